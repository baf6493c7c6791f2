"""Text helpers as built-in expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks recognised by Python's str.splitlines.
LINE_BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAKS)


def loc_count(text: Column, strip_comment_prefix: bool = True) -> Column:
    """Non-blank lines that do not start with ``#``.  ``strip_comment_prefix``
    checks ``#`` after leading blanks; the gate script checks the raw line.
    One regular expression per line: ``^\\s*[^\\s#]`` holds exactly when the
    line has a non-blank character and its first one is not ``#``."""
    if strip_comment_prefix:
        keep = lambda x: x.rlike(r"^\s*[^\s#]")
    else:
        keep = lambda x: x.rlike(r"^\s*\S") & ~x.startswith("#")
    return F.size(F.filter(lines(text), keep))


def sql_loc_count(col: str, strip_comment_prefix: bool = True) -> str:
    """The same count as DuckDB SQL text (for oracles and docs)."""
    comment = r"^\s*#" if strip_comment_prefix else r"^#"
    return (f"len(list_filter(regexp_split_to_array({col}, '{LINE_BREAKS}'), "
            f"lambda x: NOT regexp_matches(x, '^\\s*$') AND NOT regexp_matches(x, '{comment}')))")
