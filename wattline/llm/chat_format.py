"""Chat formatting with typed content parts (built-ins only).

A message has an ordered list of parts: text, image, audio or document.  The
visitor flattens them: text is escaped, any other part becomes a numbered
placeholder, its reference is recorded and its expanded tokens are counted.

Template: ``<s>ROLE\\nBODY</s>`` per turn, no separators.  Control strings in
texts (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<part:``) get a backslash
after their first character, one more than they have, so the text between two
marks can be read back exactly.

Defined results: null text is empty, a null role is the empty role, a null
part list has no parts, messages of one turn are ordered by role and content,
rows with a null conversation id form one conversation.  Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Expanded tokens of one unit: a tile, a second, a page (``units`` default 1).
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:int>"

_CONTROL = r"/?(?:s>|INST\]|part:)"
_ESCAPE = r"([<\[])(\\*" + _CONTROL + ")"
_UNESCAPE = r"([<\[])\\(\\*" + _CONTROL + ")"
_TURN = r"(?s)<s>(.*?)\n(.*?)</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def escaped_role(role: Column) -> Column:
    """On one line: a backslash is ``\\b``, a newline ``\\n``."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def _tokens(p: Column) -> Column:
    per = F.coalesce(*[F.when(p["type"] == t, F.lit(n)) for t, n in TOKENS_PER_UNIT.items()], F.lit(1))
    return (per * F.coalesce(p["units"], F.lit(1))).cast("long")


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: formatted text, loss spans over it (code
    points, end exclusive), attachments and expanded token count.

    Offsets are running sums over the conversation; they share one shuffle
    with the final grouping."""
    none = F.array().cast(f"array<{PART}>")
    rows = messages.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"),
                           F.coalesce(F.col(parts).cast(f"array<{PART}>"), none).alias("_parts"))
    rows = rows.withColumn("_parts", F.filter("_parts", lambda p: p.isNotNull())).withColumn("_key", F.xxhash64("_parts"))
    rows = rows.withColumn("_att", F.filter("_parts", lambda p: ~_is_text(p)))
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seq", F.row_number().over(order))
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.size("_att")).over(before), F.lit(0)).cast("int"))
    # place of part i among the attachments: those of earlier turns plus those before it in this one
    number = lambda i: F.col("_first") + F.size(F.filter(F.slice(F.col("_parts"), F.lit(1), i + 1), lambda q: ~_is_text(q)))
    body = F.transform("_parts", lambda p, i: F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit(""))))
                       .otherwise(F.concat(F.lit("<part:"), escaped(p["type"]), F.lit(":"), number(i).cast("string"), F.lit(">"))))
    rows = rows.withColumn("_body", F.array_join(body, "")).withColumn("_open", F.concat(F.lit("<s>"), escaped_role(F.col("_role")), F.lit("\n")))
    rows = rows.withColumn("_line", F.concat("_open", "_body", F.lit("</s>")))
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("_line")).over(before), F.lit(0)).cast("long"))
    start = F.col("_at") + F.length("_open")
    span = F.when(F.col("_role") == "assistant", F.struct(start.alias("start"), (start + F.length("_body")).alias("end")))
    found = F.transform("_att", lambda p, i: F.struct((F.col("_first") + i + 1).alias("number"), F.col("_turn").alias("turn"), p["type"].alias("type"),
                                                      p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    out = rows.groupBy("_conv").agg(
        F.array_sort(F.collect_list(F.struct("_seq", F.col("_line")))).alias("_lines"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.array_sort(F.flatten(F.collect_list(found))).alias("attachments"))
    return out.select(F.col("_conv").alias(conv), F.array_join(F.transform("_lines", lambda x: x["_line"]), "").alias("formatted"),
                      "loss_spans", "attachments",
                      F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)),
                       lambda t: F.struct(unescaped_role(F.regexp_extract(t, _TURN, 1)).alias("role"),
                                          unescaped(F.regexp_extract(t, _TURN, 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
