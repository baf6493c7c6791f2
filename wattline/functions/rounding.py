"""Rounding helpers.

``half_up`` / ``half_even`` round the value scaled by 10^d and scale back:
deterministic for a given double and identical to the scaled rounding most
SQL engines use, so reports agree digit for digit across engines.  ``trunc``
is the truncating integer conversion (Python ``int()``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x, d: int = 0) -> Column:
    """Half away from zero (JavaScript-style toFixed / SQL round)."""
    s = float(10 ** d)
    return F.round(_c(x) * s, 0) / s + F.lit(0.0)     # + 0.0 turns -0.0 into 0.0


def half_even(x, d: int = 0) -> Column:
    """Half to even (Python's round)."""
    s = float(10 ** d)
    return F.bround(_c(x) * s, 0) / s + F.lit(0.0)


def trunc(x) -> Column:
    """Towards zero, as an integer (Python int(), CAST in Spark)."""
    return _c(x).cast("long")
