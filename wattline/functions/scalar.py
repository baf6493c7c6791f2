"""Scalar helpers used by the workload-profile queries (all built-ins)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def strength_score(text: Column) -> Column:
    """+25 when any upper-case letter, +25 when any digit (Unicode classes)."""
    return (F.when(text.rlike(r"\p{Lu}"), 25).otherwise(0) + F.when(text.rlike(r"\p{Nd}"), 25).otherwise(0))


def ascii_words(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z]+")


def is_palindrome(word: Column, min_len: int = 3) -> Column:
    return (F.length(word) >= min_len) & (word == F.reverse(word))


def guarded_tan(angle: Column, eps: float = 1e-5) -> Column:
    """tan only where |cos| > eps (null elsewhere)."""
    return F.when(F.abs(F.cos(angle)) > eps, F.tan(angle))


def angle_of(i: Column, n: int) -> Column:
    return i * (2.0 * math.pi) / float(n)


def rule_class(x: Column, y: Column, z: Column, w: Column, v: Column) -> Column:
    """Nested decision rules of the branching workload, as one CASE tree."""
    return (F.when(x > 0.5,
                   F.when(y < 0.3,
                          F.when(z > 0.7,
                                 F.when(w == "A", F.when(v % 2 == 0, 1).otherwise(2)).otherwise(3))
                          .otherwise(F.when(w == "B", 4).otherwise(5)))
                   .otherwise(F.when(z < 0.4, F.when(w == "A", 6).otherwise(7)).otherwise(8)))
            .otherwise(F.when(y > 0.6,
                              F.when(z < 0.2, F.when(w == "C", 9).otherwise(10))
                              .otherwise(F.when(w == "A", 11).otherwise(12)))
                       .otherwise(F.when(z > 0.5, F.when(v % 3 == 0, 13).otherwise(14)).otherwise(15))))
