"""Constant arrays that are one expression each, however long: a plan is gone over many times before it runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts the strings of a constant; no pattern or name holds it.
PART = "\x1f"


def strings(values: Iterable[str]) -> Column:
    """An array of strings, not empty."""
    values = list(values)
    if not values or any(PART in x for x in values):
        raise ValueError("no values, or one with U+001F")
    return F.split(F.lit(PART.join(values)), PART, -1)


def ints(values: Iterable[int]) -> Column:
    """An array of ints, not empty."""
    return F.split(F.lit(",".join(str(int(x)) for x in values)), ",", -1).cast("array<int>")
