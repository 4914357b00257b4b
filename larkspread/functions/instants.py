"""Instants written as decimal text in one of four units, as exact nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: unit -> (integer digits that fit, power of ten to nanoseconds)
_UNITS = {"s": (10, 9), "ms": (13, 6), "us": (16, 3), "ns": (19, 0)}


def instant_ns(text: str | Column, unit: str | Column) -> Column:
    """Epoch nanoseconds (bigint) of a decimal text in the unit named beside it.

    Exact decimal arithmetic; what is finer than a nanosecond is cut off. Null
    for a null, an unknown unit or a text that is no number.
    """
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    unit = F.col(unit) if isinstance(unit, str) else unit
    out = None
    for name, (digits, power) in _UNITS.items():
        scaled = text.try_cast(f"decimal({digits + 9},9)") * F.lit(10**power).cast(f"decimal({power + 1},0)")
        out = F.when(unit == name, scaled.try_cast("bigint")) if out is None else out.when(unit == name, scaled.try_cast("bigint"))
    return out
