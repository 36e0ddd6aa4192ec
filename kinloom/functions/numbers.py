"""Stored expression values and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a unit, the largest stored value, and the one that stands for a missing value. Fixed values.
SCALE, LARGEST, ABSENT = 10, 65_534, 65_535


def encoded(value: Column) -> Column:
    """A value in tenths, rounded half to even and clamped; missing, NaN and infinite values become ABSENT."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, ABSENT).otherwise(F.least(F.lit(float(LARGEST)), F.greatest(F.lit(0.0), F.rint(F.when(~bad, v) * SCALE))).cast("int"))


def decoded(code: Column) -> Column:
    return F.when(code != ABSENT, code / SCALE)


def clamped(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))
