"""Colours of units or partitions as columns of #rrggbb text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E

# A categorical palette of ten pairs, and the stops of two continuous ones.
CATEGORIES = ("#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c", "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5", "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f", "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5")
SEQUENTIAL = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))
BLUE_WHITE_RED = ((0, 0, 255), (255, 255, 255), (255, 0, 0))


def categorical(id: Column) -> Column:
    """By the id, not the value."""
    return F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (F.pmod(id, F.lit(len(CATEGORIES))) + 1).cast("int"))


def ramp(at: Column, stops: tuple[tuple[int, int, int], ...] = SEQUENTIAL) -> Column:
    """The colour at 0 to 1 between evenly spaced stops."""
    last = len(stops) - 1
    k = F.least(F.floor(at * last), F.lit(last - 1)).cast("int")
    part = at * last - k

    def channel(c: int) -> Column:
        values = F.array(*(F.lit(float(s[c])) for s in stops))
        low, high = F.element_at(values, k + 1), F.element_at(values, k + 2)
        return F.lower(F.lpad(F.hex(F.round(low + (high - low) * part).cast("long")), 2, "0"))

    return F.concat(F.lit("#"), *(channel(c) for c in range(3)))


def with_position(df: DataFrame, value: str, log_scale: bool = False, least: float | None = None, most: float | None = None) -> DataFrame:
    """Adds `at`, where `value` lies between the least and the most of all rows, or between the given ones."""
    low = F.lit(least) if least is not None else df.select(F.min(value)).scalar()
    high = F.lit(most) if most is not None else df.select(F.max(value)).scalar()
    return df.withColumn("at", E.unit_range(F.col(value), low, high, log_scale))
