"""Other expressions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAJOR_PARTIES = ("DEMOCRAT", "REPUBLICAN")
LEAST_AFFINITY = LEAST_VARIANCE = LEAST_RANGE = 1e-12


def unit_id(state: Column, county: Column) -> Column:
    """A county's id from its state's number and its own, which may be text."""
    return state.cast("long") * 1000 + county.cast("long")


def state_of(unit: Column) -> Column:
    return F.floor(unit / 1000).cast("long")


def party(name: Column) -> Column:
    return F.when(name.isin(*MAJOR_PARTIES), name).otherwise("OTHER")


def log_affinity(value: Column) -> Column:
    return F.ln(F.greatest(value, F.lit(LEAST_AFFINITY)))


def ratio(part: Column, rest: Column) -> Column:
    """part / (part + rest), NaN where both are 0."""
    return F.coalesce(F.try_divide(part.cast("double"), (part + rest).cast("double")), F.lit(float("nan")))


def log_interpolated(start: float, end: float, steps: int, step: Column) -> Column:
    """From start at step 1 to end at the last step, evenly in logarithms."""
    return F.when(step >= steps, F.lit(float(end))).otherwise(F.exp(F.ln(F.lit(float(start))) + (F.ln(F.lit(float(end))) - F.ln(F.lit(float(start)))) * (step - 1) / F.lit(float(max(steps - 1, 1)))))


def unit_range(value: Column, least: Column, most: Column, log_scale: bool = False) -> Column:
    """Where value lies between least and most, from 0 to 1; beyond them it stops there."""
    f = F.ln if log_scale else (lambda c: c)
    at = (f(value) - f(least)) / F.greatest(f(most) - f(least), F.lit(LEAST_RANGE))
    return F.greatest(F.least(at, F.lit(1.0)), F.lit(0.0))


def grid_index(value: Column, size: float) -> Column:
    """The cell of a coordinate, towards zero: cells at zero are twice as wide."""
    return F.signum(value).cast("long") * F.floor(F.abs(value) / size).cast("long")


def commands(line: Column) -> Column:
    """The commands of a line, each a struct of a lower-case name and parameters in their own case."""
    return F.transform(F.split(line, ";"), lambda c: F.struct(F.lower(F.trim(F.element_at(F.split(c, "=", 2), 1))).alias("command"), F.trim(F.coalesce(F.try_element_at(F.split(c, "=", 2), F.lit(2)), F.lit(""))).alias("params")))


#: Numbers from 0 that `drawn` gives.
DRAWN = 1 << 52


def drawn(*parts: Column) -> Column:
    """A random number below `DRAWN` that the parts, as text, decide: the first bits of their MD5."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
