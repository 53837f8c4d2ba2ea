"""Views of an assignment of units to partitions, its updates, and random assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E


def populations(assignment: DataFrame, units: DataFrame) -> DataFrame:
    """(partition_id, pop)."""
    return assignment.join(units.select("unit_id", "pop"), "unit_id").groupBy("partition_id").agg(F.sum("pop").alias("pop"))


def members(assignment: DataFrame) -> DataFrame:
    """The inverted index: (partition_id, n_units, units), sorted."""
    return assignment.groupBy("partition_id").agg(F.countDistinct("unit_id").alias("n_units"), F.sort_array(F.collect_set("unit_id")).alias("units"))


def affinities(assignment: DataFrame, interactions: DataFrame) -> DataFrame:
    """(partition_id, affinity): the interaction between all ordered pairs of a partition's units, each to itself once. 0
    without any."""
    a = assignment.select(F.col("unit_id").alias("src"), F.col("partition_id"))
    b = assignment.select(F.col("unit_id").alias("dst"), F.col("partition_id"))
    inner = interactions.join(a, "src").join(b, ["dst", "partition_id"]).groupBy("partition_id").agg(F.sum("weight").alias("affinity"))
    return assignment.select("partition_id").distinct().join(inner, "partition_id", "left").select("partition_id", F.coalesce("affinity", F.lit(0.0)).alias("affinity"))


def upsert(assignment: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (unit_id, partition_id, seq) over `assignment`; of rows of one unit the last by seq holds."""
    last = rows.groupBy("unit_id").agg(F.max_by("partition_id", "seq").alias("partition_id"))
    return assignment.join(last, "unit_id", "left_anti").select("unit_id", "partition_id").unionByName(last)


def load(assignment: DataFrame, rows: DataFrame) -> DataFrame:
    """`upsert`, after a check that every row names a unit of the assignment and a partition in use."""
    unknown = rows.join(assignment, "unit_id", "left_anti").limit(1).collect() or rows.join(assignment.select("partition_id"), "partition_id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"an unknown unit or partition: {unknown[0].asDict()}")
    return upsert(assignment, rows)


def reassign(assignment: DataFrame, unit_id: int, partition_id: int) -> DataFrame:
    return assignment.select("unit_id", F.when(F.col("unit_id") == unit_id, F.lit(partition_id).cast("long")).otherwise(F.col("partition_id")).alias("partition_id"))


def check_partitions(n: int, units: int) -> None:
    if not 0 < n <= units:
        raise ValueError(f"{n} partitions of {units} units")


def seeds(units: DataFrame, k: int, seed: int) -> DataFrame:
    """k units at random, numbered from 1: (unit_id, partition_id). The order is drawn from id and seed."""
    at = E.drawn(F.lit(seed), F.col("unit_id"))
    picked = units.select("unit_id").orderBy(at, "unit_id").limit(k)
    order = Window.orderBy(at, "unit_id")  # k rows
    return picked.select("unit_id", F.row_number().over(order).cast("long").alias("partition_id"))


def random_assignment(units: DataFrame, k: int, seed: int) -> DataFrame:
    """Each of k partitions gets one unit, and the others fall at random; they need not be connected."""
    check_partitions(k, units.count())
    first = F.broadcast(seeds(units, k, seed))  # k rows
    rest = E.drawn(F.lit(seed), F.col("unit_id"), F.lit("rest")) % k + 1
    return units.select("unit_id").join(first, "unit_id", "left").select("unit_id", F.coalesce("partition_id", rest).alias("partition_id"))
