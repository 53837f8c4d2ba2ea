"""Population moments of units from census blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..schemas import EARTH_RADIUS_KM


def vertices(blocks: DataFrame, *keys: str) -> DataFrame:
    """The points of all rings of `geometry`, holes and closing points included: (keys, lon, lat)."""
    points = blocks.select(*keys, F.explode(F.flatten(F.flatten("geometry"))).alias("p"))
    return points.select(*keys, F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def block_positions(points: DataFrame, *keys: str, latitude: str = "reference") -> DataFrame:
    """(keys, x, y, z): the plain mean of a block's points, in kilometres, not brought back to the sphere."""
    vector = geo.sphere_vector(F.col("lon"), F.col("lat"), latitude)
    return points.groupBy(*keys).agg(*((EARTH_RADIUS_KM * F.avg(v)).alias(n) for n, v in zip("xyz", vector)))


def unit_moments(blocks: DataFrame) -> DataFrame:
    """blocks: (unit_id, pop, x, y, z). (unit_id, pop, x, y, z, var): population, mean position and the population's
    variance about it, summed over the axes and not below 0. Units without population have no position and are left out."""
    sums = blocks.filter("x is not null").groupBy("unit_id").agg(
        F.sum("pop").alias("w"), *(F.sum(F.col("pop") * F.col(a)).alias(a) for a in "xyz"), F.sum(F.col("pop") * (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("sq")
    )
    mean = sums.filter("w > 0").select("unit_id", F.col("w").cast("long").alias("pop"), *((F.col(a) / F.col("w")).alias(a) for a in "xyz"), (F.col("sq") / F.col("w")).alias("sq"))
    return mean.select("unit_id", "pop", "x", "y", "z", F.greatest(F.col("sq") - F.col("x") * F.col("x") - F.col("y") * F.col("y") - F.col("z") * F.col("z"), F.lit(0.0)).alias("var"))


def unplaced_units(blocks: DataFrame) -> DataFrame:
    """Units that `unit_moments` leaves out: (unit_id, blocks)."""
    return blocks.groupBy("unit_id").agg(F.count("*").alias("blocks"), F.sum(F.when(F.col("x").isNotNull(), F.col("pop")).otherwise(0)).alias("w")).filter("w <= 0").drop("w")
