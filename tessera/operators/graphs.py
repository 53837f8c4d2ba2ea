"""Weighted graphs of units as edge tables with both directions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: Half of the 26 cells around one, so that two cells meet once.
_AHEAD = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def segments(boundaries: DataFrame) -> DataFrame:
    """The segments between neighbouring points of every ring: (unit_id, poly, ring, seq, x1, y1, x2, y2). A projection
    of each row; rings of one point have none."""
    rings = boundaries.select("unit_id", F.posexplode("geometry").alias("poly", "polygon")).select("unit_id", "poly", F.posexplode("polygon").alias("ring", "points"))
    pairs = F.when(F.size("points") > 1, F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b"))))
    found = rings.select("unit_id", "poly", "ring", F.posexplode(pairs).alias("seq", "s"))
    return found.select("unit_id", "poly", "ring", "seq", F.col("s.a")[0].alias("x1"), F.col("s.a")[1].alias("y1"), F.col("s.b")[0].alias("x2"), F.col("s.b")[1].alias("y2"))


def undirected(found: DataFrame) -> DataFrame:
    """Adds `low` and `high`, the ends of a segment in the order of their coordinates."""
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return found.withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))


def border_pairs(found: DataFrame) -> DataFrame:
    """Segments that two units share: (a, b, low, high), a < b. A segment's occurrences, by unit and place in it, pair up
    first with second, third with fourth; a pair within one unit is no border."""
    order = Window.partitionBy("low", "high").orderBy("unit_id", "poly", "ring", "seq")
    pairs = undirected(found).withColumn("pair", F.floor((F.row_number().over(order) + 1) / 2)).groupBy("low", "high", "pair")
    return pairs.agg(F.min("unit_id").alias("a"), F.max("unit_id").alias("b")).filter("a < b").select("a", "b", "low", "high")


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionAll(pairs.select("b", "a", "weight"))


def adjacency(boundaries: DataFrame) -> DataFrame:
    """Border lengths in kilometres."""
    length = geo.haversine_km(F.col("low.x"), F.col("low.y"), F.col("high.x"), F.col("high.y"))
    return mirrored(border_pairs(segments(boundaries)).groupBy("a", "b").agg(F.sum(length).alias("weight")))


def interactions(units: DataFrame, sigma_km: float, max_km: float) -> DataFrame:
    """Interaction of all units within `max_km` of each other (straight through the sphere), and twice the kernel at
    distance 0 from each to itself. One side is sent to its cell and the 13 cells ahead, so a pair meets once."""
    cell = [F.floor(F.col(a) / max_km).cast("long").alias(f"b{a}") for a in "xyz"]
    held = units.select("unit_id", "pop", "x", "y", "z", "var", *cell)
    other = held.select(*(F.col(c).alias(f"{c}_2") for c in ("unit_id", "pop", "x", "y", "z", "var")), "bx", "by", "bz")
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("xyz", d))) for d in [(0, 0, 0), *_AHEAD]))
    sent = held.withColumn("d", F.explode(steps)).withColumn("same", F.col("d") == F.struct(*(F.lit(0).alias(n) for n in "xyz")))
    for a in "xyz":
        sent = sent.withColumn(f"b{a}", F.col(f"b{a}") + F.col(f"d.{a}"))
    dist_sq = sum((F.pow(F.col(f"{a}_2") - F.col(a), 2) for a in "yz"), F.pow(F.col("x_2") - F.col("x"), 2))
    met = sent.join(other, ["bx", "by", "bz"]).withColumn("dist_sq", dist_sq)
    met = met.filter((F.col("dist_sq") <= max_km**2) & (~F.col("same") | (F.col("unit_id") < F.col("unit_id_2"))))
    weight = geo.interaction(F.col("dist_sq"), F.col("var"), F.col("var_2"), F.col("pop"), F.col("pop_2"), sigma_km)
    own = 2 * geo.interaction(F.lit(0.0), F.col("var"), F.col("var"), F.col("pop"), F.col("pop"), sigma_km)
    return mirrored(met.select(F.col("unit_id").alias("a"), F.col("unit_id_2").alias("b"), weight.alias("weight"))).unionAll(units.select("unit_id", "unit_id", own))
