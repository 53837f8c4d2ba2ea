"""Candidate swaps of a unit to a neighbouring partition: affinities, legality, scores and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..storage import materialize


def _named(assignment: DataFrame, unit: str, partition: str) -> DataFrame:
    return assignment.select(F.col("unit_id").alias(unit), F.col("partition_id").alias(partition))


def adjacent_partitions(assignment: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(unit_id, src_partition, dst_partition) for the partitions, other than its own, that a unit's neighbours are in."""
    found = adjacency.select("src", "dst").join(_named(assignment, "src", "src_partition"), "src").join(_named(assignment, "dst", "dst_partition"), "dst")
    return found.filter("src_partition <> dst_partition").select(F.col("src").alias("unit_id"), "src_partition", "dst_partition").distinct()


def candidates(assignment: DataFrame, adjacency: DataFrame, interactions: DataFrame) -> DataFrame:
    """(unit_id, src_partition, dst_partition, affinity): how much more, in logarithms, the unit interacts with the other
    partition than with its own."""
    moves = adjacent_partitions(assignment, adjacency)
    border = moves.select("unit_id").distinct()
    held = interactions.filter("src <> dst").join(border, F.col("src") == F.col("unit_id"), "left_semi").join(_named(assignment, "dst", "partition"), "dst")
    sums = held.groupBy(F.col("src").alias("unit_id"), "partition").agg(F.sum("weight").alias("w"))
    to = sums.select("unit_id", F.col("partition").alias("dst_partition"), F.col("w").alias("to_dst"))
    own = sums.select("unit_id", F.col("partition").alias("src_partition"), F.col("w").alias("to_src"))
    found = moves.join(to, ["unit_id", "dst_partition"], "left").join(own, ["unit_id", "src_partition"], "left")
    log = lambda c: E.log_affinity(F.coalesce(c, F.lit(0.0)))
    return found.select("unit_id", "src_partition", "dst_partition", (log("to_dst") - log("to_src")).alias("affinity"))


def _connected(nodes: Column, links: Column) -> Column:
    """The nodes, one at least, hang together by the links (struct of a and b). Groups of nodes, single at first, are
    merged link by link; there are as many nodes as a unit has neighbours."""

    def merged(groups: Column, link: Column) -> Column:
        holds = lambda g: F.array_contains(g, link["a"]) | F.array_contains(g, link["b"])
        return F.concat(F.filter(groups, lambda g: ~holds(g)), F.array(F.flatten(F.filter(groups, holds))))

    return F.size(F.aggregate(links, F.transform(nodes, lambda n: F.array(n)), merged)) == 1


def sides(moves: DataFrame, assignment: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(unit_id, partition, connected): whether a unit's neighbours in a partition of one of its moves hang together
    among themselves. A missing row: it has none there. As many nodes and edges as a unit has neighbours."""
    wanted = moves.select("unit_id", F.col("dst_partition").alias("partition")).union(moves.select("unit_id", "src_partition")).distinct()
    near = adjacency.select(F.col("src").alias("unit_id"), F.col("dst").alias("near")).filter("unit_id <> near").join(_named(assignment, "near", "partition"), "near").join(wanted, ["unit_id", "partition"], "left_semi")
    a, b = near.withColumnRenamed("near", "src"), near.withColumnRenamed("near", "dst")
    inner = a.join(adjacency.filter("src < dst").select("src", "dst"), "src").join(b, ["unit_id", "partition", "dst"])
    links = inner.groupBy("unit_id", "partition").agg(F.collect_list(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))).alias("links"))
    nodes = near.groupBy("unit_id", "partition").agg(F.collect_set("near").alias("nodes")).join(links, ["unit_id", "partition"], "left")
    links = F.coalesce("links", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    # one neighbour, or fewer links than a tree has, need no merging
    whole = F.when(F.size("nodes") == 1, True).when(F.size(links) < F.size("nodes") - 1, False).otherwise(_connected(F.col("nodes"), links))
    return nodes.select("unit_id", "partition", whole.alias("connected"))


def legality(moves: DataFrame, assignment: DataFrame, adjacency: DataFrame, force_connected: bool = True) -> DataFrame:
    """`moves` (unit_id, src_partition, dst_partition, ...) with `legal`: the unit is not its partition's last, and, if
    partitions must be connected, its neighbours in either partition hang together without it, one on each side at least.
    That is enough for both to stay connected, but not needed."""
    sizes = assignment.groupBy(F.col("partition_id").alias("src_partition")).agg(F.count("*").alias("n_src"))
    found = moves.join(sizes, "src_partition")
    if not force_connected:
        return found.withColumn("legal", F.col("n_src") > 1).drop("n_src")
    side = sides(moves, assignment, adjacency)
    for end in ("src", "dst"):
        found = found.join(side.select("unit_id", F.col("partition").alias(f"{end}_partition"), F.col("connected").alias(f"{end}_ok")), ["unit_id", f"{end}_partition"], "left")
    legal = (F.col("n_src") > 1) & F.coalesce("src_ok", F.lit(False)) & F.coalesce("dst_ok", F.lit(False))
    return found.withColumn("legal", legal).drop("n_src", "src_ok", "dst_ok")


def scores(found: DataFrame, populations: DataFrame, population_weight: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """`found` (unit_id, src_partition, dst_partition, affinity, ...) with pop_diff and score: the z-scores of affinity and
    population difference, over all candidates, weighted and divided by the temperature."""
    if temperature <= 0:
        raise ValueError("the temperature must be above 0")
    for end in ("src", "dst"):
        found = found.join(populations.select(F.col("partition_id").alias(f"{end}_partition"), F.col("pop").alias(f"{end}_pop")), f"{end}_partition")
    found = found.withColumn("pop_diff", (F.col("src_pop") - F.col("dst_pop")).cast("double")).drop("src_pop", "dst_pop")

    def z(name: str) -> Column:
        mean = F.avg(name)
        stats = found.select(F.struct(mean.alias("mean"), F.sqrt(F.greatest(F.avg(F.col(name) * F.col(name)) - mean * mean, F.lit(E.LEAST_VARIANCE))).alias("sd")).alias("s")).scalar()
        return (F.col(name) - stats["mean"]) / stats["sd"]

    return found.withColumn("score", (z("affinity") + population_weight * z("pop_diff")) / temperature)


_BUCKET = 4096


def cumulative_softmax(scored: DataFrame) -> DataFrame:
    """`scored` with `cdf`, the running share of exp(score) by unit and partition. The running sum has two levels, of
    id ranges and within them."""
    most = scored.select(F.max("score")).scalar()
    held = scored.withColumn("p", F.exp(F.col("score") - most)).withColumn("range", F.floor(F.col("unit_id") / _BUCKET))
    ranges = held.groupBy("range").agg(F.sum("p").alias("range_p"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each 4096 ids
    ranges = ranges.withColumn("base", F.sum("range_p").over(before) - F.col("range_p"))
    own = Window.partitionBy("range").orderBy("unit_id", "dst_partition").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = held.select(F.sum("p")).scalar()
    return held.join(ranges, "range").withColumn("cdf", (F.col("base") + F.sum("p").over(own)) / total).drop("p", "range", "range_p", "base")


def pick_inverse(scored: DataFrame, u: float) -> DataFrame:
    """The first candidate whose cumulative share reaches u: one row, or none without candidates."""
    return cumulative_softmax(scored).filter(F.col("cdf") >= u).orderBy("unit_id", "dst_partition").limit(1)


def pick(scored: DataFrame, seed: int) -> DataFrame:
    """One legal candidate, drawn with a chance in proportion to exp(score): the one with the highest score plus Gumbel
    noise, which is a hash of seed, unit and partition. No sort and no order is needed."""
    u = (E.drawn(F.lit(seed), F.col("unit_id"), F.col("dst_partition")) + 0.5) / F.lit(float(E.DRAWN))
    noisy = scored.filter("legal").withColumn("noisy", F.col("score") - F.ln(-F.ln(u)))
    return noisy.orderBy(F.desc("noisy"), "unit_id", "dst_partition").limit(1).drop("noisy")


def step(assignment: DataFrame, adjacency: DataFrame, interactions: DataFrame, populations: DataFrame, seed: int, population_weight: float = 1.0, temperature: float = 1.0, force_connected: bool = True) -> DataFrame:
    """The move of one annealing step, as DataFrames throughout: one row of candidates, or none. Ten rejected draws and
    then one among legal moves have the same law as one draw among legal moves, which this is."""
    found = materialize(candidates(assignment, adjacency, interactions), "candidates")
    return pick(legality(scores(found, populations, population_weight, temperature), assignment, adjacency, force_connected), seed)
