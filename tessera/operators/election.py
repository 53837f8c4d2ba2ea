"""Election returns, apportionment of seats and the electoral college."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..storage import materialize
from .assignment import populations

#: Seats dealt out among the partitions; Alaska's and Hawaii's three are left out, and their electors fixed.
SEATS, DEM_FIXED, GOP_FIXED = 432, 4, 3
EXCLUDED_STATES = ("AK", "HI")


def parse_returns(returns: DataFrame, year: int = 2020, excluded: tuple[str, ...] = EXCLUDED_STATES) -> DataFrame:
    """(unit_id, dem, gop, other) of one year: rows of excluded states, and rows whose county is no number, don't count."""
    rows = returns.filter((F.col("year") == year) & ~F.col("state_po").isin(*excluded)).withColumn("unit_id", F.expr("try_cast(fips as bigint)")).filter("unit_id is not null")
    named = E.party(F.coalesce("party", F.lit("")))
    total = lambda p: F.coalesce(F.sum(F.when(named == p, F.col("votes"))), F.lit(0)).cast("long")
    return rows.groupBy("unit_id").agg(total("DEMOCRAT").alias("dem"), total("REPUBLICAN").alias("gop"), total("OTHER").alias("other"))


def apportion(populations: DataFrame, seats: int = SEATS) -> DataFrame:
    """Huntington-Hill: (partition_id, seats). One seat each, and the rest to the highest priorities, ties to the higher
    id. A partition's priorities fall from seat to seat, so the highest of all are what a heap would give."""
    rest = F.greatest(F.lit(seats) - populations.select(F.count("*")).scalar(), F.lit(0))
    steps = populations.select("partition_id", "pop", F.explode(F.sequence(F.lit(1), F.lit(seats))).alias("k"))
    steps = steps.withColumn("priority", F.col("pop") / F.sqrt(F.col("k") * (F.col("k") + 1.0)))
    won = steps.orderBy(F.desc("priority"), F.desc("partition_id")).limit(seats)
    by_priority = Window.orderBy(F.desc("priority"), F.desc("partition_id"))  # over `seats` rows at most
    won = won.withColumn("place", F.row_number().over(by_priority)).filter(F.col("place") <= rest).groupBy("partition_id").agg(F.count("*").alias("more"))
    return populations.join(won, "partition_id", "left").select("partition_id", (1 + F.coalesce("more", F.lit(0))).cast("long").alias("seats"))


def partition_votes(assignment: DataFrame, votes: DataFrame, strict: bool = True) -> DataFrame:
    """(partition_id, dem, gop). strict: a unit without votes is an error, else it has none."""
    joined = assignment.join(votes, "unit_id", "left")
    if strict:
        joined = joined.withColumn("dem", F.when(F.col("dem").isNull(), F.raise_error(F.concat(F.lit("no votes for unit "), F.col("unit_id").cast("string"))).cast("long")).otherwise(F.col("dem")))
    return joined.groupBy("partition_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("dem", "gop")))


def simulate(assignment: DataFrame, units: DataFrame, votes: DataFrame, strict: bool = True) -> DataFrame:
    """(partition_id, pop, dem, gop, gop_fraction, seats, electors, winner). A tie goes to GOP; a partition's electors
    are its seats and two. gop_fraction is NaN where neither party has votes."""
    held = materialize(populations(assignment, units), "populations")  # a row for each partition, used four times
    found = held.join(partition_votes(assignment, votes, strict), "partition_id").join(apportion(held), "partition_id")
    winner = F.when(F.col("dem") > F.col("gop"), "DEM").otherwise("GOP")
    return found.select("partition_id", "pop", "dem", "gop", E.ratio(F.col("gop"), F.col("dem")).alias("gop_fraction"), "seats", (F.col("seats") + 2).alias("electors"), winner.alias("winner"))


def college(simulated: DataFrame) -> DataFrame:
    """(dem_electors, gop_electors), with the fixed ones."""
    total = lambda p, fixed: (fixed + F.coalesce(F.sum(F.when(F.col("winner") == p, F.col("electors"))), F.lit(0))).cast("long")
    return simulated.agg(total("DEM", DEM_FIXED).alias("dem_electors"), total("GOP", GOP_FIXED).alias("gop_electors"))
