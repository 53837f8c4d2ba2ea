"""The engine's queries by name, over whole tables, and DuckDB's SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import assignment as A
from ..operators import chains, colours, election, geometry, graphs, moments, swaps
from ..operators import components as C
from ..sources import readers
from ..storage import materialize
from . import fixtures as X
from .fixtures import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

GRID_SIZE = 0.0317123
SEED, CHAINS, STEPS = 7, 4, 40


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- election -----------------------------------------------------------------------------------------------------


@query(duck("SELECT partition_id, pop, dem, gop, round(gop_fraction, 9) AS gop_fraction, seats, electors, winner FROM simulated", "simulated"))
def election_sim(spark: SparkSession, d: str) -> DataFrame:
    return rounded(election.simulate(X.blocky(spark, d), X.units(spark, d), X.votes(spark, d)), 9, "gop_fraction")


@query(
    duck(
        f"""SELECT CAST(fips AS BIGINT) AS unit_id, CAST(coalesce(sum(votes) FILTER (WHERE party = 'DEMOCRAT'), 0) AS BIGINT) AS dem,
  CAST(coalesce(sum(votes) FILTER (WHERE party = 'REPUBLICAN'), 0) AS BIGINT) AS gop, CAST(coalesce(sum(votes) FILTER (WHERE party NOT IN ('DEMOCRAT', 'REPUBLICAN')), 0) AS BIGINT) AS other
  FROM returns WHERE year = {X.YEAR} AND state_po NOT IN {X.EXCLUDED} AND fips <> 'NA' GROUP BY 1""",
        "returns",
    )
)
def parse_returns(spark: SparkSession, d: str) -> DataFrame:
    return election.parse_returns(X.returns(spark, d).drop("unit_id"), X.YEAR, X.EXCLUDED)


@query(duck("SELECT partition_id, seats FROM seats", "seats"))
def house_seats(spark: SparkSession, d: str) -> DataFrame:
    return election.apportion(A.populations(X.blocky(spark, d), X.units(spark, d)))


@query(
    duck(
        f"""SELECT CAST({election.DEM_FIXED} + coalesce(sum(electors) FILTER (WHERE winner = 'DEM'), 0) AS BIGINT) AS dem_electors,
  CAST({election.GOP_FIXED} + coalesce(sum(electors) FILTER (WHERE winner = 'GOP'), 0) AS BIGINT) AS gop_electors FROM simulated""",
        "simulated",
    )
)
def electoral_totals(spark: SparkSession, d: str) -> DataFrame:
    return election.college(election.simulate(X.blocky(spark, d), X.units(spark, d), X.votes(spark, d)))


@query(
    duck(
        "SELECT partition_id, CAST(sum(dem) AS BIGINT) AS dem, CAST(sum(gop) AS BIGINT) AS gop, round(sum(gop) / CAST(sum(dem) + sum(gop) AS DOUBLE), 9) AS gop_fraction FROM scattered JOIN votes USING (unit_id) GROUP BY 1",
        "scattered",
        "votes",
    )
)
def gop_fraction(spark: SparkSession, d: str) -> DataFrame:
    found = election.partition_votes(X.scattered(spark, d), X.votes(spark, d))
    return found.select("partition_id", "dem", "gop", F.round(E.ratio(F.col("gop"), F.col("dem")), 9).alias("gop_fraction"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS name, r_name AS alpha FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (1, 6, 12)")
def state_select(spark: SparkSession, d: str) -> DataFrame:
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    states = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("alpha"), F.col("n_nationkey").cast("long").alias("code"))
    return readers.select_states(states, ["6", "12", "1", "6"]).select("code", "name", "alpha")


# --- moments and graphs -------------------------------------------------------------------------------------------


@query(duck("SELECT block, unit_id, pop, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM blocks", "blocks"))
def block_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.block_positions(X.block_points(spark, d), "block", "unit_id", "pop"), 4, "x", "y", "z")


@query(duck("SELECT unit_id, pop, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(var, 4) AS var FROM units", "units"))
def unit_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.units(spark, d), 4, "x", "y", "z", "var")


@query(duck("SELECT src, dst, round(weight, 2) AS weight FROM inter", "inter"))
def interaction_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.interactions(spark, d), 2, "weight")


def _corner(name: str, step: float, base: float) -> F.Column:
    return F.round((F.col(name) - base) / step).cast("long")


def _cornered(df: DataFrame, low: str = "low", high: str = "high") -> list:
    return [_corner(f"{p}.{a}", s, b).alias(f"{n}{k}") for k, p in ((1, low), (2, high)) for n, a, s, b in (("i", "x", X.STEP_LON, X.WEST), ("j", "y", X.STEP_LAT, X.SOUTH))]


@query(duck("SELECT unit_id, seq, i1, j1, i2, j2 FROM sides", "sides").replace("0 AS seq", "CAST(0 AS INTEGER) AS seq"))
def segments(spark: SparkSession, d: str) -> DataFrame:
    found = graphs.undirected(graphs.segments(X.boundaries(spark, d)))
    return found.select("unit_id", "seq", *_cornered(found))


@query(duck("SELECT src, dst, round(weight, 6) AS weight FROM adj", "adj"))
def adjacency_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.adjacency(spark, d), 6, "weight")


# --- assignments --------------------------------------------------------------------------------------------------


@query(duck("SELECT partition_id, pop FROM pops", "pops"))
def partition_population(spark: SparkSession, d: str) -> DataFrame:
    return A.populations(X.blocky(spark, d), X.units(spark, d))


@query(
    duck(
        """SELECT partition_id, round(coalesce(affinity, 0), 0) AS affinity FROM (SELECT DISTINCT partition_id FROM blocky) LEFT JOIN (
  SELECT a.partition_id, sum(weight) AS affinity FROM inter JOIN blocky a ON a.unit_id = src JOIN blocky b ON b.unit_id = dst WHERE a.partition_id = b.partition_id GROUP BY 1) USING (partition_id)""",
        "inter",
        "blocky",
    )
)
def partition_affinity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.affinities(X.blocky(spark, d), X.interactions(spark, d)), 0, "affinity")


@query(duck("SELECT partition_id, count(*) AS n_units, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY unit_id) AS units FROM scattered GROUP BY 1", "scattered"))
def partition_index(spark: SparkSession, d: str) -> DataFrame:
    return A.members(X.scattered(spark, d)).withColumn("units", F.array_join(F.col("units").cast("array<string>"), ","))


@query(
    duck(
        """SELECT b.unit_id, coalesce(s.partition_id, b.partition_id) AS partition_id FROM blocky b LEFT JOIN (SELECT unit_id, partition_id FROM scattered WHERE unit_id % 3 = 0) s USING (unit_id)
UNION ALL SELECT unit_id + 1000000000, partition_id FROM scattered WHERE unit_id % 10 = 0""",
        "blocky",
        "scattered",
    )
)
def assignment_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows of other units are updated twice, the second of which holds, and some are new."""
    s = X.scattered(spark, d)
    first = s.filter("unit_id % 3 = 0").select("unit_id", F.lit(-1).cast("long").alias("partition_id"), F.lit(0).alias("seq"))
    second = s.filter("unit_id % 3 = 0").withColumn("seq", F.lit(1))
    new = s.filter("unit_id % 10 = 0").select((F.col("unit_id") + 1_000_000_000).alias("unit_id"), "partition_id", F.lit(0).alias("seq"))
    return A.upsert(X.blocky(spark, d), first.union(second).union(new))


_REACH = """links AS (SELECT src, dst FROM adj JOIN scattered a ON a.unit_id = src JOIN scattered b ON b.unit_id = dst WHERE a.partition_id = b.partition_id),
reach AS (SELECT unit_id AS root, unit_id AS node FROM scattered UNION SELECT r.root, l.dst FROM reach r JOIN links l ON l.src = r.node WHERE r.root < l.dst),
found AS (SELECT node AS unit_id, min(root) AS component FROM reach GROUP BY 1)"""


@query(duck(f"{_REACH} SELECT unit_id, partition_id, component FROM scattered JOIN found USING (unit_id)", "adj", "scattered", recursive=True))
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return C.partition_components(X.scattered(spark, d), X.adjacency(spark, d))


@query(
    duck(
        f"""{_REACH}, sums AS (SELECT partition_id, component, CAST(sum(pop) AS BIGINT) AS pop FROM scattered JOIN found USING (unit_id) JOIN units USING (unit_id) GROUP BY 1, 2)
SELECT partition_id, component, pop, n_components FROM (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY pop DESC, component) AS r, count(*) OVER (PARTITION BY partition_id) AS n_components FROM sums) WHERE r = 1""",
        "adj",
        "scattered",
        "units",
        recursive=True,
    )
)
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    return C.largest_components(C.partition_components(X.scattered(spark, d), X.adjacency(spark, d)), X.units(spark, d))


# a walk from settled units to one as near as any reaches it by as many hops; of such walks the least partition holds
_REPAIRED = f"""{_REACH}, sums AS (SELECT partition_id, component, CAST(sum(pop) AS BIGINT) AS pop FROM scattered JOIN found USING (unit_id) JOIN units USING (unit_id) GROUP BY 1, 2),
best AS (SELECT partition_id, component FROM sums QUALIFY row_number() OVER (PARTITION BY partition_id ORDER BY pop DESC, component) = 1),
settled AS (SELECT unit_id, partition_id FROM scattered JOIN found USING (unit_id) JOIN best USING (partition_id, component)), n_loose AS (SELECT (SELECT count(*) FROM scattered) - (SELECT count(*) FROM settled) AS n),
hops AS (SELECT unit_id, 0 AS hop FROM settled UNION SELECT dst, hop + 1 FROM hops JOIN adj ON src = unit_id ANTI JOIN settled s ON s.unit_id = dst WHERE hop < least(200, (SELECT n FROM n_loose))),
nearest AS (SELECT unit_id, min(hop) AS hop FROM hops GROUP BY 1),
walks AS (SELECT unit_id, partition_id, 0 AS hop FROM settled UNION SELECT dst, partition_id, w.hop + 1 FROM walks w JOIN adj ON src = w.unit_id JOIN nearest n ON n.unit_id = dst AND n.hop = w.hop + 1)
SELECT unit_id, min(partition_id) AS partition_id FROM walks GROUP BY 1"""


@query(duck(_REPAIRED, "adj", "scattered", "units", recursive=True))
def repair_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return C.repair(X.scattered(spark, d), X.adjacency(spark, d), X.units(spark, d))


def _duck_drawn(*parts: object) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13) AS BIGINT)"


@query(duck(f"SELECT unit_id, CASE WHEN r <= 16 THEN r ELSE {_duck_drawn(SEED, 'unit_id', chr(39) + 'rest' + chr(39))} % 16 + 1 END AS partition_id FROM (SELECT unit_id, row_number() OVER (ORDER BY {_duck_drawn(SEED, 'unit_id')}, unit_id) AS r FROM grid)", "grid"))
def random_partition(spark: SparkSession, d: str) -> DataFrame:
    return A.random_assignment(X.grid(spark, d), 16, SEED)


# --- swaps --------------------------------------------------------------------------------------------------------


@query(duck("SELECT unit_id, src_partition, dst_partition FROM moves", "moves"))
def adjacent_partitions(spark: SparkSession, d: str) -> DataFrame:
    return swaps.adjacent_partitions(X.blocky(spark, d), X.adjacency(spark, d))


@query(duck("SELECT unit_id, src_partition, dst_partition, round(affinity, 6) AS affinity FROM candidates", "candidates"))
def swap_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(swaps.candidates(X.blocky(spark, d), X.adjacency(spark, d), X.interactions(spark, d)), 6, "affinity")


_MOVED = "SELECT DISTINCT src AS unit_id, a.partition_id AS src_partition, b.partition_id AS dst_partition FROM brick JOIN blocky a ON a.unit_id = src JOIN blocky b ON b.unit_id = dst WHERE a.partition_id <> b.partition_id"
_SIDES = """near AS (SELECT src AS unit_id, partition_id AS side, dst AS node FROM brick JOIN blocky b ON b.unit_id = dst),
reach AS (SELECT unit_id, side, min(node) AS node FROM near GROUP BY 1, 2 UNION SELECT r.unit_id, r.side, n.node FROM reach r JOIN brick l ON l.src = r.node JOIN near n ON n.unit_id = r.unit_id AND n.side = r.side AND n.node = l.dst),
sides AS (SELECT unit_id, side, count(*) = (SELECT count(*) FROM near n WHERE n.unit_id = r.unit_id AND n.side = r.side) AS whole FROM reach r GROUP BY 1, 2), sizes AS (SELECT partition_id, count(*) AS n FROM blocky GROUP BY 1)"""
_LEGAL = """n > 1 AND coalesce(s.whole, false) AND coalesce(t.whole, false) AS legal FROM {} m JOIN sizes ON partition_id = src_partition
LEFT JOIN sides s ON s.unit_id = m.unit_id AND s.side = src_partition LEFT JOIN sides t ON t.unit_id = m.unit_id AND t.side = dst_partition"""


@query(duck(f"moved AS ({_MOVED}), {_SIDES} SELECT m.unit_id, src_partition, dst_partition, {_LEGAL.format('moved')}", "brick", "blocky", recursive=True))
def swap_legality(spark: SparkSession, d: str) -> DataFrame:
    own, adj = X.blocky(spark, d), X.brick_adjacency(spark, d)
    return swaps.legality(swaps.adjacent_partitions(own, adj), own, adj).select("unit_id", "src_partition", "dst_partition", "legal")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    own, units = X.blocky(spark, d), X.units(spark, d)
    found = swaps.candidates(own, X.adjacency(spark, d), X.interactions(spark, d))
    return swaps.scores(materialize(found, "candidates"), A.populations(own, units))


@query(duck("SELECT unit_id, src_partition, dst_partition, round(affinity, 6) AS affinity, pop_diff, round(score, 6) AS score FROM scored", "scored"))
def swap_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scored(spark, d), 6, "affinity", "score").select("unit_id", "src_partition", "dst_partition", "affinity", "pop_diff", "score")


_CDF = "sum(exp(score - (SELECT max(score) FROM scored))) OVER (ORDER BY unit_id, dst_partition) / (SELECT sum(exp(score - (SELECT max(score) FROM scored))) FROM scored)"


@query(duck(f"SELECT unit_id, dst_partition, round({_CDF}, 6) AS cdf FROM scored", "scored"))
def softmax_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(swaps.cumulative_softmax(materialize(_scored(spark, d), "scored")).select("unit_id", "dst_partition", "cdf"), 6, "cdf")


@query(duck(f"SELECT unit_id, dst_partition FROM (SELECT unit_id, dst_partition, {_CDF} AS cdf FROM scored) WHERE cdf >= 0.37 ORDER BY unit_id, dst_partition LIMIT 1", "scored"))
def inverse_cdf_pick(spark: SparkSession, d: str) -> DataFrame:
    return swaps.pick_inverse(materialize(_scored(spark, d), "scored"), 0.37).select("unit_id", "dst_partition")


_STEP = f"""moves AS ({_MOVED}), {X.DUCK["candidates"][1]}, {X.DUCK["scored"][1]}, {_SIDES}, judged AS (SELECT m.*, {_LEGAL.format("scored")})
SELECT unit_id, src_partition, dst_partition, round(affinity, 6) AS affinity, pop_diff, round(score, 6) AS score, legal FROM judged
WHERE legal ORDER BY score - ln(-ln(({_duck_drawn(SEED, "unit_id", "dst_partition")} + 0.5) / {float(E.DRAWN)})) DESC, unit_id, dst_partition LIMIT 1"""


@query(duck(_STEP, "brick", "blocky", "inter", "pops", recursive=True))
def gumbel_step(spark: SparkSession, d: str) -> DataFrame:
    own, units = X.blocky(spark, d), X.units(spark, d)
    found = swaps.step(own, materialize(X.brick_adjacency(spark, d), "adjacency"), X.interactions(spark, d), A.populations(own, units), SEED)
    return rounded(found, 6, "affinity", "score").select("unit_id", "src_partition", "dst_partition", "affinity", "pop_diff", "score", "legal")


# --- chains -------------------------------------------------------------------------------------------------------


@query("SELECT step, round(CASE WHEN step >= 50 THEN 0.05 ELSE exp(ln(2.0) + (ln(0.05) - ln(2.0)) * (step - 1) / 49) END, 9) AS temperature, round(CASE WHEN step >= 50 THEN 8.0 ELSE exp(ln(0.5) + (ln(8.0) - ln(0.5)) * (step - 1) / 49) END, 9) AS population_weight FROM (SELECT unnest(range(1, 51)) AS step)")
def interp_schedule(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chains.schedule(spark, 2.0, 0.05, 0.5, 8.0, 50), 9, "temperature", "population_weight")


def _graph(spark: SparkSession, d: str) -> chains.Graph:
    units = materialize(X.units(spark, d), "units")
    return chains.Graph.spread(units, materialize(X.brick_adjacency(spark, d), "adjacency"), materialize(graphs.interactions(units, X.SIGMA_KM, X.RADIUS_KM), "interactions"))


@query()
def random_connected_partition(spark: SparkSession, d: str) -> DataFrame:
    graph = chains.Graph.of_units(X.units(spark, d), materialize(X.brick_adjacency(spark, d), "adjacency"))
    return chains.random_connected(spark.range(CHAINS).select(F.col("id").alias("seed")).repartition(CHAINS), graph, 16)


@query()
def anneal_chain(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([(0, SEED, 1.0, 1.0)], "chain long, seed long, temperature double, population_weight double")
    return chains.anneal(one, _graph(spark, d), X.blocky(spark, d), STEPS)


@query()
def anneal_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Chains of several temperatures side by side."""
    rows = spark.range(CHAINS).select(F.col("id").alias("chain"), (F.col("id") + SEED).alias("seed"), F.pow(F.lit(0.5), F.col("id")).alias("temperature"), F.lit(1.0).alias("population_weight"))
    return chains.anneal(rows.repartition(CHAINS), _graph(spark, d), X.blocky(spark, d), STEPS, "assignment")


# --- geometry -----------------------------------------------------------------------------------------------------


@query(duck(f"SELECT unit_id, round(CAST({X.WEST} + {X.STEP_LON} * gx AS DOUBLE), 6) AS min_x, round(CAST({X.WEST} + {X.STEP_LON} * (gx + 1) AS DOUBLE), 6) AS max_x, round(CAST({X.SOUTH} + {X.STEP_LAT} * gy AS DOUBLE), 6) AS min_y, round(CAST({X.SOUTH} + {X.STEP_LAT} * (gy + 1) AS DOUBLE), 6) AS max_y FROM grid", "grid"))
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.bounds(X.boundaries(spark, d)), 6, "min_x", "max_x", "min_y", "max_y")


_LAMBERT = f""", box AS (SELECT radians(min({X.WEST} + {X.STEP_LON} * gx)) AS w, radians(max({X.WEST} + {X.STEP_LON} * (gx + 1))) AS e, radians(min({X.SOUTH} + {X.STEP_LAT} * gy)) AS s, radians(max({X.SOUTH} + {X.STEP_LAT} * (gy + 1))) AS n FROM grid),
cone AS (SELECT *, ln(cos(n) / cos(s)) / ln(tan(pi() / 4 + s / 2) / tan(pi() / 4 + n / 2)) AS k FROM box),
par AS (SELECT *, cos(n) * tan(pi() / 4 + n / 2) ** k / k AS f FROM cone),
corner AS (SELECT unit_id, i, j, radians({X.WEST} + {X.STEP_LON} * (gx + i)) AS lon, radians({X.SOUTH} + {X.STEP_LAT} * (gy + j)) AS lat FROM grid, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 1, 0]) AS j))
SELECT unit_id, CAST(CASE WHEN i = 0 AND j = 0 THEN 0 WHEN i = 0 THEN 1 WHEN j = 1 THEN 2 ELSE 3 END AS INTEGER) AS seq, round(f / tan(pi() / 4 + lat / 2) ** k * sin(k * (lon - (w + e) / 2)), 9) AS x,
  round(f / tan(pi() / 4 + (s + n) / 4) ** k - f / tan(pi() / 4 + lat / 2) ** k * cos(k * (lon - (w + e) / 2)), 9) AS y FROM corner, par"""


@query(duck(_LAMBERT, "grid"))
def lambert_project(spark: SparkSession, d: str) -> DataFrame:
    held = X.boundaries(spark, d)
    found = graphs.segments(geometry.project(held, geometry.fit_lambert(held)))
    return found.select("unit_id", "seq", F.round("x1", 9).alias("x"), F.round("y1", 9).alias("y"))


def _duck_trunc(e: str) -> str:
    return f"CAST(trunc(({e}) / {GRID_SIZE}) AS BIGINT)"


_X0, _X1 = f"{X.WEST} + {X.STEP_LON} * gx", f"{X.WEST} + {X.STEP_LON} * (gx + 1)"
_Y0, _Y1 = f"{X.SOUTH} + {X.STEP_LAT} * gy", f"{X.SOUTH} + {X.STEP_LAT} * (gy + 1)"
_SAMPLES = f""", windows AS (SELECT unit_id, {_X0} AS x0, {_X1} AS x1, {_Y0} AS y0, {_Y1} AS y1, 2 * CAST(trunc({_duck_trunc(_X0)} / 2.0) AS BIGINT) - 2 AS i0, 2 * CAST(trunc({_duck_trunc(_X1)} / 2.0) AS BIGINT) + 4 AS i1,
  2 * CAST(trunc({_duck_trunc(_Y0)} / 2.0) AS BIGINT) - 2 AS j0, 2 * CAST(trunc({_duck_trunc(_Y1)} / 2.0) AS BIGINT) + 4 AS j1 FROM grid),
taken AS (SELECT i, j, max(unit_id) AS unit_id FROM (SELECT *, unnest(range(j0, j1 + 1, 2)) AS j FROM (SELECT *, unnest(range(i0, i1 + 1, 2)) AS i FROM windows))
  WHERE i * {GRID_SIZE} > x0 AND i * {GRID_SIZE} < x1 AND j * {GRID_SIZE} > y0 AND j * {GRID_SIZE} < y1 GROUP BY 1, 2)"""
_CORNERS = f"""{_SAMPLES}, squares AS (SELECT DISTINCT i - di AS i, j - dj AS j FROM taken, (SELECT unnest([0, 0, 2, 2]) AS di, unnest([0, 2, 2, 0]) AS dj)),
cornered AS (SELECT s.i, s.j, coalesce(a.unit_id, -1) AS c1, coalesce(b.unit_id, -1) AS c2, coalesce(c.unit_id, -1) AS c3, coalesce(e.unit_id, -1) AS c4 FROM squares s
  LEFT JOIN taken a ON a.i = s.i AND a.j = s.j LEFT JOIN taken b ON b.i = s.i AND b.j = s.j + 2 LEFT JOIN taken c ON c.i = s.i + 2 AND c.j = s.j + 2 LEFT JOIN taken e ON e.i = s.i + 2 AND e.j = s.j)"""


@query(duck(f"{_SAMPLES} SELECT i, j, unit_id FROM taken", "grid"))
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return geometry.grid_points(X.boundaries(spark, d), GRID_SIZE)


@query(duck(f"{_CORNERS} SELECT i, j, c1, c2, c3, c4 FROM cornered", "grid"))
def grid_corners(spark: SparkSession, d: str) -> DataFrame:
    return geometry.corners(geometry.grid_points(X.boundaries(spark, d), GRID_SIZE))


_CELLS = []
for _k in range(4):
    _a, _b, _c, _d = (f"c{(_k + s) % 4 + 1}" for s in range(4))
    _i, _j = ((0, 0), (0, 1), (1, 1), (1, 0))[_k]
    _CELLS.append(f"SELECT {_a} AS unit_id, i + {_i} AS i, j + {_j} AS j, CASE WHEN {_a} <> {_b} AND {_b} = {_c} AND {_c} = {_d} THEN {_k + 1} ELSE 0 END AS shape FROM cornered WHERE {_a} >= 0")
    _CELLS.append(f"SELECT {_b}, i + {_i}, j + {_j}, {(_k + 2) % 4 + 1} FROM cornered WHERE {_b} >= 0 AND {_a} <> {_b} AND {_b} = {_c} AND {_c} = {_d}")


@query(duck(f"{_CORNERS} SELECT unit_id, i, j, CAST(shape AS INTEGER) AS shape FROM ({' UNION ALL '.join(_CELLS)})", "grid"))
def downsample_cells(spark: SparkSession, d: str) -> DataFrame:
    return geometry.cells(geometry.grid_points(X.boundaries(spark, d), GRID_SIZE))


def _steps(lines: DataFrame, key: str) -> DataFrame:
    """The segments that lines (key, line, points) run through, each as often as they do, and whether its line is closed."""
    closed = F.col("points")[0] == F.element_at("points", -1)
    held = lines.select(key, closed.alias("closed"), F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("s"))
    return graphs.undirected(held.select(key, "closed", *(F.col(f"s.{p}")[i].alias(f"{a}{k}") for k, p in ((1, "a"), (2, "b")) for i, a in enumerate("xy"))))


# corners of a cell, and which shapes have each of its sides and diagonals
_EDGES = {(0, 0, 0, 1): (0, 1, 2), (0, 1, 1, 1): (0, 2, 3), (1, 0, 1, 1): (0, 3, 4), (0, 0, 1, 0): (0, 1, 4), (0, 1, 1, 0): (1, 3), (0, 0, 1, 1): (2, 4)}
_CELL_EDGES = " UNION ALL ".join(f"SELECT unit_id, i + {a} AS i1, j + {b} AS j1, i + {c} AS i2, j + {e} AS j2 FROM covered WHERE shape IN {shapes}" for (a, b, c, e), shapes in _EDGES.items())


@query(duck(f"{_CORNERS}, covered AS ({' UNION ALL '.join(_CELLS)}) SELECT unit_id, true AS closed, i1, j1, i2, j2 FROM ({_CELL_EDGES}) GROUP BY ALL HAVING count(*) = 1", "grid"))
def downsample_rings(spark: SparkSession, d: str) -> DataFrame:
    """The rings' segments, by numbers of grid cells."""
    found = _steps(geometry.downsample(X.boundaries(spark, d), GRID_SIZE), "unit_id")
    return found.select("unit_id", "closed", *(F.round(F.col(f"{p}.{a}") / GRID_SIZE).cast("long").alias(f"{n}{k}") for k, p in ((1, "low"), (2, "high")) for n, a in (("i", "x"), ("j", "y"))))


@query(duck("SELECT partition_id, i1, j1, i2, j2 FROM sides JOIN blocky USING (unit_id) GROUP BY ALL HAVING count(*) = 1", "sides", "blocky"))
def partition_outline_edges(spark: SparkSession, d: str) -> DataFrame:
    found = geometry.outline_edges(X.boundaries(spark, d), X.blocky(spark, d))
    return found.select("partition_id", *_cornered(found))


@query(duck("SELECT i1, j1, i2, j2, count(*) AS n FROM sides GROUP BY ALL HAVING count(*) > 2", "sides"))
def overlapping_edges(spark: SparkSession, d: str) -> DataFrame:
    found = geometry.overlapping_edges(X.boundaries(spark, d))
    at = lambda n, s, b: F.round((F.col(n) - b) / s).cast("long")
    return found.select(at("x1", X.STEP_LON, X.WEST).alias("i1"), at("y1", X.STEP_LAT, X.SOUTH).alias("j1"), at("x2", X.STEP_LON, X.WEST).alias("i2"), at("y2", X.STEP_LAT, X.SOUTH).alias("j2"), "n")


@query(duck("SELECT DISTINCT i1, j1, i2, j2 FROM sides", "sides"))
def boundary_segments_distinct(spark: SparkSession, d: str) -> DataFrame:
    found = graphs.undirected(graphs.segments(X.boundaries(spark, d))).select("low", "high").distinct()
    return found.select(*_cornered(found))


@query(duck("SELECT partition_id, true AS closed, i1, j1, i2, j2 FROM sides JOIN blocky USING (unit_id) GROUP BY ALL HAVING count(*) = 1", "sides", "blocky"))
def partition_rings(spark: SparkSession, d: str) -> DataFrame:
    """The rings' segments, by corners of the grid."""
    found = _steps(geometry.outline_rings(X.boundaries(spark, d), X.blocky(spark, d)), "partition_id")
    return found.select("partition_id", "closed", *_cornered(found))


@query(duck("SELECT DISTINCT i1, j1, i2, j2 FROM sides", "sides"))
def boundary_polylines(spark: SparkSession, d: str) -> DataFrame:
    """The lines' segments, by corners of the grid."""
    found = _steps(geometry.polylines(X.boundaries(spark, d), tile=1.0), "tile")
    return found.select(*_cornered(found))


# --- colours, commands, profiles ----------------------------------------------------------------------------------


@query(duck("SELECT unit_id, round((ln(pop) - lo) / greatest(hi - lo, 1e-12), 6) AS at FROM units, (SELECT ln(min(pop)) AS lo, ln(max(pop)) AS hi FROM units)", "units"))
def range_color_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(colours.with_position(X.units(spark, d).select("unit_id", "pop"), "pop", log_scale=True), 6, "at").select("unit_id", "at")


@query("SELECT c_custkey AS unit_id, [" + ", ".join(f"'{c}'" for c in colours.CATEGORIES) + f"][c_custkey % {len(colours.CATEGORIES)} + 1] AS colour FROM customer")
def categorical_color(spark: SparkSession, d: str) -> DataFrame:
    return X.grid(spark, d).select("unit_id", colours.categorical(F.col("unit_id")).alias("colour"))


_LINES = ["temperature=0.5; interp steps=100; Save=Foo.csv", "Simulate Election", " pause ;; show counties = true", "load=a=b.csv"]


@query(
    f"""SELECT line, CAST(k AS INTEGER) AS k, lower(trim(split_part(c, '=', 1))) AS command, CASE WHEN strpos(c, '=') > 0 THEN trim(substr(c, strpos(c, '=') + 1)) ELSE '' END AS params
FROM (SELECT line, generate_subscripts(parts, 1) - 1 AS k, unnest(parts) AS c FROM (SELECT line, string_split(line, ';') AS parts FROM (SELECT unnest({_LINES!r}) AS line)))"""
)
def command_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in _LINES], "line string")
    return lines.select("line", F.posexplode(E.commands(F.col("line"))).alias("k", "c")).select("line", "k", "c.command", "c.params")


@query(duck("SELECT partition_id, CAST(count(DISTINCT floor(unit_id / 1000.0)) AS BIGINT) AS n_states, count(*) AS n_units, CAST(sum(pop) AS BIGINT) AS pop FROM blocky JOIN units USING (unit_id) GROUP BY 1", "blocky", "units"))
def state_partition_profile(spark: SparkSession, d: str) -> DataFrame:
    joined = X.blocky(spark, d).join(X.units(spark, d), "unit_id")
    return joined.groupBy("partition_id").agg(F.countDistinct(E.state_of(F.col("unit_id"))).alias("n_states"), F.count("*").alias("n_units"), F.sum("pop").alias("pop"))
