"""The engine's inputs, derived from the test tables: customers are units on a grid 40 wide, orders their census blocks and
their returns, and nations states. DUCK has the same in DuckDB's SQL, as named queries to put before another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import election, graphs, moments

COLUMNS = 40
WEST, SOUTH, STEP_LON, STEP_LAT = -124.0, 25.0, 0.25, 0.05
SIGMA_KM, RADIUS_KM = 50.0, 20.0
YEAR, EXCLUDED = 1998, ("BUILDING", "FURNITURE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, gx, gy, nation)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), "c_nationkey")
    return c.select("unit_id", (F.col("unit_id") % COLUMNS).alias("gx"), F.floor(F.col("unit_id") / COLUMNS).alias("gy"), F.col("c_nationkey").cast("long").alias("nation"))


def block_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, unit_id, pop, lon, lat): a block's line items are its points."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lon = WEST + STEP_LON * (F.col("o_custkey") % COLUMNS) + 0.01 * F.col("l_linenumber")
    lat = SOUTH + STEP_LAT * F.floor(F.col("o_custkey") / COLUMNS) + 0.001 * F.floor("l_quantity")
    return items.select(F.col("o_orderkey").alias("block"), F.col("o_custkey").alias("unit_id"), (1 + F.floor("o_totalprice") % 1000).alias("pop"), lon.alias("lon"), lat.alias("lat"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.unit_moments(moments.block_positions(block_points(spark, sf_dir), "block", "unit_id", "pop"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's cell of the grid, as a closed ring."""
    x = lambda d: WEST + STEP_LON * (F.col("gx") + d)
    y = lambda d: SOUTH + STEP_LAT * (F.col("gy") + d)
    ring = F.array(*(F.array(x(i), y(j)) for i, j in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))))
    return grid(spark, sf_dir).select("unit_id", F.array(F.array(ring)).alias("geometry"))


def bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells with every other row moved by half a cell, so that each borders on six: rings of seven points, whose
    coordinates come from numbers of half cells."""
    half = 2 * F.col("gx") + F.col("gy") % 2
    point = lambda i, j: F.array(WEST + STEP_LON / 2 * (half + i), SOUTH + STEP_LAT * (F.col("gy") + j))
    ring = F.array(*(point(i, j) for i, j in ((0, 0), (0, 1), (1, 1), (2, 1), (2, 0), (1, 0), (0, 0))))
    return grid(spark, sf_dir).select("unit_id", F.array(F.array(ring)).alias("geometry"))


def brick_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.adjacency(bricks(spark, sf_dir))


def blocky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected partitions of 10 by 10 cells."""
    return grid(spark, sf_dir).select("unit_id", (1 + F.floor(F.col("gx") / 10) + 4 * F.floor(F.col("gy") / 10)).alias("partition_id"))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition for each nation, scattered over the grid."""
    return grid(spark, sf_dir).select("unit_id", (1 + F.col("nation")).alias("partition_id"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.adjacency(boundaries(spark, sf_dir))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.interactions(units(spark, sf_dir), SIGMA_KM, RADIUS_KM)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    party = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "DEMOCRAT").when(F.substring("o_orderpriority", 1, 1).isin("3", "4"), "REPUBLICAN").otherwise("LIBERTARIAN")
    fips = F.when(F.col("o_orderkey") % 97 == 0, "NA").otherwise(F.col("o_custkey").cast("string"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("state_po"), fips.alias("fips"), party.alias("party"), (1 + F.floor("o_totalprice") % 1000).alias("votes"), F.col("o_custkey").alias("unit_id"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of every unit, of all years."""
    rows = returns(spark, sf_dir).withColumn("fips", F.col("unit_id").cast("string")).withColumn("year", F.lit(0)).withColumn("state_po", F.lit(""))
    found = election.parse_returns(rows.drop("unit_id"), 0, ("AK",))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return grid(spark, sf_dir).select("unit_id").join(found, "unit_id", "left").select("unit_id", zero("dem"), zero("gop"), zero("other"))


_R = 6370.286
_GRID = f"grid AS (SELECT c_custkey AS unit_id, c_custkey % {COLUMNS} AS gx, CAST(floor(c_custkey / {COLUMNS}.0) AS BIGINT) AS gy, CAST(c_nationkey AS BIGINT) AS nation FROM customer)"
_POINTS = f"""points AS (
  SELECT o_orderkey AS block, o_custkey AS unit_id, 1 + CAST(floor(o_totalprice) AS BIGINT) % 1000 AS pop,
         radians({WEST} + {STEP_LON} * (o_custkey % {COLUMNS}) + 0.01 * l_linenumber) AS lon,
         radians({SOUTH} + {STEP_LAT} * floor(o_custkey / {COLUMNS}.0) + 0.001 * floor(l_quantity)) AS lat
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_BLOCKS = f"""blocks AS (
  SELECT block, unit_id, pop, {_R} * avg(cos(lon) * sin(lat)) AS x, {_R} * avg(sin(lon) * sin(lat)) AS y, {_R} * avg(cos(lat)) AS z
  FROM points GROUP BY ALL)"""
_UNITS = """units AS (
  SELECT unit_id, CAST(w AS BIGINT) AS pop, sx / w AS x, sy / w AS y, sz / w AS z,
         greatest(sq / w - (sx / w) ** 2 - (sy / w) ** 2 - (sz / w) ** 2, 0) AS var
  FROM (SELECT unit_id, sum(pop) AS w, sum(pop * x) AS sx, sum(pop * y) AS sy, sum(pop * z) AS sz, sum(pop * (x * x + y * y + z * z)) AS sq FROM blocks GROUP BY 1))"""
_BLOCKY = "blocky AS (SELECT unit_id, 1 + CAST(floor(gx / 10.0) AS BIGINT) + 4 * CAST(floor(gy / 10.0) AS BIGINT) AS partition_id FROM grid)"
_SCATTERED = "scattered AS (SELECT unit_id, 1 + nation AS partition_id FROM grid)"
_KERNEL = f"exp(-0.5 * {{d}} / ({{v}} + {2 * SIGMA_KM**2})) / (2 * pi() * sqrt({{v}} + {2 * SIGMA_KM**2}))"
_INTER = f"""pairs AS (
  SELECT a.unit_id AS src, b.unit_id AS dst, a.pop * b.pop * {_KERNEL.format(d="((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)", v="(a.var + b.var)")} AS weight
  FROM units a JOIN units b ON b.z BETWEEN a.z - {RADIUS_KM} AND a.z + {RADIUS_KM} AND a.unit_id <> b.unit_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= {RADIUS_KM**2}),
inter AS (SELECT * FROM pairs UNION ALL SELECT unit_id, unit_id, 2 * pop * pop * {_KERNEL.format(d="0", v="(2 * var)")} FROM units)"""
#: The grid's sides by integer corners: (unit_id, i1, j1, i2, j2), the lesser corner first.
_SIDES = """sides AS (
  SELECT unit_id, gx AS i1, gy AS j1, gx AS i2, gy + 1 AS j2, 0 AS seq FROM grid UNION ALL SELECT unit_id, gx, gy + 1, gx + 1, gy + 1, 1 FROM grid
  UNION ALL SELECT unit_id, gx + 1, gy, gx + 1, gy + 1, 2 FROM grid UNION ALL SELECT unit_id, gx, gy, gx + 1, gy, 3 FROM grid)"""
_ADJ = f"""shared AS (SELECT min(unit_id) AS a, max(unit_id) AS b, i1, j1, i2, j2 FROM sides GROUP BY i1, j1, i2, j2 HAVING count(*) = 2),
lengths AS (
  SELECT a, b, sum(2 * {_R} * asin(sqrt(sin(radians({STEP_LAT} * (j2 - j1)) / 2) ** 2
    + cos(radians({SOUTH} + {STEP_LAT} * j1)) * cos(radians({SOUTH} + {STEP_LAT} * j2)) * sin(radians({STEP_LON} * (i2 - i1)) / 2) ** 2))) AS weight
  FROM shared GROUP BY a, b),
adj AS (SELECT a AS src, b AS dst, weight FROM lengths UNION ALL SELECT b, a, weight FROM lengths)"""
#: Six neighbours; the rows above and below are half a cell to the right of an odd row, and to the left of an even one.
_BRICKS = """brick AS (
  SELECT a.unit_id AS src, b.unit_id AS dst FROM (
    SELECT *, gx + dx + CASE WHEN dy <> 0 THEN gy % 2 ELSE 0 END AS x, gy + dy AS y
    FROM grid, (SELECT unnest([-1, 1, -1, 0, -1, 0]) AS dx, unnest([0, 0, -1, -1, 1, 1]) AS dy)) a
  JOIN grid b ON b.gx = a.x AND b.gy = a.y)"""
_RETURNS = """returns AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS state_po, CASE WHEN o_orderkey % 97 = 0 THEN 'NA' ELSE CAST(o_custkey AS VARCHAR) END AS fips,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'DEMOCRAT' WHEN o_orderpriority[1] IN ('3', '4') THEN 'REPUBLICAN' ELSE 'LIBERTARIAN' END AS party,
         1 + CAST(floor(o_totalprice) AS BIGINT) % 1000 AS votes, o_custkey AS unit_id
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_VOTES = """votes AS (
  SELECT g.unit_id, CAST(coalesce(sum(votes) FILTER (WHERE party = 'DEMOCRAT'), 0) AS BIGINT) AS dem, CAST(coalesce(sum(votes) FILTER (WHERE party = 'REPUBLICAN'), 0) AS BIGINT) AS gop
  FROM grid g LEFT JOIN returns r USING (unit_id) GROUP BY g.unit_id)"""
_POPS = "pops AS (SELECT partition_id, CAST(sum(pop) AS BIGINT) AS pop FROM blocky JOIN units USING (unit_id) GROUP BY 1)"
_SEATS = f"""priorities AS (SELECT partition_id, pop / sqrt(k * (k + 1.0)) AS p FROM pops, (SELECT unnest(range(1, {election.SEATS + 1})) AS k)),
won AS (SELECT partition_id FROM (SELECT partition_id, row_number() OVER (ORDER BY p DESC, partition_id DESC) AS r FROM priorities) WHERE r <= {election.SEATS} - (SELECT count(*) FROM pops)),
seats AS (SELECT p.partition_id, 1 + count(w.partition_id) AS seats FROM pops p LEFT JOIN won w USING (partition_id) GROUP BY 1)"""
_SIMULATED = """simulated AS (
  SELECT partition_id, pop, CAST(dem AS BIGINT) AS dem, CAST(gop AS BIGINT) AS gop, gop / CAST(dem + gop AS DOUBLE) AS gop_fraction, seats, seats + 2 AS electors, CASE WHEN dem > gop THEN 'DEM' ELSE 'GOP' END AS winner
  FROM pops JOIN seats USING (partition_id) JOIN (SELECT partition_id, sum(dem) AS dem, sum(gop) AS gop FROM blocky JOIN votes USING (unit_id) GROUP BY 1) USING (partition_id))"""
_MOVES = """moves AS (
  SELECT DISTINCT src AS unit_id, a.partition_id AS src_partition, b.partition_id AS dst_partition
  FROM adj JOIN blocky a ON a.unit_id = src JOIN blocky b ON b.unit_id = dst WHERE a.partition_id <> b.partition_id)"""
_CANDIDATES = """pull AS (SELECT src AS unit_id, partition_id, sum(weight) AS w FROM pairs JOIN blocky b ON b.unit_id = dst GROUP BY 1, 2),
candidates AS (
  SELECT m.*, ln(greatest(coalesce(t.w, 0), 1e-12)) - ln(greatest(coalesce(o.w, 0), 1e-12)) AS affinity
  FROM moves m LEFT JOIN pull t ON t.unit_id = m.unit_id AND t.partition_id = dst_partition LEFT JOIN pull o ON o.unit_id = m.unit_id AND o.partition_id = src_partition)"""
_SCORED = """diffs AS (SELECT c.*, CAST(s.pop - d.pop AS DOUBLE) AS pop_diff FROM candidates c JOIN pops s ON s.partition_id = src_partition JOIN pops d ON d.partition_id = dst_partition),
stats AS (
  SELECT avg(affinity) AS ma, sqrt(greatest(avg(affinity * affinity) - avg(affinity) ** 2, 1e-12)) AS sa, avg(pop_diff) AS mp, sqrt(greatest(avg(pop_diff * pop_diff) - avg(pop_diff) ** 2, 1e-12)) AS sp FROM diffs),
scored AS (SELECT d.*, (affinity - ma) / sa + (pop_diff - mp) / sp AS score FROM diffs d, stats)"""

DUCK = {
    "grid": ([], _GRID), "points": ([], _POINTS), "blocks": (["points"], _BLOCKS), "units": (["blocks"], _UNITS), "blocky": (["grid"], _BLOCKY), "scattered": (["grid"], _SCATTERED),
    "inter": (["units"], _INTER), "sides": (["grid"], _SIDES), "adj": (["sides"], _ADJ), "brick": (["grid"], _BRICKS), "returns": ([], _RETURNS), "votes": (["grid", "returns"], _VOTES), "pops": (["blocky", "units"], _POPS),
    "seats": (["pops"], _SEATS), "simulated": (["seats", "votes"], _SIMULATED), "moves": (["adj", "blocky"], _MOVES), "candidates": (["moves", "inter"], _CANDIDATES), "scored": (["candidates", "pops"], _SCORED),
}


def duck(sql: str, *names: str, recursive: bool = False) -> str:
    """`sql` after the named queries and all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in DUCK[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(DUCK[n][1] for n in order) + ("," if recursive else "") + "\n" + sql
