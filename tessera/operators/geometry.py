"""Geometry of boundaries: bounds, projection, grids, dissolved outlines and polylines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Lambert
from .graphs import segments, undirected


def bounds(boundaries: DataFrame) -> DataFrame:
    """(unit_id, min_x, max_x, min_y, max_y) of the exterior rings."""
    outer = boundaries.select("unit_id", F.explode(F.flatten(F.transform("geometry", lambda p: F.element_at(p, 1)))).alias("p"))
    return outer.groupBy("unit_id").agg(*(f(F.col("p")[i]).alias(f"{n}_{a}") for i, a in enumerate("xy") for n, f in (("min", F.min), ("max", F.max))))


def total_bounds(boundaries: DataFrame) -> DataFrame:
    """One row: the box of all units."""
    return bounds(boundaries).agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))


def fit_lambert(boundaries: DataFrame) -> Lambert:
    r = total_bounds(boundaries).first()
    return Lambert.of_bounds(r.min_x, r.max_x, r.min_y, r.max_y)


def project(boundaries: DataFrame, projection: Lambert) -> DataFrame:
    """Every point projected; a map over each row's nested arrays."""
    point = lambda p: F.array(*projection.project(p[0], p[1]))
    return boundaries.withColumn("geometry", F.transform("geometry", lambda poly: F.transform(poly, lambda ring: F.transform(ring, point))))


def crossings(points: DataFrame, boundaries: DataFrame, band: float = 0.05) -> DataFrame:
    """points: (unit_id, x, y), each to be held against the boundary of its own unit. Adds `inside`: it lies within, by
    the parity of the edges that a ray to the right crosses; a point on an edge lies outside. A point meets the edges of
    its band of y alone, all that a ray can cross, so a unit's work is spread over its bands."""
    low, high = F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)
    edge = segments(boundaries).select("unit_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(low, high)).alias("band"))
    x, y = F.col("x"), F.col("y")
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    side = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (x - F.col("x1")) * (F.col("y2") - F.col("y1"))
    right = F.when(F.col("y2") > F.col("y1"), side > 0).otherwise(side < 0)
    on = (side == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    met = points.withColumn("band", F.floor(y / band)).join(edge, ["unit_id", "band"]).groupBy("unit_id", "x", "y").agg(F.count_if(spans & right).alias("n"), F.count_if(on).alias("n_on"))
    return points.join(met, ["unit_id", "x", "y"], "left").withColumn("inside", (F.coalesce("n", F.lit(0)) % 2 == 1) & (F.coalesce("n_on", F.lit(0)) == 0)).drop("n", "n_on")


def _row_spans(boundaries: DataFrame, size: float) -> DataFrame:
    """(unit_id, j, xs, held): for each even row of the grid, where a unit's edges cross it, in order, and the stretches
    of the row that its edges touch. Each edge is sent to the rows that it reaches, so no point meets an edge."""
    edge = undirected(segments(boundaries)).select("unit_id", "low", "high")
    # an edge is taken from its lower end, so that both its owners find the same crossing
    first, last = (F.when(F.col("low.y") <= F.col("high.y"), F.col(a)).otherwise(F.col(b)) for a, b in (("low", "high"), ("high", "low")))
    edge = edge.select("unit_id", first.alias("p"), last.alias("q"))
    rows = F.sequence(2 * F.floor(F.col("p.y") / (2 * size)), 2 * F.floor(F.col("q.y") / (2 * size)) + 2, F.lit(2).cast("long"))
    met = edge.select("*", F.explode(rows).alias("j")).withColumn("y", F.col("j") * size).filter("y >= p.y and y <= q.y")
    level = F.col("p.y") == F.col("q.y")
    x = F.col("p.x") + (F.col("y") - F.col("p.y")) * (F.col("q.x") - F.col("p.x")) / (F.col("q.y") - F.col("p.y"))
    x = F.when(F.col("y") == F.col("q.y"), F.col("q.x")).otherwise(x)
    met = met.select("unit_id", "j", F.when(~level & (F.col("y") < F.col("q.y")), x).alias("x"), F.struct(F.when(level, F.col("p.x")).otherwise(x).alias("a"), F.when(level, F.col("q.x")).otherwise(x).alias("b")).alias("s"))
    return met.groupBy("unit_id", "j").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.collect_list("s").alias("held"))


def grid_points(boundaries: DataFrame, size: float) -> DataFrame:
    """(i, j, unit_id): each even grid point that lies within some unit, with that unit; of several the highest id. Rings
    are closed, so a row's crossings come in pairs, and between the two of a pair it lies within; points on an edge are left out."""
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")), lambda k: F.struct(F.element_at("xs", 2 * k - 1).alias("a"), F.element_at("xs", 2 * k).alias("b")))
    found = _row_spans(boundaries, size).filter("size(xs) > 1").select("unit_id", "j", "held", F.explode(pairs).alias("s"))
    steps = F.sequence(2 * F.floor(F.col("s.a") / (2 * size)), 2 * F.floor(F.col("s.b") / (2 * size)) + 2, F.lit(2).cast("long"))
    found = found.select("unit_id", "j", "held", "s", F.explode(steps).alias("i")).withColumn("x", F.col("i") * size).filter("x > s.a and x < s.b")
    found = found.filter(~F.exists("held", lambda h: F.col("x").between(F.least(h["a"], h["b"]), F.greatest(h["a"], h["b"]))))
    return found.groupBy("i", "j").agg(F.max("unit_id").alias("unit_id"))


def corners(points: DataFrame) -> DataFrame:
    """(i, j, c1, c2, c3, c4) of each square of four even grid points of which one at least is taken: the units at (i, j),
    (i, j+2), (i+2, j+2) and (i+2, j), -1 for none. Each point is sent to the four squares that it is a corner of; no join
    is needed."""
    sent = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j")) for c, (di, dj) in enumerate(((0, 0), (0, 2), (2, 2), (2, 0)), 1))))
    squares = points.select("unit_id", sent.alias("s")).groupBy(F.col("s.i").alias("i"), F.col("s.j").alias("j"))
    return squares.agg(*(F.coalesce(F.max(F.when(F.col("s.c") == c, F.col("unit_id"))), F.lit(-1)).cast("long").alias(f"c{c}") for c in (1, 2, 3, 4)))


def cells(points: DataFrame) -> DataFrame:
    """(unit_id, i, j, shape): the cells of the full grid that each unit covers. Of the four cells of a square, the one at a
    corner of the unit's is whole (0), but a half if the other three corners are one other unit's or nobody's; and a cell
    at a corner that isn't the unit's is a half if all others are. shape k in 1 to 4 is the half that holds corner k, by
    the order of `corners`."""
    square = corners(points)
    places = ((0, 0), (0, 1), (1, 1), (1, 0))
    parts = []
    for k in range(4):
        a, b, c, d = (F.col(f"c{(k + s) % 4 + 1}") for s in range(4))
        i, j = F.col("i") + places[k][0], F.col("j") + places[k][1]
        alone = (b != a) & (b == c) & (c == d)
        opposite = (k + 2) % 4 + 1
        parts.append(F.struct(a.alias("unit_id"), i.alias("i"), j.alias("j"), F.when(alone, k + 1).otherwise(0).alias("shape"), (a >= 0).alias("holds")))
        parts.append(F.struct(b.alias("unit_id"), i.alias("i"), j.alias("j"), F.lit(opposite).alias("shape"), ((b >= 0) & alone).alias("holds")))
    found = square.select(F.explode(F.array(*parts)).alias("s")).select("s.*").filter("holds")
    return found.select("unit_id", "i", "j", F.col("shape").cast("int").alias("shape"))


def cell_polygons(found: DataFrame, size: float) -> DataFrame:
    """(unit_id, geometry): `cells` as a boundary of many small polygons, not dissolved."""
    x1, y1, x2, y2 = F.col("i") * size, F.col("j") * size, (F.col("i") + 1) * size, (F.col("j") + 1) * size
    ring = lambda *ps: F.array(*(F.array(*p) for p in (*ps, ps[0])))
    p1, p2, p3, p4 = (x1, y1), (x1, y2), (x2, y2), (x2, y1)
    shape = F.when(F.col("shape") == 0, ring(p1, p2, p3, p4))
    for k, triangle in enumerate(((p1, p2, p4), (p2, p3, p1), (p3, p4, p2), (p4, p1, p3)), 1):
        shape = shape.when(F.col("shape") == k, ring(*triangle))
    return found.groupBy("unit_id").agg(F.collect_list(F.array(shape)).alias("geometry"))


def outline_edges(boundaries: DataFrame, owners: DataFrame, owner: str = "partition_id") -> DataFrame:
    """(owner, low, high): the edges that occur once among a group's units, which are its outline. owners: (unit_id,
    owner). Exact where neighbours share their edges point by point."""
    found = undirected(segments(boundaries).join(owners.select("unit_id", owner), "unit_id")).groupBy(owner, "low", "high").agg(F.count("*").alias("n"))
    return found.filter("n = 1").select(owner, "low", "high")


def overlapping_edges(boundaries: DataFrame) -> DataFrame:
    """Edges with more than two owners: where there are any, outlines by cancelling edges are wrong."""
    found = undirected(segments(boundaries)).groupBy("low", "high").agg(F.count("*").alias("n"))
    return found.filter("n > 2").select(F.col("low.x").alias("x1"), F.col("low.y").alias("y1"), F.col("high.x").alias("x2"), F.col("high.y").alias("y2"), "n")


def _walk(edges: list[tuple[tuple, tuple]], rings: bool) -> list[list[tuple]]:
    """Trails that use each edge once. rings: at a point with several ways on, the sharpest turn to the left, so that
    rings which touch at a point are kept apart; otherwise the least point."""
    near: dict[tuple, set[tuple]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def take(a: tuple, b: tuple) -> None:
        for p, q in ((a, b), (b, a)):
            near[p].discard(q)
            if not near[p]:
                del near[p]

    def follow(start: tuple) -> list[tuple]:
        trail, before = [start], None
        while (here := trail[-1]) in near and (not rings or here != start or before is None):
            ways = sorted(near[here])
            if rings and before is not None and len(ways) > 1:
                back = math.atan2(before[1] - here[1], before[0] - here[0])
                ways.sort(key=lambda w: (math.atan2(w[1] - here[1], w[0] - here[0]) - back) % (2 * math.pi))
            take(here, ways[0])
            before = here
            trail.append(ways[0])
        return trail

    out = []
    for start in sorted(near):
        while start in near:
            first = follow(start)
            out.append(first if rings else follow(start)[:0:-1] + first)
    return out


_TRAIL = "line int, points array<array<double>>"


def _trails(edges: DataFrame, key: str, rings: bool) -> DataFrame:
    """(key, line, points). The edges of one key meet in one task; they are the outline of one shape or tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _walk([((r.x1, r.y1), (r.x2, r.y2)) for r in pdf.itertuples()], rings)
        return pd.DataFrame({key: pdf[key].iloc[0], "line": range(len(found)), "points": [[list(p) for p in t] for t in found]})

    flat = edges.select(key, F.col("low.x").alias("x1"), F.col("low.y").alias("y1"), F.col("high.x").alias("x2"), F.col("high.y").alias("y2"))
    return flat.groupBy(key).applyInPandas(run, f"{key} long, {_TRAIL}")


def outline_rings(boundaries: DataFrame, owners: DataFrame, owner: str = "partition_id") -> DataFrame:
    """(owner, line, points): the rings of each group's outline."""
    return _trails(outline_edges(boundaries, owners, owner), owner, rings=True)


def polylines(boundaries: DataFrame, tile: float | None = None) -> DataFrame:
    """(tile, line, points): all boundaries as few long lines, each segment once. With a tile size, lines end at tiles'
    edges, so that the work is spread; without one, everything is one tile."""
    edges = undirected(segments(boundaries)).select("low", "high").filter("low <> high").distinct()
    at = F.lit(0) if tile is None else F.floor(F.col("low.x") / tile) * 1_000_003 + F.floor(F.col("low.y") / tile)
    return _trails(edges.withColumn("tile", at.cast("long")), "tile", rings=False)


def downsample(boundaries: DataFrame, size: float) -> DataFrame:
    """Boundaries on a grid: (unit_id, line, points), the rings of what each unit covers. A unit that holds no grid point
    has none."""
    small = cell_polygons(cells(grid_points(boundaries, size)), size)
    return outline_rings(small, small.select("unit_id", F.col("unit_id").alias("owner")), "owner").withColumnRenamed("owner", "unit_id")


def load_projected(boundaries: DataFrame, units: DataFrame, resolution: int = 1024) -> DataFrame:
    """The boundaries of `units`, projected and, if the resolution is above 0, on a grid of so many cells along the
    shorter side: rings (unit_id, line, points)."""
    chosen = boundaries.join(units.select("unit_id"), "unit_id", "left_semi")
    projection = fit_lambert(chosen)
    if math.isnan(projection.rho_ref):
        raise ValueError("the units' bounds have no projection; do they reach beyond a pole?")
    flat = project(chosen, projection)
    if resolution <= 0:
        return flat.select("unit_id", F.posexplode(F.flatten("geometry")).alias("line", "points"))
    r = total_bounds(flat).first()
    return downsample(flat, min(r.max_x - r.min_x, r.max_y - r.min_y) / resolution)


def shapes(rings: DataFrame) -> DataFrame:
    """(unit_id, geometry): boundaries again of rings (unit_id, line, points), each a polygon of its own; holes are told by
    parity. Units that shared their edges point by point still do."""
    return rings.groupBy("unit_id").agg(F.collect_list(F.array("points")).alias("geometry"))
