"""Operators against brute force, closed forms and properties."""

import heapq
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as E
from tessera.functions import geo
from tessera.operators import assignment as A
from tessera.operators import chains, colours, election, geometry, graphs, moments, swaps
from tessera.operators import components as C
from tessera.plans import fixtures as X


def rows(df):
    return [tuple(r) for r in df.collect()]


def assigned(spark, pairs):
    return spark.createDataFrame(list(pairs), "unit_id long, partition_id long")


def ungraph(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, weight double")


# --- elections ----------------------------------------------------------------------------------------------------


def heap_seats(pops, seats=432):
    won = {p: 1 for p in pops}
    heap = [(-n / math.sqrt(2), -p) for p, n in pops.items()]
    heapq.heapify(heap)
    for _ in range(max(seats - len(pops), 0)):
        _, p = heapq.heappop(heap)
        won[-p] += 1
        s = won[-p]
        heapq.heappush(heap, (-pops[-p] / math.sqrt(s * (s + 1)), p))
    return won


@pytest.mark.parametrize("pops", [{1: 100}, {1: 5, 2: 5, 3: 5}, {i: 1000 + 37 * i * i for i in range(1, 49)}, {i: 10 for i in range(450)}])
def test_apportionment_equals_a_heap(spark, pops):
    found = election.apportion(spark.createDataFrame(list(pops.items()), "partition_id long, pop long"))
    assert dict(rows(found)) == heap_seats(pops)


def test_votes_missing_and_ties(spark):
    own, votes = assigned(spark, [(1, 1), (2, 1), (3, 2), (4, 3)]), spark.createDataFrame([(1, 5, 5, 0), (2, 0, 0, 9), (3, 2, 1, 0)], "unit_id long, dem long, gop long, other long")
    with pytest.raises(Exception, match="no votes for unit 4"):
        election.partition_votes(own, votes).collect()
    assert sorted(rows(election.partition_votes(own, votes, strict=False))) == [(1, 5, 5), (2, 2, 1), (3, 0, 0)]
    units = spark.createDataFrame([(i, 10) for i in range(1, 5)], "unit_id long, pop long")
    found = {r.partition_id: r for r in election.simulate(own, units, votes, strict=False).collect()}
    assert found[1].winner == "GOP" and found[2].winner == "DEM" and math.isnan(found[3].gop_fraction)
    assert sum(r.seats for r in found.values()) == 432


def test_parse_returns_leaves_out(spark):
    data = [(2020, "WA", "53033", "DEMOCRAT", 5), (2020, "WA", "53033", "GREEN", 2), (2020, "AK", "2001", "DEMOCRAT", 7), (2016, "WA", "53033", "DEMOCRAT", 9), (2020, "WA", "NA", "REPUBLICAN", 1), (2020, "WA", None, "REPUBLICAN", 1), (2020, "WA", "53033", None, 4)]
    found = election.parse_returns(spark.createDataFrame(data, "year int, state_po string, fips string, party string, votes long"))
    assert rows(found) == [(53033, 5, 0, 6)]


# --- moments and graphs -------------------------------------------------------------------------------------------


def test_moments_of_two_blocks(spark):
    blocks = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 0.0, 0.0), (2, 0.0, 1.0, 1.0, 1.0), (3, 5.0, None, None, None)], "unit_id long, pop double, x double, y double, z double")
    assert rows(moments.unit_moments(blocks)) == [(1, 4, 3.0, 0.0, 0.0, 3.0)]
    assert sorted(rows(moments.unplaced_units(blocks))) == [(2, 1), (3, 1)]


def test_points_of_holes_and_closings_count(spark):
    square = [[0.0, 0.0], [0.0, 2.0], [2.0, 2.0], [0.0, 0.0]]
    df = spark.createDataFrame([(1, [[square, square], [square]])], "unit_id long, geometry array<array<array<array<double>>>>")
    assert moments.vertices(df, "unit_id").count() == 12


def test_closed_forms(spark):
    one = spark.range(1)
    d, k, x = one.select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), geo.interaction(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(3.0), 5.0), geo.Lambert.of_bounds(-100, -80, 30, 40).project(F.lit(-90.0), F.lit(35.0))[0]).first()
    assert d == pytest.approx(6370.286 * math.pi / 2) and k == pytest.approx(6 / (2 * math.pi * math.sqrt(50))) and x == pytest.approx(0)
    assert one.select(geo.Lambert.of_bounds(-100, -80, 30, 40).project(F.lit(-90.0), F.lit(35.0))[1]).first()[0] == pytest.approx(0, abs=1e-12)
    v = one.select(*geo.sphere_vector(F.lit(0.0), F.lit(90.0)), *geo.sphere_vector(F.lit(0.0), F.lit(90.0), "geodetic")).first()
    assert v[0] == pytest.approx(1) and v[5] == pytest.approx(1)


def test_bounds_beyond_a_pole_project_to_nan(spark):
    """As the SQL of lambert_project has it; images of such units are refused."""
    beyond = geo.Lambert.of_bounds(-124, -114, 25, 137.5)
    x, y = spark.range(1).select(*beyond.project(F.lit(-120.0), F.lit(40.0))).first()
    assert math.isnan(x) and math.isnan(y)
    ring = [[-124.0, 25.0], [-124.0, 137.5], [-114.0, 137.5], [-124.0, 25.0]]
    boundaries = spark.createDataFrame([(1, [[ring]])], "unit_id long, geometry array<array<array<array<double>>>>")
    with pytest.raises(ValueError, match="projection"):
        geometry.load_projected(boundaries, boundaries.select("unit_id"), 0)


def test_interactions_equal_all_pairs(spark, sf_dir):
    units = X.units(spark, sf_dir).cache()
    held = [r.asDict() for r in units.collect()]
    expected = {}
    for a in held:
        for b in held:
            d2 = sum((a[c] - b[c]) ** 2 for c in "xyz")
            if a["unit_id"] != b["unit_id"] and d2 <= 60.0**2:
                v = a["var"] + b["var"] + 5000
                expected[a["unit_id"], b["unit_id"]] = a["pop"] * b["pop"] * math.exp(-0.5 * d2 / v) / (2 * math.pi * math.sqrt(v))
        v = 2 * a["var"] + 5000
        expected[a["unit_id"], a["unit_id"]] = 2 * a["pop"] ** 2 / (2 * math.pi * math.sqrt(v))
    found = {(r.src, r.dst): r.weight for r in graphs.interactions(units, 50.0, 60.0).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(w) for k, w in expected.items())


def test_a_segment_with_three_owners(spark):
    ring = lambda y: [[[[0.0, 0.0], [1.0, 0.0], [0.5, y], [0.0, 0.0]]]]
    df = spark.createDataFrame([(1, ring(1.0)), (2, ring(-1.0)), (3, ring(-2.0)), (4, [[[[0.0, 0.0]]]])], "unit_id long, geometry array<array<array<array<double>>>>")
    assert [(r.a, r.b) for r in graphs.border_pairs(graphs.segments(df)).collect()] == [(1, 2)]  # the third waits for a fourth
    assert geometry.overlapping_edges(df).count() == 1


def test_graphs_are_symmetric(spark, sf_dir):
    for g in (X.adjacency(spark, sf_dir), X.brick_adjacency(spark, sf_dir)):
        held = {(r.src, r.dst): r.weight for r in g.collect()}
        assert held and all(held[b, a] == w and a != b for (a, b), w in held.items())


# --- assignments and components -----------------------------------------------------------------------------------


def test_upsert_load_and_reassign(spark):
    own = assigned(spark, [(1, 1), (2, 1), (3, 2)])
    new = spark.createDataFrame([(1, 2, 0), (1, 1, 1), (3, 1, 0)], "unit_id long, partition_id long, seq long")
    assert sorted(rows(A.load(own, new))) == [(1, 1), (2, 1), (3, 1)]
    with pytest.raises(ValueError, match="unknown"):
        A.load(own, new.withColumn("unit_id", F.col("unit_id") + 5))
    assert sorted(rows(A.reassign(own, 2, 2))) == [(1, 1), (2, 2), (3, 2)]


def test_random_assignments(spark):
    units = spark.range(50).withColumnRenamed("id", "unit_id")
    found = rows(A.random_assignment(units, 7, 3))
    assert sorted(found) == sorted(rows(A.random_assignment(units.repartition(3), 7, 3))) and {p for _, p in found} == set(range(1, 8)) and len(found) == 50
    for k in (0, 51):
        with pytest.raises(ValueError):
            A.random_assignment(units, k, 3)


def test_components_of_a_long_path_and_loose_nodes(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 55), (55, 51)], "src long, dst long")
    found = dict(rows(C.components(nodes, edges)))
    assert all(found[i] == 0 for i in range(41)) and found[51] == found[55] == 50 and found[45] == 45 and len(found) == 60
    assert dict(rows(C.components(nodes, edges.limit(0)))) == {i: i for i in range(60)}


def connected(own, near):
    for p in set(own.values()):
        members = {u for u, q in own.items() if q == p}
        front = [min(members)]
        seen = set(front)
        while front:
            new = near[front.pop()] & members - seen
            seen |= new
            front += new
        if seen != members:
            return False
    return True


def test_repair_connects_every_partition(spark, sf_dir):
    adj, own = X.adjacency(spark, sf_dir).cache(), X.scattered(spark, sf_dir)
    found = dict(rows(C.repair(own, adj, X.units(spark, sf_dir))))
    near = {}
    for a, b, _ in rows(adj):
        near.setdefault(a, set()).add(b)
    assert found.keys() == dict(rows(own)).keys() and connected(found, near) and set(found.values()) == set(dict(rows(own)).values())


def test_repair_over_blocks_goes_by_hops(spark, monkeypatch):
    """A long path with more hops than rounds could make one by one, and a random graph, in blocks of a few units."""
    monkeypatch.setattr(C, "BLOCK_UNITS", 300)
    path = [(i, i + 1) for i in range(1500)]
    own = {i: 1 + (i >= 1490) + (2 <= i < 1490) * (i % 2) for i in range(1501)}
    rng = np.random.default_rng(4)
    random = [(int(a), int(b)) for a, b in rng.integers(0, 400, (900, 2)) if a != b] + [(i, i + 1) for i in range(399)]
    for pairs, own, block in ((path, own, 300), (random, {i: int(p) for i, p in enumerate(rng.integers(1, 7, 400))}, 40)):
        monkeypatch.setattr(C, "BLOCK_UNITS", block)
        near = {i: set() for i in own}
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        units = spark.createDataFrame([(i, 1 + i % 3) for i in own], "unit_id long, pop long")
        found = dict(rows(C.repair(assigned(spark, list(own.items())), ungraph(spark, sorted({tuple(sorted(p)) for p in pairs})), units)))
        assert found == slow_repair(own, near, {i: 1 + i % 3 for i in own})


def slow_repair(own, near, pops):
    best, seen = {}, set()
    for i in sorted(own):
        if i not in seen:
            part, front = {i}, [i]
            while front:
                met = {j for j in near[front.pop()] if own[j] == own[i]} - part
                part |= met
                front += met
            seen |= part
            best[own[i]] = max(best.get(own[i], (0, 0, set())), (sum(pops[j] for j in part), -i, part))
    settled = {j: p for p, (*_, part) in best.items() for j in part}
    while len(settled) < len(own):
        settled |= {i: min(settled[j] for j in near[i] if j in settled) for i in own if i not in settled and any(j in settled for j in near[i])}
    return settled


def test_repair_fails_on_an_island(spark):
    units = spark.createDataFrame([(i, 10 - i) for i in range(4)], "unit_id long, pop long")
    with pytest.raises(ValueError, match="touch no other"):
        C.repair(assigned(spark, [(0, 1), (1, 1), (2, 1), (3, 1)]), ungraph(spark, [(0, 1), (2, 3)]), units)


# --- swaps and chains ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def region(spark, sf_dir):
    """Bricks with partitions of four columns each."""
    units = X.units(spark, sf_dir).cache()
    adj = X.brick_adjacency(spark, sf_dir).join(units.select(F.col("unit_id").alias("src")), "src", "left_semi").join(units.select(F.col("unit_id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight").cache()
    inter = graphs.interactions(units, 50.0, 40.0).cache()
    own = X.grid(spark, sf_dir).join(units, "unit_id", "left_semi").select("unit_id", (1 + F.floor(F.col("gx") / 10)).alias("partition_id")).cache()
    return units, adj, inter, own


@pytest.mark.parametrize("strips", [True, False])
def test_moves_equal_the_chains(spark, region, strips):
    units, adj, inter, own = region
    if not strips:
        own = A.random_assignment(units, 3, 1)
    graph = chains.Graph.collect(units, adj, inter)
    start = dict(rows(own))
    chain = chains.Chain(graph, np.array([start[u] for u in graph.ids.tolist()]), chains.Parameters(), 5)
    found = swaps.candidates(own, adj, inter)
    judged = {(r.unit_id, r.dst_partition): r for r in swaps.legality(swaps.scores(found, A.populations(own, units)), own, adj).collect()}
    mine = {(int(graph.ids[i]), p): (a, chain.legal(i, p)) for i, m in chain.moves.items() for p, a in m.items()}
    assert judged.keys() == mine.keys() and judged
    for k, r in judged.items():
        assert r.affinity == pytest.approx(mine[k][0]) and r.legal == mine[k][1]
    assert any(r.legal for r in judged.values()) and all(r.legal for r in judged.values()) == strips


def test_a_chain_keeps_its_invariants(spark, region):
    units, adj, inter, own = region
    graph = chains.Graph.collect(units, adj, inter)
    start = dict(rows(own))
    chain = chains.Chain(graph, np.array([start[u] for u in graph.ids.tolist()]), chains.Parameters(population_weight=2.0), 11)
    near = {int(graph.ids[i]): {int(graph.ids[j]) for j in n} for i, n in enumerate(graph.near)}
    total = sum(chain.pops.values())
    made = 0
    for _ in range(60):
        made += chain.step() is not None
        assert connected({int(u): int(p) for u, p in zip(graph.ids, chain.partition)}, near)
    assert made and sum(chain.pops.values()) == total
    fresh = chains.Chain(graph, chain.partition, chain.parameters, 0)
    assert fresh.moves.keys() == chain.moves.keys() and fresh.pops == chain.pops
    for i, m in chain.moves.items():
        assert m == pytest.approx(fresh.moves[i])


def test_chains_are_reproducible(spark, region):
    units, adj, inter, own = region
    graph = chains.Graph.collect(units, adj, inter)
    table = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 1, 1.0, 1.0), (2, 2, 0.1, 4.0)], "chain long, seed long, temperature double, population_weight double")
    a, b = (sorted(rows(chains.anneal(table.repartition(n), graph, rows(own), 15))) for n in (1, 3))
    assert a == b and [r[1:] for r in a if r[0] == 0] == [r[1:] for r in a if r[0] == 1] != [r[1:] for r in a if r[0] == 2]


def test_blocks_of_interactions_give_the_same_chains(spark, region, monkeypatch):
    """Interactions may be more than a worker holds; a task reads them in blocks."""
    units, adj, inter, strips = region
    table = spark.createDataFrame([(k, k, 1.0, 1.0) for k in range(2)], "chain long, seed long, temperature double, population_weight double")
    whole = sorted(rows(chains.anneal(table, chains.Graph.collect(units, adj, inter), strips, 15)))
    for name, n in (("MOST_EDGES", adj.count()), ("BLOCK_EDGES", 40), ("BLOCKS_HELD", 2)):
        monkeypatch.setattr(chains, name, n)
    graph = chains.Graph.spread(units, adj, inter)
    assert len(graph.reach.blocks) > 5 and sorted(rows(chains.anneal(table, graph, strips, 15))) == whole
    with pytest.raises(ValueError, match="fit"):
        chains.Graph.collect(units, adj, inter)
    with pytest.raises(ValueError, match="partition"):
        graph.aligned(strips.limit(1))


def test_growing_needs_no_interactions(spark, region, monkeypatch):
    units, adj, inter, _ = region
    monkeypatch.setattr(chains, "MOST_EDGES", adj.count())
    graph = chains.Graph.of_units(units, adj)
    found = {(r.seed, r.unit_id): r.partition_id for r in chains.random_connected(spark.range(2).withColumnRenamed("id", "seed"), graph, 4).collect()}
    assert found == {(s, u): p for s in range(2) for u, p in chains.grow(graph, 4, s).items()} and len(found) == 2 * units.count()


def test_gumbel_follows_the_softmax(spark):
    n, scores = 4000, [0.0, 0.5, -1.0, 1.5]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "unit_id long, score double").withColumn("dst_partition", F.lit(1)).withColumn("legal", F.col("unit_id") != 3)
    # one draw for each seed, as `pick` makes it
    u = (F.pmod(F.xxhash64("seed", "unit_id", "dst_partition"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    drawn = table.filter("legal").crossJoin(spark.range(n).withColumnRenamed("id", "seed")).groupBy("seed").agg(F.max_by("unit_id", F.col("score") - F.ln(-F.ln(u))).alias("unit_id"))
    counts = Counter(r.unit_id for r in drawn.collect())
    weights = [math.exp(s) for s in scores[:3]]
    chi = sum((counts[i] - n * w / sum(weights)) ** 2 / (n * w / sum(weights)) for i, w in enumerate(weights))
    assert chi < 13.8 and 3 not in counts  # the 0.1 % point of two degrees of freedom
    assert swaps.pick(table, 4).count() == 1 and swaps.pick(table.filter("unit_id = 3"), 4).count() == 0


def test_temperature_must_be_positive(spark, region):
    with pytest.raises(ValueError):
        swaps.scores(spark.createDataFrame([], "unit_id long, src_partition long, dst_partition long, affinity double"), A.populations(region[3], region[0]), temperature=0)


def test_interpolation():
    p = chains.Parameters(temperature=4.0, population_weight=0.0, interp_steps=3, end_temperature=1.0, end_weight=9.0).started()
    assert p.population_weight == 9.0
    p = p.advanced()
    assert (p.temperature, p.interp_step) == (pytest.approx(4.0), 2)
    p = p.advanced()
    assert p.temperature == pytest.approx(2.0)
    p = p.advanced()
    assert (p.temperature, p.interp_step) == (1.0, 0) and p.advanced() == p


def test_growing_partitions(spark, region):
    graph = chains.Graph.collect(*region[:3])
    near = {int(graph.ids[i]): {int(graph.ids[j]) for j in n} for i, n in enumerate(graph.near)}
    found = chains.grow(graph, 6, 2)
    assert connected(found, near) and set(found.values()) == set(range(1, 7)) and found == chains.grow(graph, 6, 2)
    with pytest.raises(ValueError, match="disconnected"):
        chains.grow(chains.Graph([(1, 1), (2, 1)], [], []), 1, 0)
    with pytest.raises(ValueError):
        chains.grow(graph, 0, 0)


# --- geometry -----------------------------------------------------------------------------------------------------


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def test_points_in_a_ring_with_a_hole(spark):
    outer = [[0.0, 0.0], [0.0, 9.0], [9.0, 9.0], [9.0, 0.0], [0.0, 0.0]]
    hole = [[3.0, 3.0], [3.0, 6.0], [6.0, 6.0], [6.0, 3.0], [3.0, 3.0]]
    df = spark.createDataFrame([(1, [[outer, hole]])], "unit_id long, geometry array<array<array<array<double>>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 4.0, 4.0), (1, 0.0, 4.0), (1, 3.0, 4.0), (1, 10.0, 4.0), (1, 1.0, 3.0), (1, 9.0, 9.0)], "unit_id long, x double, y double")
    found = {(r.x, r.y): r.inside for r in geometry.crossings(points, df).collect()}
    assert found == {(1.0, 1.0): True, (4.0, 4.0): False, (0.0, 4.0): False, (3.0, 4.0): False, (10.0, 4.0): False, (1.0, 3.0): True, (9.0, 9.0): False}


def test_rows_of_a_grid_find_the_points_that_single_tests_find(spark):
    random = np.random.default_rng(3)
    shapes = []
    for unit in range(12):  # stars around a point, in whole and half grid steps, so that corners and level edges lie on rows and no rounding matters
        angles = np.sort(random.uniform(0, 2 * math.pi, 9))
        reach = random.uniform(1, 6, 9)
        at = random.integers(-6, 6, 2)
        ring = [[float(np.round(2 * (at[0] + r * math.cos(a))) / 2), float(np.round(at[1] + r * math.sin(a)))] for a, r in zip(angles, reach)]
        shapes.append((unit, [[ring + ring[:1]]]))
    df = spark.createDataFrame(shapes, "unit_id long, geometry array<array<array<array<double>>>>")
    size = 0.5
    grid = [(u, i * size, j * size) for u in range(12) for i in range(-40, 41, 2) for j in range(-40, 41, 2)]
    judged = geometry.crossings(spark.createDataFrame(grid, "unit_id long, x double, y double"), df).filter("inside").collect()
    best: dict[tuple[float, float], int] = {}
    for r in judged:
        best[r.x, r.y] = max(best.get((r.x, r.y), -1), r.unit_id)
    found = {(r.i * size, r.j * size): r.unit_id for r in geometry.grid_points(df, size).collect()}
    assert found == best and len(found) > 50


def test_neighbours_hang_together(spark):
    random = np.random.default_rng(4)
    edges, own = [], []
    for unit in range(40):  # unit 1000 * unit and its neighbours, all in partition 2, with some links among them
        n = int(random.integers(1, 8))
        own += [(1000 * unit, 1)] + [(1000 * unit + i, 2) for i in range(1, n + 1)]
        edges += [(1000 * unit, 1000 * unit + i) for i in range(1, n + 1)]
        edges += [(1000 * unit + i, 1000 * unit + j) for i in range(1, n + 1) for j in range(i + 1, n + 1) if random.random() < 0.35]

    def whole(unit: int) -> bool:
        rest = {b for a, b in edges if a == unit}
        front = [rest.pop()]
        while front:
            near = {b for a, b in edges if a == front[-1]} | {a for a, b in edges if b == front[-1]}
            front.pop()
            front += near & rest
            rest -= near
        return not rest

    moves = spark.createDataFrame([(1000 * u, 1, 2) for u in range(40)], "unit_id long, src_partition long, dst_partition long")
    found = {r.unit_id: r.connected for r in swaps.sides(moves, assigned(spark, own), ungraph(spark, edges)).filter("partition = 2").collect()}
    assert found == {1000 * u: whole(1000 * u) for u in range(40)} and len(set(found.values())) == 2


def test_rings_touching_at_a_point_stay_apart(spark):
    square = lambda x, y: [[[[x, y], [x, y + 1.0], [x + 1.0, y + 1.0], [x + 1.0, y], [x, y]]]]
    df = spark.createDataFrame([(1, square(0.0, 0.0)), (2, square(1.0, 1.0)), (3, square(1.0, 0.0))], "unit_id long, geometry array<array<array<array<double>>>>")
    own = assigned(spark, [(1, 1), (2, 1), (3, 2)])
    found = sorted((r.partition_id, area(r.points), len(r.points)) for r in geometry.outline_rings(df, own).collect())
    assert found == [(1, 1.0, 5), (1, 1.0, 5), (2, 1.0, 5)]
    merged = geometry.outline_rings(df, assigned(spark, [(1, 1), (2, 1), (3, 1)])).collect()
    assert sum(area(r.points) for r in merged) == 3.0 and all(r.points[0] == r.points[-1] for r in merged)


def test_polylines_hold_each_segment_once(spark, sf_dir):
    held = X.boundaries(spark, sf_dir)
    wanted = {frozenset(((r.x1, r.y1), (r.x2, r.y2))) for r in graphs.segments(held).collect()}
    for tile in (None, 1.0):
        lines = [[tuple(p) for p in r.points] for r in geometry.polylines(held, tile).collect()]
        said = [frozenset(s) for line in lines for s in zip(line, line[1:])]
        assert len(said) == len(wanted) and set(said) == wanted


def test_cells_cover_the_units(spark, sf_dir):
    points = {(r.i, r.j): r.unit_id for r in geometry.grid_points(X.boundaries(spark, sf_dir), 0.0317123).collect()}
    found = Counter((r.unit_id, r.shape > 0) for r in geometry.cells(geometry.grid_points(X.boundaries(spark, sf_dir), 0.0317123)).collect())
    # each sampled point has the four cells around it, give or take halves at corners
    for unit, n in Counter(points.values()).items():
        assert 2 * n <= found[unit, False] + found[unit, True] <= 8 * n


def test_downsampled_rings_close(spark, sf_dir):
    for r in geometry.downsample(X.boundaries(spark, sf_dir), 0.0317123).collect():
        assert r.points[0] == r.points[-1] and len(r.points) >= 4


def test_projected_load(spark, sf_dir):
    units = X.grid(spark, sf_dir).filter("unit_id < 5")
    assert geometry.load_projected(X.boundaries(spark, sf_dir), units, 0).count() == 5
    assert geometry.load_projected(X.boundaries(spark, sf_dir), units, 64).select("unit_id").distinct().count() == 5


# --- colours and commands -----------------------------------------------------------------------------------------


def test_colours(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 10.0), (3, 100.0)], "id long, v double")
    found = colours.with_position(df, "v", log_scale=True).select("id", "at", colours.ramp(F.col("at")).alias("c")).collect()
    assert [r.at for r in found] == pytest.approx([0, 0.5, 1]) and [r.c for r in found] == ["#440154", "#21918c", "#fde725"]
    assert {r.at for r in colours.with_position(df.filter("id = 1"), "v").collect()} == {0.0}
    assert [r.at for r in colours.with_position(df, "v", least=0.0, most=10.0).collect()] == [0.1, 1.0, 1.0]


def test_truncating_grid(spark):
    found = spark.createDataFrame([(-1.9,), (-1.0,), (-0.4,), (0.0,), (0.9,), (1.0,)], "v double").select(E.grid_index(F.col("v"), 1.0))
    assert [r[0] for r in found.collect()] == [-1, -1, 0, 0, 0, 1]
