"""Sources, sinks, sessions and streams."""

import json
import struct
import time
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera import cli, session, svg
from tessera.operators import assignment as A
from tessera.operators import election, geometry, graphs
from tessera.plans import fixtures as X
from tessera.sources import census, readers, writers
from tessera.streaming import commands


def rows(df):
    return [tuple(r) for r in df.collect()]


SQUARE = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.mark.parametrize("lines", [False, True])
def test_geojson(spark, tmp_path, lines):
    features = [feature("Polygon", [SQUARE], POP20=5, COUNTYFP20="003"), feature("MultiPolygon", [[SQUARE], [SQUARE]], POP20=7, COUNTYFP20="005"), feature("Point", [0.0, 0.0], POP20=1, COUNTYFP20="007")]
    file = tmp_path / "blocks.json"
    file.write_text("\n".join(map(json.dumps, features)) if lines else json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    found = readers.blocks(spark, str(file), 6, lines).collect()
    assert [(r.unit_id, r.pop, len(r.geometry)) for r in found] == [(6003, 5.0, 1), (6005, 7.0, 2)]
    counties = [feature("Polygon", [SQUARE], GEOID="06003")]
    file.write_text("\n".join(map(json.dumps, counties)) if lines else json.dumps({"features": counties}))
    assert rows(readers.county_boundaries(spark, str(file), lines))[0] == (6003, [[SQUARE]])


def shape_file(shapes, rows):
    """A shape file and its table: rings of points for each shape, or None."""
    body = b""
    for i, rings in enumerate(shapes, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            firsts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            content = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(firsts)}i", *firsts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", i, len(content) // 2) + content
    fields = [(b"GEOID", b"C", 5, 0), (b"COUNTYFP20", b"C", 3, 0), (b"POP20", b"N", 8, 0), (b"LAND", b"N", 8, 2)]
    table = struct.pack("<B3sIHH20x", 3, b"\0\0\0", len(rows), 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    table += b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([size, dec]) + b"\0" * 14 for n, k, size, dec in fields) + b"\r"
    table += b"".join(b" " + b"".join(str(v).encode().rjust(f[2]) for v, f in zip(row, fields)) for row in rows)
    return b"\0" * 100 + body, table


def test_shape_files(spark, tmp_path):
    hole = [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.25)]
    square = [tuple(p) for p in SQUARE]
    away = [(x + 5, y) for x, y in square]
    shp, dbf = shape_file([[square], [away, square, hole], None], [("06003", "003", 12, "1.50"), ("06005", "005", 7, ""), ("06007", "007", "", "2.00")])
    found = list(census.features(shp, dbf))
    assert [f["properties"]["POP20"] for f in found] == [12, 7, None] and found[0]["properties"]["LAND"] == 1.5 and found[2]["geometry"] is None
    assert found[0]["geometry"] == {"type": "Polygon", "coordinates": [square]} and found[1]["geometry"] == {"type": "MultiPolygon", "coordinates": [[away], [square, hole]]}

    def fetch(url, file):
        asked.append(url)
        with zipfile.ZipFile(file, "w") as z:
            z.writestr("x.shp", shp)
            z.writestr("x.dbf", dbf)

    asked = []
    for _ in range(2):  # the second time it is there
        path = census.prepare_blocks(6, str(tmp_path), fetch)
        counties = census.prepare_counties(str(tmp_path), fetch)
    assert asked == [census.BLOCKS_URL + "tl_2020_06_tabblock20.zip", census.COUNTIES_URL + "tl_2020_us_county.zip"]
    assert [(r.unit_id, r.pop, len(r.geometry)) for r in readers.blocks(spark, path, 6, lines=True).collect()] == [(6003, 12.0, 1), (6005, 7.0, 2)]
    assert [r.unit_id for r in readers.county_boundaries(spark, counties, lines=True).collect()] == [6003, 6005, 6007]
    straight = census.zipped_features(spark, f"{tmp_path}/data/downloads/*.zip", "POP20:double,COUNTYFP20:string")
    assert straight.count() == 6 and straight.filter("geometry is null").count() == 2
    with pytest.raises(ValueError, match="type 1"):
        list(census.features(b"\0" * 100 + struct.pack(">iii", 1, 10, 0)[:8] + struct.pack("<i", 1) + b"\0" * 16, dbf))


def test_states(spark, tmp_path):
    file = tmp_path / "states.tsv"
    file.write_text("Name\tAlpha code\tNumeric code\n# a remark\nCalifornia\tCA\t6\nArizona\tAZ\t4\n")
    table = readers.states(spark, str(file))
    assert [r.code for r in readers.select_states(table, ["all"]).collect()] == [4, 6]
    assert rows(readers.select_states(table, ["6", "6"])) == [("California", "CA", 6)]
    assert readers.state_file(6, "/b").endswith("tl_2020_06_tabblock20.json") and readers.county_file("/b").startswith("/b/")
    assert readers.cache_path("/r", "edges", sigma=5, limit=9) != readers.cache_path("/r", "edges", sigma=6, limit=9)


def test_round_trips(spark, tmp_path, sf_dir):
    own = X.blocky(spark, sf_dir)
    writers.write_assignment(own, str(tmp_path / "a.csv"))
    assert rows(readers.assignment(spark, str(tmp_path / "a.csv"))) == sorted(rows(own))
    for name in ("u.tsv", "u"):
        units = X.units(spark, sf_dir)
        writers.write_units(units, str(tmp_path / name))
        assert sorted(rows(readers.units(spark, str(tmp_path / name)))) == sorted(rows(units))
    writers.write_table(X.boundaries(spark, sf_dir), str(tmp_path / "b"))
    assert sorted(rows(readers.boundaries(spark, str(tmp_path / "b")))) == sorted(rows(X.boundaries(spark, sf_dir)))
    writers.write_table(X.adjacency(spark, sf_dir), str(tmp_path / "e"))
    assert sorted(rows(readers.edges(spark, str(tmp_path / "e")))) == sorted(rows(X.adjacency(spark, sf_dir)))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.votes(spark, str(tmp_path / "none.csv"))


def test_election_etl(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("year,state,state_po,county_name,county_fips,office,candidate,party,candidatevotes\n2020,WASHINGTON,WA,KING,53033,P,X,DEMOCRAT,10\n2020,WASHINGTON,WA,KING,53033,P,Y,GREEN,3\n2020,ALASKA,AK,D1,2001,P,X,DEMOCRAT,4\n2020,WASHINGTON,WA,PIERCE,NA,P,X,REPUBLICAN,8\n2020,OREGON,OR,LANE,41039,P,Y,REPUBLICAN,6\n")
    cli.parse_election(spark, str(raw), str(tmp_path / "election.csv"))
    assert rows(readers.votes(spark, str(tmp_path / "election.csv"))) == [(41039, 0, 6, 0), (53033, 10, 0, 3)]


def test_arguments():
    a = cli.arguments([])
    assert (a.num_partitions, a.personal_stdev, a.personal_max_distance, a.states) == (4, 50.0, 400.0, ["6"])


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    units = X.units(spark, sf_dir).cache()
    adj = X.brick_adjacency(spark, sf_dir).join(units.select(F.col("unit_id").alias("src")), "src", "left_semi").join(units.select(F.col("unit_id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight").cache()
    return units, X.bricks(spark, sf_dir).join(units, "unit_id", "left_semi").cache(), adj, graphs.interactions(units, 50.0, 40.0).cache(), X.votes(spark, sf_dir).cache()


def test_session(spark, made, tmp_path):
    units, boundaries, adj, inter, votes = made
    said = []
    s = session.Session(spark, units, boundaries, adj, inter, 4, 1, votes, said.append)
    s.clock.step = s.clock.plot = 0.5
    s.frame()
    assert s.paused and not s.steps
    s.frame(["unpause; Temperature=0.5; population weight = 2; interp steps=5; interp temperature=0.1; interp population weight=4; interp"])
    assert (s.parameters.temperature, s.parameters.population_weight, s.parameters.interp_step) == (0.5, 2.0, 1)
    for _ in range(6):
        s.chain.step()
    s.frame()
    assert s.parameters.temperature == pytest.approx(0.1)
    own = tmp_path / "Kept.csv"
    s.run(f"pause; Save={own}")
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "notes.txt").write_text("kept")
    s.run(f"save={own}; save={tmp_path / 'mine'}")
    assert "failed" in said.pop() and (tmp_path / "mine" / "notes.txt").exists()
    before = sorted(rows(s.assignment()))
    s.run("full shuffle")
    assert sorted(rows(s.assignment())) != before
    s.run(f"load={own}")
    assert sorted(rows(s.assignment())) == before and s.paused
    s.run("info; anim info; help; simulate election; nonsense; interp temperature=-1; temperature=x; show counties=true")
    assert sum("failed" in x for x in said) == 3 and any(x.startswith("DEM ") for x in said) and sum(x.startswith("partition ") for x in said) == 4
    for command in ("plot partition populations", "plot county populations", "update plot"):
        s.run(f"{command}; save image={tmp_path / 'image.svg'}")
        text = (tmp_path / "image.svg").read_text()
        assert text.startswith("<svg") and text.count("<path") >= 4 and "<polyline" in text
    s.run("force connected=false; reset; unpause; pause plot; exit")
    fresh = replace(type(s.parameters)(), start_temperature=0.5, start_weight=2.0)  # a reset leaves where interpolation began
    assert s.parameters == fresh and not s.paused and s.plot_paused and s.ended
    assert not [x for x in said if "failed" in x][3:]


def test_steps_per_frame():
    assert session.Clock(1.0, 0.1, 0.35).steps_per_frame() == 6 and session.Clock(1.0, 5.0, 2.0).steps_per_frame() == 1
    c = session.Clock()
    c.saw("step", 0.0)
    assert c.step == 0.5


def test_one_message_a_frame_and_images(spark, made, tmp_path):
    s = session.Session(spark, *made[:4], 4, 1, made[4], lambda _: None, display=str(tmp_path / "display.svg"))
    s.frame(["temperature=3; exit; temperature=9", "temperature=4"])
    assert s.parameters.temperature == 3.0 and s.ended and s.messages.qsize() == 1
    assert not (tmp_path / "display.svg").exists()
    s.run("show counties=true")  # drawn, though paused
    assert s.clock.plot != 1.0 and "<polyline" in (tmp_path / "display.svg").read_text()
    c = session.Clock(1.0, 0.1, 0.75)
    assert c.steps_per_frame() == 2 and c.steps_per_frame(drawn=False) == 10


def test_command_stream(spark, made, tmp_path):
    s = session.Session(spark, *made[:4], 4, 1, made[4], lambda _: None)
    s.clock.frame = 0.05
    folder = tmp_path / "in"
    folder.mkdir()
    query = commands.steer(commands.read(spark, str(folder)), s, str(tmp_path / "checkpoint"), 0.1)

    def soon(what):
        until = time.monotonic() + 60
        while not what() and time.monotonic() < until:
            time.sleep(0.05)
        return what()

    try:
        (folder / "1.txt").write_text("temperature=0.25\nunpause\n")
        assert soon(lambda: s.steps > 0) and s.parameters.temperature == 0.25
        before = s.steps
        assert soon(lambda: s.steps > before + 3)  # steps go on without input
        (folder / "2.txt").write_text("exit\n")
        assert query.awaitTermination(60) and s.ended
    finally:
        query.stop()


def test_derived_tables_are_kept(spark, made, tmp_path, monkeypatch):
    units, boundaries, adj, inter, votes = made
    geo = boundaries.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("unit_id").cast("string").alias("GEOID")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry").alias("coordinates")).alias("geometry"))))
    geo.coalesce(1).write.text(str(tmp_path / "counties"))
    monkeypatch.setattr(cli.census, "prepare_counties", lambda base: str(tmp_path / "counties"))
    monkeypatch.setattr(cli, "unit_moments", lambda *_: units)
    a = cli.arguments(["--base", str(tmp_path), "--resolution", "60", "--personal-max-distance", "40"])
    first = [sorted(rows(t)) for t in cli.tables(spark, a, [6])]
    assert [len(t) > 0 for t in first] == [True] * 4 and first[2] == sorted(rows(adj))
    rings = cli.tables(spark, a, [6])[1]
    assert {r.unit_id for r in rings.collect()} <= {r.unit_id for r in units.collect()}

    def never(*_):
        raise AssertionError("computed again")

    for module, name in ((cli, "unit_moments"), (cli.graphs, "adjacency"), (cli.graphs, "interactions"), (cli.geometry, "load_projected")):
        monkeypatch.setattr(module, name, never)
    assert [sorted(rows(t)) for t in cli.tables(spark, a, [6])] == first


def test_commands_as_rows(spark):
    found = commands.parsed(spark.createDataFrame([("A=Bc; Pause",)], "value string"))
    assert rows(found) == [("a", "Bc"), ("pause", "")]


def test_empty_image(spark, tmp_path):
    rings = spark.createDataFrame([], "partition_id long, line int, points array<array<double>>")
    svg.draw(rings, spark.createDataFrame([], "partition_id long, colour string"), str(tmp_path / "e.svg"))
    assert "<svg" in (tmp_path / "e.svg").read_text()


def test_flagship_has_all_electors(spark, sf_dir):
    found = election.college(election.simulate(X.blocky(spark, sf_dir), X.units(spark, sf_dir), X.votes(spark, sf_dir))).first()
    n = A.members(X.blocky(spark, sf_dir)).count()
    assert sum(found) == 4 + 3 + 432 + 2 * n
    assert geometry.total_bounds(X.boundaries(spark, sf_dir)).count() == 1
