"""Census shape files: fetched if missing, unpacked, and turned into GeoJSON with one feature a line, which Spark splits.

Zipped shape files can also be read as they are, a file a task, by `zipped_features`.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.request import urlretrieve

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

# Where the public files are.
BLOCKS_URL = "https://www2.census.gov/geo/tiger/TIGER2020/TABBLOCK20/"
COUNTIES_URL = "https://www2.census.gov/geo/tiger/TIGER2020/COUNTY/"
#: Shape types: polygons, and those with heights or measures, which are left out.
_POLYGONS, _NULL = (5, 15, 25), 0


def _records(dbf: bytes) -> Iterator[dict]:
    """The rows of a dBASE table: numbers as numbers, other fields as text, blank ones as None."""
    n_rows, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields = []
    at = 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii"), chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]))
        at += 32
    for i in range(n_rows):
        at = head + i * width + 1
        row = {}
        for name, kind, size, decimals in fields:
            text = dbf[at : at + size].decode("utf-8", "replace").strip(" \0")
            at += size
            if not text or kind in "NF" and set(text) == {"*"}:
                row[name] = None
            elif kind in "NF":
                row[name] = float(text) if decimals or "." in text or "e" in text.lower() else int(text)
            else:
                row[name] = text
        yield row


def _area(ring: list) -> float:
    """Twice the signed area, above 0 if the ring runs clockwise."""
    return sum(b[0] * a[1] - a[0] * b[1] for a, b in zip(ring, ring[1:]))


def _within(point: tuple, ring: list) -> bool:
    x, y = point
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def _polygons(rings: list[list]) -> list[list[list]]:
    """Clockwise rings are exteriors, the others holes of the smallest exterior that holds them."""
    outer = [[r] for r in rings if _area(r) > 0]
    for hole in (r for r in rings if _area(r) <= 0):
        around = [p for p in outer if _within(hole[0], p[0])]
        min(around, key=lambda p: _area(p[0])).append(hole) if around else outer.append([hole])
    return outer


def _shapes(shp: bytes) -> Iterator[list[list[list]] | None]:
    at = 100
    while at + 8 <= len(shp):
        words = struct.unpack_from(">ii", shp, at)[1]
        kind = struct.unpack_from("<i", shp, at + 8)[0]
        if kind in _POLYGONS:
            n_parts, n_points = struct.unpack_from("<ii", shp, at + 44)
            first = [*struct.unpack_from(f"<{n_parts}i", shp, at + 52), n_points]
            values = struct.unpack_from(f"<{2 * n_points}d", shp, at + 52 + 4 * n_parts)
            points = list(zip(values[::2], values[1::2]))
            yield _polygons([points[a:b] for a, b in zip(first, first[1:])])
        elif kind == _NULL:
            yield None
        else:
            raise ValueError(f"shapes of type {kind}")
        at += 8 + 2 * words


def features(shp: bytes, dbf: bytes) -> Iterator[dict]:
    """GeoJSON features of a shape file and its table."""
    for shape, row in zip(_shapes(shp), _records(dbf), strict=True):
        if shape is None:
            geometry = None
        elif len(shape) == 1:
            geometry = {"type": "Polygon", "coordinates": shape[0]}
        else:
            geometry = {"type": "MultiPolygon", "coordinates": shape}
        yield {"type": "Feature", "properties": row, "geometry": geometry}


def _of_zip(data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name = {os.path.splitext(n)[1].lower(): n for n in z.namelist()}
        yield from features(z.read(name[".shp"]), z.read(name[".dbf"]))


def prepare(target: str, url: str, fetch: Callable[[str, str], object] = urlretrieve) -> str:
    """Makes the GeoJSON file `target`, if it isn't there, from the zipped shape file of the same name under `url`. What is
    half done has another name, so a run that breaks off leaves no target."""
    if os.path.isfile(target):
        return target
    os.makedirs(os.path.dirname(target), exist_ok=True)
    archive = os.path.splitext(target)[0] + ".zip"
    if not os.path.isfile(archive):
        fetch(url + os.path.basename(archive), archive + ".part")
        os.replace(archive + ".part", archive)
    with open(archive, "rb") as f, open(target + ".part", "w", encoding="utf-8") as out:
        for feature in _of_zip(f.read()):
            out.write(json.dumps(feature) + "\n")
    os.replace(target + ".part", target)
    return target


def prepare_blocks(state: int, base: str | None = None, fetch: Callable[[str, str], object] = urlretrieve) -> str:
    return prepare(readers.state_file(state, base), BLOCKS_URL, fetch)


def prepare_counties(base: str | None = None, fetch: Callable[[str, str], object] = urlretrieve) -> str:
    return prepare(readers.county_file(base), COUNTIES_URL, fetch)


def zipped_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties columns, geometry) of all zipped shape files that `path` names, wherever Spark can read them."""
    schema = pa.schema([("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held: list[str] = []
                for feature in _of_zip(data):
                    held.append(json.dumps(feature))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], schema=schema)
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], schema=schema)

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
    return readers.parsed_features(lines, properties)
