"""Scans. Every schema is given; nothing is inferred."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def base_dir() -> str:
    """Where relative paths begin: the folder in TESSERA_BASE, or the current one."""
    return os.environ.get("TESSERA_BASE", os.getcwd())


def state_file(state: int, base: str | None = None) -> str:
    """The place of a state's census blocks; its number has two digits."""
    return f"{base or base_dir()}/data/downloads/tl_2020_{state:02d}_tabblock20.json"


def county_file(base: str | None = None) -> str:
    return f"{base or base_dir()}/data/downloads/tl_2020_us_county.json"


def states(spark: SparkSession, path: str) -> DataFrame:
    """The state dimension: tab-separated, with a header and # comments."""
    return spark.read.schema(schemas.STATES).csv(path, sep="\t", header=True, comment="#")


def select_states(dimension: DataFrame, wanted: Iterable[str | int]) -> DataFrame:
    """Rows of the chosen codes, or all of them for the one word 'all', by code."""
    wanted = [str(w) for w in wanted]
    chosen = dimension if wanted == ["all"] else dimension.filter(F.col("code").isin(*{int(w) for w in wanted}))
    return chosen.dropDuplicates(["code"]).orderBy("code")


def geometry_of(kind: Column, coordinates: Column) -> Column:
    """Nested points from the JSON text of a Polygon or MultiPolygon; null for other kinds."""
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    one = F.from_json(coordinates, "array<array<array<double>>>")
    return F.when(kind == "MultiPolygon", many).when(kind == "Polygon", F.array(one))


def _feature(properties: str) -> str:
    return f"struct<type:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"


def _columns(found: DataFrame) -> DataFrame:
    return found.select("f.properties.*", geometry_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"))


def parsed_features(lines: DataFrame, properties: str) -> DataFrame:
    """`features` of rows (value), a feature each."""
    return _columns(lines.select(F.from_json("value", _feature(properties)).alias("f")))


def features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """GeoJSON features as (properties columns, geometry). properties: their DDL. lines: one feature a line, which Spark
    splits; otherwise one collection a file."""
    if lines:
        return parsed_features(spark.read.text(path), properties)
    schema = f"type string, features array<{_feature(properties)}>"
    return _columns(spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")))


def blocks(spark: SparkSession, path: str, state: int, lines: bool = False) -> DataFrame:
    """Census blocks of a state: (unit_id, pop, geometry). Blocks without a usable geometry are left out."""
    found = features(spark, path, "POP20:double,COUNTYFP20:string", lines)
    return found.filter("geometry is not null").select((F.lit(state * 1000) + F.col("COUNTYFP20").cast("long")).alias("unit_id"), F.col("POP20").alias("pop"), "geometry")


def county_boundaries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(unit_id, geometry), the id parsed from text."""
    return features(spark, path, "GEOID:string", lines).select(F.col("GEOID").cast("long").alias("unit_id"), "geometry")


def units(spark: SparkSession, path: str) -> DataFrame:
    """Population moments, tab-separated with a header, or Parquet."""
    if path.endswith((".tsv", ".tsv.gz")):
        return spark.read.schema(schemas.UNITS).csv(path, sep="\t", header=True)
    return spark.read.schema(schemas.UNITS).parquet(path)


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BOUNDARIES).parquet(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EDGES).parquet(path)


def votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes by county: a CSV file with the header geoid,dem,gop,other. Fails if there is no such file."""
    found = spark.read.schema("geoid long, dem long, gop long, other long").csv(path, header=True)
    return found.withColumnRenamed("geoid", "unit_id")


def returns(spark: SparkSession, path: str) -> DataFrame:
    """Raw returns, a CSV file with a header, by position."""
    return spark.read.schema(schemas.RETURNS).csv(path, header=True, enforceSchema=True)


def assignment(spark: SparkSession, path: str) -> DataFrame:
    """unit,partition lines without a header."""
    return spark.read.schema(schemas.ASSIGNMENT).csv(path)


def cache_path(base: str, name: str, **parameters: object) -> str:
    """Where a derived table is kept: its parameters are part of the place, so others are never returned for it."""
    said = "-".join(f"{k}={v}" for k, v in sorted(parameters.items()))
    return f"{base}/{name}" + (f"/{said}" if said else "")
