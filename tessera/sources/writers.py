"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_units(units: DataFrame, path: str) -> None:
    """Tab-separated with a header if the path says so, else Parquet."""
    if path.endswith(".tsv"):
        units.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)  # a row for each county
    else:
        units.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Boundaries and graphs, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_votes(votes: DataFrame, path: str) -> None:
    """geoid,dem,gop,other with a header, by county."""
    votes.select(F.col("unit_id").alias("geoid"), "dem", "gop", "other").orderBy("geoid").coalesce(1).write.mode("overwrite").csv(path, header=True)


def _is_assignment(df: DataFrame, path: str) -> bool:
    """There is nothing at the path, or what `write_assignment` has written."""
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return True
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.getFileStatus(at).isDirectory() else []
    return "_SUCCESS" in names and all(n == "_SUCCESS" or n.startswith("part-") and n.endswith(".csv") for n in names)


def write_assignment(assignment: DataFrame, path: str) -> None:
    """unit,partition without a header, by unit. Replaces a saved assignment, but nothing else."""
    if not _is_assignment(assignment, path):
        raise ValueError(f"{path} is there and isn't a saved assignment")
    assignment.select("unit_id", "partition_id").orderBy("unit_id").coalesce(1).write.mode("overwrite").csv(path)
