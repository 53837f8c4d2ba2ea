"""Command line: builds a session from files, whose derived tables are kept by their parameters, and reads commands from
standard input while it samples."""

from __future__ import annotations

import argparse
import sys
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import election, geometry, graphs, moments
from .session import Session
from .sources import census, readers, writers


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tessera", description="Samples partitions of counties.")
    parser.add_argument("--num-partitions", type=int, default=4)
    parser.add_argument("--personal-stdev", type=float, default=50.0, help="kilometres")
    parser.add_argument("--personal-max-distance", type=float, default=400.0, help="kilometres")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--resolution", type=int, default=1024, help="grid cells along an image's shorter side, 0 for all points")
    parser.add_argument("--display", help="an image file, drawn anew each frame")
    parser.add_argument("--base", default=readers.base_dir(), help="folder with data and results")
    parser.add_argument("states", nargs="*", default=["6"], help="numbers of states, or all")
    return parser.parse_args(args)


def kept(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] = writers.write_table) -> DataFrame:
    """The table at `path`, made and written there first if there is none."""
    try:
        return read(spark, path).select("*")
    except AnalysisException as e:  # not there yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    write(make(), path)
    return read(spark, path)


def unit_moments(spark: SparkSession, base: str, states: list[int]) -> DataFrame:
    """Moments of the states' counties, from their blocks."""
    parts = None
    for state in states:
        blocks = readers.blocks(spark, census.prepare_blocks(state, base), state, lines=True)
        blocks = blocks.withColumn("block", F.monotonically_increasing_id())
        placed = moments.block_positions(moments.vertices(blocks, "block", "unit_id", "pop"), "block", "unit_id", "pop")
        parts = placed if parts is None else parts.unionByName(placed)
    return moments.unit_moments(parts)


def tables(spark: SparkSession, a: argparse.Namespace, states: list[int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Units, boundaries as drawn (projected, on a grid), adjacency and interactions, computed once for each choice of
    states and parameters."""
    at = lambda name, **more: readers.cache_path(f"{a.base}/results", name, states="_".join(map(str, states)), **more)
    found = kept(spark, at("units"), readers.units, lambda: unit_moments(spark, a.base, states), writers.write_units)
    counties = lambda: readers.county_boundaries(spark, census.prepare_counties(a.base), lines=True).join(found.select("unit_id"), "unit_id", "left_semi")
    raw = kept(spark, at("boundaries"), readers.boundaries, counties)
    drawn = kept(spark, at("shapes", resolution=a.resolution), readers.boundaries, lambda: geometry.shapes(geometry.load_projected(raw, found, a.resolution)))
    adjacency = kept(spark, at("adjacency"), readers.edges, lambda: graphs.adjacency(raw))
    pull = kept(spark, at("interactions", stdev=a.personal_stdev, limit=a.personal_max_distance), readers.edges, lambda: graphs.interactions(found, a.personal_stdev, a.personal_max_distance))
    return found, drawn, adjacency, pull


def parse_election(spark: SparkSession, source: str, target: str) -> None:
    writers.write_votes(election.parse_returns(readers.returns(spark, source)), target)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    chosen = readers.select_states(readers.states(spark, f"{a.base}/data/state_codes.tsv"), a.states).collect()
    print("States: " + ", ".join(r.name for r in chosen))
    found, drawn, adjacency, pull = tables(spark, a, [r.code for r in chosen])
    session = Session(spark, found, drawn, adjacency, pull, a.num_partitions, a.seed, readers.votes(spark, f"{a.base}/data/election2020.csv"), display=a.display)

    def listen() -> None:
        for line in sys.stdin:
            session.put(line)
        session.put("exit")  # the end of the input

    threading.Thread(target=listen, name="commands", daemon=True).start()
    session.loop()


if __name__ == "__main__":
    main()
