"""A sampling session: one chain, its tables, and the commands that steer it.

Commands are texts `name` or `name=value`, several on a line with semicolons between. Names are read in any case; values
keep theirs. A command that fails is reported and changes nothing; a failing step ends the session.

`loop` runs frames until the command exit: steps, as many as fit the frame's time, then an image, if there is a display
(a file drawn anew each frame), then one message of those that wait. Messages may be put by other threads. A session
starts paused.
"""

from __future__ import annotations

import math
import queue
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import svg
from .operators import assignment as A
from .operators import chains, colours, election, geometry
from .operators.components import repair
from .sources import readers, writers

_HELP = {
    "session": ("help", "exit", "info", "reset", "interp", "full shuffle", "save=<file>", "load=<file>"),
    "display": ("pause[=true|false]", "unpause", "pause plot[=true|false]", "reset plot", "update plot", "show counties=<true|false>", "anim info", "save image=<file>"),
    "data": ("plot county populations", "plot partition populations", "simulate election"),
    "properties": ("temperature=<x>", "population weight=<x>", "force connected[=true|false]", "interp steps=<n>", "interp temperature=<x>", "interp population weight=<x>"),
}


def split_line(line: str) -> list[tuple[str, str]]:
    """The (name, value) of each command of a line."""
    found = []
    for part in line.split(";"):
        name, _, value = part.partition("=")
        found.append((name.strip().lower(), value.strip()))
    return found


def truth(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0"):
        raise ValueError(f"neither true nor false: {text}")
    return text.lower() in ("true", "1")


@dataclass
class Clock:
    """Moving averages, with weight one half for the newest, of the seconds that a step and a plot take."""

    frame: float = 1.0
    step: float = 1.0
    plot: float = 1.0

    def saw(self, name: str, seconds: float) -> None:
        setattr(self, name, 0.5 * getattr(self, name) + 0.5 * seconds)

    def steps_per_frame(self, drawn: bool = True) -> int:
        """As many as fit a frame beside its image, if one is drawn."""
        left = self.frame - (self.plot if drawn else 0.0)
        return max(1, math.floor(left / self.step)) if self.step > 0 else 1


class Session:
    def __init__(self, spark: SparkSession, units: DataFrame, boundaries: DataFrame, adjacency: DataFrame, interactions: DataFrame, k: int, seed: int = 0, votes: DataFrame | None = None, say: Callable[[str], None] = print, display: str | None = None):
        self.spark, self.units, self.boundaries, self.adjacency, self.interactions = spark, units, boundaries, adjacency, interactions
        self.votes, self.say, self.seed = votes, say, seed
        self.graph = chains.Graph.collect(units, adjacency, interactions)
        self.parameters = chains.Parameters()
        self.k = k
        self.draws = self.steps = 0
        self.clock = Clock()
        self.display = display
        self.messages: queue.SimpleQueue[str] = queue.SimpleQueue()
        self.paused = True
        self.plot_paused = self.show_counties = self.ended = False
        self.colours: DataFrame | None = None
        self._begin(chains.grow(self.graph, k, seed))

    # state

    def _begin(self, assignment: dict[int, int]) -> None:
        self.draws += 1
        partition = np.array([assignment[u] for u in self.graph.ids.tolist()], np.int64)
        self.chain = chains.Chain(self.graph, partition, self.parameters, self.seed + self.draws)

    def assignment(self) -> DataFrame:
        return self.spark.createDataFrame([(int(u), int(p)) for u, p in zip(self.graph.ids, self.chain.partition)], "unit_id long, partition_id long")

    def _rebuild(self, assignment: DataFrame) -> None:
        """Derived state anew, after a repair if partitions must be connected."""
        if self.parameters.force_connected:
            assignment = repair(assignment, self.adjacency, self.units)
        self._begin({r.unit_id: r.partition_id for r in assignment.collect()})

    def _set(self, **values: object) -> None:
        self.parameters = self.chain.parameters = replace(self.chain.parameters, **values)

    # frames

    def drawn(self) -> bool:
        return self.display is not None and not self.plot_paused

    def put(self, line: str) -> None:
        """A message for a later frame; any thread may put it."""
        if line.strip():
            self.messages.put(line)

    def frame(self, lines: list[str] = ()) -> None:
        """Steps and an image, unless paused, then the commands of one waiting message. lines: messages to put first."""
        for line in lines:
            self.put(line)
        if not self.paused:
            began, n = time.monotonic(), self.clock.steps_per_frame(self.drawn())
            for _ in range(n):
                self.chain.step()
            self.steps += n
            self.parameters = self.chain.parameters
            self.clock.saw("step", (time.monotonic() - began) / n)
            if self.drawn():
                self.colours = None
                self._draw(self.display)
        try:
            self.run(self.messages.get_nowait())
        except queue.Empty:
            pass

    def loop(self) -> None:
        """Frames, each as long as the clock's, until the command exit."""
        while not self.ended:
            began = time.monotonic()
            self.frame()
            left = self.clock.frame - (time.monotonic() - began)
            if left > 0 and not self.ended:
                time.sleep(left)

    def run(self, line: str) -> None:
        for name, value in split_line(line):
            try:
                self.command(name, value)
            except Exception as e:  # noqa: BLE001  a session goes on after a failing command
                self.say(f"{name} failed: {e}")
            if self.ended:
                break

    # commands

    def command(self, name: str, value: str) -> None:
        if not name:
            return
        action = getattr(self, "do_" + {"unpause": "pause", "frame info": "anim info", "reset anim": "update plot", "reset plot": "update plot", "save plot": "save image"}.get(name, name).replace(" ", "_"), None)
        if action is None:
            raise ValueError("no such command")
        action(value)

    def do_exit(self, _: str) -> None:
        self.ended = True

    def do_help(self, _: str) -> None:
        for topic, names in _HELP.items():
            self.say(f"{topic}: " + ", ".join(names))

    def do_info(self, _: str) -> None:
        p = self.chain.parameters
        self.say(f"temperature {p.temperature:g}, population weight {p.population_weight:g}, force connected {p.force_connected}")
        self.say(f"interpolation step {p.interp_step} of {p.interp_steps}, to temperature {p.end_temperature:g} and population weight {p.end_weight:g}")
        own = self.assignment()
        found = A.populations(own, self.units).join(A.affinities(own, self.interactions), "partition_id").orderBy("partition_id")
        for r in found.collect():
            self.say(f"partition {r.partition_id}: population {r.pop}, affinity {r.affinity:g}")

    def do_reset(self, _: str) -> None:
        self._set(temperature=1.0, population_weight=1.0, force_connected=True, interp_step=0, interp_steps=0, end_temperature=1.0, end_weight=1.0)
        self._rebuild(self.assignment())

    def do_force_connected(self, value: str) -> None:
        self._set(force_connected=truth(value) if value else True)
        if self.parameters.force_connected:
            self._rebuild(self.assignment())

    def do_interp(self, _: str) -> None:
        self.parameters = self.chain.parameters = self.chain.parameters.started()

    def do_full_shuffle(self, _: str) -> None:
        self._rebuild(A.random_assignment(self.units, self.k, self.seed + self.draws))

    def do_temperature(self, value: str) -> None:
        self._set(temperature=float(value))

    def do_population_weight(self, value: str) -> None:
        self._set(population_weight=float(value))

    def do_interp_steps(self, value: str) -> None:
        if int(value) < 0:
            raise ValueError("steps below 0")
        self._set(interp_steps=int(value))

    def _positive(self, value: str) -> float:
        if not float(value) > 0:
            raise ValueError(f"not above 0: {value}")
        return float(value)

    def do_interp_temperature(self, value: str) -> None:
        self._set(end_temperature=self._positive(value))

    def do_interp_population_weight(self, value: str) -> None:
        self._set(end_weight=self._positive(value))

    def do_save(self, value: str) -> None:
        writers.write_assignment(self.assignment(), value)

    def do_load(self, value: str) -> None:
        rows = readers.assignment(self.spark, value).withColumn("seq", F.monotonically_increasing_id())
        self._rebuild(A.load(self.assignment(), rows))

    def do_plot_county_populations(self, _: str) -> None:
        found = colours.with_position(self.units.select("unit_id", "pop"), "pop", log_scale=True)
        self._show(found.select("unit_id", colours.ramp(F.col("at")).alias("colour")))

    def do_plot_partition_populations(self, _: str) -> None:
        found = colours.with_position(A.populations(self.assignment(), self.units), "pop", log_scale=True)
        self._show(found.select("partition_id", colours.ramp(F.col("at")).alias("colour")))

    def do_simulate_election(self, _: str) -> None:
        if self.votes is None:
            raise ValueError("there are no votes")
        found = election.simulate(self.assignment(), self.units, self.votes)
        r = election.college(found).first()
        self.say(f"DEM {r.dem_electors}, GOP {r.gop_electors}")
        found = colours.with_position(found, "gop_fraction", least=0.45, most=0.55)
        self._show(found.select("partition_id", colours.ramp(F.col("at"), colours.BLUE_WHITE_RED).alias("colour")))

    def do_pause(self, value: str) -> None:
        self.paused = truth(value) if value else not self.paused

    def do_pause_plot(self, value: str) -> None:
        self.plot_paused = truth(value) if value else not self.plot_paused

    def do_anim_info(self, _: str) -> None:
        c = self.clock
        self.say(f"paused {self.paused}, display paused {self.plot_paused}, show counties {self.show_counties}")
        self.say(f"step {1e3 * c.step:g} ms, plot {1e3 * c.plot:g} ms, frame {1e3 * c.frame:g} ms, {c.steps_per_frame(self.drawn())} steps a frame")

    def do_update_plot(self, _: str) -> None:
        self._show(None)

    def do_show_counties(self, value: str) -> None:
        self.show_counties = truth(value)
        self._show(None)

    def do_save_image(self, value: str) -> None:
        self._draw(value)

    def _show(self, found: DataFrame | None) -> None:
        """Colours of units or partitions, or none for the partitions' own; the display, if there is one, has them at once."""
        self.colours = found
        if self.display is not None:
            self._draw(self.display)

    def _draw(self, path: str) -> None:
        began = time.monotonic()
        own = self.assignment()
        key = "unit_id" if self.colours is not None and "unit_id" in self.colours.columns else "partition_id"
        owners = own if key == "partition_id" else own.select(F.col("unit_id"), F.col("unit_id").alias("owner"))
        rings = geometry.outline_rings(self.boundaries, owners, key if key == "partition_id" else "owner")
        rings = rings if key == "partition_id" else rings.withColumnRenamed("owner", key)
        found = self.colours if self.colours is not None else own.select(key).distinct().withColumn("colour", colours.categorical(F.col(key)))
        svg.draw(rings, found, path, key, geometry.polylines(self.boundaries) if self.show_counties else None)
        self.clock.saw("plot", time.monotonic() - began)
