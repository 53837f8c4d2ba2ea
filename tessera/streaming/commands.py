"""Sessions steered by a stream of command lines."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import expressions as E
from ..session import Session


def read(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """Lines of text files as they appear in a folder, a file a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)


def parsed(lines: DataFrame) -> DataFrame:
    """(command, params) of each command."""
    return lines.select(F.explode(E.commands(F.col("value"))).alias("c")).select("c.*")


def steer(lines: DataFrame, session: Session, checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
    """Runs the session's frames in a thread of the driver, with or without input, and puts the lines of each batch, in
    order, as messages, of which a frame takes one. The command exit, or a failing step, stops the query. A batch that
    failed is seen again and left out by its number; a new process begins a new session, which is told the last batch again
    if its end wasn't recorded."""
    seen = {"batch": -1}

    def batch(rows: DataFrame, number: int) -> None:
        if number <= seen["batch"]:
            return
        for r in rows.collect():  # what a person has typed since the last batch
            session.put(r.value)
        seen["batch"] = number

    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

    def frames() -> None:
        try:
            session.loop()
        finally:
            session.ended = True
            query.stop()

    threading.Thread(target=frames, name="session", daemon=True).start()
    return query
