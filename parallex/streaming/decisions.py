"""The decision log as a stream: the latest decision of every unit.

An addition of this engine: review services append decisions to a log; here the
log is read as a stream whose state holds each unit's best decision, by revision,
then time, then place in the log, whatever order events arrive in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallex.shared import shared_dir


def latest(events: DataFrame) -> DataFrame:
    """One row for each unit of a stream (or table) of ``unit_id``, ``status``,
    ``revision``, ``at``, ``seq``: an incremental aggregate whose state is a row
    for each unit; late events need no watermark because the revision decides."""
    best = F.max_by(F.struct("status", "revision"), F.struct("revision", "at", "seq"))
    return events.groupBy("unit_id").agg(best.alias("d")).select("unit_id", "d.status", "d.revision")


def counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Decisions of each status in windows of event time; events later than
    ``late`` are left out of closed windows."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "status").count().select("window.start", "status", "count")


def sink(spark: SparkSession, table_dir: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: each batch's changed units as a new version
    folder, so a batch that is run again overwrites its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/version={epoch}")

    return write


def current(spark: SparkSession, table_dir: str) -> DataFrame:
    """The state that the sink's versions add up to."""
    rows = spark.read.parquet(table_dir)
    best = F.max_by(F.struct("status", "revision"), "version")
    return rows.groupBy("unit_id").agg(best.alias("d")).select("unit_id", "d.status", "d.revision")


def replayed(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stored log through the stream until nothing is left."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    run = latest(shape(stream)).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
    run.foreachBatch(sink(spark, f"{folder}/table")).trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{folder}/table")
