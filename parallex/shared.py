"""Tables in the folder that driver and executors share: lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this repository wherever the driver started."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([here, *known])


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only where the session has none, and runs in one local JVM, a temporary
    folder stands in; on a cluster a missing setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    where = "file://" + tempfile.mkdtemp(prefix="parallex-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Lets Spark delete an execution's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet and read again: lost executors re-read it
    instead of recomputing, what isn't deterministic is settled, and later plans
    start from it.  The write's shuffle files go when it has ended, for nothing
    reads them again.  ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bound the Arrow batches that Python workers get by bytes, not only by
    rows, unless the session already does: texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not str(now).isdigit() or int(now) > limit:
        spark.conf.set(key, str(limit))
