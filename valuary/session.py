"""Session defaults and the shared work folder used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table with at most this many rows may be broadcast; above it joins stay shuffled.
MAX_LOOKUP_ROWS = 200_000

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Independent fits run side by side, each in a pool of its own.
    "spark.scheduler.mode": "FAIR",
}


def spark_session(app_name: str = "valuary", master: str | None = None, **conf) -> SparkSession:
    """Session with this library's defaults; cluster settings such as partitions stay with the caller."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fallback_dir(master: str) -> str:
    """A temporary folder for a session in one process; on a cluster, where executors would not see it, an error."""
    if master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="valuary-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`; where it is unset, only a local session gets one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(configured or fallback_dir(sc.master))
        current = sc.getCheckpointDir()
    return configured or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that later uses neither recompute nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores when its scan has fewer partitions than that; larger scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stage_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a wide intermediate table to the shared folder and read it back: later passes scan only their columns.

    With a `folder` (a `scratch_path`) it lies there, to go with the folder once nothing reads it any more."""
    path = scratch_path(df.sparkSession, name) if folder is None else f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of staged tables."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(table: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """A materialised table marked for broadcast when its counted size is within `max_rows`."""
    return F.broadcast(table) if table.count() <= max_rows else table


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = MAX_LOOKUP_ROWS,
) -> DataFrame:
    """Equi-join against a grouped table: broadcast when its counted size is within `max_rows`, shuffled otherwise.

    The table is usually an aggregate of `df` itself. Left to the planner it would be estimated as
    large as its input and the wide side would be shuffled once per lookup.
    """
    return df.join(broadcast_if_small(materialise(table), max_rows), on, how)
