"""Usage roll-up and sessions; the same functions take static and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from valuary.operators.usage import SESSION_GAP_MINUTES


def daily_usage(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Calls, cost and tokens per day and model; a stream emits a day once the watermark has passed it."""
    if log.isStreaming:
        log = log.withWatermark("timestamp", lateness)
    counted = log.groupBy(F.window("timestamp", "1 day").alias("w"), "model").agg(
        F.count("*").alias("calls"),
        F.sum("cost_estimate").alias("cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    return counted.select(F.to_date("w.start").alias("day"), "model", "calls", "cost", "input_tokens", "output_tokens")


def sessions(
    turns: DataFrame, user: str, time: str, gap_minutes: int = SESSION_GAP_MINUTES, lateness: str = "1 hour"
) -> DataFrame:
    """Sessions of a user ended by a silent gap, with start, end and number of turns.

    A static table is first counted per user and slot of one gap length, inside which no session can
    end. However many turns a user has, only its slots meet in one task.
    """
    gap = f"{gap_minutes} minutes"
    if turns.isStreaming:
        grouped = turns.withWatermark(time, lateness).groupBy(user, F.session_window(time, gap).alias("s"))
        counted = grouped.agg(F.count("*").alias("turns"))
        return counted.select(user, F.col("s.start").alias("started_at"), F.col("s.end").alias("expires_at"), "turns")
    slots = turns.where(F.col(time).isNotNull()).groupBy(user, F.window(time, gap).alias("slot"))
    slots = slots.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("turns"))
    along = Window.partitionBy(user).orderBy("first")
    silent = F.expr(f"interval {gap_minutes} minutes")
    begins = F.coalesce(F.col("first") > F.lag("last").over(along) + silent, F.lit(True))
    numbered = slots.withColumn("_begins", begins.cast("int")).withColumn("_session", F.sum("_begins").over(along))
    grouped = numbered.groupBy(user, "_session").agg(
        F.min("first").alias("started_at"), (F.max("last") + silent).alias("expires_at"), F.sum("turns").alias("turns")
    )
    return grouped.drop("_session")


def write_daily_usage(log_stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append finished days of a streaming log to a Parquet table."""
    writer = daily_usage(log_stream).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def roll_up_landed(
    spark: SparkSession, landing: str, schema: StructType, path: str, checkpoint: str, **options: str
) -> DataFrame:
    """Roll up the log files that landed since the last call, and return all finished days so far.

    The checkpoint holds which files were counted, the open days and the watermark, so a call that broke off is
    taken up where it stood and no row counts twice. A row that comes later than the watermark allows is left out;
    days that the watermark hasn't passed stay open. Without any finished day the result is empty.
    """
    log = spark.readStream.schema(schema).options(**options).parquet(landing)
    write_daily_usage(log, path, checkpoint).awaitTermination()
    finished = daily_usage(spark.createDataFrame([], schema)).schema
    return spark.read.schema(finished).parquet(path)
