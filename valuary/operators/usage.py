"""Usage and cost figures of a request audit log, and conversation sessions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Turns kept per session and minutes of silence that end one.
SESSION_TURNS = 8
SESSION_GAP_MINUTES = 30


def usage_stats(log: DataFrame, since: datetime | str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Calls, success percentage, cost, mean latency and tokens since a time; zeros for an empty log."""
    if since is not None:
        log = log.where(F.col("timestamp") >= F.lit(since).cast(log.schema["timestamp"].dataType))

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    calls, good = F.count("*"), F.count_if(F.col("success"))
    return log.groupBy(*by).agg(
        calls.alias("total_calls"),
        F.coalesce(F.try_divide(good, calls) * 100, F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        or_zero(F.sum("input_tokens")).alias("total_input_tokens"),
        or_zero(F.sum("output_tokens")).alias("total_output_tokens"),
    )


def daily_costs(log: DataFrame) -> DataFrame:
    """Cost per calendar day."""
    cost = F.coalesce(F.sum("cost_estimate"), F.lit(0.0))
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(cost.alias("total_cost"))


def last_turns(df: DataFrame, session: str, order: Sequence[str | Column], k: int = SESSION_TURNS) -> DataFrame:
    """Newest k turns per session, `order` given oldest first.

    The rank filter is applied inside each map task first (window group limit), so a session with
    very many turns sends at most k rows per task.
    """
    newest = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    w = Window.partitionBy(session).orderBy(*newest)
    return df.withColumn("turns_back", F.row_number().over(w)).where(F.col("turns_back") <= k)
