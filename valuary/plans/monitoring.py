"""Monitoring and governance runs over prediction and metrics tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuary.operators import arena, monitor
from valuary.operators.drift import WATCHED_FEATURES, drift_summary, monitor_drift, order_by_status
from valuary.session import materialise


@dataclass(frozen=True)
class MonitoringResult:
    drift: DataFrame
    summary: DataFrame
    performance: DataFrame
    decision: DataFrame


def monitor_model(
    reference: DataFrame,
    current: DataFrame,
    as_of: datetime,
    trained_at: datetime | None = None,
    features: Sequence[str] = WATCHED_FEATURES,
) -> MonitoringResult:
    """Drift of the features, performance on the current slice and the retrain decision they lead to."""
    drift = materialise(monitor_drift(reference, current, features))
    summary = drift_summary(drift)
    performance = materialise(monitor.evaluate_performance(current))
    model = performance.select(
        "ppe10",
        "mdape",
        F.col("status").alias("performance_status"),
        summary.select(F.col("alerts")).scalar().alias("drift_alerts"),
        F.lit(trained_at).cast("timestamp").alias("trained_at"),
    )
    return MonitoringResult(order_by_status(drift), summary, performance, monitor.retrain_decision(model, as_of))


def propose_champion(
    metrics: DataFrame, runs: DataFrame, champion: str, policy: dict = arena.POLICY
) -> DataFrame:
    """Newest eligible runs ranked against the champion; `is_winner` marks the one to promote, if any."""
    chosen = arena.candidate_runs(runs, champion, policy.get("selection_window", 5)).select("run_id")
    kept = chosen.unionByName(chosen.sparkSession.createDataFrame([(champion,)], "run_id string"))
    decisions = arena.evaluate_candidates(
        metrics.join(F.broadcast(kept), "run_id", "left_semi"), champion, runs, policy
    )
    return arena.rank_candidates(decisions)
