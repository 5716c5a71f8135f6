"""Model health: performance status, retrain decision and choice of the latest run."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuary.functions.parse import fixed4
from valuary.operators.evaluate import evaluate_predictions

# Limits of the performance monitor and of the retrain policy.
PERFORMANCE_LIMITS = {"warn_ppe10": 0.75, "critical_ppe10": 0.65, "warn_mdape": 0.08, "critical_mdape": 0.12}
RETRAIN_LIMITS = {"max_model_age_days": 90, "min_ppe10": 0.75, "max_mdape": 0.08, "max_drift_alerts": 0}
TRIAL_WORDS = ("smoke", "dryrun")


def performance_status(limits: dict[str, float] = PERFORMANCE_LIMITS) -> Column:
    """alert, warn or ok from columns ppe10 and mdape."""
    limits = {**PERFORMANCE_LIMITS, **limits}
    ppe10, mdape = F.col("ppe10"), F.col("mdape")
    return (
        F.when((ppe10 < limits["critical_ppe10"]) | (mdape > limits["critical_mdape"]), "alert")
        .when((ppe10 < limits["warn_ppe10"]) | (mdape > limits["warn_mdape"]), "warn")
        .otherwise("ok")
    )


def evaluate_performance(predictions: DataFrame, limits: dict[str, float] = PERFORMANCE_LIMITS, **columns) -> DataFrame:
    """Overall metrics of a prediction table with their status."""
    metrics = evaluate_predictions(predictions, **columns).where("group_type = 'overall'")
    return metrics.select("n", "ppe10", "mdape", "r2", performance_status(limits).alias("status"))


def retrain_decision(models: DataFrame, as_of: datetime, limits: dict[str, float] = RETRAIN_LIMITS) -> DataFrame:
    """Retrain or hold, with reasons, per row of a model table.

    Columns read: ppe10, mdape, performance_status, drift_alerts, trained_at (any may be null).
    """
    limits = {**RETRAIN_LIMITS, **limits}
    alerts = F.coalesce(F.col("drift_alerts"), F.lit(0))
    age = F.floor((F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.col("trained_at").cast("timestamp"))) / 86400)
    age = age.cast("int")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("performance_status") == "alert", "accuracy watch raised an alert"),
            F.when(
                F.col("ppe10") < limits["min_ppe10"],
                F.format_string(f"ppe10 is %s, wanted at least {limits['min_ppe10']:.4f}", fixed4(F.col("ppe10"))),
            ),
            F.when(
                F.col("mdape") > limits["max_mdape"],
                F.format_string(f"mdape is %s, allowed up to {limits['max_mdape']:.4f}", fixed4(F.col("mdape"))),
            ),
            F.when(
                alerts > limits["max_drift_alerts"],
                F.format_string(f"%d drift alerts, allowed up to {limits['max_drift_alerts']}", alerts),
            ),
            F.when(
                age > limits["max_model_age_days"],
                F.format_string(f"trained %d days ago, allowed up to {limits['max_model_age_days']}", age),
            ),
        )
    )
    out = models.withColumns({"model_age_days": age, "reasons": reasons})
    retrain = F.size("reasons") > 0
    return out.withColumns(
        {"should_retrain": retrain, "decision": F.when(retrain, "retrain").otherwise("hold")}
    )


def is_trial(name: Column) -> Column:
    """Whether a run or artifact name marks a smoke test or dry run."""
    lowered = F.lower(F.coalesce(name, F.lit("")))
    hit = F.lit(False)
    for word in TRIAL_WORDS:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit


def latest_run(
    runs: DataFrame,
    by: Sequence[str] = (),
    name: str = "run_name",
    time: str = "started_at",
    tie_break: str = "run_id",
    prefer_production: bool = True,
) -> DataFrame:
    """Newest run per group of `by`, real runs before trial ones."""
    order = [is_trial(F.col(name)).asc()] if prefer_production else []
    keyed = runs.withColumn("_all", F.lit(1)) if not by else runs
    w = Window.partitionBy(*(by or ["_all"])).orderBy(*order, F.col(time).desc(), F.col(tie_break).desc())
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_all")
