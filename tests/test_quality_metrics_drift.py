"""Contracts, accuracy metrics, drift, retraining and the arena."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuary.operators import arena, contracts, drift, evaluate, monitor
from valuary.operators.ordered import group_quantiles
from valuary.schemas import DRIFT_SCHEMA

SALE = "sale_date date, sale_price double, bbl bigint, latitude double, longitude double, borough int, block int, lot int, building_class string, building_class_category string"
GOOD = (date(2025, 1, 1), 5e5, 1000010001, 40.7, -73.9, 1, 1, 1, "A", "01")


def test_valid_table_passes(rows):
    df = rows([GOOD], SALE)
    result = contracts.enforce(df, contracts.sales_violations(df, date(2025, 6, 1)))
    assert result.passed and result.row_count == 1


@pytest.mark.parametrize(
    "column,value,check",
    [
        ("sale_price", 5000.0, "domain_sale_price"),
        ("bbl", 123, "domain_bbl"),
        ("latitude", 10.0, "domain_coordinates"),
        ("borough", 9, "domain_borough"),
        ("sale_date", date(2020, 1, 1), "freshness"),
        ("sale_price", None, "null_threshold"),
    ],
)
def test_each_violation_raises(rows, column, value, check):
    df = rows([GOOD], SALE).withColumn(column, F.lit(value).cast(dict(rows([GOOD], SALE).dtypes)[column]))
    found = contracts.sales_violations(df, date(2025, 6, 1))
    assert check in {r["check"] for r in found.collect()}
    with pytest.raises(contracts.ContractError, match=check):
        contracts.enforce(df, found)
    assert not contracts.enforce(df, found, raise_on_error=False).passed


def test_missing_column_and_empty_table(rows):
    df = rows([GOOD], SALE).drop("lot")
    assert {r["check"] for r in contracts.sales_violations(df, date(2025, 6, 1)).collect()} == {"required_columns"}
    empty = rows([], SALE)
    assert {r["message"] for r in contracts.sales_violations(empty, date(2025, 6, 1)).collect()} == {"no sale_date could be read"}


PRED = "sale_price double, predicted_price double, property_segment string, price_tier string, sale_date date"


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.uniform(1e5, 1e6, 300)
    p = y * rng.uniform(0.7, 1.3, 300)
    seg = rng.choice(["A", "B"], 300)
    data = [(float(a), float(b), str(s), "entry", date(2024, 1 + i % 12, 1)) for i, (a, b, s) in enumerate(zip(y, p, seg))]
    data += [(0.0, 1.0, "A", "entry", None), (5.0, None, "A", None, None), (7.0, 7.0, "LONE", None, None)]
    df = spark.createDataFrame(data, PRED)
    got = {(r["group_type"], r["group_name"]): r for r in evaluate.evaluate_predictions(df).collect()}
    assert set(got) == {("overall", "all"), ("segment", "A"), ("segment", "B"), ("price_tier", "entry")}
    ape = np.abs(p - y) / y
    for s in "AB":
        m, r = seg == s, got[("segment", s)]
        assert r["n"] == m.sum() and r["ppe10"] == pytest.approx((ape[m] <= 0.1).mean())
        assert r["mdape"] == pytest.approx(np.median(ape[m]))
        assert r["r2"] == pytest.approx(1 - ((y - p)[m] ** 2).sum() / ((y[m] - y[m].mean()) ** 2).sum())
    quarters = [r["period"] for r in evaluate.temporal_scorecard(df).orderBy("period").collect()]
    assert quarters == ["2024Q1", "2024Q2", "2024Q3", "2024Q4"]


def test_scorecard_keeps_null_predictions(rows):
    df = rows([(100.0, 100.0, "A", None, None), (100.0, None, "A", None, None)], PRED)
    row = evaluate.segment_scorecard(df).first()
    assert (row["n"], row["ppe10"], row["mdape"], row["r2"]) == (2, 0.5, None, None)
    assert evaluate.evaluate_predictions(df).where("group_type = 'segment'").count() == 0


def test_r2_without_variance(rows):
    flat = rows([(5.0, 5.0, "A", None, None)] * 2 + [(5.0, 6.0, "B", None, None)] * 2, PRED)
    got = {r["group_name"]: r["r2"] for r in evaluate.segment_scorecard(flat).collect()}
    assert got == {"A": 1.0, "B": 0.0}


def _psi(ref, cur, bins=10):
    cuts = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    e, c = (np.histogram(x, bins=cuts)[0] for x in (ref, cur))
    e, c = (np.clip(x / max(x.sum(), 1), 1e-6, None) for x in (e, c))
    return float(np.sum((c - e) * np.log(c / e)))


def test_drift_matches_numpy(spark):
    rng = np.random.default_rng(42)
    ref = {"a": rng.normal(0, 1, 400), "b": rng.integers(1, 4, 400).astype(float), "c": np.full(400, 2.0)}
    cur = {"a": rng.normal(1.2, 1, 300), "b": rng.integers(1, 5, 300).astype(float), "c": np.full(300, 2.0)}

    def frame(d):
        return spark.createDataFrame([tuple(map(float, r)) for r in zip(*d.values())], "a double, b double, c double")

    out = drift.monitor_drift(frame(ref), frame(cur), ["a", "b", "c", "absent"])
    got = {r["feature"]: r for r in out.collect()}
    assert set(got) == {"a", "b", "c"}
    for f in "ab":
        assert got[f]["psi"] == pytest.approx(_psi(ref[f], cur[f]))
    assert (got["c"]["psi"], got["c"]["ks"], got["c"]["status"]) == (0.0, 0.0, "ok")
    assert got["a"]["status"] == "alert"
    assert [r["feature"] for r in drift.order_by_status(out).collect()][0] == "a"


def test_small_samples_have_no_drift_value(rows):
    df = rows([(float(i),) for i in range(19)], "a double")
    row = drift.monitor_drift(df, df, ["a"]).first()
    assert (row["reference_n"], row["psi"], row["ks"], row["status"]) == (19, None, None, "ok")


def test_no_matching_feature(rows):
    empty = drift.monitor_drift(rows([(1.0,)], "a double"), rows([(1.0,)], "b double"), ["a"])
    assert empty.schema == DRIFT_SCHEMA and empty.count() == 0
    assert drift.drift_summary(empty).first()["status"] == "warn"


def test_missingness_by_slice(rows):
    data = [("ELEVATOR", date(2024, 1, 1), 1.0), ("ELEVATOR", date(2024, 2, 1), None), (None, None, 2.0)]
    df = rows(data, "property_segment string, sale_date date, x double")
    got = {(r["segment"], r["period"], r["feature"]): r["missing_rate"] for r in drift.feature_missingness(df, ["x", "gone"]).collect()}
    assert got[("ELEVATOR", "2024Q1", "x")] == 0.5 and got[("UNKNOWN", "unknown", "x")] == 0.0
    assert got[("ELEVATOR", "2024Q1", "gone")] == 1.0


def test_slice_drift_alerts_on_shift(spark):
    rng = np.random.default_rng(0)
    schema = "property_segment string, sale_date date, x double, c string"
    train = spark.createDataFrame([("S", date(2023, 1, 1), float(v), "k") for v in rng.normal(0, 1, 200)], schema)
    test = spark.createDataFrame(
        [("S", date(2024, 1, 1), float(v), "new") for v in rng.normal(5, 1, 60)] + [("T", date(2024, 1, 1), 0.1, None)], schema
    )
    got = {(r["segment"], r["feature"]): r for r in drift.drift_by_segment_time(train, test, ["x", "c"]).collect()}
    assert got[("S", "x")]["status"] == "alert" and got[("S", "x")]["baseline_scope"] == "segment"
    assert got[("S", "c")]["cat_unseen_rate"] == 1.0 and got[("S", "c")]["feature_type"] == "categorical"
    assert got[("T", "x")]["baseline_scope"] == "global_fallback" and got[("T", "x")]["status"] == "ok"
    assert got[("T", "x")]["reference_n"] == 200
    ordered = drift.order_by_severity(drift.drift_by_segment_time(train, test, ["x", "c"])).collect()
    assert [r["status"] for r in ordered] == sorted((r["status"] for r in ordered), key=["alert", "warn", "ok"].index)


def test_performance_and_retraining(rows):
    df = rows([(100.0, 180.0, "A", "entry", None)] * 40 + [(200.0, 80.0, "B", "entry", None)] * 40, PRED)
    assert monitor.evaluate_performance(df).first()["status"] == "alert"
    models = rows(
        [("bad", 0.70, 0.09, "warn", 1, datetime(2025, 1, 1)), ("good", 0.9, 0.05, "ok", 0, None)],
        "m string, ppe10 double, mdape double, performance_status string, drift_alerts int, trained_at timestamp",
    )
    got = {r["m"]: r for r in monitor.retrain_decision(models, datetime(2025, 3, 1), {"max_model_age_days": 30}).collect()}
    assert got["bad"]["decision"] == "retrain" and len(got["bad"]["reasons"]) == 4
    assert got["bad"]["reasons"][0] == "ppe10 is 0.7000, wanted at least 0.7500"
    assert (got["good"]["decision"], got["good"]["model_age_days"]) == ("hold", None)


def test_latest_run_prefers_production(rows):
    runs = rows([("r1", "model_v1", 1), ("r2", "model_smoke", 9), ("r3", "dryrun_x", 8)], "run_id string, run_name string, started_at int")
    assert monitor.latest_run(runs).first()["run_id"] == "r1"
    assert monitor.latest_run(runs.where("run_id <> 'r1'")).first()["run_id"] == "r2"
    assert monitor.latest_run(runs, prefer_production=False).first()["run_id"] == "r2"


METRICS = "run_id string, group_type string, group_name string, n bigint, ppe10 double, mdape double"
CHAMPION = [("champ", "overall", "all", 22, 0.30, 0.20), ("champ", "segment", "A", 10, 0.32, 0.19), ("champ", "segment", "B", 12, 0.28, 0.21)]


def test_arena_gates(rows):
    better = [("x", "overall", "all", 22, 0.34, 0.17), ("x", "segment", "A", 10, 0.35, 0.17), ("x", "segment", "B", 12, 0.30, 0.18)]
    worse = [("y", "overall", "all", 22, 0.31, 0.17), ("y", "segment", "A", 10, 0.10, 0.17), ("y", "segment", "B", 12, 0.31, 0.18)]
    metrics = rows(CHAMPION + better + worse, METRICS)
    ranked = arena.rank_candidates(arena.evaluate_candidates(metrics, "champ", policy={"major_segment_min_n": 2}))
    got = {r["run_id"]: r for r in ranked.collect()}
    assert got["x"]["gate_pass"] and got["x"]["is_winner"] and got["x"]["score"] > 0
    assert not got["y"]["gate_pass"] and got["y"]["max_major_segment_ppe10_drop"] == pytest.approx(0.22)
    gates = {r["gate_key"]: r["status"] for r in arena.gate_table(ranked).collect()}
    assert set(gates.values()) == {"pass"} and len(gates) == 5
    assert arena.champion_quality(metrics, "champ").first()["status"] == "pass"


def test_arena_drift_gate_and_unknown_champion(rows):
    metrics = rows(CHAMPION + [("x", "overall", "all", 22, 0.34, 0.17)], METRICS)
    runs = rows([("champ", "v1", 0), ("x", "v2", 3)], "run_id string, model_version string, drift_alerts int")
    row = arena.evaluate_candidates(metrics, "champ", runs, {"major_segment_min_n": 2}).first()
    assert (row["drift_alert_delta"], row["gate_pass"], row["model_version"]) == (3, False, "v2")
    with pytest.raises(ValueError, match="champion"):
        arena.evaluate_candidates(metrics, "nobody")


def test_run_eligibility(rows):
    tags = "status string, run_name string, run_kind string, " + ", ".join(f"{t} string" for t in arena.REQUIRED_TAGS)
    full = ["a"] * len(arena.REQUIRED_TAGS)
    runs = rows(
        [
            ("FINISHED", "train", "train", *full),
            ("RUNNING", "train", "train", *full),
            ("FINISHED", "Smoke_1", "train", *full),
            ("FINISHED", "train", "eval", *full),
            ("FINISHED", "train", "train", *full[:-1], ""),
        ],
        tags,
    )
    assert arena.eligible_runs(runs).count() == 1


def test_quantiles_of_a_hot_value(spark):
    df = spark.range(9000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    row = group_quantiles(df, ["g"], "v", {"q30": 0.3, "q90": 0.9}, max_cell_rows=10).first()
    values = np.array([5.0 if i % 3 == 0 else float(i) for i in range(9000)])
    assert row["q30"] == np.quantile(values, 0.3) and row["q90"] == pytest.approx(np.quantile(values, 0.9))
