"""Readers, sinks, routing and the end-to-end plans on a small generated feed."""

from dataclasses import dataclass
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from valuary.operators import arena, model
from valuary.operators.contracts import ContractError
from valuary.operators.profile import sample_rows
from valuary.plans.etl import run_etl
from valuary.plans.monitoring import monitor_model, propose_champion
from valuary.plans.training import TrainConfig, train_model
from valuary.schemas import SALES_SCHEMA, TRAINING_COLUMNS
from valuary.sources import readers, sinks


@pytest.fixture(scope="module")
def feed(spark):
    """1,200 raw sales of 300 parcels with gaps, duplicates and untidy units."""
    return spark.range(1200).select(
        F.col("id").alias("row_order"),
        (F.lit(1000000001) + F.col("id") % 300 * 10000).alias("bbl"),
        (F.col("id") % 5 + 1).cast("int").alias("borough"),
        (F.col("id") % 300).cast("int").alias("block"),
        F.lit(1).alias("lot"),
        F.concat(F.col("id") % 300, F.lit(" MAIN ST, "), F.col("id") % 3, F.lit("A")).alias("address"),
        F.expr("case when id % 4 = 0 then 'APT 2B' end").alias("apartment_number"),
        F.expr("concat('N', id % 7)").alias("neighborhood"),
        F.expr("concat('C', id % 4)").alias("building_class"),
        F.expr("element_at(array('01 ONE', '07 WALK', '13 CONDO', '14 SMALL'), cast(id % 4 + 1 as int))").alias("building_class_category"),
        F.expr("case when id % 6 <> 0 then 500.0 + id % 400 end").alias("gross_square_feet"),
        F.expr("case when id % 9 = 0 then 0 else 1900 + id % 120 end").alias("year_built"),
        (F.lit(40.6) + F.col("id") % 20 * 0.01).alias("latitude"),
        (F.lit(-74.0) + F.col("id") % 20 * 0.01).alias("longitude"),
        F.expr("cast(id % 5 as double)").alias("residential_units"),
        F.expr("cast(id % 5 + 1 as double)").alias("total_units"),
        F.expr("50000.0 + (id % 400) * 900 + (id % 4) * 40000").alias("sale_price"),
        F.expr("date_add(date'2020-01-01', cast(id * 37 % 2000 as int))").alias("sale_date"),
    )


@pytest.fixture(scope="module")
def sales(feed):
    return run_etl(feed.unionByName(feed.limit(100)), date(2025, 9, 1), min_segment_rows=50)


def test_etl_enriches_and_reports(sales):
    out, stages = sales.sales, {r["stage"]: r for r in sales.stages.collect()}
    assert list(stages) and stages["extract_raw"]["rows"] == 1300 and stages["feature_engineered"]["rows"] == 1200
    assert out.where("gross_square_feet is null or year_built = 0 or price_tier is null or price_tier_proxy is null").count() == 0
    assert out.where("sale_sequence = 1").count() == out.select("property_id").distinct().count()


def test_etl_stops_on_a_broken_contract(feed):
    with pytest.raises(ContractError, match="freshness"):
        run_etl(feed, date(2029, 1, 1))
    with pytest.raises(ContractError, match="domain_bbl"):
        run_etl(feed.withColumn("bbl", F.lit(5)), date(2025, 9, 1))


def test_sales_sink_replaces_and_appends(spark, sales, tmp_path):
    path = str(tmp_path / "sales")
    sinks.write_sales(sales.sales, path, replace=True)
    sinks.write_sales(sales.sales.limit(10), path)
    stored = spark.read.schema(SALES_SCHEMA).parquet(path)
    assert stored.count() == 1210
    plan = stored.where("sale_year = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_year" in plan
    sinks.write_sales(sales.sales.limit(10), path, replace=True)
    assert spark.read.parquet(path).count() == 10


def test_report_formats(spark, rows, tmp_path):
    df = rows([("a", 1)], "k string, n int")
    for fmt in ("parquet", "csv", "json"):
        sinks.write_report(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 1
    with pytest.raises(ValueError):
        sinks.write_report(df, str(tmp_path / "x"), "xlsx")


def test_csv_source_limit_and_lineage(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("sale_price,address\n" + "".join(f'"{i},000","{i} A, 1B"\n' for i in range(50)))
    extract = readers.get_source(spark, " CSV ", path=str(path), limit=3)
    assert [r["sale_price"] for r in extract.df.orderBy("row_order").collect()] == ["0,000", "1,000", "2,000"]
    line = extract.lineage.first()
    assert (line["source_id"], line["row_count"], len(line["source_fingerprint"])) == ("csv", 3, 16)
    with pytest.raises(ValueError, match="unsupported"):
        readers.get_source(spark, "excel")
    with pytest.raises(ValueError, match="path"):
        readers.get_source(spark, "csv")


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:x", "SELECT * FROM sales", limit=5)
    assert plain == {"url": "jdbc:x", "dbtable": "(SELECT * FROM (SELECT * FROM sales) q LIMIT 5) q"}
    split = readers.jdbc_options("jdbc:x", "SELECT 1", partition_column="id", bounds=(0, 100), partitions=4)
    assert split["numPartitions"] == "4" and split["upperBound"] == "100"


def test_training_scan_adds_missing_proxy(sales):
    scan = readers.training_scan(sales.sales.drop("price_tier_proxy"), limit=5, order=("sale_date", "row_order"))
    assert scan.columns == list(TRAINING_COLUMNS) and scan.count() == 5
    assert scan.where("price_tier_proxy is not null").count() == 0
    newest = readers.latest_sales(sales.sales, 3, tie_break=("row_order",)).collect()
    assert [r["sale_date"] for r in newest] == sorted((r["sale_date"] for r in newest), reverse=True)


def test_attached_coordinates(rows):
    df = rows([(1, None, None), (2, 5.0, 6.0)], "bbl bigint, latitude double, longitude double")
    side = readers.coordinates_table(rows([("1", "40.5", "-73"), ("1", "40.5", "-73"), ("3", None, None)], "bbl string, latitude string, longitude string"))
    got = {r["bbl"]: (r["latitude"], r["longitude"]) for r in readers.attach_coordinates(df, side).collect()}
    assert got == {1: (40.5, -73.0), 2: (5.0, 6.0)}


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    one = {r[0] for r in sample_rows(df, "id", 20, 1).collect()}
    two = {r[0] for r in sample_rows(df.repartition(7), "id", 20, 1).collect()}
    assert one == two and len(one) == 20 and one != {r[0] for r in sample_rows(df, "id", 20, 2).collect()}


@dataclass
class Constant:
    value: float

    def transform(self, df):
        return df.withColumn("predicted_price", F.lit(self.value))


def test_routing_labels_and_fallback(sales):
    frame = sales.sales.limit(200).withColumn("h3_price_lag", F.lit(1.0))
    artifact = model.ModelArtifact(Constant(1.0), "segmented_router", ["property_segment"], {"WALKUP": Constant(2.0)})
    got = model.score(artifact, frame).select("property_segment", "model_route", "predicted_price").distinct().collect()
    by_segment = {r["property_segment"]: (r["model_route"], r["predicted_price"]) for r in got}
    assert by_segment["WALKUP"] == ("route:WALKUP", 2.0)
    assert {v for k, v in by_segment.items() if k != "WALKUP"} == {("fallback_global", 1.0)}
    blank = model.score(artifact, frame.withColumn("property_segment", F.lit(" "))).select("model_route").distinct()
    assert [r[0] for r in blank.collect()] == ["fallback_global"]
    assert model.score(artifact, frame.where("false")).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        model.score(artifact, frame.drop("total_units"))
    leaky = model.ModelArtifact(Constant(1.0), feature_columns=["price_tier"])
    with pytest.raises(ValueError, match="target-derived"):
        model.score(leaky, frame)


def test_score_derives_proxy_and_time_features(sales):
    frame = sales.sales.limit(50).withColumn("h3_price_lag", F.lit(1.0)).drop("price_tier_proxy", "month_sin", "rate_regime_bucket")
    artifact = model.ModelArtifact(Constant(1.0), "segmented_router", ["property_segment", "price_tier_proxy"], {"WALKUP||core": Constant(3.0)})
    got = model.score(artifact, frame)
    assert {"price_tier_proxy", "month_sin", "rate_regime_bucket"} <= set(got.columns)
    assert got.where("model_route = 'route:WALKUP||core' and predicted_price <> 3.0").count() == 0


def test_training_run_routed(spark, sales, tmp_path):
    config = TrainConfig(
        "segmented_router", "segment_plus_tier", min_segment_rows=150, params={"n_estimators": 2, "max_depth": 3, "learning_rate": 0.5, "colsample_bytree": 1.0}
    )
    out = str(tmp_path / "run")
    result = train_model(sales.sales, config, out)
    labels = {r[0] for r in result.predictions.select("model_route").distinct().collect()}
    assert "fallback_global" in labels and labels - {"fallback_global"} <= {f"route:{k}" for k in result.artifact.routes}
    overall = result.metrics.where("group_type = 'overall'").first()
    assert overall["n"] == 240 and overall["mdape"] < 0.6
    assert spark.read.parquet(f"{out}/drift").count() == result.drift.count() > 0
    gains = model.feature_importance(result.artifact.fallback, sales.sales.withColumn("h3_price_lag", F.lit(1.0)))
    assert gains.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    health = monitor_model(
        result.predictions.where("month(sale_date) % 2 = 0"), result.predictions.where("month(sale_date) % 2 = 1"), datetime(2025, 9, 1), datetime(2025, 8, 1),
        features=["gross_square_feet", "year_built"],
    )
    assert health.decision.first()["decision"] == "retrain" and health.summary.first()["rows"] == 2
    assert health.decision.first()["model_age_days"] == 31


def test_training_rejects_bad_config(sales):
    with pytest.raises(ValueError):
        train_model(sales.sales, TrainConfig("forest"))
    with pytest.raises(ValueError):
        train_model(sales.sales, TrainConfig(router_mode="by_moon"))
    with pytest.raises(ValueError, match="at least 50"):
        train_model(sales.sales.limit(10))


def test_tuning_skips_small_data(sales):
    assert model.tune(sales.sales, 0) == {}
    assert model.tune(sales.sales.limit(60), 2) == {}


def test_permutation_moves_values_only(spark):
    df = spark.range(500).select(F.col("id").alias("row_order"), (F.col("id") * 2).alias("x"))
    moved = model.permuted(df, "x", "row_order", 1, 4)
    assert {r["x"] for r in moved.collect()} == {2 * i for i in range(500)}
    assert moved.where("x = row_order * 2").count() < 5


def test_champion_proposal(rows):
    tags = {t: "x" for t in arena.REQUIRED_TAGS}
    runs = rows([(r, n, "FINISHED", "train", i, "v", 0) for i, (r, n) in enumerate((("champ", "a"), ("good", "b"), ("trial", "smoke")))],
                "run_id string, run_name string, status string, run_kind string, started_at int, model_version string, drift_alerts int")
    runs = runs.withColumns({t: F.lit(v) for t, v in tags.items()})
    metrics = rows(
        [(r, k, g, 50, p, m) for r, p, m in (("champ", 0.3, 0.2), ("good", 0.4, 0.1), ("trial", 0.9, 0.01)) for k, g in (("overall", "all"), ("segment", "A"))],
        "run_id string, group_type string, group_name string, n bigint, ppe10 double, mdape double",
    )
    got = propose_champion(metrics, runs, "champ", {"major_segment_min_n": 10}).collect()
    assert [(r["run_id"], r["is_winner"]) for r in got] == [("good", True)]


def test_model_queries_run_with_the_operators_own_settings(monkeypatch):
    """No query narrows trees, tuning space or features."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from oracle import models

    calls = {}

    def fake(name, result):
        def run(*args, **kwargs):
            calls.setdefault(name, []).append((args, kwargs))
            return result

        monkeypatch.setattr(models.model, name, run)

    monkeypatch.setattr(models, "_parts", lambda spark, d: (MagicMock(), MagicMock()))
    for name in ("fit_proxy_bins", "assign_proxy_tiers", "evaluate_predictions", "V", "F", "Window"):
        monkeypatch.setattr(models, name, MagicMock())
    monkeypatch.setattr(models, "train_model", lambda df, config: calls.setdefault("config", config) and MagicMock())
    for name, result in (
        ("fit_price_model", MagicMock()),
        ("fit_routed_models", (MagicMock(), {})),
        ("score", MagicMock()),
        ("tune", {}),
        ("feature_importance", MagicMock()),
        ("permutation_importance", MagicMock()),
    ):
        fake(name, result)
    for query in (models.m2, models.m4, models.m5, models.m6, models.m7, models.m7_permutation):
        query(SimpleNamespace(createDataFrame=lambda *a: None), "")
    assert len(calls["fit_price_model"]) == 3 and all(len(a) == 1 and not k for a, k in calls["fit_price_model"])
    assert not calls["fit_routed_models"][0][1].get("params")
    assert calls["config"].params is None
    assert "space" not in calls["tune"][0][1]
    assert calls["permutation_importance"][0][0][2] == model.FEATURES
