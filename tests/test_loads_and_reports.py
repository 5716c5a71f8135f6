"""Keyed loads, reports of failed runs, content fingerprints and numbers in file order."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from valuary.operators.contracts import ContractError
from valuary.operators.drift import drift_by_segment_time
from valuary.operators.journal import RunJournal
from valuary.plans.etl import EtlError, run_etl
from valuary.sources import readers, sinks
from tests.test_sources_plans_model import feed  # noqa: F401


@pytest.fixture
def sales(rows):
    return rows(
        [(2020 + i % 3, 1000 + i, float(100 + i), f"p{i}") for i in range(30)],
        "sale_year int, bbl long, sale_price double, property_id string",
    )


def keyed(spark, path):
    return sorted((r["run_id"], r["bbl"], r["sale_price"]) for r in sinks.read_runs(spark, path).collect())


def test_a_repeated_load_replaces_its_run_only(spark, sales, tmp_path):
    path = str(tmp_path / "sales")
    assert sinks.read_runs(spark, path).count() == 0 and sinks.finished_runs(spark, path).count() == 0
    assert sinks.load_run(sales, path, "a") == 30
    once = keyed(spark, path)
    assert sinks.load_run(sales, path, "a") == 30
    assert keyed(spark, path) == once
    sinks.load_run(sales.where("sale_year = 2020"), path, "b")
    # The run comes back without one of its years: none of that year's old rows may stay.
    assert sinks.load_run(sales.where("sale_year <> 2021"), path, "a") == 20
    got = keyed(spark, path)
    assert [r for r in got if r[0] == "a"] == [r for r in once if (r[1] - 1000) % 3 != 1] and len(got) == 30
    assert {r["run_id"]: r["rows"] for r in sinks.finished_runs(spark, path).collect()} == {"a": 20, "b": 10}
    with pytest.raises(ValueError):
        sinks.load_run(sales, path, "a/b")


def test_a_run_that_broke_off_is_not_seen(spark, sales, tmp_path, monkeypatch):
    path = str(tmp_path / "sales")
    sinks.load_run(sales, path, "a")
    bad = sales.withColumn("sale_price", F.when(F.col("bbl") == 1029, F.raise_error(F.lit("lost"))).otherwise(F.col("sale_price")))
    with pytest.raises(Exception, match="lost"):
        sinks.load_run(bad, path, "b")
    # Rows that stand there without a manifest entry: an earlier crash between the two writes.
    sales.withColumn("x", F.lit(1)).write.mode("overwrite").partitionBy("sale_year").parquet(f"{path}/run_id=c")
    assert {r["run_id"] for r in sinks.read_runs(spark, path).select("run_id").distinct().collect()} == {"a"}
    plan = sinks.read_runs(spark, path).where("sale_year = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_year" in plan


def test_a_failed_run_leaves_its_report(spark, feed, tmp_path):  # noqa: F811
    path = str(tmp_path / "report")
    with pytest.raises(EtlError, match="freshness") as broken:
        run_etl(feed, date(2029, 1, 1), output=str(tmp_path / "out"), report=path)
    stages = {r["stage"]: r["rows"] for r in broken.value.stages.collect()}
    assert stages["extract_raw"] == 1200 and set(stages) == {"extract_raw", "cleaned"}
    assert [r["check"] for r in broken.value.violations.collect()] == ["freshness"]
    assert {r["stage"]: r["rows"] for r in spark.read.json(f"{path}/stages").collect()} == stages
    assert [r["check"] for r in spark.read.json(f"{path}/violations").collect()] == ["freshness"]
    assert spark.read.json(f"{path}/run").first()["status"] == "failed" and not (tmp_path / "out").exists()


def test_a_keyed_run_notes_what_the_table_holds(spark, feed, tmp_path):  # noqa: F811
    out, path = str(tmp_path / "out"), str(tmp_path / "report")
    for _ in range(2):
        result = run_etl(feed, date(2025, 9, 1), output=out, min_segment_rows=50, run_id="day-1", report=path)
    stages = {r["stage"]: r for r in result.stages.collect()}
    assert list(stages) == ["extract_raw", "cleaned", "feature_engineered", "loaded"]
    assert stages["loaded"]["rows"] == stages["feature_engineered"]["rows"] == sinks.read_runs(spark, out).count()
    assert stages["loaded"]["unique_properties"] == stages["feature_engineered"]["unique_properties"] > 0
    assert spark.read.json(f"{path}/run").first()["status"] == "succeeded"


def test_the_journal_observes_without_a_count_of_its_own(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("journal", "")
    journal = RunJournal(spark)
    df = spark.range(50).select("id", F.lit("2020-01-05").alias("sale_date"))
    journal.write("kept", journal.observe("read", df).where("id < 20"))
    assert len(tracker.getJobIdsForGroup("journal")) == 2  # the write, and the schema of the written table
    spark.sparkContext.setJobGroup("", "")
    assert [tuple(r) for r in journal.stage_table().collect()] == [
        (0, "read", 50, None, date(2020, 1, 5)), (1, "kept", 20, None, date(2020, 1, 5)),
    ]
    with pytest.raises(ContractError, match="too few"):
        journal.check(df, spark.createDataFrame([("size", "too few", 3)], "check string, message string, failed_rows long"))
    assert journal.violation_table().collect()[0]["check"] == "size"


def fingerprint(df):
    return readers.lineage(df, "x", "y").first()["content_fingerprint"]


def test_content_fingerprint_is_a_multiset_hash(rows):
    data = [(i, "a" if i % 2 else None, float(i)) for i in range(200)]
    schema = "k long, s string, v double"
    one = fingerprint(rows(data, schema))
    assert len(one) == 32 and one == fingerprint(rows(data[::-1], schema).repartition(7).select("v", "s", "k"))
    assert one != fingerprint(rows([*data[:-1], (199, "a", 198.0)], schema))
    assert one != fingerprint(rows([*data[:-1], data[0]], schema)) != fingerprint(rows([*data[:-1], data[1]], schema))
    assert fingerprint(rows([(1, None, None)], schema)) != fingerprint(rows([(1, "", None)], schema))
    assert fingerprint(rows([], schema)) == "0" * 32


def test_rows_are_numbered_by_file_name(spark, tmp_path):
    lines = iter(range(10_000))
    for i, size in enumerate((5, 3000, 1, 700, 0, 40)):
        body = "".join(f"{next(lines)},x\n" for _ in range(size))
        (tmp_path / f"f{i}.csv").write_text("n,t\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = readers.read_csv(spark, str(tmp_path), file_order=True)
        assert got.rdd.getNumPartitions() > 2
        assert got.where("row_order <> cast(n as bigint)").count() == 0 and got.count() == 3746
        assert got.columns == ["n", "t", "row_order"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_drift_minima_are_parameters(rows):
    train = rows([("A", float(i), date(2020, 1, 1)) for i in range(30)] + [("B", float(i), date(2020, 1, 1)) for i in range(90)],
                 "property_segment string, v double, sale_date date")
    test = train.withColumn("sale_date", F.lit(date(2021, 1, 1)))
    scope = lambda **k: {r["segment"]: (r["baseline_scope"], r["psi"] is None) for r in drift_by_segment_time(train, test, ["v"], **k).collect()}
    assert scope() == {"A": ("global_fallback", False), "B": ("segment", False)}
    assert scope(min_reference=10) == {"A": ("segment", False), "B": ("segment", False)}
    assert scope(min_reference=10, min_sample=60) == {"A": ("segment", True), "B": ("segment", False)}
