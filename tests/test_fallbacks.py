"""The ways taken when a lookup is too large to broadcast, and the remaining small helpers."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuary.operators import features, ordered, tiers
from valuary.operators.clean import load_mapping, mapping_report, to_canonical
from valuary.schemas import AUDIT_LOG_SCHEMA, MODEL_PERFORMANCE_SCHEMA
from valuary.session import broadcast_if_small, fallback_dir, lookup_join, materialise, shared_dir, spread
from valuary.sources.sinks import write_table


def test_lookup_join_gives_the_same_rows_without_broadcast(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    table = df.groupBy("k").agg(F.max("id").alias("top")).where("k < 5")
    small, large = lookup_join(df, table, ["k"]), lookup_join(df, table, ["k"], max_rows=0)
    assert small.exceptAll(large).count() == 0 and large.count() == 300
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    held = materialise(table)
    assert broadcast_if_small(held, 1) is held


@pytest.mark.parametrize("cell_rows", [500_000, 20])
def test_order_statistics_without_broadcast(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(ordered, "MAX_LOOKUP_ROWS", 0)
    values = np.random.default_rng(2).lognormal(3, 2, 900)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)], "g int, v double")
    got = {r["g"]: r["m"] for r in ordered.group_quantiles(df, ["g"], "v", {"m": 0.5}, max_cell_rows=cell_rows).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(np.median(values[g::3]), rel=1e-12)
    ks = ordered.ks_distance(df.where("g = 0").drop("g").withColumn("f", F.lit(1)), df.where("g = 1").drop("g").withColumn("f", F.lit(1)), ["f"], max_cell_rows=cell_rows)
    a, b = np.sort(values[0::3]), np.sort(values[1::3])
    both = np.concatenate([a, b])
    want = np.max(np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)))
    assert ks.first()["ks"] == pytest.approx(want, abs=1e-12)


def test_infinite_and_extreme_values(spark):
    values = [float("-inf"), -1e308, -1.0, 0.0, 5e-324, 1e308, float("inf")]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    stats = ordered.order_statistics(df, ["g"], "v", lambda n: [F.lit(i) for i in range(7)], max_cell_rows=1)
    assert [r["value"] for r in stats.orderBy("i").collect()] == values


def test_large_integers_keep_their_order(spark):
    base = 2**60
    df = spark.range(200).select(F.lit("g").alias("g"), (F.lit(base) + F.col("id")).alias("v"))
    row = ordered.order_statistics(df, ["g"], "v", lambda n: [F.lit(123)], max_cell_rows=10).first()
    assert (row["value"], row["below"], row["n"]) == (base + 123, 123, 200)


def test_tiers_of_one_price_for_a_third_of_all_rows(spark):
    df = spark.range(999).select(
        F.col("id").alias("row_order"), F.lit("S").alias("property_segment"),
        F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.col("id") * 1.0).alias("sale_price"),
    )
    got = {r["price_tier"]: r["n"] for r in tiers.assign_price_tiers(df).groupBy("price_tier").agg(F.count("*").alias("n")).collect()}
    assert got == {"entry": 250, "core": 250, "premium": 249, "luxury": 250}


def test_own_price_lag(rows):
    df = rows([("a", 1.0), ("a", 3.0), ("b", 8.0)], "h3_index string, sale_price double")
    got = [r["h3_price_lag"] for r in features.with_cell_price_lag(df).orderBy("sale_price").collect()]
    assert got == [2.0, 2.0, 8.0]
    kept = features.with_cell_price_lag(df.withColumn("h3_price_lag", F.lit(7.0)))
    assert {r["h3_price_lag"] for r in kept.collect()} == {7.0}
    assert features.with_cell_price_lag(rows([(1,)], "x int")).first()["h3_price_lag"] is None


def test_mapping_files_and_report(rows, tmp_path):
    mapping = {"rename": {"px": "sale_price"}, "defaults": {"borough": "UNK"}}
    (tmp_path / "m.json").write_text(json.dumps(mapping))
    (tmp_path / "m.yaml").write_text("rename:\n  px: sale_price\ndefaults:\n  borough: UNK\n")
    assert load_mapping(str(tmp_path / "m.json")) == load_mapping(str(tmp_path / "m.yaml")) == mapping
    raw = rows([("20,000",)], "px string")
    out = to_canonical(raw, mapping)
    assert (out.first()["sale_price"], out.first()["borough"]) == (20000.0, "UNK")
    report = mapping_report(raw, out, mapping, "m.json").first()
    assert (report["rename_count"], report["defaults_count"], report["input_columns"]) == (1, 1, 1)


def test_log_and_performance_tables(spark, rows, tmp_path):
    log = rows([(datetime(2024, 1, 1), "m", 0.5, True)], "timestamp timestamp, model string, cost_estimate double, success boolean")
    for name, schema, df in (
        ("log", AUDIT_LOG_SCHEMA, log),
        ("perf", MODEL_PERFORMANCE_SCHEMA, rows([("v1", 0.2)], "model_version string, mdape double")),
    ):
        write_table(df, str(tmp_path / name), schema)
        write_table(df, str(tmp_path / name), schema)
        stored = spark.read.parquet(str(tmp_path / name))
        assert stored.count() == 2 and stored.columns == schema.names


def test_shared_folder_and_spread(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 10, 1, 9)
    assert spread(wide) is wide


def test_a_cluster_needs_a_shared_folder():
    assert fallback_dir("local[4]").startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            fallback_dir(master)


def test_white_space_of_every_kind_is_stripped(rows):
    from valuary.functions.parse import to_number
    from valuary.functions.property import unit_token

    df = rows([("\t12\n", "\tAPT 3B"), ("\u00a0 1,200 \u3000", "APT 3B\n"), ("\u20097\x0b", " apt\u00a03B ")], "n string, u string")
    assert [r[0] for r in df.select(to_number(df.n)).collect()] == [12.0, 1200.0, 7.0]
    assert [r[0] for r in df.select(unit_token(df.u, strict=False)).collect()] == ["3B"] * 3
