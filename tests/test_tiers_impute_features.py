"""Tiers, proxy thresholds, imputation levels, regimes and the time split."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from valuary.functions.calendar import period_label, rate_regime
from valuary.operators import features, impute, tiers


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 11])
@pytest.mark.parametrize("ties", [False, True])
def test_price_tiers_follow_ranked_quartiles(spark, n, ties):
    prices = [100.0 if ties else 100.0 * (i * 7 % n) for i in range(n)]
    df = spark.createDataFrame([(i, "S", p) for i, p in enumerate(prices)], "row_order bigint, property_segment string, sale_price double")
    got = [r["price_tier"] for r in tiers.assign_price_tiers(df).orderBy("row_order").collect()]
    rank = pd.Series(prices).rank(method="first")
    share = (rank - 1) / max(n - 1, 1)
    want = pd.cut(share, [-0.001, 0.25, 0.5, 0.75, 1.0], labels=list(tiers.TIERS)).astype(str).tolist()
    assert got == want


def test_null_price_has_no_tier(rows):
    df = rows([(1, "S", None), (2, "S", 5.0)], "row_order bigint, property_segment string, sale_price double")
    got = {r["row_order"]: r["price_tier"] for r in tiers.assign_price_tiers(df).collect()}
    assert got == {1: None, 2: "entry"}


PROXY = "property_segment string, gross_square_feet double, building_age double, distance_to_center_km double, total_units double, residential_units double, borough int, sale_price double"


def test_proxy_tiers_ignore_the_target_and_fall_back(rows):
    base = [("SINGLE_FAMILY", 900.0 + 200 * i, 80.0 - 8 * i, 9.0 - i, 1.0, 1.0, 3, 1e5 * i) for i in range(6)]
    base += [("TINY", 950.0, 40.0, 7.2, 1.0, 1.0, 4, 9e9), (None, None, 1.0, 1.0, None, None, 1, 1.0)]
    df = rows(base, PROXY)
    bins = tiers.fit_proxy_bins(df, min_segment_rows=3)
    assert {r["scope"] for r in bins.collect()} == {"SINGLE_FAMILY", tiers.GLOBAL_SCOPE}
    one = tiers.assign_proxy_tiers(df, bins).drop("sale_price")
    two = tiers.assign_proxy_tiers(df.withColumn("sale_price", F.lit(1.0)), bins).drop("sale_price")
    assert one.exceptAll(two).count() == 0
    source = {r["property_segment"]: (r["price_tier_proxy_source"], r["price_tier_proxy"]) for r in one.collect()}
    assert source["TINY"][0] == "global_fallback"
    assert source["SINGLE_FAMILY"][0] == "segment:SINGLE_FAMILY"
    assert source[None] == ("default_core_missing_score", "core")


def test_bins_without_any_score_are_zero(rows):
    bins = tiers.fit_proxy_bins(rows([("S", None)], "property_segment string, gross_square_feet double")).collect()
    assert [tuple(b) for b in bins] == [(tiers.GLOBAL_SCOPE, 0.0, 0.0, 0.0, 0)]


def test_imputation_levels(rows):
    data = [
        (1, "N1", 1, "R4", 1000.0, 1980),
        (2, "N1", 1, "R4", None, 0),
        (3, "N2", 1, "R4", 0.0, 1980),
        (4, "N3", 2, "R4", None, 1980),
        (5, "N4", 3, "X9", None, None),
        (6, None, None, "R4", None, 1980),
    ]
    df = rows(data, "id int, neighborhood string, borough int, building_class string, gross_square_feet double, year_built int")
    got = {r["id"]: r for r in impute.impute_missing_values(df).collect()}
    assert [got[i]["sqft_imputation_level"] for i in range(1, 7)] == [
        None, "neighborhood_class", "borough_class", "class_only", "citywide", "class_only",
    ]
    assert all(r["gross_square_feet"] == 1000.0 for r in got.values())
    assert got[2]["year_built"] == 1980 and got[2]["year_built_imputed"] and not got[1]["sqft_imputed"]
    assert got[5]["year_built"] == 1980


def test_imputation_without_any_known_value(rows):
    df = rows([("N", 1, "C", None, 0)], "neighborhood string, borough int, building_class string, gross_square_feet double, year_built int")
    row = impute.impute_missing_values(df).first()
    assert (row["gross_square_feet"], row["year_built"]) == (1200.0, 1960)


@pytest.mark.parametrize(
    "day,label",
    [
        (date(2019, 12, 31), "pre_2020"),
        (date(2021, 7, 15), "pandemic_low_rate"),
        (date(2022, 1, 1), "post_hike_transition"),
        (date(2024, 1, 1), "high_rate_2024_plus"),
        (None, "high_rate_2024_plus"),
    ],
)
def test_rate_regimes(rows, day, label):
    assert rows([(day,)], "d date").select(rate_regime(F.col("d"))).first()[0] == label


def test_null_date_features(rows):
    row = features.add_temporal_features(rows([(None,)], "sale_date date")).first()
    assert (row["days_since_2019_start"], row["month_sin"], row["month_cos"]) == (None, 0.0, 1.0)


def test_periods(rows):
    df = rows([(date(2024, 5, 9),)], "d date")
    assert [df.select(period_label(F.col("d"), f)).first()[0] for f in "QMY"] == ["2024Q2", "2024-05", "2024"]


def test_ages_and_cells(rows):
    df = rows([(40.7, -73.9, y, 5e5, s) for y, s in ((2030, 0.0), (0, 1000.0), (1990, None))], "latitude double, longitude double, year_built int, sale_price double, gross_square_feet double")
    got = features.add_location_features(df).collect()
    assert [r["building_age"] for r in got] == [0, 100, 35]
    assert [r["price_per_sqft"] for r in got] == [None, 500.0, None]
    assert {r["h3_index"] for r in got} == {"4070:-7390"}


@pytest.mark.parametrize("n,hot", [(10, 0), (57, 1), (200, 1)])
def test_time_split_takes_the_first_rows(spark, n, hot):
    rng = np.random.default_rng(n)
    days = np.where(rng.random(n) < 0.34 * hot, 18000, rng.integers(17900, 18100, n))
    frame = pd.DataFrame({"row_order": rng.permutation(n), "day": days})
    df = spark.createDataFrame(frame).withColumn("sale_date", F.date_from_unix_date(F.col("day").cast("int")))
    train, test = features.time_split(df, 0.2)
    want = frame.sort_values(["day", "row_order"]).head(int(n * (1 - 0.2)))
    assert {r["row_order"] for r in train.collect()} == set(want["row_order"])
    assert test.count() == n - len(want)


def test_time_split_rejects_bad_sizes(spark):
    with pytest.raises(ValueError):
        features.time_split(spark.range(3), 0.7)


def test_cell_price_lag_comes_from_train(rows):
    train = rows([("a", 100.0), ("a", 300.0), ("b", 900.0)], "h3_index string, sale_price double")
    test = rows([("a", 1.0), ("new", 1.0), (None, 1.0)], "h3_index string, sale_price double")
    _, out = features.add_cell_price_lag(train, test)
    assert {r["h3_index"]: r["h3_price_lag"] for r in out.collect()} == {"a": 200.0, "new": 300.0, None: 300.0}


def test_feature_contract(rows):
    with pytest.raises(ValueError, match="target-derived"):
        features.check_feature_columns(["price_tier"])
    with pytest.raises(ValueError, match="inference"):
        features.check_feature_columns(["shoe_size"])
    df = rows([(1.0, None)], "year_built double, total_units double")
    with pytest.raises(ValueError, match="all-null"):
        features.check_training_contract(df, df, ["year_built", "total_units"])
    with pytest.raises(ValueError, match="missing"):
        features.check_training_contract(df, df.drop("year_built"), ["year_built"])
