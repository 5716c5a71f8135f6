"""Catalogue rules, search, clusters and valuations on small frames."""

import pytest
from pyspark.sql import functions as F

from valuary.operators import catalog, valuation

RAW = "row_order int, property_id string, address string, borough string, zip_code string, property_segment string, latitude string, longitude string, gross_square_feet string, year_built string, total_units string, building_class string, sale_date string, bbl string"


@pytest.fixture
def catalogue(rows):
    data = [
        (1, "p1", " 1 Main St ", "1", "10001-22", "single family", "40.70", "-73.90", "900", "1950", "2", "A1", "2024-01-01", "5"),
        (2, "p1", "other", "1", None, None, "40.7", "-73.9", None, None, None, None, None, None),
        (3, None, "2 Oak Ave", "staten  island", "12", "walkup", "40.71", "-73.91", "0", "1700", "0", None, None, "77"),
        (4, "p4", "3 Elm", "3", "11201", "elevator", "99", "-73.9", "1", "2000", "1", "B", "2024-01-01", "1"),
        (5, "p5", "", "3", "11201", "elevator", "40.7", "-73.9", "1", "2000", "1", "B", "2024-01-01", "1"),
        (6, "p6", "9 Main Rd", None, "11201", "", "40.2", "-73.2", "700", "2000", "1.5", "B", "2024-01-01", "1"),
    ]
    return catalog.build_catalogue(rows(data, RAW))


def test_records(catalogue):
    got = {r["property_id"]: r for r in catalogue.collect()}
    assert set(got) == {"p1", "77:2 OAK AVE:na", "p6"}
    p1, oak, p6 = got["p1"], got["77:2 OAK AVE:na"], got["p6"]
    assert (p1["address"], p1["borough"], p1["zip_code"], p1["property_segment"]) == ("1 Main St", "MANHATTAN", "10001", "SINGLE_FAMILY")
    assert (p1["feature_completeness"], p1["data_quality_status"], p1["inference_ready"]) == (1.0, "ready", True)
    assert (oak["borough"], oak["zip_code"], oak["year_built"], oak["data_quality_status"]) == ("STATEN_ISLAND", None, None, "sparse")
    assert oak["missing_required_features"] == ["gross_square_feet", "year_built", "total_units", "building_class"]
    assert (p6["borough"], p6["property_segment"], p6["total_units"], p6["data_quality_status"]) == ("UNKNOWN", "UNKNOWN", None, "partial")


def test_search_and_box(catalogue):
    found = catalog.search_properties(catalogue, "MAIN")
    assert [r["property_id"] for r in catalog.first_page(found, 1).collect()] == ["p1"]
    assert tuple(catalog.search_totals(catalogue, found).first()) == (2, 3)
    assert catalog.search_properties(catalogue, "", borough="manhattan", segment="single_family", zip_code="10001").count() == 1
    assert catalog.nearby_properties(catalogue, -74, 40.6, -73.8, 40.8).count() == 2
    assert catalog.property_detail(catalogue, "p6").count() == 1


def test_clusters(catalogue):
    apart = catalog.map_clusters(catalogue, 12).collect()
    assert {r["key"] for r in apart} == {"p1", "77:2 OAK AVE:na", "p6"} and {r["count"] for r in apart} == {1}
    wide = {r["type"]: r for r in catalog.map_clusters(catalogue, 8).collect()}
    assert wide["property"]["key"] == "p6"
    assert (wide["cluster"]["count"], wide["cluster"]["lat"]) == (2, pytest.approx(40.705))


def test_options(catalogue):
    assert [tuple(r) for r in catalog.filter_options(catalogue, ["borough"]).collect()] == [
        ("borough", "MANHATTAN"), ("borough", "STATEN_ISLAND"), ("borough", "UNKNOWN"),
    ]


def test_history_by_parcel(rows):
    sales = rows([(1, 5.0, "2024-01-01"), (1, 6.0, "2024-02-01"), (2, 7.0, "2024-01-01")], "bbl int, sale_price double, sale_date string")
    got = catalog.price_history(sales, rows([(1,), (None,)], "bbl int")).collect()
    assert [r["sale_price"] for r in got] == [6.0, 5.0]


def test_status_and_range(rows):
    df = rows([(111.0, 100.0, "A"), (89.0, 100.0, "B"), (105.0, 100.0, "A"), (1.0, 0.0, "A")], "sale_price double, predicted_price double, property_segment string")
    assert [r["valuation_status"] for r in valuation.add_valuation_status(df).collect()] == [
        "over_valued", "under_valued", "near_fair_value", "near_fair_value",
    ]
    metrics = rows([("overall", "all", 0.2), ("segment", "A", 1.5)], "group_type string, group_name string, mdape double")
    got = {r["property_segment"]: r for r in valuation.add_value_range(valuation.add_segment_metrics(df, metrics)).collect()}
    assert (got["A"]["mdape_source"], got["A"]["confidence_score"]) == ("segment", 0.0)
    assert (got["B"]["mdape_source"], got["B"]["low_value_bound"], got["B"]["high_value_bound"]) == ("overall", 80.0, 120.0)


def test_rule_valuation_and_drivers(rows):
    df = rows([("Staten Island", 1000.0, 1925, 10), ("nowhere", 500.0, 2030, 1)], "borough string, gross_square_feet double, year_built int, total_units int")
    got = valuation.top_drivers(valuation.add_value_drivers(valuation.rule_based_valuation(df, 2025), 2025), 2).collect()
    assert got[0]["predicted_price"] == round(1000 * 500 * (1 - 100 * 0.0012) * 0.94)
    assert (got[0]["interval_low"], got[0]["interval_high"]) == (376376, 450824)
    assert [d["feature"] for d in got[0]["drivers_negative"]] == ["building_age", "total_units"]
    assert [d["feature"] for d in got[0]["top_drivers"]] == ["gross_square_feet", "building_age"]
    assert got[1]["predicted_price"] == 310000 and got[1]["drivers_negative"] == []


def test_confidence(rows):
    got = valuation.add_confidence(rows([(0.6,), (None,), (0.05,)], "segment_ppe10 double")).collect()
    assert [r["confidence_band"] for r in got] == ["high", "medium", "low"]
    assert got[0]["segment_calibration"] == 0.95


def test_label(rows):
    df = rows([("1 A", None, None)], "address string, apartment_number string, sale_date date")
    assert df.select(catalog.display_label(df)).first()[0] == "1 A  | unknown_date"
    assert df.withColumn("property_id", F.lit("x")).drop("sale_date").select(catalog.display_label(df.withColumn("property_id", F.lit("x")).drop("sale_date"))).first()[0] == "x"
