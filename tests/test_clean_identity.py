"""Cleaning rules, unit tokens, duplicates and resale history on small frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from valuary.functions.property import unit_from_address, unit_token
from valuary.operators.clean import clean_sales, coerce_numbers, conform, to_canonical
from valuary.operators.identity import add_property_id, add_sales_history, deduplicate_sales, duplicate_metrics
from valuary.operators.skew import hot_keys
from valuary.schemas import SALES_SCHEMA

RAW = "`SALE PRICE` string, `Building Class Category` string, latitude double, longitude double, bbl string, `sale date` string, `year built` double"


def test_clean_keeps_only_the_valid_row(rows):
    good = ("500,000", "01 ONE FAMILY", 40.7, -73.9, "1000010001", "2024-05-01", None)
    bad = [
        ("100", *good[1:]),
        (good[0], "31 COMMERCIAL", *good[2:]),
        (*good[:2], None, *good[3:]),
        (*good[:4], "x", *good[5:]),
        (*good[:4], "0", *good[5:]),
        ("n/a", *good[1:]),
    ]
    out = clean_sales(rows([good, *bad], RAW)).collect()
    assert len(out) == 1
    row = out[0]
    assert (row["sale_price"], row["bbl"], row["sale_year"], row["sale_quarter"], row["year_built"]) == (500000.0, 1000010001, 2024, 2, 0)
    assert row["sale_date"] == date(2024, 5, 1)


def test_bad_date_is_an_error_in_clean_and_null_in_canonical(rows):
    row = ("500000", "01 ONE FAMILY", 40.7, -73.9, "1000010001", "someday", 1990.0)
    with pytest.raises(Exception, match="unparseable date"):
        clean_sales(rows([row], RAW)).collect()
    out = to_canonical(rows([("someday", "5,000")], "close_date string, close_price string"), {"rename": {"close_date": "sale_date", "close_price": "sale_price"}})
    got = out.first()
    assert got["sale_date"] is None and got["sale_price"] is None and got["year_built"] == 0 and "neighborhood" in out.columns


@pytest.mark.parametrize(
    "text,value", [("1,234.5", 1234.5), (" 7 ", 7.0), ("1e3", 1000.0), ("12d", None), ("", None), ("NA", None), ("--", None), ("-4", -4.0)]
)
def test_number_texts(rows, text, value):
    assert coerce_numbers(rows([(text,)], "sale_price string")).first()[0] == value


@pytest.mark.parametrize(
    "text,loose,strict",
    [
        ("apt 1a", "1A", "1A"),
        ("# 3-B", "3-B", "3-B"),
        ("UNIT PH", "PH", "PH"),
        ("A", "A", None),
        ("STREET", None, None),
        ("none", None, None),
        ("  ", None, None),
        (None, None, None),
    ],
)
def test_unit_tokens(rows, text, loose, strict):
    c = F.col("u")
    got = rows([(text,)], "u string").select(unit_token(c, False), unit_token(c, True)).first()
    assert tuple(got) == (loose, strict)


@pytest.mark.parametrize(
    "address,unit",
    [
        ("430 OCEAN PARKWAY, 1A", "1A"),
        ("100 MAIN STREET, STREET", None),
        ("12 ELM APT 4C", "4C"),
        ("12 ELM #9", "9"),
        ("12 ELM AVENUE", None),
        ("7 OAK, REAR UNIT 2", "REARUNIT2"),
        (None, None),
    ],
)
def test_units_in_addresses(rows, address, unit):
    assert rows([(address,)], "a string").select(unit_from_address(F.col("a"))).first()[0] == unit


SALES = "row_order bigint, bbl bigint, apartment_number string, address string, sale_date date, sale_price double"


def test_ids_and_duplicates(rows):
    d = date(2024, 1, 1)
    df = add_property_id(
        rows(
            [
                (1, 1000010001, "1A", "1 A ST", d, 5e5),
                (2, 1000010001, "APT 1A", "1 A ST", d, 5e5),
                (3, 1000010001, "1A", "1 A STREET", d, 6e5),
                (4, 1000010001, "2B", None, d, 5e5),
                (5, 1000010001, None, None, d, 5e5),
            ],
            SALES,
        )
    )
    kept = {r["row_order"]: r["property_id"] for r in deduplicate_sales(df).collect()}
    assert kept == {1: "1000010001_1A", 3: "1000010001_1A", 4: "1000010001_2B", 5: "1000010001"}
    assert tuple(duplicate_metrics(df).first()) == (1, 0)


def test_history_marks_sequence_and_change(rows):
    df = add_property_id(
        rows([(1, 7, None, None, date(2020, 1, 1), 1e5), (2, 7, None, None, date(2022, 1, 1), 1.5e5)], SALES)
    )
    first, second = add_sales_history(df).orderBy("sale_date").collect()
    assert (first["sale_sequence"], first["is_latest_sale"], first["previous_sale_price"]) == (1, False, None)
    assert (second["sale_sequence"], second["is_latest_sale"], second["price_change_pct"]) == (2, True, 50.0)
    assert (second["days_since_last_sale"], second["previous_sale_date"]) == (731, date(2020, 1, 1))


def test_history_of_a_property_with_a_third_of_all_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_order"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 400)).alias("property_id"),
        F.expr("date_add(date'2020-01-01', cast(id * 7919 % 40 as int))").alias("sale_date"),
        (F.lit(10000.0) + F.col("id") * 31 % 90001).alias("sale_price"),
    )
    df = deduplicate_sales(df)
    hot = hot_keys(df, ["property_id"], share=0.1, min_rows=0)
    assert [r[0] for r in hot.collect()] == ["hot"]
    split = add_sales_history(df, "row_order", hot_share=0.1, hot_min_rows=0)
    plain = add_sales_history(df, "row_order", hot_share=2.0)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_hot_keys_are_bounded_by_the_share(spark):
    df = spark.range(10000).select((F.col("id") % 100).alias("k"))
    assert hot_keys(df, ["k"], share=0.005, min_rows=0).count() == 100
    assert hot_keys(df, ["k"], share=0.02, min_rows=0).count() == 0


def test_conform_keeps_schema_columns_and_drops_nan(rows):
    out = conform(rows([(1.6, float("nan"), "x")], "sale_price double, latitude double, other string"), SALES_SCHEMA)
    assert out.schema == SALES_SCHEMA
    assert (out.first()["sale_price"], out.first()["latitude"], out.first()["bbl"]) == (1, None, None)
