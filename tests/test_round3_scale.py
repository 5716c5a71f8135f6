"""What rows and tables travel in the steps of the sales queries: each is settled once, plain rows stay where they are."""

import os
from datetime import date

from pyspark.sql import functions as F

from oracle import catalogue as catalogue_queries
from oracle import sales as sales_queries
from oracle import views as V
from valuary.functions.property import unit_token
from valuary.operators import catalog, identity
from valuary.sources import readers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coordinates_by_hash_and_only_for_rows_that_lack_them(rows):
    schema = "id int, bbl long, latitude double, longitude double"
    df = rows([(1, 7, 40.0, -73.0), (2, 7, None, None), (3, 8, None, -70.0), (4, None, None, 1.0), (5, 9, 41.0, None), (6, 6, None, 2.0)], schema)
    side = rows(
        [(7, 40.6, -73.5), (7, 40.5, -73.1), (7, 40.5, -73.2), (8, 40.5, None), (8, 40.5, -9.0), (9, 42.0, -71.0), (None, 1.0, 1.0)],
        "bbl long, latitude double, longitude double",
    )
    out = readers.attach_coordinates(df, side)
    assert out.columns == ["bbl", "id", "latitude", "longitude"]
    assert {r["id"]: (r["latitude"], r["longitude"]) for r in out.collect()} == {
        1: (40.0, -73.0), 2: (40.5, -73.2), 3: (40.5, -70.0), 4: (None, 1.0), 5: (41.0, -71.0), 6: (None, 2.0)
    }
    assert "Union" in _optimized(out) and "SortAggregate" not in _plan(out)


SALES = [
    # property, day, price, row_order: two copies, a resale, equal days
    ("1", date(2020, 1, 1), 50000.0, 3),
    ("1", date(2020, 1, 1), 50000.0, 1),
    ("1", date(2021, 1, 1), 60000.0, 2),
    ("1", date(2021, 1, 1), 55000.0, 9),
    ("2_A", date(2019, 5, 5), 20000.0, 4),
]


def test_resale_history_shuffles_rows_once(rows):
    df = rows(SALES, "property_id string, sale_date date, sale_price double, row_order long").withColumn("bbl", F.substring("property_id", 1, 1).cast("long"))
    got = identity.resale_history(df)
    assert _plan(got).count("Exchange hashpartitioning(property_id") == 1
    assert "sale_date" not in "".join(x for x in _plan(got).splitlines() if "Exchange" in x)
    plain = identity.add_sales_history(identity.deduplicate_sales(df), order="row_order")
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 4


def test_resale_history_of_outsized_parcels(rows, monkeypatch):
    monkeypatch.setattr(identity, "hot_keys", lambda df, keys, *_: df.groupBy(*keys).count().where("count > 2").select(*keys))
    df = rows(SALES, "property_id string, sale_date date, sale_price double, row_order long").withColumn("bbl", F.substring("property_id", 1, 1).cast("long"))
    got = {(r["property_id"], r["row_order"]): (r["sale_sequence"], r["is_latest_sale"]) for r in identity.resale_history(df).collect()}
    assert got == {("1", 1): (1, False), ("1", 9): (2, True), ("1", 2): (3, True), ("2_A", 4): (1, True)}


def test_a_unit_is_worked_out_once(rows):
    df = rows([(" apt  3b ",), ("STREET",), ("nan",), ("APT",), ("#PH-2!",), ("Unit St",), ("NANA",), ("x y",), (None,)], "u string")
    out = df.select("u", unit_token(F.col("u"), False).alias("t"), unit_token(F.col("u"), True).alias("s"))
    got = {r["u"]: (r["t"], r["s"]) for r in out.collect()}
    assert got == {
        " apt  3b ": ("3B", "3B"), "STREET": (None, None), "nan": (None, None), "APT": (None, None), "#PH-2!": ("PH-2", "PH-2"),
        "Unit St": (None, None), "NANA": ("NANA", None), "x y": ("XY", None), None: (None, None),
    }
    assert _optimized(df.select(F.coalesce(F.lit(None), unit_token(F.col("u"), False)).alias("t"))).count("upper(") == 1


def test_loads_share_one_identified_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sales_queries.sinks, "load_run", lambda df, *_: seen.append(_optimized(df)))
    monkeypatch.setattr(sales_queries.sinks, "finished_runs", lambda s, _: s.createDataFrame([("first", 1)], "run_id string, rows long"))
    feed = spark.createDataFrame([(1, 10000.0)], "bbl long, sale_price double").withColumn("property_id", F.upper(F.lit("x")))
    monkeypatch.setattr(V, "identified", lambda *_: feed.withColumn("property_id", F.regexp_replace(F.col("bbl").cast("string"), "1", "2")))
    sales_queries.s8_runs(spark, "")
    assert len(seen) == 3 and not any("regexp_replace" in p for p in seen)


RAW = "row_order long, property_id string, bbl string, address string, sale_date string, latitude string, longitude string, borough string"


def test_catalogue_normalises_only_rows_that_stay(rows):
    df = rows(
        [
            (1, " a ", "1", " ", "d", "40", "-73", "1"),
            (2, " a ", "1", "x st", "d", "400", "-73", "2"),
            (3, "a", "1", "y st", "d", "40", "-73", " staten  island "),
            (4, "a ", "1", "z st", "d", "40", "-73", "4"),
            (5, None, "1", "q st", "d", "40", "-73", "5"),
        ],
        RAW,
    )
    out = catalog.build_catalogue(df)
    assert {(r["property_id"], r["row_order"], r["borough"]) for r in out.collect()} == {("a", 3, "STATEN_ISLAND"), ("1:Q ST:d", 5, "STATEN_ISLAND")}
    plan = _optimized(out)
    # The blanks inside keys are replaced above the window, so for the rows that stay.
    assert plan.index("\\s+") < plan.index("Window")


def test_search_totals_build_the_catalogue_once(spark, monkeypatch):
    plans = []
    totals = catalog.search_totals
    monkeypatch.setattr(catalogue_queries.catalog, "search_totals", lambda c, f: plans.extend([_optimized(c), _optimized(f)]) or totals(c, f))
    feed = spark.createDataFrame([(i, "1", 7, f"{i} main", date(2020, 1, 1), 40.0, -73.0, "4", "01") for i in range(6)],
        "row_order long, property_id string, bbl long, address string, sale_date date, latitude double, longitude double, borough string, property_segment string")
    monkeypatch.setattr(catalogue_queries, "_untidy", lambda *_: feed.withColumn("property_id", F.col("row_order").cast("string")))
    got = catalogue_queries.p33_totals(spark, "").first().asDict()
    assert got == {"total_available": 0, "total_catalog": 6}
    assert len(plans) == 2 and not any("Window" in p for p in plans)


def test_near_duplicates_leave_no_staged_tables_behind(spark, rows):
    from valuary.llm import op4_minhash_dedup as op4
    from valuary.session import shared_dir

    text = " ".join(f"w{i}" for i in range(60))
    docs = rows([(1, text), (2, text), (3, text + " end"), (4, "something else altogether here now")], "doc_id long, text string")
    place = shared_dir(spark).removeprefix("file://")
    staged = lambda: {n for n in os.listdir(place) if n.startswith(("signatures", "buckets", "bucket-texts", "heads", "open-shingles", "near-duplicates"))}
    before = staged()
    kept = op4.keep_one(docs)
    assert staged() == before
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_parity_marks_of_many_sets(monkeypatch):
    import numpy as np

    from valuary.llm import op4_minhash_dedup as op4

    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in rng.integers(1, 6, 5000)]
    got = op4.parity_marks(sets)
    assert got.shape == (5000, op4.MARKS)
    for i in (0, 2047, 2048, 4999):
        assert (got[i] == op4.parity_marks([sets[i]])[0]).all()
