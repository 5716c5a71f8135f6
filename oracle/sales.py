"""Checks of scans, cleaning, identity, history, tiers, imputation and features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from oracle import views as V
from oracle.registry import check
from valuary.operators import clean, features, identity, impute, tiers
from valuary.operators.profile import head_rows, sample_rows
from valuary.plans.etl import EtlError, run_etl
from valuary.schemas import SALES_SCHEMA
from valuary.session import scratch_path, stage_table
from valuary.sources import readers, sinks

# ---------------------------------------------------------------- scans, sources and sinks


def _landed_csv(spark, sf_dir):
    """The orders table as a CSV file in the shared folder."""
    path = scratch_path(spark, "orders-csv")
    V.table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return path


@check(
    "s1_csv_scan",
    """select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from orders
       order by o_orderkey limit 500""",
)
def s1(spark, d):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    df = readers.read_csv(spark, _landed_csv(spark, d), schema=schema, limit=500, order=["o_orderkey"])
    return df.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@check(
    "s2_yearly_union",
    """select count(*) as rows, count(latitude) as with_coordinates,
       round(count(latitude) * 100.0e0 / count(*), 4) as coverage_pct from raw_sales
       where year(sale_date) between 2020 and 2022""",
)
def s2(spark, d):
    root = scratch_path(spark, "yearly")
    raw = V.raw_sales(spark, d).select("bbl", "sale_price", "sale_date", "latitude", F.year("sale_date").alias("year"))
    raw.where("year between 2020 and 2022").write.partitionBy("year").option("header", True).csv(root)
    union = readers.read_yearly(spark, root + "/year={year}", 2020, 2022)
    cover = readers.coordinate_coverage(union)
    return cover.withColumn("coverage_pct", F.round("coverage_pct", 4))


@check(
    "s3_coordinates",
    """select bbl, round(min(latitude), 6) as latitude, round(min(longitude), 6) as longitude from raw_sales
       where latitude is not null group by bbl""",
)
def s3(spark, d):
    table = readers.coordinates_table(V.raw_sales(spark, d))
    return table.groupBy("bbl").agg(
        F.round(F.min("latitude"), 6).alias("latitude"), F.round(F.min("longitude"), 6).alias("longitude")
    )


@check(
    "s5_lineage",
    """select 'parquet' as source_id, 'orders' as detail, count(*) as row_count,
       substr(sha256(concat('parquet:orders:', cast(count(*) as varchar))), 1, 16) as source_fingerprint from orders""",
)
def s5(spark, d):
    return readers.lineage(V.table(spark, d, "orders"), "parquet", "orders").drop("extracted_at", "content_fingerprint")


@check(
    "s6_training_scan",
    """select sale_date, sale_price, h3_index, building_class, property_segment, cast(null as varchar) as price_tier_proxy
       from featured where sale_price is not null and sale_date is not null""",
)
def s6(spark, d):
    sales = V.featured(spark, d).withColumn("price_tier", F.lit(None).cast("string"))
    cols = ("sale_date", "sale_price", "h3_index", "building_class", "property_segment", "price_tier_proxy")
    return readers.training_scan(sales).select(*cols)


@check(
    "s7_latest_sales",
    """select row_order as id, bbl, sale_date, sale_price, property_segment from segmented
       order by sale_date desc, row_order limit 1000""",
)
def s7(spark, d):
    sales = V.segmented(spark, d).withColumnRenamed("row_order", "id")
    return readers.latest_sales(sales, 1000).select("id", "bbl", "sale_date", "sale_price", "property_segment")


@check(
    "s8_sales_sink",
    """select bbl, sale_year, cast(round(sale_price) as bigint) as sale_price, property_id, run_id from identified, (values ('first'), ('second')) r(run_id)""",
)
def s8(spark, d):
    path = scratch_path(spark, "sales")
    # Cleaned and identified once for the three loads.
    sales = stage_table(V.identified(spark, d).withColumn("sale_price", F.round("sale_price")), "identified")
    # The first run is loaded with wrong prices, another run comes between, then the first is loaded again.
    sinks.load_run(sales.withColumn("sale_price", F.lit(1)), path, "first")
    sinks.load_run(sales, path, "second")
    sinks.load_run(sales, path, "first")
    return sinks.read_runs(spark, path).select("bbl", "sale_year", "sale_price", "property_id", "run_id")


@check("s8_finished_runs", """select run_id, count(*) as rows from identified, (values ('first'), ('second')) r(run_id) group by all""")
def s8_runs(spark, d):
    path = scratch_path(spark, "sales")
    sales = stage_table(V.identified(spark, d), "identified")
    for run in ("first", "second", "first"):
        sinks.load_run(sales, path, run)
    return sinks.finished_runs(spark, path).select("run_id", "rows")


@check(
    "s1_file_order",
    "select o_orderkey, row_number() over (order by o_orderkey) - 1 as row_order from orders",
)
def s1_file_order(spark, d):
    """Files of very different sizes, named in the order of their keys."""
    path = scratch_path(spark, "orders-files")
    V.table(spark, d, "orders").repartitionByRange(9, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
    landed = readers.read_csv(spark, path, file_order=True)
    return landed.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "row_order")


@check(
    "s5_content_fingerprint",
    "select count(*) as row_count, true as same_when_dealt_anew, true as other_when_a_cell_changes, true as other_when_a_row_repeats from orders",
)
def s5_content(spark, d):
    orders = V.table(spark, d, "orders")
    one = orders.agg(F.max("o_orderkey")).first()[0]
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == one, "?").otherwise(F.col("o_orderstatus")))
    swapped = orders.where(F.col("o_orderkey") != one).unionByName(orders.where(F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).first()[0]))
    names = ("plain", "dealt", "changed", "swapped")
    frames = (orders, orders.select(*reversed(orders.columns)).repartition(13), changed, swapped)
    prints = {n: readers.lineage(f, "parquet", "orders").select("row_count", F.col("content_fingerprint").alias(n)) for n, f in zip(names, frames)}
    both = prints["plain"]
    for name in names[1:]:
        both = both.join(prints[name], "row_count")
    return both.select(
        "row_count",
        (F.col("plain") == F.col("dealt")).alias("same_when_dealt_anew"),
        (F.col("plain") != F.col("changed")).alias("other_when_a_cell_changes"),
        (F.col("plain") != F.col("swapped")).alias("other_when_a_row_repeats"),
    )


@check(
    "s9_report_sink",
    """select property_segment, count(*) as n, round(avg(sale_price), 4) as mean_price from segmented group by all""",
)
def s9(spark, d):
    path = scratch_path(spark, "report")
    report = V.segmented(spark, d).groupBy("property_segment").agg(
        F.count("*").alias("n"), F.round(F.avg("sale_price"), 4).alias("mean_price")
    )
    sinks.write_report(report, path, "csv")
    return spark.read.option("header", True).schema("property_segment string, n bigint, mean_price double").csv(path)


@check(
    "s14_predictions_table",
    """select bbl, round(predicted_price, 6) as predicted_price, sale_price as actual_price,
       round(abs(predicted_price - sale_price), 6) as absolute_error, 'v1' as model_version
       from predictions where predicted_price is not null""",
)
def s14(spark, d):
    from valuary.schemas import PREDICTIONS_SCHEMA

    path = scratch_path(spark, "predictions")
    rows = V.predictions(spark, d).where("predicted_price is not null").withColumns(
        {
            "actual_price": F.col("sale_price"),
            "absolute_error": F.round(F.abs(F.col("predicted_price") - F.col("sale_price")), 6),
            "predicted_price": F.round("predicted_price", 6),
            "model_version": F.lit("v1"),
        }
    )
    sinks.write_table(rows, path, PREDICTIONS_SCHEMA)
    cols = ("bbl", "predicted_price", "actual_price", "absolute_error", "model_version")
    return spark.read.schema(PREDICTIONS_SCHEMA).parquet(path).select(*cols)


# ---------------------------------------------------------------- cleaning


@check("p1_standard_names", "select sale_price, building_class, bbl as bin_number from raw_sales")
def p1(spark, d):
    raw = V.raw_sales(spark, d).select(
        F.col("sale_price").alias(" Sale Price "), F.col("building_class").alias("BUILDING CLASS AT TIME OF"), F.col("bbl").alias("BIN")
    )
    return clean.standardise_names(raw)


@check(
    "p2_numbers",
    """select row_order, case row_order % 7 when 1 then null when 2 then null when 3 then null else sale_price end as sale_price
       from raw_sales""",
)
def p2(spark, d):
    text = F.expr(
        """case row_order % 7 when 1 then ' N/A ' when 2 then 'nan' when 3 then '12 apples'
           when 4 then concat('  ', cast(sale_price as string)) else format_number(sale_price, 2) end"""
    )
    raw = V.raw_sales(spark, d).select("row_order", text.alias("sale_price"))
    return clean.coerce_numbers(raw)


@check("p3_market_sales", "select row_order, sale_price from raw_sales where sale_price >= 10000")
def p3(spark, d):
    return clean.market_sales(V.raw_sales(spark, d)).select("row_order", "sale_price")


@check(
    "p4_residential",
    "select building_class_category, count(*) as n from raw_sales where left(building_class_category, 2) not in ('31') group by all",
)
def p4(spark, d):
    return clean.residential_sales(V.raw_sales(spark, d)).groupBy("building_class_category").agg(F.count("*").alias("n"))


@check("p5_located", "select row_order, round(latitude, 6) as latitude from raw_sales where latitude is not null")
def p5(spark, d):
    return clean.located_sales(V.raw_sales(spark, d)).select("row_order", F.round("latitude", 6).alias("latitude"))


@check(
    "p6_valid_parcels",
    "select row_order, bbl from raw_sales where row_order % 5 not in (0, 1)",
)
def p6(spark, d):
    text = F.expr("case row_order % 5 when 0 then '0' when 1 then 'unknown' when 2 then concat(bbl, '.0') else cast(bbl as string) end")
    return clean.valid_parcels(V.raw_sales(spark, d).select("row_order", text.alias("bbl")))


@check(
    "p7_sale_dates",
    """select row_order, sale_date, cast(year(sale_date) as int) as sale_year, cast(month(sale_date) as int) as sale_month,
       cast(quarter(sale_date) as int) as sale_quarter,
       case when row_order % 3 = 0 then 0 else cast(year_built as bigint) end as year_built from raw_sales""",
)
def p7(spark, d):
    raw = V.raw_sales(spark, d).select(
        "row_order",
        F.expr("case when row_order % 2 = 0 then date_format(sale_date, 'yyyy-MM-dd') else date_format(sale_date, 'M/d/yyyy') end").alias("sale_date"),
        F.expr("case when row_order % 3 <> 0 then year_built end").alias("year_built"),
    )
    return clean.parse_sale_dates(raw)


@check(
    "clean_sales",
    """select row_order, bbl, sale_date, sale_price, sale_year, sale_month, sale_quarter, year_built from cleaned""",
)
def clean_all(spark, d):
    return V.cleaned(spark, d).select(
        "row_order", "bbl", "sale_date", "sale_price", "sale_year", "sale_month", "sale_quarter", "year_built"
    )


@check(
    "p8_canonical",
    """select row_order, sale_date, case when sale_price >= 10000 then sale_price end as sale_price,
       round(latitude, 6) as latitude, gross_square_feet, cast(year_built as bigint) as year_built,
       'UNK' as borough, cast(null as varchar) as lot from raw_sales""",
)
def p8(spark, d):
    raw = V.raw_sales(spark, d).select(
        "row_order",
        F.date_format("sale_date", "yyyy-MM-dd").alias("close_date"),
        F.format_number("sale_price", 2).alias("close_price"),
        F.col("latitude").cast("string").alias("lat"),
        F.col("longitude").cast("string").alias("lon"),
        F.col("gross_square_feet").cast("string").alias("sqft"),
        F.col("year_built").cast("string").alias("built_year"),
    )
    mapping = {
        "rename": {"close_date": "sale_date", "close_price": "sale_price", "lat": "latitude", "lon": "longitude", "sqft": "gross_square_feet", "built_year": "year_built"},
        "defaults": {"borough": "UNK"},
    }
    out = clean.to_canonical(raw, mapping).withColumn("latitude", F.round("latitude", 6))
    return out.select("row_order", "sale_date", "sale_price", "latitude", "gross_square_feet", "year_built", "borough", "lot")


@check("p9_training_frame", "select row_order, sale_date, sale_price, h3_index from featured")
def p9(spark, d):
    df = V.featured(spark, d)
    return clean.prepare_training_frame(df.toDF(*[c.upper() for c in df.columns])).select("row_order", "sale_date", "sale_price", "h3_index")


# ---------------------------------------------------------------- identity, duplicates, history


@check(
    "p10_unit_token",
    f"select distinct apartment_number, {V.unit_sql('apartment_number', False)} as unit, {V.unit_sql('apartment_number', True)} as strict_unit from raw_sales",
)
def p10(spark, d):
    from valuary.functions.property import unit_token

    a = F.col("apartment_number")
    units = V.raw_sales(spark, d).select(a, unit_token(a, False).alias("unit"), unit_token(a, True).alias("strict_unit"))
    return units.distinct()


@check("p11_address_unit", f"select row_order, address, {V.ADDRESS_UNIT_SQL} as unit from raw_sales")
def p11(spark, d):
    from valuary.functions.property import unit_from_address

    return V.raw_sales(spark, d).select("row_order", "address", unit_from_address(F.col("address")).alias("unit"))


@check("p12_property_id", "select row_order, property_id, unit_identifier, property_id_source from identified")
def p12(spark, d):
    return V.identified(spark, d).select("row_order", "property_id", "unit_identifier", "property_id_source")


@check("w1_dedup_first", "select row_order, property_id, sale_date, sale_price from deduped")
def w1(spark, d):
    return V.deduped(spark, d).select("row_order", "property_id", "sale_date", "sale_price")


@check(
    "a10_duplicate_metrics",
    """select count(*) filter (where n > 1) as duplicate_groups, count(*) filter (where n > 1 and addresses > 1) as suspect_groups
       from (select count(*) as n, count(distinct upper(trim(coalesce(address, '')))) as addresses from
         (select * replace (case when row_order % 2 = 1 and block % 3 = 0 then concat(address, ' REAR') else address end as address) from identified)
         group by property_id, sale_date, sale_price)""",
)
def a10(spark, d):
    address = F.expr("case when row_order % 2 = 1 and block % 3 = 0 then concat(address, ' REAR') else address end")
    return identity.duplicate_metrics(V.identified(spark, d).withColumn("address", address))


@check(
    "u2_duplicate_keys",
    "select property_id, sale_date, sale_price from identified group by all having count(*) > 1",
)
def u2(spark, d):
    return identity.duplicate_keys(V.identified(spark, d))


@check(
    "u1_union_parts",
    "select cast(year(sale_date) as int) as year, count(*) as n from raw_sales group by all",
)
def u1(spark, d):
    raw = V.raw_sales(spark, d)
    old, new = raw.where("sale_date < date'2022-01-01'").drop("zip_code"), raw.where("sale_date >= date'2022-01-01'")
    union = old.unionByName(new, allowMissingColumns=True)
    return union.groupBy(F.year("sale_date").alias("year")).agg(F.count("*").alias("n"))


_HISTORY = """row_order, property_id, sale_date, sale_sequence, is_latest_sale, previous_sale_price, previous_sale_date,
    round(price_change_pct, 6) as price_change_pct, days_since_last_sale"""


def _history_columns(df):
    return df.selectExpr(
        "row_order", "property_id", "sale_date", "sale_sequence", "is_latest_sale", "previous_sale_price",
        "previous_sale_date", "round(price_change_pct, 6) as price_change_pct", "days_since_last_sale",
    )


@check("sales_history", f"select {_HISTORY} from history")
def sales_history(spark, d):
    return _history_columns(V.history(spark, d))


@check("w2_sale_sequence", "select row_order, property_id, sale_sequence from history")
def w2(spark, d):
    return V.history(spark, d).select("row_order", "property_id", "sale_sequence")


@check("w3_latest_sale", "select row_order, property_id, is_latest_sale from history")
def w3(spark, d):
    return V.history(spark, d).select("row_order", "property_id", "is_latest_sale")


@check(
    "w4_previous_sale",
    "select row_order, property_id, previous_sale_price, previous_sale_date from history",
)
def w4(spark, d):
    return V.history(spark, d).select("row_order", "property_id", "previous_sale_price", "previous_sale_date")


@check(
    "w5_price_change",
    "select row_order, round(price_change_pct, 6) as price_change_pct, days_since_last_sale from history",
)
def w5(spark, d):
    return V.history(spark, d).select("row_order", F.round("price_change_pct", 6).alias("price_change_pct"), "days_since_last_sale")


@check("w2_history_of_hot_properties", f"select {_HISTORY} from history")
def w2_hot(spark, d):
    # A low share makes most properties count as hot, so the split path does the work.
    return _history_columns(
        identity.add_sales_history(V.deduped(spark, d), order="row_order", hot_share=1e-4, hot_min_rows=0)
    )


# ---------------------------------------------------------------- segments and tiers


@check(
    "p13_segments",
    f"select building_class_category, {V.SEGMENT_SQL} as property_segment, count(*) as n from raw_sales group by all",
)
def p13(spark, d):
    df = tiers.assign_segments(V.raw_sales(spark, d))
    return df.groupBy("building_class_category", "property_segment").agg(F.count("*").alias("n"))


_TIER_SQL = """select row_order, property_segment, sale_price,
    case when 4 * (rn - 1) <= n - 1 then 'entry' when 4 * (rn - 1) <= 2 * (n - 1) then 'core'
         when 4 * (rn - 1) <= 3 * (n - 1) then 'premium' else 'luxury' end as price_tier
    from (select *, row_number() over (partition by property_segment order by {price}, row_order) as rn,
          count(*) over (partition by property_segment) as n from segmented)"""


@check("w6_price_tiers", _TIER_SQL.format(price="sale_price"))
def w6(spark, d):
    return tiers.assign_price_tiers(V.segmented(spark, d)).select("row_order", "property_segment", "sale_price", "price_tier")


@check(
    "w6_price_tiers_with_ties",
    """select row_order, property_segment, price_tier from (with segmented2 as
       (select row_order, property_segment, case when sale_price between 30000 and 60000 then 40000e0 else round(sale_price, -4) end as sale_price
        from segmented) select row_order, property_segment,
    case when 4 * (rn - 1) <= n - 1 then 'entry' when 4 * (rn - 1) <= 2 * (n - 1) then 'core'
         when 4 * (rn - 1) <= 3 * (n - 1) then 'premium' else 'luxury' end as price_tier
    from (select *, row_number() over (partition by property_segment order by sale_price, row_order) as rn,
          count(*) over (partition by property_segment) as n from segmented2))""",
)
def w6_ties(spark, d):
    price = F.expr("case when sale_price between 30000 and 60000 then 40000e0 else round(sale_price, -4) end")
    df = tiers.assign_price_tiers(V.segmented(spark, d).withColumn("sale_price", price))
    return df.select("row_order", "property_segment", "price_tier")


# ---------------------------------------------------------------- imputation

_IMPUTE_SQFT_SQL = """with ok as (select * from cleaned where gross_square_feet is not null and gross_square_feet <> 0),
    m1 as (select neighborhood, building_class, median(gross_square_feet) as m from ok group by all),
    m2 as (select borough, building_class, median(gross_square_feet) as m from ok group by all),
    m3 as (select building_class, median(gross_square_feet) as m from ok group by all),
    m4 as (select median(gross_square_feet) as m from ok)
    select row_order, miss as sqft_imputed,
      case when miss then case when v1 is not null then 'neighborhood_class' when v2 is not null then 'borough_class'
        when v3 is not null then 'class_only' else 'citywide' end end as sqft_imputation_level,
      round(case when miss then coalesce(v1, v2, v3, v4, 1200) else gross_square_feet end, 4) as gross_square_feet
    from (select c.*, coalesce(gross_square_feet, 0) = 0 as miss, m1.m as v1, m2.m as v2, m3.m as v3, m4.m as v4
      from cleaned c left join m1 on c.neighborhood = m1.neighborhood and c.building_class = m1.building_class
      left join m2 on c.borough = m2.borough and c.building_class = m2.building_class
      left join m3 on c.building_class = m3.building_class cross join m4)"""


@check("j1_impute_sqft", _IMPUTE_SQFT_SQL)
def j1(spark, d):
    df = impute.impute_sqft(V.cleaned(spark, d))
    return df.select("row_order", "sqft_imputed", "sqft_imputation_level", F.round("gross_square_feet", 4).alias("gross_square_feet"))


@check(
    "j2_impute_year",
    """with ok as (select * from cleaned where year_built <> 0),
    m1 as (select neighborhood, median(year_built) as m from ok group by all),
    m2 as (select borough, median(year_built) as m from ok group by all), m3 as (select median(year_built) as m from ok)
    select row_order, c.year_built = 0 as year_built_imputed,
      case when c.year_built = 0 then cast(trunc(coalesce(m1.m, m2.m, m3.m)) as bigint) else c.year_built end as year_built
    from cleaned c left join m1 on c.neighborhood = m1.neighborhood left join m2 on c.borough = m2.borough cross join m3""",
)
def j2(spark, d):
    return impute.impute_year_built(V.cleaned(spark, d)).select("row_order", "year_built_imputed", "year_built")


# ---------------------------------------------------------------- features


@check("p15_grid_cell", f"select row_order, {V.CELL_SQL} as h3_index from cleaned")
def p15(spark, d):
    return V.featured(spark, d).select("row_order", "h3_index")


@check("p16_distance", "select row_order, round(distance_to_center_km, 6) as distance_to_center_km from featured")
def p16(spark, d):
    return V.featured(spark, d).select("row_order", F.round("distance_to_center_km", 6).alias("distance_to_center_km"))


@check("p17_building_age", f"select distinct year_built, cast({V.AGE_SQL} as bigint) as building_age from cleaned")
def p17(spark, d):
    return V.featured(spark, d).select("year_built", F.col("building_age").cast("bigint").alias("building_age")).distinct()


@check("p18_price_per_sqft", "select row_order, round(price_per_sqft, 6) as price_per_sqft from featured")
def p18(spark, d):
    return V.featured(spark, d).select("row_order", F.round("price_per_sqft", 6).alias("price_per_sqft"))


@check(
    "p19_temporal_features",
    """select distinct sale_date, days_since_2019_start, round(month_sin, 9) + 0e0 as month_sin, round(month_cos, 9) + 0e0 as month_cos,
       rate_regime_bucket from featured""",
)
def p19(spark, d):
    df = V.featured(spark, d).select(
        "sale_date",
        "days_since_2019_start",
        (F.round("month_sin", 9) + F.lit(0.0)).alias("month_sin"),
        (F.round("month_cos", 9) + F.lit(0.0)).alias("month_cos"),
        "rate_regime_bucket",
    )
    return df.distinct()


_SPLIT_SQL = """select *, rn <= cast(floor(n * (1 - 0.2e0)) as bigint) as is_train from
    (select *, row_number() over (order by sale_date, row_order) as rn, count(*) over () as n from featured)"""


@check(
    "w7_time_split",
    f"select row_order, sale_date, case when is_train then 'train' else 'test' end as part from ({_SPLIT_SQL})",
)
def w7(spark, d):
    train, test = features.time_split(V.cleaned(spark, d), 0.2)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("row_order", "sale_date", "part")


@check(
    "j3_cell_price_lag",
    f"""with split as ({_SPLIT_SQL}), cell as (select h3_index, median(sale_price) as m from split where is_train group by all)
        select row_order, case when is_train then 'train' else 'test' end as part,
        round(coalesce(m, (select median(sale_price) from split where is_train)), 4) as h3_price_lag
        from split left join cell using (h3_index)""",
)
def j3(spark, d):
    train, test = features.add_cell_price_lag(*features.time_split(V.featured(spark, d), 0.2))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("row_order", "part", F.round("h3_price_lag", 4).alias("h3_price_lag"))


@check(
    "j11_attach_coordinates",
    """with side as (select bbl, min(latitude) as known_lat from raw_sales where latitude is not null group by bbl)
       select row_order, round(coalesce(latitude, known_lat), 6) as latitude from raw_sales left join side using (bbl)""",
)
def j11(spark, d):
    raw = V.raw_sales(spark, d)
    out = readers.attach_coordinates(raw, readers.coordinates_table(raw))
    return out.select("row_order", F.round("latitude", 6).alias("latitude"))


@check("l1_head_limit", "select row_order, sale_price from raw_sales order by row_order limit 250")
def l1(spark, d):
    return head_rows(V.raw_sales(spark, d).select("row_order", "sale_price"), ["row_order"], 250)


@check(
    "l2_newest_rows",
    "select row_order, sale_date, sale_price from cleaned order by sale_date desc, row_order limit 2000",
)
def l2(spark, d):
    df = V.cleaned(spark, d).select("row_order", "sale_date", "sale_price")
    return head_rows(df, [F.col("sale_date").desc(), "row_order"], 2000)


@check(
    "l5_sample",
    "select row_order, sale_price from cleaned order by md5(concat(cast(row_order as varchar), ':7')), row_order limit 500",
)
def l5(spark, d):
    return sample_rows(V.cleaned(spark, d).select("row_order", "sale_price"), "row_order", 500, 7)


# ---------------------------------------------------------------- the whole pass

_TIERED = """(select *, case when 4 * (rn - 1) <= n - 1 then 'entry' when 4 * (rn - 1) <= 2 * (n - 1) then 'core'
    when 4 * (rn - 1) <= 3 * (n - 1) then 'premium' else 'luxury' end as price_tier from
    (select *, row_number() over (partition by seg order by sale_price, row_order) as rn, count(*) over (partition by seg) as n
     from (select *, {seg} as seg from history)))"""


def _etl(spark, d):
    return run_etl(V.raw_sales(spark, d), date(2025, 12, 1))


@check(
    "e1_etl_stages",
    """select 0 as position, 'extract_raw' as stage, count(*) as rows, cast(null as bigint) as unique_properties, max(sale_date) as latest_sale_date from raw_sales
       union all select 1, 'cleaned', count(*), null, max(sale_date) from cleaned
       union all select 2, 'feature_engineered', count(*), count(distinct property_id), max(sale_date) from deduped
       union all select 3, 'load_skipped', count(*), count(distinct property_id), max(sale_date) from deduped""",
)
def e1_stages(spark, d):
    return _etl(spark, d).stages


@check(
    "e1_failed_run",
    """select 'stage' as kind, 'extract_raw' as name, count(*) as rows from raw_sales union all select 'stage', 'cleaned', count(*) from cleaned
       union all select 'violation', 'freshness', count(*) from cleaned union all select 'run', 'failed', 1""",
)
def e1_failed(spark, d):
    """The report that a run leaves behind when its feed is too old."""
    path = scratch_path(spark, "etl-report")
    try:
        run_etl(V.raw_sales(spark, d), date(2045, 12, 1), report=path)
    except EtlError:
        pass
    stages = spark.read.json(f"{path}/stages").select(F.lit("stage").alias("kind"), F.col("stage").alias("name"), "rows")
    violations = spark.read.json(f"{path}/violations").select(F.lit("violation"), "check", "failed_rows")
    run = spark.read.json(f"{path}/run").select(F.lit("run"), "status", F.col("violations").cast("long"))
    return stages.union(violations).union(run)


@check(
    "e1_enriched_sales",
    f"""select seg as property_segment, price_tier, count(*) as n, cast(sum(sale_sequence) as bigint) as sequences,
        count(*) filter (where is_latest_sale) as latest, count(*) filter (where coalesce(gross_square_feet, 0) = 0) as imputed_sqft,
        count(*) filter (where year_built = 0) as imputed_years, count(distinct {V.CELL_SQL}) as cells from {_TIERED.format(seg=V.SEGMENT_SQL)} group by all""",
)
def e1_enriched(spark, d):
    return _etl(spark, d).sales.groupBy("property_segment", "price_tier").agg(
        F.count("*").alias("n"),
        F.sum("sale_sequence").alias("sequences"),
        F.count_if("is_latest_sale").alias("latest"),
        F.count_if("sqft_imputed").alias("imputed_sqft"),
        F.count_if("year_built_imputed").alias("imputed_years"),
        F.count_distinct("h3_index").alias("cells"),
    )
