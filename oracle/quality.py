"""Checks of data contracts, stage statistics, distributions and feature contracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from oracle import views as V
from oracle.registry import check
from valuary.operators import contracts, profile, features

AS_OF = date(2025, 12, 1)

# One rule broken per part of the table.
_BROKEN = {
    "sale_price": "case when block % 50 = 0 then 5000e0 when block % 51 = 0 then null else sale_price end",
    "bbl": "case when block % 40 = 0 then bbl % 1000000000 when block % 41 = 0 then null else bbl end",
    "latitude": "case when block % 30 = 0 then 10e0 else latitude end",
    "borough": "case when block % 20 = 0 then 9 else borough end",
}
_BROKEN_SQL = "(select * replace (" + ", ".join(f"{e} as {c}" for c, e in _BROKEN.items()) + ") from cleaned)"


def _broken(spark, d):
    return V.cleaned(spark, d).withColumns({c: F.expr(e) for c, e in _BROKEN.items()})


def _null_rows(columns: list[str]) -> str:
    return " union all ".join(
        f"""select 'null_threshold' as "check", printf('{c}: share of nulls %.4f is above 0.0000', avg(case when {c} is null then 1e0 else 0e0 end)) as message,
        count(*) filter (where {c} is null) as failed_rows from b having count(*) filter (where {c} is null) > 0"""
        for c in columns
    )


_DOMAIN = """select 'domain_sale_price' as "check", 'sale_price under 10000' as message, count(*) as failed_rows from b where sale_price < 10000 having count(*) > 0
    union all select 'domain_bbl', 'bbl without exactly 10 digits', count(*) from b where bbl is null or length(cast(bbl as varchar)) <> 10 having count(*) > 0
    union all select 'domain_coordinates', 'coordinates absent or off the city', count(*) from b
        where latitude is null or longitude is null or not (latitude between 40.40e0 and 41.10e0 and longitude between -74.35e0 and -73.45e0) having count(*) > 0
    union all select 'domain_borough', 'borough is none of 1 to 5', count(*) from b where borough is null or borough not in (1, 2, 3, 4, 5) having count(*) > 0"""
_NULLS = _null_rows(["sale_date", "sale_price", "bbl", "latitude", "longitude"])
_FRESH = """select 'freshness' as "check", concat('newest sale_date ', strftime(max(sale_date), '%Y-%m-%d'), ' lies ',
    cast(date '2028-01-01' - max(sale_date) as varchar), ' days back, allowed are 730') as message, count(*) as failed_rows from b
    having date '2028-01-01' - max(sale_date) > 730"""


@check("a11_null_limits", f"with b as {_BROKEN_SQL} {_NULLS}")
def a11(spark, d):
    return contracts.null_violations(_broken(spark, d))


@check("a12_domains", f"with b as {_BROKEN_SQL} {_DOMAIN}")
def a12(spark, d):
    return contracts.domain_violations(_broken(spark, d))


@check("a13_freshness", f"with b as (select * from cleaned) {_FRESH}")
def a13(spark, d):
    return contracts.freshness_violations(V.cleaned(spark, d), date(2028, 1, 1))


@check(
    "a14_sales_contract",
    f"""with b as {_BROKEN_SQL} select 'required_columns' as "check", 'columns absent (required): lot' as message, count(*) as failed_rows from b
        union all {_FRESH} union all {_NULLS} union all {_DOMAIN}""",
)
def a14(spark, d):
    return contracts.sales_violations(_broken(spark, d).drop("lot"), date(2028, 1, 1))


@check(
    "a14_contract_passed",
    """select cast(count(*) as bigint) as rows, true as passed from cleaned""",
)
def a14_passed(spark, d):
    df = V.cleaned(spark, d)
    broken = contracts.sales_violations(df, AS_OF).agg((F.count("*") == 0).alias("passed"))
    return df.agg(F.count("*").alias("rows")).withColumn("passed", broken.scalar())


@check(
    "a14_canonical_contract",
    f"""with b as {_BROKEN_SQL}
        select 'required_columns' as "check", 'columns absent (canonical): property_segment' as message, count(*) as failed_rows from b
        union all select 'domain_sale_price', 'sale_price under 10000', count(*) from b where sale_price < 10000 having count(*) > 0
        union all select 'sale_date', 'no sale_date could be parsed', count(*) from b""",
)
def a14_canonical(spark, d):
    return contracts.canonical_violations(_broken(spark, d).withColumn("sale_date", F.lit(None).cast("date")))


@check(
    "s12_stage_statistics",
    """select 0 as position, 'extract_raw' as stage, count(*) as rows, cast(null as bigint) as unique_properties, max(sale_date) as latest_sale_date from raw_sales
       union all select 1, 'cleaned', count(*), null, max(sale_date) from cleaned
       union all select 2, 'identified', count(*), count(distinct property_id), max(sale_date) from identified
       union all select 3, 'deduplicated', count(*), count(distinct property_id), max(sale_date) from deduped""",
)
def s12(spark, d):
    return profile.stage_statistics(
        {
            "extract_raw": V.raw_sales(spark, d),
            "cleaned": V.cleaned(spark, d),
            "identified": V.identified(spark, d),
            "deduplicated": V.deduped(spark, d),
        }
    )


@check(
    "s13_dataset_version",
    """select concat('rows_', cast(count(*) as varchar), '_date_', strftime(min(sale_date), '%Y-%m-%d'), '_', strftime(max(sale_date), '%Y-%m-%d'))
       as dataset_version from cleaned""",
)
def s13(spark, d):
    return profile.dataset_version(V.cleaned(spark, d))


@check(
    "a15_distribution",
    """select 'property_id_source' as column_name, property_id_source as "value", count(*) as n,
       round(count(*) * 100e0 / sum(count(*)) over (), 6) as pct from identified group by property_id_source""",
)
def a15(spark, d):
    return profile.distribution(V.identified(spark, d), "property_id_source").withColumn("pct", F.round("pct", 6))


@check(
    "a15_distributions",
    """select 'property_segment' as column_name, property_segment as "value", count(*) as n,
         round(count(*) * 100e0 / sum(count(*)) over (), 6) as pct from segmented group by property_segment
       union all select 'neighborhood', neighborhood, count(*), round(count(*) * 100e0 / sum(count(*)) over (), 6) from segmented group by neighborhood
       union all select 'sale_quarter', cast(sale_quarter as varchar), count(*), round(count(*) * 100e0 / sum(count(*)) over (), 6) from segmented group by sale_quarter""",
)
def a15_many(spark, d):
    df = profile.distributions(V.segmented(spark, d), ["property_segment", "neighborhood", "sale_quarter"])
    return df.withColumn("pct", F.round("pct", 6))


@check(
    "a23_missing_causes",
    """select building_class_category, count(*) as n, count(*) filter (where coalesce(gross_square_feet, 0) = 0) as missing_n,
       round(count(*) filter (where coalesce(gross_square_feet, 0) = 0) * 100e0 / count(*), 6) as missing_pct from cleaned group by all""",
)
def a23(spark, d):
    df = profile.missing_by_category(V.cleaned(spark, d), "gross_square_feet", "building_class_category")
    return df.withColumn("missing_pct", F.round("missing_pct", 6))


@check(
    "p24_feature_contract",
    """select column_name, case when column_name in ('sale_price') then 'target_derived'
         when column_name in ('gross_square_feet', 'year_built', 'residential_units', 'total_units', 'borough', 'building_class', 'neighborhood') then 'ok'
         else 'undocumented' end as verdict, case column_name when 'gross_square_feet' then f when 'apartment_number' then a else n end as filled
       from (select count(*) as n, count(gross_square_feet) as f, count(apartment_number) as a from cleaned),
         (values ('sale_price'), ('gross_square_feet'), ('year_built'), ('borough'), ('apartment_number')) c(column_name)""",
)
def p24(spark, d):
    columns = ["sale_price", "gross_square_feet", "year_built", "borough", "apartment_number"]
    filled = V.cleaned(spark, d).agg(*[F.count(c).alias(c) for c in columns])
    filled = filled.unpivot([], columns, "column_name", "filled")
    return features.feature_contract_report(columns, spark).join(F.broadcast(filled), "column_name")


@check(
    "u4_missing_columns",
    """select 'lot' as missing_column, count(*) as rows from cleaned""",
)
def u4(spark, d):
    found = contracts.sales_violations(V.cleaned(spark, d).drop("lot"), AS_OF).where("check = 'required_columns'")
    return found.select(
        F.regexp_extract("message", r": (\w+)$", 1).alias("missing_column"), F.col("failed_rows").alias("rows")
    )
