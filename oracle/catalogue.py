"""Checks of the property catalogue, search, map clusters and valuations."""

from __future__ import annotations

from pyspark.sql import functions as F

from oracle import views as V
from oracle.registry import check
from valuary.operators import catalog, evaluate, search, valuation
from valuary.operators.clean import normalise_latest_sales
from valuary.session import stage_table

# Raw rows with untidy texts; the same expressions make the SQL input.
_UNTIDY = {
    "property_id": "case when row_order % 4 = 0 then '  ' else property_id end",
    "borough": "case when row_order % 5 = 0 then ' staten  island ' when row_order % 5 = 1 then '' else cast(borough as string) end",
    "zip_code": "case when row_order % 6 = 0 then '123' when row_order % 6 = 1 then concat(' ', cast(zip_code as string), '-0001') else cast(zip_code as string) end",
    "property_segment": "case when row_order % 7 = 0 then '' else lower(building_class_category) end",
    "price_tier_proxy": "case when row_order % 3 = 0 then ' very high ' when row_order % 3 = 1 then '  ' else 'core' end",
    "address": "case when row_order % 50 = 0 then ' ' else concat(' ', address) end",
    "gross_square_feet": "cast(cast(gross_square_feet as bigint) as string)",
    "year_built": "case when row_order % 9 = 0 then '1700' when row_order % 9 = 1 then 'old' else cast(year_built as string) end",
    "total_units": "case when row_order % 8 = 0 then '0' when row_order % 8 = 1 then '2.5' else cast(cast(total_units as int) as string) end",
}
_KEEP = ["row_order", "bbl", "latitude", "longitude", "building_class", "residential_units", "sale_date"]
_UNTIDY_SQL = f"(select {', '.join(_KEEP + [f'{e} as {c}' for c, e in _UNTIDY.items()])} from identified)"


def _untidy(spark, d):
    return V.identified(spark, d).selectExpr(*_KEEP, *[f"{e} as {c}" for c, e in _UNTIDY.items()])


_RECORDS = f"""(select *, round(((sqft is not null)::int + (yb is not null)::int + (tu is not null)::int + (building_class is not null)::int + 1) / 5e0, 2) as completeness
    from (select row_order, coalesce(nullif(trim(property_id), ''), concat(cast(bbl as varchar), ':', upper(trim(address)), ':', cast(sale_date as varchar))) as property_id,
      trim(address) as address,
      case when borough = '' then 'UNKNOWN' when trim(borough) = '1' then 'MANHATTAN' when trim(borough) = '2' then 'BRONX' when trim(borough) = '3' then 'BROOKLYN'
        when trim(borough) = '4' then 'QUEENS' when trim(borough) = '5' then 'STATEN_ISLAND' else regexp_replace(upper(trim(borough)), '\\s+', '_', 'g') end as borough,
      case when length(regexp_replace(zip_code, '[^0-9]', '', 'g')) >= 5 then left(regexp_replace(zip_code, '[^0-9]', '', 'g'), 5) end as zip_code,
      regexp_replace(upper(coalesce(nullif(trim(property_segment), ''), 'UNKNOWN')), '\\s+', '_', 'g') as property_segment,
      regexp_replace(upper(nullif(trim(price_tier_proxy), '')), '\\s+', '_', 'g') as price_tier_proxy, latitude as lat, longitude as lng,
      case when try_cast(gross_square_feet as double) > 0 then try_cast(gross_square_feet as double) end as sqft,
      case when try_cast(year_built as bigint) between 1800 and 2100 then try_cast(year_built as bigint) end as yb,
      case when total_units not like '%.%' and try_cast(total_units as bigint) >= 1 then try_cast(total_units as bigint) end as tu, building_class
      from {_UNTIDY_SQL} where trim(address) <> ''))"""
_CATALOGUE = f"(select * from {_RECORDS} qualify row_number() over (partition by property_id order by row_order) = 1)"


@check(
    "p31_catalogue_records",
    f"""select row_order, property_id, address, borough, zip_code, property_segment, price_tier_proxy, round(lat, 6) as lat,
        sqft as gross_square_feet, yb as year_built, tu as total_units from {_RECORDS}""",
)
def p31(spark, d):
    df = catalog.catalogue_records(_untidy(spark, d))
    return df.select(
        "row_order", "property_id", "address", "borough", "zip_code", "property_segment", "price_tier_proxy",
        F.round("lat", 6).alias("lat"), "gross_square_feet", "year_built", "total_units",
    )


@check(
    "p32_completeness",
    f"""select row_order, completeness as feature_completeness, case when completeness >= 0.9e0 then 'ready' when completeness >= 0.6e0 then 'partial' else 'sparse' end as data_quality_status,
        array_to_string(list_filter([case when sqft is null then 'gross_square_feet' end, case when yb is null then 'year_built' end,
          case when tu is null then 'total_units' end], lambda x: x is not null), ',') as missing_required_features,
        sqft is not null and yb is not null and tu is not null as inference_ready from {_RECORDS}""",
)
def p32(spark, d):
    df = catalog.catalogue_records(_untidy(spark, d))
    missing = F.array_join("missing_required_features", ",").alias("missing_required_features")
    return df.select("row_order", "feature_completeness", "data_quality_status", missing, "inference_ready")


@check("w8_catalogue_first", f"select property_id, row_order, address from {_CATALOGUE}")
def w8(spark, d):
    return catalog.build_catalogue(_untidy(spark, d)).select("property_id", "row_order", "address")


_FOUND = f"""(select * from {_CATALOGUE} where borough = 'QUEENS' and (contains(lower(address), '7 main') or contains(lower(borough), '7 main') or contains(lower(property_segment), '7 main')))"""


@check(
    "p33_search_page",
    f"""select property_id, address, borough, zip_code, property_segment, price_tier_proxy, round(lat, 6) as lat from {_FOUND} order by property_id limit 30""",
)
def p33(spark, d):
    found = catalog.search_properties(catalog.build_catalogue(_untidy(spark, d)), " 7 Main", borough="queens")
    page = catalog.first_page(found, 30)
    return page.select("property_id", "address", "borough", "zip_code", "property_segment", "price_tier_proxy", F.round("lat", 6).alias("lat"))


@check("p33_search_totals", f"select (select count(*) from {_FOUND}) as total_available, (select count(*) from {_CATALOGUE}) as total_catalog")
def p33_totals(spark, d):
    catalogue = catalog.build_catalogue(_untidy(spark, d)).select("property_id", *catalog.SEARCHED)
    catalogue = stage_table(catalogue, "catalogue")
    return catalog.search_totals(catalogue, catalog.search_properties(catalogue, " 7 Main", borough="queens"))


_NEEDLES = "select concat(s_suppkey, ' Main') as needle from supplier union all select cast(n_nationkey as varchar) from nation"


@check(
    "p33_search_many",
    f"""select needle, count(*) as n_found, min(property_id) as first_id from (select lower(needle) as needle from ({_NEEDLES}) group by all) q
        join {_CATALOGUE} c on contains(lower(address), needle) or contains(lower(borough), needle) or contains(lower(property_segment), needle)
        group by needle""",
)
def p33_many(spark, d):
    needles = V.table(spark, d, "supplier").select(F.concat("s_suppkey", F.lit(" Main")).alias("needle"))
    needles = needles.union(V.table(spark, d, "nation").select(F.col("n_nationkey").cast("string")))
    catalogue = stage_table(catalog.build_catalogue(_untidy(spark, d)), "catalogue")
    found = search.search_many(catalogue, needles, "property_id", ("address", "borough", "property_segment"))
    return found.groupBy("needle").agg(F.count("*").alias("n_found"), F.min("property_id").alias("first_id"))


@check(
    "p34_nearby",
    f"""select property_id, borough, round(lat, 6) as lat, round(lng, 6) as lng from {_CATALOGUE}
        where lng between -74.15e0 and -74.0e0 and lat between 40.55e0 and 40.7e0 and property_segment = '01_ECONOMY'""",
)
def p34(spark, d):
    found = catalog.nearby_properties(
        catalog.build_catalogue(_untidy(spark, d)), -74.15, 40.55, -74.0, 40.7, segment="01_economy"
    )
    return found.select("property_id", "borough", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@check(
    "p35_property_detail",
    f"select property_id, address, borough from {_CATALOGUE} where property_id = (select min(property_id) from identified where row_order % 4 <> 0)",
)
def p35(spark, d):
    wanted = V.identified(spark, d).where("row_order % 4 <> 0").agg(F.min("property_id")).first()[0]
    return catalog.property_detail(catalog.build_catalogue(_untidy(spark, d)), wanted).select("property_id", "address", "borough")


_BOROUGH_NAME = "case borough when 1 then 'Manhattan' when 2 then 'Bronx' when 3 then 'Brooklyn' when 4 then 'Queens' when 5 then 'Staten Island' else cast(borough as varchar) end"


@check("p14_borough_names", f"select borough, {_BOROUGH_NAME} as borough_name, count(*) as n from (select case when block % 10 = 0 then 9 else borough end as borough from raw_sales) group by all")
def p14(spark, d):
    raw = V.raw_sales(spark, d).withColumn("borough", F.expr("case when block % 10 = 0 then 9 else borough end"))
    return normalise_latest_sales(raw).groupBy("borough", "borough_name").agg(F.count("*").alias("n"))


@check(
    "p36_explorer_sales",
    f"""select row_order, {_BOROUGH_NAME} as borough_name, {V.SEGMENT_SQL} as property_segment from history
        where is_latest_sale and borough in (1, 3) and {V.SEGMENT_SQL} in ('WALKUP', 'ELEVATOR')""",
)
def p36(spark, d):
    sales = normalise_latest_sales(V.history(spark, d))
    out = catalog.explorer_sales(sales, ["Manhattan", "Brooklyn"], ["WALKUP", "ELEVATOR"])
    return out.select("row_order", "borough_name", "property_segment")


@check(
    "p37_display_label",
    """select row_order, concat(coalesce(address, 'Unknown'), ' ', coalesce(apartment_number, ''), ' | ', strftime(sale_date, '%Y-%m-%d')) as display_label from cleaned""",
)
def p37(spark, d):
    df = V.cleaned(spark, d)
    return df.select("row_order", catalog.display_label(df).alias("display_label"))


_CLUSTERS = f"""select case when count(*) = 1 then 'property' else 'cluster' end as type, case when count(*) = 1 then min(property_id) else
    concat(cast(cast(floor(lng / {{s}}) as bigint) as varchar), ':', cast(cast(floor(lat / {{s}}) as bigint) as varchar)) end as key,
    count(*) as count, round(avg(lat) * count(*), 6) as lat_sum, round(avg(lng) * count(*), 6) as lng_sum from {_CATALOGUE} group by floor(lng / {{s}}), floor(lat / {{s}})"""


@check("a18_map_clusters", _CLUSTERS.format(s="0.03e0"))
def a18(spark, d):
    df = catalog.map_clusters(catalog.build_catalogue(_untidy(spark, d)), zoom=10)
    sums = [F.round(F.col(c) * F.col("count"), 6).alias(f"{c}_sum") for c in ("lat", "lng")]
    return df.select("type", "key", "count", *sums)


@check(
    "a19_filter_options",
    f"""select distinct 'borough' as option, borough as "value" from {_RECORDS} union select distinct 'property_segment', property_segment from {_RECORDS}
        union select distinct 'price_tier_proxy', price_tier_proxy from {_RECORDS} where price_tier_proxy is not null""",
)
def a19(spark, d):
    return catalog.filter_options(catalog.catalogue_records(_untidy(spark, d)), ["borough", "property_segment", "price_tier_proxy"])


@check(
    "j9_price_history",
    """select property_id, sale_date, sale_price, sale_sequence, is_latest_sale from history
       where property_id in (select property_id from identified where block % 100 = 7 and sale_year = 2021)""",
)
def j9(spark, d):
    wanted = V.identified(spark, d).where("block % 100 = 7 and sale_year = 2021").select("property_id")
    out = catalog.price_history(V.history(spark, d), wanted)
    return out.select("property_id", "sale_date", "sale_price", "sale_sequence", "is_latest_sale")


# ---------------------------------------------------------------- valuation


@check(
    "p26_valuation_status",
    """select row_order, case when (sale_price - predicted_price) / predicted_price >= 0.10e0 then 'over_valued'
       when (sale_price - predicted_price) / predicted_price <= -0.10e0 then 'under_valued' else 'near_fair_value' end as valuation_status from predictions""",
)
def p26(spark, d):
    return valuation.add_valuation_status(V.predictions(spark, d)).select("row_order", "valuation_status")


_SEG = f"(select property_segment as seg, median({V.APE_SQL}) as own from predictions where predicted_price is not null group by all)"
# To score, one segment goes by a name that no evaluated prediction has.
_SEEN = "case when property_segment = 'WALKUP' then 'LOFT' else property_segment end"
_ALL = f"(select median({V.APE_SQL}) from predictions where predicted_price is not null)"
_RANGE = f"(select p.*, coalesce(own, {_ALL}) as m, case when own is not null then 'segment' else 'overall' end as src from predictions p left join {_SEG} on {_SEEN} = seg)"


def _with_segment_metrics(spark, d):
    df = V.predictions(spark, d)
    metrics = evaluate.evaluate_predictions(df)
    return valuation.add_segment_metrics(df.withColumn("property_segment", F.expr(_SEEN)), metrics)


@check("j8_segment_metric", f"select row_order, round(m, 6) as mdape_used, src as mdape_source from {_RANGE}")
def j8(spark, d):
    return _with_segment_metrics(spark, d).select("row_order", F.round("mdape_used", 6).alias("mdape_used"), "mdape_source")


@check(
    "p27_value_range",
    f"""select row_order, round(predicted_price * (1 - m), 8) as low_value_bound, round(predicted_price * (1 + m), 8) as high_value_bound,
        round(greatest(0, least(1, 1 - m)), 6) as confidence_score from {_RANGE}""",
)
def p27(spark, d):
    df = valuation.add_value_range(_with_segment_metrics(spark, d))
    return df.select(
        "row_order",
        F.round("low_value_bound", 8).alias("low_value_bound"),
        F.round("high_value_bound", 8).alias("high_value_bound"),
        F.round("confidence_score", 6).alias("confidence_score"),
    )


_PPSF = "case borough when 1 then 1200e0 when 2 then 420e0 when 3 then 780e0 when 4 then 610e0 when 5 then 500e0 end"


def _named(spark, d):
    names = "case borough when 1 then 'manhattan' when 2 then ' Bronx' when 3 then 'BROOKLYN' when 4 then 'Queens' else 'Staten Island' end"
    return V.cleaned(spark, d).withColumn("borough", F.expr(names))


_RULE = f"""(select *, cast(floor(gross_square_feet * {_PPSF} * greatest(0.72e0, least(1.08e0, 1 - greatest(0e0, least(150e0, cast(2025 - year_built as double))) * 0.0012e0))
    * case when total_units > 4 then 0.94e0 else 1e0 end + 0.5e0) as bigint) as price from cleaned)"""


@check(
    "p28_rule_valuation",
    f"""select row_order, price as predicted_price, cast(floor(price * 0.91e0 + 0.5e0) as bigint) as interval_low,
        cast(floor(price * 1.09e0 + 0.5e0) as bigint) as interval_high from {_RULE}""",
)
def p28(spark, d):
    df = valuation.rule_based_valuation(_named(spark, d), 2025)
    return df.select("row_order", "predicted_price", "interval_low", "interval_high")


_DRIVERS = f"""(select row_order, cast(floor(gross_square_feet * 42e0 + 0.5e0) as bigint) as sq, cast(floor(75000e0 * ({_PPSF} / 620e0 - 1) + 0.5e0) as bigint) as bo,
    -cast(floor((2025 - year_built) * 420e0 + 0.5e0) as bigint) as ag, case when total_units > 8 then -cast(floor((total_units - 8) * 3500e0 + 0.5e0) as bigint) else 0 end as un from cleaned)"""


def _driver_text(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat(x["feature"], F.lit(":"), x["impact"].cast("string"))), ",")


@check(
    "p29_value_drivers",
    f"""select row_order, array_to_string(list_filter([case when sq > 0 then concat('gross_square_feet:', sq::varchar) end, case when bo > 0 then concat('borough:', bo::varchar) end], lambda x: x is not null), ',') as positive,
        array_to_string(list_filter([case when ag < 0 then concat('building_age:', ag::varchar) end, case when un < 0 then concat('total_units:', un::varchar) end], lambda x: x is not null), ',') as negative
        from {_DRIVERS}""",
)
def p29(spark, d):
    df = valuation.add_value_drivers(_named(spark, d), 2025)
    return df.select("row_order", _driver_text("drivers_positive").alias("positive"), _driver_text("drivers_negative").alias("negative"))


@check(
    "l4_top_drivers",
    f"""select row_order, array_to_string(list_transform(list_sort(list_filter([
          case when sq > 0 then {{'a': -abs(sq), 'p': 1, 't': concat('gross_square_feet:', sq::varchar)}} end,
          case when bo > 0 then {{'a': -abs(bo), 'p': 2, 't': concat('borough:', bo::varchar)}} end,
          case when ag < 0 then {{'a': -abs(ag), 'p': 3, 't': concat('building_age:', ag::varchar)}} end,
          case when un < 0 then {{'a': -abs(un), 'p': 4, 't': concat('total_units:', un::varchar)}} end], lambda x: x is not null))[1:2], lambda x: x.t), ',') as top from {_DRIVERS}""",
)
def l4(spark, d):
    df = valuation.top_drivers(valuation.add_value_drivers(_named(spark, d), 2025), 2)
    return df.select("row_order", _driver_text("top_drivers").alias("top"))


@check(
    "p30_confidence",
    """select block, round(greatest(0.25e0, least(0.95e0, s / 0.6e0)), 2) as segment_calibration, round(greatest(0.25e0, least(0.95e0, s / 0.5e0)), 2) as support_coverage,
       score as confidence, case when score >= 0.75e0 then 'high' when score >= 0.45e0 then 'medium' else 'low' end as confidence_band from
       (select *, round(greatest(0.25e0, least(0.95e0, s / 0.6e0)) * 0.45e0 + greatest(0.25e0, least(0.95e0, s / 0.5e0)) * 0.35e0 + 0.9e0 * 0.2e0, 2) as score from
         (select distinct block, coalesce(p, 0.28e0) as s from (select block, case when block % 10 <> 0 then (block % 97) / 97e0 end as p from cleaned)))""",
)
def p30(spark, d):
    df = V.cleaned(spark, d).select("block", F.expr("case when block % 10 <> 0 then (block % 97) / 97e0 end").alias("segment_ppe10")).distinct()
    out = valuation.add_confidence(df)
    return out.select("block", "segment_calibration", "support_coverage", "confidence", "confidence_band")
