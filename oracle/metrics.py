"""Checks of tier proxies, accuracy metrics, missingness and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from oracle import views as V
from oracle.registry import check
from valuary.functions import errors
from valuary.functions.parse import token_or
from valuary.operators import drift, evaluate, tiers
from valuary.operators.ordered import cumulative_counts, group_quantiles

# ---------------------------------------------------------------- tier proxy

_SCORED = f"(select *, {V.SCORE_SQL} as score from featured)"


@check("p20_proxy_score", f"select row_order, round(score, 6) as score from {_SCORED}")
def p20(spark, d):
    df = V.featured(spark, d)
    return df.select("row_order", F.round(tiers.proxy_score(df), 6).alias("score"))


@check(
    "p21_bucketize",
    f"""select row_order, case when score is null then 'core' when score <= 1.5e0 then 'entry' when score <= 2.25e0 then 'core'
        when score <= 2.5e0 then 'premium' else 'luxury' end as tier from {_SCORED}""",
)
def p21(spark, d):
    df = V.featured(spark, d)
    tier = tiers.bucketize(tiers.proxy_score(df), F.lit(1.5), F.lit(2.25), F.lit(2.5))
    return df.select("row_order", tier.alias("tier"))


@check(
    "p22_segment_token",
    """select coalesce(nullif(trim(case when borough = 2 then '  ' when borough = 3 then null else concat(' ', property_segment) end), ''), '__missing__') as token,
       count(*) as n from segmented group by all""",
)
def p22(spark, d):
    raw = F.expr("case when borough = 2 then '  ' when borough = 3 then null else concat(' ', property_segment) end")
    return V.segmented(spark, d).groupBy(token_or(raw, "__missing__").alias("token")).agg(F.count("*").alias("n"))


_BINS = f"""select scope, round(quantile_cont(score, 0.25), 6) as q25, round(quantile_cont(score, 0.5), 6) as q50,
    round(quantile_cont(score, 0.75), 6) as q75, count(*) as n
    from (select property_segment as scope, score from {_SCORED} where score is not null
          union all select '__global__', score from {_SCORED} where score is not null)
    group by scope having scope = '__global__' or count(*) >= {{rows}}"""


@check("a9_proxy_bins", _BINS.format(rows=800))
def a9(spark, d):
    bins = tiers.fit_proxy_bins(V.featured(spark, d), min_segment_rows=800)
    return bins.select("scope", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "n")


@check(
    "j4_proxy_tiers",
    f"""with s as {_SCORED}, b as (select property_segment as seg, quantile_cont(score, 0.25) as q25, quantile_cont(score, 0.5) as q50,
          quantile_cont(score, 0.75) as q75 from s group by all having count(score) >= 7000),
        g as (select quantile_cont(score, 0.25) as q25, quantile_cont(score, 0.5) as q50, quantile_cont(score, 0.75) as q75 from s)
        select row_order, case when score is null then 'core' when score <= coalesce(b.q25, g.q25) then 'entry'
          when score <= coalesce(b.q50, g.q50) then 'core' when score <= coalesce(b.q75, g.q75) then 'premium' else 'luxury' end as price_tier_proxy,
        case when score is null then 'default_core_missing_score' when b.q25 is not null then concat('segment:', property_segment)
          else 'global_fallback' end as price_tier_proxy_source
        from s left join b on property_segment = seg cross join g""",
)
def j4(spark, d):
    df = tiers.assign_proxy_tiers(V.featured(spark, d), min_segment_rows=7000)
    return df.select("row_order", "price_tier_proxy", "price_tier_proxy_source")


# ---------------------------------------------------------------- accuracy


def _metrics_sql(source: str, kind: str, name: str, group: str) -> str:
    """Metrics per group; a null prediction is a miss and leaves the median and R² undefined."""
    return f"""select {kind} as group_type, {name} as group_name, count(*) as n,
      round(coalesce(sum(case when ape <= 0.10e0 then 1e0 else 0e0 end) / nullif(count(*) filter (where sale_price > 0), 0), 0), 6) as ppe10,
      round(case when count(*) filter (where predicted_price is null) = 0 then median(ape) end, 6) as mdape,
      round(case when count(*) filter (where predicted_price is null) = 0 then
        1 - sum((sale_price - predicted_price) ** 2) / (var_pop(sale_price) * count(*)) end, 6) as r2
      from (select *, {V.APE_SQL} as ape from {source}) {group}"""


_VALID = "(select * from predictions where predicted_price is not null and sale_price > 0)"
_EVAL = f"""{_metrics_sql(_VALID, "'overall'", "'all'", "")}
    union all {_metrics_sql(_VALID, "'segment'", "property_segment", "group by property_segment having count(*) >= 2")}
    union all {_metrics_sql(_VALID, "'price_tier'", "price_tier", "group by price_tier having count(*) >= 2")}"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("ppe10", "mdape", "r2") if c in df.columns})


@check("p25_errors", f"select row_order, round(predicted_price - sale_price, 6) as prediction_error, round({V.APE_SQL}, 6) as abs_pct_error from predictions")
def p25(spark, d):
    df = evaluate.add_errors(V.predictions(spark, d))
    return df.select("row_order", F.round("prediction_error", 6).alias("prediction_error"), F.round("abs_pct_error", 6).alias("abs_pct_error"))


@check(
    "a1_hit_rate",
    f"select property_segment, round(avg(case when {V.APE_SQL} <= 0.10e0 then 1e0 else 0e0 end), 6) as ppe10 from {_VALID} group by all",
)
def a1(spark, d):
    ape = errors.abs_pct_error(F.col("sale_price"), F.col("predicted_price"))
    df = evaluate.valid_predictions(V.predictions(spark, d))
    return df.groupBy("property_segment").agg(F.round(errors.hit_rate(ape), 6).alias("ppe10"))


@check("a2_median_error", f"select property_segment, round(median({V.APE_SQL}), 6) as mdape, count(*) as n from {_VALID} group by all")
def a2(spark, d):
    df = evaluate.add_errors(evaluate.valid_predictions(V.predictions(spark, d)))
    return group_quantiles(df, ["property_segment"], "abs_pct_error", {"mdape": 0.5}).withColumn("mdape", F.round("mdape", 6))


@check("a3_evaluate", _EVAL)
def a3(spark, d):
    return _rounded(evaluate.evaluate_predictions(V.predictions(spark, d)))


@check(
    "a4_scorecard",
    f"""{_metrics_sql("predictions", "'segment'", "property_segment", "group by property_segment having count(*) >= 2")}
    union all {_metrics_sql("predictions", "'price_tier'", "price_tier", "group by price_tier having count(*) >= 2")}""",
)
def a4(spark, d):
    return _rounded(evaluate.segment_scorecard(V.predictions(spark, d)))


_BY_QUARTER = _metrics_sql(f"(select *, {V.QUARTER_SQL} as period from {_VALID})", "'p'", "period", "group by period")


@check("a5_temporal_scorecard", f"select group_name as period, n, ppe10, mdape, r2 from ({_BY_QUARTER})")
def a5(spark, d):
    return _rounded(evaluate.temporal_scorecard(V.predictions(spark, d)))


@check(
    "a6_temporal_stability",
    f"""select count(*) as temporal_period_count, round(stddev_pop(mdape), 4) as temporal_mdape_std, round(min(ppe10), 4) as temporal_ppe10_min,
        round(max(mdape), 4) as temporal_mdape_max, round(arg_max(mdape, group_name) - arg_min(mdape, group_name), 4) as temporal_mdape_last_minus_first
        from ({_BY_QUARTER})""",
)
def a6(spark, d):
    df = evaluate.temporal_stability(evaluate.temporal_scorecard(V.predictions(spark, d)))
    cols = ("temporal_mdape_std", "temporal_ppe10_min", "temporal_mdape_max", "temporal_mdape_last_minus_first")
    return df.select("temporal_period_count", *[F.round(c, 4).alias(c) for c in cols])


@check(
    "a7_segment_spread",
    f"""select round(max(ppe10) - min(ppe10), 5) as segment_ppe10_variance, max(ppe10) - min(ppe10) > 0.15e0 as segment_variance_flag
        from ({_EVAL}) where group_type = 'segment'""",
)
def a7(spark, d):
    df = evaluate.segment_spread(evaluate.evaluate_predictions(V.predictions(spark, d)))
    return df.withColumn("segment_ppe10_variance", F.round("segment_ppe10_variance", 5))


@check(
    "s10_metrics_document",
    f"""select group_type, group_name, concat('{{"n":', cast(n as varchar), ',"hits":', cast(cast(round(ppe10 * n) as bigint) as varchar), '}}') as metrics from ({_EVAL})""",
)
def s10(spark, d):
    doc = evaluate.metrics_json(evaluate.evaluate_predictions(V.predictions(spark, d)))
    back = F.from_json("metrics", "n bigint, ppe10 double, mdape double, r2 double")
    hits = F.round(back["ppe10"] * back["n"]).cast("bigint")
    return doc.select("group_type", "group_name", F.to_json(F.struct(back["n"].alias("n"), hits.alias("hits"))).alias("metrics"))


# ---------------------------------------------------------------- missingness and drift

_WATCHED = ["gross_square_feet", "year_built", "residential_units", "total_units", "distance_to_center_km"]


@check(
    "a8_missingness",
    f"""with s as (select coalesce(property_segment, 'UNKNOWN') as segment, coalesce({V.QUARTER_SQL}, 'unknown') as period, * from featured),
        c as (select segment, period, count(*) as n, count(gross_square_feet) as f1, count(residential_units) as f2, count(neighborhood) as f3 from s group by all)
        select segment, period, feature, n, n - filled as missing_n, round((n - filled) / cast(n as double), 6) as missing_rate from (
          select *, 'gross_square_feet' as feature, f1 as filled from c union all select *, 'residential_units', f2 from c
          union all select *, 'neighborhood', f3 from c union all select *, 'h3_price_lag', 0 from c)""",
)
def a8(spark, d):
    df = drift.feature_missingness(V.featured(spark, d), ["gross_square_feet", "residential_units", "neighborhood", "h3_price_lag"])
    return df.withColumn("missing_rate", F.round("missing_rate", 6))


_LONG = " union all ".join(
    f"select '{f}' as feature, cast({f} as double) as v, sale_date >= date '{V.SPLIT_DAY}' as is_cur from featured" for f in _WATCHED
)
_PSI = """q as (select feature, list_sort(list_distinct(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as cuts
      from vals where not is_cur group by feature),
    binned as (select vals.feature, is_cur, case when v = cuts[len(cuts)] then len(cuts) - 1
        when v < cuts[len(cuts)] and v >= cuts[1] then len(list_filter(cuts, lambda c: c <= v)) end as bin from vals join q using (feature)),
    h as (select feature, bin, count(*) filter (where not is_cur) as r, count(*) filter (where is_cur) as c from binned where bin is not null group by all),
    sh as (select feature, greatest(r / sum(r) over (partition by feature), 1e-6) as e, greatest(c / sum(c) over (partition by feature), 1e-6) as a from h),
    psi as (select feature, sum((a - e) * ln(a / e)) as psi from sh group by all)"""
_KS = """cnt as (select feature, v, count(*) filter (where not is_cur) as r, count(*) filter (where is_cur) as c from vals group by all),
    cum as (select feature, sum(r) over w / cast(sum(r) over (partition by feature) as double) as fr,
        sum(c) over w / cast(sum(c) over (partition by feature) as double) as fc from cnt
        window w as (partition by feature order by v rows between unbounded preceding and current row)),
    ks as (select feature, max(abs(fr - fc)) as ks from cum group by all)"""
_VALS = f"with vals as (select * from ({_LONG}) where v is not null)"
_STATUS = """case when psi >= 0.25e0 or ks >= 0.20e0 then 'alert' when psi >= 0.10e0 or ks >= 0.10e0 then 'warn' else 'ok' end"""
_DRIFT = f"""{_VALS}, {_PSI}, {_KS} select feature, count(*) filter (where not is_cur) as reference_n, count(*) filter (where is_cur) as current_n,
    round(max(psi.psi), 6) as psi, round(max(ks.ks), 6) as ks, {_STATUS.replace("psi ", "max(psi.psi) ").replace("ks ", "max(ks.ks) ")} as status
    from vals join psi using (feature) join ks using (feature) group by feature"""


def _sides(spark, d):
    df = V.featured(spark, d)
    split = F.lit(V.SPLIT_DAY).cast("date")
    return df.where(F.col("sale_date") < split), df.where(F.col("sale_date") >= split)


@check("d1_psi", f"{_VALS}, {_PSI} select feature, round(psi, 6) as psi from psi")
def d1(spark, d):
    ref, cur = _sides(spark, d)
    out = drift.stability_index(drift.long_features(ref, _WATCHED), drift.long_features(cur, _WATCHED), ["feature"])
    return out.select("feature", F.round("psi", 6).alias("psi"))


@check("d2_ks", f"{_VALS}, {_KS} select feature, round(ks, 6) as ks from ks")
def d2(spark, d):
    from valuary.operators.ordered import ks_distance

    ref, cur = _sides(spark, d)
    out = ks_distance(drift.long_features(ref, _WATCHED), drift.long_features(cur, _WATCHED), ["feature"])
    return out.select("feature", F.round("ks", 6).alias("ks"))


@check("d3_monitor_drift", _DRIFT)
def d3(spark, d):
    out = drift.monitor_drift(*_sides(spark, d), _WATCHED)
    return out.withColumns({"psi": F.round("psi", 6), "ks": F.round("ks", 6)})


@check(
    "w9_cumulative_share",
    f"""{_VALS}, cnt as (select feature, v, count(*) as n from vals group by all)
        select feature, v, round(sum(n) over (partition by feature order by v) / cast(sum(n) over (partition by feature) as double), 6) as share from cnt""",
)
def w9(spark, d):
    values = drift.long_features(V.featured(spark, d), _WATCHED)
    out = cumulative_counts(values, ["feature"], "v")
    return out.select("feature", F.col("value").alias("v"), F.round(F.col("through") / F.col("total"), 6).alias("share"))


@check(
    "l3_drift_order",
    f"select feature, status, cast(row_number() over (order by status, psi desc, ks desc) as int) as position from ({_DRIFT})",
)
def l3(spark, d):
    from pyspark.sql import Window

    # One row per watched feature, so the position can be numbered in one task.
    table = drift.order_by_status(drift.monitor_drift(*_sides(spark, d), _WATCHED))
    order = Window.orderBy("status", F.desc_nulls_last("psi"), F.desc_nulls_last("ks"))
    return table.select("feature", "status", F.row_number().over(order).alias("position"))


@check(
    "a22_drift_summary",
    f"""select case when count(*) = 0 then 'warn' when count(*) filter (where status = 'alert') > 0 then 'alert'
        when count(*) filter (where status = 'warn') > 0 then 'warn' else 'ok' end as status, count(*) as rows,
        count(*) filter (where status = 'alert') as alerts, count(*) filter (where status = 'warn') as warnings from ({_DRIFT})""",
)
def a22(spark, d):
    return drift.drift_summary(drift.monitor_drift(*_sides(spark, d), _WATCHED))


_CATS = " union all ".join(
    f"select '{f}' as feature, coalesce(cast({e} as varchar), '__missing__') as v, sale_date >= date '{V.SPLIT_DAY}' as is_cur from featured"
    for f, e in (("neighborhood", "neighborhood"), ("rate_regime_bucket", "rate_regime_bucket"), ("building_class", "building_class"))
)


def _category_rows(df):
    entries = [
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("v"))
        for f in ("neighborhood", "rate_regime_bucket", "building_class")
    ]
    return df.select(F.explode(F.array(*entries)).alias("e")).select("e.feature", "e.v")


_CAT_SHARES = f"""with c as (select feature, v, count(*) filter (where not is_cur) as r, count(*) filter (where is_cur) as a from ({_CATS}) group by all),
    s as (select *, r / cast(sum(r) over (partition by feature) as double) as rs, a / cast(sum(a) over (partition by feature) as double) as cs from c)"""


@check(
    "d4_categorical_drift",
    f"""{_CAT_SHARES} select feature, round(0.5e0 * sum(abs(cs - rs)), 6) as cat_tvd, round(sum(case when r = 0 then cs else 0 end), 6) as cat_unseen_rate
        from s group by feature""",
)
def d4(spark, d):
    ref, cur = _sides(spark, d)
    out = drift.categorical_drift(_category_rows(ref), _category_rows(cur), ["feature"])
    return out.withColumns({c: F.round(c, 6) for c in ("cat_tvd", "cat_unseen_rate")})


@check("j6_category_distance", f"{_CAT_SHARES} select feature, round(0.5e0 * sum(abs(cs - rs)), 6) as cat_tvd from s group by feature")
def j6(spark, d):
    return d4(spark, d).select("feature", "cat_tvd")


@check("j7_unseen_rate", f"{_CAT_SHARES} select feature, round(sum(case when r = 0 then cs else 0 end), 6) as cat_unseen_rate from s group by feature")
def j7(spark, d):
    return d4(spark, d).select("feature", "cat_unseen_rate")


@check(
    "u3_category_union",
    f"{_CAT_SHARES} select feature, v as category from s where r > 0 or a > 0",
)
def u3(spark, d):
    ref, cur = _sides(spark, d)
    both = _category_rows(ref).distinct().unionByName(_category_rows(cur).distinct())
    return both.select("feature", F.coalesce("v", F.lit("__missing__")).alias("category")).distinct()


_D5_TRAIN = f"(select * from featured where sale_date < date '{V.SPLIT_DAY}')"
# A segment with less than a fifth of the train rows has no reference of its own here.
_D5_LEAST = "(select count(*) // 5 from tr)"
_D5_TEST = f"(select *, {V.QUARTER_SQL} as period from featured where sale_date >= date '{V.SPLIT_DAY}')"


def _d5_sql() -> str:
    numeric = ["gross_square_feet", "year_built", "total_units"]
    text = ["neighborhood", "rate_regime_bucket"]

    def rows(source: str, cols: str, names: list[str], cast: str) -> str:
        return " union all ".join(f"select {cols}, '{f}' as feature, {cast.format(f)} as v from {source}" for f in names)

    num, cat = "cast({} as double)", "coalesce(cast({} as varchar), '__missing__')"
    keys = "scope, segment, period, feature"
    return f"""with tr as {_D5_TRAIN}, te as {_D5_TEST},
    scopes as (select segment, case when coalesce(n, 0) >= {_D5_LEAST} then segment else '__global__' end as scope from
        (select distinct property_segment as segment from te) left join (select property_segment as segment, count(*) as n from tr group by all) using (segment)),
    ref as (select scope, tr.* from tr join scopes on property_segment = segment where scope <> '__global__'
        union all select '__global__', tr.* from tr where exists (select 1 from scopes where scope = '__global__')),
    cur as (select scope, segment, te.* from te join scopes on property_segment = segment),
    refn as (select * from ({rows("ref", "scope", numeric, num)}) where v is not null),
    curn as (select * from ({rows("cur", "scope, segment, period", numeric, num)}) where v is not null),
    q as (select scope, feature, list_sort(list_distinct(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as cuts from refn group by all),
    grp as (select distinct {keys} from curn),
    vals as (select grp.*, v, false as is_cur from refn join grp using (scope, feature) union all select {keys}, v, true from curn),
    binned as (select {keys}, is_cur, cuts, case when v = cuts[len(cuts)] then len(cuts) - 1
        when v < cuts[len(cuts)] and v >= cuts[1] then len(list_filter(cuts, lambda c: c <= v)) end as bin from vals join q using (scope, feature)),
    h as (select {keys}, bin, count(*) filter (where not is_cur) as r, count(*) filter (where is_cur) as c from binned where bin is not null group by all),
    sh as (select {keys}, greatest(r / sum(r) over (partition by {keys}), 1e-6) as e, greatest(c / sum(c) over (partition by {keys}), 1e-6) as a from h),
    psi as (select {keys}, sum((a - e) * ln(a / e)) as psi from sh group by all),
    cnt as (select {keys}, v, count(*) filter (where not is_cur) as r, count(*) filter (where is_cur) as c from vals group by all),
    cum as (select {keys}, sum(r) over w as cr, sum(c) over w as cc, sum(r) over (partition by {keys}) as nr, sum(c) over (partition by {keys}) as nc from cnt
        window w as (partition by {keys} order by v rows between unbounded preceding and current row)),
    ks as (select {keys}, max(abs(cr / cast(nr as double) - cc / cast(nc as double))) as ks, max(nr) as nr, max(nc) as nc from cum group by all),
    catr as (select scope, feature, v, count(*) as r from ({rows("ref", "scope", text, cat)}) group by all),
    catc as (select {keys}, v, count(*) as c from ({rows("cur", "scope, segment, period", text, cat)}) group by all),
    cg as (select {keys}, sum(c) as nc from catc group by all), rg as (select scope, feature, sum(r) as nr from catr group by all),
    full_cat as (select {keys}, v, coalesce(r, 0) as r, coalesce(c, 0) as c, nr, nc
        from (select cg.*, v, r from cg join catr using (scope, feature)) full join catc using ({keys}, v) join rg using (scope, feature)
        join (select {keys}, nc as nc2 from cg) using ({keys})),
    fc as (select {keys}, v, r, c, max(nr) over (partition by scope, feature) as nr, sum(c) over (partition by {keys}) as nc from full_cat),
    cd as (select {keys}, 0.5e0 * sum(abs(c / cast(nc as double) - r / cast(nr as double))) as tvd, sum(case when r = 0 then c else 0 end) / cast(max(nc) as double) as unseen from fc group by all)
    select segment, period, feature, 'numeric' as feature_type, case when scope = '__global__' then 'global_fallback' else 'segment' end as baseline_scope,
        round(case when nr >= 20 and nc >= 20 then psi end, 6) as psi, round(case when nr >= 20 and nc >= 20 then ks end, 6) as ks,
        cast(null as double) as cat_tvd, cast(null as double) as cat_unseen_rate,
        case when nr < 20 or nc < 20 then 'ok' when psi >= 0.25e0 or ks >= 0.20e0 then 'alert' when psi >= 0.10e0 or ks >= 0.10e0 then 'warn' else 'ok' end as status
    from ks join psi using ({keys})
    union all select segment, period, feature, 'categorical', case when scope = '__global__' then 'global_fallback' else 'segment' end, null, null,
        round(tvd, 6), round(unseen, 6), case when tvd >= 0.35e0 or unseen >= 0.20e0 then 'alert' when tvd >= 0.20e0 or unseen >= 0.10e0 then 'warn' else 'ok' end from cd"""


@check("d5_drift_by_segment_time", _d5_sql())
def d5(spark, d):
    df = V.featured(spark, d)
    train = df.where(f"sale_date < date'{V.SPLIT_DAY}'")
    test = df.where(f"sale_date >= date'{V.SPLIT_DAY}'")
    out = drift.drift_by_segment_time(train, test, ["gross_square_feet", "year_built", "total_units", "neighborhood", "rate_regime_bucket"], min_reference=train.count() // 5)
    metrics = {c: F.round(c, 6) for c in ("psi", "ks", "cat_tvd", "cat_unseen_rate")}
    return out.withColumns(metrics).drop("reference_n", "current_n", "missing_rate_train", "missing_rate_test")


@check(
    "d5_slice_counts",
    f"""with tr as {_D5_TRAIN}, te as {_D5_TEST},
        n as (select property_segment as segment, count(*) as n, count(gross_square_feet) as f from tr group by all having count(*) >= {_D5_LEAST}),
        g as (select count(*) as n, count(gross_square_feet) as f from tr)
        select property_segment as segment, period, max(coalesce(n.f, g.f)) as reference_n, count(gross_square_feet) as current_n,
        round(1 - max(coalesce(n.f, g.f)) / cast(max(coalesce(n.n, g.n)) as double), 6) as missing_rate_train,
        round(1 - count(gross_square_feet) / cast(count(*) as double), 6) as missing_rate_test
        from te left join n on property_segment = segment cross join g group by property_segment, period""",
)
def d5_counts(spark, d):
    df = V.featured(spark, d)
    train = df.where(f"sale_date < date'{V.SPLIT_DAY}'")
    test = df.where(f"sale_date >= date'{V.SPLIT_DAY}'")
    out = drift.drift_by_segment_time(train, test, ["gross_square_feet"], min_reference=train.count() // 5)
    rates = {c: F.round(c, 6) for c in ("missing_rate_train", "missing_rate_test")}
    return out.withColumns(rates).select("segment", "period", "reference_n", "current_n", *rates)
