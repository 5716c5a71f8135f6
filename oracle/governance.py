"""Checks of model health, retraining, candidate comparison and run selection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from oracle import views as V
from oracle.registry import check
from valuary.operators import arena, evaluate, monitor

_APE = "abs((predicted_price - sale_price) / sale_price)"
_M = f"""(select run_id, 'overall' as group_type, 'all' as group_name, count(*) as n, avg(case when {_APE} <= 0.10e0 then 1e0 else 0e0 end) as ppe10,
      median({_APE}) as mdape from run_predictions group by run_id
    union all select run_id, 'segment', property_segment, count(*), avg(case when {_APE} <= 0.10e0 then 1e0 else 0e0 end), median({_APE})
      from run_predictions group by run_id, property_segment)"""
MIN_N = 5000


def _run_metrics(spark, d):
    """Long metrics table (overall and per segment) of the three runs, in one pass over their predictions."""
    df = V.run_predictions(spark, d)
    scope = F.array(
        F.struct(F.lit("overall").alias("group_type"), F.lit("all").alias("group_name")),
        F.struct(F.lit("segment").alias("group_type"), F.col("property_segment").alias("group_name")),
    )
    rows = df.select("run_id", F.explode(scope).alias("g"), F.col("sale_price").alias("y"), F.col("predicted_price").alias("p"))
    rows = rows.select("run_id", "g.group_type", "g.group_name", "y", "p")
    return evaluate.group_metrics(rows, ["run_id", "group_type", "group_name"])


@check(
    "d6_performance_status",
    f"""select n, round(ppe10, 6) as ppe10, round(mdape, 6) as mdape, case when ppe10 < 0.65e0 or mdape > 0.12e0 then 'alert'
        when ppe10 < 0.75e0 or mdape > 0.08e0 then 'warn' else 'ok' end as status from
        (select count(*) as n, avg(case when {V.APE_SQL} <= 0.10e0 then 1e0 else 0e0 end) as ppe10, median({V.APE_SQL}) as mdape
         from predictions where predicted_price is not null and sale_price > 0)""",
)
def d6(spark, d):
    df = monitor.evaluate_performance(V.predictions(spark, d))
    return df.select("n", F.round("ppe10", 6).alias("ppe10"), F.round("mdape", 6).alias("mdape"), "status")


_MODELS = f"""(select run_id, ppe10, mdape, case when run_id = 'c1' then 'alert' else 'warn' end as performance_status,
    case run_id when 'champion' then 0 else 3 end as drift_alerts, timestamp '2025-01-01 00:00:00' as trained_at from {_M} where group_type = 'overall')"""


@check(
    "d7_retrain_decision",
    f"""select run_id, 'retrain' as decision, true as should_retrain, cast(364 as int) as model_age_days,
        array_to_string(list_filter([case when performance_status = 'alert' then 'accuracy watch raised an alert' end,
          case when ppe10 < 0.75e0 then printf('ppe10 is %.4f, wanted at least 0.7500', ppe10) end,
          case when mdape > 0.08e0 then printf('mdape is %.4f, allowed up to 0.0800', mdape) end,
          case when drift_alerts > 0 then concat(cast(drift_alerts as varchar), ' drift alerts, allowed up to 0') end,
          'trained 364 days ago, allowed up to 90'], lambda x: x is not null), '; ') as reasons from {_MODELS}""",
)
def d7(spark, d):
    models = _run_metrics(spark, d).where("group_type = 'overall'").withColumns(
        {
            "performance_status": F.expr("case when run_id = 'c1' then 'alert' else 'warn' end"),
            "drift_alerts": F.expr("case run_id when 'champion' then 0 else 3 end"),
            "trained_at": F.lit("2025-01-01 00:00:00").cast("timestamp"),
        }
    )
    out = monitor.retrain_decision(models, datetime(2025, 12, 31, 12))
    return out.select("run_id", "decision", "should_retrain", "model_age_days", F.array_join("reasons", "; ").alias("reasons"))


_RUNS = """(select o_orderkey as run_no, concat('run_', cast(o_orderkey as string)) as run_id,
    case o_orderkey % 7 when 0 then 'smoke_check' when 1 then 'Train-DRYRUN-2' else concat('train_', cast(o_custkey as string)) end as run_name,
    case o_orderstatus when 'F' then 'FINISHED' when 'O' then 'finished' else 'RUNNING' end as status,
    case when o_orderkey % 5 = 0 then 'eval' when o_orderkey % 11 = 0 then null else 'train' end as run_kind,
    'h1' as hypothesis_id, case when o_orderkey % 13 = 0 then '' else 'feature' end as change_type,
    case when o_orderkey % 17 <> 0 then 'more data' end as change_summary, 'team' as owner, 'fs1' as feature_set_version,
    'rows' as dataset_version, cast(o_orderdate as date) as started_at, o_custkey % 50 as model_group from orders)"""


def _runs(spark, d):
    V.table(spark, d, "orders").createOrReplaceTempView("_orders_for_runs")
    return spark.sql(f"select * from {_RUNS.replace('from orders)', 'from _orders_for_runs)')}")


_ELIGIBLE = f"""select * from {_RUNS} where upper(status) = 'FINISHED' and not contains(lower(run_name), 'smoke') and not contains(lower(run_name), 'dryrun')
    and run_kind = 'train' and change_type <> '' and change_summary is not null"""


@check("p38_eligible_runs", f"select run_id, run_name, started_at from ({_ELIGIBLE})")
def p38(spark, d):
    return arena.eligible_runs(_runs(spark, d)).select("run_id", "run_name", "started_at")


@check(
    "p38_candidate_window",
    f"select run_id, started_at from ({_ELIGIBLE}) where run_id <> 'run_3' order by started_at desc, run_id limit 5",
)
def p38_window(spark, d):
    return arena.candidate_runs(_runs(spark, d), "run_3").select("run_id", "started_at")


@check(
    "s11_latest_run",
    f"""select model_group, run_id from {_RUNS} qualify row_number() over (partition by model_group order by
        contains(lower(run_name), 'smoke') or contains(lower(run_name), 'dryrun'), started_at desc, run_id desc) = 1""",
)
def s11(spark, d):
    return monitor.latest_run(_runs(spark, d), ["model_group"]).select("model_group", "run_id")


_NOTE = "case when o_orderkey % {k} = 0 then {v} else 'text' end"


@check(
    "p39_change_notes",
    f"""select o_orderkey, len(f) = 0 as is_complete, array_to_string(f, ',') as missing_fields from (select o_orderkey, list_filter([
        case when o_orderkey % 2 = 0 then 'problem_statement' end, case when o_orderkey % 3 = 0 then 'change_rationale' end,
        case when o_orderkey % 5 = 0 then 'risk_callouts' end], lambda x: x is not null) as f from orders)""",
)
def p39(spark, d):
    notes = V.table(spark, d, "orders").select(
        "o_orderkey",
        F.expr(_NOTE.format(k=2, v="''")).alias("problem_statement"),
        F.expr(_NOTE.format(k=3, v="null")).alias("change_rationale"),
        F.lit("text").alias("change_details"),
        F.lit("text").alias("before_after_metrics"),
        F.expr(_NOTE.format(k=5, v="''")).alias("risk_callouts"),
        F.lit("text").alias("rollback_pointer"),
    )
    out = arena.change_note_gaps(notes)
    return out.select("o_orderkey", "is_complete", F.array_join("missing_fields", ",").alias("missing_fields"))


_MAJOR = f"group_type = 'segment' and n >= {MIN_N}"
_SUMMARY = f"""(select run_id, max(ppe10) filter (where group_type = 'overall') as o_ppe10, max(mdape) filter (where group_type = 'overall') as o_mdape,
    coalesce(sum(n * mdape) filter (where {_MAJOR}) / sum(n) filter (where {_MAJOR}), max(mdape) filter (where group_type = 'overall')) as w_mdape,
    coalesce(sum(n * ppe10) filter (where {_MAJOR}) / sum(n) filter (where {_MAJOR}), max(ppe10) filter (where group_type = 'overall')) as w_ppe10,
    coalesce(min(ppe10) filter (where {_MAJOR}), max(ppe10) filter (where group_type = 'overall')) as floor_ppe10,
    case when count(*) filter (where {_MAJOR}) >= 2 then max(ppe10) filter (where {_MAJOR}) - min(ppe10) filter (where {_MAJOR}) else 0 end as gap,
    array_to_string(list_sort(list(group_name) filter (where {_MAJOR})), ',') as majors from {_M} group by run_id)"""
_POLICY = {"major_segment_min_n": MIN_N, "max_segment_ppe10_gap": 0.001}


@check("a16_weighted_metrics", f"select run_id, round(w_mdape, 6) as weighted_mdape, round(w_ppe10, 6) as weighted_ppe10 from {_SUMMARY}")
def a16(spark, d):
    df = arena.run_summary(_run_metrics(spark, d), _POLICY)
    return df.select("run_id", F.round("weighted_mdape", 6).alias("weighted_mdape"), F.round("weighted_ppe10", 6).alias("weighted_ppe10"))


@check(
    "a17_segment_gaps",
    f"""select run_id, round(gap, 6) as ppe10_gap, cast(gap > 0.001e0 as int) as fairness_alerts, round(floor_ppe10, 6) as ppe10_floor, majors as major_segments
        from {_SUMMARY}""",
)
def a17(spark, d):
    df = arena.run_summary(_run_metrics(spark, d), _POLICY)
    return df.select(
        "run_id",
        F.round("ppe10_gap", 6).alias("ppe10_gap"),
        "fairness_alerts",
        F.round("ppe10_floor", 6).alias("ppe10_floor"),
        F.array_join("major_segments", ",").alias("major_segments"),
    )


_DROPS = f"""(select a.run_id, greatest(0, max(b.ppe10 - a.ppe10)) as loss from {_M} a join {_M} b on a.group_name = b.group_name
    where a.group_type = 'segment' and b.group_type = 'segment' and b.run_id = 'champion' and a.run_id <> 'champion' and b.n >= {MIN_N} group by a.run_id)"""


@check("j5_segment_drops", f"select run_id, round(loss, 6) as max_major_segment_ppe10_drop from {_DROPS}")
def j5(spark, d):
    df = arena.segment_drops(_run_metrics(spark, d), "champion", _POLICY)
    return df.withColumn("max_major_segment_ppe10_drop", F.round("max_major_segment_ppe10_drop", 6))


_DECISIONS = f"""(select *, 0.5e0 * greatest(-1, least(1.5, gain / 0.05e0)) + 0.3e0 * greatest(-1, least(1.5, lift / 0.05e0))
      + 0.2e0 * greatest(0, least(1, 1 - (case when loss > 0 then greatest(0, least(0.6e0, loss / 0.04e0)) else 0 end)
        - (case when drift_delta > 0 then 0.2e0 else 0 end) - (case when fair_delta > 0 then 0.2e0 else 0 end))) as score,
      gain >= 0.05e0 and loss <= 0.02e0 and floor_ppe10 >= 0.24e0 and drift_delta <= 0 and fair_delta <= 0 as gate_pass
    from (select s.*, coalesce(loss, 0) as loss, (c.w_mdape - s.w_mdape) / c.w_mdape as gain, s.o_ppe10 - c.o_ppe10 as lift,
        case s.run_id when 'c1' then 0 else 2 end as drift_delta, cast(s.gap > 0.001e0 as int) - cast(c.gap > 0.001e0 as int) as fair_delta
      from {_SUMMARY} s cross join (select * from {_SUMMARY} where run_id = 'champion') c left join {_DROPS} p on p.run_id = s.run_id where s.run_id <> 'champion'))"""


def _decisions(spark, d):
    metrics = _run_metrics(spark, d)
    runs = spark.createDataFrame(
        [("champion", "v1", 1), ("c1", "v2", 1), ("c2", "v3", 3)], "run_id string, model_version string, drift_alerts int"
    )
    return arena.evaluate_candidates(metrics, "champion", runs, _POLICY)


@check(
    "d8_evaluate_candidates",
    f"""select run_id, case run_id when 'c1' then 'v2' else 'v3' end as model_version, round(score, 5) as score, gate_pass,
        round(gain, 5) as weighted_segment_mdape_improvement, round(lift, 5) as overall_ppe10_lift, round(loss, 5) as max_major_segment_ppe10_drop,
        round(floor_ppe10, 5) as min_major_segment_ppe10, cast(drift_delta as int) as drift_alert_delta, cast(fair_delta as int) as fairness_alert_delta,
        round(w_ppe10, 5) as tie_breaker_weighted_segment_ppe10, round(o_mdape, 5) as tie_breaker_overall_mdape from {_DECISIONS}""",
)
def d8(spark, d):
    df = _decisions(spark, d)
    return df.withColumns({c: F.round(c, 5) for c, t in df.dtypes if t == "double"})


@check(
    "w10_rank_candidates",
    f"""select run_id, cast(row_number() over w as int) as "rank", row_number() over w = 1 and gate_pass as is_winner from {_DECISIONS}
        window w as (order by gate_pass desc, score desc, w_ppe10 desc, o_mdape, run_id)""",
)
def w10(spark, d):
    return arena.rank_candidates(_decisions(spark, d)).select("run_id", "rank", "is_winner")


@check(
    "d9_gate_table",
    f"""with top as (select * from {_DECISIONS} order by gate_pass desc, score desc, w_ppe10 desc, o_mdape, run_id limit 1)
        select run_id, gate_key, status, threshold, round(actual, 5) as actual from (
        select run_id, 'weighted_segment_mdape_improvement' as gate_key, case when gain >= 0.05e0 then 'pass' else 'fail' end as status, '>= 0.05' as threshold, cast(gain as double) as actual from top
        union all select run_id, 'max_major_segment_ppe10_drop', case when loss <= 0.02e0 then 'pass' else 'fail' end, '<= 0.02', loss from top
        union all select run_id, 'major_segment_ppe10_floor', case when floor_ppe10 >= 0.24e0 then 'pass' else 'fail' end, '>= 0.24', floor_ppe10 from top
        union all select run_id, 'no_new_drift_alerts', case when drift_delta <= 0 then 'pass' else 'fail' end, '<= 0', drift_delta from top
        union all select run_id, 'no_new_fairness_alerts', case when fair_delta <= 0 then 'pass' else 'fail' end, '<= 0', fair_delta from top)""",
)
def d9(spark, d):
    table = arena.gate_table(arena.rank_candidates(_decisions(spark, d)))
    return table.select("run_id", "gate_key", "status", "threshold", F.round("actual", 5).alias("actual"))


@check(
    "d10_champion_quality",
    f"""select run_id, case when ppe10 < 0.24e0 or mdape > 0.30e0 then 'fail' else 'pass' end as status from {_M} where run_id = 'champion' and group_type = 'overall'""",
)
def d10(spark, d):
    return arena.champion_quality(_run_metrics(spark, d), "champion").select("run_id", "status")


@check(
    "d11_compare_models",
    f"""select a.group_type, a.group_name, a.n as left_n, round(b.ppe10 - a.ppe10, 6) as delta_ppe10, round(b.mdape - a.mdape, 6) as delta_mdape
        from {_M} a join {_M} b on a.group_type = b.group_type and a.group_name = b.group_name where a.run_id = 'champion' and b.run_id = 'c1'""",
)
def d11(spark, d):
    metrics = _run_metrics(spark, d)
    out = evaluate.compare_models(metrics.where("run_id = 'champion'"), metrics.where("run_id = 'c1'"))
    return out.select(
        "group_type", "group_name", "left_n", F.round("delta_ppe10", 6).alias("delta_ppe10"), F.round("delta_mdape", 6).alias("delta_mdape")
    )
