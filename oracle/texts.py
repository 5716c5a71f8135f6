"""Checks of text, usage and session operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from oracle import views as V
from oracle.registry import check
from valuary.operators import text, usage
from valuary.session import scratch_path
from valuary.streaming import usage as stream_usage

_MODELS = "(values " + ", ".join(f"('{m}', {i}, {o}, {p:.8f}e0, {q:.8f}e0)" for m, i, o, p, q in text.MODEL_TABLE) + ") m(model, input_limit, output_limit, input_price, output_price)"
_MODEL_OF = "case doc_id % 4 when 0 then 'gpt-5-nano' when 1 then 'gpt-4o' when 2 then 'gpt-3.5-turbo' else 'other' end"
_LIMITS = f"""(select d.doc_id, length(d.text) // 4 as tok, coalesce(m.input_limit, 4000) as il, coalesce(m.output_limit, 1000) as ol,
    coalesce(m.input_price, 0.001e0) as ip, coalesce(m.output_price, 0.002e0) as op from (select *, {_MODEL_OF} as model from texts) d left join {_MODELS} on d.model = m.model)"""


def _docs(spark, d):
    return V.documents(spark, d).withColumn("model", F.expr(_MODEL_OF))


@check("t1_token_cost", f"select doc_id, cast(tok as bigint) as input_tokens, cast(il as int) as input_limit, round(tok / 1000e0 * ip + 500 / 1000e0 * op, 9) as cost from {_LIMITS}")
def t1(spark, d):
    df = text.add_model_limits(_docs(spark, d)).withColumn("input_tokens", text.token_estimate(F.col("text")))
    cost = text.estimated_cost(F.col("input_tokens"), F.lit(500))
    return df.select("doc_id", "input_tokens", "input_limit", F.round(cost, 9).alias("cost"))


@check(
    "t2_truncate",
    "select doc_id, sha256(case when length(text) <= 800 then text else concat(left(text, 797), '...') end) as cut from texts",
)
def t2(spark, d):
    return V.documents(spark, d).select("doc_id", F.sha2(text.truncate_to_tokens(F.col("text"), 200), 256).alias("cut"))


@check(
    "t3_request_budget",
    f"""select doc_id, tok <= il and cost <= 0.005e0 as within_budget, case when tok > il then concat(tok::varchar, ' input tokens, allowed up to ', il::varchar)
        when cost > 0.005e0 then printf('request costs $%.4f, allowed up to $0.0050', cost)
        else concat('fits: ', tok::varchar, ' of ', il::varchar, printf(' input tokens, costs $%.4f of $0.0050', cost)) end as budget_reason
        from (select *, tok / 1000e0 * ip + least(1200, ol) / 1000e0 * op as cost from {_LIMITS})""",
)
def t3(spark, d):
    return text.add_request_budget(_docs(spark, d), cost_limit=0.005).select("doc_id", "within_budget", "budget_reason")


_REDACT = "text"
for _p in text.REDACTED_PHRASES:
    _REDACT = f"regexp_replace({_REDACT}, '(?i){_p}', '[REDACTED]', 'g')"


@check("t4_redact", f"select doc_id, {_REDACT} like '%[REDACTED]%' as has_redaction, sha256({_REDACT}) as redacted from texts")
def t4(spark, d):
    clean = text.redact(F.col("text"))
    return V.documents(spark, d).select(
        "doc_id", F.contains(clean, F.lit("[REDACTED]")).alias("has_redaction"), F.sha2(clean, 256).alias("redacted")
    )


_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_CLEAN = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_BLOCK = " or ".join(f"regexp_matches(clean, '(?i){p}')" for p in text.BLOCKED_PATTERNS)


@check(
    "t5_safety_label",
    f"""select doc_id, prompt_hash, inj as prompt_injection_blocked, over as token_budget_exceeded, inj or over as blocked,
        case when inj then 'safety_blocked' when over then 'budget_exceeded' end as blocked_reason from
        (select doc_id, left(sha256(clean), 16) as prompt_hash, ({_BLOCK}) as inj, ceil(length(text) / 4e0) > 1600 as over from (select *, {_CLEAN} as clean from texts))""",
)
def t5(spark, d):
    cols = ("prompt_hash", "prompt_injection_blocked", "token_budget_exceeded", "blocked", "blocked_reason")
    return text.add_safety_label(V.documents(spark, d)).select("doc_id", *cols)


def _chunks_sql() -> str:
    """The chunk rule, one step of recursion a chunk."""
    size, overlap = text.CHUNK_SIZE, text.CHUNK_OVERLAP
    quoted = ["'" + sep.replace("\n", "' || chr(10) || '") + "'" for sep in text.SEPARATORS]
    last = lambda q: f"length(w) - instr(reverse(w), reverse({q})) + 1 - length({q})"
    borders = " ".join(f"when instr(w, {q}) > 0 and {last(q)} > 0 then {last(q)} + length({q})" for q in quoted)
    step = f"""(select doc_id, text, no, b, s, case when s + {size} >= length(text) then length(text) else b + (case {borders} else length(w) end) end as e
        from (select *, substr(text, b + 1, s + {size} - b) as w from (select *, greatest(0, b - {overlap}) as s from {{0}})))"""
    first = step.format("(select doc_id, text, 0 as no, 0 as b from texts)")
    following = step.format("(select doc_id, text, no + 1 as no, e as b from c where e < length(text))")
    return f"""with recursive c as (select * from {first} union all select * from {following})
        select doc_id, cast(no as int) as chunk_no, cast(s as int) as "start", cast(e as int) as "end", sha256(substr(text, s + 1, e - s)) as chunk_hash from c"""


@check("t6_chunks", _chunks_sql())
def t6(spark, d):
    rows = text.chunk_documents(V.documents(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", "chunk_no", "start", "end", F.sha2("chunk", 256).alias("chunk_hash"))


_MEMO = """case conv_id % 6 when 0 then to_json(named_struct('summary', text, 'investment_thesis', role, 'key_risks', array('a', text), 'confidence_level', 'High'))
    when 1 then to_json(named_struct('summary', text, 'investment_thesis', role, 'key_risks', role, 'upside_catalysts', 'rent', 'confidence_level', 'certain'))
    when 2 then to_json(named_struct('summary', text, 'key_risks', array(role)))
    when 3 then concat('not json ', text)
    when 4 then to_json(named_struct('summary', text, 'investment_thesis', role, 'key_risks', array(role), 'confidence_level', turn))
    else to_json(named_struct('summary', text, 'investment_thesis', role, 'key_risks', array('x'), 'upside_catalysts', array('y', 'z'))) end"""


@check(
    "t7_memo_check",
    """select conv_id, turn, conv_id % 6 in (0, 1, 5) as is_valid, case when conv_id % 6 in (0, 1, 5) then sha256(text) end as summary,
       case conv_id % 6 when 0 then sha256(concat('a|', text)) when 1 then sha256(role) when 5 then sha256('x') end as key_risks,
       case conv_id % 6 when 0 then 'No catalysts identified' when 1 then 'rent' when 5 then 'y|z' end as upside_catalysts,
       case conv_id % 6 when 0 then 'High' when 1 then 'medium' when 5 then 'medium' end as confidence_level from conversations""",
)
def t7(spark, d):
    memos = V.table(spark, d, "conversations").withColumn("memo", F.expr(_MEMO)).select("conv_id", "turn", "memo")
    out = text.add_memo_check(memos)
    return out.select(
        "conv_id",
        "turn",
        "is_valid",
        F.sha2("summary", 256).alias("summary"),
        F.sha2(F.array_join("key_risks", "|"), 256).alias("key_risks"),
        F.array_join("upside_catalysts", "|").alias("upside_catalysts"),
        "confidence_level",
    )


def _intent_sql() -> str:
    scores = ", ".join(
        f"round({base}e0 + case when regexp_matches(lower(text), '{words}') then {bonus}e0 else 0e0 end, 2) as s{i}"
        for i, (_, base, bonus, words) in enumerate(text.INTENTS)
    )
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(text.INTENTS))) + ")"
    pick = " ".join(f"when s{i} = top then '{name}'" for i, (name, *_) in enumerate(text.INTENTS))
    return f"""(select conv_id, turn, role, text, least(0.95e0, greatest(0.2e0, top)) as confidence, case {pick} end as intent
        from (select *, {top} as top from (select *, {scores} from questions)))"""


_INTENT = _intent_sql()


@check(
    "t8_intents",
    f"""select conv_id, turn, intent, round(confidence, 2) as confidence, confidence < 0.45e0 or intent = 'unknown' as low_confidence,
        nullif(regexp_extract(text, '(?i)\\bval_[a-z0-9_]+\\b', 0), '') as valuation_id, nullif(regexp_extract(text, '(?i)\\bproposal_[a-z0-9_]+\\b', 0), '') as proposal_id,
        nullif(regexp_extract(lower(text), '\\b(7|30|90|180)d\\b', 0), '') as "window" from {_INTENT}""",
)
def t8(spark, d):
    df = text.add_entities(text.add_intent(V.questions(spark, d)))
    return df.select(
        "conv_id", "turn", "intent", F.round("confidence", 2).alias("confidence"), "low_confidence", "valuation_id", "proposal_id", "window"
    )


@check(
    "t8_intents_on_page",
    f"""select conv_id, turn, case when ok then intent else 'promotion_status' end as intent, round(case when ok then confidence else least(confidence, 0.6e0) end, 2) as confidence,
        not ok as downgraded_for_page from (select *, intent in ('what_changed_recently', 'promotion_status', 'monitoring_remediation', 'unknown') as ok from {_INTENT})""",
)
def t8_page(spark, d):
    df = text.add_intent(V.questions(spark, d), page="governance")
    return df.select("conv_id", "turn", "intent", F.round("confidence", 2).alias("confidence"), "downgraded_for_page")


@check(
    "t8_intent_mix",
    f"select role, intent, count(*) as n, round(count(*) / cast(sum(count(*)) over (partition by role) as double), 6) as share from {_INTENT} group by role, intent",
)
def t8_mix(spark, d):
    return text.intent_mix(text.add_intent(V.questions(spark, d)), "role").withColumn("share", F.round("share", 6))


@check("t9_duplicate_prompts", "select left(sha256(text), 16) as prompt_hash, count(*) as n from documents group by all having count(*) > 1")
def t9(spark, d):
    return text.duplicate_prompts(V.table(spark, d, "documents"))


# ---------------------------------------------------------------- usage and sessions

_STATS = """count(*) as total_calls, round(count(*) filter (where success) * 100e0 / count(*), 6) as success_rate, round(sum(cost_estimate), 4) as total_cost,
    round(avg(latency_ms), 6) as avg_latency_ms, cast(sum(input_tokens) as bigint) as total_input_tokens, cast(sum(output_tokens) as bigint) as total_output_tokens"""


def _rounded_stats(df):
    return df.withColumns(
        {"success_rate": F.round("success_rate", 6), "total_cost": F.round("total_cost", 4), "avg_latency_ms": F.round("avg_latency_ms", 6)}
    )


@check("a20_usage_stats", f"select {_STATS} from audit_log where timestamp >= timestamp '2024-01-05 00:00:00'")
def a20(spark, d):
    return _rounded_stats(usage.usage_stats(V.audit_log(spark, d), datetime(2024, 1, 5)))


@check("a20_usage_by_model", f"select model, {_STATS} from audit_log group by model")
def a20_by_model(spark, d):
    return _rounded_stats(usage.usage_stats(V.audit_log(spark, d), by=["model"]))


@check("a21_daily_costs", "select cast(timestamp as date) as day, round(sum(cost_estimate), 4) as total_cost from audit_log group by all")
def a21(spark, d):
    return usage.daily_costs(V.audit_log(spark, d)).withColumn("total_cost", F.round("total_cost", 4))


@check(
    "w11_last_turns",
    """select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as turns_back from events
       qualify turns_back <= 8""",
)
def w11(spark, d):
    df = V.table(spark, d, "events").select("user_id", "event_id", "ts")
    return usage.last_turns(df, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "turns_back")


@check(
    "st1_daily_usage",
    """select cast(timestamp as date) as day, model, count(*) as calls, round(sum(cost_estimate), 4) as cost,
       cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from audit_log group by all""",
)
def st1(spark, d):
    return stream_usage.daily_usage(V.audit_log(spark, d)).withColumn("cost", F.round("cost", 4))


# A row lands up to 20 hours after its time, in one of three deliveries by the time it lands.
_LANDED = "timestamp + make_interval(0, 0, 0, 0, cast(event_id % 21 as int), 0, 0)"


@check(
    "st1_stream",
    """select cast(timestamp as date) as day, model, count(*) as calls, round(sum(cost_estimate), 4) as cost,
       cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from audit_log
       where date_trunc('day', timestamp) + interval 2 day <= (select max(timestamp) from audit_log) group by all""",
)
def st1_stream(spark, d):
    """The roll-up as a stream, taken up from its checkpoint after each of three deliveries."""
    log = V.audit_log(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    landed = log.withColumn("_at", F.expr(_LANDED).cast("double"))
    low, high = landed.agg(F.min("_at"), F.max("_at")).first()
    part = F.least(F.floor((F.col("_at") - (low or 0)) * 3 / ((high or 0) - (low or 0) + 1)), F.lit(2))
    landed = landed.withColumn("_part", part).drop("_at")
    work = scratch_path(spark, "daily-usage")
    for i in range(3):
        landed.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(f"{work}/landing")
        days = stream_usage.roll_up_landed(spark, f"{work}/landing", log.schema, f"{work}/days", f"{work}/checkpoint")
    return days.withColumn("cost", F.round("cost", 4))


@check(
    "st2_sessions",
    """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started_at, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as expires_at, count(*) as turns from
       (select *, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as sid from
         (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval 30 minute, true) as gap from events)) group by user_id, sid""",
)
def st2(spark, d):
    out = stream_usage.sessions(V.table(spark, d, "events"), "user_id", "ts")
    return out.select(
        "user_id",
        F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
        "turns",
    )
