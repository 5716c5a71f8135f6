"""Secret scans: base patterns, and weak credential parts reported only where complementary parts co-occur.

Native Spark only. Matches are cut out of the text as gaps and lengths (one row a match, without the text);
running sums give code point positions. Weak parts (an identifier, a random-looking string, an endpoint) are
then linked by interval semi-joins: spans are dealt to scopes of `scope` code points and meet others of the
same document whose gap to them is at most that long. No pairs are emitted. The rules:

* a weak secret is reported with a strong access key near it, or with a weak identifier and an endpoint near it;
* a weak identifier is reported with a secret near it (base or reported weak one);
* an endpoint is reported with a secret and an identifier or access key near it.

Defined results: a null or empty text has no spans; equal rows are scanned one by one; the keywords' letters
match in either ASCII case; extra columns are carried only by `redact`. `redact` cuts islands out of a text
one after another, so its work on one text follows length times number of islands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuary.llm import sql
from valuary.llm.registry import query, table
from valuary.session import stage_table


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns and least lengths, in the order in which kinds are listed.
KEYWORDS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
BASE_KINDS = ("assign", "access", "hex")

_OWNERS = "|".join(any_case(w) for w in ("client", "account", "tenant", "user", "access", "app"))
_FIELDS = "|".join(any_case(w) for w in ("id", "name", "key_?id"))
IDENTIFIER = rf"""(?:{_OWNERS})[_-]?(?:{_FIELDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{{4,}}"""
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]{4,}"""
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
PART_KINDS = ("part_secret", "part_id", "part_endpoint")
KINDS = BASE_KINDS + PART_KINDS
SCOPE = 300


def _matches(text: Column, pattern: str, value_group: int | None = None, mixed: bool = False) -> Column:
    """Array of (gap before the match, its length, whether it counts), in text order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    if value_group is not None:
        ok = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda v: F.char_length(v) >= MIN_VALUE
        )
    elif mixed:
        ok = F.transform(found, lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"))
    else:
        ok = F.transform(found, lambda v: F.lit(True))
    zipped = F.arrays_zip(
        F.transform(gaps, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("len"), ok.alias("ok")
    )
    return F.when(text.rlike(pattern), zipped)


def scan(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """One staged row per row of `docs`: a row number, the kept columns and the matches of every kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weak = text.rlike(RANDOM) & (text.rlike(ENDPOINT) | text.rlike(IDENTIFIER) | text.rlike("AKIA"))
    linked = weak | text.rlike(ASSIGN) & (text.rlike(ENDPOINT) | text.rlike(IDENTIFIER))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        *keep,
        _matches(text, ASSIGN, value_group=2).alias("assign"),
        _matches(text, ACCESS).alias("access"),
        _matches(text, HEX).alias("hex"),
        F.when(weak, _matches(text, RANDOM, mixed=True)).alias("part_secret"),
        F.when(linked, _matches(text, IDENTIFIER)).alias("part_id"),
        F.when(linked, _matches(text, ENDPOINT)).alias("part_endpoint"),
    )
    return stage_table(found, "secret-matches")


def positions(found: DataFrame) -> DataFrame:
    """One row per match that counts: row, kind (its number), start, end (code points, end exclusive)."""
    each = [
        found.where(F.size(k) > 0).select("row", F.lit(i).alias("kind"), F.posexplode(k).alias("n", "m")).select(
            "row", "kind", "n", "m.gap", "m.len", "m.ok"
        )
        for i, k in enumerate(KINDS)
    ]
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    spans = reduce(DataFrame.unionByName, each).withColumn("end", end).where("ok")
    return spans.select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _near(spans: DataFrame, others: DataFrame, scope: int, how: str = "left_semi", reach: int | None = None) -> DataFrame:
    """The spans with (left_semi) or without (left_anti) one of the others at most `reach` away in the same row."""
    reach = scope if reach is None else reach
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    left = spans.withColumn("_scope", bins(F.col("start") - reach, F.col("end") + reach))
    right = others.select(
        F.col("row").alias("_row"), F.col("start").alias("_start"), F.col("end").alias("_end"), bins(F.col("start"), F.col("end")).alias("_bin")
    )
    on = (F.col("row") == F.col("_row")) & (F.col("_scope") == F.col("_bin"))
    on &= (F.col("_start") < F.col("end") + reach) & (F.col("start") < F.col("_end") + reach)
    hits = left.join(right, on, "left_semi").select("row", "kind", "start", "end").distinct()
    if how == "left_semi":
        return hits
    return spans.join(hits, ["row", "kind", "start", "end"], "left_anti")


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, and the weak parts that complementary parts confirm."""
    of = lambda *kinds: spans.where(F.col("kind").isin([KINDS.index(k) for k in kinds]))
    base = of(*BASE_KINDS)
    # A string inside a base span is reported already.
    strings = _near(of("part_secret"), base, scope, "left_anti", reach=0)
    with_id = _near(_near(strings, of("part_id"), scope), of("part_endpoint"), scope)
    secret = with_id.unionByName(_near(strings, of("access"), scope)).distinct()
    secrets = of("assign", "hex").unionByName(secret)
    identifier = _near(of("part_id"), secrets, scope)
    endpoint = _near(_near(of("part_endpoint"), secrets, scope), of("part_id", "access"), scope)
    return reduce(DataFrame.unionByName, [base, secret, identifier, endpoint])


def secret_spans(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All reported spans of a staged scan."""
    return link_parts(stage_table(positions(found), "secret-spans"), scope)


def summarise(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Per row of the scan: counts of the base kinds, hash of the base spans, all spans as text."""
    said = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])
    per_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_spans"),
    )
    joined = found.select("row", "doc_id").join(per_row, "row", "left")
    all_spans = F.coalesce("_spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(all_spans, lambda s: s["kind"] < len(BASE_KINDS))
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(all_spans, said), ",").alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """`docs` with every reported secret and access key cut out of its text; identifiers and endpoints stay.
    `n_chars`, where there is one, follows the text. Rows without a secret are returned as they are."""
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    found = scan(docs, whole)
    hide = [KINDS.index(k) for k in ("assign", "access", "hex", "part_secret")]
    spans = secret_spans(found, scope).where(F.col("kind").isin(hide))
    in_order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("_before"), 0).otherwise(1)).over(in_order)
    islands = (
        spans.withColumn("_before", before).withColumn("_island", island)
        .groupBy("row", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    )
    has = reduce(Column.__or__, [F.coalesce(F.size(KINDS[i]) > 0, F.lit(False)) for i in hide])
    clean = found.where(~has).select("doc.*")
    text = F.col("doc.text")
    kept_before = lambda s, i: F.concat(
        F.substring(
            text,
            F.when(i > 0, F.element_at("_cut", F.greatest(i, F.lit(1)))["end"]).otherwise(0).cast("int") + 1,
            (s["start"] - F.when(i > 0, F.element_at("_cut", F.greatest(i, F.lit(1)))["end"]).otherwise(0)).cast("int"),
        ),
        F.lit(mask),
    )
    tail = F.substring(text, F.element_at("_cut", -1)["end"].cast("int") + 1, F.char_length(text))
    cut = F.when(F.col("_cut").isNull(), text).otherwise(F.concat(F.array_join(F.transform("_cut", kept_before), ""), tail))
    masked = found.where(has).select("row", "doc").join(islands, "row", "left").withColumn("_text", cut)
    masked = masked.select(
        *[
            F.col("_text").alias(c) if c == "text"
            else F.char_length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col(f"doc.`{c}`")
            for c in names
        ]
    )
    return clean.unionByName(masked)


PATTERNS = list(zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM, IDENTIFIER, ENDPOINT)))


@query("op5_secret_scans", sql.secret_scans(PATTERNS, "assign", MIN_VALUE, "part_secret", SCOPE))
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), "doc_id")
    return summarise(found, secret_spans(found))
