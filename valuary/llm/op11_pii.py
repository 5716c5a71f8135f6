"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust their score.

Native Spark only. One scan turns each text into proposals and context words as gaps and lengths, each proposal
with the score that its pattern and validator give it (Luhn for cards, mod 97 for bank accounts, ranges for
addresses); running sums give code point positions. Two windows over a text's spans, one in each direction, then
find the nearest context words: a word of the kind's own list within `reach` code points adds to the score, a word
of doubt takes from it. The base kinds (email, ip, card, phone) are always reported, the added kinds (iban,
short_card, national_id, local_phone) from `min_score` on, and those without a checksum of their own only where no
base span overlaps. No text is copied per span and no pairs are formed.

Defined results: a null or empty text has no spans; equal rows are scanned one by one; spans of different added
kinds may overlap; leading zeros of address parts don't count; a very long text or run of characters is scanned in
linear time (possessive patterns, runs entered at their start only); `key` columns named by the caller and doc_id
are carried, others dropped; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuary.llm import sql
from valuary.llm.op5_secret_scans import any_case
from valuary.llm.registry import query, table
from valuary.session import stage_table

# The kinds in the order in which spans are listed; the base kinds come first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "short_card", "national_id", "local_phone")

# The patterns as they are stated, and in Spark's form: the same matches without backtracking over long runs.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
EMAIL_SCAN = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
IP_SCAN = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]([\x20-]?[0-9])+"
CARD_SCAN = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds; they begin with the character in front of the span (a blank stands before the text).
IBAN = r"[^A-Za-z0-9][A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
NATIONAL_ID = r"[^0-9A-Za-z-][0-9]{3}-[0-9]{2}-[0-9]{4}"
LOCAL_PHONE = r"[^0-9A-Za-z+][(]?[0-9][\x20().0-9-]{5,30}[0-9]"
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
VALID_IP = rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$"

# Context words by what they speak of (a word may go on), and words of doubt.
CONTEXT = {
    "mail": ("email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"),
    "net": ("ip", "host", "server", "address", "adresse", "serveur", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "handy", "anruf", "appel", "llam"),
    "bank": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "person": ("ssn", "social security", "passport", "ausweis", "identit", "dni"),
    "doubt": ("example", "sample", "test", "order", "invoice", "version", "isbn"),
}
TOPICS = tuple(CONTEXT)
MARKS = [f"[^A-Za-z](?:{'|'.join(any_case(w) for w in words)})" for words in CONTEXT.values()]


@dataclass(frozen=True)
class Scores:
    """Scores of 100: what a confirmed proposal of each kind has (in the order of KINDS), and what moves it."""

    confirmed: tuple[int, ...] = (80, 60, 80, 70, 90, 50, 45, 45)
    topic: tuple[str, ...] = ("mail", "net", "card", "phone", "bank", "card", "person", "phone")
    near: int = 15
    doubt: int = 15
    min_score: int = 60
    reach: int = 40


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    back = F.reverse(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1))),
        lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (capitals and digits) leaves the remainder 1: its first four characters go behind,
    letters count from 10."""
    solid = F.concat(F.substring(account, F.lit(5), F.char_length(account)), F.substring(account, 1, 4))
    values = F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(solid), F.lit(1))),
        lambda i: F.ascii(F.substring(solid, i, F.lit(1))),
    )
    step = lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)
    return F.aggregate(values, F.lit(0), step) == 1


def _proposals(text: Column, pattern: str, found: Column, kind, lead: int = 0) -> Column:
    """Array of (gap before the match, its length, characters at its front that aren't part of the span, kind or
    null where a validator rejects it)."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    shaped = F.transform(
        zipped,
        lambda m: F.struct(
            F.char_length(m["gap"]).alias("gap"),
            F.char_length(m["hit"]).alias("len"),
            F.lit(lead).alias("lead"),
            kind(m["hit"]).cast("int").alias("kind"),
        ),
    )
    return F.when(F.size(found) > 0, shaped)


def _card_kind(hit: Column) -> Column:
    n = F.char_length(_digits(hit))
    kind = F.when(n.between(16, 19), KINDS.index("card")).when(n.between(12, 15), KINDS.index("short_card"))
    return F.when(n.between(12, 19), F.when(luhn(_digits(hit)), kind))


def scan(docs: DataFrame, *key: str) -> DataFrame:
    """One staged row per row of `docs`: a row number, `key`, and the proposals and context words it holds."""
    docs = docs.select(
        F.monotonically_increasing_id().alias("row"), *key, F.coalesce(F.col("text"), F.lit("")).alias("_text")
    ).withColumn("_led", F.concat(F.lit(" "), F.col("_text")))
    text, led = F.col("_text"), F.col("_led")
    at = KINDS.index
    all_of = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    # name: text, pattern, when it can match at all, kind of a match, characters in front of the span
    always = lambda name: lambda hit: F.lit(at(name))
    sources = {
        "email": (text, EMAIL_SCAN, F.contains(text, F.lit("@")), always("email"), 0),
        "ip": (text, IP_SCAN, text.rlike(r"[0-9]\.[0-9]"), lambda h: F.when(h.rlike(VALID_IP), at("ip")), 0),
        "card": (text, CARD_SCAN, text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"), _card_kind, 0),
        "phone": (
            text, PHONE, F.contains(text, F.lit("+")),
            lambda h: F.when(F.char_length(_digits(h)).between(8, 15), at("phone")), 0,
        ),
        "iban": (
            led, IBAN, led.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"),
            lambda h: F.when(mod97(F.regexp_replace(h, "[^A-Z0-9]", "")), at("iban")), 1,
        ),
        "national_id": (led, NATIONAL_ID, led.rlike("[0-9]-[0-9]{2}-[0-9]"), always("national_id"), 1),
        "local_phone": (
            led, LOCAL_PHONE, led.rlike(r"[0-9][\x20().0-9-]{5}"),
            lambda h: F.when(F.char_length(_digits(h)).between(7, 12), at("local_phone")), 1,
        ),
    }
    hits = docs.select(
        "*", *[F.when(may, all_of(t, p)).alias(f"_{name}") for name, (t, p, may, _, _) in sources.items()]
    )
    shaped = hits.select(
        "row", *key, "_led",
        *[_proposals(t, p, F.col(f"_{name}"), kind, lead).alias(name) for name, (t, p, _, kind, lead) in sources.items()],
    )
    some = reduce(
        Column.__or__,
        [F.coalesce(F.exists(F.col(name), lambda m: m["kind"].isNotNull()), F.lit(False)) for name in sources],
    )
    shaped = shaped.select("*", *[F.when(some, all_of(led, p)).alias(f"_about_{t}") for t, p in zip(TOPICS, MARKS)])
    of_topic = [
        _proposals(led, p, F.col(f"_about_{t}"), lambda hit, i=i: F.lit(len(KINDS) + i), 1).alias(f"about_{t}")
        for i, (t, p) in enumerate(zip(TOPICS, MARKS))
    ]
    return stage_table(shaped.select("row", *key, *sources, *of_topic), "pii-proposals")


def positions(found: DataFrame, *key: str) -> DataFrame:
    """One row per proposal that a validator let pass and per context word: row, kind, start, end (code points)."""
    names = [c for c in found.columns if c not in ("row", *key)]
    each = [
        found.where(F.size(c) > 0).select("row", F.lit(i).alias("_of"), F.posexplode(c).alias("_n", "m")).select(
            "row", "_of", "_n", "m.gap", "m.len", "m.lead", "m.kind"
        )
        for i, c in enumerate(names)
    ]
    so_far = Window.partitionBy("row", "_of").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    ends = reduce(DataFrame.unionByName, each).withColumn("_end", F.sum(F.col("gap") + F.col("len")).over(so_far))
    # A text with a blank in front is one character longer; the span begins behind the character in front of it.
    return ends.where("kind is not null").select(
        "row", "kind", (F.col("_end") - F.col("len")).alias("start"), (F.col("_end") - F.col("lead")).alias("end")
    )


def scored(spans: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """The reported spans with their score: row, kind, start, end, score."""
    forth = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    groups = {t: F.col("kind") == len(KINDS) + i for i, t in enumerate(TOPICS)}
    groups["base"] = F.col("kind") < len(BASE_KINDS)
    seen = spans.select("*", *[F.max(F.when(g, F.col("end"))).over(forth).alias(f"_{n}_end") for n, g in groups.items()])
    seen = seen.select("*", *[F.min(F.when(g, F.col("start"))).over(back).alias(f"_{n}_start") for n, g in groups.items()])

    def near(name: str, reach: int) -> Column:
        behind = F.coalesce(F.col("start") < F.col(f"_{name}_end") + reach, F.lit(False))
        return behind | F.coalesce(F.col(f"_{name}_start") < F.col("end") + reach, F.lit(False))

    pick = lambda values: F.element_at(F.array(*values), F.col("kind") + 1)
    confirmed = pick([F.lit(v) for v in scores.confirmed])
    known = pick([F.when(near(t, scores.reach), scores.near).otherwise(0) for t in scores.topic])
    doubt = F.when(near("doubt", scores.reach), scores.doubt).otherwise(0)
    own = F.col("kind") <= KINDS.index("iban")
    judged = seen.where(F.col("kind") < len(KINDS)).select(
        "row", "kind", "start", "end", (confirmed + known - doubt).alias("score"), (own | ~near("base", 0)).alias("_apart")
    )
    return judged.where((F.col("kind") < len(BASE_KINDS)) | (F.col("score") >= scores.min_score) & F.col("_apart")).drop("_apart")


def pii_spans(docs: DataFrame, *key: str, scores: Scores = Scores()) -> tuple[DataFrame, DataFrame]:
    """The staged rows (row, key columns, proposals) and the reported spans (row, kind number, start, end, score)."""
    found = scan(docs, *key)
    return found, scored(positions(found, *key), scores)


def summarise(found: DataFrame, spans: DataFrame, *key: str) -> DataFrame:
    """Per row: counts of the base kinds, hash of the base spans, all spans and their scores as text."""
    said = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])
    per_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sort_array(F.collect_list(F.struct("kind", "start", "end", "score"))).alias("_spans"),
    )
    joined = found.select("row", *key).join(per_row, "row", "left")
    every = F.coalesce("_spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,score:int>>"))
    base = F.filter(every, lambda s: s["kind"] < len(BASE_KINDS))
    return joined.select(
        *key,
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, said), ",").alias("spans"),
        F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


# Kinds and marks as SQL reads them: pattern and characters in front of the span.
PATTERNS = [(EMAIL, 0), (IP, 0), (CARD, 0), (PHONE, 0), (IBAN, 1), (CARD, 0), (NATIONAL_ID, 1), (LOCAL_PHONE, 1)]
PATTERNS += [(m, 1) for m in MARKS]


@query("op11_pii", sql.personal_data(KINDS, TOPICS, PATTERNS, VALID_IP, Scores()))
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = pii_spans(table(spark, sf_dir, "documents"), "doc_id")
    return summarise(found, spans, "doc_id")
