"""Quality rules: base word rules and the divergence of a document's histograms from its language's reference.

Native Spark only. A first pass turns each text into counts (staged, a few numbers a row); a second one
sums the references per language; a third one compares. The reference of a language covers all its
documents that pass the base rules and hold few symbols, so it shifts with the corpus but not with its junk.

How far a document's common words may lie depends on its language: the measure is the distance that a text
without any listed word has from the same reference, and a document is judged by it only if the reference lets
expect `min_expected_words` listed words in a text of its length. So word salad and texts in another language than
their label go, however often a language uses its listed words, and short texts aren't judged by chance.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a null language is the
language ''; in a language with fewer than `min_reference_docs` usable documents, characters are held against all
languages' usable documents together and common words aren't judged; without any usable document distances reject
nothing; very long texts are counted whole, in one row; repeated rows are judged one by one; an empty table gives
an empty result; further columns are carried only by `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuary.llm import sql
from valuary.llm.registry import query, table
from valuary.llm.words import BLANKS, NOT_BLANK
from valuary.session import lookup_join, materialise, stage_table

# The most frequent function words of the four languages, the cells of the word histogram.
COMMON_WORDS = (
    "the of and to in that "
    "le les des et une du "
    "der die und das zu von "
    "el los que y por las"
).split()
# Characters counted as symbols, and the marks that ordinary sentences use.
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_MARKS = r"[.,;:'\"()\-]"
CHAR_CELLS = ("upper", "lower", "digit", "mark", "symbol", "other")


@dataclass(frozen=True)
class QualityRules:
    """Limits; a document must satisfy all. Distances are Jensen-Shannon distances (base 2, 0 to 1).

    `max_word_share` limits the distance of common words as a share of that of a text without any of them. Of 2,180
    documents labelled good that can be judged, the farthest lies at 0.63; 95 of 100 documents held against another
    language's reference lie at 1 or more.
    """

    min_words: int = 10
    max_repeat_pct: int = 20
    min_divergence_words: int = 50
    min_reference_docs: int = 20
    max_reference_symbol_pct: int = 1
    max_char_distance: float = 0.21
    max_word_share: float = 0.75
    min_expected_words: int = 20


def _removed(text: Column, pattern: str) -> Column:
    """How many code points the pattern's single-character matches take."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def document_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row: the words and the counts of the base rules and histograms; `keep` names columns to carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(
        *keep,
        F.col("lang").alias("_lang"),
        text.alias("_text"),
        F.array_remove(F.split(text, f"{BLANKS}+"), "").alias("_words"),
    )
    n = F.size("_words")
    step = step.select(
        "*",
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
        F.array_join("_words", "").alias("_solid"),
    )
    tail = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    step = step.withColumn("_h2", F.zip_with(F.slice("_h1", 1, F.greatest(n - 1, F.lit(0))), tail("_h1", 1), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h4", F.zip_with(F.slice("_h2", 1, F.greatest(F.size("_h2") - 2, F.lit(0))), tail("_h2", 2), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h5", F.zip_with(F.slice("_h4", 1, F.greatest(F.size("_h4") - 1, F.lit(0))), tail("_h1", 4), lambda a, b: F.xxhash64(a, b)))
    # Only documents with a repeated window sort their windows.
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_h5")) < F.size("_h5"),
            F.sort_array(F.transform("_h5", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = lambda x, i: (F.element_at("_sorted", F.greatest(i, F.lit(1))).getField("h") == x["h"]) & (i > 0) | (
        F.element_at("_sorted", F.least(i + 2, F.size("_sorted"))).getField("h") == x["h"]
    ) & (i + 1 < F.size("_sorted"))
    step = step.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", again), lambda x: x["i"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(NOT_BLANK))
    step = step.select(
        *keep,
        "_lang",
        "_text",
        "_solid",
        "_words",
        n.cast("long").alias("n_words"),
        F.char_length("_solid").cast("long").alias("word_chars"),
        _removed(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    solid = F.col("_solid")
    upper, lower = _removed(solid, r"\p{Lu}"), _removed(solid, r"[\p{L}&&[^\p{Lu}]]")
    digit, mark = _removed(solid, r"\p{Nd}"), _removed(solid, SENTENCE_MARKS)
    listed = F.filter("_words", lambda w: w.isin(COMMON_WORDS))
    step = step.select(
        *keep,
        "_lang",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        *[c.cast("long").alias(f"_{k}") for k, c in zip(CHAR_CELLS, (upper, lower, digit, mark))],
        listed.alias("_listed"),
    )
    cells = F.transform(F.array(*map(F.lit, COMMON_WORDS)), lambda c: F.size(F.filter("_listed", lambda w: w == c)))
    chars = [F.col(f"_{k}") for k in CHAR_CELLS[:4]]
    other = F.col("word_chars") - F.col("n_symbols") - sum(chars[1:], chars[0])
    return step.select(
        *keep,
        "_lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(*chars, F.col("n_symbols"), other).alias("_chars"),
        cells.cast("array<bigint>").alias("_common"),
    )


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def language_references(counts: DataFrame, rules: QualityRules) -> DataFrame:
    """Per language: summed histograms of all documents that pass the base rules and are long enough.

    A language with too few of them has the characters of all languages together and no common words.
    """
    usable = (
        ~base_failed(rules)
        & (F.col("n_words") >= rules.min_divergence_words)
        & (100 * F.col("n_symbols") <= rules.max_reference_symbol_pct * F.col("word_chars"))
    )
    chars = [f"c{i}" for i in range(len(CHAR_CELLS))]
    common = [f"w{i}" for i in range(len(COMMON_WORDS))]
    sums = [F.sum(F.when(usable, F.col("_chars")[i])).alias(c) for i, c in enumerate(chars)]
    sums += [F.sum(F.when(usable, F.col("_common")[i])).alias(w) for i, w in enumerate(common)]
    sums += [F.count_if(usable).alias("_ref_docs"), F.sum(F.when(usable, F.col("n_words"))).alias("_ref_words")]
    totals = materialise(counts.groupBy(F.coalesce("_lang", F.lit("")).alias("_language")).agg(*sums))
    # One row of six numbers; they stay null where no document is usable.
    pooled = totals.agg(*[F.sum(c).alias(c) for c in chars]).first()
    known = F.col("_ref_docs") >= rules.min_reference_docs
    everywhere = F.lit(None) if pooled[0] is None else F.array(*[F.lit(x).cast("long") for x in pooled])
    return totals.select(
        "_language",
        "_ref_words",
        F.when(known, F.array(*chars)).otherwise(everywhere).alias("_ref_chars"),
        F.when(known, F.array(*common)).alias("_ref_common"),
    )


def judge(counts: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds base_failed, the two distances (null without a reference), word_share and kept to staged counts."""
    known = lookup_join(
        counts.withColumn("_language", F.coalesce("_lang", F.lit(""))), language_references(counts, rules), ["_language"]
    )
    total = lambda cells: F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x)
    with_rest = lambda cells, n: F.concat(cells, F.array(F.greatest(F.col(n) - total(cells), F.lit(0))))
    known = known.select(
        "*",
        _shares(F.col("_chars")).alias("_p"),
        _shares(F.col("_ref_chars")).alias("_q"),
        _shares(with_rest(F.col("_common"), "n_words")).alias("_wp"),
        _shares(with_rest(F.col("_ref_common"), "_ref_words")).alias("_wq"),
        (F.col("n_words") * total(F.col("_ref_common")) / F.col("_ref_words")).alias("_expected"),
    )
    none_listed = F.array(*[F.lit(0.0)] * len(COMMON_WORDS), F.lit(1.0))
    judged = known.withColumn("char_distance", js_distance(F.col("_p"), F.col("_q"))).withColumn(
        "word_distance", js_distance(F.col("_wp"), F.col("_wq"))
    )
    judged = judged.withColumn("word_share", F.try_divide("word_distance", js_distance(none_listed, F.col("_wq"))))
    strange = (F.col("_expected") >= rules.min_expected_words) & (F.col("word_share") > rules.max_word_share)
    far = F.coalesce(F.col("char_distance") > rules.max_char_distance, F.lit(False)) | F.coalesce(strange, F.lit(False))
    guarded = (F.col("n_words") >= rules.min_divergence_words) & far
    return judged.withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.col("base_failed") & ~guarded)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One verdict per row of `docs` (doc_id, text, lang)."""
    counts = stage_table(document_counts(docs, "doc_id"), "quality-counts")
    return judge(counts, rules)


def filter_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    names = docs.columns
    row = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    counts = stage_table(document_counts(row, "_row"), "quality-rows")
    return judge(counts, rules).where("kept").select("_row.*")


@query("op10_quality_rules", sql.quality_rules(QualityRules(), COMMON_WORDS, SENTENCE_MARKS, SYMBOLS))
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
