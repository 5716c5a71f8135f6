"""Doc_ids that stand with many texts, repeated rows and labels, and letters whose lower case is longer."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from valuary.llm import op7_packing, op8_substring_dedup, op9_quality_classifier
from valuary.llm.tokens import PieceMemory
from tests.llm.test_text_operators import prose


def passage(seed, n):
    return prose(random.Random(seed), n, 100_000)


def test_substring_removal_with_thousands_of_texts_of_one_doc_id(spark):
    shared = passage(1, 300)
    texts = {f"{passage(i, 6 + i % 40)}" for i in range(2, 3000)}
    some = sorted(texts)[:400]
    rows = [(1, shared)] + [(5, t) for t in texts] + [(5, f"{t} {' '.join(shared.split()[i % 200 : i % 200 + 20])}") for i, t in enumerate(some)]
    got = op8_substring_dedup.substring_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    removed = sorted(r["n_removed"] for r in got)
    # Only the 400 rows that hold twenty words of document 1 lose words, and just these.
    assert removed == [0] * (len(rows) - 400) + [20] * 400


def test_without_repeats_shuffles_texts_once_and_keeps_odd_columns(spark):
    shared = passage(1, 40)
    schema = "doc_id long, text string, spans string, key long, _rest string, _null int, n_chars long"
    rows = [
        (1, shared, "a", 1, "r", 2, 999), (2, f"own words {shared} end", "b", 1, "r", 2, 998), (3, None, "c", 1, None, 2, None),
        (4, shared, "d", 1, "r", 2, 997), (5, "", "e", 1, "r", 2, 996), (None, f"{shared} tail", None, None, None, None, 1),
    ]
    docs = spark.createDataFrame(rows, schema)
    kept = op8_substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    got = {r["spans"]: tuple(r) for r in kept.collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    assert got["a"] == rows[0] and got["c"] == rows[2] and got["e"] == rows[4]
    assert got["b"] == (2, "own words end", "b", 1, "r", 2, 13) and got[None] == (None, "tail", None, None, None, None, 4)
    assert op8_substring_dedup.without_repeats(docs.limit(0)).count() == 0
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3


def test_classifier_collects_no_more_than_its_bounds(spark, monkeypatch):
    how = op9_quality_classifier.Training(max_positives=30, max_unlabelled=50)
    rows = [(7, f"text number {i} of one id") for i in range(400)] + [(7, "the same text")] * 400 + [(i, f"clean text {i}.") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 20 + [(7, 0)] * 5 + [(i, i % 2) for i in range(100, 140)], "doc_id long, quality int")
    seen = {}

    def fit(positive, unlabelled, prior, how):
        seen.update(p=len(positive), u=len(unlabelled), prior=prior)
        return real(positive, unlabelled, prior, how)

    real = op9_quality_classifier.fit
    monkeypatch.setattr(op9_quality_classifier, "fit", fit)
    model = op9_quality_classifier.train(docs, labels, how)
    assert seen["p"] <= 30 and seen["u"] <= 50 and seen["p"] > 0
    known = {7: 1} | {i: i % 2 for i in range(100, 140)}
    import zlib
    inside = [q for d, q in known.items() if zlib.crc32(str(d).encode()) % 5]
    assert seen["prior"] == pytest.approx(sum(inside) / len(inside))
    assert op9_quality_classifier.score(docs, model).count() == len(rows)


def risk(x, y, prior, w, b, decay):
    """The non-negative risk as it is stated, plus the weights' decay."""
    loss = lambda z: np.log1p(np.exp(-z))
    zp, zu = x @ w + b, y @ w + b
    return prior * loss(zp).mean() + max(0.0, loss(-zu).mean() - prior * loss(-zp).mean()) + decay / 2 * (w**2).sum()


def test_classifier_fit_is_near_the_least_risk():
    rng = np.random.default_rng(3)
    positive, negative = rng.normal(0.8, 1, (300, 2)), rng.normal(-0.8, 1, (700, 2))
    unlabelled = np.concatenate([rng.normal(0.8, 1, (300, 2)), negative])
    how = op9_quality_classifier.Training()
    mean, scale, w, b = op9_quality_classifier.fit(positive, unlabelled, 0.3, how)
    x, y = (positive - mean) / scale, (unlabelled - mean) / scale
    found = risk(x, y, 0.3, w, b, how.decay)
    # Brute force: a fine grid over both weights and the bias.
    grid = np.linspace(-4, 4, 33)
    least = min(risk(x, y, 0.3, np.array([a, c]), d, how.decay) for a in grid for c in grid for d in grid)
    assert found <= least + 0.01


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_letter_before_marks_encodes_as_in_the_library(name):
    memory = PieceMemory(public_tokenizers.path(name))
    letters = [chr(c) for c in range(0x21, 0x250)]
    texts = [f"x {c}, y{c}. {c}!" for c in letters] + [f"x {w}, ({w})" for w in list(memory.library.get_vocab())[::7]]
    ids, counts = memory.encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    for text, mine, other in zip(texts, got, memory.library.encode_batch(texts, add_special_tokens=False)):
        assert mine.tolist() == other.ids, text


def test_packing_of_a_letter_with_a_long_lower_case(spark):
    docs = spark.createDataFrame([(1, "x İ, ve İ.")], "doc_id long, text string")
    library = PieceMemory(public_tokenizers.path(op7_packing.WORD_BPE)).library
    row = op7_packing.pack_documents(docs, public_tokenizers.path(op7_packing.WORD_BPE)).first()
    assert row["length"] == len(library.encode("x İ, ve İ.", add_special_tokens=False).ids) + 1
    assert F is not None
