"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives (quality 1) and unlabelled web text train a logistic model whose risk is
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)): the unlabelled text's risk as negatives, less the share of it that comes
from hidden positives, held at zero from below. The class prior pi is estimated from labelled rows, which are drawn
from the same web text. Inputs are figures of a text's form and hashed word shapes; labels, language, source and doc_id
are never inputs.

Training reads a bounded sample (`max_positives`, `max_unlabelled` rows, those with the smallest hashes of their
ids; rows held out from labels are not in it); every row is scored, whole texts, chunk by chunk.

Defined results: a null or empty text is scored like any other, by its zero counts; repeated rows are scored one by
one, and in training equal rows count once; of conflicting labels of one doc_id the larger counts; without a positive the
score is the prior; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuary.llm.registry import query, table
from valuary.llm.words import chunks
from valuary.session import broadcast_if_small, materialise, stage_table

FOLDS = 5
THRESHOLD = 0.3
SHAPES = 512

_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and settings of the fit."""

    max_positives: int = 4000
    max_unlabelled: int = 8000
    steps: int = 600
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 11


class _Shapes(dict):
    """Cell of a word's shape: kinds of its first and last characters, whether it mixes kinds, its length class."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        kind = lambda c: "U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else c
        inner = {kind(c) for c in word}
        said = f"{kind(word[0])}{kind(word[-1])}{len(inner)}{'U' in inner}{'l' in inner}{min(len(word), 20) // 4}"
        self[word] = cell = zlib.crc32(said.encode()) % SHAPES
        return cell


_SHAPES = _Shapes()


def features(text: str) -> np.ndarray:
    """Figures of a text's form, then the square roots of its word shapes' shares."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    once = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    grams = max(0, n - 2)
    distinct = len(set(zip(words, words[1:], words[2:])))
    form = [
        np.log1p(n) / 10,
        np.log1p(len(lines)) / 10,
        sum(map(len, words)) / max(1, n) / 10,
        len(_SYMBOL.findall(text)) / max(1, n),
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars * 5,
        len(_ODD.findall(text)) / chars * 5,
        text.count("!") / max(1, n),
        (text.count(".") + text.count(",")) / max(1, n),
        once / max(1, n),
        repeats / max(1, n),
        1 - distinct / grams if grams else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(n == 0),
        float(n < 10),
    ]
    shapes = np.bincount(np.fromiter(map(_SHAPES.__getitem__, words), np.int64, n), minlength=SHAPES) / max(1, n)
    return np.concatenate([form, np.sqrt(shapes)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, how: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, bias) of the logistic model with the least non-negative risk."""
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-3), 1 - 1e-3)
        width = (positive if len(positive) else unlabelled).shape[1]
        return np.zeros(width), np.ones(width), np.zeros(width), float(np.log(p / (1 - p)))
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, bias = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, how.steps + 1):
        sp, su = sigmoid(p @ w + bias), sigmoid(u @ w + bias)
        # Logistic losses and their slopes in the score: -log s has slope s - 1, -log(1 - s) has slope s.
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        slope_p, slope_u = prior * (sp - 1) / len(p), su / len(u)
        if negative >= 0:
            slope_p = slope_p - prior * sp / len(p)
        else:
            # The negative part went below zero: step back on it alone.
            slope_p, slope_u = prior * sp / len(p), -slope_u
        grad = np.append(p.T @ slope_p + u.T @ slope_u + how.decay * w, slope_p.sum() + slope_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return mean, scale, w, float(bias)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()):
    """The model, from labelled rows outside the held-out fold and unlabelled rows."""
    # A doc_id counts once, with the larger label where labels disagree.
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, ones = known.agg(F.count("*"), F.sum(F.col("quality").cast("double"))).first()
    prior = min(max((ones or 0.0) / n, 0.01), 0.99) if n else 0.5
    # Rows are told apart by id and text, so a doc_id with many rows takes at most the bound, equal rows one place.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("print")]
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    free = free.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print")).distinct()
    positives = free.join(broadcast_if_small(materialise(known.where("quality = 1").select("doc_id"))), "doc_id", "left_semi")
    positives = positives.orderBy(*order).limit(how.max_positives).withColumn("side", F.lit(1))
    unlabelled = free.orderBy(*order).limit(how.max_unlabelled).withColumn("side", F.lit(0))
    chosen = stage_table(positives.union(unlabelled), "classifier-sample")

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            x = [features(t).astype("<f4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("side"), pa.array(x, pa.binary())], ["doc_id", "side", "x"])

    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    sample = texts.join(broadcast_if_small(chosen), ["doc_id", "print"]).dropDuplicates(["doc_id", "print", "side"])
    sample = sample.select("doc_id", "side", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(describe, f"doc_id {kind}, side int, x binary").collect()
    # In a fixed order: sums of floats depend on it.
    rows.sort(key=lambda r: (r["side"], r["doc_id"], bytes(r["x"])))
    width = len(features(""))
    side = lambda s: np.array([np.frombuffer(r["x"], "<f4") for r in rows if r["side"] == s], np.float64).reshape(-1, width)
    return fit(side(1), side(0), prior, how)


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    mean, scale, w, bias = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            s = [1 / (1 + np.exp(-np.clip(((features(t) - mean) / scale) @ w + bias, -30, 30))) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
