"""Top-k search, components and the pipeline against brute force."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from valuary.llm import op2_exact_top_k
from valuary.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def best_by_hand(rows, query_ids, k):
    ints = {}
    usable = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, [math.floor(256 * x) for x in v]))
    for vec_id, v in usable:
        ints[vec_id] = min(ints.get(vec_id, v), v)
    out = []
    for q in sorted(set(query_ids) & set(ints)):
        found = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in usable if i != q and len(v) == len(ints[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def test_top_k_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(150)]  # equal vectors: ties
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(700, [0.25] * 3), (701, [0.5] * 3), (702, []), (10, rows[10][1]), (704, [-0.1] * 6)]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(4)
    vectors = op2_exact_top_k.integer_vectors(frame)
    asked = [0, 10, 50, 300, 350, 600, 602, 700, 702]
    got = op2_exact_top_k.top_k(vectors, vectors.where(vectors.vec_id.isin(asked)), 5).collect()
    assert sorted(map(tuple, got)) == best_by_hand(rows, asked, 5)


def test_top_k_of_large_components_and_empty_tables(spark):
    rows = [(i, [float(3**i), -1e15, float(i)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = op2_exact_top_k.integer_vectors(frame)
    got = op2_exact_top_k.top_k(vectors, vectors.where("vec_id < 3"), 4).collect()
    want = [(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in best_by_hand(rows, [0, 1, 2], 11)]
    held = collections.defaultdict(list)
    for q, _, i, s in want:
        held[q].append((-s, i))
    assert sorted(map(tuple, got)) == [(q, r, i, -s) for q in sorted(held) for r, (s, i) in enumerate(sorted(held[q])[:4], 1)]
    none = vectors.limit(0)
    assert op2_exact_top_k.top_k(none, none).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500)]
    links += [(900, 800), (800, 900), (700, 900)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {500: 500, 700: 700, 800: 700, 900: 700}
    assert got == want


def test_stages_keep_columns_and_agree_with_brute_force(spark):
    """Every stage on its own input at the smallest scale; the whole run ends in gapless sequences."""
    from tests.llm.test_text_operators import check_packed, library, near_by_hand, repeats_by_hand, rules_by_hand, secrets_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        at[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    pairs = lambda frame: [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    before, after = map(pairs, at["quality_rules"])
    failed = {i for i, t in before if rules_by_hand(t)[-1]}
    assert not failed & {i for i, _ in after} and set(after) <= set(before)
    before, after = map(pairs, at["near_dedup"])
    label, _ = near_by_hand(before, 5, 80)
    assert {i for i, _ in after} == {i for i, c in label.items() if i == c}
    before, after = map(pairs, at["substring_dedup"])
    lost = {i: (n, gone) for i, n, gone, _ in repeats_by_hand(before)}
    after = dict(after)
    assert set(after) == {i for i, (n, gone) in lost.items() if not n or gone < n}
    assert all(t == dict(before)[i] for i, t in after.items() if not lost[i][1])
    before, after = map(dict, map(pairs, at["secret_scans"]))
    assert set(before) == set(after)
    assert all(not secrets_by_hand(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not secrets_by_hand(t) and "http" not in t)
    before, after = at["packing"]
    lib, rows = library("word_bpe_49k.json"), after.collect()
    total = sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in pairs(before))
    assert sum(r.length for r in rows) == total
    assert check_packed(rows, 2048) <= 1.03 * total / 2048 + 1


def test_query_vocabulary_paths_exist():
    import os

    assert all(os.path.exists(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("bound,kind", [(1.0, "double"), (2.0**55, "long"), (2.0**70, "whole")])
def test_scores_are_exact_on_every_path(bound, kind):
    rng = np.random.default_rng(0)
    c, q = rng.integers(-50, 50, (7, 5)).astype(float), rng.integers(-50, 50, (3, 5)).astype(float)
    assert (op2_exact_top_k.scores(c, q, bound) == (q @ c.T).astype(int)).all()
