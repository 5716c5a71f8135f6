"""Order statistics and KS against brute force, with many ties, one hot group and tiny cells."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from valuary.operators.ordered import (
    boundary_rows,
    counted_values,
    cumulative_counts,
    group_quantiles,
    ks_distance,
    order_statistics,
    ranged_counts,
)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 6000
    frame = pd.DataFrame(
        {
            "g": np.where(np.arange(n) % 3 == 0, "hot", rng.choice(list("abcdefg"), n)),
            "v": np.where(np.arange(n) % 3 == 1, 7.5, np.round(rng.normal(0, 1000, n) ** 3, 2)),
            "place": rng.permutation(n),
        }
    )
    frame.loc[frame.index % 50 == 0, "v"] = np.nan
    return frame, spark.createDataFrame(frame).cache()


@pytest.mark.parametrize("cell_rows", [500_000, 40, 3])
def test_quantiles_equal_linear_interpolation(table, cell_rows):
    frame, df = table
    qs = {"low": 0.0, "q10": 0.1, "mid": 0.5, "q90": 0.9, "high": 1.0}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", qs, max_cell_rows=cell_rows).collect()}
    for g, part in frame.dropna().groupby("g"):
        assert got[g]["n"] == len(part)
        for alias, q in qs.items():
            assert got[g][alias] == pytest.approx(np.quantile(part["v"], q), rel=1e-12)


def test_null_group_and_single_value(rows):
    df = rows([(None, 5.0), (None, 9.0), ("x", -3.0), ("y", None)], "g string, v double")
    got = {r["g"]: r["m"] for r in group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 7.0, "x": -3.0}


def test_approximate_quantiles_stay_close(table):
    frame, df = table
    got = {r["g"]: r["m"] for r in group_quantiles(df, ["g"], "v", {"m": 0.5}, approx=True).collect()}
    assert got["hot"] in set(frame.loc[frame["g"] == "hot", "v"])


def test_ranks_report_rows_below_and_ties(rows):
    df = rows([("a", v) for v in (1, 2, 2, 2, 5)], "g string, v bigint")
    stats = {r["i"]: r for r in order_statistics(df, ["g"], "v", lambda n: [n - n, F.lit(2), n - 1]).collect()}
    assert [(stats[i]["value"], stats[i]["below"], stats[i]["ties"]) for i in range(3)] == [(1, 0, 1), (2, 1, 3), (5, 4, 1)]


@pytest.mark.parametrize("cell_rows", [500_000, 25])
def test_boundary_rows_break_ties_by_second_column(table, cell_rows):
    frame, df = table
    got = boundary_rows(df, ["g"], "v", "place", lambda n: [F.floor(n / 3), F.floor(n * 2 / 3)], cell_rows).collect()
    for r in got:
        part = frame[frame["g"] == r["g"]].dropna().sort_values(["v", "place"]).reset_index(drop=True)
        want = part.iloc[len(part) // 3 if r["i"] == 0 else len(part) * 2 // 3]
        assert r["first"] == want["v"]
        assert r["second"] in (None, want["place"])
        if (part["v"] == want["v"]).sum() > 1:
            assert r["second"] == want["place"]


def _ks(a, b):
    values = np.unique(np.concatenate([a, b]))
    left = np.searchsorted(np.sort(a), values, side="right") / len(a)
    right = np.searchsorted(np.sort(b), values, side="right") / len(b)
    return np.max(np.abs(left - right))


@pytest.mark.parametrize("cell_rows", [500_000, 30])
def test_ks_equals_brute_force(spark, cell_rows):
    rng = np.random.default_rng(11)
    ref = {"p": rng.normal(0, 1, 900), "q": rng.integers(0, 9, 700).astype(float), "r": np.full(200, 4.0)}
    cur = {"p": rng.normal(0.15, 1.1, 800), "q": rng.integers(0, 10, 600).astype(float), "r": rng.normal(4, 0.001, 300)}

    def frame(side):
        return spark.createDataFrame([(k, float(v)) for k, vs in side.items() for v in vs], "f string, v double")

    got = {r["f"]: r["ks"] for r in ks_distance(frame(ref), frame(cur), ["f"], max_cell_rows=cell_rows).collect()}
    for key in ref:
        assert got[key] == pytest.approx(_ks(ref[key], cur[key]), abs=1e-12)


def test_ks_with_shared_reference(spark):
    rng = np.random.default_rng(5)
    ref = rng.normal(0, 1, 500)
    cur = {p: rng.normal(shift, 1, 300) for p, shift in (("p1", 0.0), ("p2", 0.7))}
    ref_df = spark.createDataFrame([("f", float(v)) for v in ref], "f string, v double")
    cur_df = spark.createDataFrame([("f", p, float(v)) for p, vs in cur.items() for v in vs], "f string, p string, v double")
    got = {r["p"]: r["ks"] for r in ks_distance(ref_df, cur_df, ["f", "p"], ["f"], max_cell_rows=20).collect()}
    for p, vs in cur.items():
        assert got[p] == pytest.approx(_ks(ref, vs), abs=1e-12)


def test_cumulative_counts(table):
    frame, df = table
    got = {(r["g"], r["value"]): r["through"] for r in cumulative_counts(df, ["g"], "v").collect()}
    part = frame[frame["g"] == "hot"].dropna()
    for v in part["v"].unique():
        assert got[("hot", v)] == (part["v"] <= v).sum()


def test_counted_values_stand_for_their_rows(spark):
    """Quantiles and KS from counts equal those from rows; null, NaN and hot values included."""
    rng = random.Random(8)
    rows = [(g, rng.choice([None, float("nan"), 5.0, 5.0, 5.0, rng.gauss(0, 9)])) for g in ["a", None] for _ in range(300)]
    one, other = (spark.createDataFrame(part, "g string, v double") for part in (rows[::2], rows[1::2]))
    counts = [counted_values(df, ["g"]) for df in (one, other)]
    assert counts[0].agg(F.sum("n")).first()[0] == sum(v is not None and v == v for _, v in rows[::2])
    levels = {"lo": 0.1, "mid": 0.5, "hi": 0.93}
    for cell_rows in (40,):
        assert sorted(map(tuple, group_quantiles(counts[0], ["g"], "v", levels, max_cell_rows=cell_rows, weight="n").collect()), key=str) == sorted(
            map(tuple, group_quantiles(one, ["g"], "v", levels, max_cell_rows=cell_rows).collect()), key=str
        )
        known = [df.where("g is not null") for df in (*counts, one, other)]
        by_counts = ks_distance(known[0], known[1], ["g"], max_cell_rows=cell_rows, weight="n").collect()
        assert sorted(map(tuple, by_counts)) == sorted(map(tuple, ks_distance(known[2], known[3], ["g"], max_cell_rows=cell_rows).collect()))


def test_prefix_sums_of_values_close_together_are_spread(spark):
    """Thousands of values in one logarithmic cell are dealt over all ranges; totals are exact across ranges."""
    rows = [("hot", 1000 + i * 1e-6) for i in range(4000)] + [("hot", 1000.0)] * 2000 + [(None, 1.0), (None, None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    sizes = [r["count"] for r in ranged_counts(df, ["g"], "v", parts=8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4001 / 8
    got = {(r["g"], r["value"]): (r["n"], r["through"], r["total"]) for r in cumulative_counts(df, ["g"], "v", parts=8).collect()}
    assert len(got) == 4001 and got[(None, 1.0)] == (1, 1, 1)
    assert all(got[("hot", 1000 + i * 1e-6)] == (2001 if i == 0 else 1, 2001 + i, 6000) for i in range(4000))
    assert cumulative_counts(df.where("false"), ["g"], "v").collect() == []
