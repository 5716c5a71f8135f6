"""Exact order statistics and distribution distances without a global sort.

Medians, quantile edges, tier borders, time splits and KS distances all ask "which value sits at rank
r of its group?". A sort, an unpartitioned window or a value map per group would put a whole group
into one task. Here the values of a group are counted into cells (an order-keeping cut of the number
line), which map-side aggregation keeps small; running totals over the cells tell which few cells
hold the wanted ranks, and only rows inside those are looked at again, in ever finer cells, until a
cell is small enough to list its distinct values. Equal values always share a cell and collapse to
one counted row, so a value held by a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuary.session import MAX_LOOKUP_ROWS, broadcast_if_small, materialise, stage_table

LOG_CELLS = 1024  # first cut: cells per e-fold of 1 + |value|
SPLIT_CELLS = 4096  # later cuts: equal-width cells inside an opened cell
MAX_CELL_ROWS = 500_000  # a cell up to this size is listed value by value


def first_cell(v: Column) -> Column:
    """Cell number on a signed logarithmic scale; never decreases as v grows."""
    return F.floor(F.signum(v.cast("double")) * F.log1p(F.abs(v.cast("double"))) * LOG_CELLS)


def _inner_cell(v: Column, lo: Column, hi: Column) -> Column:
    return F.floor((v - lo) / (hi - lo) * SPLIT_CELLS)


def _values(df: DataFrame, keys: Sequence[str], v: Column, counts: dict[str, int | Column]) -> DataFrame:
    """Keys, the value as `v` with NaN as null, and counts: constants per row, or the weight of a counted row.

    Null values are not filtered here: the optimizer would copy the whole value expression into a
    filter at the scan. They meet in a cell of their own, which `_cells` drops.
    """
    counted = [(F.lit(n) if isinstance(n, int) else n).cast("long").alias(c) for c, n in counts.items()]
    rows = df.select(*keys, v.alias("v"), *counted)
    if isinstance(rows.schema["v"].dataType, (T.DoubleType, T.FloatType)):
        rows = rows.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return rows


def counted_values(df: DataFrame, keys: Sequence[str], value: Column | str = "v") -> DataFrame:
    """Keys, distinct value `v` and its number of rows `n`; null and NaN are left out.

    Map tasks count before the shuffle. Staged, it serves every later pass over the same values by `weight`.
    """
    v = F.col(value) if isinstance(value, str) else value
    counts = _values(df, keys, v, {"n": 1}).groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    return counts.where("v is not null")


def _weight(weight: str | None) -> int | Column:
    return 1 if weight is None else F.col(weight)


def _cells(rows: DataFrame, by: Sequence[Column | str], cell: Column, counts: Sequence[str]) -> DataFrame:
    cells = rows.groupBy(*by, cell.alias("cell")).agg(
        *[F.sum(c).alias(c) for c in counts], F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    return cells.where(F.col("lo").isNotNull())


def _with_before(cells: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Running totals of the cells before each cell; a group has few cells, never its rows, in a task."""
    w = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts})


def _join_open(rows: DataFrame, opened: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Rows whose value lies in an opened cell of their group (null keys match null keys)."""
    side = opened.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("open_first", first_cell(F.col("open_lo")))
    match = [rows[k].eqNullSafe(side[f"_{k}"]) for k in keys]
    within = (rows["v"] >= side["open_lo"]) & (rows["v"] <= side["open_hi"])
    # All values of an opened cell lie in one first cell, so each row meets only the opened cells around its value.
    match += [first_cell(rows["v"]) == side["open_first"], F.coalesce(within, F.lit(False))]
    joined = rows.join(F.broadcast(side) if small else side, reduce(lambda a, b: a & b, match))
    return joined.drop("open_first", *[f"_{k}" for k in keys])


def _size_of(opened: DataFrame, count: str | Column) -> tuple[int, int]:
    row = opened.agg(F.count("*").alias("cells"), F.max(count).alias("largest")).first()
    return row["cells"], row["largest"] or 0


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    ranks: Callable[[Column], Sequence[Column]],
    max_cell_rows: int = MAX_CELL_ROWS,
    few_values: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Values at given 0-based ranks of each group of `keys` (at least one key).

    `ranks(n)` returns the wanted ranks as expressions of the group size. The result has one row per
    group and rank: keys, `i` (position in the list), `rank`, `value`, `below` (rows with a smaller
    value), `ties` (rows with this value) and `n`. Null and NaN values are left out.

    `few_values` promises that a group has a bounded number of distinct values (calendar days, or no
    more rows than a cell may have): they are then listed in the first pass. `weight` names the number of rows
    that a row of a table from `counted_values` stands for.
    """
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    rows = _values(df, keys, v, {"n": _weight(weight)})

    def wanted(total: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("r")) for i, r in enumerate(ranks(total))])

    def holding(cells: DataFrame) -> DataFrame:
        """Keep cells that contain a wanted rank, with those ranks only."""
        begin, end = F.col("n_before"), F.col("n_before") + F.col("n")
        inside = F.filter("wanted", lambda x: (x["r"] >= begin) & (x["r"] < end))
        return cells.withColumn("wanted", inside).where(F.size("wanted") > 0)

    def found(cells: DataFrame) -> DataFrame:
        hit = cells.where("lo = hi").select(*keys, "lo", "n", "n_before", "total", F.explode("wanted").alias("w"))
        return hit.select(
            *keys,
            F.col("w.i").alias("i"),
            F.col("w.r").alias("rank"),
            F.col("lo").alias("value"),
            F.col("n_before").alias("below"),
            F.col("n").alias("ties"),
            F.col("total").alias("n"),
        )

    cut = F.col("v") if few_values else first_cell(F.col("v"))
    cells = _with_before(_cells(rows, keys, cut, ["n"]), keys, ["n"])
    cells = cells.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    cells = materialise(holding(cells.withColumn("wanted", wanted(F.col("total")))).drop("cell"))
    results = [found(cells)]
    while not few_values:
        opened = cells.where("lo < hi")
        number, largest = _size_of(opened, "n")
        if number == 0:
            break
        opened = opened.select(
            *keys,
            F.col("lo").alias("open_lo"),
            F.col("hi").alias("open_hi"),
            F.col("n_before").alias("base"),
            "total",
            "wanted",
        )
        inside = _join_open(rows, opened, keys, small=number <= MAX_LOOKUP_ROWS)
        if largest <= max_cell_rows:
            cell = F.col("v")
        else:
            cell = _inner_cell(F.col("v"), F.col("open_lo"), F.col("open_hi"))
        by = [*keys, "open_lo", "base", "total", "wanted"]
        cells = _with_before(_cells(inside, by, cell, ["n"]), [*keys, "open_lo"], ["n"])
        cells = cells.withColumn("n_before", F.col("n_before") + F.col("base")).drop("cell", "open_lo", "base")
        cells = materialise(holding(cells))
        results.append(found(cells))
    return reduce(DataFrame.unionByName, results)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    quantiles: dict[str, float],
    approx: bool = False,
    max_cell_rows: int = MAX_CELL_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group: keys, one column per entry of `quantiles`, and `n`.

    `approx=True` trades exactness for one pass with a bounded sketch; it takes no `weight`.
    """
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    if approx and weight is not None:
        raise ValueError("the sketch takes rows, not counted values")
    if approx:
        sketch = _values(df, keys, v, {}).groupBy(*keys).agg(
            *[F.percentile_approx("v", q, 10_000).cast("double").alias(a) for a, q in quantiles.items()],
            F.count("v").alias("n"),
        )
        return sketch.where("n > 0")

    def ranks(n: Column) -> list[Column]:
        at = [F.lit(float(q)) * (n - 1) for q in quantiles.values()]
        return [edge for p in at for edge in (F.floor(p), F.ceil(p))]

    stats = order_statistics(df, keys, v, ranks, max_cell_rows, weight=weight)
    wide = stats.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("i") == i, F.col("value").cast("double"))).alias(f"_{i}") for i in range(2 * len(quantiles))],
    )
    columns = []
    for j, (alias, q) in enumerate(quantiles.items()):
        low, high = F.col(f"_{2 * j}"), F.col(f"_{2 * j + 1}")
        at = F.lit(float(q)) * (F.col("n") - 1)
        columns.append((low + (high - low) * (at - F.floor(at))).alias(alias))
    return wide.select(*keys, *columns, "n")


def boundary_rows(
    df: DataFrame,
    keys: Sequence[str],
    first: Column | str,
    second: Column | str,
    ranks: Callable[[Column], Sequence[Column]],
    max_cell_rows: int = MAX_CELL_ROWS,
    few_first: bool = False,
) -> DataFrame:
    """Rows at given ranks when groups are ordered by (first, second): keys, i, `first`, `second`, `n`.

    `second` is null where no other row shares the first value, so no tie has to be broken.
    `few_first` promises few distinct first values, see `order_statistics`.
    """
    keys = list(keys)
    a = F.col(first) if isinstance(first, str) else first
    b = F.col(second) if isinstance(second, str) else second
    rows = df.select(*keys, a.alias("a"), b.alias("b"))
    heads = materialise(order_statistics(rows, keys, "a", ranks, max_cell_rows, few_first))
    tied = heads.where("ties > 1").select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        "i",
        F.col("value").alias("_value"),
        (F.col("rank") - F.col("below")).alias("place"),
        "ties",
    )
    number, largest = _size_of(tied, "ties")
    tied = tied.drop("ties")
    if number == 0:
        return heads.select(*keys, "i", F.col("value").alias("first"), F.lit(None).cast("long").alias("second"), "n")
    same = [rows[k].eqNullSafe(tied[f"_{k}"]) for k in keys] + [rows["a"] == tied["_value"]]
    side = F.broadcast(tied) if number <= MAX_LOOKUP_ROWS else tied
    inside = rows.join(side, reduce(lambda x, y: x & y, same)).select(*keys, F.col("i").alias("_i"), "place", "b")
    breaks = order_statistics(
        inside, [*keys, "_i", "place"], "b", lambda n: [F.col("place")], max_cell_rows, few_values=largest <= max_cell_rows
    )
    breaks = breaks.select(*[F.col(k).alias(f"_{k}") for k in keys], "_i", F.col("value").alias("second"))
    on = [heads[k].eqNullSafe(breaks[f"_{k}"]) for k in keys] + [heads["i"] == breaks["_i"]]
    out = heads.join(breaks, reduce(lambda x, y: x & y, on), "left")
    return out.select(*keys, "i", F.col("value").alias("first"), F.col("second"), "n")


def at_or_before(first: Column, second: Column, border_first: Column, border_second: Column) -> Column:
    """Whether a row does not come after a border from `boundary_rows`."""
    return (first < border_first) | (
        (first == border_first) & (border_second.isNull() | (second <= border_second))
    )


def ranged_counts(df: DataFrame, keys: Sequence[str], value: Column | str, parts: int | None = None) -> DataFrame:
    """`counted_values` dealt out by ranges of (keys, v), written down with the number `part` of each row's range.

    Ranges hold about equally many distinct values, so neither a large group nor values that lie close together
    meet in one task; `parts` sets their number instead of the session's shuffle partitions.
    """
    counts = counted_values(df, keys, value)
    by = [F.col(k) for k in keys] + [F.col("v")]
    dealt = counts.repartitionByRange(parts, *by) if parts else counts.repartitionByRange(*by)
    return stage_table(dealt.withColumn("part", F.spark_partition_id()), "ranged-counts")


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: Column | str, parts: int | None = None) -> DataFrame:
    """Rows at or below each distinct value of a group: keys, value, n, through, total.

    A prefix sum in two levels: running totals inside a range start from the totals of the group's ranges before it.
    Null and NaN values are left out; null keys are a group of their own; an empty table gives an empty result.
    """
    keys = list(keys)
    counts = ranged_counts(df, keys, value, parts)
    # At most one row per group and range, and a group's ranges lie side by side.
    ranges = counts.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"before": F.coalesce(F.sum("n").over(along), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*keys))})
    bases = materialise(ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), "before", "total"))
    same = [counts[k].eqNullSafe(bases[f"_{k}"]) for k in keys] + [counts["part"] == bases["_part"]]
    joined = counts.join(broadcast_if_small(bases), reduce(lambda a, b: a & b, same))
    running = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("before") + F.sum("n").over(running)
    return joined.select(*keys, F.col("v").alias("value"), "n", through.alias("through"), "total")


def ks_distance(
    reference: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    reference_keys: Sequence[str] | None = None,
    value: str = "v",
    max_cell_rows: int = MAX_CELL_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Exact two-sample KS statistic per group: keys, reference_n, current_n, ks.

    `reference_keys` may be a subset of `keys` when one reference serves several current groups. Both
    cumulative shares are known exactly at cell borders; inside a cell their gap cannot exceed the
    wider of its two crossed borders, so only cells whose bound beats the best border are opened. With `weight`
    both tables are counted (`counted_values`), so a reference meets its current groups by distinct value, not by row.
    """
    keys = list(keys)
    reference_keys = list(reference_keys or keys)
    counts = ["ref", "cur"]

    sides = [
        (_values(reference, reference_keys, F.col(value), {"ref": _weight(weight), "cur": 0}), reference_keys),
        (_values(current, keys, F.col(value), {"ref": 0, "cur": _weight(weight)}), keys),
    ]
    cur_cells = _cells(sides[1][0], keys, first_cell(F.col("v")), counts)
    ref_cells = _cells(sides[0][0], reference_keys, first_cell(F.col("v")), counts)
    if reference_keys != keys:
        ref_cells = ref_cells.join(cur_cells.select(*keys).distinct(), reference_keys)
    both = ref_cells.select(*keys, "cell", "ref", "cur", "lo", "hi").unionByName(cur_cells)
    cells = both.groupBy(*keys, "cell").agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    group = Window.partitionBy(*keys)
    cells = _with_before(cells, keys, counts)
    cells = cells.withColumns({"ref_n": F.sum("ref").over(group), "cur_n": F.sum("cur").over(group)})
    cells = materialise(cells)

    def gaps(table: DataFrame) -> DataFrame:
        ref0 = F.try_divide(F.col("ref_before"), F.col("ref_n"))
        cur0 = F.try_divide(F.col("cur_before"), F.col("cur_n"))
        ref1 = F.try_divide(F.col("ref_before") + F.col("ref"), F.col("ref_n"))
        cur1 = F.try_divide(F.col("cur_before") + F.col("cur"), F.col("cur_n"))
        return table.withColumns(
            {"gap": F.abs(ref1 - cur1), "bound": F.greatest(F.abs(ref1 - cur0), F.abs(cur1 - ref0))}
        )

    def best_of(table: DataFrame) -> DataFrame:
        return table.groupBy(*keys).agg(
            F.max("ref_n").alias("reference_n"), F.max("cur_n").alias("current_n"), F.max("gap").alias("ks")
        )

    cells = gaps(cells)
    bests = [best_of(cells)]
    while True:
        best = F.max("gap").over(group)
        # A cell with rows of one side only has its extremes at its borders already.
        open_it = (F.col("bound") > F.col("best")) & (F.col("lo") < F.col("hi")) & (F.col("ref") > 0) & (F.col("cur") > 0)
        opened = cells.withColumn("best", best).where(open_it)
        opened = opened.select(
            *keys,
            F.col("lo").alias("open_lo"),
            F.col("hi").alias("open_hi"),
            F.col("ref_before").alias("ref_base"),
            F.col("cur_before").alias("cur_base"),
            "ref_n",
            "cur_n",
            (F.col("ref") + F.col("cur")).alias("size"),
        )
        number, largest = _size_of(opened, "size")
        if number == 0:
            break
        opened = opened.drop("size")
        small = number <= MAX_LOOKUP_ROWS
        parts = []
        for rows, by in sides:
            inside = _join_open(rows, opened, by, small)
            parts.append(inside.select(*keys, "v", "ref", "cur", *[c for c in opened.columns if c not in keys]))
        exact = largest <= max_cell_rows
        cell = F.col("v") if exact else _inner_cell(F.col("v"), F.col("open_lo"), F.col("open_hi"))
        by = [*keys, "open_lo", "ref_base", "cur_base", "ref_n", "cur_n"]
        cells = _cells(parts[0].unionByName(parts[1]), by, cell, counts)
        cells = _with_before(cells, [*keys, "open_lo"], counts)
        cells = cells.withColumns(
            {"ref_before": F.col("ref_before") + F.col("ref_base"), "cur_before": F.col("cur_before") + F.col("cur_base")}
        ).drop("cell", "open_lo", "ref_base", "cur_base")
        cells = gaps(materialise(cells))
        bests.append(best_of(cells))
        if exact:
            break
    result = reduce(DataFrame.unionByName, bests).groupBy(*keys)
    return result.agg(
        F.max("reference_n").alias("reference_n"), F.max("current_n").alias("current_n"), F.max("ks").alias("ks")
    )
