"""Ranks, order statistics and cuts without ordering a whole table in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowguard.session import cut_lineage

ACCURACY = 10_000
TAKE_LIMIT = 10_000


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order.

    Rows are range-sorted and keep their partition and place; only one row per partition
    (the sizes) is summed up to turn places into a global number.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, offset = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    placed = placed.select("*", part.alias("_part"), offset.alias("_offset"))
    # One row per partition of the sort: bounded by the number of partitions.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.withColumn(out, F.col("_start") + F.col("_offset")).drop("_place", "_part", "_offset", "_start")


def steps_below(value: Column, cuts: Sequence[float], reached: bool = False, leaf: Callable[[int], Column] = F.lit) -> Column:
    """How many of the ascending ``cuts`` are under ``value`` (or, ``reached``, at most it), by halving.

    ``leaf`` makes the answer of the number; a value takes as many comparisons as the number has binary digits.
    """

    def part(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        mid = (low + high) // 2
        cut = F.lit(float(cuts[mid]))
        passed = value >= cut if reached else value > cut
        return F.when(passed, part(mid + 1, high)).otherwise(part(low, mid))

    return part(0, len(cuts))


class _Known(NamedTuple):
    """What one pass of sketches says of a column: its ends, its count, and values either side of each wanted share."""

    low: float
    high: float
    count: int
    around: list[tuple[float, float]]


def _requested(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """``v0, v1, ...``: the columns as doubles, NaN as null, written once for the passes over them."""
    cells = [col.cast("double") + F.lit(0.0) for col in columns]
    return cut_lineage(df.select(*[F.when(~F.isnan(v), v).alias(f"v{k}") for k, v in enumerate(cells)]))


def _sketched(values: DataFrame, shares: Sequence[Sequence[float]]) -> list[_Known]:
    """All columns in one pass; quantile summaries are merged from task to task and have a size of their own."""
    cells = []
    for k, own in enumerate(shares):
        v = F.col(f"v{k}")
        near = [min(max(p + d / ACCURACY, 0.0), 1.0) for p in own for d in (-2, 2)] or [0.5]
        cells += [F.min(v), F.max(v), F.count(v), F.percentile_approx(v, near, ACCURACY)]
    row = values.agg(*[x.alias(f"x{i}") for i, x in enumerate(cells)]).first()
    out = []
    for k, own in enumerate(shares):
        low, high, count, near = row[4 * k : 4 * k + 4]
        # So few values need no sketch: all of them are counted one by one.
        few = count <= ACCURACY
        out.append(_Known(low, high, count, [(low, high) if few else (near[2 * i], near[2 * i + 1]) for i in range(len(own))]))
    return out


def _counted(values: DataFrame, brackets: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """``k, slot, v, n``: the exact pass. Values inside a bracket are counted one by one, those between by their gap.

    Of the brackets of a column, ascending and apart, slot 2 j + 1 is bracket j and slot 2 j the gap before it.
    """
    cells = []
    for k, own in brackets.items():
        v = F.col(f"v{k}")

        def leaf(j: int, v: Column = v, own: list[tuple[float, float]] = own) -> Column:
            return F.lit(0) if j == 0 else F.when(v <= F.lit(float(own[j - 1][1])), 2 * j - 1).otherwise(2 * j)

        slot = steps_below(v, [low for low, _ in own], reached=True, leaf=leaf)
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), slot.alias("slot"), v.alias("v"))))
    spread = values.select(F.explode(F.array_compact(F.array(*cells))).alias("at")).select("at.k", "at.slot", F.when(F.col("at.slot") % 2 == 1, F.col("at.v")).alias("v"))
    return cut_lineage(spread.groupBy("k", "slot", "v").agg(F.count(F.lit(1)).alias("n")))


def _apart(brackets: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _at_ranks(values: DataFrame, known: Sequence[_Known], ranks: dict[int, Sequence[int]]) -> dict[int, list[float]]:
    """Values of each column at its ranks, from one exact pass over all columns.

    The sketch brackets every rank, so that a few values in ``ACCURACY`` per rank are counted one by one and
    summed up in order, bracket by bracket. A rank that its bracket does not hold after all takes the gap it
    fell into for a bracket in one more pass, so a poor sketch costs time, never a value.
    """
    found: dict[tuple[int, int], float] = {}
    open_ = {k: sorted(set(wanted)) for k, wanted in ranks.items() if wanted}
    brackets = {k: _apart(known[k].around) for k in open_}
    while open_:
        counts = _counted(values, brackets)
        totals: dict[int, dict[int, int]] = {k: {} for k in open_}
        for row in counts.groupBy("k", "slot").agg(F.sum("n").alias("n")).collect():
            totals[row.k][row.slot] = row.n
        asked, missed = [], {}
        for k, wanted in open_.items():
            own, before = brackets[k], 0
            for slot in range(2 * len(own) + 1):
                here = [r for r in wanted if before <= r < before + totals[k].get(slot, 0)]
                if slot % 2:
                    asked += [(k, slot, r, r - before) for r in here]
                elif here:
                    ends = (known[k].low if slot == 0 else own[slot // 2 - 1][1], known[k].high if slot == 2 * len(own) else own[slot // 2][0])
                    missed.setdefault(k, []).append((ends, here))
                before += totals[k].get(slot, 0)
        if asked:
            # A row for every wanted rank.
            places = values.sparkSession.createDataFrame(asked, "k int, slot int, rank long, place long")
            inside = counts.join(F.broadcast(places.select("k", "slot").distinct()), ["k", "slot"], "left_semi")
            till = F.sum("n").over(Window.partitionBy("k", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            summed = inside.select("k", "slot", "v", "n", till.alias("till"))
            hit = summed.join(F.broadcast(places), ["k", "slot"]).filter((F.col("place") < F.col("till")) & (F.col("place") >= F.col("till") - F.col("n")))
            found |= {(row.k, row.rank): row.v for row in hit.select("k", "rank", "v").collect()}
        brackets = {k: _apart([ends for ends, _ in gaps]) for k, gaps in missed.items()}
        open_ = {k: [r for _, here in gaps for r in here] for k, gaps in missed.items()}
    return {k: [found[k, r] for r in wanted] for k, wanted in ranks.items()}


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """Exact values at 0-based ``ranks`` among the non-null values of a numeric column."""
    values = _requested(df, [F.col(column)])
    total = values.agg(F.count("v0")).first()[0]
    if any(r < 0 or r >= total for r in ranks):
        raise ValueError(f"rank outside the {total} values")
    if not ranks:
        return []
    return _at_ranks(values, _sketched(values, [[(r + 0.5) / total for r in ranks]]), {0: ranks})[0]


def several_quantiles(
    df: DataFrame, columns: Sequence[Column], probs: Sequence[Sequence[float]], interpolate: bool = False
) -> list[list[float | None]]:
    """Exact quantiles of several columns in two passes: one of sketches, one that counts near the wanted ranks.

    By rank, the smallest value whose share of the column's rows reaches ``p``, or interpolated.
    """
    values = _requested(df, columns)
    known = _sketched(values, probs)
    wanted: dict[int, list[int]] = {}
    for k, own in enumerate(probs):
        count = known[k].count
        if not count:
            continue
        if interpolate:
            wanted[k] = [r for p in own for r in (math.floor(p * (count - 1)), math.ceil(p * (count - 1)))]
        else:
            wanted[k] = [min(max(math.ceil(p * count) - 1, 0), count - 1) for p in own]
    at = _at_ranks(values, known, wanted)
    out: list[list[float | None]] = []
    for k, own in enumerate(probs):
        if k not in at:
            out.append([None] * len(own))
        elif interpolate:
            spots = [p * (known[k].count - 1) for p in own]
            out.append([at[k][2 * i] + (at[k][2 * i + 1] - at[k][2 * i]) * (s - math.floor(s)) for i, s in enumerate(spots)])
        else:
            out.append(at[k])
    return out


def quantiles(df: DataFrame, column: str, probs: Sequence[float], interpolate: bool = False) -> list[float | None]:
    """Exact quantiles of one column; see ``several_quantiles``."""
    return several_quantiles(df, [F.col(column)], [probs], interpolate)[0]


def kth_smallest(df: DataFrame, column: str, k: int) -> Column:
    """The k-th smallest value (or the largest when there are fewer), as a column usable on ``df``.

    Null and NaN are no values, however many are asked for.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    if k <= TAKE_LIMIT:
        # Every task keeps its k smallest values, so no task sees more than k rows of each other task.
        return values.orderBy("v").limit(k).agg(F.max("v")).scalar()
    count = values.count()
    if not count:
        return F.lit(None).cast("double")
    return F.lit(order_statistics(values, "v", [min(k, count) - 1])[0])


def within_top_k(df: DataFrame, column: str, k: int) -> Column:
    """True for rows whose rank by ``column`` ascending, ties sharing a rank, is at most ``k``; never null."""
    return F.coalesce(F.col(column) <= kth_smallest(df, column, k), F.lit(False))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; every task keeps only ``n`` rows per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")
