"""String similarity columns.

Spark has edit distance built in; Jaro-Winkler and the composite score have no built-in
expression, so they run as Arrow-batched functions over candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normalised(column: str | Column) -> Column:
    """Lower case, everything but letters and digits as a space, trimmed."""
    value = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", " "))


def tokens_of(norm: Column) -> Column:
    """Sorted distinct words of a normalised string."""
    return F.array_sort(F.array_distinct(F.filter(F.split(norm, " "), lambda t: t != "")))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table held as bits of an integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """Share of characters kept by insertions and deletions only, 0-100."""
    total = len(a) + len(b)
    return int(200.0 * common_subsequence(a, b) / total + 0.5) if total else 100


def best_window_ratio(a: str, b: str) -> int:
    """Best ratio of the shorter string against the windows of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    width = len(short)
    best = 0
    for start in range(1 - width, len(long)):
        window = long[max(start, 0) : start + width]
        best = max(best, ratio(short, window))
        if best == 100:
            break
    return best


def set_ratio(a: list[str], b: list[str], measure=ratio) -> int:
    """Best of shared words against each side's shared-plus-own words, and of those two; 0 without a shared word."""
    shared = sorted(set(a) & set(b))
    if not shared:
        return 0
    base = " ".join(shared)
    left = " ".join(shared + sorted(set(a) - set(b)))
    right = " ".join(shared + sorted(set(b) - set(a)))
    return max(measure(base, left), measure(base, right), measure(left, right))


def composite(a: str | None, b: str | None) -> float:
    """Weighted similarity of two normalised strings, 0-100; 0 when a side is empty."""
    if not a or not b:
        return 0.0
    words_a, words_b = sorted(set(a.split())), sorted(set(b.split()))
    sorted_a, sorted_b = " ".join(words_a), " ".join(words_b)
    best = float(ratio(a, b))
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        best = max(best, 0.95 * ratio(sorted_a, sorted_b), 0.95 * set_ratio(words_a, words_b))
    else:
        scale = 0.9 if spread <= 8 else 0.6
        best = max(best, scale * best_window_ratio(a, b), 0.95 * scale * best_window_ratio(sorted_a, sorted_b))
        best = max(best, 0.95 * scale * set_ratio(words_a, words_b, best_window_ratio))
    return float(int(best + 0.5))


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler similarity, 0-1; prefix weight 0.1 over at most 4 characters, from 0.7 on."""
    if a is None or b is None:
        return None
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    kept = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                kept.append(ch)
                break
    m = len(kept)
    if not m:
        return 0.0
    other = [ch for ch, hit in zip(b, taken) if hit]
    swaps = sum(x != y for x, y in zip(kept, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1.0 - jaro)


@F.pandas_udf(DoubleType())
def _composite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([composite(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(DoubleType())
def _jaro_winkler(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([jaro_winkler(a, b) for a, b in zip(left, right)], dtype="float64")


def composite_score(left: str | Column, right: str | Column) -> Column:
    """Composite weighted similarity 0-100 of two raw string columns; 0 when either is null or empty."""
    return _composite(normalised(left), normalised(right))


def jaro_winkler_score(left: str | Column, right: str | Column) -> Column:
    """Jaro-Winkler similarity times 100 of two raw string columns."""
    return _jaro_winkler(left, right) * F.lit(100.0)


def score_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add both similarities to a table of candidate pairs."""
    return pairs.withColumns(
        {
            "similarity_score_fuzzy": composite_score(left, right),
            "similarity_score_jellyfish": jaro_winkler_score(left, right),
        }
    )
