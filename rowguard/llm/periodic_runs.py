"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are identical) that repeats at least
``exponent`` times, has ``least`` words or more, and that no neighbouring word extends. All texts of a slice
of a batch are looked at together, a word of one text never being equal to a word of another:

1. Prefix doubling gives the suffix array and, for every power of two m, a name for each stretch of m words;
   equal stretches, equal names. The stretches of one name are a range of the suffix array.
2. A wavelet tree over the suffix array answers range successor: the first occurrence at or after a place
   among those of a range. Every dyadic block (m words from a multiple of m on) asks for its occurrences in
   the window where a run that holds the block and has a period of that scale must repeat it.
3. A window spans less than m words, so its occurrences are an arithmetic progression. One or two members
   are candidate periods as they are. Three or more mean that the block itself repeats by the progression's
   difference; then a period of the surroundings must carry one end of that repetition onto the same end of
   the one in the window, which leaves two candidates whatever the number of members.
4. Candidates are extended to both sides by halving over the names and kept if long enough.

A run of L >= exponent * q words holds, for the m with (2m - 1) / (exponent - 1) <= q < (4m - 1) / (exponent - 1),
a whole dyadic block and the block's copy q words on, so no run is missed. Blocks, windows and candidates
are in proportion to the words at every scale: n log n in all, also for a text of one repeated word.

Every text is worked on where it lies, nothing is shuffled. A task holds about 2 MB of text at a time, or one
longer text at some 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard.llm.words import flat, slices, words

EXPONENT = 4
LEAST = 6


class Runs(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


class Occurrences:
    """Wavelet tree over a suffix array: range rank, range quantile, and so range successor, for many queries at once."""

    def __init__(self, places: np.ndarray):
        self.bits = max(1, len(places).bit_length())
        self.ones, self.zeros = [], []
        left = places
        for bit in range(self.bits - 1, -1, -1):
            up = (left >> bit) & 1
            count = np.zeros(len(left) + 1, np.int32)
            np.cumsum(up, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(left) - int(count[-1]))
            up = up.astype(bool)
            left = np.concatenate([left[~up], left[up]])

    def before(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many places in [low, high) of the suffix array are under ``bound``."""
        total = np.zeros(len(low), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = (bound >> (self.bits - 1 - k)) & 1 == 1
            low1, high1 = ones[low], ones[high]
            low0, high0 = low - low1, high - high1
            total += np.where(up, high0 - low0, 0)
            low, high = np.where(up, zeros + low1, low0), np.where(up, zeros + high1, high0)
        return total

    def at(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place of that rank, by value, in [low, high); with ``before`` as the rank: the successor."""
        value = np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            low1, high1 = ones[low], ones[high]
            low0, high0 = low - low1, high - high1
            up = rank >= high0 - low0
            rank = np.where(up, rank - (high0 - low0), rank)
            value = value * 2 + up
            low, high = np.where(up, zeros + low1, low0), np.where(up, zeros + high1, high0)
        return value


def named_stretches(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... symbols from every place, until all differ, and the suffix array.

    A name is where the range of its suffixes begins in the suffix array. Only stretches that are still
    equal to another are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    name = np.empty(n, np.int32)
    names: list[np.ndarray] = []
    open_, key = np.arange(n), symbols[order]
    size = 1
    while True:
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(begins, len(key)))
        name = name.copy()
        name[order[open_]] = np.repeat(open_[begins], counts)
        names.append(name)
        open_ = open_[np.repeat(counts > 1, counts)]
        if not len(open_):
            return names, order
        places = order[open_]
        after = np.full(len(places), -1, np.int64)
        inside = places + size < n
        after[inside] = name[places[inside] + size]
        key = name[places].astype(np.int64) * (n + 1) + after + 1
        moved = np.argsort(key, kind="stable")
        order[open_], key = places[moved], key[moved]
        size *= 2


def _common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from a and b on (or, ``back``, up to them) are the same."""
    n = len(names[0])
    a, b = a.copy(), b.copy()
    total = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        if back:
            fits = np.flatnonzero((a >= size) & (b >= size))
            same = fits[names[k][a[fits] - size] == names[k][b[fits] - size]]
            a[same] -= size
            b[same] -= size
        else:
            fits = np.flatnonzero((a < n) & (b < n))
            same = fits[names[k][a[fits]] == names[k][b[fits]]]
            a[same] += size
            b[same] += size
        total[same] += size
    return total


def _candidates(names: list[np.ndarray], order: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and the distances at which a run may repeat them."""
    n = len(order)
    tree = Occurrences(order)
    blocks, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, name in enumerate(names):
        size = 1 << k
        nearest, farthest = -(-(2 * size - 1) // (exponent - 1)), (4 * size - 2) // (exponent - 1)
        block = np.arange(0, n - size + 1, size)
        if nearest > farthest or not len(block):
            continue
        many = np.bincount(name, minlength=n)
        block = block[many[name[block]] > 1]
        low = name[block].astype(np.int64)
        high = low + many[low]
        skipped = tree.before(low, high, np.minimum(block + nearest, n))
        found = tree.before(low, high, np.minimum(block + farthest + 1, n)) - skipped
        some = found > 0
        block, low, high, skipped, found = block[some], low[some], high[some], skipped[some], found[some]
        if not len(block):
            continue
        first = tree.at(low, high, skipped)
        several = found > 1
        second = np.full(len(block), -1, np.int64)
        second[several] = tree.at(low[several], high[several], skipped[several] + 1)
        few = found < 3
        blocks += [block[few], block[found == 2]]
        periods += [(first - block)[few], (second - block)[found == 2]]
        b, o, p = block[~few], first[~few], (second - first)[~few]
        heads = [x - _common(names, x, x + p, back=True) for x in (b, o)]
        tails = [x + _common(names, x, x + p) for x in (b, o)]
        for shift in (heads[1] - heads[0], tails[1] - tails[0]):
            good = (shift > 0) & (b + shift < n)
            blocks.append(b[good])
            periods.append(shift[good])
    return np.concatenate(blocks), np.concatenate(periods)


def find_runs(symbols: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> Runs:
    """All runs of a sequence, by start, then period. ``exponent`` is three or more."""
    if exponent < 3:
        raise ValueError("windows hold a progression only from an exponent of three on")
    if not len(symbols):
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    names, order = named_stretches(symbols)
    block, period = _candidates(names, order, exponent)
    start = block - _common(names, block, block + period, back=True)
    end = block + period + _common(names, block, block + period)
    long = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[long], end[long], period[long]
    # Multiples of a run's period give the same stretch again: its smallest period stays.
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return Runs(start[by], end[by], period[by])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def text_runs(texts: pa.Array, exponent: int = EXPONENT, least: int = LEAST) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    found = words(texts)
    raw, _ = flat(texts)
    n = len(found.starts)
    lengths = found.ends - found.starts
    places = np.concatenate([[0], np.cumsum(lengths)])
    inner = np.repeat(found.starts - places[:-1], lengths) + np.arange(places[-1])
    own = pa.LargeStringArray.from_buffers(n, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw[inner])))
    number = own.dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    symbols = text * max(1, len(number.dictionary)) + number.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(symbols, exponent, least)
    of = text[runs.start] if n else np.zeros(0, np.int64)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    parts = [pa.array(x) for x in (runs.start - found.first[of], runs.end - runs.start, runs.period)]
    listed = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, fields=list(RUN)))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.end, -1)
    kept = np.cumsum(change)[:n] == 0
    kept_before = np.concatenate([[0], np.cumsum(kept)])[found.first]
    lists = pa.LargeListArray.from_arrays(pa.array(kept_before), own.filter(pa.array(kept)))
    return pa.array(np.diff(found.first)), listed, pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """``id, n_words, runs, collapsed``, one row per row of ``docs``, whatever its other columns are called.

    ``runs`` holds ``start`` (word number from 0), ``length`` and ``period`` by start, then period. ``collapsed``
    is the words joined by single spaces without those that some run contains after its first period. Words
    are told apart by their bytes, case included. Null texts are empty: no words, no runs, an empty text.
    Null and repeated ids keep their rows; an empty table gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                count, runs, collapsed = text_runs(part.column("body"), exponent, least)
                yield pa.RecordBatch.from_arrays([part.column("id"), count, runs, collapsed.cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
