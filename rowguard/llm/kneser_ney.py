"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

1. Trusted texts are written once as places in lists of their different words. For a part of the middle words after
   the other, their trigrams go to shards of their last two words, which count them and write them in blobs. Pairs
   (how many words stand before them), words (how many before them) and contexts (how many n-grams of count 1, 2
   and more they have) are counted from these. The model is a table of keys (64-bit hashes of words, pairs and trigrams)
   and counts, discounts are a few numbers; it is written where its shard is, so reading it moves nothing.
2. Documents are scored a share at a time. They are cut into chunks, written as different words and places among them. A chunk asks shards of
   the keys for its different words, pairs and trigrams; a shard holds its part of the model and answers each
   chunk with counts, of which the chunk works out probabilities and adds up its documents.

No n-gram or count passes through the driver or a broadcast, and nothing is left out: a task holds
one chunk or one shard, whose sizes do not depend on the input. A document passes if its perplexity is at
most its language's quantile over all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard.llm.trie_scores import _batch, _in_order, _ranges, _stream, packed, unpacked
from rowguard.llm.words import mix, slices, word_hashes, words
from rowguard.operators.joins import lookup_join
from rowguard.session import cut_lineage, release

CHUNK_BYTES = 8 << 20
LEAST_SHARDS = 32
CHUNKS_PER_SHARD = 8
FIT_WAVES, WAVES = 4, 9
PACKED_ROWS = 1 << 20
KEEP = 0.85
START, END = np.uint64(1), np.uint64(2)
ADAPTIVE = "spark.sql.adaptive.enabled"
PAIR_BITS = np.uint64(((1 << 16) - 1) << 48)
WAVE_BITS = (FIT_WAVES - 1).bit_length()
_TURNS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each text two starts, its words and one end; words and end per text."""
    found = words(texts)
    n = np.diff(found.first) + 1
    ends = np.cumsum(n + 2)
    line = np.full(ends[-1] if len(ends) else 0, START, np.uint64)
    line[_ranges(ends - n, n - 1)] = word_hashes(found)
    line[ends - 1] = END
    return line, n


def _grams(line: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = _ranges(np.cumsum(n + 2) - n - 2, n)
    return np.stack([line[at], line[at + 1], line[at + 2]])


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three columns of word hashes, one row per token with two words before it, and tokens per text.

    A text is its words and one end; two starts stand before it.
    """
    line, n = _lines(texts)
    return _grams(line, n), n


def _key(*parts: np.ndarray) -> np.ndarray:
    return mix(reduce(lambda h, x: mix(h * _TURNS[0] + x), parts[1:], parts[0] * _TURNS[1] + _TURNS[2] * np.uint64(len(parts))))


def _class(words: np.ndarray) -> np.ndarray:
    """One of ``FIT_WAVES`` for each middle word."""
    return mix(words) >> np.uint64(64 - WAVE_BITS)


def keys(shards: int, *parts: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of word hashes.

    A trigram's begins as that of its last two words, so both are in one shard. Below the bits that name the shard
    come those of the first of the two, so what the waves write of a shard, one after the other, is in order.
    """
    key = _key(*parts)
    if len(parts) == 1:
        return key
    if len(parts) == 3:
        return keys(shards, *parts[1:]) & PAIR_BITS | key & ~PAIR_BITS
    at = np.uint64(65 - shards.bit_length() - WAVE_BITS)
    return key & ~(np.uint64(FIT_WAVES - 1) << at) | _class(parts[0]) << at


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each different value begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _power_of_two(n: int) -> int:
    """The least one that is not below ``n``, up to what a trigram's key has of its pair's besides the wave."""
    return 1 << min((n - 1).bit_length(), 16 - WAVE_BITS)


def _edges(asked: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin and end."""
    step = (1 << 64) // shards
    inner = np.searchsorted(asked, np.array([s * step for s in range(1, shards)], np.uint64))
    return np.concatenate([[0], inner, [len(asked)]])


def _find(part: tuple[np.ndarray, np.ndarray] | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys wanted are there, and their columns."""
    if part is None or not len(part[0]):
        return np.zeros(0, np.int64), np.zeros((4, 0), np.int64)
    held, x = part
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    hit = np.flatnonzero(held[at] == wanted)
    return hit, x[:, at[hit]]


def _counts(parts: dict, level: int, wanted: np.ndarray, shards: int) -> list[np.ndarray]:
    """Counts of the n-grams wanted, of how many n-grams each is the context, and for more than one what those are ``_seen`` as."""
    count, total = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    hit, x = _find(parts.get((level, False)), wanted)
    count[hit] = x[0]
    if level == 3:
        return [count]
    asked = np.arange(len(wanted))
    if level == 2:
        # A pair tells of itself as a context that occurs once; others, and the one no text has before it, are in the table of contexts.
        total[hit] = x[1] == 1
        asked = np.flatnonzero((count > 0) & (total == 0) | (wanted == _first_context(shards)))
    hit, seen = _find(parts.get((level, True)), wanted[asked])
    total[asked[hit]] = _total(seen)
    return [count, total, seen[:, _total(seen) > 1]]


def _first_context(shards: int) -> np.ndarray:
    """Key of the two starts before a text."""
    return keys(shards, np.array([START]), np.array([START]))


def _total(seen: np.ndarray) -> np.ndarray:
    return seen[0] + 2 * seen[1] + 3 * seen[2] + seen[3]


class Rates(NamedTuple):
    """What probabilities need besides counts: discounts of words, pairs and trigrams, all pairs, an unknown word's share."""

    discounts: tuple[tuple[float, float, float], ...]
    total: int
    floor: float

    def _off(self, level: int, count: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts[level - 1]])[np.minimum(count, 3)]

    def words(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and their logarithms."""
        p = (count - self._off(1, count)) / self.total + self.floor
        return p, np.where(count > 0, np.log(p), np.log(self.floor)).astype(np.float32)

    def contexts(self, level: int, total: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, back-off weights and their logarithms for contexts of n-grams of the level; ``seen`` has those of more than one."""
        by = self.discounts[level - 1]
        weight = np.array([1.0, by[0]])[np.minimum(total, 1)]
        log_weight = np.log(np.array([1.0, by[0]])).astype(np.float32)[np.minimum(total, 1)]
        more = np.flatnonzero(total > 1)
        weight[more] = sum(n * d for n, d in zip(seen, by)) / total[more]
        log_weight[more] = np.log(weight[more])
        return total, weight, log_weight

    def above(self, level: int, count: np.ndarray, context: tuple[np.ndarray, ...], p: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``words``, for n-grams of the level with their contexts and what the level below has for them."""
        total, weight, log_weight = context
        p, log_p = weight * p, log_weight + log_p
        hit = np.flatnonzero(count)
        own = count[hit]
        p[hit] += (own - self._off(level, own)) / total[hit]
        log_p[hit] = np.log(p[hit]).astype(np.float32)
        return p, log_p


class Model(NamedTuple):
    parts: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]  # by level, counts of n-grams or of contexts
    rates: Rates
    shards: int

    def token_scores(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of every row's last word after the two before it."""
        u, v, w = grams
        (count, *_), (two, *own), (pair, *_), (_, *above), (three,) = (
            _counts(self.parts, len(x), keys(self.shards, *x), self.shards) for x in ((w,), (v,), (v, w), (u, v), (u, v, w))
        )
        found = self.rates.above(2, pair, self.rates.contexts(2, *own), *self.rates.words(count))
        return self.rates.above(3, three, self.rates.contexts(3, *above), *found)[1]


def _discounts(seen: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts of counts 1, 2 and 3 or more, within 0 and the count; ``seen``: how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = seen
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


_BLOB = "words binary, often binary, rows binary, counts binary"
_TABLE = "shard long, level int, weight boolean, keys binary, x binary"


def _blob(names: np.ndarray, place: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows as places among ``names`` (different, in order), of which those that occur are kept, the most frequent first."""
    often = np.bincount(place.ravel(), minlength=len(names))
    used = np.flatnonzero(often)
    ranked = np.empty(len(names), np.int64)
    ranked[used[np.argsort(-often[used], kind="stable")]] = np.arange(len(used))
    return _batch({"words": packed(np.diff(names[used], prepend=np.uint64(0))), "often": packed(often[used]), "rows": packed(ranked[place].ravel()), "counts": packed(counts)})


def _opened(row: dict, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, rows as places among them, and counts of a ``_blob``."""
    order = np.argsort(-unpacked(row["often"]), kind="stable")
    return np.cumsum(unpacked(row["words"])).view(np.uint64)[order], unpacked(row["rows"]).reshape(columns, -1), unpacked(row["counts"])


def _each(table: DataFrame, make: Callable[..., Iterator[pa.RecordBatch]], layout: str, columns: int) -> DataFrame:
    """``make`` of every blob of a table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from make(*_opened(row, columns))

    return table.mapInArrow(each, layout)


def _texts(trusted: DataFrame, text_col: str) -> DataFrame:
    """Texts in blobs: all their words in a row, with two starts and an end each, and how many words and end each has."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blob() -> pa.RecordBatch:
            line, n = (np.concatenate(x) for x in zip(*held))
            names, place = np.unique(line, return_inverse=True)
            return _blob(names, place, n)

        for batch in batches:
            for part in slices(batch, "body"):
                held.append(_lines(part.column("body")))
                if sum(len(line) for line, _ in held) >= PACKED_ROWS:
                    yield blob()
                    held = []
        if held:
            yield blob()

    return trusted.select(F.col(text_col).cast("string").alias("body")).mapInArrow(pack, _BLOB)


def _counted(texts: DataFrame, shards: int, wave: int, waves: int) -> DataFrame:
    """Counts of the trigrams whose middle word belongs to the wave, a blob per shard, in order of their keys."""

    def send(names: np.ndarray, line: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        line = line[0]
        at = _ranges(np.cumsum(n + 2) - n - 2, n)
        if waves > 1:
            at = at[(_class(names) * np.uint64(waves) // np.uint64(FIT_WAVES) == np.uint64(wave))[line[at + 1]]]
        if not len(at):
            return
        key = keys(shards, *[names[line[at + i]] for i in range(3)])
        order = np.argsort(key)
        first = _starts(key[order])
        counts = np.diff(np.append(first, len(order)))
        at, key = at[order[first]], key[order[first]]
        cuts = _edges(key, shards)
        shard = np.repeat(np.arange(shards), np.diff(cuts))
        # Every shard gets a list of its own words.
        order, first, (of, word) = _in_order(np.tile(shard, 3), np.concatenate([line[at + i] for i in range(3)]))
        words_cuts = np.searchsorted(of, np.arange(shards + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)) - words_cuts[of], np.diff(np.append(first, len(order))))
        place = place.reshape(3, -1)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[s], cuts[s + 1])
            yield _batch({"shard": s, "words": names[word[words_cuts[s] : words_cuts[s + 1]]].tobytes(), "rows": packed(place[:, own].ravel()), "counts": packed(counts[own])})

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")]
        names, back = np.unique(np.concatenate(lists), return_inverse=True)
        begin = np.cumsum([0, *map(len, lists)])
        place = np.concatenate([back[unpacked(x.as_py()).reshape(3, -1) + b] for x, b in zip(table.column("rows"), begin)], axis=1)
        counts = np.concatenate([unpacked(x.as_py()) for x in table.column("counts")])
        key = keys(shards, *names[place])
        order = np.argsort(key)
        first = _starts(key[order])
        return pa.Table.from_batches([_blob(names, place[:, order[first]], np.add.reduceat(counts[order], first))])

    return _each(texts, send, "shard long, words binary, rows binary, counts binary", 1).groupBy("shard").applyInArrow(meet, _BLOB)


def _pairs(names: np.ndarray, rows: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs that end the trigrams, in order, their places, where each begins, and the order of trigrams."""
    key = keys(shards, names[rows[1]], names[rows[2]])
    order = np.argsort(key)
    first = _starts(key[order])
    return key[order[first]], rows[1:, order[first]], first, order


def _seen(counts: np.ndarray) -> np.ndarray:
    """Per row: whether the count is 1, 2, or more, and by how much it is over 3."""
    return np.stack([counts == 1, counts == 2, counts >= 3, np.maximum(counts - 3, 0)]).astype(np.int64)


def _summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    first = _starts(key[order])
    return key[order[first]], np.add.reduceat(x[:, order], first, axis=1) if len(first) else x


def _sent(key: np.ndarray, x: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Keys in order and their columns, a message to each shard."""
    cuts = _edges(key, shards)
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[s], cuts[s + 1])
        yield _batch({"shard": s, "keys": packed(np.diff(key[own], prepend=np.uint64(0))), "x": packed(x[:, own].ravel())})


_MESSAGE = "shard long, keys binary, x binary"


def _column(row: dict) -> tuple[np.ndarray, np.ndarray]:
    held = np.cumsum(unpacked(row["keys"])).view(np.uint64)
    x = unpacked(row["x"])
    return held, x.reshape(len(x) // max(1, len(held)), len(held))


def _row(shard: int, level: int, weight: bool, key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    values = [shard, level, weight, packed(np.diff(key, prepend=np.uint64(0))), packed(x.ravel())]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["shard", "level", "weight", "keys", "x"])


def _met(messages: DataFrame, level: int, weight: bool, shards: int) -> DataFrame:
    """Part of a model's table, a row per shard: the sums of what was sent for each key."""
    only = _first_context(shards)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        held, x = zip(*map(_column, table.to_pylist()))
        held, x = _summed(np.concatenate(held), np.concatenate(x, axis=1))
        if level == 2:
            # A context that occurs once is told by its pair, which occurs once too, but for the one no text has before it.
            kept = np.flatnonzero((_total(x) > 1) | (held == only))
            held, x = held[kept], x[:, kept]
        return pa.Table.from_batches([_row(key[0].as_py(), level, weight, held, x)])

    return messages.groupBy("shard").applyInArrow(meet, _TABLE)


def _in_shards(table: DataFrame, shards: int) -> DataFrame:
    """Part of a model's table, each shard's row written where the shard is, so that what asks for it comes to it.

    Adaptive execution would forget how the rows are dealt, so it is off for this step.
    """
    conf = table.sparkSession.conf
    before = conf.get(ADAPTIVE)
    conf.set(ADAPTIVE, "false")
    try:
        return cut_lineage(table.repartition(shards, "shard"))
    finally:
        conf.set(ADAPTIVE, before)


def entries(trusted: DataFrame, text_col: str = "text", shards: int = LEAST_SHARDS, waves: int = 1) -> tuple[list[DataFrame], Rates]:
    """The model of all texts in ``trusted`` as tables ``_in_shards``, and what turns its counts into probabilities.

    Tables: ``level``, ``keys`` in order as differences, ``x``: the count of each n-gram (of different words before it
    but for trigrams) or, where ``weight`` holds, of each as a context what its n-grams are ``_seen`` as. No texts
    at all give a uniform model. ``shards`` is a power of two. Trigrams are counted wave by wave, each with
    those whose middle word belongs to it, so that only a wave's messages are on disk at a time.
    """
    texts = cut_lineage(_texts(trusted, text_col))
    tri = [cut_lineage(_counted(texts, shards, wave, waves)) for wave in range(waves)]
    release(texts)
    every = reduce(DataFrame.unionByName, tri)
    shift = np.uint64(65 - shards.bit_length())

    def word_blob(names: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Per word how many of the pairs end in it, and of those that begin with it how many have counts 1 to 4, more, and by how much over 3."""
        _, (v, w), first, _ = _pairs(names, rows, shards)
        before = np.diff(np.append(first, rows.shape[1]))
        over = np.where(before > 4, before - 3, 0)
        columns = [np.bincount(w, minlength=len(names))] + [np.bincount(v, x, len(names)).astype(np.int64) for x in (*[before == k for k in (1, 2, 3, 4)], over > 0, over)]
        order = np.argsort(names)
        columns = np.stack(columns)[:, order]
        used = np.flatnonzero(columns.any(axis=0))
        yield _blob(names[order], used[None], columns[:, used].ravel())

    def word_rows(names: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        before = counts.reshape(7, -1)[0]
        used = np.flatnonzero(before)
        for a in range(0, len(used), 1 << 16):
            part = used[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(names[rows[0][part]].view(np.int64)), pa.array(before[part])], names=["w", "n"])

    def of_pairs(counts: np.ndarray) -> list[int]:
        return counts.reshape(7, -1)[1:5].sum(axis=1).tolist()

    def of_trigrams(counts: np.ndarray) -> list[int]:
        return [int((counts == k).sum()) for k in (1, 2, 3, 4)]

    def four(table: DataFrame, of: Callable[[np.ndarray], list[int]]) -> tuple[int, ...]:
        """How many n-grams have counts 1 to 4, by the counts of each blob."""
        names = ["n1", "n2", "n3", "n4"]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for counts in batch.column("counts"):
                    yield _batch(dict(zip(names, of(unpacked(counts.as_py())))))

        found = table.select("counts").mapInArrow(each, ", ".join(f"{n} long" for n in names))
        return tuple(found.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first())

    bi = cut_lineage(_each(every, word_blob, _BLOB, 3))
    uni = cut_lineage(_each(bi, word_rows, "w long, n long", 1).groupBy("w").agg(F.sum("n").alias("c")))
    total, vocabulary, *seen = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), *[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    discounts = (_discounts(tuple(seen)), _discounts(four(bi, of_pairs)), _discounts(four(every, of_trigrams)))
    left = sum(n * d for n, d in zip((*seen[:2], vocabulary - sum(seen[:2])), discounts[0]))
    rates = Rates(discounts, total or 1, (left / total if total else 1.0) / (vocabulary + 1))

    def words_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            return _sent(*_summed(keys(shards, rows.column("w").to_numpy().view(np.uint64)), rows.column("c").to_numpy()[None]), shards)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield from sent()
                held, n = [], 0
        if n:
            yield from sent()

    def word_contexts(names: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, one, two, three, four, more, over = counts.reshape(7, -1)
        seen = np.stack([one, two, three + four + more, four + over])
        used = np.flatnonzero(seen.any(axis=0))
        yield from _sent(*_summed(keys(shards, names[rows[0][used]]), seen[:, used]), shards)

    def pair_contexts(names: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from _sent(*_summed(keys(shards, names[rows[0]], names[rows[1]]), _seen(counts)), shards)

    def trigram_row(names: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = keys(shards, *names[rows])
        yield _row(int(key[0] >> shift), 3, False, key, counts)

    def pair_row(names: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, _, first, order = _pairs(names, rows, shards)
        x = np.stack([np.diff(np.append(first, len(order))), np.add.reduceat(counts[order], first)])
        yield _row(int(key[0] >> shift), 2, False, key, x)

    tables = [_in_shards(_met(uni.mapInArrow(words_sent, _MESSAGE), 1, False, shards), shards)]
    release(uni)
    tables.append(_in_shards(_met(_each(bi, word_contexts, _MESSAGE, 1), 1, True, shards), shards))
    release(bi)
    for own in tri:
        for table in (_each(own, trigram_row, _TABLE, 3), _each(own, pair_row, _TABLE, 3), _met(_each(own, pair_contexts, _MESSAGE, 3), 2, True, shards)):
            tables.append(_in_shards(table, shards))
        release(own)
    return tables, rates


def _parts(rows: list[dict]) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Keys in order and their columns, of each level's n-grams and contexts."""
    parts: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in rows:
        parts.setdefault((row["level"], row["weight"]), []).append(_column(row))
    out = {}
    for level, held in parts.items():
        held = [x for x in held if len(x[0])]
        key, x = (np.concatenate([h[i] for h in sorted(held, key=lambda h: h[0][0])], axis=-1) for i in (0, 1)) if held else (np.zeros(0, np.uint64), np.zeros((4, 0), np.int64))
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")  # merges what is in order already
            key, x = key[order], x[:, order]
        out[level] = key, x
    return out


def fit(trusted: DataFrame, text_col: str = "text") -> Model:
    """The whole model in memory, for few texts; ``judged`` leaves it in shards."""
    tables, rates = entries(trusted, text_col)
    return Model(_parts(reduce(DataFrame.unionByName, tables).toArrow().to_pylist()), rates, LEAST_SHARDS)


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """All documents that every label calls good; rows of one id and text count once."""
    good = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("good"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias(text_col))
    return lookup_join(rows, good.filter("good = 1").select("id"), "id", "inner").dropDuplicates(["id", text_col])


def _chunks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "body", CHUNK_BYTES):
                line, n = _lines(part.column("body"))
                different, stream, counts = np.unique(line, return_inverse=True, return_counts=True)
                # Places by falling count take fewer bytes.
                order = np.argsort(-counts, kind="stable")
                ranked = np.empty(len(order), np.int64)
                ranked[order] = np.arange(len(order))
                yield _batch({"chunk": number, "ids": _stream(part.select(["id", "lang"])), "lengths": packed(n), "stream": packed(ranked[stream]), "words": different[order].tobytes()})
                number += 1

    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(each, "chunk long, ids binary, lengths binary, stream binary, words binary")


def _numbered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number per row that equal rows share; by number, where it first occurs and its two values."""
    order, first, (x, y) = _in_order(x, y)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return of, order[first], x, y


class _Chunk:
    """A chunk's different words, pairs and trigrams."""

    def __init__(self, row: dict, shards: int):
        self.n = unpacked(row["lengths"])
        names = np.frombuffer(row["words"], np.uint64)
        line = unpacked(row["stream"])
        at = _ranges(np.cumsum(self.n + 2) - self.n - 2, self.n)
        pair, _, self.a, self.b = _numbered(line[:-1], line[1:])
        self.gram, first, self.context, last = _numbered(pair[at], line[at + 2])
        self.lower = pair[at[first] + 1]
        a, b = names[self.a], names[self.b]
        pairs = keys(shards, a, b)
        self.keys = [keys(shards, names), pairs, pairs[self.lower] & PAIR_BITS | _key(a[self.context], b[self.context], names[last]) & ~PAIR_BITS]

    def scores(self, found: list[list[np.ndarray]], rates: Rates) -> np.ndarray:
        """Log probability of each text, given ``_counts`` of each level by order of keys."""
        orders = [np.argsort(key) for key in self.keys]

        def placed(order: np.ndarray, x: np.ndarray) -> np.ndarray:
            out = np.empty_like(x)
            out[order] = x
            return out

        words, pairs, grams = (placed(order, x[0]) for order, x in zip(orders, found))
        context, above = ([placed(order, x) for x in rates.contexts(level, *own)] for level, order, (_, *own) in zip((2, 3), orders, found))
        p, log_p = rates.words(words)
        p, log_p = rates.above(2, pairs, [x[self.a] for x in context], p[self.b], log_p[self.b])
        _, log_p = rates.above(3, grams, [x[self.context] for x in above], p[self.lower], log_p[self.lower])
        return np.add.reduceat(log_p[self.gram], np.cumsum(self.n) - self.n)


_ASKED = ["words", "pairs", "trigrams"]
# Counts of each level, of words and pairs as contexts besides, and 4 columns for those of more than one n-gram.
_FOUND = {"words": 1, "word_totals": 1, "word_contexts": 4, "pairs": 1, "pair_totals": 1, "pair_contexts": 4, "trigrams": 1}


def _answers(chunks: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """Per chunk and shard the counts of the keys asked for and of their contexts, zeros where the model has none."""
    layout = "shard long, chunk long, " + ", ".join(f"{c} binary" for c in _FOUND)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = [np.sort(key) for key in _Chunk(row, shards).keys]
                edges = np.stack([_edges(key, shards) for key in asked])
                for s in np.flatnonzero(np.diff(edges).any(axis=0)).tolist():
                    own = [packed(np.diff(key[e[s] : e[s + 1]], prepend=np.uint64(0))) for key, e in zip(asked, edges)]
                    yield _batch({"shard": s, "chunk": row["chunk"], **dict(zip(_ASKED, own))})

    def answer(key: tuple, held: pa.Table, sent: pa.Table) -> pa.Table:
        parts = _parts(held.select(["level", "weight", "keys", "x"]).to_pylist())
        found = []
        for message in sent.select(_ASKED).to_pylist():
            asked = [np.cumsum(unpacked(message[c])).view(np.uint64) for c in _ASKED]
            found.append([packed(x.ravel()) for level, own in enumerate(asked, 1) for x in _counts(parts, level, own, shards)])
        columns = [pa.array([f[i] for f in found], pa.binary()) for i in range(len(_FOUND))]
        return pa.table({"shard": pa.array([key[0].as_py()] * len(found), pa.int64()), "chunk": pa.array(sent.column("chunk").to_pylist(), pa.int64()), **dict(zip(_FOUND, columns))})

    messages = chunks.select("chunk", "lengths", "stream", "words").mapInArrow(ask, "shard long, chunk long, words binary, pairs binary, trigrams binary")
    return model.groupBy("shard").cogroup(messages.groupBy("shard")).applyInArrow(answer, layout)


def perplexities(
    docs: DataFrame, model: DataFrame, rates: Rates, shards: int, waves: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``id, lang, n_tokens, perplexity`` for every row under a model ``_in_shards``; a null text is empty: one end token.

    Documents are scored wave by wave (by hash of their text), so that only a wave's keys and answers are on disk at a time.
    """

    def score(key: tuple, held: pa.Table, replies: pa.Table) -> pa.Table:
        row = {c: held.column(c)[0].as_py() for c in held.column_names}
        chunk = _Chunk(row, shards)
        replies = replies.sort_by("shard")
        found = [np.concatenate([unpacked(r.as_py()).reshape(n, -1) for r in replies.column(c)], axis=1) for c, n in _FOUND.items()]
        found = [x if n > 1 else x[0] for x, n in zip(found, _FOUND.values())]
        sums = chunk.scores([found[:3], found[3:6], found[6:]], rates)
        ids = pa.ipc.open_stream(row["ids"]).read_all()
        return pa.table({"id": ids.column("id"), "lang": ids.column("lang"), "n_tokens": chunk.n, "perplexity": np.exp(-sums / chunk.n)})

    layout = f"id {docs.schema[id_col].dataType.simpleString()}, lang string, n_tokens long, perplexity double"
    out = []
    for wave in range(waves):
        own = docs.filter(F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(waves)) == wave) if waves > 1 else docs
        chunks = cut_lineage(_chunks(own, id_col, text_col, lang_col))
        answers = _answers(chunks, model, shards)
        out.append(cut_lineage(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, layout)))
        release(chunks)
    return reduce(DataFrame.unionByName, out)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: float = KEEP) -> DataFrame:
    """``id, lang, n_tokens, perplexity, threshold, kept``: one row per row of ``docs``.

    ``threshold`` is the ``keep`` quantile of the perplexities of all documents of the language (exact to
    1/10,000 of their ranks); null is a language like any other.
    """
    # A share of the input at a time is on disk beside the model; no wave has less than a chunk of text.
    chunks = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0] // CHUNK_BYTES + 1
    waves, shards = min(FIT_WAVES, chunks), _power_of_two(max(LEAST_SHARDS, -(-chunks // CHUNKS_PER_SHARD)))
    tables, rates = entries(trusted_texts(docs, labels, id_col, text_col), text_col, shards, waves)
    scored = perplexities(docs, reduce(DataFrame.unionByName, tables), rates, shards, min(WAVES, chunks), id_col, text_col, lang_col)
    cuts = scored.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("perplexity", F.lit(keep), F.lit(10_000)).alias("threshold"))
    joined = scored.join(cuts, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("kept", F.col("perplexity") <= F.col("threshold"))
