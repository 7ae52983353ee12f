"""Language-model scores from sharded Elias-Fano n-gram tries that grow with the corpus.

The model has n-grams of any ``order`` with Dirichlet smoothing, p(w | h) = (c(hw) + M p(w | h')) / (c(h) + M),
where h' is the context without its first word and the last level is the smoothed unigram distribution; it
sums to one for every context. A text's start counts as the context of its first word, its end as a word.

1. Texts are tokenized where they lie and written as chunks: different words (64-bit hashes), the text as
   places in that list, training counts.
2. Words meet by shards of their hash: total counts and dense ids go back to the chunks.
3. Level by level, chunks send their different n-grams (but those of which a part is unknown, which the level
   below decides), the context named by its place in the trie of the level below, to shards of the context. A
   context with more than ``SPLIT`` occurrences is spread over shards by its words.
4. A shard adds up the counts and builds its trie. It looks the chunks' n-grams up in the trie: counts and, before
   the highest level, places go back to the chunks, which have the counts of contexts and the probabilities of the
   level below, and so those of the level, rounded as the tries keep them. ``model`` reads the tries.

No word, n-gram or model passes through the driver: it sees three numbers and one size per shard. A task
holds one chunk or one shard, whose sizes do not depend on the input; their number does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard.llm.elias_fano import Trie, quantise, restore
from rowguard.llm.tables import kept_id
from rowguard.llm.words import mix, slices, word_hashes, words
from rowguard.session import cut_lineage

CHUNK_BYTES = 8 << 20
LEAST_SHARDS = 32
CHUNKS_PER_SHARD = 8
SPLIT = 1 << 22
PRIOR = 300.0
END = np.uint64(2)


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:], max_output_size=1 << 40), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _in_order(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of non-negative ``parts`` in order: where they stand, where each different one begins, and the different ones.

    Parts and places are sorted as one number where they fit one, which is several times as fast as by places.
    """
    n = len(parts[0])
    widths = [int(x.max(initial=0)).bit_length() for x in parts]
    place = max(n - 1, 0).bit_length()
    if sum(widths) + place > 63:
        order = np.lexsort(parts[::-1])
        first = np.flatnonzero(reduce(np.logical_or, [np.diff(x[order], prepend=-1) != 0 for x in parts]))
        return order, first, [x[order[first]] for x in parts]
    joined = np.zeros(n, np.int64)
    for x, width in zip([*parts, np.arange(n)], [*widths, place]):
        joined <<= width
        joined |= x
    joined.sort()
    order = joined & ((1 << place) - 1)
    joined >>= place
    first = np.flatnonzero(np.diff(joined, prepend=-1))
    left, different = joined[first], []
    for width in widths[::-1]:
        different.insert(0, left & ((1 << width) - 1))
        left >>= width
    return order, first, different


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


_CHUNK = "chunk long, ids binary, held binary, lengths binary, stream binary, end long, words binary, counts binary"


def _by_count(counts: np.ndarray) -> np.ndarray:
    return _in_order(counts.max(initial=0) - counts)[0]


def _batch(columns: dict) -> pa.RecordBatch:
    kinds = {bytes: pa.binary(), int: pa.int64(), float: pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[type(v)]) for v in columns.values()], names=list(columns))


def _stream(rows: pa.RecordBatch) -> bytes:
    """The rows with their types, as one value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as written:
        written.write_batch(rows)
    return out.getvalue().to_pybytes()


def _chunks(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "body", CHUNK_BYTES):
                # Training documents come first, so a document's place tells its kind.
                held = ~part.column("training").to_numpy(zero_copy_only=False).astype(bool)
                part = part.take(pa.array(np.argsort(held, kind="stable")))
                held = np.sort(held)
                found = words(part.column("body"))
                n = np.diff(found.first) + 1
                ends = np.cumsum(n)
                line = np.full(ends[-1], END)
                line[_ranges(ends - n, n - 1)] = word_hashes(found)
                different, stream = np.unique(line, return_inverse=True)
                trained = int(n[~held].sum())
                counts = np.bincount(stream[:trained], minlength=len(different))
                # Places by falling count take fewer bytes; the order follows from the counts.
                ranked = np.empty(len(different), np.int64)
                ranked[_by_count(counts)] = np.arange(len(different))
                yield _batch(
                    {
                        "chunk": number,
                        "ids": _stream(part.select(["id"])),
                        "held": held.tobytes(),
                        "lengths": packed(n),
                        "stream": packed(ranked[stream]),
                        "end": int(np.searchsorted(different, END)),
                        "words": different.tobytes(),
                        "counts": packed(counts),
                    }
                )
                number += 1

    rows = docs.select(kept_id(docs, id_col)[0], F.col(text_col).cast("string").alias("body"), training.alias("training"))
    return rows.mapInArrow(each, _CHUNK)


def _vocabulary(chunks: DataFrame, shards: int) -> DataFrame:
    """Replies to the chunks (``total`` counts and ``place`` + 1 of their words) and, chunk -1, each shard's size."""
    step = -(-(1 << 64) // shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
                counts = unpacked(batch.column("counts")[i].as_py())
                edges = np.searchsorted(names, np.array([min(s * step, (1 << 64) - 1) for s in range(1, shards)], np.uint64))
                for s, (a, b) in enumerate(zip([0, *edges], [*edges, len(names)])):
                    if b > a:
                        yield _batch({"shard": s, "chunk": batch.column("chunk")[i].as_py(), "words": names[a:b].tobytes(), "counts": packed(counts[a:b])})

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")]
        names, back = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.concatenate([unpacked(x.as_py()) for x in table.column("counts")])
        total = np.bincount(back, counts, len(names)).astype(np.int64)
        place = np.zeros(len(names), np.int64)
        known = np.flatnonzero(total)
        place[known[_by_count(total[known])]] = np.arange(1, len(known) + 1)
        edges = np.cumsum([len(x) for x in lists])[:-1]
        replies = [(packed(total[b]), packed(place[b])) for b in np.split(back, edges)]
        shard = key[0].as_py()
        return pa.table(
            {
                "shard": pa.array([shard] * (len(replies) + 1), pa.int64()),
                "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()),
                "size": pa.array([0] * len(replies) + [int((total > 0).sum())], pa.int64()),
                "tokens": pa.array([0] * len(replies) + [int(total.sum())], pa.int64()),
                "total": pa.array([*[a for a, _ in replies], None], pa.binary()),
                "place": pa.array([*[b for _, b in replies], None], pa.binary()),
            }
        )

    sent = chunks.select("chunk", "words", "counts").mapInArrow(send, "shard long, chunk long, words binary, counts binary")
    return sent.groupBy("shard").applyInArrow(meet, "shard long, chunk long, size long, tokens long, total binary, place binary")


_MESSAGE = ["contexts", "words", "counts", "context_counts", "lower"]
_SENT = "shard long, chunk long, " + ", ".join(f"{c} binary" for c in _MESSAGE)
_NONE = packed(np.zeros(0, np.int64))


def _floor(size: int, tokens: int) -> float:
    """log10 of what unigram counts are divided by."""
    return float(np.log10(tokens + 0.5 * (size + 1)))


def _code(count: np.ndarray, below: np.ndarray, context_count: np.ndarray, prior: float) -> np.ndarray:
    """What a trie keeps of an n-gram's probability, ``below`` being its log10 by the level below."""
    return quantise(np.log10((count + prior * 10**below) / (context_count + prior)))


class _Chunk:
    """A chunk with the replies it has: n-grams of its tokens, level by level."""

    def __init__(self, row: dict, replies: pa.Table, shards: int, floor: float):
        self.row, self.replies, self.shards = row, replies.sort_by("shard"), shards
        held = np.frombuffer(row["held"], bool)
        self.trained = int((~held).sum())
        self.n = unpacked(row["lengths"])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.edges = np.cumsum(self.n) - self.n
        self.within = np.arange(len(self.doc)) - np.repeat(self.edges, self.n)
        total, name = self._replied(1)
        self.relabel, self.word_name, self.total = self._by_name(name, total)
        self.words = self.relabel[_by_count(unpacked(row["counts"]))][unpacked(row["stream"])]
        self.base = np.log10(self.total + 0.5) - floor
        # Per token its n-gram of the level reached, per n-gram its name, count and log probability.
        self.gram, self.name, self.seen, self.log_p = self.words, self.word_name, self.total, self.base
        self.token_log_p = self.base[self.words]

    def _replied(self, k: int) -> tuple[np.ndarray, ...]:
        """Counts and names. Named by place in their shard, then shard: frequent words have small names."""
        own = self.replies.filter(pa.compute.equal(self.replies.column("level"), k))
        counts = [unpacked(x.as_py()) for x in own.column("counts")]
        names = [(unpacked(p.as_py()) - 1) * self.shards + s.as_py() for s, p in zip(own.column("shard"), own.column("place")) if p.is_valid]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, names))

    @staticmethod
    def _by_name(name: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        """New numbers in order of the names, so that sorted n-grams are in order of names too."""
        order = _in_order(name + 1)[0]
        relabel = np.empty(len(name), np.int64)
        relabel[order] = np.arange(len(name))
        return relabel, name[order], *[x[order] for x in others]

    def meet(self, k: int) -> None:
        """The different n-grams of level ``k``: context ``h``, word ``w``, n-gram below, tokens, and where they are sent."""
        before = np.empty_like(self.gram)
        before[0], before[1:] = self.relabel[self.row["end"]], self.gram[:-1]
        # The first words of a text have fewer words, or only its start, before them.
        live = np.flatnonzero(self.within >= k - 2)
        order, self.first, (self.h, self.w) = _in_order(before[live], self.words[live])
        self.order = live[order]
        self.runs = np.diff(np.append(self.first, len(order)))
        h, w, self.lower = self.h, self.w, self.gram[self.order[self.first]]
        # An n-gram with an unknown part is in no trie: its score follows from the level below.
        known = self.seen > 0
        sent = np.flatnonzero(known[h] & known[self.lower])
        context = h[sent]
        places = self.seen // SPLIT + 1
        shard = mix(self.name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.shards)
        shard = shard.astype(np.uint16 if self.shards < 1 << 16 else np.int64)[context]
        self.places = places[context]
        hot = np.flatnonzero(self.places > 1)
        if len(hot):
            spread = mix(self.word_name[w[sent[hot]]].astype(np.uint64)) % self.places[hot].astype(np.uint64)
            name = self.name[context[hot]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            shard[hot] = mix(name + spread) % np.uint64(self.shards)
        put = np.argsort(shard, kind="stable")
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=self.shards))])
        self.sent, self.places = sent[put], self.places[put]

    def score(self, k: int, prior: float, last: bool) -> None:
        """Take the replies of level ``k``: its n-grams have probabilities, and names for the next level unless it is the last."""
        counts, places = self._replied(k)
        h, lower = self.h, self.lower
        log_k = np.log10(prior / (self.seen + prior))[h] + self.log_p[lower]
        found = counts > 0
        there = self.sent[found]
        log_k[there] = restore(_code(counts[found], self.log_p[lower[there]], self.seen[h[there]], prior))
        self.token_log_p[self.order] = np.repeat(log_k, self.runs)
        if last:
            return
        count_k, name_k = np.zeros(len(self.first), np.int64), np.full(len(self.first), -1)
        count_k[self.sent], name_k[self.sent] = counts, places
        gram = np.zeros(len(self.words), np.int64)
        gram[self.order] = np.repeat(np.arange(len(self.first)), self.runs)
        moved, self.name, self.seen, self.log_p = self._by_name(name_k, count_k, log_k)
        self.gram = moved[gram] if len(self.first) else gram


def _row(table: pa.Table) -> dict:
    return {c: table.column(c)[0].as_py() for c in table.column_names}


def _messages(chunks: DataFrame, replies: DataFrame, floor: float, prior: float, shards: int, level: int, model: bool) -> DataFrame:
    """Messages of the chunks to the shards of the contexts; only a ``model`` needs more than n-grams and counts.

    Only contexts that are spread over shards are sent with their count: others have all their words in one.
    """

    def work(key: tuple, held_chunk: pa.Table, replies: pa.Table) -> pa.Table:
        c = _Chunk(_row(held_chunk), replies, shards, floor)
        for k in range(2, level):
            c.meet(k)
            c.score(k, prior, False)
        c.meet(level)
        inside = np.concatenate([[0], np.cumsum(c.doc[c.order] < c.trained)])
        rows = []
        for s in np.flatnonzero(np.diff(c.cuts)).tolist():
            some = c.sent[c.cuts[s] : c.cuts[s + 1]]
            h, w, lower = c.h[some], c.w[some], c.lower[some]
            often = inside[c.first[some] + c.runs[some]] - inside[c.first[some]]
            parts = [np.diff(c.name[h], prepend=0), c.word_name[w], often]
            if model:
                below = c.total[w] if level == 2 else quantise(c.log_p[lower]).astype(np.int64)
                parts += [np.where(c.places[c.cuts[s] : c.cuts[s + 1]] > 1, c.seen[h], 0), below]
            rows.append((s, c.row["chunk"], *map(packed, parts), *[_NONE] * (len(_MESSAGE) - len(parts))))
        kinds = {"long": pa.int64(), "binary": pa.binary()}
        return pa.table({c: pa.array([r[i] for r in rows], kinds[k]) for i, (c, k) in enumerate(x.split() for x in _SENT.split(", "))})

    return chunks.drop("words", "ids").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(work, _SENT)


_SCORED = "kind int, shard long, chunk long, trie binary, counts binary, place binary"


def _shards(sent: DataFrame, floor: float, prior: float, level: int, last: bool, model: bool) -> DataFrame:
    """Kind 0: a shard's answer to a chunk: counts of the n-grams sent (0 if unknown) and, before the last level,
    places + 1 in the trie. Kind 1: tries, their codes filled in for a ``model``.
    """

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()

        def message(i: int, columns: list[str]) -> list[np.ndarray]:
            contexts, *rest = (unpacked(table.column(c)[i].as_py()) for c in columns)
            return [np.cumsum(contexts), *rest]

        used = _MESSAGE if model else _MESSAGE[:3]
        messages = [message(i, used) for i in range(table.num_rows)]
        ends = np.cumsum([len(m[0]) for m in messages])
        joined = [np.concatenate(column) for column in zip(*messages)]
        del messages
        # Of all n-grams sent each different one is looked up once; the trie holds those that were counted.
        order, first, asked = _in_order(*joined[:2])
        often = np.add.reduceat(joined[2][order], first) if len(first) else first
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        counted = np.flatnonzero(often)
        more = [x[order[first[counted]]] for x in joined[3:]]
        del joined, order
        contexts, names, count = asked[0][counted], asked[1][counted], often[counted]
        codes = np.zeros(len(count), np.uint16)
        if model and len(count):
            context_counts, lower = more
            first = np.flatnonzero(np.diff(contexts, prepend=-1))
            whole = np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(count))))
            below = np.log10(lower + 0.5) - floor if level == 2 else restore(lower)
            codes = _code(count, below, np.where(context_counts > 0, context_counts, whole), prior)
        blob = Trie.build(contexts, names, codes)
        trie = Trie.open(blob)
        rows = [(1, shard, -1, blob if model else None, None, None)]
        at = trie.find(*asked)
        known = np.zeros(len(at), np.int64)
        known[at >= 0] = count[at[at >= 0]]
        for chunk, mine in zip(table.column("chunk").to_pylist(), np.split(of, ends[:-1])):
            rows.append((0, shard, chunk, None, packed(known[mine]), None if last else packed(at[mine] + 1)))
        kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
        fields = [x.split() for x in _SCORED.split(", ")]
        return pa.table({c: pa.array([r[i] for r in rows], kinds[k]) for i, (c, k) in enumerate(fields)})

    return sent.groupBy("shard").applyInArrow(meet, _SCORED)


def trie_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, order: int = 2) -> tuple[DataFrame, DataFrame]:
    """Scores of all rows of ``docs`` and the model learnt from those where ``training`` holds.

    Scores: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Model: ``level, shard, trie``
    (level 2: pairs, up to ``order``, which is only worked out when it is read), to be read with ``elias_fano.Trie.open``. Null texts are empty: one end token. A null id is a row like any
    other, a null ``training`` means held out; ids that are not whole numbers keep their type. Without training rows every token has the unknown word's
    probability, which is then 1. An empty table gives no rows.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    id_type = kept_id(docs, id_col)[1]
    chunks = cut_lineage(_chunks(docs, id_col, text_col, F.coalesce(training, F.lit(False))))
    shards = max(LEAST_SHARDS, -(-chunks.count() // max(1, CHUNKS_PER_SHARD >> 2 * (order - 2))))
    vocabulary = cut_lineage(_vocabulary(chunks, shards))
    sizes = {r["shard"]: (r["size"], r["tokens"]) for r in vocabulary.filter("chunk < 0").select("shard", "size", "tokens").collect()}
    tokens = sum(n for _, n in sizes.values())
    floor = _floor(sum(n for n, _ in sizes.values()), tokens)
    answers = ["chunk", "shard", "counts", "place"]
    replies = vocabulary.filter("chunk >= 0").withColumnRenamed("total", "counts").select(F.lit(1).alias("level"), *answers)
    tries = []
    for level in range(2, order + 1):
        last = level == order

        def met(model: bool) -> DataFrame:
            return _shards(_messages(chunks, replies, floor, prior, shards, level, model), floor, prior, level, last, model)

        # Nothing here reads the last level's tries again, so they are made anew, with all they need, for whoever asks for the model.
        scored = cut_lineage(met(False).filter("kind <> 1") if last else met(True))
        tries.append((met(True) if last else scored).filter("kind = 1").select(F.lit(level).alias("level"), "shard", "trie"))
        replies = replies.unionByName(scored.filter("kind = 0").select(F.lit(level).alias("level"), *answers))

    def total(key: tuple, held_chunk: pa.Table, found: pa.Table) -> pa.Table:
        c = _Chunk(_row(held_chunk), found, shards, floor)
        base_score = np.add.reduceat(c.token_log_p, c.edges)
        for k in range(2, order + 1):
            c.meet(k)
            c.score(k, prior, k == order)
        ids = pa.ipc.open_stream(c.row["ids"]).read_all().column("id")
        return pa.table(
            {
                "id": ids,
                "held_out": pa.array(np.frombuffer(c.row["held"], bool)),
                "n_tokens": c.n,
                "n_known": np.add.reduceat((c.total > 0)[c.words].astype(np.int64), c.edges),
                "train_tokens": np.full(len(ids), tokens),
                "base_score": base_score,
                "score": np.add.reduceat(c.token_log_p, c.edges),
            }
        )

    layout = f"id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = chunks.drop("words").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(total, layout)
    return out, reduce(DataFrame.unionByName, tries)
