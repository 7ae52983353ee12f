"""Repeated passages by suffix sorting: every byte under a string of ``LENGTH`` bytes that starts elsewhere too.

Candidates. Every start of a string of LENGTH bytes is keyed by the smallest hash of the short windows in the
string, so equal strings have equal keys, and a document falls into segments, runs of starts of one key
(some seventy starts each). Keys meet by shards. A segment whose key occurs nowhere else is done. Segments of
equal bytes are one class; if a key has one class with several segments, all its strings repeat. Only keys of
several classes are open, and one segment of each class goes on, however often it occurs.

Decision. The texts of a shard's open classes are sorted by suffix in two stages: suffixes smaller than
their successors are sorted directly, the others follow from their successors bucket by bucket; then the
common prefixes of neighbours in that order say which strings repeat. Strings that a class holds more
than once, inside one segment or by several, repeat as well.

Marks go back to the chunks of documents they came from. What is shuffled are keys (about 20 bytes for
seventy bytes of text), the open texts and twice the compressed texts. A task holds one chunk or one shard;
their number follows the input, their size does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard.llm.trie_scores import _batch, _ranges, packed, unpacked
from rowguard.llm.words import back_powers, flat, mix, prefix_sums, range_hash, slices
from rowguard.session import cut_lineage

LENGTH = 200
WINDOW = 64
CHUNK_BYTES = 6 << 20
PIECE_BYTES = 1 << 20
LEAST_SHARDS = 48
CHUNKS_PER_SHARD = 3


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray, length: int, window: int, piece: int = PIECE_BYTES) -> tuple[np.ndarray, ...]:
    """``key, content, begin, count, periodic`` of the segments of all documents.

    Documents are taken in groups of about ``piece`` bytes, so memory does not follow the chunk.
    """
    part = offsets[:-1] // piece
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(offsets) - 1]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        key, content, begin, count, periodic = _segments(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, window)
        found.append((key, content, begin + offsets[a], count, periodic))
    return tuple(np.concatenate(x) for x in zip(*found))


def _segments(data: np.ndarray, offsets: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """``periodic`` marks segments in which the smallest hash occurs twice: only they can hold a string twice.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    if len(data) < length:
        return none
    sums = prefix_sums(data)
    places = np.arange(len(data) - window + 1)
    hashes = range_hash(sums, places, places + window)
    keys = sliding_min(hashes, length - window + 1)
    sizes = np.diff(offsets)
    starts_of = np.maximum(sizes - length + 1, 0)
    at = _ranges(offsets[:-1][starts_of > 0], starts_of[starts_of > 0])
    if not len(at):
        return none
    own = keys[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    begin, key = at[first], own[first]
    count = np.diff(np.append(first, len(at)))
    # Places whose hash is the smallest of some window over them, and equal ones close to each other.
    reach = length - window
    padded = np.concatenate([np.zeros(reach, np.uint64), keys, np.zeros(reach, np.uint64)])
    anchors = np.flatnonzero(~sliding_min(~padded, reach + 1) == hashes)
    near = np.flatnonzero((hashes[anchors[1:]] == hashes[anchors[:-1]]) & (np.diff(anchors) <= reach))
    periodic = np.zeros(len(begin), bool)
    if len(near):
        left, right = anchors[near], anchors[near + 1]
        low = np.searchsorted(begin + count - 1, right - reach)
        high = np.searchsorted(begin, left, "right")
        some = _ranges(low, np.maximum(high - low, 0))
        which = np.repeat(np.arange(len(near)), np.maximum(high - low, 0))
        periodic[some[key[some] == hashes[left[which]]]] = True
    return key, range_hash(sums, begin, begin + count - 1 + length), begin, count, periodic


def _prefix_equal(sums: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return (sums[a + size] - sums[a]) * back[a] == (sums[b + size] - sums[b]) * back[b]


def _common(sums: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, up to ``most``, by hash."""
    low = np.where(_prefix_equal(sums, back, a, b, most), most, 0)
    open_ = np.flatnonzero(low < most)
    a, b = a[open_], b[open_]
    floor, roof = np.zeros(len(open_), np.int64), np.full(len(open_), most - 1)
    while len(open_) and (floor < roof).any():
        middle = (floor + roof + 1) // 2
        same = _prefix_equal(sums, back, a, b, middle)
        floor, roof = np.where(same, middle, floor), np.where(same, roof, middle - 1)
    low[open_] = floor
    return low


def _direct_sort(data: np.ndarray, some: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at ``some`` in order of their first ``depth`` bytes."""
    lead = np.zeros(len(some), np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | data[some + k]
    order = np.argsort(lead, kind="stable")
    some, lead = some[order], lead[order]
    tied = np.zeros(len(some), bool)
    tied[1:] = lead[1:] == lead[:-1]
    sums = prefix_sums(data)
    back = back_powers(sums)
    group = np.cumsum(~tied) - 1
    first = np.flatnonzero(~tied)
    active = np.flatnonzero(np.bincount(group)[group] > 1)
    while len(active):
        a, g = some[active], group[active]
        pivot = some[first[g]]
        common = _common(sums, back, a, pivot, depth)
        mine, other = data[a + common].astype(np.int64), data[pivot + common].astype(np.int64)
        side = np.sign(mine - other) * (common < depth)
        # Smaller ones that part from the pivot early come first, larger ones that part early last.
        key = side * ((depth + 1 - common) << 9) + np.where(side == 0, 0, mine)
        order = np.lexsort((key, g))
        active_sorted = a[order]
        g, key, side = g[order], key[order], side[order]
        some[active] = active_sorted
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        # Groups are named by the place of their first member from here on.
        heads = active[np.flatnonzero(new)]
        name = np.repeat(heads, np.diff(np.append(np.flatnonzero(new), len(g))))
        group = group if first is _IDENTITY else first[group]
        first = _IDENTITY
        group[active] = name
        size = np.repeat(np.diff(np.append(np.flatnonzero(new), len(g))), np.diff(np.append(np.flatnonzero(new), len(g))))
        active = active[(size > 1) & (side != 0)]
    return some


class _Identity:
    """Names that are places already."""

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return at


_IDENTITY = _Identity()


def two_stage_order(data: np.ndarray, begin: np.ndarray, count: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes that start in the ranges, in order of their first ``depth`` bytes at least.

    ``data`` has ``depth`` + 8 spare zero bytes or more after the last range.
    """
    n = len(data)
    step = np.sign(np.diff(data.astype(np.int16), append=-1)).astype(np.int8)
    kind = np.int32 if n < 1 << 31 else np.int64
    places = np.arange(n, dtype=kind)
    change = np.where(step != 0, places, kind(n - 1))
    change = np.minimum.accumulate(change[::-1])[::-1]  # where the run of equal bytes ends
    smaller = step[change] > 0
    next_direct = np.minimum.accumulate(np.where(smaller, places, kind(n - 1))[::-1])[::-1]
    # A suffix that is not sorted directly follows from its successors up to the next one that is.
    reach = next_direct[begin + count - 1] + 1
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, begin, 1)
    np.add.at(mark, np.minimum(reach, n), -1)
    needed = np.cumsum(mark[:n], dtype=np.int32) > 0
    del places, next_direct, mark
    direct = _direct_sort(data, np.flatnonzero(needed & smaller), depth)
    follow = np.flatnonzero(needed & ~smaller)
    follow = follow[np.argsort(data[follow], kind="stable")]
    lead_direct = np.searchsorted(data[direct], np.arange(257))
    lead_follow = np.searchsorted(data[follow], np.arange(257))
    rank = np.zeros(n + 1, kind)
    order = np.empty(len(direct) + len(follow), np.int64)
    top = 0
    for c in range(256):
        some = follow[lead_follow[c] : lead_follow[c + 1]]
        if len(some):
            end = change[some] + 1  # the byte after the run is smaller, so its suffix has its rank
            some = some[np.lexsort((rank[end], end - some))]
        for part in (some, direct[lead_direct[c] : lead_direct[c + 1]]):
            rank[part] = np.arange(top + 1, top + 1 + len(part))
            order[top : top + len(part)] = part
            top += len(part)
    wanted = np.zeros(n, bool)
    wanted[_ranges(begin, count)] = True
    return order[wanted[order]]


def repeated_starts(data: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes of ``order`` share their first ``length`` bytes with a neighbour in it."""
    left, right = order[:-1], order[1:]
    live = np.arange(len(left))
    for k in range(length):
        if k < 16 or k % 8 == 0:
            live = live[data[left[live] + k] == data[right[live] + k]]
    if len(live):
        words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
        for k in (*range(0, length - 7, 8), length - 8):
            live = live[words[left[live] + k] == words[right[live] + k]]
    same = np.zeros(len(order), bool)
    same[live] = True
    same[live + 1] = True
    return same


_CHUNK = "chunk long, ids binary, missing binary, sizes binary, data binary"
_SEGMENTS = "shard long, chunk long, key binary, content binary, begin binary, count binary, periodic binary"
_MET = "kind int, shard long, chunk long, class binary, begin binary, count binary, of binary, full binary"
_TEXTS = "shard long, class binary, count binary, data binary"
_MARKS = "chunk long, begin binary, count binary"


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "body", CHUNK_BYTES):
                data, offsets = flat(part.column("body"))
                ids = part.column("id")
                yield _batch(
                    {
                        "chunk": number,
                        "ids": ids.fill_null(0).to_numpy().tobytes(),
                        "missing": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                        "sizes": packed(np.diff(offsets)),
                        "data": zstandard.ZstdCompressor(3).compress(data.tobytes()),
                    }
                )
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(each, _CHUNK)


def _opened(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 40), np.uint8)


def _table(layout: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in layout.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _keyed(chunks: DataFrame, shards: int, length: int, window: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _opened(batch.column("data")[i].as_py())
                offsets = np.concatenate([[0], np.cumsum(unpacked(batch.column("sizes")[i].as_py()))])
                key, content, begin, count, periodic = segments(data, offsets, length, window)
                shard = (mix(key) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                number = batch.column("chunk")[i].as_py()
                for s in range(shards):
                    some = order[cuts[s] : cuts[s + 1]]
                    if len(some):
                        steps = np.diff(begin[some], prepend=0)
                        yield _batch({"shard": s, "chunk": number, "key": key[some].tobytes(), "content": content[some].tobytes(), "begin": packed(steps), "count": packed(count[some]), "periodic": packed(periodic[some])})

    return chunks.select("chunk", "sizes", "data").mapInArrow(each, _SEGMENTS)


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """Kind 0: strings of a chunk that all repeat. Kind 1: texts wanted of a chunk. Kind 2: who has which class."""
    shard = key[0].as_py()
    n = table.num_rows
    part = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
    keys, content = part("key", np.uint64), part("content", np.uint64)
    begins = [np.cumsum(unpacked(x.as_py())) for x in table.column("begin")]
    begin, count = np.concatenate(begins), np.concatenate([unpacked(x.as_py()) for x in table.column("count")])
    periodic = np.concatenate([unpacked(x.as_py()) for x in table.column("periodic")]).astype(bool)
    of = np.repeat(np.arange(n), [len(b) for b in begins])
    order = np.lexsort((content, keys))
    keys, content, begin, count, periodic, of = (x[order] for x in (keys, content, begin, count, periodic, of))
    new_key = np.diff(keys, prepend=~keys[:1]) != 0
    new_class = new_key | (np.diff(content, prepend=~content[:1]) != 0)
    class_of, key_of = np.cumsum(new_class) - 1, np.cumsum(new_key) - 1
    members = np.bincount(class_of)
    classes_of_key = np.bincount(key_of[new_class])
    several = members[class_of] > 1
    wanted = (classes_of_key[key_of] > 1) | (periodic & ~several)
    full = several & ~wanted
    chunk = np.array(table.column("chunk").to_pylist())
    rows = []
    first = new_class & wanted
    for kind, mask in ((0, full), (1, first)):
        for i in np.unique(of[mask]).tolist():
            some = np.flatnonzero(mask)[of[mask] == i]
            own = packed(class_of[some]) if kind else None
            rows.append((kind, shard, int(chunk[i]), own, packed(begin[some]), packed(count[some]), None, None))
    if wanted.any():
        rows.append((2, shard, -1, packed(class_of[wanted]), packed(begin[wanted]), packed(count[wanted]), chunk[of[wanted]].tobytes(), packed(several[wanted])))
    return _table(_MET, rows)


def _texts(chunks: DataFrame, met: DataFrame, length: int) -> DataFrame:
    def send(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and own.num_rows:
            data = _opened(own.column("data")[0].as_py())
            for i in range(asked.num_rows):
                begin, count = (unpacked(asked.column(c)[i].as_py()) for c in ("begin", "count"))
                text = data[_ranges(begin, count + length - 1)]
                rows.append((asked.column("shard")[i].as_py(), asked.column("class")[i].as_py(), packed(count), zstandard.ZstdCompressor(1).compress(text.tobytes())))
        return _table(_TEXTS, rows)

    requests = met.filter("kind = 1").select("chunk", "shard", "class", "begin", "count")
    return chunks.select("chunk", "data").groupBy("chunk").cogroup(requests.groupBy("chunk")).applyInArrow(send, _TEXTS)


def _sorted_marks(texts: DataFrame, met: DataFrame, length: int) -> DataFrame:
    def sort(key: tuple, found: pa.Table, owners: pa.Table) -> pa.Table:
        if not found.num_rows:
            return _table(_MARKS, [])
        pieces = [_opened(x.as_py()) for x in found.column("data")]
        data = np.concatenate([*pieces, np.zeros(length + 16, np.uint8)])
        del pieces
        names = np.concatenate([unpacked(x.as_py()) for x in found.column("class")])
        count = np.concatenate([unpacked(x.as_py()) for x in found.column("count")])
        size = count + length - 1
        begin = np.cumsum(size) - size
        order = two_stage_order(data, begin, count, length)
        repeats = np.zeros(len(data) + 1, np.int8)
        repeats[order[repeated_starts(data, order, length)]] = 1
        # Runs of repeated starts inside each class.
        at = _ranges(begin, count)
        which = np.repeat(np.arange(len(begin)), count)
        on = repeats[at] == 1
        edge = np.ones(len(at), bool)
        edge[1:] = (on[1:] != on[:-1]) | (which[1:] != which[:-1])
        first = np.flatnonzero(edge)
        runs = np.diff(np.append(first, len(at)))
        first, runs = first[on[first]], runs[on[first]]
        run_class, run_from = names[which[first]], at[first] - begin[which[first]]
        by_class = np.argsort(run_class, kind="stable")
        run_class, run_from, runs = run_class[by_class], run_from[by_class], runs[by_class]
        owner, where, whole, several = (np.concatenate([unpacked(x.as_py()) for x in owners.column(c)]) for c in ("class", "begin", "count", "full"))
        chunk = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in owners.column("of")])
        low, high = np.searchsorted(run_class, owner), np.searchsorted(run_class, owner, "right")
        alone = several == 0
        n_runs = np.where(alone, high - low, 0)
        some = _ranges(low, n_runs)
        out_chunk = np.concatenate([np.repeat(chunk, n_runs), chunk[~alone]])
        out_begin = np.concatenate([np.repeat(where, n_runs) + run_from[some], where[~alone]])
        out_count = np.concatenate([runs[some], whole[~alone]])
        put = np.argsort(out_chunk, kind="stable")
        edges = np.flatnonzero(np.diff(out_chunk[put], prepend=-1))
        rows = []
        for a, b in zip(edges, np.append(edges[1:], len(put))):
            rows.append((int(out_chunk[put[a]]), packed(out_begin[put[a:b]]), packed(out_count[put[a:b]])))
        return _table(_MARKS, rows)

    owners = met.filter("kind = 2").select("shard", "class", "begin", "count", "of", "full")
    return texts.groupBy("shard").cogroup(owners.groupBy("shard")).applyInArrow(sort, _MARKS)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, spans, kept_sha256`` per row, and ``kept`` (bytes) if ``texts``.

    ``spans`` are the maximal removed runs as (from, to) byte places. A null text is empty. Rows that repeat
    an id are documents of their own, so their texts repeat each other. Kept bytes may end inside a
    character, because strings are bytes. An empty table gives no rows.
    """
    chunks = cut_lineage(_chunks(docs, id_col, text_col))
    shards = max(LEAST_SHARDS, -(-chunks.count() // CHUNKS_PER_SHARD))
    met = cut_lineage(_keyed(chunks, shards, length, window).groupBy("shard").applyInArrow(_meet, _MET))
    marks = _sorted_marks(_texts(chunks, met, length), met, length)
    full = met.filter("kind = 0").select("chunk", "begin", "count")
    layout = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept_sha256 string" + ", kept binary" * texts

    def finish(key: tuple, own: pa.Table, marked: pa.Table) -> pa.Table:
        row = {c: own.column(c)[0].as_py() for c in own.column_names}
        data, sizes = _opened(row["data"]), unpacked(row["sizes"])
        cover = np.zeros(len(data) + 1, np.int32)
        for i in range(marked.num_rows):
            begin, count = (unpacked(marked.column(c)[i].as_py()) for c in ("begin", "count"))
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + count - 1 + length, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        del cover
        ends = np.cumsum(sizes)
        # Runs end with their document.
        before, after = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
        before[1:], after[:-1] = gone[:-1], gone[1:]
        before[(ends - sizes)[sizes > 0]] = False
        after[ends[sizes > 0] - 1] = False
        heads, tails = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        doc = np.searchsorted(ends, heads, "right")
        removed = np.bincount(doc, tails - heads, len(sizes)).astype(np.int64)
        n_spans = np.bincount(doc, minlength=len(sizes))
        local = heads - (ends - sizes)[doc]
        spans = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()),
            pa.StructArray.from_arrays([pa.array(local), pa.array(local + tails - heads)], ["begin", "end"]),
        )
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        columns = {
            "id": pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["missing"], bool)),
            "n_bytes": pa.array(sizes),
            "n_removed": pa.array(removed),
            "n_spans": pa.array(n_spans),
            "spans": spans,
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    return chunks.groupBy("chunk").cogroup(full.unionByName(marks).groupBy("chunk")).applyInArrow(finish, layout)
