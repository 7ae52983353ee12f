"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart have a word between them that is within one bit of one and two
of the other. Every fingerprint emits the variants within one bit; fingerprints of odd parity also those
of two bits within one half of the word. That is enough: at distance 1 or 3 the two differ in parity, and
of three differing bits two lie in one half; at distance 2 they meet one bit from each.

Variants are not shuffled one row each. A fingerprint goes once to every bucket (a pattern of some bits)
that holds any of its variants, and the task makes those variants there, so rows shuffled stay some
fifteen a fingerprint instead of five hundred. Of the fingerprints within one bit of a variant the
smallest is linked to all others that meet there: all of them are within three bits of it, so no link is
doubtful and classes of n fingerprints give links in proportion to n, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard.llm.tables import kept_id, only_rows, text_digest
from rowguard.llm.words import slices, words
from rowguard.operators.components import components
from rowguard.session import cut_lineage

SHINGLE = 3
SEED = 42
RADIUS = 3
PER_BUCKET = 1 << 16
CHUNK = 4096


def text_fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; 0 for a text without words."""
    found = words(texts)
    lengths = found.ends - found.starts
    # All words again with one space after each, so that a shingle is a range of bytes.
    places = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(places[-1], 32, np.uint8)
    joined[_ranges(places[:-1], lengths)] = found.data[_ranges(found.starts, lengths)]
    data = joined.tobytes()
    n_words = np.diff(found.first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    at = _ranges(found.first[:-1], n_shingles)
    last = np.minimum(at + size, np.repeat(found.first[1:], n_shingles))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(places[at].tolist(), (places[last] - 1).tolist())), np.uint64, len(at))
    out = np.zeros(len(n_words), np.uint64)
    filled = np.flatnonzero(n_shingles)
    edges = np.concatenate([[0], np.cumsum(n_shingles[filled])])
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for a, b in _runs(edges, 1 << 17):
        bits = np.unpackbits(hashes[edges[a] : edges[b]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, edges[a:b] - edges[a], axis=0, dtype=np.int32)
        set_bits = 2 * counts > (edges[a + 1 : b + 1] - edges[a:b])[:, None]
        out[filled[a:b]] = (set_bits * weights).sum(1, dtype=np.uint64)
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _runs(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive groups of about ``most`` items; a larger group stands alone."""
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1)
        yield a, b
        a = b


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``id, fp``: the fingerprint of every row as a signed long; null text is empty, its fingerprint 0.

    Whole-number ids are longs, others keep their type.

    With ``digests`` also ``digest``, the SHA-256 of the text.
    """
    more = ["digest"] if digests else []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                fps = text_fingerprints(part.column("body")).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps), *[part.column(c) for c in more]], names=["id", "fp", *more])

    digest = [text_digest(F.col(text_col)).alias("digest")] if digests else []
    own, kind = kept_id(docs, id_col)
    rows = docs.select(own, F.col(text_col).cast("string").alias("body"), *digest)
    return rows.mapInArrow(each, f"id {kind.simpleString()}, fp long" + (", digest string" if digests else ""))


def _bucket_bits(count: int, per_bucket: int) -> list[int]:
    """Positions whose bits name the bucket, taken from both halves of the word in turn."""
    n = max(8, int(np.ceil(np.log2(max(1, count) / per_bucket))))
    return [(i // 2) + 32 * (i % 2) for i in range(min(n, 32))]


def _parity(fps: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(fps) & 1).astype(bool)


def _messages(fps: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (as bit patterns in place) that hold variants of each fingerprint, and the fingerprint."""
    mask = np.uint64(sum(1 << b for b in bits))
    flips = [0] + [1 << b for b in bits]
    double = [(1 << a) | (1 << b) for i, a in enumerate(bits) for b in bits[i + 1 :] if (a < 32) == (b < 32)]
    odd = _parity(fps)
    one = [(fps & mask) ^ np.uint64(f) for f in flips]
    two = [(fps[odd] & mask) ^ np.uint64(f) for f in double]
    return np.concatenate([*one, *two]), np.concatenate([fps] * len(one) + [fps[odd]] * len(two))


def _bucket_links(bucket: np.uint64, fps: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of all variants that lie in one bucket, each once."""
    mask = np.uint64(sum(1 << b for b in bits))
    free = [b for b in range(64) if b not in bits]
    gap = (fps ^ bucket) & mask
    away = np.bitwise_count(gap)
    home, near = fps[away == 0], fps[away == 1]
    singles = [home] + [home ^ np.uint64(1 << b) for b in free] + [near ^ gap[away == 1]]
    keys, owner = np.concatenate(singles), np.concatenate([home] * (len(free) + 1) + [near])
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    known, anchors = keys[first], owner[first]
    sizes = np.diff(np.append(first, len(keys)))
    heads = np.repeat(anchors, sizes)
    found = [np.unique(np.stack([heads, owner])[:, heads != owner], axis=1)]

    def probe(variants: np.ndarray, of: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(known, variants), len(known) - 1)
        hit = known[at] == variants
        if hit.any():
            found.append(np.unique(np.stack([anchors[at[hit]], of[hit]]), axis=1))

    if len(known):
        halves = [[b for b in free if b < 32], [b for b in free if b >= 32]]
        pairs = [np.uint64((1 << a) | (1 << b)) for half in halves for i, a in enumerate(half) for b in half[i + 1 :]]
        odd_home = home[_parity(home)]
        for part in range(0, len(odd_home), CHUNK):
            own = odd_home[part : part + CHUNK]
            for group in range(0, len(pairs), 64):
                variants = own[None, :] ^ np.array(pairs[group : group + 64], np.uint64)[:, None]
                probe(variants.ravel(), np.tile(own, len(variants)))
        odd = _parity(near)
        own, moved = near[odd], gap[away == 1][odd]
        for half, low in ((halves[0], True), (halves[1], False)):
            here = (moved < np.uint64(1 << 32)) == low
            for b in half:
                probe(own[here] ^ moved[here] ^ np.uint64(1 << b), own[here])
        far = (away == 2) & _parity(fps)
        probe(fps[far] ^ gap[far], fps[far])
    links = np.concatenate(found, axis=1)
    links = np.unique(links[:, links[0] != links[1]], axis=1)
    return links[0], links[1]


def links(distinct: DataFrame, count: int, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``left, right``: links between different fingerprints (column ``fp``) at most RADIUS bits apart.

    Not all such pairs, but enough that the components are those of all pairs: see above. A bucket has
    about ``per_bucket`` fingerprints at any ``count``.
    """
    bits = _bucket_bits(count, per_bucket)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fps = _messages(batch.column("fp").to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(fps.view(np.int64))], names=["bucket", "fp"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        left, right = _bucket_links(np.int64(key[0].as_py()).view(np.uint64), table.column("fp").to_numpy().view(np.uint64), bits)
        return pa.table({"left": left.view(np.int64), "right": right.view(np.int64)})

    sent = distinct.mapInArrow(send, "bucket long, fp long")
    met = sent.groupBy("bucket").applyInArrow(meet, "left long, right long").distinct()
    return met.filter(F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= RADIUS)


def _grouped(docs: DataFrame, id_col: str, text_col: str, digests: bool = False) -> DataFrame:
    """The rows of ``fingerprints`` with ``component``, a fingerprint, and ``component_id``."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, digests))
    heads = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = links(heads.select("fp"), heads.count())
    members = components(found, "left", "right").select(F.col("value").alias("fp"), "component")
    joined = heads.join(members, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(names, "component").select("fp", "component", "component_id"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component_id`` per row; a component is named by its smallest id.

    Links join rows whose fingerprints differ in at most three bits, however far a component reaches;
    texts without words share fingerprint 0 and link to it and each other. Rows of a null id keep their
    place in a component, which they name only if it has no other id. An empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col).select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, with the columns of ``docs``: the smallest id, of its texts the smallest SHA-256."""
    first = _grouped(docs, id_col, text_col, digests=True).filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("component").agg(F.min("id").alias("id"), F.min("digest").alias("digest"))
    return only_rows(docs, id_col, text_col, kept)
