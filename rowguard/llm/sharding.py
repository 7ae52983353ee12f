"""Sharding by bytes: a minimax contiguous partition of ordered groups that stay whole.

DataFrame functions only. Documents of equal text are a group; groups are put in the order of their text's
SHA-256 and cut into shards so that the largest shard is as small as any cut of that order allows. Groups
larger than an even share of what is left have a shard each first (fewer than there are shards).

The smallest capacity is found by halving. A capacity is checked greedily: every shard takes groups up to
it. That needs the running sums of group sizes, of which the driver holds a summary of a fixed size
(``BUCKETS`` spans of the range of sums, each with its first and last sum). A check over the summary gives
two answers: with unknown sums left out a capacity that passes is large enough, with unknown sums anywhere in
their span one that fails is too small. The span of sums where a cut can still lie is summed up again, finer,
until both answers are one and every cut is a known sum; each pass narrows the spans by about
``BUCKETS`` / (shards squared), so three or four passes do for 10^10 groups.

What is shuffled is one short row per document (no text): to its group, back to it, and to its slot. A group
that holds a large share of the rows is counted in the tasks first and split in pieces for its slots.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowguard.llm.tables import restored, shielded, text_digest
from rowguard.operators.joins import lookup_join
from rowguard.session import cut_lineage

SHARDS = 24
OVERHEAD = 8  # bytes a document takes besides its text
BUCKETS = 1 << 14
PIECE_ROWS = 1 << 10
ORDER_PARTS = 1 << 16
PART_GROUPS = 1 << 16


class Summary(NamedTuple):
    """Spans of running sums in order: least and greatest sum, and how many there are."""

    low: list[int]
    high: list[int]
    count: list[int]

    def reach(self, bound: int, hopeful: bool) -> int:
        """The largest sum up to ``bound``; where sums are not known, the least it can be, or (``hopeful``) the most."""
        k = bisect_right(self.low, bound) - 1
        if k < 0:
            return 0
        if bound >= self.high[k]:
            return self.high[k]
        return bound if hopeful and self.count[k] > 2 else self.low[k]


def greedy(summary: Summary, capacity: int, shards: int, total: int, hopeful: bool) -> tuple[bool, list[int]]:
    """Whether ``shards`` shards of ``capacity`` take all, and where each but the last ends."""
    cuts, at = [], 0
    for _ in range(shards - 1):
        at = total if at + capacity >= total else max(at, summary.reach(at + capacity, hopeful))
        cuts.append(at)
    return at + capacity >= total, cuts


def smallest_capacity(summary: Summary, least: int, shards: int, total: int, hopeful: bool) -> int:
    """By halving between ``least`` and ``total``."""
    low, high = min(least, total), total
    while low < high:
        mid = (low + high) // 2
        if greedy(summary, mid, shards, total, hopeful)[0]:
            high = mid
        else:
            low = mid + 1
    return low


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _summed_up(sums: DataFrame, spans: list[tuple[int, int]], buckets: int) -> Summary:
    """The running sums ``end`` inside the spans (ends included), about ``buckets`` rows for the driver."""
    width = sum(b - a + 1 for a, b in spans)
    named: Column | None = None
    for k, (a, b) in enumerate(spans):
        step = max(1, -(-width // buckets))
        own = F.struct(F.lit(k).alias("span"), F.floor((F.col("end") - F.lit(a)) / F.lit(step)).cast("long").alias("bucket"))
        inside = F.col("end").between(a, b)
        named = F.when(inside, own) if named is None else named.when(inside, own)
    found = sums.select("end", named.alias("at")).filter(F.col("at").isNotNull()).groupBy("at")
    rows = found.agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).select("a", "b", "n").collect()
    rows.sort()
    return Summary([r.a for r in rows], [r.b for r in rows], [r.n for r in rows])


def minimax_cuts(sums: DataFrame, shards: int, total: int, buckets: int = BUCKETS) -> list[int]:
    """Running sums (``end`` of ``sums``) at which every shard but the last ends, for the smallest capacity."""
    spans = [(1, total)]
    least = -(-total // shards)
    # A cut is as uncertain as the buckets before it together; so many leave a quarter of the spans at most.
    buckets = max(buckets, 4 * shards * shards)
    while True:
        summary = _summed_up(sums, spans, buckets)
        sure = smallest_capacity(summary, least, shards, total, hopeful=False)
        least = smallest_capacity(summary, least, shards, total, hopeful=True)
        low, high = greedy(summary, least, shards, total, False)[1], greedy(summary, sure, shards, total, True)[1]
        if sure == least and low == high:
            return low
        spans = _merged([(max(1, a), b) for a, b in zip(low, high)])


class _Groups(NamedTuple):
    rows: DataFrame  # id, digest, size, text_crc32, uid: a row per document, written
    placed: DataFrame  # digest, shard, first (slot of its first row), n


def _running(groups: DataFrame) -> DataFrame:
    """``groups`` with ``end`` and ``row_end``: bytes and rows up to each group, by digest.

    Parts are ranges of the digest, which is uniform, so none is crowded. One row per part is summed up alone:
    at most ``ORDER_PARTS`` rows, however many groups.
    """
    count = groups.count()
    parts = 16
    while parts < ORDER_PARTS and parts * PART_GROUPS < count:
        parts *= 2
    part = F.floor(F.conv(F.substring("digest", 1, 4), 16, 10).cast("long") / F.lit((1 << 16) // parts))
    named = groups.withColumn("part", part)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = named.groupBy("part").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
    starts = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("_r"))
    within = Window.partitionBy("part").orderBy("digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = named.select("*", F.sum("bytes").over(within).alias("_own"), F.sum("n").over(within).alias("_rows"))
    # A row per part: at most ORDER_PARTS rows of three longs.
    joined = summed.join(F.broadcast(starts), "part")
    return joined.select("digest", "bytes", "n", (F.col("_b") + F.col("_own")).alias("end"), (F.col("_r") + F.col("_rows")).alias("row_end"))


def _placed_groups(docs: DataFrame, shards: int, id_col: str, text_col: str, buckets: int) -> _Groups:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(body) + OVERHEAD).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), text_digest(body).alias("digest"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    # Rows that agree in everything are told apart by a number that is written before it is used.
    rows = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))
    groups = cut_lineage(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = []
    for row in groups.orderBy(F.desc("bytes"), "digest").limit(shards - 1).collect():
        if row.bytes * (shards - len(alone)) <= left:
            break
        alone.append(row.digest)
        left -= row.bytes
    single = F.col("digest").isin(alone) if alone else F.lit(False)
    sums = cut_lineage(_running(groups.filter(~single)))
    cuts = minimax_cuts(sums, shards - len(alone), left, buckets) if left else []
    shard = sum((F.when(F.col("end") > cut, 1).otherwise(0) for cut in cuts), F.lit(len(alone)))
    cut_up = sums.select("digest", "n", shard.cast("int").alias("shard"), (F.col("row_end") - F.col("n")).alias("before"))
    # At most a row for every shard.
    bases = {r.shard: r.base for r in cut_up.groupBy("shard").agg(F.min("before").alias("base")).collect()}
    base = F.lit(0)
    for k, value in bases.items():
        base = F.when(F.col("shard") == k, F.lit(value)).otherwise(base)
    placed = cut_up.select("digest", "shard", (F.col("before") - base).cast("long").alias("first"), "n")
    number = F.lit(0)
    for k, digest in enumerate(alone):
        number = F.when(F.col("digest") == digest, k).otherwise(number)
    own = groups.filter(single).select("digest", number.cast("int").alias("shard"), F.lit(0).cast("long").alias("first"), "n")
    return _Groups(rows, placed.unionAll(own))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``id, size, text_crc32, shard, slot``, one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes and ``OVERHEAD``; ``slot`` numbers the rows of a shard without gaps from 0,
    group after group. Null texts are empty and one group with empty ones. Repeated rows have slots of their
    own; null ids are ids like any other; other columns play no part, whatever their names. Shards may stay
    empty when there are fewer groups than shards; an empty table gives no rows.
    """
    rows, placed = _placed_groups(docs, shards, id_col, text_col, buckets)
    joined = lookup_join(rows, placed, "digest", "inner")
    piece = F.when(F.col("n") > piece_rows, F.pmod("uid", F.ceil(F.col("n") / piece_rows))).otherwise(0).cast("long")
    cut_up = cut_lineage(joined.withColumn("piece", piece))
    sizes = cut_up.filter(F.col("n") > piece_rows).groupBy("digest", "piece").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("digest").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("digest", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    found = lookup_join(cut_up, offsets, ["digest", "piece"], "left")
    place = F.row_number().over(Window.partitionBy("digest", "piece").orderBy("id", "uid")) - 1
    return found.select("id", "size", "text_crc32", "shard", (F.col("first") + F.coalesce("offset", F.lit(0)) + place).cast("long").alias("slot"))


def with_shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", out: str = "shard") -> DataFrame:
    """``docs`` with the number of each document's shard, to be written by it; texts move only if the groups' table is large."""
    _, placed = _placed_groups(docs, shards, id_col, text_col, BUCKETS)
    renamed, at = shielded(docs)
    joined = lookup_join(renamed.withColumn("digest", text_digest(F.col(at[text_col]))), placed.select("digest", "shard"), "digest", "inner")
    return joined.select(*[joined[at[c]].alias(c) for c in docs.columns], joined["shard"].alias(out))
