"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents are tokenized where they lie and cut into pieces; whole sequences are done. The other pieces are
dealt at random to blocks of about ``BLOCK`` pieces, and every block is packed by several islands: an
individual is a packing, crossover injects whole well-filled bins of one parent into the other, drops the
bins that now hold an item twice and places their other items by best fit. After each round an island
passes its best packing on to the next island of its block (elite migration, a join), and the best island
of a block wins. A block wastes about what its last bins leave open, a share that does not depend on the
size of the input.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard.llm.words import slices
from rowguard.session import cut_lineage

CAPACITY = 1024
END = 2
BLOCK = 32_768
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 8
POPULATION = 4
INJECTED = 0.04
#: The added token of the tokenizers file; it is one id wherever a text holds it.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(1)
def _encoding(ranks_file: str, pattern: str):
    """The public byte-level BPE as tiktoken reads it: the same ids as its tokenizers file, faster."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)


def public_encoding():
    import public_tokenizers

    return _encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of ``n`` tokens; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``uid, id, piece, start, length, ids_crc32``; a null or empty text is the end token alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(public_encoding().encode, allowed_special="all")
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "body"):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, body in enumerate(part.column("body").to_pylist()):
                    ids = np.array([*encode(body or ""), END], "<u4")
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(crc32(ids[s : s + n].tobytes()))
                uids = np.arange(uid, uid + len(rows))
                uid += len(rows)
                columns = [pa.array(uids), part.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"uid long, id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by the room they have; the tightest bin that an item fits is found by one bit operation."""

    def __init__(self, capacity: int, room: dict[int, int] | None = None):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for name, left in (room or {}).items():
            self._add(name, left)
        self.next = max(room, default=-1) + 1 if room else 0

    def _add(self, name: int, left: int) -> None:
        if left:
            self.open[left].append(name)
            self.mask |= 1 << left

    def place(self, size: int) -> int:
        fitting = self.mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = self.open[left]
            name = at.pop()
            if not at:
                self.mask ^= 1 << left
        else:
            left, name = self.capacity, self.next
            self.next += 1
        self._add(name, left - size)
        return name


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, into: np.ndarray | None = None, room: dict[int, int] | None = None) -> np.ndarray:
    """Bin of every item; ``order`` are the items to place, ``into`` the bins of those already placed."""
    out = np.full(len(sizes), -1, np.int64) if into is None else into
    bins = Bins(capacity, room)
    out[order] = [bins.place(s) for s in sizes[order].tolist()]
    return np.unique(out, return_inverse=True)[1]


def exact_fill(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """A packing that closes one bin after the other: the largest item left, then one or two that fill it exactly.

    Sizes at hand are bits of a number, so a pair that adds up to the room left is found by one shift.
    Without an exact filling the largest item that fits goes in. ``rng`` varies which pair is taken.
    """
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, s in enumerate(sizes.tolist()):
        held[s].append(i)
    have = mirror = 0  # bit s, and bit capacity - s, for every size at hand
    for s, items in enumerate(held):
        if items:
            have |= 1 << s
            mirror |= 1 << (capacity - s)
    out = np.empty(len(sizes), np.int64)
    number = 0

    def take(size: int) -> int:
        nonlocal have, mirror
        out[held[size].pop()] = number
        if not held[size]:
            have ^= 1 << size
            mirror ^= 1 << (capacity - size)
        return size

    while have:
        left = capacity - take(have.bit_length() - 1)
        while left:
            if have >> left & 1:
                take(left)
                break
            pairs = have & (mirror >> (capacity - left)) & ((1 << left) - 1)
            if left % 2 == 0 and len(held[left // 2]) == 1:
                pairs &= ~(1 << (left // 2))
            if pairs:
                size = pairs.bit_length() - 1
                if rng is not None and rng.random() < 0.5:
                    below = pairs & ((1 << int(rng.integers(1, size + 1))) - 1)
                    size = below.bit_length() - 1 if below else size
                take(size)
                take(left - size)
                break
            fitting = have & ((1 << (left + 1)) - 1)
            if not fitting:
                break
            left -= take(fitting.bit_length() - 1)
        number += 1
    return out


def fitness(sizes: np.ndarray, bin_of: np.ndarray, capacity: int) -> tuple[int, float]:
    """Larger is better: fewer bins, then the mean square of their filling."""
    fill = np.bincount(bin_of, sizes)
    return -len(fill), float(((fill / capacity) ** 2).mean())


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator, share: float = INJECTED) -> np.ndarray:
    """``mother`` with some of the father's best-filled bins in place of the bins they share items with."""
    fill = np.bincount(father, sizes)
    best = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(best, max(1, int(share * len(fill))), replace=False) if len(best) > share * len(fill) else best] = True
    injected = chosen[father]
    broken = np.zeros(mother.max() + 1, bool)
    broken[mother[injected]] = True
    # Also the loosest bins of the mother, else nothing is left to put into the gaps.
    own = np.bincount(mother, sizes)
    broken[np.argsort(own, kind="stable")[: max(1, int(share * len(own)))]] = True
    loose = np.flatnonzero(broken[mother] & ~injected)
    kept = np.flatnonzero(~broken)
    child = np.full(len(sizes), -1, np.int64)
    stay = ~broken[mother] & ~injected
    child[stay] = mother[stay]
    child[injected] = father[injected] + len(broken)
    room = {int(b): int(capacity - own[b]) for b in kept}
    top = len(broken) + len(fill)
    room |= {int(b) + len(broken): int(capacity - fill[b]) for b in np.flatnonzero(chosen)}
    room.setdefault(top, 0)
    order = loose[np.argsort(-sizes[loose], kind="stable")]
    return best_fit(sizes, order, capacity, child, room)


def evolve(sizes: np.ndarray, migrants: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """The best packing of one island after some generations."""
    rng = np.random.default_rng(seed)
    people = [m for m in migrants if len(m) == len(sizes)]
    if not people:
        # The first generation: best fit of falling sizes, exactly filled bins, and noisy orders.
        people.append(best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity))
    people.append(exact_fill(sizes, capacity, None if seed % 2 else rng))
    while len(people) < population:
        noise = sizes * rng.uniform(0.9, 1.1, len(sizes))
        people.append(best_fit(sizes, np.argsort(-noise, kind="stable"), capacity))
    total = -(-int(sizes.sum()) // capacity)
    people.sort(key=lambda p: fitness(sizes, p, capacity), reverse=True)
    for _ in range(generations):
        if -fitness(sizes, people[0], capacity)[0] == total:
            break
        for _ in range(population):
            a, b = rng.choice(len(people), 2, replace=False)
            people.append(crossover(sizes, people[min(a, b)], people[max(a, b)], capacity, rng))
        people.sort(key=lambda p: fitness(sizes, p, capacity), reverse=True)
        del people[population:]
    return people[0]


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """``cut_pieces`` (written, with ``uid`` and ``length``) with ``sequence_id`` and ``offset``.

    Pieces as long as a sequence fill one each. An empty table gives no rows.
    """
    whole = cut_pieces.filter(F.col("length") >= capacity).select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut_pieces.filter(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block))
    dealt = rest.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    # A block is bounded: uids are unique and dealt by hash.
    listed = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "uid"))).alias("items"))
    state = listed.select(
        "block",
        F.transform("items", lambda x: x["uid"]).alias("uids"),
        F.transform("items", lambda x: x["length"]).alias("sizes"),
    )
    state = cut_lineage(state.repartition(blocks, "block"))
    names = state.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    current = names.withColumn("own", F.lit(None).cast("array<int>")).withColumn("migrant", F.lit(None).cast("array<int>"))

    def step(number: int):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {k: batch.column(k)[i] for k in ("block", "island", "sizes", "own", "migrant")}
                    sizes = np.array(row["sizes"].as_py(), np.int64)
                    given = [np.array(row[k].as_py(), np.int64) for k in ("own", "migrant") if row[k].is_valid]
                    seed = hash((row["block"].as_py(), row["island"].as_py(), number)) & 0x7FFFFFFF
                    best = evolve(sizes, given, capacity, seed)
                    score = fitness(sizes, best, capacity)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("block").slice(i, 1),
                            batch.column("island").slice(i, 1),
                            pa.array([score[0] + score[1]]),
                            pa.array([best.tolist()], pa.list_(pa.int32())),
                        ],
                        names=["block", "island", "score", "own"],
                    )

        return each

    for number in range(rounds):
        spread = current.repartition(blocks * islands, "block", "island")
        best = cut_lineage(spread.mapInArrow(step(number), "block long, island int, score double, own array<int>"))
        moved = best.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("own").alias("migrant"))
        current = names.join(best.drop("score"), ["block", "island"]).join(moved, ["block", "island"])
    won = best.groupBy("block").agg(F.max_by("own", F.struct("score", -F.col("island"))).alias("own"))
    joined = state.join(won, "block")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uids, sizes, own = (np.array(batch.column(k)[i].as_py(), np.int64) for k in ("uids", "sizes", "own"))
                order = np.argsort(own, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                runs = np.diff(np.append(first, len(own)))
                offset = ends - sizes[order] - np.repeat((ends - sizes[order])[first], runs)
                number = (batch.column("block")[i].as_py() << 32) + own[order]
                yield pa.RecordBatch.from_arrays([pa.array(uids[order]), pa.array(number), pa.array(offset)], names=["uid", "sequence_id", "offset"])

    placed = joined.mapInArrow(place, "uid long, sequence_id long, offset long")
    return rest.join(placed, "uid").select(*cut_pieces.columns, "sequence_id", "offset").unionByName(whole)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row."""
    return pack(cut_lineage(pieces(docs, id_col, text_col, capacity)), capacity, block).drop("uid")
