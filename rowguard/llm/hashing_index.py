"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes under a learned rotation (iterative quantisation, fitted on a bounded sample).
Codes are split into substrings of eight bits, each with its own postings. By the pigeonhole principle a
code within Hamming radius r of the query agrees with it in some substring up to a share of r, so probing
the postings of all near substring values retrieves every code within r; Euclidean distances on the
original vectors then order them. Radius r is the ``QUANTILE`` of the code distances between true
neighbours in the sample, so it follows the data and not a constant.

The index is a table of blocks of about ``BLOCK`` vectors; a block of queries visits every block once and
only each block's nearest few leave the task. A block with fewer than k codes within r is probed further,
so a query never gets fewer than k neighbours while candidates exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowguard.session import cut_lineage

SAMPLE = 20_000
SAMPLE_QUERIES = 400
QUANTILE = 0.98
TURNS = 30
BLOCK = 8_192
QUERY_BLOCK = 512
NEIGHBOURS = 10

_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Coder(NamedTuple):
    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Packed codes, one byte per substring."""
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)


def fit_coder(sample: np.ndarray, k: int = NEIGHBOURS, seed: int = 3) -> Coder:
    mean = sample.mean(0)
    centred = sample - mean
    bits = min(64, sample.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(TURNS):
        left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    coder = Coder(mean, axes @ turn, 0)
    codes = coder.codes(sample)
    picked = np.random.default_rng(seed).permutation(len(sample))[:SAMPLE_QUERIES]
    gaps = []
    for q in picked.tolist():
        far = ((sample - sample[q]) ** 2).sum(1)
        far[q] = np.inf
        near = np.argpartition(far, min(k, len(far) - 1))[:k] if len(far) > 1 else np.zeros(0, int)
        gaps.append(np.bitwise_count(codes[near] ^ codes[q]).sum(1))
    radius = int(np.ceil(np.quantile(np.concatenate(gaps), QUANTILE))) if len(sample) > 1 else bits
    return coder._replace(radius=radius)


#: What a block's row holds, packed.
PACKED = {"ids": np.int64, "rows": np.int64, "unnamed": np.bool_, "vectors": np.float64, "codes": np.uint8}


class Block:
    """Vectors of one block with the postings of their substrings."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, rows: np.ndarray | None = None, unnamed: np.ndarray | None = None):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.rows = np.arange(len(ids)) if rows is None else rows
        self.unnamed = np.zeros(len(ids), bool) if unnamed is None else unnamed
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.edges = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``: all of them, by the pigeonhole principle."""
        m = len(code)
        share, rest = divmod(radius, m)
        marked = np.zeros(len(self.ids), bool)
        for j in range(m):
            reach = share if j <= rest else share - 1
            for value in np.flatnonzero(_ONES[code[j]] <= reach).tolist():
                marked[self.order[j][self.edges[j][value] : self.edges[j][value + 1]]] = True
        rows = np.flatnonzero(marked)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]

    def nearest(self, query: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest but row ``query``; ties to the smaller id, no id last."""
        most = 8 * len(code)
        while True:
            near = self.within(code, min(radius, most))
            near = near[self.rows[near] != query]
            if len(near) >= k or radius >= most:
                break
            radius += 4
        away = np.sqrt(((self.vectors[near] - vector) ** 2).sum(1))
        best = np.lexsort((self.rows[near], self.ids[near], self.unnamed[near], away))[:k]
        return near[best], away[best]


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v, row``: rows with a finite vector that is not all zero, of the table's usual length.

    The usual length is the most frequent one (of equals the longer); distances between vectors of
    different lengths are not defined. Rows of no id, and all rows of a repeated one, take part; ``row`` tells
    them apart and has to be written before it is used.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().agg(F.max_by("n", F.struct("count", "n")))
    return rows.filter(F.size("v") == usual.scalar()).withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query row, itself left out.

    ``is_query`` is a condition on column ``id``. Ties go to the smaller id, a null one last. Every row of a repeated
    id is a candidate for the others, and a query of its own if ``is_query`` holds; then its ranks are given
    once for each. An empty table, or one of a single vector, gives no rows.
    """
    rows = cut_lineage(usable(table, id_col, vector_col))
    # Bounded by SAMPLE rows; the only data that reaches the driver.
    sample = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(SAMPLE).select("v").toArrow()
    coder = fit_coder(_matrix(sample.column("v")), k) if sample.num_rows else Coder(np.zeros(1), np.zeros((1, 1)), 0)

    def build(key: tuple, part: pa.Table) -> pa.Table:
        vectors = _matrix(part.column("v"))
        ids = part.column("id").combine_chunks()
        fields = {
            "ids": ids.fill_null(np.iinfo(np.int64).max).to_numpy(),
            "rows": part.column("row").to_numpy(),
            "unnamed": ids.is_null().to_numpy(zero_copy_only=False),
            "vectors": vectors,
            "codes": coder.codes(vectors),
        }
        return pa.table({"block": [key[0].as_py()], "size": [len(ids)], **{name: [x.tobytes()] for name, x in fields.items()}})

    layout = "block long, size long, " + ", ".join(f"{name} binary" for name in PACKED)

    def blocks_of(some: DataFrame, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-some.count() // size))
        return some.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).alias("block")).applyInArrow(build, layout), n

    index, n_blocks = blocks_of(rows, BLOCK)
    queries, _ = blocks_of(rows.filter(is_query), QUERY_BLOCK)
    index, queries = cut_lineage(index), cut_lineage(queries)
    visits = queries.select(
        *[F.col(c).alias("q_" + c) for c in ("size", *PACKED)],
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"),
    )

    def search(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        for i in range(held.num_rows):
            held_in = _unpacked(held, "", i)
            block = Block(held_in["ids"], held_in["vectors"], held_in["codes"], held_in["rows"], held_in["unnamed"])
            for j in range(asked.num_rows):
                own = _unpacked(asked, "q_", j)
                for name, row, vector, code in zip(own["ids"], own["rows"], own["vectors"], own["codes"]):
                    near, far = block.nearest(row, vector, code, coder.radius, k)
                    found.append((np.full(len(near), row), np.full(len(near), name), block.ids[near], block.unnamed[near], block.rows[near], far))
        kinds = (np.int64, np.int64, np.int64, bool, np.int64, np.float64)
        query_row, query_id, vec_id, unnamed, row, score = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip(kinds, zip(*found) if found else [()] * len(kinds)))
        ids = pa.array(vec_id, mask=unnamed.astype(bool))
        return pa.table({"query_row": query_row, "query_id": query_id, "vec_id": ids, "row": row, "score": score})

    shape = "query_row long, query_id long, vec_id long, row long, score double"
    found = visits.groupBy("block").cogroup(index.groupBy("block")).applyInArrow(search, shape)
    order = Window.partitionBy("query_row").orderBy("score", F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(table: pa.Table, prefix: str, i: int) -> dict[str, np.ndarray]:
    n = table.column(prefix + "size")[i].as_py()
    out = {name: np.frombuffer(table.column(prefix + name)[i].as_py(), kind) for name, kind in PACKED.items()}
    return out | {name: out[name].reshape(n, -1) for name in ("vectors", "codes")}
