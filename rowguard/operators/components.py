"""Connected components of match pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard.operators.joins import salted_join
from rowguard.operators.ranking import dense_index
from rowguard.session import cut_lineage


# Edges of one node from which joins on nodes are salted.
HOT_NODE = 1_000_000
# Edges that a task takes up before it contracts them.
PIECE_EDGES = 1 << 20


def forest(left: pa.Array, right: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Every value that is not the smallest of its component of the given edges, and that smallest value.

    Heads hook onto the smallest head they have an edge to, then pointers are followed to their ends; heads
    that still have an edge to another one at least halve in number every time.
    """
    both = pa.concat_arrays([left, right])
    values = pc.unique(both)
    values = values.take(pc.sort_indices(values))
    codes = pc.index_in(both, value_set=values).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = codes[: len(left)], codes[len(left) :]
    head = np.arange(len(values))
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(head, np.maximum(a, b), low)
        while True:
            further = head[head]
            if (further == head).all():
                break
            head = further
        a, b = head[a], head[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    below = np.flatnonzero(head != np.arange(len(head)))
    return values.take(pa.array(below)), values.take(pa.array(head[below]))


def _contracted(pairs: DataFrame) -> DataFrame:
    """Edges ``a, b`` with the same components: of what a task reads, one edge from each value to its smallest.

    A task holds ``PIECE_EDGES`` edges at most, or twice that while it contracts them; a forest of more than
    half of that goes out and a new one begins.
    """
    most = PIECE_EDGES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                held = [contract(held)]
                n = held[0].num_rows
                if n > most // 2:
                    yield held[0]
                    held, n = [], 0
        if n:
            yield contract(held)

    def contract(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = [pa.concat_arrays(table.column(c).chunks) for c in ("a", "b")]
        return pa.RecordBatch.from_arrays(list(forest(*ends)), names=["a", "b"])

    return pairs.mapInArrow(each, pairs.schema)


def _by_node(edges: DataFrame, least: DataFrame, hot: bool) -> DataFrame:
    # A row per node is no small table, whatever Spark takes it for.
    return salted_join(edges, least, ["a"], "inner") if hot else edges.join(least.hint("merge"), "a")


def _large_star(edges: DataFrame, hot: bool = False) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _by_node(both.filter(F.col("b") > F.col("a")), least, hot).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hot: bool = False) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _by_node(edges, least, hot).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame, hot_node: int) -> tuple[list, bool]:
    """Number and sum of hashes of the edges, and whether a head has ``hot_node`` of them.

    A contracted node has few edges to smaller ones (one per task at most), so edges to larger ones count.
    """
    heads = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    *seen, most = heads.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return seen, (most or 0) >= hot_node


def components(edges: DataFrame, left: str = "left", right: str = "right", hot_node: int = HOT_NODE) -> DataFrame:
    """``value, component``: the component is named by its smallest member.

    Tasks first contract the edges they hold, before and after these are shuffled, so a component
    whose edges meet in one task is settled there. Then alternating star contraction (Kiveris et al.,
    2014): every round is two aggregates and two joins of edges to one row per node, and rounds go on
    until no edge changes. Once a node has ``hot_node`` edges, the joins are salted, so the head of a
    large component is no hot key. Each round is written to the shared folder, so the plan does not grow
    and a lost executor costs one round.
    """
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter(F.col("a") != F.col("b"))
    current = cut_lineage(_contracted(_contracted(pairs).distinct()))
    mark, hot = _state(current, hot_node)
    while True:
        current = cut_lineage(_small_star(_large_star(current, hot), hot).filter(F.col("a") != F.col("b")).distinct())
        seen, hot = _state(current, hot_node)
        if seen == mark:
            break
        mark = seen
    heads = current.select(F.col("b").alias("value")).distinct().withColumn("component", F.col("value"))
    return current.select(F.col("a").alias("value"), F.col("b").alias("component")).unionByName(heads)


def numbered_components(edges: DataFrame, left: str = "left", right: str = "right", out: str = "cluster") -> DataFrame:
    """``value, cluster``: components numbered from 0 in the order of their smallest members."""
    members = components(edges, left, right)
    numbers = dense_index(members.select("component").distinct(), ["component"], out)
    return members.join(numbers, "component").select("value", F.col(out).cast("int").alias(out))
