"""Joining records to a dictionary with one row per key, whatever the sizes and however skewed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard.session import cut_lineage

BROADCAST_BYTES = 32 << 20
HOT_KEYS = 1000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, (left[k].eqNullSafe(right["_hot_" + k]) for k in keys))


def hot_keys(records: DataFrame, keys: Sequence[str], most: int = HOT_KEYS) -> DataFrame:
    """Keys that hold more than one row in ``most``, fewer than ``most`` keys, and places to split each over.

    Counting is partial in every task before anything is shuffled; null is a key like any other.
    """
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = records.agg(F.count(F.lit(1))).scalar()
    # As many places as keep a place under that share of the rows.
    places = F.ceil(F.col("_n") * most / total).cast("int")
    return counts.filter(F.col("_n") * most > total).select(*[F.col(k).alias("_hot_" + k) for k in keys], places.alias("_places"))


def salted_join(records: DataFrame, dictionary: DataFrame, keys: Sequence[str], how: str, most: int = HOT_KEYS) -> DataFrame:
    """Shuffle join in which the records of a hot key are split over places, each with a copy of its entries."""
    hot = cut_lineage(hot_keys(records, keys, most))

    def marked(df: DataFrame) -> DataFrame:
        # Fewer than ``most`` rows, so it may go to every task.
        return df.join(F.broadcast(hot), _same(df, hot, keys), "left").drop(*["_hot_" + k for k in keys])

    places = F.coalesce("_places", F.lit(1))
    spread = F.pmod(F.xxhash64(*records.columns), places).cast("int")
    left = marked(records).withColumn("_salt", spread).drop("_places")
    right = marked(dictionary).withColumn("_salt", F.explode(F.sequence(F.lit(0), places - 1))).drop("_places")
    # Sizes of exploded rows are guessed far too low, so Spark could broadcast what belongs in a shuffle.
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: the length of strings and binaries, of other values as text, and 16 for each column."""
    sizes = [F.octet_length(F.col(f.name)) if f.dataType.typeName() in ("string", "binary") else F.lit(0) for f in df.schema.fields]
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    if nested:
        sizes.append(F.octet_length(F.to_json(F.struct(*nested))))
    return sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(16 * len(sizes)))


def lookup_join(
    records: DataFrame, dictionary: DataFrame, keys: str | Sequence[str], how: str = "left", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Join ``records`` to ``dictionary`` on equal keys, ``how`` being left or inner.

    The dictionary is written first and its bytes are added up: up to ``broadcast_bytes`` it goes to
    every task and the records are not moved at all; beyond that both are shuffled, hot keys salted.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how {how!r} is not left or inner")
    names = [keys] if isinstance(keys, str) else list(keys)
    table = cut_lineage(dictionary)
    size = table.agg(F.coalesce(F.sum(row_bytes(table)), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return records.join(F.broadcast(table), names, how)
    return salted_join(records, table, names, how)
