"""Exact duplicates by progressive refinement: byte length, then prefix hash, then full hash.

DataFrame functions only. Texts never move between tasks: every step shuffles lengths and hashes,
counted in the tasks first. The full hash is computed only for rows whose (length, prefix) group
survives; survivors are named by slots of a fixed number, so what is broadcast has a fixed bound
(``SLOTS`` longs, 2 MB), whatever the input. A row that shares a slot by chance costs a hash and changes
nothing, because groups are formed on length, prefix hash and SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard.llm.tables import only_rows

PREFIX_CHARS = 64
SLOTS = 1 << 18


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    hash_all: bool = False,
) -> DataFrame:
    """``id, keep_id, group_size, kept, sha256``, one row per row of ``docs``.

    Equal texts form a group, null and empty texts one of their own; the largest id stays. ``normalise``
    is applied before comparing (default: nothing). ``sha256`` is null for rows whose group ended before
    the full hash, unless ``hash_all``. Rows that repeat an id with the same text each count in
    ``group_size`` and agree in ``kept``. A null id stays only in a group without other ids. Empty tables
    give no rows; other columns of ``docs`` play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).select(
        "id", "body", F.octet_length("body").alias("bytes"), F.xxhash64(F.substring("body", 1, PREFIX_CHARS)).alias("prefix")
    )
    slot = F.pmod(F.xxhash64("bytes", "prefix"), F.lit(SLOTS))
    pairs = rows.groupBy("bytes", "prefix").agg(F.count(F.lit(1)).alias("n"))
    by_length = pairs.groupBy("bytes").agg(F.sum("n").alias("of_length")).filter("of_length > 1")
    surviving = pairs.filter("n > 1").join(by_length, "bytes", "left_semi").select(slot.alias("slot")).distinct()
    marked = rows.withColumn("slot", slot).join(F.broadcast(surviving.withColumn("open", F.lit(True))), "slot", "left")
    digest = F.sha2("body", 256)
    hashed = marked.select("id", "bytes", "prefix", (digest if hash_all else F.when(F.col("open"), digest)).alias("sha256"), "open")
    groups = (
        hashed.filter("open")
        .groupBy("bytes", "prefix", "sha256")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    found = hashed.join(groups, ["bytes", "prefix", "sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha256").withColumn(
        "kept", F.col("id").eqNullSafe(F.col("keep_id"))
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; repeated rows of one id and text count once."""
    kept = exact_groups(docs, id_col, text_col, hash_all=True).filter("kept")
    return only_rows(docs, id_col, text_col, kept.select("id", F.col("sha256").alias("digest")))
