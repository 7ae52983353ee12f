"""Helpers on tables: column names that cannot clash, written steps, row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, LongType


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column renamed out of the way, and the new name of each old one."""
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order, under their names."""
    return df.select(*[f"_in_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _named(key: Column) -> Column:
    """The id as text that null and the empty text do not share."""
    return F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), key.cast("string")))


def kept_id(docs: DataFrame, id_col: str) -> tuple[Column, DataType]:
    """The id and its type: whole numbers become long, anything else stays what it is."""
    kind = docs.schema[id_col].dataType
    kind = LongType() if isinstance(kind, IntegralType) else kind
    return F.col(id_col).cast(kind).alias("id"), kind


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def only_rows(docs: DataFrame, id_col: str, text_col: str, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each id and text in ``kept`` (``id``, ``digest``), with the columns of ``docs``.

    The text decides beside the id, since a null id, or one that occurs twice, stands for several texts.
    Semi-join and dropping of repeated rows share their keys, so texts are shuffled once.
    """
    renamed, at = shielded(docs)
    named = renamed.withColumn("_key", _named(F.col(at[id_col]))).withColumn("_digest", text_digest(F.col(at[text_col])))
    ids = kept.select(_named(F.col("id")).alias("_key"), F.col("digest").alias("_digest")).distinct()
    return restored(named.join(ids, ["_key", "_digest"], "left_semi").dropDuplicates(["_key", "_digest"]), docs)
