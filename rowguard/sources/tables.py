"""Catalog tables: names, reading, overwriting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

LAYERS = ("bronze", "silver", "platinum", "gold")


def table_name(
    purpose: str,
    country: str,
    layer: str,
    catalog: str | None = None,
    tag: str = "",
    suffix: str = "",
    layer_prefix: str = "",
) -> str:
    """``catalog.layer.tbl_<purpose>_<country><tag><suffix>``; the layer must be a known one."""
    if layer not in LAYERS:
        raise ValueError(f"layer {layer!r} is not one of {LAYERS}")
    parts = [catalog] if catalog else []
    parts += [layer_prefix + layer, f"tbl_{purpose}_{country.lower()}{tag.lower()}{suffix}"]
    return ".".join(parts)


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read a catalog table; a missing one fails with its name."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"table {name} does not exist")
    table = spark.read.table(name)
    return table.select(*columns) if columns else table


def read_parquet(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read one parquet table of a folder."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


def overwrite_table(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    path: str | None = None,
    cluster_within: Sequence[str] = (),
    options: dict[str, str] | None = None,
) -> None:
    """Replace a catalog table and its schema.

    ``cluster_within`` sorts inside each written file, which keeps a cluster's rows in few
    row groups without a global sort. ``options`` go to the format (a Delta table takes
    ``overwriteSchema`` and its column mapping mode there).
    """
    out = df.sortWithinPartitions(*cluster_within) if cluster_within else df
    writer = out.write.mode("overwrite").format(fmt)
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
