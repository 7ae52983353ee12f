"""From match clusters to one proposed value per cluster, and what that means per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.functions.predicates import is_invalid_name, marked
from rowguard.operators.joins import lookup_join


def frequencies(records: DataFrame, column: str = c.CITY) -> DataFrame:
    """Rows per value; the null value counts 0."""
    return records.groupBy(column).agg(F.count(column).alias("city_count"))


def stack(members: DataFrame, records: DataFrame, column: str = c.CITY) -> DataFrame:
    """Members of the clusters with their number of records."""
    named = members.select(F.col("value").alias(column), c.CLUSTER).distinct()
    return named.join(frequencies(records, column), column)


def winners(stacked: DataFrame, column: str = c.CITY) -> DataFrame:
    """The single most frequent member of each cluster; a cluster with a tie has none.

    Two aggregates with partial sums instead of a window, so a cluster of any size needs no
    sort in one task.
    """
    level = stacked.groupBy(c.CLUSTER, "city_count").agg(F.count(F.lit(1)).alias("tied"), F.min(column).alias("name"))
    top = level.groupBy(c.CLUSTER).agg(F.max(F.struct("city_count", "tied", "name")).alias("top"))
    return top.filter(F.col("top.tied") == 1).select(c.CLUSTER, F.col("top.name").alias("proposed_city"))


def propose(stacked: DataFrame, column: str = c.CITY) -> DataFrame:
    """Add the proposed value; ties and unreadable winners are left to a person."""
    joined = stacked.join(winners(stacked, column), c.CLUSTER, "left")
    proposal = F.when(is_invalid_name("proposed_city"), c.MANUAL).otherwise(F.col("proposed_city"))
    return joined.withColumn("proposed_city", proposal)


def details(records: DataFrame, stacked: DataFrame, column: str = c.CITY) -> DataFrame:
    """Per record: 1 replace the value, 0 it is the proposal, null a person decides."""
    joined = lookup_join(records, stacked, column, "inner")
    change = F.when(F.col("proposed_city") == c.MANUAL, None).otherwise((F.col(column) != F.col("proposed_city")).cast("int"))
    return joined.withColumn("apply_changes", change)


def standard_names(stacked: DataFrame, column: str = c.CITY) -> DataFrame:
    """Value and its standard: the proposal, or for a manual cluster its smallest member with a marker."""
    common = stacked.groupBy(c.CLUSTER).agg(F.min(column).alias("_first"))
    joined = stacked.join(common, c.CLUSTER)
    name = F.when(F.col("proposed_city") == c.MANUAL, marked("_first")).otherwise(F.col("proposed_city"))
    return joined.select(column, name.alias(c.STANDARD))


def standardise(records: DataFrame, stacked: DataFrame, column: str = c.CITY) -> DataFrame:
    """Add the standardised value; values outside all clusters keep their own."""
    joined = lookup_join(records, standard_names(stacked, column), column)
    return joined.withColumn(c.STANDARD, F.coalesce(F.col(c.STANDARD), F.col(column))).select(*records.columns, c.STANDARD)
