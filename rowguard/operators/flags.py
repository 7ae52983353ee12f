"""Anomaly flags, tags and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.operators.ranking import several_quantiles, within_top_k


def not_isolated() -> Column:
    """Records with unknown neighbours count as isolated."""
    return ~F.coalesce(F.col("is_isolated"), F.lit(True))


def flag_top_k(df: DataFrame, k_coords: int = c.TOP_K_COORDS, k_city: int = c.TOP_K_CITY) -> DataFrame:
    """Flags by rank: the k lowest scores, ties included; category flags need a record that is not isolated."""
    return df.withColumns(
        {
            "is_anomaly_coords": within_top_k(df, c.SCORE_COORDS, k_coords),
            "is_anomaly_city_cluster": within_top_k(df, c.SCORE_CITY_CLUSTER, k_city) & not_isolated(),
            "is_anomaly_city": within_top_k(df, c.SCORE_CITY, k_city) & not_isolated(),
        }
    )


def flag_percentile(
    df: DataFrame, share_coords: float = c.SHARE_COORDS, share_city: float = c.SHARE_CITY
) -> DataFrame:
    """Flags by exact quantile: coordinates over all rows, category scores over rows that are not isolated."""
    dense = [F.when(not_isolated(), F.col(x)) for x in (c.SCORE_CITY, c.SCORE_CITY_CLUSTER)]
    cuts = several_quantiles(df, [F.col(c.SCORE_COORDS), *dense], [[share_coords], [share_city], [share_city]])

    def at_most(cut: float | None, column: str) -> Column:
        return F.lit(False) if cut is None else F.coalesce(F.col(column) <= F.lit(cut), F.lit(False))

    return df.withColumns(
        {
            "is_anomaly_coords": at_most(cuts[0][0], c.SCORE_COORDS),
            "is_anomaly_city": at_most(cuts[1][0], c.SCORE_CITY) & not_isolated(),
            "is_anomaly_city_cluster": at_most(cuts[2][0], c.SCORE_CITY_CLUSTER) & not_isolated(),
        }
    )


def tag(df: DataFrame) -> DataFrame:
    """First matching case: spelling, spelling and place, place, outlier; else null."""
    respelled = F.col(c.CITY) != F.col(c.STANDARD)
    same = F.col(c.CITY) == F.col(c.STANDARD)
    odd = F.col("is_anomaly_city_cluster")
    return df.withColumn(
        "tag_anomalies",
        F.when(respelled & ~odd, c.TAG_SPELLING)
        .when(respelled & odd, c.TAG_SPELLING_AND_PLACE)
        .when(same & odd, c.TAG_PLACE)
        .when(F.col("is_anomaly_coords"), c.TAG_OUTLIER),
    )


def alerts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("tag_anomalies").isNotNull())


def map_rows(df: DataFrame, score: str, flag: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The flagged rows and fields behind one map, with the marker size."""
    from rowguard.functions.predicates import marker_radius

    fields = [c.ID, c.CITY, c.LAT, c.LONG, score, "is_isolated", "neighbors_count", *extra]
    return df.filter(F.col(flag)).select(*fields, marker_radius(score).alias("radius"))
