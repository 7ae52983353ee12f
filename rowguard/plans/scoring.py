"""Job B: cluster, encode and score standardised records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowguard.operators import isolation_forest as forest
from rowguard.operators.clusters import PlaceClusters
from rowguard.operators.encoding import encode
from rowguard.session import cut_lineage


def features(standardised: DataFrame, clusters: PlaceClusters | None = None) -> DataFrame:
    """Clusters and category codes."""
    return encode(cut_lineage((clusters or PlaceClusters()).fit(standardised)))


def scores(encoded: DataFrame, **params) -> DataFrame:
    """The three scores: coordinates, coordinates with category, the same within each cluster."""
    ready = cut_lineage(forest.prepare(encoded))  # written once: three scoring passes read it
    out = forest.score_coordinates(ready, **params)
    out = forest.score_city(out, **params)
    return forest.score_city_cluster(out, **params)

