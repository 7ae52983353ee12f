"""Job A: find misspelled categories and propose corrections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.operators.components import numbered_components
from rowguard.operators.matching import closest_spelling, match_pairs, spelling_edges
from rowguard.operators.proposals import details, propose, stack, standardise
from rowguard.session import cut_lineage


@dataclass
class Standardisation:
    """The three tables of the job."""

    summary: DataFrame
    stacked: DataFrame
    details: DataFrame


def _finish(records: DataFrame, pairs: DataFrame) -> Standardisation:
    members = cut_lineage(numbered_components(pairs, c.CITY, "matched_city"))
    summary = pairs.join(members.withColumnRenamed("value", c.CITY), c.CITY)
    stacked = cut_lineage(propose(stack(members, records)))
    return Standardisation(summary, stacked, details(records, stacked))


def by_similarity(
    records: DataFrame, threshold: float = c.FUZZY_THRESHOLD, jaro_winkler_threshold: float = c.JARO_WINKLER_THRESHOLD
) -> Standardisation:
    """Pairs by composite similarity, guarded by Jaro-Winkler."""
    kept = records.select(c.ID, c.CITY, c.POST_CODE)
    pairs = cut_lineage(match_pairs(kept, c.CITY, threshold, jaro_winkler_threshold))
    return _finish(kept, pairs)


def by_spelling(records: DataFrame, distance: int = 1, threshold: float = 97.0) -> Standardisation:
    """Pairs by edit distance, guarded by Jaro-Winkler: plain enough to be restated in SQL."""
    kept = records.select(c.ID, c.CITY, c.POST_CODE)
    edges = spelling_edges(kept, c.CITY, distance, threshold)
    pairs = edges.select(F.col("left").alias(c.CITY), F.col("right").alias("matched_city"), "similarity_score_jellyfish")
    return _finish(kept, cut_lineage(pairs))


def standardised(records: DataFrame, stacked: DataFrame) -> DataFrame:
    """Records with their standardised category."""
    return standardise(records, stacked)


__all__ = ["Standardisation", "by_similarity", "by_spelling", "closest_spelling", "standardised"]
