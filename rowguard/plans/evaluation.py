"""How well the scores find the known errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rowguard import config as c
from rowguard.operators.metrics import auto_threshold, confusion_at, precision_recall, sweep
from rowguard.session import cut_lineage

# The two cuts shown beside the estimated one.
SHOWN_CUTS = (-0.56, -0.53)


@dataclass
class Evaluation:
    cuts: DataFrame
    swept: DataFrame
    curve: DataFrame
    shown: DataFrame


def evaluate_scores(scores: DataFrame, truth: DataFrame, score: str = c.SCORE_CITY_CLUSTER, flag: str = "is_error") -> Evaluation:
    """Join the truth by id, then estimated and best cut, the sweep, the curve and the shown cuts."""
    known = cut_lineage(scores.drop(flag).join(truth.select(c.ID, flag), c.ID, "left").select(score, flag))
    return Evaluation(
        auto_threshold(known, score, flag),
        sweep(known, score, flag),
        precision_recall(known, score, flag),
        confusion_at(known, score, flag, SHOWN_CUTS),
    )
