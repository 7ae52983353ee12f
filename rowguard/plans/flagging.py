"""Job C: flag and tag records, and learn from reviews which alerts to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.operators.feedback import AnomalyClassifier, retag, split
from rowguard.operators.flags import flag_percentile, flag_top_k, tag
from rowguard.operators.neighbours import with_neighbours
from rowguard.session import cut_lineage


def results(scores: DataFrame, neighbour_stats: DataFrame, by_rank: bool = True) -> DataFrame:
    """Scores with neighbours, flags and tag, one row per record."""
    joined = cut_lineage(with_neighbours(scores, neighbour_stats))
    return tag(flag_top_k(joined) if by_rank else flag_percentile(joined))


def reviewed_results(feedback: DataFrame, classifier: AnomalyClassifier | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows with the model's prediction, and the alerts the model upholds."""
    parted = split(feedback)
    model = (classifier or AnomalyClassifier()).fit(parted.filter(F.col("train_or_test") == "train"))
    predicted = model.predict(parted).fillna({c.LABEL: 0, "prediction": 0.0})
    return predicted, retag(predicted)

