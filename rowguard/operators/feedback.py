"""Learning from reviewed records: labels, split, random forest, explanation, retagging."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.functions.predicates import cast_double, outcome
from rowguard.operators.metrics import confusion, metrics, profile
from rowguard.operators.ranking import quantiles
from rowguard.session import shared_folder


def attach_reviews(results: DataFrame, reviews: DataFrame, label: str = c.LABEL) -> DataFrame:
    """Results with review labels; a null label means unreviewed."""
    return results.join(reviews.select(c.ID, label), c.ID, "left")


def split(df: DataFrame, label: str = c.LABEL) -> DataFrame:
    """Reviewed rows train, the others test."""
    return df.withColumn("train_or_test", F.when(F.col(label).isNotNull(), "train").otherwise("test"))


def split_counts(df: DataFrame, label: str = c.LABEL) -> DataFrame:
    known = F.col(label).isNotNull()
    return df.agg(F.count_if(known).alias("train_rows"), F.count_if(~known).alias("test_rows"))


# The default parameters of the random forest.
DEFAULT_PARAMS = {
    "numTrees": 20,
    "maxDepth": 5,
    "impurity": "gini",
    "featureSubsetStrategy": "auto",
    "minInstancesPerNode": 1,
    "minInfoGain": 0.0,
    "seed": 17,
}


@dataclass
class AnomalyClassifier:
    """Random forest on scores, place and neighbours; null features count as 0."""

    input_columns: Sequence[str] = tuple(c.FEATURES)
    response: str = c.LABEL
    class_thresholds: Sequence[float] = (0.5, 0.5)
    params: dict = field(default_factory=lambda: dict(DEFAULT_PARAMS))
    model: PipelineModel | None = field(default=None, init=False)

    def prepare(self, df: DataFrame) -> DataFrame:
        return cast_double(df, self.input_columns).fillna(0.0, subset=list(self.input_columns))

    def fit(self, train: DataFrame) -> "AnomalyClassifier":
        labelled = self.prepare(train.filter(F.col(self.response).isNotNull()))
        labelled = labelled.withColumn(self.response, F.col(self.response).cast("double"))
        forest = RandomForestClassifier(featuresCol="features", labelCol=self.response, predictionCol="prediction", **self.params)
        forest.setThresholds(list(self.class_thresholds))
        assembler = VectorAssembler(inputCols=list(self.input_columns), outputCol="features")
        self.model = Pipeline(stages=[assembler, forest]).fit(labelled.select(*self.input_columns, self.response))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prepare(df))

    def importance(self, df: DataFrame) -> DataFrame:
        """Feature importances by name, highest first."""
        values = self.model.stages[-1].featureImportances.toArray()
        rows = [(name, float(v)) for name, v in zip(self.input_columns, values)]
        return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def partial_dependence(self, df: DataFrame, feature: str, grid_size: int = 100) -> DataFrame:
        """Mean probability of an anomaly with one feature set to each grid value in turn.

        The grid is the observed values when they are few, else even steps between the 5 % and
        95 % quantiles. No row meets the grid: with the feature left open a row reaches a few leaves
        of each tree, which are counted in one pass, and a grid value picks those whose range holds it.
        """
        ready = self.prepare(df).select(*self.input_columns)
        few = [r[0] for r in ready.select(feature).distinct().limit(grid_size).collect()]
        if len(few) < grid_size:
            grid = sorted(few)
        else:
            low, high = quantiles(ready, feature, [0.05, 0.95], interpolate=True)
            grid = [low + (high - low) * i / (grid_size - 1) for i in range(grid_size)]
        roots = forest_nodes(df.sparkSession, self.model.stages[-1])
        open_feature = self.input_columns.index(feature)
        reached = F.flatten(F.array(*[_reached(root, open_feature, self.input_columns) for root in roots]))
        # A row for every leaf of the forest, at most.
        counts = dict(ready.select(F.explode(reached).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1))).collect())
        sums, weights = np.zeros(len(grid)), np.zeros(len(grid))
        for root in roots:
            for leaf, above, until in _ranges(root, open_feature):
                holds = (np.array(grid) > above) & (np.array(grid) <= until)
                sums += holds * leaf.probability * counts.get(leaf.number, 0)
                weights += holds * counts.get(leaf.number, 0)
        curve = [(float(g), float(p)) for g, p in zip(grid, sums / np.maximum(weights, 1))]
        return df.sparkSession.createDataFrame(curve, "feature_value double, partial_dependence double")


@dataclass
class Node:
    """A node of a forest, numbered over all trees; a leaf has no children. Values up to ``threshold`` go left."""

    number: int
    probability: float
    feature: int = -1
    threshold: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


def forest_nodes(spark: SparkSession, forest: RandomForestClassificationModel) -> list[Node]:
    """The trees of a binary forest on continuous features, from its saved form; probabilities are of class 1."""
    place = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    forest.save(place)
    # At most trees x 2^(depth + 1) rows, whatever the data.
    rows = spark.read.parquet(f"{place}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    by_place = {(r.treeID, r.id): k for k, r in enumerate(rows)}

    def node(tree: int, at: int) -> Node:
        k = by_place[tree, at]
        row = rows[k]
        share = row.impurityStats[1] / max(sum(row.impurityStats), 1e-300)
        if row.leftChild < 0:
            return Node(k, share)
        return Node(k, share, row.split.featureIndex, row.split.leftCategoriesOrThreshold[0], node(tree, row.leftChild), node(tree, row.rightChild))

    return [node(tree, 0) for tree in sorted({r.treeID for r in rows})]


def _reached(node: Node, open_feature: int, names: Sequence[str]) -> Column:
    """The leaves a row can reach while one feature may have any value."""
    if node.left is None:
        return F.array(F.lit(node.number))
    left, right = _reached(node.left, open_feature, names), _reached(node.right, open_feature, names)
    if node.feature == open_feature:
        return F.concat(left, right)
    return F.when(F.col(names[node.feature]) <= F.lit(node.threshold), left).otherwise(right)


def _ranges(node: Node, open_feature: int, above: float = -math.inf, until: float = math.inf) -> Iterator[tuple[Node, float, float]]:
    """Leaves with the values of the open feature, over ``above`` and up to ``until``, that lead to them."""
    if node.left is None:
        yield node, above, until
    elif node.feature == open_feature:
        yield from _ranges(node.left, open_feature, above, min(until, node.threshold))
        yield from _ranges(node.right, open_feature, max(above, node.threshold), until)
    else:
        yield from _ranges(node.left, open_feature, above, until)
        yield from _ranges(node.right, open_feature, above, until)


def retag(predicted: DataFrame) -> DataFrame:
    """Clear the tag where the model sees no anomaly and keep the rows still tagged."""
    cleared = predicted.withColumn("tag_anomalies", F.when(F.col("prediction") == 0, None).otherwise(F.col("tag_anomalies")))
    return cleared.drop("features", "rawPrediction", "probability").filter(F.col("tag_anomalies").isNotNull())


def evaluate(predicted: DataFrame, truth: str = "is_error", part: str = "all") -> DataFrame:
    """Confusion counts and rates of the predictions over all, train or test rows."""
    if part not in ("all", "train", "test"):
        raise ValueError(f"part {part!r} is not all, train or test")
    rows = predicted if part == "all" else predicted.filter(F.col("train_or_test") == part)
    positive = F.coalesce(F.col("prediction"), F.lit(0)) == 1
    return metrics(confusion(rows, F.col(truth).cast("boolean"), positive))


def report(predicted: DataFrame, truth: str = "is_error") -> DataFrame:
    """Rows by tag, truth, split and prediction."""
    return profile(predicted, ["tag_anomalies", truth, "train_or_test", "prediction"])


def with_outcome(predicted: DataFrame, truth: str = "is_error") -> DataFrame:
    """Outcome class of each row, and the border colour of its map marker."""
    return predicted.withColumns(
        {
            "outcome": outcome(F.col(truth).cast("boolean"), F.col("prediction") == 1),
            "border": F.when(F.col("train_or_test") == "train", "red").otherwise("black"),
        }
    )
