"""Isolation forest: trees grown on small hashed samples, rows scored where they lie."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowguard import config as c
from rowguard.operators.joins import lookup_join
from rowguard.operators.ranking import first_per_group
from rowguard.session import cut_lineage

TREE_SCHEMA = "grp string, tree int, sample int, node int, feature int, cut double, child int, value double"
BROADCAST_GROUPS = 64
ROWS_PER_SLICE = 100_000
_SCALE = 1 << 30


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n leaves (Liu et al., 2008)."""
    n = np.asarray(n, dtype="float64")
    with np.errstate(divide="ignore", invalid="ignore"):
        big = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Node arrays of one tree, grown level by level for all its nodes at once.

    A node with ``feature`` -1 is a leaf and ``value`` the depth at which its points count as
    isolated; the children of another are ``child`` and, above the cut, ``child + 1``.
    """
    limit = math.ceil(math.log2(max(len(points), 2)))
    size = 2 * len(points)
    feature, child = np.full(size, -1), np.full(size, -1)
    cut, value = np.zeros(size), np.zeros(size)
    at = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    used = 1
    for depth in range(limit + 1):
        rows = rows[np.argsort(at[rows], kind="stable")]
        nodes, starts, counts = np.unique(at[rows], return_index=True, return_counts=True)
        low, high = np.minimum.reduceat(points[rows], starts), np.maximum.reduceat(points[rows], starts)
        can_split = high > low
        grows = can_split.any(axis=1) & (depth < limit)
        value[nodes[~grows]] = depth + average_path(counts[~grows])
        if not grows.any():
            break
        nodes, low, high, can_split = nodes[grows], low[grows], high[grows], can_split[grows]
        # One of the features that vary in the node, then a cut between its ends.
        pick = np.floor(rng.random(len(nodes)) * can_split.sum(axis=1)).astype(np.int64)
        chosen = np.argmax(np.cumsum(can_split, axis=1) > pick[:, None], axis=1)
        ends = np.arange(len(nodes)), chosen
        cuts = low[ends] + rng.random(len(nodes)) * (high[ends] - low[ends])
        cuts = np.where(cuts < high[ends], cuts, low[ends])
        feature[nodes], cut[nodes] = chosen, cuts
        child[nodes] = used + 2 * np.arange(len(nodes))
        used += 2 * len(nodes)
        rows = rows[np.repeat(grows, counts)]
        node = at[rows]
        at[rows] = child[node] + (points[rows, feature[node]] > cut[node])
    return {"node": np.arange(used), "feature": feature[:used], "cut": cut[:used], "child": child[:used], "value": value[:used]}


def pack(nodes: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """One tuple of node arrays per tree."""
    trees = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append(tuple(t[col].to_numpy() for col in ("feature", "cut", "child", "value")))
    return trees


def mean_depth(trees: list[tuple[np.ndarray, ...]], points: np.ndarray) -> np.ndarray:
    """Average isolation depth of each point over the trees, all points of a batch at once."""
    total = np.zeros(len(points))
    rows = np.arange(len(points))
    for feature, cut, child, value in trees:
        at = np.zeros(len(points), dtype=np.int64)
        live = rows[feature[at] >= 0]
        while len(live):
            node = at[live]
            at[live] = child[node] + (points[live, feature[node]] > cut[node])
            live = live[feature[at[live]] >= 0]
        total += value[at]
    return total / len(trees)


def anomaly_score(trees: list, sample: int, points: np.ndarray) -> np.ndarray:
    """-2^(-depth / c(sample)): near -1 isolated early, near -0.5 and above ordinary."""
    norm = float(average_path(sample))
    if norm == 0.0 or all(len(t[0]) == 1 for t in trees):
        return np.full(len(points), -0.5)
    return -np.power(2.0, -mean_depth(trees, points) / norm)


def trees_of(nodes: pd.DataFrame) -> tuple[list, int]:
    """The packed trees of one group and the rows each was grown from."""
    return pack(nodes), int(nodes["sample"].iloc[0])


def usable_scores(forest: tuple[list, int] | None, points: np.ndarray) -> np.ndarray:
    """Scores of the finite points, NaN for the others and for a group without a forest."""
    out = np.full(len(points), np.nan)
    ready = np.isfinite(points).all(axis=1)
    if forest is not None and ready.any():
        out[ready] = anomaly_score(*forest, points[ready])
    return out


@dataclass
class IsolationForest:
    """Scores records by how early random splits isolate them; lower is more anomalous.

    One forest over the table, or one per value of ``partition_col``. Columns that are constant
    in a group cannot be split and so play no part. Rows with a null, NaN or infinite feature are
    neither used nor scored, nor are rows of a group that the forest does not know. A fitted forest
    holds the sample size of every group, so other tables can be scored with it.
    """

    input_cols: Sequence[str]
    output_col: str = "anomaly_score"
    partition_col: str | None = None
    id_col: str = c.ID
    n_trees: int = 50
    max_samples: int = 256
    seed: int = 0
    broadcast_groups: int = BROADCAST_GROUPS
    _group: str = field(default="_grp", init=False)

    def _with_group(self, df: DataFrame) -> DataFrame:
        group = F.col(self.partition_col).cast("string") if self.partition_col else F.lit("all")
        return df.withColumn(self._group, F.coalesce(group, F.lit("\x00null")))

    def _features(self, df: DataFrame) -> DataFrame:
        cells = [F.col(x).cast("double").alias(f"f{i}") for i, x in enumerate(self.input_cols)]
        rows = self._with_group(df).select(F.col(self._group).alias("grp"), F.col(self.id_col).alias("id"), *cells)
        for i in range(len(cells)):
            rows = rows.filter(F.abs(f"f{i}") < F.lit(math.inf))
        return rows.dropna()

    def _sizes(self, rows: DataFrame) -> tuple[DataFrame, dict[str, int] | None]:
        """Rows per group, and the same as a dict when there are at most ``broadcast_groups`` groups."""
        sizes = cut_lineage(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")))
        few = sizes.limit(self.broadcast_groups + 1).collect()
        return sizes, ({r["grp"]: r["size"] for r in few} if len(few) <= self.broadcast_groups else None)

    def samples(self, df: DataFrame) -> DataFrame:
        """``max_samples`` rows of each group for each tree, drawn by hashes of the id.

        A first hash keeps of each group a pool of about what all its trees need, so the
        table is passed once with one hash per row, and not moved when the groups are few; trees
        then draw from the pools. The draw depends on ids and seed alone, not on partitions.
        """
        rows = self._features(df)
        need = max(self.n_trees, 16) * self.max_samples
        sizes, few = self._sizes(rows)
        if few:
            known = F.create_map(*[F.lit(x) for pair in few.items() for x in pair])
            sized = rows.withColumn("size", known[F.col("grp")])
        else:
            sized = lookup_join(rows, sizes, "grp", "inner")
        chance = F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(_SCALE))
        pool = sized.filter(chance < F.least(F.lit(1.0), F.lit(need) / F.col("size")) * _SCALE)
        pool = pool.withColumn("held", F.least("size", F.lit(need)))
        drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1))))
        drawn = drawn.withColumn("h", F.pmod(F.xxhash64("id", "tree", F.lit(self.seed + 1)), F.lit(_SCALE)))
        drawn = drawn.filter(F.col("h") < F.least(F.lit(1.0), F.lit(2 * self.max_samples) / F.col("held")) * _SCALE)
        return first_per_group(drawn, ["grp", "tree"], [F.col("h"), F.col("id")], self.max_samples)

    def fit(self, df: DataFrame) -> DataFrame:
        """The forest as a table of nodes; every task grows one tree from at most ``max_samples`` rows."""
        names = [f"f{i}" for i in range(len(self.input_cols))]
        seed = self.seed

        def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            grp, tree = key
            ordered = group.sort_values("id")
            rng = np.random.default_rng([seed, int(tree), *grp.encode()])
            nodes = pd.DataFrame(grow_tree(ordered[names].to_numpy(), rng))
            nodes.insert(0, "sample", len(ordered))
            nodes.insert(0, "tree", tree)
            nodes.insert(0, "grp", grp)
            return nodes

        picked = self.samples(df).select("grp", "tree", "id", *names)
        return cut_lineage(picked.groupBy("grp", "tree").applyInPandas(grow, TREE_SCHEMA))

    def transform(self, df: DataFrame, forest: DataFrame) -> DataFrame:
        """Add the score column.

        A forest has at most ``n_trees * (2 * max_samples - 1)`` nodes per group. Up to
        ``broadcast_groups`` groups go to every task as arrays; beyond that rows and trees meet
        by group, a large group spread over slices of about 100,000 rows. Both give the same rows.
        """
        groups = forest.select("grp").distinct().limit(self.broadcast_groups + 1).count()
        score = self._score_broadcast if groups <= self.broadcast_groups else self._score_joined
        return score(df, forest)

    def _score_broadcast(self, df: DataFrame, forest: DataFrame) -> DataFrame:
        packed = {grp: trees_of(part) for grp, part in forest.toPandas().groupby("grp")}
        shared = df.sparkSession.sparkContext.broadcast(packed)

        # Of one batch at a time, not of an iterator: then Spark runs the scores of a row in one Python worker, not in one each.
        @F.pandas_udf("double")
        def score(grp: pd.Series, *columns: pd.Series) -> pd.Series:
            forests = shared.value
            points = np.column_stack([col.to_numpy(dtype="float64", na_value=np.nan) for col in columns])
            out = np.full(len(points), np.nan)
            for name in grp.unique():
                mine = (grp == name).to_numpy()
                out[mine] = usable_scores(forests.get(name), points[mine])
            return pd.Series(out).astype("Float64").where(~np.isnan(out), pd.NA)

        features = [F.col(x).cast("double") for x in self.input_cols]
        scored = self._with_group(df)
        return scored.withColumn(self.output_col, score(F.col(self._group), *features)).drop(self._group)

    def _score_joined(self, df: DataFrame, forest: DataFrame) -> DataFrame:
        """Rows carry all their columns to the trees and back, so ids need not be unique."""
        names = [f"c{i}" for i in range(len(df.columns))]
        features = [names[df.columns.index(x)] for x in self.input_cols]
        grouped = self._with_group(df).select(F.col(self._group).alias("grp"), *[F.col(x).alias(n) for x, n in zip(df.columns, names)])
        sizes = cut_lineage(grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size")))
        slices = sizes.select("grp", F.ceil(F.col("size") / ROWS_PER_SLICE).cast("int").alias("slices"))
        spread = F.pmod(F.xxhash64(*names), F.col("slices")).cast("int")
        placed = lookup_join(grouped, slices, "grp", "inner").withColumn("slice", spread).select("grp", "slice", *names)
        every = F.explode(F.sequence(F.lit(0), F.col("slices") - F.lit(1))).alias("slice")
        trees = forest.join(slices, "grp").select(*forest.columns, every)
        layout = StructType([*[StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)], StructField("score", DoubleType())])

        def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            columns = [left.column(x).cast(pa.float64()).to_numpy().astype("float64") for x in features]
            values = usable_scores(trees_of(right.to_pandas()) if right.num_rows else None, np.column_stack(columns))
            out = left.select(names)
            return out.append_column("score", pa.array(values, pa.float64(), mask=np.isnan(values)))

        met = placed.groupBy("grp", "slice").cogroup(trees.groupBy("grp", "slice")).applyInArrow(score, layout)
        return met.toDF(*df.columns, self.output_col)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.transform(df, self.fit(df))


def prepare(df: DataFrame, code: str = c.CODE, cluster: str = c.CLUSTER, common: str = c.COMMON_CLUSTER) -> DataFrame:
    """Rows without a code get the largest code plus one and fall back to their own cluster."""
    from rowguard.functions.predicates import fill_max_plus_one

    fallback = F.when(F.col(code).isNull(), F.col(cluster)).otherwise(F.col(common))
    return fill_max_plus_one(df.withColumn(common, fallback), code)


def standardise(df: DataFrame, columns: Sequence[str], prefix: str = "st_attr_") -> DataFrame:
    """Zero mean and unit sample deviation over the whole table, as extra columns; a constant becomes 0."""
    added = {}
    for i, name in enumerate(columns):
        value = F.col(name).cast("double")
        mean, spread = df.agg(F.avg(value)).scalar(), df.agg(F.stddev_samp(value)).scalar()
        added[f"{prefix}{i}"] = F.when(spread > 0, (value - mean) / spread).when(value.isNotNull(), F.lit(0.0))
    return df.withColumns(added)


def score_coordinates(df: DataFrame, **params) -> DataFrame:
    return IsolationForest([c.LAT, c.LONG], c.SCORE_COORDS, **params).fit_transform(df)


def score_city(df: DataFrame, **params) -> DataFrame:
    return IsolationForest([c.LAT, c.LONG, c.CODE], c.SCORE_CITY, **params).fit_transform(df)


def score_city_cluster(df: DataFrame, **params) -> DataFrame:
    return IsolationForest([c.LAT, c.LONG, c.CODE], c.SCORE_CITY_CLUSTER, c.COMMON_CLUSTER, **params).fit_transform(df)
