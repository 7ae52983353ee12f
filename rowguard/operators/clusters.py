"""Place clusters: K-means with an elbow, one cluster per category, small clusters merged."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.functions.geo import haversine_m
from rowguard.functions.predicates import any_null
from rowguard.operators.joins import lookup_join
from rowguard.session import cut_lineage

ROUNDS = 20
TOLERANCE = 1e-4


def elbow(ks: Sequence[int], costs: Sequence[float]) -> int:
    """The k whose normalised cost lies farthest below the chord of a falling, convex curve.

    A curve that never bends below its chord has no elbow; then the largest k is taken.
    """
    low, high = min(costs), max(costs)
    if len(ks) < 3 or high <= low:
        return ks[0]
    span = ks[-1] - ks[0]
    bend = [1 - (k - ks[0]) / span - (cost - low) / (high - low) for k, cost in zip(ks, costs)]
    best = max(range(len(ks)), key=lambda i: (bend[i], -i))
    return ks[best] if bend[best] > 0 else ks[-1]


def nearest_centre(centres: Sequence[Sequence[float]], geo_cols: Sequence[str]) -> tuple[Column, Column]:
    """Number and squared distance of the nearest centre; ties to the first."""
    # One array literal: the code made for a plan does not change with the centres.
    flat = F.array(*[F.lit(float(x)) for centre in centres for x in centre])
    away = []
    for j in range(len(centres)):
        gaps = [F.col(g) - flat[j * len(geo_cols) + i] for i, g in enumerate(geo_cols)]
        away.append(sum((x * x for x in gaps[1:]), gaps[0] * gaps[0]))
    each = F.array(*away)
    least = F.array_min(each)
    return (F.array_position(each, least) - 1).cast("int"), least


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    away = ((points[:, None] - centres[None]) ** 2).sum(-1)
    near = away.argmin(1)
    return near, away[np.arange(len(points)), near]


def _cluster_sums(batches: Iterator[pa.RecordBatch], centres: Mapping[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Weight, cost and weighted coordinates of the clusters of every model, a row per centre and task."""
    sums = {k: np.zeros((len(own), 2 + own.shape[1])) for k, own in centres.items()}
    for batch in batches:
        *geo, weight = (batch.column(i).to_numpy() for i in range(batch.num_columns))
        points = np.stack(geo, axis=1)
        for k, own in centres.items():
            near, away = _nearest(points, own)
            parts = [weight, away * weight, *(x * weight for x in geo)]
            sums[k] += np.stack([np.bincount(near, part, len(own)) for part in parts], axis=1)
    for k, held in sums.items():
        own = {"k": np.full(len(held), k, np.int32), "j": np.arange(len(held), dtype=np.int32)}
        own |= {f"s{i}": np.ascontiguousarray(held[:, i]) for i in range(held.shape[1])}
        yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in own.items()})


def _summed(points: DataFrame, geo_cols: Sequence[str], centres: Mapping[int, np.ndarray]) -> dict[int, np.ndarray]:
    """``_cluster_sums`` over all tasks: one pass, whatever the number of models."""
    names = [f"s{i}" for i in range(2 + len(geo_cols))]
    parts = points.select(*geo_cols, "_weight").mapInArrow(partial(_cluster_sums, centres=dict(centres)), "k int, j int, " + ", ".join(f"{x} double" for x in names))
    rows = parts.groupBy("k", "j").agg(*[F.sum(x).alias(x) for x in names]).collect()
    out = {k: np.zeros((len(own), len(names))) for k, own in centres.items()}
    for r in rows:
        out[r.k][r.j] = r[2:]
    return out


def candidate_centres(points: DataFrame, geo_cols: Sequence[str], most: int, seed: int = 1, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Some ``2 * most * rounds`` points far from one another, and the weight of those nearest to each.

    Every round draws points in proportion to their weight and squared distance from those drawn before, as a
    race of exponential times fixed by a hash of the point, so it takes one pass and no order of rows matters.
    """
    hashed = F.pmod(F.xxhash64(F.lit(seed), *geo_cols), F.lit(1 << 52))
    late = -F.log((hashed + F.lit(0.5)) / F.lit(float(1 << 52)))

    def pulled(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _nearest(np.stack([batch.column(i).to_numpy() for i in range(len(geo_cols))], axis=1), centres)[1]
            yield batch.append_column("_pull", pa.array(away))

    def first(rows: DataFrame, pull: Column, count: int) -> list[tuple[float, ...]]:
        timed = rows.filter(pull > 0).select(*geo_cols, (F.col("_late") / pull).alias("_time"))
        return [tuple(r)[: len(geo_cols)] for r in timed.orderBy("_time", *geo_cols).limit(count).collect()]

    timed = points.select(*geo_cols, "_weight", late.alias("_late"))
    shape = ", ".join(f"{g} double" for g in geo_cols) + ", _weight double, _late double, _pull double"
    drawn = first(timed, F.col("_weight"), 1)
    for _ in range(rounds):
        drawn += first(timed.mapInArrow(partial(pulled, centres=np.array(drawn)), shape), F.col("_weight") * F.col("_pull"), 2 * most)
    candidates = np.array(drawn)
    return candidates, _summed(points, geo_cols, {0: candidates})[0][:, 0]


def starting_centres(candidates: np.ndarray, weights: np.ndarray, ks: Sequence[int], seed: int = 1) -> dict[int, np.ndarray]:
    """For every k, its centres among the few candidates: drawn apart by weight, then settled on the candidates."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.choice(len(weights), p=weights / weights.sum()))]
    while len(picked) < max(ks):
        far = ((candidates[:, None] - candidates[picked][None]) ** 2).sum(-1).min(1) * weights
        if not far.any():
            break
        picked.append(int(rng.choice(len(weights), p=far / far.sum())))
    out = {}
    for k in ks:
        centres = candidates[picked[:k]].copy()
        for _ in range(30):
            near = ((candidates[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            for j in range(len(centres)):
                own = near == j
                if weights[own].sum() > 0:
                    centres[j] = np.average(candidates[own], axis=0, weights=weights[own])
        out[k] = centres
    return out


def settle(points: DataFrame, geo_cols: Sequence[str], starts: Mapping[int, np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[dict[int, np.ndarray], dict[int, float], int]:
    """Lloyd's iteration for several models at once: centres and cost of each, and the passes it took.

    A pass gives every point to its centre in all models and adds up all their clusters, a row per centre and task. It ends when no centre moves by more than ``tolerance``, or after ``rounds`` moves.
    """
    centres = {k: np.array(v, dtype=float) for k, v in starts.items()}
    passes = 0
    while True:
        sums = _summed(points, geo_cols, centres)
        passes += 1
        costs = {k: float(own[:, 1].sum()) for k, own in sums.items()}
        # A centre of no points stays.
        moved = {k: np.where(own[:, :1] > 0, own[:, 2:] / np.maximum(own[:, :1], 1e-300), centres[k]) for k, own in sums.items()}
        if passes > rounds or all(np.abs(moved[k] - own).max() <= tolerance for k, own in centres.items()):
            return centres, costs, passes
        centres = moved


@dataclass
class PlaceClusters:
    """Parameters of the clustering; ``fit`` returns records with ``cluster`` and ``most_common_cluster``."""

    geo_cols: Sequence[str] = (c.LAT, c.LONG)
    cat_col: str = c.STANDARD
    output_col: str = c.CLUSTER
    size_threshold: int = 100
    max_n_clusters: int = 11
    seed: int = 1
    default_cluster: int = 99
    costs: dict[int, float] = field(default_factory=dict, init=False)
    k: int | None = field(default=None, init=False)

    @property
    def common_col(self) -> str:
        return f"most_common_{self.output_col}"

    def kmeans(self, df: DataFrame) -> DataFrame:
        """Cluster rows with coordinates; rows without any go to the default cluster.

        Equal coordinates are one weighted point, which leaves the cost unchanged and spares
        every pass over copies of a place. All numbers of clusters are tried in the same passes.
        """
        geo = [F.col(g).cast("double").alias(g) for g in self.geo_cols]
        places = df.dropna(subset=list(self.geo_cols)).select(*geo).groupBy(*self.geo_cols)
        # Written once: the passes read few, even partitions, and a lost executor repeats no grouping.
        points = cut_lineage(places.agg(F.count(F.lit(1)).cast("double").alias("_weight")))
        distinct = points.limit(self.max_n_clusters).count()
        if distinct == 0:
            return df.withColumn(self.output_col, F.lit(self.default_cluster))
        ks = [k for k in range(2, self.max_n_clusters) if k <= distinct] or [2]
        starts = starting_centres(*candidate_centres(points, self.geo_cols, self.max_n_clusters, self.seed), ks, self.seed)
        centres, self.costs, _ = settle(points, self.geo_cols, starts)
        self.k = elbow(ks, [self.costs[k] for k in ks])
        unplaced = any_null(self.geo_cols)
        for g in self.geo_cols:
            unplaced = unplaced | F.isnan(F.col(g).cast("double"))
        ready = df.withColumns({f"_{g}": F.col(g).cast("double") for g in self.geo_cols})
        number, _ = nearest_centre(centres[self.k].tolist(), [f"_{g}" for g in self.geo_cols])
        return ready.select(*df.columns, F.when(unplaced, self.default_cluster).otherwise(number).cast("int").alias(self.output_col))

    def unify(self, df: DataFrame) -> DataFrame:
        return with_common_cluster(df, self.cat_col, self.output_col)

    def merge(self, df: DataFrame) -> DataFrame:
        return merge_small(df, self.common_col, self.geo_cols, self.size_threshold)

    def fit(self, df: DataFrame) -> DataFrame:
        return self.merge(self.unify(self.kmeans(df)))


def pair_counts(df: DataFrame, category: str, cluster: str) -> DataFrame:
    return df.groupBy(category, cluster).agg(F.count(F.lit(1)).alias("count"))


def modal_clusters(df: DataFrame, category: str, cluster: str) -> DataFrame:
    """Most frequent cluster of each category; equal counts go to the smallest cluster."""
    best = F.max_by(cluster, F.struct("count", -F.col(cluster)))
    return pair_counts(df, category, cluster).groupBy(category).agg(best.alias(f"most_common_{cluster}"))


def with_common_cluster(df: DataFrame, category: str = c.STANDARD, cluster: str = c.CLUSTER) -> DataFrame:
    """Give each record its category's cluster; a record without category keeps its own."""
    common = f"most_common_{cluster}"
    modes = modal_clusters(df.filter(F.col(category).isNotNull()), category, cluster)
    joined = lookup_join(df, modes, category)
    return joined.withColumn(common, F.coalesce(common, cluster)).select(*df.columns, common)


def centroids(df: DataFrame, cluster: str, geo_cols: Sequence[str] = (c.LAT, c.LONG)) -> DataFrame:
    """Mean place and size of each cluster."""
    lat, long = geo_cols
    return df.groupBy(cluster).agg(
        F.avg(lat).alias("centroid_lat"), F.avg(long).alias("centroid_long"), F.count(F.lit(1)).alias("cluster_size")
    )


def nearest_large(centers: DataFrame, cluster: str, size_threshold: int) -> DataFrame:
    """For each cluster below the threshold the nearest one at or above it, by great-circle distance.

    Clusters without a centroid take no part, equal distances go to the smallest cluster. The
    large clusters are one array: clusters are at most as many as the clustering made (k plus
    the default one), not a function of the rows.
    """
    placed = centers.filter(F.col("centroid_lat").isNotNull() & F.col("centroid_long").isNotNull())
    large = placed.filter(F.col("cluster_size") >= size_threshold)
    listed = large.agg(F.collect_list(F.struct("centroid_lat", "centroid_long", F.col(cluster).alias("id")))).scalar()
    small = placed.filter(F.col("cluster_size") < size_threshold)

    def reach(other):
        d = haversine_m("centroid_lat", "centroid_long", other["centroid_lat"], other["centroid_long"])
        return F.struct(F.round(d, 2).alias("d"), other["id"].alias("id"))

    near = small.withColumn("_large", listed).withColumn("_near", F.array_min(F.transform("_large", reach)))
    near = near.filter(F.col("_near").isNotNull())
    return near.select(
        F.col(cluster).alias("small_cluster_id"),
        F.col("_near.id").alias("nearest_large_cluster"),
        F.col("_near.d").alias("distance_m"),
    )


def merge_small(
    df: DataFrame, cluster: str = c.COMMON_CLUSTER, geo_cols: Sequence[str] = (c.LAT, c.LONG), size_threshold: int = 100
) -> DataFrame:
    """Move the rows of small clusters to the nearest large one.

    One pass is enough: the targets only grow. Without a large cluster nothing changes.
    """
    moves = nearest_large(centroids(df, cluster, geo_cols), cluster, size_threshold)
    moves = moves.select(F.col("small_cluster_id").alias(cluster), "nearest_large_cluster")
    joined = lookup_join(df, moves, cluster)
    return joined.withColumn(cluster, F.coalesce("nearest_large_cluster", cluster)).select(*df.columns)
