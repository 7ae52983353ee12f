"""Neighbours of each record on the globe: how many within a radius, and the nearest one.

No step pairs all records of a place. Records at equal coordinates are one *site* with a count. Sites are
range-partitioned once, in the order of a curve through the cube around the globe, so a part is a compact
region with about as many sites as any other. Two passes follow:

1. Every part builds a tree of boxes over its sites, answers its own, and puts down which of them lie so close to
   a box of another part that this part may hold a neighbour within the radius, or one nearer than their own.
   The boxes of all parts (a bounded number each) are what parts know of one another.
2. The sites put down are shuffled to the parts they ask, and the answers are added up per site.

A circle's count takes whole boxes by their sum and opens only those at its edge, so a crowded place costs the
length of the edge, not its area.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.functions.geo import EARTH_RADIUS_M, haversine_between
from rowguard.functions.predicates import is_valid_point
from rowguard.operators.joins import lookup_join
from rowguard.session import cut_lineage

PART_SITES = 1 << 15
MOST_PARTS = 1 << 12
PART_BOXES = 64
LEAF = 8
FAN = 8
QUERIES = 4096
MOST_PAIRS = 1 << 18  # queries and boxes, or sites, held beside one another; about 70 MB
SLACK_M = 0.02  # keeps rounding out of bounds; the test of a pair is exact


# -- sites -------------------------------------------------------------------------------


def sites(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and one row per coordinate pair with its count and two smallest ids."""
    point = records.filter(is_valid_point(c.LAT, c.LONG)).select(
        F.col(c.ID).alias("id"),
        F.col(c.CITY).alias("city"),
        F.col(c.LAT).cast("double").alias("lat"),
        # -180 and 180 are one meridian; + 0.0 turns a negative zero into zero.
        (F.when(F.col(c.LONG).cast("double") == 180, -180.0).otherwise(F.col(c.LONG).cast("double")) + F.lit(0.0)).alias("long"),
    )
    point = point.withColumn("lat", F.col("lat") + F.lit(0.0))
    # Tasks keep two rows a place before the shuffle; both windows share it.
    by_id = Window.partitionBy("lat", "long").orderBy("id", "city")
    two = point.withColumn("rn", F.row_number().over(by_id)).filter("rn <= 2").withColumn("own", F.struct("id", "city"))
    ends = two.select("lat", "long", "rn", F.col("own").alias("first"), F.coalesce(F.lead("own").over(by_id), "own").alias("second")).filter("rn = 1").drop("rn")
    counts = point.groupBy("lat", "long").agg(F.count(F.lit(1)).alias("n"))
    return point, counts.join(ends, ["lat", "long"]).withColumn("site", F.col("first.id"))


# -- order along a curve ---------------------------------------------------------------------


def _spread(cell: Column) -> Column:
    """The 20 bits of a number set three apart."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
    return cell


def curve(lat: str, long: str) -> Column:
    """Place on a Morton curve through the cube around the globe; it knows neither poles nor a date line."""
    y, x = F.radians(lat), F.radians(long)
    axes = (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))
    cells = [F.least(F.floor((v + 1) * (1 << 19)), F.lit((1 << 20) - 1)).cast("long") for v in axes]
    first, second, third = (_spread(v) for v in cells)
    return first.bitwiseOR(F.shiftleft(second, 1)).bitwiseOR(F.shiftleft(third, 2))


def in_parts(spots: DataFrame, part_sites: int = PART_SITES) -> DataFrame:
    """Sites range-partitioned along the curve, sorted and written once; ``part`` is the partition."""
    count = spots.count()
    # A small table still has a part for every core.
    parts = min(MOST_PARTS, max(-(-count // part_sites), min(count // LEAF**2, spots.sparkSession.sparkContext.defaultParallelism), 1))
    coded = spots.select("site", "lat", "long", "n", curve("lat", "long").alias("code"))
    ranged = coded.repartitionByRange(parts, "code", "lat", "long").sortWithinPartitions("code", "lat", "long")
    return cut_lineage(ranged.select("site", "lat", "long", "n", F.spark_partition_id().alias("part")))


# -- a tree of boxes over the sites of a part --------------------------------------------------


def _on_globe(lat: np.ndarray, long: np.ndarray) -> np.ndarray:
    y, x = np.radians(lat), np.radians(long)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


def _chord(metres: np.ndarray | float) -> np.ndarray:
    """Length through the unit globe of a great-circle distance; 2 from the other side on."""
    return 2 * np.sin(np.minimum(np.maximum(metres, 0.0) / (2 * EARTH_RADIUS_M), np.pi / 2))


def _least(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(np.maximum(low - points, points - high), 0.0) ** 2).sum(-1))


def _most(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(np.abs(points - low), np.abs(high - points)) ** 2).sum(-1))


class Level(NamedTuple):
    starts: np.ndarray  # first member one level below (or site); the last entry closes the level
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray  # records
    sites: np.ndarray


class Tree:
    """Boxes over runs of ``LEAF`` sites in curve order, then over runs of ``FAN`` boxes, up to a few."""

    def __init__(self, lat: np.ndarray, long: np.ndarray, n: np.ndarray, rank: np.ndarray):
        self.lat, self.long, self.n, self.rank = lat, long, n, rank
        self.points = _on_globe(lat, long)
        self.levels: list[Level] = []
        low = high = self.points
        width, sites = LEAF, np.ones(len(lat), np.int64)
        while not self.levels or len(low) > FAN:
            starts = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            n, sites = np.add.reduceat(n, starts), np.add.reduceat(sites, starts)
            self.levels.append(Level(np.append(starts, self.levels[-1].starts.size - 1 if self.levels else len(lat)), low, high, n, sites))
            width = FAN

    def boxes(self, most: int) -> Level:
        """The finest level of at most ``most`` boxes."""
        return next((level for level in self.levels if len(level.low) <= most), self.levels[-1])

    def _opened(self, k: int, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.levels[k].starts[node]
        size = self.levels[k].starts[node + 1] - first
        ends = np.cumsum(size)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        return np.repeat(query, size), np.repeat(first, size) + inner

    def _crowded(self, k: int, node: np.ndarray, queries: int) -> bool:
        """Opening the boxes makes too many pairs, and there are queries to go without."""
        return queries > 1 and (self.levels[k].starts[node + 1] - self.levels[k].starts[node]).sum() > MOST_PAIRS

    def _top(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        nodes = len(self.levels[-1].low)
        return np.repeat(np.arange(count), nodes), np.tile(np.arange(nodes), count)

    def inside(self, lat: np.ndarray, long: np.ndarray, radius: float) -> np.ndarray:
        """Records within ``radius`` metres of each query: whole boxes by their sum, only those at the edge are opened."""
        points = _on_globe(lat, long)
        total = np.zeros(len(lat), np.int64)
        query, node = self._top(len(lat))
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            near = _least(points[query], level.low[node], level.high[node]) <= _chord(radius + SLACK_M)
            query, node = query[near], node[near]
            whole = _most(points[query], level.low[node], level.high[node]) <= _chord(radius - SLACK_M)
            np.add.at(total, query[whole], level.n[node[whole]])
            if self._crowded(k, node[~whole], len(lat)):
                half = len(lat) // 2
                return np.concatenate([self.inside(lat[part], long[part], radius) for part in (slice(half), slice(half, None))])
            query, node = self._opened(k, query[~whole], node[~whole])
        close = haversine_between(lat[query], long[query], self.lat[node], self.long[node]) <= radius
        np.add.at(total, query[close], self.n[node[close]])
        return total

    def nearest(self, lat: np.ndarray, long: np.ndarray, reach: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest site other than ``skip`` within each query's reach: place (-1 for none) and metres to the centimetre."""
        points = _on_globe(lat, long)
        bound = _chord(reach + SLACK_M)
        query, node = self._top(len(lat))
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            near = _least(points[query], level.low[node], level.high[node]) <= bound[query]
            query, node = query[near], node[near]
            # The farthest point of a box of two sites or more is a bound for all others.
            sure = _most(points[query], level.low[node], level.high[node])
            several = level.sites[node] > 1
            np.minimum.at(bound, query[several], sure[several] + _chord(2 * SLACK_M))
            if self._crowded(k, node, len(lat)):
                half = len(lat) // 2
                parts = [self.nearest(lat[part], long[part], reach[part], None if skip is None else skip[part]) for part in (slice(half), slice(half, None))]
                return tuple(np.concatenate(x) for x in zip(*parts))
            query, node = self._opened(k, query, node)
        if skip is not None:
            other = node != skip[query]
            query, node = query[other], node[other]
        metres = haversine_between(lat[query], long[query], self.lat[node], self.long[node])
        close = metres <= reach[query]
        query, node, metres = query[close], node[close], np.round(metres[close], 2)
        by = np.lexsort((self.rank[node], metres, query))
        query, node, metres = query[by], node[by], metres[by]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place, distance = np.full(len(lat), -1), np.full(len(lat), np.inf)
        place[query[first]], distance[query[first]] = node[first], metres[first]
        return place, distance


def _tree(part: pa.Table) -> Tree:
    ids = part.column("site").combine_chunks()
    rank = np.empty(len(ids), np.int64)
    rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return Tree(*(part.column(x).to_numpy() for x in ("lat", "long", "n")), rank)


# -- two passes --------------------------------------------------------------------------------


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    part = pa.Table.from_batches(held)
    level = _tree(part).boxes(PART_BOXES)
    sides = {f"{side}{k}": pa.array(np.ascontiguousarray(box[:, k])) for side, box in (("low", level.low), ("high", level.high)) for k in range(3)}
    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(level.low), part.column("part")[0].as_py(), np.int32)), **sides})


class Boxes(NamedTuple):
    part: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _within_part(batches: Iterator[pa.RecordBatch], boxes: Boxes, radius: float, reach: float) -> Iterator[pa.RecordBatch]:
    """Counts and nearest sites among the part's own, and the questions its sites have for other parts."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    part = pa.Table.from_batches(held).combine_chunks()
    tree, ids = _tree(part), part.column("site").combine_chunks()
    own = part.column("part")[0].as_py()
    elsewhere = boxes.part != own
    other = Boxes(*(x[elsewhere] for x in boxes))
    for a in range(0, len(ids), QUERIES):
        b = min(len(ids), a + QUERIES)
        lat, long = tree.lat[a:b], tree.long[a:b]
        inside = tree.inside(lat, long, radius)
        alone = tree.n[a:b] == 1
        place, metres = np.full(b - a, -1), np.full(b - a, -1.0)
        place[alone], metres[alone] = tree.nearest(lat[alone], long[alone], np.full(alone.sum(), reach), np.arange(a, b)[alone])
        # Another part must be as near, to the centimetre; crowded sites only count.
        still = np.where(alone, np.minimum(metres + SLACK_M, reach), -1.0)
        yield _answers(ids.slice(a, b - a), inside, ids.take(pa.array(place, mask=place < 0)), np.where(place < 0, np.inf, metres), None)
        query, target = _asked(tree.points[a:b], np.maximum(still, radius), other)
        if len(query):
            yield _answers(ids.slice(a, b - a).take(pa.array(query)), None, None, still[query], target, lat[query], long[query])


def _asked(points: np.ndarray, metres: np.ndarray, boxes: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """Which query has to ask which part: runs of queries by their box first, then one by one."""
    queries, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    reach = _chord(metres + SLACK_M)
    for a in range(0, len(points), 64):
        run = points[a : a + 64]
        low, high = run.min(0), run.max(0)
        gap = np.sqrt((np.maximum(np.maximum(boxes.low - high, low - boxes.high), 0.0) ** 2).sum(1))
        near = np.flatnonzero(gap <= reach[a : a + 64].max())
        if len(near):
            q, k = np.nonzero(_least(run[:, None], boxes.low[near], boxes.high[near]) <= reach[a : a + 64, None])
            both = np.unique(np.stack([q + a, boxes.part[near[k]]]), axis=1)
            queries.append(both[0])
            targets.append(both[1].astype(np.int32))
    return np.concatenate(queries), np.concatenate(targets)


def _answers(site, inside, closest, metres, target, lat=None, long=None) -> pa.RecordBatch:
    """Answers have counts, and a nearest site and its distance or none; questions a target, a place and how far to look."""
    size = len(site)
    empty = partial(pa.nulls, size)
    far = ~np.isfinite(metres)
    columns = {
        "target": empty(pa.int32()) if target is None else pa.array(target),
        "site": site,
        "lat": empty(pa.float64()) if lat is None else pa.array(lat),
        "long": empty(pa.float64()) if long is None else pa.array(long),
        "inside": empty(pa.int64()) if inside is None else pa.array(inside),
        "distance": pa.array(metres, mask=far),
        "closest_site": empty(site.type) if closest is None else closest,
    }
    return pa.RecordBatch.from_pydict(columns)


def _answered(asked: pa.Table, part: pa.Table, radius: float) -> pa.Table:
    """What a part has for the sites that ask it."""
    columns = ["site", "inside", "distance", "closest_site"]
    if not asked.num_rows or not part.num_rows:
        return _answers(asked.column("site").combine_chunks().slice(0, 0), np.zeros(0, np.int64), None, np.zeros(0), None).select(columns)
    # Shuffled rows come in any order; the curve's order makes the boxes small.
    tree = _tree(part.sort_by("at"))
    ids = part.sort_by("at").column("site").combine_chunks()
    out = []
    for batch in asked.to_batches(max_chunksize=QUERIES):
        lat, long, still = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("lat", "long", "distance"))
        place, metres = np.full(len(lat), -1), np.full(len(lat), np.inf)
        seek = still >= 0
        place[seek], metres[seek] = tree.nearest(lat[seek], long[seek], still[seek])
        out.append(_answers(batch.column("site"), tree.inside(lat, long, radius), ids.take(pa.array(place, mask=place < 0)), metres, None).select(columns))
    return pa.Table.from_batches(out)


def site_neighbours(spots: DataFrame, radius_m: float, reach_m: float, part_sites: int = PART_SITES) -> DataFrame:
    """``site, inside, distance, closest_site``: records within ``radius_m``, the site's own included, and for
    sites with one record the nearest other site within ``reach_m``.

    Exact. Distances are compared to the centimetre, equal ones go to the smallest id. A site asks another
    part only if one of that part's boxes is within the radius, or nearer than what it found in its own.
    """
    placed = in_parts(spots.select("site", "lat", "long", "n"), part_sites)
    kind = placed.schema["site"].dataType.simpleString()
    corners = [f"{side}{k}" for side in ("low", "high") for k in range(3)]
    # At most MOST_PARTS x PART_BOXES boxes, 15 MB, however many sites.
    found = placed.mapInArrow(_boxed, "part int, " + ", ".join(f"{x} double" for x in corners)).toArrow()
    sides = np.stack([found.column(x).to_numpy() for x in corners], axis=1)
    boxes = Boxes(found.column("part").to_numpy(), sides[:, :3], sides[:, 3:])
    answer = f"site {kind}, inside long, distance double, closest_site {kind}"
    own = partial(_within_part, boxes=boxes, radius=radius_m, reach=reach_m)
    told = cut_lineage(placed.mapInArrow(own, f"target int, site {kind}, lat double, long double, inside long, distance double, closest_site {kind}"))
    asked = told.filter(F.col("target").isNotNull()).select(F.col("target").alias("part"), "site", "lat", "long", "distance")
    wanted = placed.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(asked.select("part").distinct()), "part", "left_semi")
    others = asked.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(partial(_answered, radius=radius_m), answer)
    first = told.filter(F.col("target").isNull()).select("site", "inside", "distance", "closest_site")
    best = F.min(F.when(F.col("closest_site").isNotNull(), F.struct("distance", "closest_site")))
    both = first.unionByName(others).groupBy("site").agg(F.sum("inside").alias("inside"), best.alias("best"))
    return both.select("site", "inside", "best.distance", "best.closest_site")


# -- the operator --------------------------------------------------------------------------


def neighbours(
    records: DataFrame, radius_m: float = 1000.0, reach_m: float = 65536.0, min_neighbours: int = c.MIN_NEIGHBOURS
) -> DataFrame:
    """Per record: neighbours within the radius, the nearest other record, and whether it is isolated.

    A record is isolated with fewer than ``min_neighbours`` neighbours, or without usable
    coordinates (its count is then null). ``closest_*`` are null when nothing lies within
    ``reach_m``.
    """
    point, spots = sites(records)
    spots = cut_lineage(spots)
    found = cut_lineage(site_neighbours(spots, radius_m, reach_m))
    names = spots.select(F.col("site").alias("closest_site"), F.col("first.city").alias("closest_city"))
    told = spots.join(lookup_join(found, names, "closest_site"), "site", "left")
    own = F.col("first.id") == F.col("id")
    crowded = F.col("n") > 1
    # A coordinate pair may hold a large share of the records.
    per_record = lookup_join(point, told, ["lat", "long"], "inner").select(
        "id",
        (F.coalesce("inside", "n") - 1).alias("neighbors_count"),
        F.when(crowded & own, F.col("second.city")).when(crowded, F.col("first.city")).otherwise(F.col("closest_city")).alias("closest_city__cmd"),
        F.when(crowded, F.lit(0.0)).otherwise(F.col("distance")).alias("closest_distance_m"),
        F.when(crowded & own, F.col("second.id")).when(crowded, F.col("first.id")).otherwise(F.col("closest_site")).alias("closest_id__cmd"),
    )
    placed = per_record.withColumnRenamed("id", c.ID)
    unplaced = records.filter(~F.coalesce(is_valid_point(c.LAT, c.LONG), F.lit(False)))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema.fields if f.name != c.ID]
    joined = placed.unionByName(unplaced.select(c.ID, *nulls))
    isolated = F.coalesce(F.col("neighbors_count") < min_neighbours, F.lit(True))
    return joined.select(c.ID, isolated.alias("is_isolated"), "neighbors_count", "closest_city__cmd", "closest_distance_m", "closest_id__cmd")


def with_neighbours(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Join neighbour statistics to the scores and drop the helper features."""
    from rowguard.functions.predicates import drop_prefixed

    return drop_prefixed(scores.join(stats, c.ID, "left"), "st_attr").withColumn("is_isolated", F.coalesce("is_isolated", F.lit(True)))
