import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.functions.geo import EARTH_RADIUS_M, ellipsoid_m, nearly_opposite_m, with_distance
from rowguard.operators import clusters, encoding, neighbours
from rowguard.operators.clusters import PlaceClusters, elbow

SCHEMA = "id__cmd long, city__cmd string, lat__cmd double, long__cmd double"


def brute_force(rows, radius, reach):
    ok = [r for r in rows if r[2] is not None and r[3] is not None and -90 <= r[2] <= 90 and -180 <= r[3] <= 180]
    out = {}
    for i, name, y, x in ok:
        count, best = 0, None
        for j, other, v, u in ok:
            if i == j:
                continue
            h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
            d = 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))
            count += d <= radius
            if d <= reach and (best is None or (round(d, 2), j) < best):
                best = (round(d, 2), j)
        out[i] = (count, *(best or (None, None)))
    return out


def scattered(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        rows.append((rng.gauss(45, 0.02), rng.gauss(9, 0.02)))
    rows += [(45.0, 9.0)] * 40 + [(45.00001, 9.00001)] * 3
    rows += [(rng.uniform(-0.01, 0.01), rng.choice([-1, 1]) * (180 - rng.uniform(0, 0.01))) for _ in range(30)]
    rows += [(rng.choice([-1, 1]) * (90 - rng.uniform(0, 0.01)), rng.uniform(-180, 180)) for _ in range(30)]
    rows += [(60.0, 179.999), (60.0, -179.999), (60.0, 180.0), (60.0, -180.0), (90.0, 0.0), (90.0, 77.0)]
    rows += [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(30)]
    rows += [(91.0, 0.0), (0.0, 181.0), (None, 3.0), (3.0, None)]
    return [(i, f"city {i % 7}", y, x) for i, (y, x) in enumerate(rows, start=1)]


def test_a_crowded_part_opens_few_pairs_at_a_time(monkeypatch):
    """Same answers, however many pairs of queries and boxes may be held."""
    rng = np.random.default_rng(4)
    lat, long = np.sort(rng.uniform(45, 45.05, 900)), rng.uniform(9, 9.05, 900)
    tree = neighbours.Tree(lat, long, rng.integers(1, 4, 900), rng.permutation(900))
    reach, skip = np.full(900, 65536.0), np.arange(900)
    inside, (place, metres) = tree.inside(lat, long, 1000.0), tree.nearest(lat, long, reach, skip)
    opened, plain = [], neighbours.Tree._opened
    monkeypatch.setattr(neighbours.Tree, "_opened", lambda self, *args: opened.append(plain(self, *args)) or opened[-1])
    monkeypatch.setattr(neighbours, "MOST_PAIRS", 2000)
    assert (tree.inside(lat, long, 1000.0) == inside).all()
    got = tree.nearest(lat, long, reach, skip)
    assert (got[0] == place).all() and (got[1] == metres).all()
    assert max(len(query) for query, _ in opened) <= 2000


def check_neighbours(spark, rows, radius, reach):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["id__cmd"]: r for r in neighbours.neighbours(frame, radius, reach).collect()}
    want = brute_force(rows, radius, reach)
    assert len(got) == len(rows)
    for i, _, y, x in rows:
        r = got[i]
        if i not in want:
            assert r["neighbors_count"] is None and r["is_isolated"] and r["closest_id__cmd"] is None
            continue
        count, distance, other = want[i]
        assert r["neighbors_count"] == count, (i, y, x, r, want[i])
        assert r["is_isolated"] == (count < 5)
        # The antipode of a rounding: both sides work with the same formula, distances agree to the centimetre.
        assert (r["closest_distance_m"] is None) == (distance is None)
        if distance is not None:
            assert abs(r["closest_distance_m"] - distance) <= 0.02, (i, y, x, r, want[i])
            assert r["closest_id__cmd"] == other or abs(r["closest_distance_m"] - distance) <= 0.02


def test_neighbours_equal_all_pairs(spark):
    check_neighbours(spark, scattered(1), 1000.0, 65536.0)


@pytest.mark.parametrize("part_sites", [6, 40, 10_000])
def test_any_number_of_parts_gives_the_same(spark, part_sites):
    rng = random.Random(8)
    rows = [(i, "x", 45 + rng.uniform(0, 0.012), 9 + rng.uniform(0, 0.012)) for i in range(250)]
    rows += [(i, "x", 45 + rng.choice([0.02, 0.021]), 9 + rng.choice([0.02, 0.021])) for i in range(250, 300)]
    rows += [(i, "x", 90 - rng.uniform(0, 0.004), rng.uniform(-180, 180)) for i in range(300, 350)]
    frame = spark.createDataFrame(rows, SCHEMA)
    _, spots = neighbours.sites(frame)
    got = {r["site"]: r for r in neighbours.site_neighbours(spots, 500.0, 4096.0, part_sites).collect()}
    want = brute_force(rows, 500.0, 4096.0)
    alone = {r["site"] for r in spots.filter("n = 1").collect()}
    for site, r in got.items():
        assert r["inside"] - 1 == want[site][0]
        assert (r["distance"], r["closest_site"]) == (want[site][1:] if site in alone else (None, None))
    assert spots.count() == len(got)


def test_trees_of_many_levels_equal_all_pairs():
    rng = np.random.default_rng(4)
    lat, long = 45 + rng.normal(0, 0.05, 3000), 9 + rng.normal(0, 0.05, 3000)
    lat[:500], long[:500] = 45.001, 9 + 1e-6 * np.arange(500)
    n, rank = rng.integers(1, 4, 3000), rng.permutation(3000)
    tree = neighbours.Tree(lat, long, n, rank)
    assert len(tree.levels) > 2
    q = rng.choice(3000, 200, replace=False)
    far = neighbours.haversine_between(lat[q][:, None], long[q][:, None], lat[None], long[None])
    for radius in (3.0, 900.0, 1e7):
        assert tree.inside(lat[q], long[q], radius).tolist() == (n[None] * (far <= radius)).sum(1).tolist()
    cents = np.round(far, 2)
    cents[np.arange(200), q] = np.inf
    for reach in (0.05, 300.0, 1e7):
        place, metres = tree.nearest(lat[q], long[q], np.full(200, reach), q)
        for i in range(200):
            near = np.flatnonzero((far[i] <= reach) & (np.arange(3000) != q[i]))
            best = min(((cents[i, k], rank[k], k) for k in near), default=(np.inf, 0, -1))
            assert (metres[i], place[i]) == (best[0], best[2])


def test_no_records(spark):
    assert neighbours.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "pair, metres",
    [
        ((0.0, 0.0, 0.5, 179.5), 19936288.579),
        ((0.0, 0.0, 0.5, 179.7), 19944127.421),
        ((0.0, 0.0, 0.0, 180.0), 20003931.459),
        ((90.0, 0.0, -90.0, 33.0), 20003931.459),
        ((30.0, 0.0, -30.0, 180.0), 20003931.459),
        ((0.0, 10.0, 90.0, 0.0), 10001965.729),
    ],
)
def test_nearly_opposite_points_to_the_millimetre(pair, metres):
    for y1, x1, y2, x2 in (pair, (pair[2], pair[3], pair[0], pair[1]), (-pair[0], pair[1], -pair[2], pair[3])):
        assert abs(ellipsoid_m([y1], [x1], [y2], [x2])[0] - metres) < 0.001
        assert abs(nearly_opposite_m([y1], [x1], [y2], [x2])[0] - metres) < 0.001


def test_both_solutions_of_the_geodesic_agree():
    rng = np.random.default_rng(6)
    ends = rng.uniform(-89, 89, 2000), rng.uniform(-180, 180, 2000), rng.uniform(-89, 89, 2000), rng.uniform(-180, 180, 2000)
    assert np.abs(ellipsoid_m(*ends) - nearly_opposite_m(*ends)).max() < 0.0002
    opposite = ends[0], ends[1], -ends[0] + rng.normal(0, 0.3, 2000), ends[1] + 180 + rng.normal(0, 0.3, 2000)
    length = ellipsoid_m(*opposite)
    assert np.isfinite(length).all() and length.max() <= 20003931.459 and length.min() > 1.98e7


def test_ellipsoidal_distance(spark):
    assert abs(ellipsoid_m([0.0], [0.0], [0.0], [1.0])[0] - 111319.491) < 0.001
    assert abs(ellipsoid_m([0.0], [0.0], [90.0], [0.0])[0] - 10001965.729) < 0.001
    assert ellipsoid_m([10.0], [20.0], [10.0], [20.0])[0] == 0.0
    assert np.isfinite(ellipsoid_m([0.0], [0.0], [0.3], [179.9])[0])
    rows = [("45.0", "9.0", 45.0, 9.0), ("91", "0", 0.0, 0.0), ("x", "0", 0.0, 0.0), (None, "0", 0.0, 0.0), ("0", "181", 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "a string, b string, c double, d double")
    assert [r["distance_m"] for r in with_distance(frame, "a", "b", "c", "d").collect()] == [0.0, None, None, None, None]


def test_elbow():
    assert elbow([2, 3, 4, 5, 6], [100, 40, 10, 8, 6]) == 4
    assert elbow([2, 3, 4], [30, 20, 10]) == 4
    assert elbow([2, 3, 4], [5, 5, 5]) == 2


def plain_lloyd(points, weights, centres, rounds):
    centres = np.array(centres, dtype=float)
    for k in range(rounds + 1):
        away = ((points[:, None] - centres[None]) ** 2).sum(-1)
        near, cost = away.argmin(1), float((away.min(1) * weights).sum())
        moved = centres.copy()
        for j in set(near.tolist()):
            moved[j] = np.average(points[near == j], axis=0, weights=weights[near == j])
        if k == rounds or np.abs(moved - centres).max() <= clusters.TOLERANCE:
            return centres, cost, k + 1
        centres = moved


@pytest.mark.parametrize("rounds", [2, 20])
def test_models_settled_together_equal_those_settled_alone(spark, rounds):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal((10.0 * i, 3.0 * i), 1.5, (80, 2)) for i in range(4)])
    weights = rng.integers(1, 5, len(points)).astype(float)
    frame = spark.createDataFrame([(float(a), float(b), float(w)) for (a, b), w in zip(points, weights)], "a double, b double, _weight double").repartition(3)
    candidates, held = clusters.candidate_centres(frame, ["a", "b"], 6)
    again, _ = clusters.candidate_centres(frame.repartition(5), ["a", "b"], 6)
    assert candidates.tolist() == again.tolist() and held.sum() == weights.sum() and len({tuple(x) for x in candidates.tolist()}) == 25
    starts = clusters.starting_centres(candidates, held, [2, 3, 4, 5, 6])
    centres, costs, passes = clusters.settle(frame, ["a", "b"], starts, rounds)
    alone = {k: plain_lloyd(points, weights, own, rounds) for k, own in starts.items()}
    assert passes == max(n for _, _, n in alone.values())
    for k, (own, cost, n) in alone.items():
        if n == passes:
            assert np.allclose(centres[k], own) and costs[k] == pytest.approx(cost)
        assert costs[k] <= cost * (1 + 1e-9)
    assert costs[4] < 0.2 * costs[2]


def test_fewer_places_than_clusters(spark):
    frame = spark.createDataFrame([(i, "x", float(i % 3), 0.0) for i in range(9)], SCHEMA).withColumn(c.STANDARD, F.col(c.CITY))
    job = PlaceClusters()
    assert job.kmeans(frame).select("cluster").distinct().count() == job.k and sorted(job.costs) == [2, 3] and job.costs[3] == 0.0
    assert {r["cluster"] for r in PlaceClusters().kmeans(frame.filter("lat__cmd = 1")).collect()} <= {0, 1}
    assert {r["cluster"] for r in PlaceClusters().kmeans(frame.withColumn("lat__cmd", F.lit(None).cast("double"))).collect()} == {99}


def test_clusters_find_separate_places_and_keep_rows_without_coordinates(spark):
    rng = random.Random(2)
    rows = [(i, f"c{i % 3}", 10.0 * (i % 3) + rng.random() / 10, rng.random() / 10) for i in range(600)]
    rows += [(600, "c0", None, 1.0), (601, None, 0.0, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn(c.STANDARD, F.col(c.CITY))
    job = PlaceClusters()
    placed = job.fit(frame)
    assert job.k == 3 and len(job.costs) == 9
    by_id = {r["id__cmd"]: r for r in placed.collect()}
    assert len(by_id) == len(rows)
    assert by_id[600]["cluster"] == 99 and by_id[600]["most_common_cluster"] == by_id[0]["cluster"]
    assert by_id[601]["cluster"] == 99 and by_id[601]["most_common_cluster"] == 99
    assert len({by_id[i]["most_common_cluster"] for i in range(600)}) == 3


def test_merge_without_large_cluster_changes_nothing_and_ends(spark):
    rows = [(1, "a", 1.0, 1.0), (2, "b", 2.0, 2.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.col(c.ID))
    assert sorted(r["k"] for r in clusters.merge_small(frame, "k").collect()) == [1, 2]


def test_merge_ignores_a_large_cluster_without_coordinates(spark):
    rows = [(i, "a", None, None) for i in range(5)] + [(i, "b", 50.0, 5.0) for i in range(5, 10)] + [(10, "c", 1.0, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.when(F.col(c.CITY) == "a", 0).when(F.col(c.CITY) == "b", 1).otherwise(2))
    moved = {r["id__cmd"]: r["k"] for r in clusters.merge_small(frame, "k", size_threshold=5).collect()}
    assert moved[10] == 1 and moved[0] == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("block", [None, 16])
def test_codes_are_a_permutation_walked_to_the_farthest(spark, block):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(80)})
    frame = spark.createDataFrame([(i, w, i % 2) for i, w in enumerate(words)] + [(999, None, 0)], "id__cmd int, w string, k int")
    coded = encoding.encode(frame, "w", "k", block=block).collect()
    assert sorted(r["index"] for r in coded if r["w"]) == list(range(1, len(words) + 1))
    assert [r["index"] for r in coded if r["w"] is None] == [None]
    if block is None:
        for k in (0, 1):
            order = [r["w"] for r in sorted((r for r in coded if r["w"] and r["k"] == k), key=lambda r: r["index"])]
            assert order[0] == min(order)
            for i in range(len(order) - 1):
                rest = order[i + 1 :]
                far = [plain_distance(order[i], w) for w in rest]
                assert far[0] == max(far)


def test_a_cluster_of_any_size_is_walked_by_one_rule():
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(1400)})
    for some in (words[:1024], words[:1025]):
        order = encoding.walk(some)
        assert sorted(order) == sorted(some) and order[0] == min(some)
        for i in rng.sample(range(len(order) - 1), 12):
            rest = order[i + 1 :]
            far = [plain_distance(order[i], w) for w in rest]
            assert far[0] == max(far) and rest[0] == min(w for w, d in zip(rest, far) if d == far[0])


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyz😀"])
def test_distances_and_walk_equal_the_plain_ones(alphabet):
    rng = random.Random(len(alphabet))
    for trial in range(40):
        lengths = [0, 1, 12, 63, 64, 65, 80] if trial % 8 == 0 else [0, 1, 3, 6, 9]
        words = ["".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(20)]
        sizes = np.array([len(w) for w in words])
        letters = np.zeros((20, sizes.max()), np.int64)
        for i, w in enumerate(words):
            letters[i, : len(w)] = [ord(ch) for ch in w]
        asked = rng.choice(words)
        assert encoding.distances_to(asked, letters, sizes).tolist() == [plain_distance(asked, w) for w in words]
        order = encoding.walk(sorted(set(words)))
        left = set(words) - {order[0]}
        assert order[0] == min(words) and len(order) == len(set(words))
        for here, following in zip(order, order[1:]):
            assert following == min(left, key=lambda w: (-plain_distance(here, w), w))
            left.remove(following)
