import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rowguard.functions.text import composite, jaro_winkler
from rowguard.operators import components, matching, proposals
from rowguard.operators.joins import salted_join
from rowguard.session import cut_lineage

THRESHOLD = 92


def norm(s):
    return re.sub(r"[\W_]", " ", s.lower()).strip()


def best_by_brute_force(values, threshold):
    """All pairs; pairs of very different length are left out, as their score has a ceiling of 90 (tested below)."""
    found = {}
    keys = {v: norm(v) for v in values}
    for a in values:
        n = len(keys[a])
        near = [b for b in values if b != a and keys[b] and 1.5 * min(n, len(keys[b])) > max(n, len(keys[b]))]
        rated = [(-composite(keys[a], keys[b]), b) for b in near]
        rated = [r for r in rated if -r[0] >= threshold]
        if rated:
            score, name = min(rated)
            found[a] = (name, -score)
    return found


def noisy(rng, word):
    chars = list(word)
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(chars) + 1)
        action = rng.random()
        if action < 0.4 and len(chars) > 2:
            chars.pop(min(at, len(chars) - 1))
        elif action < 0.8:
            chars.insert(at, rng.choice("abcdefghijklmno "))
        else:
            chars[min(at, len(chars) - 1)] = rng.choice("abcdeé")
    return "".join(chars)


def dictionary(seed):
    rng = random.Random(seed)
    words = ["san", "giovanni", "rotondo", "santa", "maria", "new", "york", "sur", "mer", "stadt", "ober", "unter", "bad", "river"]
    values = set()
    for _ in range(60):
        name = " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
        values.add(name)
        for _ in range(3):
            values.add(noisy(rng, name))
        parts = name.split()
        rng.shuffle(parts)
        values.add(" ".join(parts).upper())
        values.add(noisy(rng, " ".join(parts)))
        values.add(name.replace(" ", "-"))
        values.add(name + " " + rng.choice("abc"))
    values |= {f"store number {i:05d}" for i in range(60)} | {"", "?", "a", "ab"}
    return sorted(values)


@pytest.mark.parametrize("seed,threshold", [(1, 92), (2, 96), (3, 91)])
def test_best_match_equals_all_pairs(spark, seed, threshold):
    values = dictionary(seed)
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "city__cmd string")
    got = {r["value"]: (r["matched"], r["similarity_score_fuzzy"]) for r in matching.best_matches(frame, "city__cmd", threshold).collect()}
    want = best_by_brute_force(values, threshold)
    differing = {v: (got.get(v), want.get(v)) for v in set(got) | set(want) if got.get(v) != want.get(v)}
    assert not differing


def test_pairs_of_very_different_length_never_pass_the_ceiling():
    rng = random.Random(9)
    values = rng.sample(dictionary(1), 60)
    far = [(a, b) for a in map(norm, values) for b in map(norm, values) if a and b and len(a) >= 1.5 * len(b)]
    assert len(far) > 300
    assert max(composite(a, b) for a, b in far) == 90.0


@pytest.mark.parametrize("threshold", [55, 78, 80, 85, 86, 90])
def test_best_match_within_reach_of_substrings_equals_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    values = rng.sample(sorted(v for v in dictionary(3) if norm(v)), 70) + ["york", "yrk", "new", "ob", "rotond river", "sur mer river ober unter stadt bad new york", "x"]
    keys = {v: norm(v) for v in values}
    want = {}
    for a in set(values):
        rated = [(-composite(keys[a], keys[b]), b) for b in set(values) if b != a]
        rated = [r for r in rated if -r[0] >= threshold]
        if rated:
            want[a] = (min(rated)[1], -min(rated)[0])
    frame = spark.createDataFrame([(v,) for v in values], "city__cmd string")
    got = {r["value"]: (r["matched"], r["similarity_score_fuzzy"]) for r in matching.best_matches(frame, threshold=threshold).collect()}
    assert got == want


def test_no_pairs_and_null_category(spark):
    frame = spark.createDataFrame([("oslo",), ("lima",), ("quito",)], "city__cmd string")
    assert matching.match_pairs(frame).count() == 0
    empty = spark.createDataFrame([(None,)], "city__cmd string")
    assert matching.match_pairs(empty).count() == 0
    assert matching.edit_neighbours(empty, "city__cmd").count() == 0


@pytest.mark.parametrize("distance", [1, 2])
def test_edit_neighbours_equal_all_pairs(spark, distance):
    values = [v for v in dictionary(5) if len(v) < 20][:150]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = {(r["left"], r["right"]) for r in matching.edit_neighbours(frame, "v", distance).collect()}
    pairs = spark.createDataFrame([(a, b) for a in values for b in values if a < b], "a string, b string")
    want = {(r["a"], r["b"]) for r in pairs.filter(F.levenshtein("a", "b") <= distance).collect()}
    assert got == want


def test_long_values_meet_on_segments(spark):
    rng = random.Random(4)
    values = set()
    for size in (22, 24, 25, 27, 60, 1000):
        base = "".join(rng.choice("abcdef ") for _ in range(size))
        values |= {base, base[1:], base[:-2], base[: size // 2] + "x" + base[size // 2 :], base[:3] + base[5:] + "zz", "q" + base[1:-1] + "q"}
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = {(r["left"], r["right"], r["distance"]) for r in matching.edit_neighbours(frame, "v", 2).collect()}
    from tests.test_places import plain_distance

    ordered = sorted(values)
    near = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if abs(len(a) - len(b)) <= 2]
    assert got == {(a, b, d) for a, b in near if (d := plain_distance(a, b)) <= 2}


def test_fuzzy_join_equals_all_pairs(spark):
    left = ["New York", "san giovanni rotondo", "Oslo", "new-york", "santa maria"]
    right = ["new york", "san giovani rotondo", "maria santa", "lima"]
    a = spark.createDataFrame([(i, v, v) for i, v in enumerate(left)], "id int, city string, other string")
    b = spark.createDataFrame([(i, v) for i, v in enumerate(right)], "rid int, name string")
    got = sorted((r["city"], r["name"]) for r in matching.fuzzy_join(a, b, {"city": ["name"], "other": ["name"]}, 92).collect())
    want = sorted((x, y) for x in left for y in right if composite(norm(x), norm(y)) >= 92)
    assert got == want
    with pytest.raises(ValueError):
        matching.fuzzy_join(a, b, {}, 92)


def test_row_pairs_of_overlapping_column_pairs_come_once(spark):
    rng = random.Random(11)
    names = sorted(v for v in dictionary(6) if norm(v))[:60]
    left = [(i, rng.choice([*names, None]), rng.choice([*names, None])) for i in range(60)]
    right = [(i, rng.choice([*names, None]), rng.choice(names)) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, city string, other string"), spark.createDataFrame(right, "rid int, name string, alias string")
    joined = matching.fuzzy_join(a, b, {"city": ["name", "alias"], "other": ["alias"]}, 92)
    got = sorted((r["id"], r["rid"]) for r in joined.collect())
    score = lambda x, y: composite(norm(x), norm(y)) if x and y else 0.0
    ways = [[score(x[1], y[1]) >= 92, score(x[1], y[2]) >= 92, score(x[2], y[2]) >= 92] for x in left for y in right]
    want = sorted((x[0], y[0]) for (x, y), hit in zip([(x, y) for x in left for y in right], ways) if any(hit))
    assert got == want and sum(sum(hit) > 1 for hit in ways) > 3
    assert "ArrowEvalPython" not in joined._jdf.queryExecution().executedPlan().toString()


def test_shared_words_first_and_own_words_after():
    assert composite("giovanni rotondo santa", "santo giovanni rotondo") == 90.0
    assert composite("alpha beta gamma", "zeta alpha beta") == composite("zeta alpha beta", "alpha beta gamma")


def test_scores_of_known_strings():
    assert composite("new york", "new yrk") == 93.0
    assert composite("new york", "york new") == 95.0
    assert composite("", "x") == 0.0 and composite(None, "x") == 0.0
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler(None, "a") is None and jaro_winkler("", "") == 1.0


def test_components_of_chains_and_random_graphs(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "f"), ("x", "x")]
    frame = spark.createDataFrame(edges, "left string, right string")
    got = {r["value"]: r["component"] for r in components.components(frame).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}
    rng = random.Random(3)
    nodes = [f"n{i:03d}" for i in range(200)]
    # A hub next to a long path: the shapes that need the most rounds and the most partners.
    pairs = [("n000", n) for n in nodes[1:60]] + list(zip(nodes[60:140], nodes[61:141])) + [tuple(rng.sample(nodes[141:], 2)) for _ in range(40)]
    head = {n: n for n in nodes}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        head[y] = x
    touched = {n for p in pairs for n in p}
    want = {n: find(n) for n in touched}
    frame = spark.createDataFrame(pairs, "left string, right string").repartition(7)
    got = {r["value"]: r["component"] for r in components.components(frame).collect()}
    assert got == want
    none = spark.createDataFrame([], "left string, right string")
    assert components.numbered_components(none).count() == 0


def test_tasks_contract_their_edges_before_the_rounds(spark, monkeypatch):
    """A long chain: fewer rounds and fewer edges to begin with, the same components, whatever a task may hold."""
    order = list(range(60))
    random.Random(5).shuffle(order)
    links = list(zip(order, order[1:])) + [(1000 + k, 1000) for k in range(1, 30)] + [(2001, 2000), (2001, 2001), (2001, None)]
    want = {**dict.fromkeys(order, 0), **dict.fromkeys(range(1000, 1030), 1000), 2000: 2000, 2001: 2000}
    frame = spark.createDataFrame(links, "left long, right long").repartition(5)
    rounds, sizes = [], []
    star, cut = components._small_star, components.cut_lineage

    def watched(df):
        out = cut(df)
        sizes[-1].append(out.count())
        return out

    monkeypatch.setattr(components, "_small_star", lambda *args: rounds.append(len(sizes)) or star(*args))
    monkeypatch.setattr(components, "cut_lineage", watched)
    contracted = components._contracted
    for piece, way in ((1 << 20, contracted), (16, contracted), (1 << 20, lambda df: df)):
        monkeypatch.setattr(components, "PIECE_EDGES", piece)
        monkeypatch.setattr(components, "_contracted", way)
        sizes.append([])
        assert {r["value"]: r["component"] for r in components.components(frame).collect()} == want
    taken = [rounds.count(k) for k in (1, 2, 3)]
    assert taken[0] == 1 and taken[0] <= taken[1] <= taken[2] and taken[0] < taken[2]
    assert sizes[0][0] == 59 + 29 + 1 and sum(sizes[0]) < sum(sizes[2])


def test_forest_links_to_the_smallest():
    import pyarrow as pa

    a, b = components.forest(pa.array(["d", "é", "b", "z"]), pa.array(["c", "z", "d", "é"]))
    assert dict(zip(a.to_pylist(), b.to_pylist())) == {"c": "b", "d": "b", "é": "z"}
    assert [len(x) for x in components.forest(pa.array([], pa.int64()), pa.array([], pa.int64()))] == [0, 0]


def test_ties_and_unreadable_winners_are_left_to_a_person(spark):
    records = [("aa",), ("ab",)] + [("b?",)] * 3 + [("bb",)] + [("cc",)] * 2 + [("cd",)]
    records = spark.createDataFrame([(i, v[0]) for i, v in enumerate(records)], "id__cmd int, city__cmd string")
    members = spark.createDataFrame([("aa", 0), ("ab", 0), ("b?", 1), ("bb", 1), ("cc", 2), ("cd", 2)], "value string, cluster int")
    stacked = proposals.propose(proposals.stack(members, records))
    got = {r["city__cmd"]: r["proposed_city"] for r in stacked.collect()}
    manual = "to be manually selected"
    assert got == {"aa": manual, "ab": manual, "b?": manual, "bb": manual, "cc": "cc", "cd": "cc"}
    changes = {r["city__cmd"]: r["apply_changes"] for r in proposals.details(records, stacked).collect()}
    assert changes == {"aa": None, "ab": None, "b?": None, "bb": None, "cc": 0, "cd": 1}
    named = {r["city__cmd"]: r["standardized_city"] for r in proposals.standardise(records, stacked).collect()}
    assert named == {"aa": "aa *", "ab": "aa *", "b?": "b? *", "bb": "b? *", "cc": "cc", "cd": "cc"}


def test_exploded_signatures_are_never_broadcast(spark):
    names = spark.createDataFrame([(f"Customer#{i:09d}" + "x" * (i % 2 * 12),) for i in range(40)], "name string")
    plan = matching.edit_neighbours(names, "name", 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [mark#" in plan and "SortMergeJoin [n#" in plan
    assert "BroadcastHashJoin [mark#" not in plan and "BroadcastHashJoin [n#" not in plan


def test_salted_joins_shuffle_both_sides(spark):
    edges = spark.createDataFrame([(f"n{i}", "n0") for i in range(1, 30)], "a string, b string")
    least = edges.select("a", F.col("b").alias("m"))
    joined = salted_join(edges, least, ["a"], "inner")
    assert "SortMergeJoin [a#" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 29


def test_joins_of_the_rounds_broadcast_no_table_of_nodes(spark):
    edges, least = spark.createDataFrame([("b", "a")], "a string, b string"), spark.createDataFrame([("b", "a")], "a string, m string")
    plan = components._by_node(edges, least, False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_what_a_written_step_shuffled_is_removed(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    before, held = shuffled(), []
    for k in range(3):
        held.append(spark.range(1000).groupBy(F.col("id") % (k + 7)).count())
        held.append(cut_lineage(held[-1]))
    deadline = time.time() + 20
    while shuffled() > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffled() <= before
    assert [held[i].count() for i in (1, 3, 5)] == [7, 8, 9]
