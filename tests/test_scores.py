import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.operators import feedback, flags, joins, metrics, ranking, relations
from rowguard.operators.isolation_forest import IsolationForest, prepare
from rowguard.plans import scoring
from rowguard.sources import tables


def points(spark, n=3000, outliers=20, parts=4):
    rng = np.random.default_rng(1)
    inner = rng.normal(0, 1, (n, 2))
    outer = rng.uniform(8, 12, (outliers, 2)) * rng.choice([-1, 1], (outliers, 2))
    rows = [(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(np.vstack([inner, outer]))]
    rows.append((len(rows), None, 0.0, 0))
    return spark.createDataFrame(rows, "id__cmd long, a double, b double, k int").repartition(parts)


def test_outliers_score_lowest_whatever_the_partitions(spark):
    model = IsolationForest(["a", "b"], "s")
    first = {r["id__cmd"]: r["s"] for r in model.fit_transform(points(spark)).collect()}
    again = {r["id__cmd"]: r["s"] for r in model.fit_transform(points(spark, parts=9)).collect()}
    assert first == again
    assert first.pop(3020) is None
    assert all(-1 <= s < 0 for s in first.values())
    cut = np.quantile(list(first.values()), 0.1)
    assert all(first[i] < cut for i in range(3000, 3020))
    assert np.median(list(first.values())) > -0.55


def test_groups_score_alike_broadcast_or_joined(spark):
    frame = points(spark)
    few = IsolationForest(["a", "b"], "s", "k", n_trees=10).fit_transform(frame)
    many = IsolationForest(["a", "b"], "s", "k", n_trees=10, broadcast_groups=1).fit_transform(frame)
    assert sorted(map(tuple, few.select("id__cmd", "s").collect())) == sorted(map(tuple, many.select("id__cmd", "s").collect()))


def test_constant_and_single_rows_score_a_half(spark):
    rows = [(i, 1.0, 2.0, 0) for i in range(300)] + [(300, 5.0, 6.0, 1)]
    frame = spark.createDataFrame(rows, "id__cmd long, a double, b double, k int")
    scores = {r["s"] for r in IsolationForest(["a", "b"], "s", "k", n_trees=5).fit_transform(frame).collect()}
    assert scores == {-0.5}


def test_no_rows_to_fit(spark):
    frame = spark.createDataFrame([(1, None, 1.0, 0)], "id__cmd long, a double, b double, k int")
    assert [r["s"] for r in IsolationForest(["a", "b"], "s", "k").fit_transform(frame).collect()] == [None]


def test_prepare_fills_codes_and_falls_back_to_the_own_cluster(spark):
    frame = spark.createDataFrame([(1, 5, 7, 3), (2, 6, 8, None)], "id__cmd int, cluster int, most_common_cluster int, index int")
    got = {r["id__cmd"]: (r["most_common_cluster"], r["index"]) for r in prepare(frame).collect()}
    assert got == {1: (7, 3), 2: (6, 4)}


def test_order_statistics_and_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 500), np.full(400, 0.25), rng.normal(0, 1e6, 100), [1e-300, -0.0]])
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    ordered = np.sort(values)
    ranks = [0, 1, 250, 500, 700, len(values) - 1]
    assert ranking.order_statistics(frame, "v", ranks) == [ordered[r] for r in ranks]
    got = ranking.quantiles(frame, "v", [0.25, 0.5, 0.75], interpolate=True)
    assert np.allclose(got, np.quantile(values, [0.25, 0.5, 0.75]))
    assert ranking.quantiles(frame.filter("v is null"), "v", [0.5]) == [None]
    with pytest.raises(ValueError):
        ranking.order_statistics(frame, "v", [10**6])
    wide = [float("-inf"), -1.7e308, 0.0, 5e-324, 1e-323, 1.7e308, float("inf")]
    extreme = spark.createDataFrame([(v,) for v in wide], "v double")
    assert ranking.order_statistics(extreme, "v", list(range(7))) == wide
    tiny = spark.createDataFrame([(0.0,), (5e-324,), (1e-323,)], "v double")
    assert ranking.order_statistics(tiny, "v", [0, 1, 2]) == [0.0, 5e-324, 1e-323]


def counted_passes(monkeypatch):
    passes = []
    whole = ranking._counted
    monkeypatch.setattr(ranking, "_counted", lambda values, brackets: passes.append(brackets) or whole(values, brackets))
    return passes


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_quantiles_take_one_exact_pass(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranking, "ACCURACY", accuracy)
    passes = counted_passes(monkeypatch)
    rng = np.random.default_rng(accuracy)
    data = [rng.normal(size=3000), np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 50, 3000).astype(float)), np.full(3000, 2.5)]
    frame = spark.createDataFrame([tuple(map(float, row)) for row in zip(*data)], "a double, b double, c double").repartition(4)
    probs = [k / 32 for k in range(1, 32)]
    for interpolate in (False, True):
        got = ranking.several_quantiles(frame, [F.col(x) for x in "abc"], [probs] * 3, interpolate)
        want = [np.quantile(v, probs, method="linear" if interpolate else "inverted_cdf") for v in data]
        assert np.allclose(got, want, rtol=1e-12)
    assert len(passes) == 2


def test_a_sketch_that_is_off_costs_a_pass_and_no_value(spark, monkeypatch):
    passes = counted_passes(monkeypatch)
    frame = spark.createDataFrame([(float(i),) for i in range(900)], "v double")
    wrong = [ranking._Known(0.0, 899.0, 900, [(3.0, 5.0), (400.0, 400.0)])]
    values = ranking._requested(frame, [F.col("v")])
    assert ranking._at_ranks(values, wrong, {0: [0, 4, 300, 400, 401, 899]}) == {0: [0.0, 4.0, 300.0, 400.0, 401.0, 899.0]}
    assert len(passes) == 2


def test_a_value_finds_its_bin_by_halving(spark):
    cuts = [1.0, 2.0, 2.0, 5.0]
    frame = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 6.0)], "v double")
    both = frame.select(ranking.steps_below(F.col("v"), cuts).alias("a"), ranking.steps_below(F.col("v"), cuts, reached=True).alias("b")).collect()
    assert [r.a for r in both] == [0, 0, 1, 1, 3, 3, 4] and [r.b for r in both] == [0, 1, 1, 3, 3, 4, 4]


def test_dense_index_numbers_in_order(spark):
    frame = spark.createDataFrame([(f"{(i * 7919) % 1000:04d}",) for i in range(1000)], "v string").repartition(6)
    rows = ranking.dense_index(frame, ["v"]).collect()
    assert [r["idx"] for r in sorted(rows, key=lambda r: r["v"])] == list(range(1000))


def test_ties_at_the_last_rank_are_all_flagged_and_nulls_never(spark):
    frame = spark.createDataFrame([(1, -0.9), (2, -0.8), (3, -0.8), (4, -0.8), (5, -0.1), (6, None)], "id int, s double")
    flagged = frame.select("id", ranking.within_top_k(frame, "s", 2).alias("f"))
    assert {r["id"] for r in flagged.collect() if r["f"]} == {1, 2, 3, 4}
    assert [r["f"] for r in frame.select(ranking.within_top_k(frame.filter("id > 6"), "s", 2).alias("f")).collect()] == [False] * 6


def test_top_k_beyond_the_take_limit_gives_the_same_cut(spark, monkeypatch):
    frame = spark.range(1000).select((F.col("id") % 97).cast("double").alias("s"))
    few = frame.filter(ranking.within_top_k(frame, "s", 300)).count()
    monkeypatch.setattr(ranking, "TAKE_LIMIT", 10)
    assert frame.filter(ranking.within_top_k(frame, "s", 300)).count() == few


def test_top_k_counts_nan_as_no_value_on_both_sides_of_the_take_limit(spark, monkeypatch):
    values = [float(i) for i in range(10)] + [float("nan")] * 3 + [None] * 2
    frame = spark.createDataFrame(list(enumerate(values)), "id int, s double")
    for limit in (10_000, 3):
        monkeypatch.setattr(ranking, "TAKE_LIMIT", limit)
        for k in (2, 4, 12, 100):
            assert frame.filter(ranking.within_top_k(frame, "s", k)).count() == min(k, 10)


def test_several_quantiles_are_those_of_each_column(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(700, 2)).round(2)
    frame = spark.createDataFrame([(float(a), float(b) if i % 5 else None) for i, (a, b) in enumerate(data)], "a double, b double").withColumn("n", F.lit(None).cast("double"))
    probs = [0.0, 0.05, 0.5, 0.93, 1.0]
    got = ranking.several_quantiles(frame, [F.col("a"), F.col("b"), F.col("n")], [probs] * 3, interpolate=True)
    kept = data[[i % 5 != 0 for i in range(700)], 1]
    assert np.allclose(got[0], np.quantile(data[:, 0], probs)) and np.allclose(got[1], np.quantile(kept, probs)) and got[2] == [None] * 5


def test_a_forest_scores_other_tables_as_its_own(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(rng.normal()), float(rng.normal()), f"g{i % 3}") for i in range(900)]
    frame = spark.createDataFrame(rows, "id__cmd int, a double, b double, k string")
    for limit in (64, 0):
        model = IsolationForest(["a", "b"], "s", "k", n_trees=8, broadcast_groups=limit)
        forest = model.fit(frame)
        whole = {r["id__cmd"]: r["s"] for r in model.transform(frame, forest).collect()}
        odd = spark.createDataFrame([(5000, 0.0, 0.0, "unknown"), (5001, float("inf"), 0.0, "g0"), (5002, None, 0.0, "g0"), (5003, float("nan"), 0.0, "g1")], frame.schema)
        batch = frame.filter("id__cmd < 20 and k <> 'g2'")
        got = model.transform(batch.unionByName(batch).unionByName(odd), forest).collect()
        assert len(got) == 2 * batch.count() + 4
        assert all(r["s"] is None if r["id__cmd"] >= 5000 else abs(r["s"] - whole[r["id__cmd"]]) < 1e-12 for r in got)
        if limit == 64:
            broadcast = whole
    assert all(abs(whole[i] - broadcast[i]) < 1e-12 for i in whole)


def test_counts_beyond_a_long_do_not_overflow(spark):
    frame = spark.createDataFrame([(4 * 10**9,), (3 * 10**9,), (1,)], "n long")
    assert relations._tied(frame, "n") == (sum(n * (n - 1) // 2 for n in (4 * 10**9, 3 * 10**9, 1)), 3)


def test_metrics_without_positives_or_rows(spark):
    frame = spark.createDataFrame([(False, -0.5)], "t boolean, s double")
    row = metrics.metrics(metrics.confusion(frame, F.col("t"), F.col("s") < -0.6)).first()
    assert (row["tp"], row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0.0, 0.0, 0.0, 1.0)
    empty = metrics.metrics(metrics.confusion(frame.filter("s > 0"), F.col("t"), F.col("s") < 0)).first()
    assert empty["accuracy"] == 0.0
    assert metrics.sweep(frame.filter("s > 0"), "s", "t").count() == 101


def test_a_score_equal_to_a_cut_is_not_below_it(spark):
    cuts = [-0.9 + i * 0.005 for i in range(101)]
    scores = cuts + [x - 1e-12 for x in cuts] + [-2.0, 0.0]
    frame = spark.createDataFrame([(x, i % 2 == 0) for i, x in enumerate(scores)], "s double, t boolean")
    rows = metrics.sweep(frame, "s", "t").orderBy("threshold").collect()
    assert [r["tp"] + r["fp"] for r in rows] == [sum(x < cut for x in scores) for cut in cuts]


def test_kendall_with_ties_equals_pair_counting(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b) if b < 9 else None) for a, b in zip(rng.integers(0, 40, 400), rng.integers(0, 10, 400))]
    frame = spark.createDataFrame(rows, "a int, b int")
    known = np.array([r for r in rows if r[1] is not None])
    dx, dy = (np.sign(known[:, i][:, None] - known[:, i][None, :]) for i in (0, 1))
    want = (dx * dy).sum() / np.sqrt(float((dx != 0).sum()) * float((dy != 0).sum()))
    assert abs(relations.kendall_pair(frame, "a", "b") - want) < 1e-12
    assert relations.kendall_pair(frame.withColumn("a", F.lit(1)), "a", "b") is None
    assert abs(relations.kendall_pair(frame, "a", "a") - 1) < 1e-12


def test_kendall_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(relations, "KENDALL_BLOCK", 7)
    rng = np.random.default_rng(4)
    x, y = rng.permutation(300), rng.permutation(300)
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "a int, b int")
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    assert abs(relations.kendall_pair(frame, "a", "b") - (dx * dy).sum() / (300 * 299)) < 1e-12


def test_mutual_information_of_equal_and_independent_columns(spark):
    frame = spark.range(1024).select((F.col("id") % 32).alias("a"), F.floor(F.col("id") / 32).alias("b"), (F.col("id") % 32 * 2).alias("c"))
    got = {(r["column_1"], r["column_2"]): r["nmi"] for r in relations.mutual_information(frame, ["a", "b", "c"]).collect()}
    assert abs(got[("a", "b")]) < 1e-9 and abs(got[("a", "c")] - 1) < 1e-9 and got[("b", "b")] == 1.0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    hot = [(i, "hot") for i in range(3000)] + [(i, None) for i in range(3000, 6000)] + [(i, f"k{i}") for i in range(6000, 6500)]
    records = spark.createDataFrame(hot, "id int, key string")
    entries = spark.createDataFrame([("hot", 1), ("unused", 2)] + [(f"k{i}", i) for i in range(6000, 6400)], "key string, v int")
    plain = sorted(map(str, records.join(entries, "key", how).select("id", "key", "v").collect()))
    for limit in (0, 10**6):
        joined = joins.lookup_join(records, entries, "key", how, broadcast_bytes=limit)
        assert sorted(map(str, joined.select("id", "key", "v").collect())) == plain
    assert {r["_hot_key"] for r in joins.hot_keys(records, ["key"]).collect()} == {"hot", None}


def test_flags_and_tags(spark):
    rows = [(1, "a", "b", -0.9, -0.1, -0.9, False), (2, "a", "b", -0.1, -0.1, -0.1, False), (3, "a", "a", -0.1, -0.1, -0.8, False), (4, "a", "a", -0.95, -0.1, -0.99, True), (5, "a", "a", -0.1, -0.1, -0.1, None)]
    frame = spark.createDataFrame(rows, "id__cmd int, city__cmd string, standardized_city string, S_Score_coordinates double, S_Score_city double, S_Score_city_cluster double, is_isolated boolean")
    tagged = {r["id__cmd"]: r["tag_anomalies"] for r in flags.tag(flags.flag_top_k(frame, 1, 3)).collect()}
    assert tagged == {1: c.TAG_SPELLING_AND_PLACE, 2: c.TAG_SPELLING, 3: c.TAG_PLACE, 4: c.TAG_OUTLIER, 5: None}


def test_classifier_learns_and_explains(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(s), 0.0, float(s), float(s), 3, int(s < -0.5) if i % 2 else None, int(s < -0.5)) for i, s in enumerate(rng.uniform(-0.9, -0.1, 400))]
    frame = spark.createDataFrame(rows, "id__cmd int, lat__cmd double, long__cmd double, S_Score_coordinates double, S_Score_city_cluster double, neighbors_count int, is_anomaly int, is_error int")
    parted = feedback.split(frame.withColumn("tag_anomalies", F.lit("x")))
    model = feedback.AnomalyClassifier().fit(parted)
    predicted = model.predict(parted)
    row = feedback.evaluate(predicted, part="test").first()
    assert row["f1"] > 0.95 and row["tp"] + row["tn"] + row["fp"] + row["fn"] == 200
    with pytest.raises(ValueError):
        feedback.evaluate(predicted, part="other")
    assert feedback.retag(predicted).filter("prediction = 0").count() == 0
    names = [r["feature"] for r in model.importance(frame).collect()]
    assert sorted(names) == sorted(c.FEATURES)
    curve = {r["feature_value"]: r["partial_dependence"] for r in model.partial_dependence(frame, "S_Score_coordinates", 20).collect()}
    assert len(curve) == 20 and curve[min(curve)] > curve[max(curve)]


def test_partial_dependence_equals_scoring_every_row_at_every_value(spark):
    rng = np.random.default_rng(3)
    names = ["a", "b", "d"]
    data = [(*map(float, rng.normal(size=2).round(2)), float(rng.integers(0, 4)) if i % 9 else None) for i in range(500)]
    frame = spark.createDataFrame([(*r, int(r[0] * r[1] > 0.2 or r[2] == 3)) for r in data], "a double, b double, d double, is_anomaly int")
    model = feedback.AnomalyClassifier(input_columns=names).fit(frame)
    for name, size in (("a", 17), ("d", 50)):
        curve = {r["feature_value"]: r["partial_dependence"] for r in model.partial_dependence(frame, name, size).collect()}
        grid = spark.createDataFrame([(g,) for g in curve], "g double")
        swept = model.predict(frame.drop(name).crossJoin(grid).withColumn(name, F.col("g")))
        want = dict(swept.groupBy("g").agg(F.avg(vector_to_array("probability")[1])).collect())
        assert len(curve) == (17 if name == "a" else 4) and curve == pytest.approx(want, abs=1e-12)


def test_tables_are_named_read_and_replaced_with_their_schema(spark, tmp_path):
    assert tables.table_name("cleansing", "GB", "bronze", "cat", "_V1", "_cmd", "dq_") == "cat.dq_bronze.tbl_cleansing_gb_v1_cmd"
    with pytest.raises(ValueError):
        tables.table_name("x", "gb", "tin")
    with pytest.raises(LookupError, match="tbl_missing"):
        tables.read_table(spark, "tbl_missing")
    path = str(tmp_path / "t")
    tables.overwrite_table(spark.range(3), "tbl_replace_test", path=path)
    tables.overwrite_table(spark.createDataFrame([("x", 1)], "a string, b int"), "tbl_replace_test", path=path, cluster_within=["b"])
    assert tables.read_table(spark, "tbl_replace_test").columns == ["a", "b"]
    assert tables.read_table(spark, "tbl_replace_test", ["b"]).collect()[0]["b"] == 1
    spark.sql("DROP TABLE tbl_replace_test")


def test_the_scores_of_a_row_share_a_python_worker(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(y), float(x), i % 5 + 1, i % 3) for i, (y, x) in enumerate(rng.normal(size=(60, 2)))]
    scored = scoring.scores(spark.createDataFrame([(*r, r[-1]) for r in rows], f"{c.ID} long, {c.LAT} double, {c.LONG} double, {c.CODE} int, {c.CLUSTER} int, {c.COMMON_CLUSTER} int"), n_trees=3)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "score(" in plan
    got = scored.collect()
    assert len(got) == 60 and all(-1 <= r[k] < 0 for r in got for k in (c.SCORE_COORDS, c.SCORE_CITY, c.SCORE_CITY_CLUSTER))
