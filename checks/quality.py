"""Checks of scoring models, neighbours, flags, tags and the review loop."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.fixtures import cmd, scored, with_cmd
from checks.registry import check
from checks.statistics import HAVERSINE, RATES, rates_sql, rounded
from checks.spelling import STANDARD
from rowguard import config as c
from rowguard.operators import clusters, encoding, feedback, flags, neighbours, proposals, truth
from rowguard.operators import isolation_forest as forest
from rowguard.plans import evaluation, flagging, scoring, standardisation
from rowguard.session import cut_lineage

RADIUS_M = 1000.0
REACH_M = 65536.0


# -- joins on ids and dictionaries ---------------------------------------------------------


@check("jn_neighbours", with_cmd("SELECT s.id__cmd, s.S_Score_city, n.is_isolated, n.neighbors_count FROM scored s LEFT JOIN scored n ON n.id__cmd = s.id__cmd"))
def jn_neighbours(spark, folder):
    base = scored(spark, folder)
    left = base.select(c.ID, c.SCORE_CITY, F.lit(0.0).alias("st_attr_0"))
    return neighbours.with_neighbours(left, base.select(c.ID, "is_isolated", "neighbors_count"))


@check("jn_truth", with_cmd("SELECT id__cmd, S_Score_city, swapped_geo OR shuffle_lat AS is_error FROM scored LEFT JOIN cmd USING (id__cmd)"))
def jn_truth(spark, folder):
    flagged = truth.with_truth(cmd(spark, folder), ["swapped_geo", "shuffle_lat"])
    return scored(spark, folder).select(c.ID, c.SCORE_CITY).join(flagged.select(c.ID, "is_error"), c.ID, "left")


@check(
    "jn_dictionary",
    with_cmd("SELECT id__cmd, true_city, true_city AS word, true_city IS NOT NULL AS has_code FROM scored"),
)
def jn_dictionary(spark, folder):
    coded = encoding.encode(scored(spark, folder).select(c.ID, "true_city", "cluster"), "true_city", "cluster")
    return coded.select(c.ID, "true_city", "word", F.col(c.CODE).isNotNull().alias("has_code"))


# -- neighbours ----------------------------------------------------------------------------

_DISTANCE = HAVERSINE.format(y1="a.lat__cmd", x1="a.long__cmd", y2="b.lat__cmd", x2="b.long__cmd")
_SPATIAL = f"""
placed AS (SELECT id__cmd, city__cmd, lat__cmd, long__cmd FROM cmd WHERE lat__cmd IS NOT NULL),
near AS (SELECT a.id__cmd, count(*) AS n FROM placed a JOIN placed b ON b.lat__cmd BETWEEN a.lat__cmd - 0.01 AND a.lat__cmd + 0.01
         WHERE a.id__cmd <> b.id__cmd AND {_DISTANCE} <= {RADIUS_M} GROUP BY a.id__cmd),
closest AS (SELECT a.id__cmd, min(struct_pack(d := round({_DISTANCE}, 2), i := b.id__cmd, name := b.city__cmd)) AS m
         FROM placed a JOIN placed b ON b.lat__cmd BETWEEN a.lat__cmd - 0.6 AND a.lat__cmd + 0.6
         WHERE a.id__cmd <> b.id__cmd AND {_DISTANCE} <= {REACH_M} GROUP BY a.id__cmd),
stats AS (SELECT cmd.id__cmd, CASE WHEN lat__cmd IS NOT NULL THEN coalesce(n, 0) END AS neighbors_count,
          m.name AS closest_city__cmd, m.d AS closest_distance_m, m.i AS closest_id__cmd
          FROM cmd LEFT JOIN near USING (id__cmd) LEFT JOIN closest USING (id__cmd))
"""


@check("jn_spatial", with_cmd("SELECT id__cmd, neighbors_count, closest_city__cmd, round(closest_distance_m, 1) AS closest_distance_m, closest_id__cmd FROM stats", _SPATIAL))
def jn_spatial(spark, folder):
    stats = neighbours.neighbours(cmd(spark, folder), RADIUS_M, REACH_M)
    return rounded(stats, 1, "closest_distance_m").drop("is_isolated")


@check("dq_neighbours", with_cmd("SELECT id__cmd, coalesce(neighbors_count < 5, true) AS is_isolated, neighbors_count, closest_id__cmd FROM stats", _SPATIAL))
def dq_neighbours(spark, folder):
    stats = neighbours.neighbours(cmd(spark, folder), RADIUS_M, REACH_M)
    return stats.select(c.ID, "is_isolated", "neighbors_count", "closest_id__cmd")


# -- models --------------------------------------------------------------------------------


@check(
    "ml_assemble",
    with_cmd("SELECT id__cmd, lat__cmd AS first, 3 AS n_features FROM scored WHERE lat__cmd IS NOT NULL AND long__cmd IS NOT NULL AND neighbors_count IS NOT NULL"),
)
def ml_assemble(spark, folder):
    ready = scored(spark, folder).select(c.ID, c.LAT, c.LONG, "neighbors_count")
    made = VectorAssembler(inputCols=[c.LAT, c.LONG, "neighbors_count"], outputCol="v", handleInvalid="skip").transform(ready)
    return made.withColumn("a", vector_to_array("v")).select(c.ID, F.col("a")[0].alias("first"), F.size("a").alias("n_features"))


@check(
    "ml_standardise",
    with_cmd(
        """SELECT id__cmd, round((lat__cmd - m1) / s1, 6) AS st_attr_0, round((long__cmd - m2) / s2, 6) AS st_attr_1 FROM cmd,
        (SELECT avg(lat__cmd) AS m1, stddev_samp(lat__cmd) AS s1, avg(long__cmd) AS m2, stddev_samp(long__cmd) AS s2 FROM cmd)"""
    ),
)
def ml_standardise(spark, folder):
    done = forest.standardise(cmd(spark, folder), [c.LAT, c.LONG])
    return rounded(done, 6, "st_attr_0", "st_attr_1").select(c.ID, "st_attr_0", "st_attr_1")


@check(
    "ml_if_prepare",
    with_cmd(
        """SELECT id__cmd, cluster, CASE WHEN neighbors_count IS NULL THEN cluster ELSE cluster + 1 END AS most_common_cluster,
        coalesce(neighbors_count, (SELECT max(neighbors_count) FROM scored) + 1) AS index FROM scored"""
    ),
)
def ml_if_prepare(spark, folder):
    base = scored(spark, folder).select(c.ID, "cluster", (F.col("cluster") + 1).alias("most_common_cluster"), F.col("neighbors_count").alias("index"))
    return forest.prepare(base)


def _clusterer():
    return clusters.PlaceClusters(cat_col="true_city")


def _records(spark, folder):
    return cmd(spark, folder).select(c.ID, c.CITY, "true_city", c.LAT, c.LONG)


def _holds(df, **facts):
    """One row: whether each fact holds for every row (null: not)."""
    return df.agg(*[F.coalesce(F.min(F.coalesce(fact, F.lit(False))), F.lit(True)).alias(name) for name, fact in facts.items()])


def _with_holds(rows, facts):
    """Rows with the facts beside each."""
    return rows.join(F.broadcast(facts), F.lit(True))


@check(
    "ml_kmeans_elbow",
    with_cmd("SELECT id__cmd, lat__cmd IS NULL OR long__cmd IS NULL AS in_default, TRUE AS few_clusters, TRUE AS most_explained FROM cmd"),
)
def ml_kmeans_elbow(spark, folder):
    """Rows without a place are in the default cluster; the others are in 2 to 10 that explain most of the spread."""
    made = cut_lineage(_clusterer().kmeans(_records(spark, folder)))
    placed = made.filter(F.col(c.LAT).isNotNull() & F.col(c.LONG).isNotNull())
    spread = F.var_pop(c.LAT) + F.var_pop(c.LONG)
    within = placed.groupBy(c.CLUSTER).agg(F.count(F.lit(1)).alias("n"), spread.alias("v")).agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within"), F.count(F.lit(1)).alias("k"))
    whole = placed.agg(spread.alias("whole")).join(F.broadcast(within), F.lit(True))
    facts = _holds(whole, few_clusters=F.col("k").between(2, 10), most_explained=F.col("within") < 0.5 * F.col("whole"))
    return _with_holds(made.select(c.ID, (F.col(c.CLUSTER) == 99).alias("in_default")), facts)


@check(
    "ml_cluster",
    with_cmd("SELECT id__cmd, true_city, lat__cmd IS NULL OR long__cmd IS NULL AS in_default, TRUE AS one_per_category, TRUE AS large FROM cmd"),
)
def ml_cluster(spark, folder):
    """Every category is in one cluster, and no cluster with a place is small."""
    made = cut_lineage(_clusterer().fit(_records(spark, folder)))
    per_category = made.groupBy("true_city").agg(F.count_distinct(c.COMMON_CLUSTER).alias("n"))
    sizes = made.groupBy(c.COMMON_CLUSTER).agg(F.count(F.lit(1)).alias("n"), F.count(c.LAT).alias("placed"))
    facts = _holds(per_category, one_per_category=F.col("n") == 1).join(_holds(sizes, large=(F.col("n") >= 100) | (F.col("placed") == 0)), F.lit(True))
    return _with_holds(made.select(c.ID, "true_city", (F.col(c.CLUSTER) == 99).alias("in_default")), facts)


@check(
    "ml_similarity_encode",
    with_cmd(
        """SELECT id__cmd, scored.city__cmd, scored.cluster, before + step AS index, word FROM scored
        LEFT JOIN walked ON word = scored.city__cmd LEFT JOIN starts ON starts.part = walked.part""",
        """words AS (SELECT city__cmd AS w, min(cluster) AS part FROM scored GROUP BY city__cmd),
        starts AS (SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
                   FROM (SELECT part, count(*) AS n FROM words GROUP BY part)),
        walked AS (SELECT part, 1::BIGINT AS step, min(w) AS word, [min(w)] AS used FROM words GROUP BY part
                   UNION ALL
                   SELECT part, step + 1, next.w, list_append(used, next.w) FROM
                   (SELECT t.part, t.step, t.used, min(struct_pack(d := -levenshtein(t.word, v.w), w := v.w)) AS next
                    FROM walked t JOIN words v ON v.part = t.part AND NOT list_contains(t.used, v.w) GROUP BY t.part, t.step, t.used))""",
    ),
)
def ml_similarity_encode(spark, folder):
    return encoding.encode(scored(spark, folder).select(c.ID, c.CITY, "cluster"), c.CITY, "cluster")


def _encoded(spark, folder):
    """Records with a category code, numbered within the place clusters of the fixture."""
    base = scored(spark, folder).select(c.ID, c.CITY, "true_city", c.LAT, c.LONG, "cluster")
    merged = clusters.merge_small(clusters.with_common_cluster(base, "true_city"))
    return cut_lineage(forest.prepare(encoding.encode(cut_lineage(merged), "true_city")))


_SCORES_SQL = "SELECT id__cmd, {known} AS scored, TRUE AS in_range{more} FROM {table}"
_PLACED = "lat__cmd IS NOT NULL AND long__cmd IS NOT NULL"


def _scored_facts(df, score, errors=None):
    """Which rows have a score, and whether all scores are in [-1, 0) (and known errors score lower on average)."""
    df = cut_lineage(df)
    facts = _holds(df, in_range=F.col(score).isNull() | ((F.col(score) >= -1) & (F.col(score) < 0)))
    if errors is not None:
        means = df.agg(F.avg(F.when(errors, F.col(score))).alias("bad"), F.avg(F.when(~errors, F.col(score))).alias("good"))
        facts = facts.join(_holds(means, errors_lower=F.col("bad") < F.col("good")), F.lit(True))
    return _with_holds(df.select(c.ID, F.col(score).isNotNull().alias("scored")), facts)


@check("ml_if_coords", with_cmd(_SCORES_SQL.format(known=_PLACED, more=", TRUE AS errors_lower", table="cmd")))
def ml_if_coords(spark, folder):
    errors = F.col("swapped_geo") | F.col("shuffle_lat") | F.col("shuffle_long")
    return _scored_facts(forest.score_coordinates(cmd(spark, folder)), c.SCORE_COORDS, errors)


@check("ml_if_city", with_cmd(_SCORES_SQL.format(known=_PLACED, more="", table="cmd")))
def ml_if_city(spark, folder):
    return _scored_facts(forest.score_city(_encoded(spark, folder)), c.SCORE_CITY)


@check("ml_if_city_cluster", with_cmd(_SCORES_SQL.format(known=_PLACED, more="", table="cmd")))
def ml_if_city_cluster(spark, folder):
    return _scored_facts(forest.score_city_cluster(_encoded(spark, folder)), c.SCORE_CITY_CLUSTER)


@check("ml_iforest", with_cmd(_SCORES_SQL.format(known=_PLACED + " AND neighbors_count IS NOT NULL", more="", table="scored")))
def ml_iforest(spark, folder):
    model = forest.IsolationForest([c.LAT, c.LONG, "neighbors_count"], "anomaly_score", "cluster")
    return _scored_facts(model.fit_transform(scored(spark, folder)), "anomaly_score")


@check(
    "udf_grouped_map",
    with_cmd("SELECT t.tree::INT AS tree, least(256, n)::INT AS sample, TRUE AS binary_tree, TRUE AS shallow FROM range(50) AS t(tree), (SELECT count(*) AS n FROM cmd WHERE lat__cmd IS NOT NULL AND long__cmd IS NOT NULL)"),
)
def udf_grouped_map(spark, folder):
    """Trees grown in groups: as many leaves as inner nodes and one, children in order, no value beyond the depth limit's."""
    nodes = forest.IsolationForest([c.LAT, c.LONG], "anomaly_score").fit(_records(spark, folder))
    leaf = F.col("feature") < 0
    most = 8 + float(forest.average_path(256))
    return nodes.groupBy("tree", "sample").agg(
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary_tree"),
        (F.max(F.when(leaf, F.col("value"))) <= most).alias("shallow"),
    )


def _classifier(spark, folder):
    base = feedback.split(scored(spark, folder))
    return feedback.AnomalyClassifier().fit(base.filter(F.col("train_or_test") == "train")), base


def _predictions(rows, *columns):
    agree = F.col("prediction") == (vector_to_array("probability")[1] > 0.5).cast("double")
    return rows.select(*columns, (F.col("prediction").isin(0.0, 1.0) & agree).alias("follows_probability"))


@check("ml_classify_fit", with_cmd("SELECT id__cmd, is_anomaly, TRUE AS follows_probability, TRUE AS fits FROM scored WHERE is_anomaly IS NOT NULL"))
def ml_classify_fit(spark, folder):
    model, base = _classifier(spark, folder)
    rows = cut_lineage(model.predict(base.filter(F.col("train_or_test") == "train")))
    right = rows.agg(F.avg((F.col(c.LABEL) == F.col("prediction")).cast("double")).alias("share"))
    return _with_holds(_predictions(rows, c.ID, c.LABEL), _holds(right, fits=F.col("share") > 0.9))


@check(
    "ml_classify_predict",
    with_cmd("SELECT id__cmd, CASE WHEN is_anomaly IS NULL THEN 'test' ELSE 'train' END AS train_or_test, TRUE AS follows_probability FROM scored"),
)
def ml_classify_predict(spark, folder):
    model, base = _classifier(spark, folder)
    return _predictions(model.predict(base), c.ID, "train_or_test")


@check("ml_importance", "SELECT unnest([{}]) AS feature, TRUE AS a_share, TRUE AS sum_to_one".format(", ".join(f"'{x}'" for x in c.FEATURES)))
def ml_importance(spark, folder):
    model, base = _classifier(spark, folder)
    shares = model.importance(base)
    total = shares.agg(F.sum("importance").alias("total"))
    rows = shares.select("feature", F.col("importance").between(0, 1).alias("a_share"))
    return _with_holds(rows, _holds(total, sum_to_one=F.abs(F.col("total") - 1) < 1e-9))


@check(
    "ml_pdp",
    with_cmd(
        """SELECT round(lo + (hi - lo) * i / 99e0, 9) AS feature_value, TRUE AS a_probability FROM range(100) AS t(i),
        (SELECT quantile_cont(S_Score_coordinates, 0.05) AS lo, quantile_cont(S_Score_coordinates, 0.95) AS hi FROM scored)"""
    ),
)
def ml_pdp(spark, folder):
    model, base = _classifier(spark, folder)
    curve = model.partial_dependence(base, c.SCORE_COORDS)
    return curve.select(F.round("feature_value", 9).alias("feature_value"), F.col("partial_dependence").between(0, 1).alias("a_probability"))


# -- flags and tags ------------------------------------------------------------------------

RANK_FLAGS = """flagged AS (SELECT *, rank() OVER (ORDER BY S_Score_coordinates) <= 5 AS is_anomaly_coords,
rank() OVER (ORDER BY S_Score_city_cluster) <= 1000 AND NOT is_isolated AS is_anomaly_city_cluster,
rank() OVER (ORDER BY S_Score_city) <= 1000 AND NOT is_isolated AS is_anomaly_city FROM scored)"""
TAGGED = (
    RANK_FLAGS
    + """, tagged AS (SELECT *, CASE
WHEN city__cmd <> standardized_city AND NOT is_anomaly_city_cluster THEN 'case 1 - city to be standardized'
WHEN city__cmd <> standardized_city AND is_anomaly_city_cluster THEN 'case 2 - both city standardization and coords to be checked'
WHEN city__cmd = standardized_city AND is_anomaly_city_cluster THEN 'case 3 - inconsistency between city name and coords'
WHEN is_anomaly_coords THEN 'case 4 - out of Country' END AS tag_anomalies FROM flagged)"""
)
FLAG_COLUMNS = ["is_anomaly_coords", "is_anomaly_city_cluster", "is_anomaly_city"]


@check("dq_flag_topk", with_cmd(f"SELECT id__cmd, {', '.join(FLAG_COLUMNS)} FROM flagged", RANK_FLAGS))
def dq_flag_topk(spark, folder):
    return flags.flag_top_k(scored(spark, folder)).select(c.ID, *FLAG_COLUMNS)


@check(
    "dq_flag_percentile",
    with_cmd(
        """SELECT id__cmd, S_Score_coordinates <= qa AS is_anomaly_coords, S_Score_city_cluster <= qc AND NOT is_isolated AS is_anomaly_city_cluster,
        S_Score_city <= qb AND NOT is_isolated AS is_anomaly_city FROM scored,
        (SELECT quantile_disc(S_Score_coordinates, 0.005) AS qa FROM scored),
        (SELECT quantile_disc(S_Score_city, 0.05) AS qb, quantile_disc(S_Score_city_cluster, 0.05) AS qc FROM scored WHERE NOT is_isolated)"""
    ),
)
def dq_flag_percentile(spark, folder):
    return flags.flag_percentile(scored(spark, folder)).select(c.ID, *FLAG_COLUMNS)


def _tagged(spark, folder):
    return flags.tag(flags.flag_top_k(scored(spark, folder)))


@check("dq_tag", with_cmd("SELECT id__cmd, tag_anomalies FROM tagged", TAGGED))
def dq_tag(spark, folder):
    return _tagged(spark, folder).select(c.ID, "tag_anomalies")


@check("dq_alerts", with_cmd("SELECT id__cmd, city__cmd, tag_anomalies FROM tagged WHERE tag_anomalies IS NOT NULL", TAGGED))
def dq_alerts(spark, folder):
    return flags.alerts(_tagged(spark, folder)).select(c.ID, c.CITY, "tag_anomalies")


@check(
    "dq_map_table",
    with_cmd(
        """SELECT id__cmd, city__cmd, lat__cmd, long__cmd, S_Score_city_cluster, is_isolated, neighbors_count, tag_anomalies,
        abs(S_Score_city_cluster) * 15 AS radius FROM tagged WHERE is_anomaly_city_cluster""",
        TAGGED,
    ),
)
def dq_map_table(spark, folder):
    return flags.map_rows(_tagged(spark, folder), c.SCORE_CITY_CLUSTER, "is_anomaly_city_cluster", ("tag_anomalies",))


# -- truth and review loop -----------------------------------------------------------------


@check(
    "dq_error_truth",
    with_cmd(
        """SELECT id__cmd, swapped_geo OR shuffle_lat OR shuffle_long OR missing_geo OR typo_city AS is_error,
        CASE WHEN swapped_geo THEN 1 WHEN shuffle_lat THEN 2 WHEN shuffle_long THEN 3 WHEN missing_geo THEN 4 WHEN typo_city THEN 5 END AS index_error FROM cmd"""
    ),
)
def dq_error_truth(spark, folder):
    names = ["swapped_geo", "shuffle_lat", "shuffle_long", "missing_geo", "typo_city"]
    return truth.with_truth(cmd(spark, folder), names).select(c.ID, "is_error", "index_error")


def _hit_sql(salt: int) -> str:
    return f"((((id__cmd % 2147483648) * 2654435761 + {salt * 40503}) % 4294967296) >> 7) % 50 = 0"


_HITS = ", ".join(f"{_hit_sql(i)} AS {name}" for i, name in enumerate(truth.ERROR_FLAGS, start=1))
_SPOILED = f"""hit AS (SELECT id__cmd, lat__cmd, long__cmd, post_code__cmd, {_HITS.replace('swapped_geo', 'swapped')} FROM cmd),
moved AS (SELECT *, CASE WHEN shuffle_lat THEN lat__cmd + 9e0 ELSE lat__cmd END AS la, CASE WHEN shuffle_long THEN long__cmd - 13e0 ELSE long__cmd END AS lo,
CASE WHEN shuffle_postcode THEN reverse(post_code__cmd) ELSE post_code__cmd END AS pc FROM hit)"""


@check(
    "dq_inject_errors",
    with_cmd(
        """SELECT id__cmd, CASE WHEN swapped THEN lo ELSE la END AS lat__cmd, CASE WHEN swapped THEN la ELSE lo END AS long__cmd,
        CASE WHEN typo_postcode THEN substr(pc, 1, 1) || substr(pc, 3) ELSE pc END AS post_code__cmd,
        shuffle_postcode, shuffle_lat, shuffle_long, swapped AS swapped_geo, typo_postcode FROM moved""",
        _SPOILED,
    ),
)
def dq_inject_errors(spark, folder):
    clean = cmd(spark, folder).select(c.ID, c.LAT, c.LONG, c.POST_CODE)
    return truth.inject_errors(clean)


@check("dq_feedback_join", with_cmd("SELECT id__cmd, S_Score_city, CASE WHEN is_anomaly IS NOT NULL THEN is_anomaly END AS is_anomaly FROM scored"))
def dq_feedback_join(spark, folder):
    base = scored(spark, folder)
    reviews = base.filter(F.col(c.LABEL).isNotNull()).select(c.ID, c.LABEL)
    return feedback.attach_reviews(base.select(c.ID, c.SCORE_CITY), reviews)


@check("dq_split", with_cmd("SELECT id__cmd, is_anomaly, CASE WHEN is_anomaly IS NOT NULL THEN 'train' ELSE 'test' END AS train_or_test FROM scored"))
def dq_split(spark, folder):
    return feedback.split(scored(spark, folder)).select(c.ID, c.LABEL, "train_or_test")


PREDICTED = (
    TAGGED
    + """, predicted AS (SELECT *, CASE WHEN S_Score_city < -0.49e0 THEN 1e0 ELSE 0e0 END AS prediction,
CASE WHEN is_anomaly IS NOT NULL THEN 'train' ELSE 'test' END AS train_or_test FROM tagged)"""
)


def _predicted(spark, folder):
    """A stand-in prediction by a fixed cut, so that what follows a model can be restated in SQL."""
    by_cut = F.when(F.col(c.SCORE_CITY) < -0.49, 1.0).otherwise(0.0)
    return feedback.split(_tagged(spark, folder)).withColumn("prediction", by_cut)


@check("dq_retag", with_cmd("SELECT id__cmd, prediction, tag_anomalies FROM predicted WHERE prediction <> 0 AND tag_anomalies IS NOT NULL", PREDICTED))
def dq_retag(spark, folder):
    return feedback.retag(_predicted(spark, folder)).select(c.ID, "prediction", "tag_anomalies")


@check(
    "dq_evaluate",
    with_cmd(
        f"SELECT tp, tn, fp, fn, {rates_sql()} FROM tallied",
        PREDICTED
        + """, tallied AS (SELECT count(*) FILTER (is_error AND prediction = 1) AS tp, count(*) FILTER (NOT is_error AND prediction = 0) AS tn,
        count(*) FILTER (NOT is_error AND prediction = 1) AS fp, count(*) FILTER (is_error AND prediction = 0) AS fn FROM predicted)""",
    ),
)
def dq_evaluate(spark, folder):
    return rounded(feedback.evaluate(_predicted(spark, folder)), 9, *RATES)


@check("dq_evaluate_report", with_cmd("SELECT tag_anomalies, is_error, train_or_test, prediction, count(*) AS n FROM predicted GROUP BY ALL", PREDICTED))
def dq_evaluate_report(spark, folder):
    return feedback.report(_predicted(spark, folder))


@check(
    "fn_outcome_class",
    with_cmd(
        """SELECT id__cmd, CASE WHEN is_error AND prediction = 1 THEN 'TP' WHEN prediction = 1 THEN 'FP' WHEN is_error THEN 'FN' ELSE 'TN' END AS outcome,
        CASE WHEN train_or_test = 'train' THEN 'red' ELSE 'black' END AS border FROM predicted""",
        PREDICTED,
    ),
)
def fn_outcome_class(spark, folder):
    return feedback.with_outcome(_predicted(spark, folder)).select(c.ID, "outcome", "border")


# -- the jobs end to end -------------------------------------------------------------------


@check("job_scores", with_cmd(f"SELECT id__cmd, true_city AS standardized_city, {_PLACED} AS coords_scored, {_PLACED} AS city_scored, {_PLACED} AS cluster_scored FROM cmd"))
def job_scores(spark, folder):
    """Records to three scores: clusters, codes, forests."""
    records = _records(spark, folder).withColumn(c.STANDARD, F.col("true_city"))
    return _which_scored(scoring.scores(scoring.features(records)))


def _which_scored(df, *more):
    names = {c.SCORE_COORDS: "coords_scored", c.SCORE_CITY: "city_scored", c.SCORE_CITY_CLUSTER: "cluster_scored"}
    return df.select(c.ID, c.STANDARD, *[F.col(x).isNotNull().alias(n) for x, n in names.items()], *more)


def _upheld_facts(results, upheld):
    """Upheld alerts are alerts of the job, predicted as such, and some are upheld."""
    alerts = flags.alerts(results).select(c.ID, F.col("tag_anomalies").alias("given"))
    joined = upheld.join(alerts, c.ID, "left")
    facts = _holds(joined, are_alerts=F.col("given") == F.col("tag_anomalies"), are_predicted=F.col("prediction") == 1)
    return facts.join(upheld.agg((F.count(F.lit(1)) > 0).alias("some_upheld"), (F.count(F.lit(1)) == F.count_distinct(c.ID)).alias("once_each")), F.lit(True))


@check("job_results", "SELECT TRUE AS are_alerts, TRUE AS are_predicted, TRUE AS some_upheld, TRUE AS once_each")
def job_results(spark, folder):
    """Scores and neighbours to tagged records, reviewed by the model."""
    base = scored(spark, folder)
    stats = neighbours.neighbours(cmd(spark, folder), RADIUS_M, REACH_M)
    results = cut_lineage(flagging.results(base.drop("neighbors_count", "is_isolated"), stats))
    _, upheld = flagging.reviewed_results(results)
    return _upheld_facts(results, cut_lineage(upheld))


@check(
    "job_full",
    with_cmd(
        f"""SELECT cmd.id__cmd, coalesce(named.standardized_city, cmd.city__cmd) AS standardized_city, {_PLACED} AS coords_scored, {_PLACED} AS city_scored,
        {_PLACED} AS cluster_scored, stats.neighbors_count, TRUE AS are_alerts, TRUE AS are_predicted, TRUE AS some_upheld, TRUE AS once_each
        FROM cmd LEFT JOIN named ON named.city__cmd = cmd.city__cmd LEFT JOIN stats ON stats.id__cmd = cmd.id__cmd""",
        f"{STANDARD}, {_SPATIAL}",
    ),
)
def job_full(spark, folder):
    """Misspelled records to reviewed alerts in one chain: standard names, clusters, codes, forests, neighbours, flags, review."""
    records = cmd(spark, folder)
    flagged = records.withColumn("is_error", F.col("swapped_geo") | F.col("shuffle_lat") | F.col("shuffle_long"))
    names = standardisation.by_spelling(records)
    clean = proposals.standardise(flagged, names.stacked).select(c.ID, c.CITY, c.STANDARD, c.LAT, c.LONG, "is_error")
    scores = scoring.scores(scoring.features(clean))
    results = cut_lineage(flagging.results(scores, neighbours.neighbours(records, RADIUS_M, REACH_M)))
    reviews = results.filter(F.col(c.ID) % 3 == 0).select(c.ID, F.col("is_error").cast("int").alias(c.LABEL))
    _, upheld = flagging.reviewed_results(feedback.attach_reviews(results, reviews))
    return _with_holds(_which_scored(results, "neighbors_count"), _upheld_facts(results, cut_lineage(upheld)))


@check(
    "job_evaluate",
    with_cmd(
        """SELECT cut, count(*) FILTER (bad AND s < cut) AS tp, count(*) FILTER (NOT bad AND s >= cut) AS tn,
        count(*) FILTER (NOT bad AND s < cut) AS fp, count(*) FILTER (bad AND s >= cut) AS fn, 101::BIGINT AS cuts_swept, 101::BIGINT AS curve_points
        FROM (SELECT s.S_Score_city_cluster AS s, swapped_geo OR shuffle_lat OR shuffle_long OR missing_geo OR typo_city AS bad FROM scored s JOIN cmd USING (id__cmd)),
        (SELECT unnest([-0.56e0, -0.53e0]) AS cut) GROUP BY cut"""
    ),
)
def job_evaluate(spark, folder):
    """The evaluation job: truth joined to scores, the shown cuts, the sweep and the curve."""
    kinds = ["swapped_geo", "shuffle_lat", "shuffle_long", "missing_geo", "typo_city"]
    made = evaluation.evaluate_scores(scored(spark, folder), truth.with_truth(cmd(spark, folder), kinds))
    counts = made.swept.agg(F.count(F.lit(1)).alias("cuts_swept")).join(made.curve.agg(F.count(F.lit(1)).alias("curve_points")), F.lit(True))
    return _with_holds(made.shown.select("cut", "tp", "tn", "fp", "fn"), counts)
