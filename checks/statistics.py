"""Checks of aggregates, metrics, curves and feature relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import cmd, scored, with_cmd
from checks.registry import check
from rowguard import config as c
from rowguard.operators import clusters, feedback, metrics, ranking, relations

CITY_SCORE = c.SCORE_CITY_CLUSTER
HAVERSINE = (
    "2 * 6371008.8 * asin(least(1e0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2)"
    " + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
)


def rounded(df, digits, *columns):
    return df.withColumns({x: F.round(x, digits) for x in columns})


@check("agg_pair_count", with_cmd("SELECT city__cmd, cluster, count(*) AS count FROM scored GROUP BY ALL"))
def agg_pair_count(spark, folder):
    return clusters.pair_counts(scored(spark, folder), c.CITY, "cluster")


MODES = """modes AS (SELECT true_city, cluster AS most_common_cluster FROM (SELECT true_city, cluster,
row_number() OVER (PARTITION BY true_city ORDER BY count(*) DESC, cluster) AS rn FROM scored GROUP BY true_city, cluster) WHERE rn = 1)"""


@check("agg_mode", with_cmd("SELECT true_city, most_common_cluster FROM modes", MODES))
def agg_mode(spark, folder):
    return clusters.modal_clusters(scored(spark, folder), "true_city", "cluster")


@check("jn_mode", with_cmd("SELECT id__cmd, cluster, most_common_cluster FROM scored LEFT JOIN modes USING (true_city)", MODES))
def jn_mode(spark, folder):
    records = scored(spark, folder)
    modes = clusters.modal_clusters(records, "true_city", "cluster")
    return records.join(modes, "true_city", "left").select(c.ID, "cluster", "most_common_cluster")


@check(
    "ml_cluster_unify",
    with_cmd("SELECT id__cmd, city__cmd, cluster, coalesce(most_common_cluster, cluster) AS most_common_cluster FROM scored LEFT JOIN modes USING (true_city)", MODES),
)
def ml_cluster_unify(spark, folder):
    unified = clusters.with_common_cluster(scored(spark, folder), "true_city")
    return unified.select(c.ID, c.CITY, "cluster", "most_common_cluster")


CENTERS = "centers AS (SELECT cluster, avg(lat__cmd) AS lat, avg(long__cmd) AS long, count(*) AS size FROM scored GROUP BY cluster)"
NEAREST = (
    CENTERS
    + f""", nearest AS (SELECT small, large, d FROM (SELECT s.cluster AS small, l.cluster AS large,
    round({HAVERSINE.format(y1="s.lat", x1="s.long", y2="l.lat", x2="l.long")}, 2) AS d,
    row_number() OVER (PARTITION BY s.cluster ORDER BY round({HAVERSINE.format(y1="s.lat", x1="s.long", y2="l.lat", x2="l.long")}, 2), l.cluster) AS rn
    FROM centers s, centers l WHERE s.size < 400 AND l.size >= 400 AND s.lat IS NOT NULL AND l.lat IS NOT NULL) WHERE rn = 1)"""
)


@check(
    "agg_centroid",
    with_cmd("SELECT cluster, round(lat, 6) AS centroid_lat, round(long, 6) AS centroid_long, size AS cluster_size FROM centers", CENTERS),
)
def agg_centroid(spark, folder):
    return rounded(clusters.centroids(scored(spark, folder), "cluster"), 6, "centroid_lat", "centroid_long")


@check(
    "jn_nearest",
    with_cmd("SELECT small AS small_cluster_id, large AS nearest_large_cluster, round(d, 1) AS distance_m FROM nearest", NEAREST),
)
def jn_nearest(spark, folder):
    centers = clusters.centroids(scored(spark, folder), "cluster")
    return rounded(clusters.nearest_large(centers, "cluster", 400), 1, "distance_m")


@check("win_nearest", with_cmd("SELECT small AS small_cluster_id, large AS nearest_large_cluster FROM nearest", NEAREST))
def win_nearest(spark, folder):
    centers = clusters.centroids(scored(spark, folder), "cluster")
    return clusters.nearest_large(centers, "cluster", 400).select("small_cluster_id", "nearest_large_cluster")


_MERGED = "SELECT id__cmd, cluster AS original, coalesce(large, cluster) AS cluster FROM scored LEFT JOIN nearest ON small = cluster"


@check("ml_cluster_merge", with_cmd(_MERGED.replace("cluster AS original, ", ""), NEAREST))
def ml_cluster_merge(spark, folder):
    return clusters.merge_small(scored(spark, folder), "cluster", size_threshold=400).select(c.ID, "cluster")


@check("jn_remap", with_cmd(_MERGED, NEAREST))
def jn_remap(spark, folder):
    records = scored(spark, folder).withColumn("original", F.col("cluster"))
    return clusters.merge_small(records, "cluster", size_threshold=400).select(c.ID, "original", "cluster")


@check("agg_max", with_cmd("SELECT max(neighbors_count) AS largest FROM scored"))
def agg_max(spark, folder):
    return scored(spark, folder).agg(F.max("neighbors_count").alias("largest"))


@check("agg_profile", with_cmd("SELECT swapped_geo, shuffle_lat, shuffle_long, missing_geo, typo_city, count(*) AS n FROM cmd GROUP BY ALL"))
def agg_profile(spark, folder):
    return metrics.profile(cmd(spark, folder), ["swapped_geo", "shuffle_lat", "shuffle_long", "missing_geo", "typo_city"])


@check(
    "agg_split_count",
    with_cmd("SELECT count(*) FILTER (is_anomaly IS NOT NULL) AS train_rows, count(*) FILTER (is_anomaly IS NULL) AS test_rows FROM scored"),
)
def agg_split_count(spark, folder):
    return feedback.split_counts(scored(spark, folder))


CONFUSION = """counts AS (SELECT count(*) FILTER (is_error AND S_Score_city_cluster < -0.5e0) AS tp,
count(*) FILTER (NOT is_error AND S_Score_city_cluster >= -0.5e0) AS tn,
count(*) FILTER (NOT is_error AND S_Score_city_cluster < -0.5e0) AS fp,
count(*) FILTER (is_error AND S_Score_city_cluster >= -0.5e0) AS fn FROM scored)"""


def rates_sql(digits: int = 9) -> str:
    """SQL of the rates of tp, tn, fp, fn; spelled out once for every check that needs it."""
    p = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END"
    r = "CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END"
    return f"""round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), {digits}) AS accuracy, round({p}, {digits}) AS precision,
    round({r}, {digits}) AS recall, round(CASE WHEN tp > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0e0 END, {digits}) AS f1"""


RATES = ["accuracy", "precision", "recall", "f1"]


@check("agg_confusion", with_cmd("SELECT tp, tn, fp, fn FROM counts", CONFUSION))
def agg_confusion(spark, folder):
    return metrics.confusion(scored(spark, folder), F.col("is_error"), F.col(CITY_SCORE) < -0.5)


@check("agg_metrics", with_cmd(f"SELECT tp, tn, fp, fn, {rates_sql()} FROM counts", CONFUSION))
def agg_metrics(spark, folder):
    return rounded(metrics.metrics(metrics.confusion(scored(spark, folder), F.col("is_error"), F.col(CITY_SCORE) < -0.5)), 9, *RATES)


@check(
    "agg_alert_precision",
    with_cmd(
        """SELECT count(*) FILTER (is_error) AS tp, count(*) FILTER (NOT is_error) AS fp,
        round(count(*) FILTER (is_error) / CAST(count(*) AS DOUBLE), 9) AS precision FROM scored"""
    ),
)
def agg_alert_precision(spark, folder):
    return rounded(metrics.alert_precision(scored(spark, folder), F.col("is_error")), 9, "precision")


def _confusion_over(cuts: str, key: str) -> str:
    return f"""SELECT {key}, count(*) FILTER (is_error AND s < {key}) AS tp, count(*) FILTER (NOT is_error AND s >= {key}) AS tn,
    count(*) FILTER (NOT is_error AND s < {key}) AS fp, count(*) FILTER (is_error AND s >= {key}) AS fn
    FROM {cuts}, (SELECT is_error, S_Score_city_cluster AS s FROM scored) GROUP BY {key}"""


@check("agg_confusion_at", with_cmd(_confusion_over("(VALUES (-0.56e0), (-0.53e0), (-0.45e0)) AS cuts(cut)", "cut")))
def agg_confusion_at(spark, folder):
    return metrics.confusion_at(scored(spark, folder), CITY_SCORE, "is_error", [-0.56, -0.53, -0.45])


CUTS = "cuts AS (SELECT -0.9e0 + i * 0.005e0 AS threshold FROM range(101) t(i))"
SWEEP = f"{CUTS}, swept AS ({_confusion_over('cuts', 'threshold')}), rated AS (SELECT threshold, tp, tn, fp, fn, {rates_sql()} FROM swept)"


@check("agg_sweep", with_cmd("SELECT round(threshold, 3) AS threshold, tp, tn, fp, fn, accuracy, precision, recall, f1 FROM rated", SWEEP))
def agg_sweep(spark, folder):
    return rounded(rounded(metrics.sweep(scored(spark, folder), CITY_SCORE, "is_error"), 9, *RATES), 3, "threshold")


@check(
    "agg_pr_curve",
    with_cmd(
        """SELECT round(threshold, 3) AS threshold, round(v, 6) AS score,
        round(CASE WHEN rows_below > 0 THEN pos_below / CAST(rows_below AS DOUBLE) ELSE 1e0 END, 9) AS precision,
        round(pos_below / CAST(total_pos AS DOUBLE), 9) AS recall
        FROM (SELECT threshold, v, rows_below, pos_below, total_pos,
              row_number() OVER (PARTITION BY threshold ORDER BY abs(v - threshold), v) AS rn FROM cuts, curve) WHERE rn = 1""",
        CUTS
        + """, per_score AS (SELECT S_Score_city_cluster AS v, count(*) AS n, count(*) FILTER (is_error) AS pos FROM scored GROUP BY v),
        curve AS (SELECT v, coalesce(sum(n) OVER below, 0) AS rows_below, coalesce(sum(pos) OVER below, 0) AS pos_below,
                  sum(pos) OVER () AS total_pos FROM per_score
                  WINDOW below AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    ),
)
def agg_pr_curve(spark, folder):
    curve = metrics.precision_recall(scored(spark, folder), CITY_SCORE, "is_error")
    return rounded(rounded(rounded(curve, 3, "threshold"), 6, "score"), 9, "precision", "recall")


@check("agg_quantile", with_cmd("SELECT round(quantile_disc(S_Score_coordinates, 0.005), 9) AS q_low, round(quantile_disc(S_Score_coordinates, 0.05), 9) AS q_high FROM scored"))
def agg_quantile(spark, folder):
    low, high = ranking.quantiles(scored(spark, folder), c.SCORE_COORDS, [0.005, 0.05])
    return spark.range(1).select(F.round(F.lit(low), 9).alias("q_low"), F.round(F.lit(high), 9).alias("q_high"))


FENCE = """tails AS (SELECT -(q3 + 1.5e0 * (q3 - q1)) AS fence, z FROM
(SELECT quantile_cont(abs(S_Score_city_cluster), 0.25) AS q1, quantile_cont(abs(S_Score_city_cluster), 0.75) AS q3 FROM scored),
(SELECT -min(abs(S_Score_city_cluster)) AS z FROM scored WHERE abs(S_Score_city_cluster) -
 (SELECT avg(abs(S_Score_city_cluster)) FROM scored) > 1.5e0 * (SELECT stddev_pop(abs(S_Score_city_cluster)) FROM scored)))"""


@check("agg_iqr_tail", with_cmd("SELECT round(fence, 9) AS fence FROM tails", FENCE))
def agg_iqr_tail(spark, folder):
    fence = metrics.quartile_fence(scored(spark, folder), CITY_SCORE)
    return spark.range(1).select(F.round(F.lit(fence), 9).alias("fence"))


@check("agg_z_tail", with_cmd("SELECT round(z, 9) AS z_tail FROM tails", FENCE))
def agg_z_tail(spark, folder):
    return rounded(metrics.z_tail(scored(spark, folder), CITY_SCORE), 9, "z_tail")


@check("agg_auto_cut", with_cmd("SELECT round(fence, 9) AS fence, round(z, 9) AS z_tail, round(least(fence, z), 2) AS estimated_threshold FROM tails", FENCE))
def agg_auto_cut(spark, folder):
    return rounded(metrics.auto_cut(scored(spark, folder), CITY_SCORE), 9, "fence", "z_tail")


@check(
    "dq_auto_threshold",
    with_cmd(
        """SELECT (SELECT round(least(fence, z), 2) FROM tails) AS estimated_threshold,
        (SELECT round(threshold, 3) FROM rated ORDER BY f1 DESC, threshold LIMIT 1) AS best_threshold, (SELECT max(f1) FROM rated) AS best_f1""",
        f"{FENCE}, {SWEEP}",
    ),
)
def dq_auto_threshold(spark, folder):
    found = metrics.auto_threshold(scored(spark, folder), CITY_SCORE, "is_error")
    return rounded(rounded(found, 3, "best_threshold"), 9, "best_f1")


@check(
    "agg_histogram",
    with_cmd(
        """SELECT bin, count(s) AS n FROM (SELECT CAST(i AS INT) AS bin FROM range(20) t(i)) LEFT JOIN
        (SELECT s, CAST(least(floor((s - lo) / (hi - lo) * 20), 19) AS INT) AS b FROM (SELECT S_Score_city AS s FROM scored),
         (SELECT min(S_Score_city) AS lo, max(S_Score_city) AS hi FROM scored)) ON b = bin GROUP BY bin"""
    ),
)
def agg_histogram(spark, folder):
    return metrics.histogram(scored(spark, folder), c.SCORE_CITY)


@check("agg_minmax", with_cmd("SELECT min(S_Score_city) AS lowest, max(S_Score_city) AS highest FROM scored WHERE is_error"))
def agg_minmax(spark, folder):
    return metrics.value_range(scored(spark, folder), c.SCORE_CITY, "is_error")


@check("agg_label_rate", with_cmd("SELECT neighbors_count, count(is_anomaly) AS n_labels, round(avg(is_anomaly), 9) AS label_rate FROM scored GROUP BY neighbors_count"))
def agg_label_rate(spark, folder):
    return rounded(relations.label_rate(scored(spark, folder), "neighbors_count", c.LABEL), 9, "label_rate")


def matrix_sql(columns: list[str], value, name: str, source: str) -> str:
    """Both directions and the diagonal, from ``value(a, b)`` SQL per pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [f"SELECT '{a}' AS a, '{b}' AS b, ({value(a, b)}) AS v" for a, b in pairs]
    diagonal = " UNION ALL ".join(f"SELECT '{x}', '{x}', 1e0" for x in columns)
    return (
        f"SELECT a AS column_1, b AS column_2, v AS {name} FROM (WITH pairs AS ({' UNION ALL '.join(rows)}) "
        f"SELECT a, b, v FROM pairs UNION ALL SELECT b, a, v FROM pairs UNION ALL {diagonal})"
    )


FEATURES = list(c.FEATURES)
KENDALL_COLUMNS = [CITY_SCORE, c.SCORE_COORDS, "neighbors_count"]


@check("agg_pearson", with_cmd(matrix_sql(FEATURES, lambda a, b: f"SELECT round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) FROM scored", "pearson", "scored")))
def agg_pearson(spark, folder):
    return rounded(relations.pearson(scored(spark, folder), FEATURES), 6, "pearson")


def _kendall_sql(a: str, b: str) -> str:
    return f"""WITH p AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w FROM scored
    WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)
    SELECT round(sum(l.w * r.w * sign(l.x - r.x) * sign(l.y - r.y)) /
    sqrt(sum(CASE WHEN l.x <> r.x THEN l.w * r.w ELSE 0e0 END) * sum(CASE WHEN l.y <> r.y THEN l.w * r.w ELSE 0e0 END)), 9) FROM p l, p r"""


@check("agg_kendall", with_cmd(matrix_sql(KENDALL_COLUMNS, _kendall_sql, "kendall", "scored")))
def agg_kendall(spark, folder):
    return rounded(relations.kendall(scored(spark, folder), KENDALL_COLUMNS), 9, "kendall")


def _nmi_sql(a: str, b: str) -> str:
    return f"""WITH j AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS n FROM
    (SELECT len(list_filter(cuts_{a}, lambda q: q < {a})) AS x, len(list_filter(cuts_{b}, lambda q: q < {b})) AS y FROM complete, cuts) GROUP BY x, y),
    t AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM j)
    SELECT round(sum(n / total * log2(n * total / (nx * ny))) / (SELECT greatest(log2(count(DISTINCT {a})), log2(count(DISTINCT {b}))) FROM complete), 6) FROM t"""


_COMPLETE = "complete AS (SELECT {cols} FROM scored WHERE {known})".format(
    cols=", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in FEATURES), known=" AND ".join(f"{x} IS NOT NULL" for x in FEATURES)
)
_SHARES = ", ".join(f"{k}::DOUBLE / 32" for k in range(1, 32))
_CUTS = "cuts AS (SELECT {cols} FROM complete)".format(cols=", ".join(f"quantile_disc({x}, [{_SHARES}]) AS cuts_{x}" for x in FEATURES))


@check("agg_nmi", with_cmd(matrix_sql(FEATURES, _nmi_sql, "nmi", "scored"), f"{_COMPLETE}, {_CUTS}"))
def agg_nmi(spark, folder):
    return rounded(relations.mutual_information(scored(spark, folder), FEATURES), 6, "nmi")


@check(
    "agg_minmax_scale",
    with_cmd(
        """SELECT id__cmd, round((S_Score_city - lo) / (hi - lo), 9) AS S_Score_city, round((lat__cmd - lo2) / (hi2 - lo2), 9) AS lat__cmd FROM scored,
        (SELECT min(S_Score_city) AS lo, max(S_Score_city) AS hi, min(lat__cmd) AS lo2, max(lat__cmd) AS hi2 FROM scored)"""
    ),
)
def agg_minmax_scale(spark, folder):
    scaled = relations.min_max_scale(scored(spark, folder).select(c.ID, c.SCORE_CITY, c.LAT), [c.SCORE_CITY, c.LAT])
    return rounded(scaled, 9, c.SCORE_CITY, c.LAT)


_NUNIQUE = [c.SCORE_CITY, "neighbors_count", "cluster", "is_error", c.LAT]


@check(
    "agg_nunique",
    with_cmd(" UNION ALL ".join(f"SELECT '{x}' AS column_name, count(DISTINCT {x}) AS n_distinct, count(DISTINCT {x}) <= 1 AS is_constant FROM scored" for x in _NUNIQUE)),
)
def agg_nunique(spark, folder):
    return relations.distinct_counts(scored(spark, folder), _NUNIQUE)


@check(
    "dq_relations",
    with_cmd(
        f"""SELECT column_1, column_2, pearson, kendall, nmi FROM
        ({matrix_sql(KENDALL_COLUMNS, lambda a, b: f"SELECT round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) FROM complete", "pearson", "scored")})
        JOIN ({matrix_sql(KENDALL_COLUMNS, lambda a, b: _kendall_sql(a, b).replace("FROM scored", "FROM complete"), "kendall", "scored")}) USING (column_1, column_2)
        JOIN ({matrix_sql(KENDALL_COLUMNS, _nmi_sql, "nmi", "scored")}) USING (column_1, column_2)""",
        f"{_COMPLETE}, {_CUTS}",
    ),
)
def dq_relations(spark, folder):
    base = scored(spark, folder).select(*FEATURES).dropna()
    parts = [
        rounded(relations.pearson(base, KENDALL_COLUMNS), 6, "pearson"),
        rounded(relations.kendall(base, KENDALL_COLUMNS), 9, "kendall"),
        rounded(relations.mutual_information(base, KENDALL_COLUMNS), 6, "nmi"),
    ]
    return parts[0].join(parts[1], ["column_1", "column_2"]).join(parts[2], ["column_1", "column_2"])
