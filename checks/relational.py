"""Checks of sources, projections, filters, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.fixtures import cmd, scored, with_cmd
from checks.registry import check
from checks.spelling import norm_sql, score_sql
from rowguard import config as c
from rowguard.functions import predicates as p
from rowguard.functions.geo import with_distance
from rowguard.functions.text import composite_score, jaro_winkler_score
from rowguard.operators import clusters, flags, metrics, ranking
from rowguard.session import shared_folder
from rowguard.sources import tables
from rowguard.sources.countries import COUNTRIES, with_country

FLAGS = ["swapped_geo", "shuffle_lat", "shuffle_long", "missing_geo", "typo_city"]


# -- sources and sinks -----------------------------------------------------------------


@check("src_table", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src_table(spark, folder):
    return tables.read_parquet(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])


_KNOWN = ", ".join(f"('{code}', '{name}')" for code, name in sorted(COUNTRIES.items()))


@check(
    "src_country_dim",
    f"""WITH dim(code, country_name) AS (VALUES {_KNOWN}),
    coded AS (SELECT c_custkey, upper(substr(n_name, 1, 2)) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT coded.c_custkey, coded.code, dim.country_name, dim.code IS NOT NULL AS is_known_country
    FROM coded LEFT JOIN dim ON dim.code = coded.code""",
)
def src_country_dim(spark, folder):
    customer = tables.read_parquet(spark, folder, "customer", ["c_custkey", "c_nationkey"])
    nation = tables.read_parquet(spark, folder, "nation", ["n_nationkey", "n_name"])
    coded = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return with_country(coded.select("c_custkey", F.upper(F.substring("n_name", 1, 2)).alias("code")), "code")


@check("snk_overwrite", with_cmd("SELECT city__cmd, id__cmd, lat__cmd FROM cmd"))
def snk_overwrite(spark, folder):
    name = tables.table_name("overwrite_check", "gb", "gold").replace(".", "_")
    out = cmd(spark, folder).select(c.CITY, c.ID, c.LAT)
    tables.overwrite_table(out, name, path=f"{shared_folder(spark)}/{name}", cluster_within=[c.CITY])
    return tables.read_table(spark, name)


@check("snk_report", with_cmd("SELECT cluster, count(*) AS n FROM scored GROUP BY cluster"))
def snk_report(spark, folder):
    return metrics.profile(scored(spark, folder), ["cluster"])


# -- projections and filters -------------------------------------------------------------


@check("prj_select", with_cmd("SELECT id__cmd, city__cmd, post_code__cmd FROM cmd"))
def prj_select(spark, folder):
    return cmd(spark, folder).select(c.ID, c.CITY, c.POST_CODE)


@check("prj_rename", with_cmd("SELECT id__cmd, city__cmd AS matched_city FROM cmd"))
def prj_rename(spark, folder):
    return cmd(spark, folder).select(c.ID, c.CITY).withColumnRenamed(c.CITY, "matched_city")


@check("prj_suffix", with_cmd("SELECT id__cmd AS id__cmd_2, city__cmd AS city__cmd_2 FROM cmd"))
def prj_suffix(spark, folder):
    return p.with_suffix(cmd(spark, folder).select(c.ID, c.CITY), "_2")


@check("prj_drop", with_cmd("SELECT id__cmd, city__cmd, true_city FROM cmd"))
def prj_drop(spark, folder):
    return cmd(spark, folder).drop(c.LAT, c.LONG, c.POST_CODE, *[x for x in FLAGS])


@check("prj_drop_prefix", with_cmd("SELECT id__cmd, city__cmd, true_city, lat__cmd, long__cmd, is_error, neighbors_count, is_isolated, is_anomaly, standardized_city, cluster FROM scored"))
def prj_drop_prefix(spark, folder):
    return p.drop_prefixed(scored(spark, folder), "S_Score")


@check("prj_const", with_cmd("SELECT id__cmd, 99 AS cluster FROM cmd WHERE lat__cmd IS NULL"))
def prj_const(spark, folder):
    return cmd(spark, folder).filter(F.col(c.LAT).isNull()).select(c.ID, F.lit(99).alias("cluster"))


def _assembled(spark, folder):
    ready = cmd(spark, folder).select(c.ID, c.LAT, c.LONG)
    return VectorAssembler(inputCols=[c.LAT, c.LONG], outputCol="features", handleInvalid="skip").transform(ready)


@check("prj_unpack", with_cmd("SELECT id__cmd, lat__cmd AS st_attr_0, long__cmd AS st_attr_1 FROM cmd WHERE lat__cmd IS NOT NULL AND long__cmd IS NOT NULL"))
def prj_unpack(spark, folder):
    unpacked = _assembled(spark, folder).withColumn("a", vector_to_array("features"))
    return unpacked.select(c.ID, *[F.col("a").getItem(i).alias(f"st_attr_{i}") for i in range(2)])


@check("flt_notnull", with_cmd("SELECT id__cmd, is_anomaly FROM scored WHERE is_anomaly IS NOT NULL"))
def flt_notnull(spark, folder):
    return scored(spark, folder).filter(F.col(c.LABEL).isNotNull()).select(c.ID, c.LABEL)


@check(
    "flt_dropna",
    with_cmd(
        """SELECT id__cmd, lat__cmd, neighbors_count, 'complete' AS part FROM scored WHERE lat__cmd IS NOT NULL AND neighbors_count IS NOT NULL
        UNION ALL SELECT id__cmd, lat__cmd, neighbors_count, 'incomplete' FROM scored WHERE lat__cmd IS NULL OR neighbors_count IS NULL"""
    ),
)
def flt_dropna(spark, folder):
    columns = [c.LAT, "neighbors_count"]
    base = scored(spark, folder).select(c.ID, *columns)
    complete = base.dropna(subset=columns).withColumn("part", F.lit("complete"))
    return complete.unionByName(base.filter(p.any_null(columns)).withColumn("part", F.lit("incomplete")))


@check("flt_flag", with_cmd("SELECT id__cmd, is_error, cluster FROM scored WHERE is_error AND cluster = 22"))
def flt_flag(spark, folder):
    return scored(spark, folder).filter(F.col("is_error") & (F.col("cluster") == 22)).select(c.ID, "is_error", "cluster")


@check(
    "flt_pair_ne",
    with_cmd(
        """SELECT a.g AS cluster, a.v AS "left", b.v AS "right" FROM vals a JOIN vals b ON a.g = b.g AND a.v < b.v
        WHERE levenshtein(a.v, b.v) <= 1""",
        "vals AS (SELECT DISTINCT cluster AS g, city__cmd AS v FROM scored)",
    ),
)
def flt_pair_ne(spark, folder):
    from rowguard.operators.matching import edit_neighbours

    return edit_neighbours(scored(spark, folder), c.CITY, 1, group="cluster").select("cluster", "left", "right")


# -- predicates, casts, fills --------------------------------------------------------------


@check(
    "prd_or_flags",
    with_cmd("SELECT id__cmd, coalesce(swapped_geo, false) OR coalesce(shuffle_lat, false) OR coalesce(lat__cmd > 40, false) AS is_error FROM cmd"),
)
def prd_or_flags(spark, folder):
    base = cmd(spark, folder).withColumn("is_north", F.col(c.LAT) > 40)
    return base.select(c.ID, p.any_true(["swapped_geo", "shuffle_lat", "is_north"]).alias("is_error"))


@check(
    "prd_first_true",
    with_cmd(
        """SELECT id__cmd, CASE WHEN swapped_geo THEN 1 WHEN shuffle_lat THEN 2 WHEN shuffle_long THEN 3
        WHEN missing_geo THEN 4 WHEN typo_city THEN 5 END AS index_error FROM cmd"""
    ),
)
def prd_first_true(spark, folder):
    return cmd(spark, folder).select(c.ID, p.first_true(FLAGS).alias("index_error"))


@check(
    "prd_case",
    with_cmd(
        """SELECT id__cmd, CASE WHEN city__cmd <> true_city AND city__cmd NOT LIKE '%?%' THEN 1
        WHEN city__cmd LIKE '%?%' THEN NULL ELSE 0 END AS apply_changes FROM cmd"""
    ),
)
def prd_case(spark, folder):
    unreadable = F.col(c.CITY).contains("?")
    change = F.when((F.col(c.CITY) != F.col("true_city")) & ~unreadable, 1).when(unreadable, None).otherwise(0)
    return cmd(spark, folder).select(c.ID, change.alias("apply_changes"))


@check("prd_regex_invalid", with_cmd("SELECT id__cmd, city__cmd IS NULL OR city__cmd LIKE '%?%' AS is_invalid FROM cmd"))
def prd_regex_invalid(spark, folder):
    return cmd(spark, folder).select(c.ID, p.is_invalid_name(c.CITY).alias("is_invalid"))


_TRUE_PAIRS = f"""true_pairs AS (SELECT DISTINCT city__cmd AS l, true_city AS r, {norm_sql('city__cmd')} AS ka, {norm_sql('true_city')} AS kb FROM cmd),
true_scores AS ({score_sql('true_pairs')})"""


# A name and a postcode are too unlike in length to pass 90, so the second column pair adds no row.
@check(
    "prd_fuzzy_any",
    with_cmd(
        """SELECT city__cmd, true_city, post_code__cmd, count(*) AS n FROM cmd JOIN true_scores ON l = city__cmd AND r = true_city
        WHERE score >= 92 GROUP BY city__cmd, true_city, post_code__cmd""",
        _TRUE_PAIRS,
    ),
)
def prd_fuzzy_any(spark, folder):
    pairs = cmd(spark, folder).groupBy(c.CITY, "true_city", c.POST_CODE).agg(F.count(F.lit(1)).alias("n"))
    return pairs.filter(p.fuzzy_any({c.CITY: ["true_city", c.POST_CODE]}, 92))


@check(
    "prd_threshold",
    with_cmd(
        "SELECT DISTINCT city__cmd, true_city FROM cmd WHERE jaro_winkler_similarity(city__cmd, true_city) * 100 >= 97"
    ),
)
def prd_threshold(spark, folder):
    pairs = cmd(spark, folder).select(c.CITY, "true_city").distinct()
    return pairs.filter(jaro_winkler_score(c.CITY, "true_city") >= 97)


@check(
    "prd_geo_valid",
    with_cmd(
        """SELECT id__cmd, coalesce(lat__cmd * 3e0 BETWEEN -90 AND 90 AND long__cmd * 6e0 BETWEEN -180 AND 180, false) AS is_valid FROM cmd"""
    ),
)
def prd_geo_valid(spark, folder):
    wide = cmd(spark, folder).select(c.ID, (F.col(c.LAT) * 3.0).alias("lat"), (F.col(c.LONG) * 6.0).cast("string").alias("long"))
    return wide.select(c.ID, p.is_valid_point("lat", "long").alias("is_valid"))


@check("cst_double", with_cmd("SELECT id__cmd, CAST(neighbors_count AS DOUBLE) AS neighbors_count, CAST(is_anomaly AS DOUBLE) AS is_anomaly FROM scored"))
def cst_double(spark, folder):
    return p.cast_double(scored(spark, folder).select(c.ID, "neighbors_count", c.LABEL), ["neighbors_count", c.LABEL])


@check("fil_null", with_cmd("SELECT id__cmd, coalesce(neighbors_count, 0) AS neighbors_count, lat__cmd FROM scored"))
def fil_null(spark, folder):
    return scored(spark, folder).select(c.ID, "neighbors_count", c.LAT).fillna(0, subset=["neighbors_count"])


@check("fil_coalesce", with_cmd("SELECT id__cmd, coalesce(neighbors_count, cluster) AS code FROM scored"))
def fil_coalesce(spark, folder):
    return scored(spark, folder).select(c.ID, F.coalesce("neighbors_count", "cluster").alias("code"))


@check(
    "fil_max_plus_one",
    with_cmd("SELECT id__cmd, coalesce(neighbors_count, (SELECT max(neighbors_count) FROM scored) + 1) AS neighbors_count FROM scored"),
)
def fil_max_plus_one(spark, folder):
    return p.fill_max_plus_one(scored(spark, folder).select(c.ID, "neighbors_count"), "neighbors_count")


# -- sorts and top-k -----------------------------------------------------------------------


@check("srt_cluster", with_cmd("SELECT cluster, city__cmd, count(*) AS n FROM scored GROUP BY ALL ORDER BY cluster, city__cmd"))
def srt_cluster(spark, folder):
    return metrics.profile(scored(spark, folder), ["cluster", c.CITY]).orderBy("cluster", c.CITY)


@check("srt_score", with_cmd("SELECT id__cmd, S_Score_coordinates FROM scored ORDER BY S_Score_coordinates, id__cmd"))
def srt_score(spark, folder):
    return scored(spark, folder).select(c.ID, c.SCORE_COORDS).orderBy(c.SCORE_COORDS, c.ID)


_TOP = with_cmd(
    """SELECT id__cmd, rank() OVER (ORDER BY S_Score_coordinates) <= 5 AS top_5,
    rank() OVER (ORDER BY S_Score_city) <= 1000 AS top_1000 FROM scored"""
)


@check("top_k_ties", _TOP)
def top_k_ties(spark, folder):
    base = scored(spark, folder)
    return base.select(
        c.ID,
        ranking.within_top_k(base, c.SCORE_COORDS, 5).alias("top_5"),
        ranking.within_top_k(base, c.SCORE_CITY, 1000).alias("top_1000"),
    )


@check(
    "win_global_rank",
    with_cmd(
        """SELECT id__cmd, rank() OVER (ORDER BY S_Score_coordinates) <= 5 AS is_anomaly_coords,
        rank() OVER (ORDER BY S_Score_city_cluster) <= 1000 AND NOT is_isolated AS is_anomaly_city_cluster,
        rank() OVER (ORDER BY S_Score_city) <= 1000 AND NOT is_isolated AS is_anomaly_city FROM scored"""
    ),
)
def win_global_rank(spark, folder):
    flagged = flags.flag_top_k(scored(spark, folder))
    return flagged.select(c.ID, "is_anomaly_coords", "is_anomaly_city_cluster", "is_anomaly_city")


# -- set operations ------------------------------------------------------------------------


@check("set_union", with_cmd("SELECT city__cmd FROM cmd UNION SELECT true_city FROM cmd"))
def set_union(spark, folder):
    base = cmd(spark, folder)
    return base.select(c.CITY).union(base.select("true_city")).distinct()


@check(
    "set_union_append",
    with_cmd("SELECT min(cluster) AS cluster, true_city AS word FROM scored GROUP BY true_city"),
)
def set_union_append(spark, folder):
    from rowguard.operators.encoding import encode_dictionary

    return encode_dictionary(scored(spark, folder), "true_city", "cluster").select("cluster", "word")


@check(
    "set_union_byname",
    with_cmd(
        """SELECT id__cmd, lat__cmd, 99 AS cluster FROM cmd WHERE lat__cmd IS NULL
        UNION ALL SELECT id__cmd, NULL, cluster FROM scored WHERE lat__cmd IS NOT NULL"""
    ),
)
def set_union_byname(spark, folder):
    missing = cmd(spark, folder).filter(F.col(c.LAT).isNull()).select(c.ID, c.LAT, F.lit(99).alias("cluster"))
    placed = scored(spark, folder).filter(F.col(c.LAT).isNotNull()).select("cluster", c.ID)
    return missing.unionByName(placed, allowMissingColumns=True)


# -- scalar functions and pair jobs --------------------------------------------------------


@check(
    "fn_levenshtein",
    with_cmd("SELECT DISTINCT city__cmd, true_city, CAST(levenshtein(city__cmd, true_city) AS INT) AS distance FROM cmd"),
)
def fn_levenshtein(spark, folder):
    pairs = cmd(spark, folder).select(c.CITY, "true_city").distinct()
    return pairs.withColumn("distance", F.levenshtein(c.CITY, "true_city"))


@check(
    "job_pair_scores_jw",
    with_cmd("SELECT DISTINCT city__cmd, true_city, round(jaro_winkler_similarity(city__cmd, true_city) * 100, 6) AS score FROM cmd"),
)
def job_pair_scores_jw(spark, folder):
    pairs = cmd(spark, folder).select(c.CITY, "true_city").distinct()
    return pairs.withColumn("score", F.round(jaro_winkler_score(c.CITY, "true_city"), 6))


@check("job_pair_scores_composite", with_cmd("SELECT l AS city__cmd, r AS true_city, score FROM true_scores", _TRUE_PAIRS))
def job_pair_scores_composite(spark, folder):
    pairs = cmd(spark, folder).select(c.CITY, "true_city").distinct()
    return pairs.withColumn("score", composite_score(c.CITY, "true_city"))


# Vincenty's inverse formula, one row per pair and iteration; these pairs settle within a few.
_GEODESIC = """consts AS (SELECT 6378137e0 AS a, 1 / 298.257223563e0 AS f, 6378137e0 * (1 - 1 / 298.257223563e0) AS b),
centers AS (SELECT post_code__cmd, avg(lat__cmd) AS clat, avg(long__cmd) AS clong FROM cmd GROUP BY post_code__cmd),
reduced AS (SELECT id__cmd, f, atan((1 - f) * tan(radians(lat__cmd))) AS u1, atan((1 - f) * tan(radians(clat))) AS u2,
            radians(clong - long__cmd) AS span FROM cmd JOIN centers USING (post_code__cmd), consts WHERE lat__cmd IS NOT NULL),
turns AS (SELECT id__cmd, f, u1, u2, span, span AS lam, 0 AS n FROM reduced
          UNION ALL
          SELECT id__cmd, f, u1, u2, span, span + (1 - k) * f * sa * (sig + k * ss * (mid + k * cs * (2 * mid * mid - 1))), n + 1 FROM
          (SELECT *, f / 16 * ca2 * (4 + f * (4 - 3 * ca2)) AS k FROM
           (SELECT *, CASE WHEN ca2 > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / ca2 ELSE 0e0 END AS mid FROM
            (SELECT *, atan2(ss, cs) AS sig, 1 - sa * sa AS ca2 FROM
             (SELECT *, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0e0 END AS sa FROM
              (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
                      sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM turns WHERE n < 12))))) WHERE n < 12),
lengths AS (SELECT id__cmd, b * big_a * (sig - big_b * ss * (mid + big_b / 4 * (cs * (2 * mid * mid - 1)
              - big_b / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))) AS d FROM
           (SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS big_a,
                   usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS big_b FROM
            (SELECT *, CASE WHEN ca2 > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / ca2 ELSE 0e0 END AS mid, ca2 * (a * a - b * b) / (b * b) AS usq FROM
             (SELECT *, atan2(ss, cs) AS sig, 1 - sa * sa AS ca2 FROM
              (SELECT *, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0e0 END AS sa FROM
               (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
                       sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM turns WHERE n = 12))), consts)))"""


@check("job_pair_distance", with_cmd("SELECT id__cmd, round(d, 2) AS distance_m FROM cmd LEFT JOIN lengths USING (id__cmd)", _GEODESIC))
def job_pair_distance(spark, folder):
    base = cmd(spark, folder).select(c.ID, c.POST_CODE, c.LAT, c.LONG)
    pairs = base.join(clusters.centroids(base, c.POST_CODE), c.POST_CODE)
    return with_distance(pairs, c.LAT, c.LONG, "centroid_lat", "centroid_long").select(c.ID, "distance_m")


@check("fn_concat_marker", with_cmd("SELECT id__cmd, city__cmd || ' *' AS marked FROM cmd"))
def fn_concat_marker(spark, folder):
    return cmd(spark, folder).select(c.ID, p.marked(c.CITY).alias("marked"))


@check("fn_regex", with_cmd("SELECT id__cmd, contains(city__cmd, '?') AS has_mark FROM cmd"))
def fn_regex(spark, folder):
    return cmd(spark, folder).select(c.ID, F.col(c.CITY).contains("?").alias("has_mark"))


# Rounding half away from zero acts on the written decimal of a double, so SQL rounds that decimal.
@check("fn_abs_round", with_cmd("SELECT id__cmd, CAST(round(CAST(CAST(abs(S_Score_city) AS VARCHAR) AS DECIMAL(24, 20)), 2) AS DOUBLE) AS size FROM scored"))
def fn_abs_round(spark, folder):
    return scored(spark, folder).select(c.ID, F.round(F.abs(c.SCORE_CITY), 2).alias("size"))


@check("fn_radius", with_cmd("SELECT id__cmd, abs(S_Score_coordinates) * 15 AS radius FROM scored"))
def fn_radius(spark, folder):
    return scored(spark, folder).select(c.ID, p.marker_radius(c.SCORE_COORDS).alias("radius"))


@check(
    "fn_vector",
    with_cmd("SELECT id__cmd, 2 AS n_features, long__cmd AS second FROM cmd WHERE lat__cmd IS NOT NULL AND long__cmd IS NOT NULL"),
)
def fn_vector(spark, folder):
    unpacked = _assembled(spark, folder).withColumn("a", vector_to_array("features"))
    return unpacked.select(c.ID, F.size("a").alias("n_features"), F.col("a").getItem(1).alias("second"))


@check("fn_log2", with_cmd("SELECT round(log2(count(DISTINCT city__cmd)), 9) AS bits FROM cmd"))
def fn_log2(spark, folder):
    distinct = cmd(spark, folder).select(c.CITY).distinct()
    return distinct.agg(F.round(F.log2(F.count(c.CITY)), 9).alias("bits"))


@check("fn_null", with_cmd("SELECT id__cmd, lat__cmd IS NULL AS no_lat, neighbors_count IS NOT NULL AS has_count, CAST(coalesce(neighbors_count, -1) AS VARCHAR) AS label FROM scored"))
def fn_null(spark, folder):
    return scored(spark, folder).select(
        c.ID,
        F.col(c.LAT).isNull().alias("no_lat"),
        F.col("neighbors_count").isNotNull().alias("has_count"),
        F.coalesce("neighbors_count", F.lit(-1)).cast("string").alias("label"),
    )


@check("udf_scalar", with_cmd("SELECT city__cmd, true_city, count(*) AS n, round(jaro_winkler_similarity(city__cmd, true_city) * 100, 6) AS score FROM cmd GROUP BY ALL"))
def udf_scalar(spark, folder):
    pairs = cmd(spark, folder).groupBy(c.CITY, "true_city").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("score", F.round(jaro_winkler_score(c.CITY, "true_city"), 6))
