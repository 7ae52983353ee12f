"""Checks of category matching: neighbours, components, proposals, details, standard names.

SQL can restate the rule "edit distance at most 1 and Jaro-Winkler at least 0.97" and the
components as a recursive query; the composite similarity has no SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import cmd, scored, with_cmd
from checks.registry import check
from rowguard import config as c
from rowguard.operators import components, matching, metrics, proposals, ranking
from rowguard.plans import standardisation
from rowguard.session import cut_lineage
from rowguard.sources.tables import read_parquet

EDGES = """
vals AS (SELECT DISTINCT city__cmd AS v FROM cmd),
edges AS (SELECT a.v AS l, b.v AS r, jaro_winkler_similarity(a.v, b.v) * 100 AS jw FROM vals a JOIN vals b ON a.v < b.v
          WHERE levenshtein(a.v, b.v) <= 1 AND jaro_winkler_similarity(a.v, b.v) >= 0.97),
both_ways AS (SELECT l AS a, r AS b, jw FROM edges UNION ALL SELECT r, l, jw FROM edges)
"""
MEMBERS = (
    EDGES
    + """,
reach AS (SELECT a AS v, a AS m FROM both_ways UNION SELECT reach.v, b FROM reach JOIN both_ways ON reach.m = both_ways.a),
labels AS (SELECT v, min(m) AS head FROM reach GROUP BY v),
members AS (SELECT v AS city__cmd, head, CAST(dense_rank() OVER (ORDER BY head) - 1 AS INT) AS cluster FROM labels)
"""
)
FREQUENCY = MEMBERS + ", freq AS (SELECT city__cmd, count(city__cmd) AS city_count FROM cmd GROUP BY city__cmd)"
COUNTED = FREQUENCY + ", counted AS (SELECT city__cmd, cluster, city_count FROM members JOIN freq USING (city__cmd))"
RANKED = (
    COUNTED
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY city_count DESC, city__cmd) AS rn,
    count(*) OVER (PARTITION BY cluster, city_count) AS tied FROM counted),
won AS (SELECT cluster, city__cmd AS proposed_city FROM ranked WHERE rn = 1 AND tied = 1)"""
)
STACKED = (
    RANKED
    + """, stacked AS (SELECT city__cmd, counted.cluster, city_count,
    CASE WHEN proposed_city IS NULL OR proposed_city LIKE '%?%' THEN 'to be manually selected' ELSE proposed_city END AS proposed_city
    FROM counted LEFT JOIN won ON won.cluster = counted.cluster)"""
)
STANDARD = (
    STACKED
    + """, named AS (SELECT city__cmd, CASE WHEN proposed_city = 'to be manually selected'
    THEN min(city__cmd) OVER (PARTITION BY cluster) || ' *' ELSE proposed_city END AS standardized_city FROM stacked)"""
)




def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'))"


def words_sql(key: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({key}, ' '), lambda w: w <> '')))"


def common_sql(a: str, b: str) -> str:
    """Longest common subsequence: one table row per character of ``a``, each a running maximum."""
    cell = f"greatest(line[q], CASE WHEN {b}[q] = ch THEN coalesce(line[q - 1], 0) + 1 ELSE 0 END)"
    row = f"list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: {cell})))"
    start = f"list_transform(range(1, length({b}) + 1), lambda z: 0::BIGINT)"
    folded = f"list_reduce(list_concat([{start}], list_transform(string_split({a}, ''), lambda c: [ascii(c)::BIGINT])), lambda line, c: "
    return folded + row.replace("= ch", "= chr(c[1]::INT)") + ")[-1]"


def score_sql(source: str) -> str:
    """``l, r, score`` of pairs ``l, r, ka, kb`` whose lengths are comparable."""
    ratio = "floor(200e0 * {n} / ({x} + {y}) + 0.5e0)"
    plain = ratio.format(n=common_sql("ka", "kb"), x="length(ka)", y="length(kb)")
    ordered = ratio.format(n=common_sql("sa", "sb"), x="length(sa)", y="length(sb)")
    shared = "greatest({}, {})".format(*[ratio.format(n="length(s0)", x="length(s0)", y=f"length({s})") for s in ("sa", "sb")])
    own = ratio.format(n=common_sql("la", "lb"), x="length(la)", y="length(lb)")
    first = "list_sort(list_intersect(ta, tb))"
    rest = "list_filter({}, lambda w: NOT list_contains({}, w))"
    return f"""SELECT l, r, floor(greatest({plain}, 0.95e0 * {ordered}, CASE WHEN s0 = '' THEN 0e0 ELSE 0.95e0 * greatest({shared}, {own}) END) + 0.5e0) AS score
    FROM (SELECT *, array_to_string(ta, ' ') AS sa, array_to_string(tb, ' ') AS sb, array_to_string({first}, ' ') AS s0,
                 array_to_string(list_concat({first}, {rest.format("ta", "tb")}), ' ') AS la, array_to_string(list_concat({first}, {rest.format("tb", "ta")}), ' ') AS lb
          FROM (SELECT *, {words_sql('ka')} AS ta, {words_sql('kb')} AS tb FROM {source}))
    WHERE greatest(length(ka), length(kb)) < 1.5e0 * least(length(ka), length(kb))"""


SIMILAR = f"""names AS (SELECT DISTINCT city__cmd AS v, {norm_sql('city__cmd')} AS k FROM cmd WHERE city__cmd IS NOT NULL),
name_pairs AS (SELECT a.v AS l, b.v AS r, a.k AS ka, b.k AS kb FROM names a JOIN names b ON a.v < b.v WHERE a.k <> '' AND b.k <> ''),
rated_pairs AS ({score_sql('name_pairs')}),
best AS (SELECT value, matched, score FROM (SELECT value, matched, score, row_number() OVER (PARTITION BY value ORDER BY score DESC, matched) AS rn
         FROM (SELECT l AS value, r AS matched, score FROM rated_pairs UNION ALL SELECT r, l, score FROM rated_pairs) WHERE score >= 92) WHERE rn = 1)"""


def _members(records):
    return cut_lineage(components.numbered_components(matching.spelling_edges(records)))


def _counted(records):
    return proposals.stack(_members(records), records)


def _stacked(records):
    return proposals.propose(_counted(records))


@check("agg_distinct", with_cmd("SELECT DISTINCT city__cmd FROM cmd"))
def agg_distinct(spark, folder):
    return cmd(spark, folder).select(c.CITY).distinct()


@check("agg_freq", with_cmd("SELECT city__cmd, count(city__cmd) AS city_count FROM cmd GROUP BY city__cmd"))
def agg_freq(spark, folder):
    return proposals.frequencies(cmd(spark, folder))


@check(
    "jn_self_distance",
    with_cmd(
        """SELECT a.v AS "left", b.v AS "right", CAST(levenshtein(a.v, b.v) AS INT) AS distance FROM vals a JOIN vals b ON a.v < b.v
        WHERE levenshtein(a.v, b.v) <= 2""",
        "vals AS (SELECT DISTINCT city__cmd AS v FROM cmd)",
    ),
)
def jn_self_distance(spark, folder):
    return matching.edit_neighbours(cmd(spark, folder), c.CITY, 2)


@check(
    "jn_best_match_spelling",
    with_cmd(
        """SELECT a AS value, b AS matched, round(jw, 6) AS similarity_score_jellyfish FROM
        (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jw DESC, b) AS rn FROM both_ways) WHERE rn = 1""",
        EDGES,
    ),
)
def jn_best_match_spelling(spark, folder):
    best = matching.closest_spelling(matching.spelling_edges(cmd(spark, folder)))
    return best.withColumn("similarity_score_jellyfish", F.round("similarity_score_jellyfish", 6))


@check("jn_best_match", with_cmd("SELECT value, matched, score AS similarity_score_fuzzy FROM best", SIMILAR))
def jn_best_match(spark, folder):
    return matching.best_matches(cmd(spark, folder))


@check(
    "dq_match_pairs",
    with_cmd(
        """SELECT value AS city__cmd, matched AS matched_city, score AS similarity_score_fuzzy,
        round(jaro_winkler_similarity(value, matched) * 100, 6) AS similarity_score_jellyfish FROM best
        WHERE jaro_winkler_similarity(value, matched) * 100 >= 85""",
        SIMILAR,
    ),
)
def dq_match_pairs(spark, folder):
    pairs = matching.match_pairs(cmd(spark, folder))
    return pairs.withColumn("similarity_score_jellyfish", F.round("similarity_score_jellyfish", 6))


def _theta(spark, folder, rate):
    observed = cmd(spark, folder).groupBy(c.CITY).agg(F.count(F.lit(1)).alias("city_count"))
    names = read_parquet(spark, folder, "part", ["p_name"]).groupBy("p_name").agg(F.count(F.lit(1)).alias("parts"))
    return matching.fuzzy_join(observed, names, {c.CITY: ["p_name"]}, rate)


def _theta_sql(rate: int) -> str:
    return with_cmd(
        f"SELECT l AS city__cmd, city_count, r AS p_name, parts FROM theta JOIN observed ON city__cmd = l JOIN named_parts ON p_name = r WHERE score >= {rate}",
        f"""observed AS (SELECT city__cmd, count(*) AS city_count FROM cmd GROUP BY city__cmd),
        named_parts AS (SELECT p_name, count(*) AS parts FROM part GROUP BY p_name),
        theta_pairs AS (SELECT city__cmd AS l, p_name AS r, {norm_sql('city__cmd')} AS ka, {norm_sql('p_name')} AS kb FROM observed, named_parts),
        theta AS ({score_sql('theta_pairs')} UNION ALL
        SELECT l, r, 86 FROM theta_pairs WHERE greatest(length(ka), length(kb)) BETWEEN 1.5e0 * least(length(ka), length(kb)) AND 8e0 * least(length(ka), length(kb))
        AND list_has_any({words_sql('ka')}, {words_sql('kb')}))""",
    )


@check("jn_fuzzy_theta", _theta_sql(92))
def jn_fuzzy_theta(spark, folder):
    return _theta(spark, folder, c.FUZZY_THRESHOLD)


@check("jn_fuzzy_theta_85", _theta_sql(85))
def jn_fuzzy_theta_85(spark, folder):
    """A rate within reach of substrings: names of very different length match on a word in common."""
    return _theta(spark, folder, 85.0)


@check("agg_components", with_cmd("SELECT v AS value, head AS component FROM labels", MEMBERS))
def agg_components(spark, folder):
    return components.components(matching.spelling_edges(cmd(spark, folder)))


NAME_EDGES = """names AS (SELECT c_name AS v FROM customer),
near AS (SELECT a.v AS l, b.v AS r, levenshtein(a.v, b.v) AS d FROM names a JOIN names b ON a.v < b.v WHERE levenshtein(a.v, b.v) <= 1),
ends AS (SELECT l AS a, r AS b FROM near UNION ALL SELECT r, l FROM near)"""


@check("jn_self_distance_names", with_cmd('SELECT l AS "left", r AS "right", CAST(d AS INT) AS distance FROM near', NAME_EDGES))
def jn_self_distance_names(spark, folder):
    """Neighbours in a dictionary that grows with the data."""
    return matching.edit_neighbours(read_parquet(spark, folder, "customer", ["c_name"]), "c_name", 1)


@check(
    "agg_components_names",
    with_cmd(
        "SELECT v AS value, min(head) AS component FROM walk GROUP BY v",
        NAME_EDGES + ", walk AS (SELECT v, v AS head FROM (SELECT min(a) AS v FROM ends) UNION SELECT ends.b, walk.head FROM walk JOIN ends ON walk.v = ends.a)",
    ),
)
def agg_components_names(spark, folder):
    """One component of all names: whoever has a neighbour is reached from the smallest."""
    names = read_parquet(spark, folder, "customer", ["c_name"])
    return components.components(matching.edit_neighbours(names, "c_name", 1))


@check("dq_clusters", with_cmd("SELECT city__cmd, cluster, city_count FROM counted", COUNTED))
def dq_clusters(spark, folder):
    return _counted(cmd(spark, folder)).select(c.CITY, c.CLUSTER, "city_count")


@check("jn_counts", with_cmd("SELECT city__cmd, head, city_count FROM members JOIN freq USING (city__cmd)", FREQUENCY))
def jn_counts(spark, folder):
    records = cmd(spark, folder)
    named = components.components(matching.spelling_edges(records)).select(F.col("value").alias(c.CITY), F.col("component").alias("head"))
    return named.join(proposals.frequencies(records), c.CITY)


@check(
    "win_rank_in_cluster",
    with_cmd("SELECT cluster, city__cmd, city_count FROM ranked WHERE rn = 1", RANKED),
)
def win_rank_in_cluster(spark, folder):
    counted = _counted(cmd(spark, folder))
    return ranking.first_per_group(counted, [c.CLUSTER], [F.desc("city_count"), F.col(c.CITY)]).select(c.CLUSTER, c.CITY, "city_count")


@check("win_tie_count", with_cmd("SELECT city__cmd, cluster, city_count, tied FROM ranked", RANKED))
def win_tie_count(spark, folder):
    counted = _counted(cmd(spark, folder))
    ties = metrics.profile(counted, [c.CLUSTER, "city_count"]).withColumnRenamed("n", "tied")
    return counted.join(ties, [c.CLUSTER, "city_count"]).select(c.CITY, c.CLUSTER, "city_count", "tied")


@check("win_unique_winner", with_cmd("SELECT cluster, proposed_city FROM won", RANKED))
def win_unique_winner(spark, folder):
    return proposals.winners(_counted(cmd(spark, folder)))


@check(
    "jn_proposal",
    with_cmd("SELECT city__cmd, counted.cluster, proposed_city FROM counted LEFT JOIN won ON won.cluster = counted.cluster", RANKED),
)
def jn_proposal(spark, folder):
    counted = cut_lineage(_counted(cmd(spark, folder)))
    return counted.join(proposals.winners(counted), c.CLUSTER, "left").select(c.CITY, c.CLUSTER, "proposed_city")


@check("dq_propose", with_cmd("SELECT city__cmd, cluster, city_count, proposed_city FROM stacked", STACKED))
def dq_propose(spark, folder):
    return _stacked(cmd(spark, folder)).select(c.CITY, c.CLUSTER, "city_count", "proposed_city")


_DETAILS = """SELECT id__cmd, cmd.city__cmd, post_code__cmd, cluster, city_count, proposed_city,
CASE WHEN proposed_city = 'to be manually selected' THEN NULL WHEN cmd.city__cmd <> proposed_city THEN 1 ELSE 0 END AS apply_changes
FROM cmd JOIN stacked ON cmd.city__cmd = stacked.city__cmd"""
_DETAIL_COLUMNS = [c.ID, c.CITY, c.POST_CODE, c.CLUSTER, "city_count", "proposed_city", "apply_changes"]


@check("dq_details", with_cmd(_DETAILS, STACKED))
def dq_details(spark, folder):
    return standardisation.by_spelling(cmd(spark, folder)).details.select(*_DETAIL_COLUMNS)


@check("jn_details", with_cmd("SELECT id__cmd, cmd.city__cmd, cluster, proposed_city FROM cmd JOIN stacked ON cmd.city__cmd = stacked.city__cmd", STACKED))
def jn_details(spark, folder):
    records = cmd(spark, folder)
    return proposals.details(records.select(c.ID, c.CITY), _stacked(records)).select(c.ID, c.CITY, c.CLUSTER, "proposed_city")


@check("win_first_any", with_cmd("SELECT city__cmd, min(city__cmd) OVER (PARTITION BY cluster) AS first_city FROM stacked", STACKED))
def win_first_any(spark, folder):
    stacked = cut_lineage(_stacked(cmd(spark, folder)))
    return stacked.join(stacked.groupBy(c.CLUSTER).agg(F.min(c.CITY).alias("first_city")), c.CLUSTER).select(c.CITY, "first_city")


_STANDARDISED = """SELECT id__cmd, cmd.city__cmd, coalesce(standardized_city, cmd.city__cmd) AS standardized_city
FROM cmd LEFT JOIN named ON named.city__cmd = cmd.city__cmd"""


@check("dq_standardise", with_cmd(_STANDARDISED, STANDARD))
def dq_standardise(spark, folder):
    records = cmd(spark, folder)
    return proposals.standardise(records, _stacked(records)).select(c.ID, c.CITY, c.STANDARD)


@check(
    "jn_standardise",
    with_cmd("SELECT id__cmd, lat__cmd, cmd.city__cmd, standardized_city FROM cmd LEFT JOIN named ON named.city__cmd = cmd.city__cmd", STANDARD),
)
def jn_standardise(spark, folder):
    records = cmd(spark, folder)
    names = proposals.standard_names(_stacked(records))
    return records.select(c.ID, c.LAT, c.CITY).join(names, c.CITY, "left")


SIMILAR_EDGES = (
    SIMILAR
    + """, both_ways AS (SELECT value AS a, matched AS b FROM best WHERE jaro_winkler_similarity(value, matched) * 100 >= 85
    UNION ALL SELECT matched, value FROM best WHERE jaro_winkler_similarity(value, matched) * 100 >= 85)"""
)


@check("dq_standardise_similarity", with_cmd(_STANDARDISED, STANDARD.replace(EDGES, SIMILAR_EDGES)))
def dq_standardise_similarity(spark, folder):
    records = cmd(spark, folder)
    return proposals.standardise(records, standardisation.by_similarity(records).stacked).select(c.ID, c.CITY, c.STANDARD)


@check(
    "win_mode",
    with_cmd(
        """SELECT city__cmd, cluster AS most_common_cluster FROM (SELECT city__cmd, cluster,
        row_number() OVER (PARTITION BY city__cmd ORDER BY count(*) DESC, cluster) AS rn FROM scored GROUP BY city__cmd, cluster) WHERE rn = 1"""
    ),
)
def win_mode(spark, folder):
    from rowguard.operators.clusters import pair_counts

    counts = pair_counts(scored(spark, folder), c.CITY, "cluster")
    first = ranking.first_per_group(counts, [c.CITY], [F.desc("count"), F.col("cluster")])
    return first.select(c.CITY, F.col("cluster").alias("most_common_cluster"))


