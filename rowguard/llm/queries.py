"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowguard.llm import (
    exact_dedup,
    fill_middle,
    hashing_index,
    kneser_ney,
    mixing,
    packing,
    periodic_runs,
    pseudonyms,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    trie_scores,
)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def mixing_ipf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    rated = mixing.rated_documents(docs, share=None)
    probability = F.round("probability", 9)
    return rated.select(
        F.col("_in_0").alias("doc_id"),
        F.col("_in_2").alias("source"),
        F.col("_in_3").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.round("probability", 6).alias("probability"),
        (mixing.draw(F.col("_in_0"), F.col("_in_1")) < probability).alias("sampled"),
    )


MIXING_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         coalesce(text, '') AS body
  FROM documents
), topics AS (
  SELECT doc_id, source, lang, n_tokens, sha256(body) AS digest,
         CASE WHEN contains(body, 'icense') THEN 'legal' WHEN contains(body, ' | ') THEN 'table'
              WHEN contains(body, '$$$') OR contains(body, '###') THEN 'noise'
              WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic
  FROM docs
), cells AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM topics GROUP BY ALL
), targets AS (
  SELECT *, pow(sum(tokens) OVER (PARTITION BY source), 0.8) AS ts, pow(sum(tokens) OVER (PARTITION BY lang), 0.8) AS tl,
         pow(sum(tokens) OVER (PARTITION BY topic), 0.8) AS tt,
         count(*) OVER (PARTITION BY source) AS ns, count(*) OVER (PARTITION BY lang) AS nl, count(*) OVER (PARTITION BY topic) AS nt
  FROM cells
), shares AS (
  SELECT source, lang, topic, tokens, ts / sum(ts / ns) OVER () AS ts, tl / sum(tl / nl) OVER () AS tl, tt / sum(tt / nt) OVER () AS tt
  FROM targets
), raked AS (
  SELECT 0 AS k, *, tokens AS w FROM shares
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, ts, tl, tt, w * tt / sum(w) OVER (PARTITION BY topic)
  FROM (SELECT * REPLACE (w * tl / sum(w) OVER (PARTITION BY lang) AS w)
        FROM (SELECT * REPLACE (w * ts / sum(w) OVER (PARTITION BY source) AS w) FROM raked WHERE k < 40))
), rates AS (
  SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS p FROM raked WHERE k = 40
)
SELECT doc_id, t.source, t.lang, t.topic, n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5('mix:' || doc_id::VARCHAR || ':' || t.digest), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < round(p, 9) AS sampled
FROM topics t JOIN rates r
  ON t.source IS NOT DISTINCT FROM r.source AND t.lang IS NOT DISTINCT FROM r.lang AND t.topic = r.topic
"""


def simhash_ball(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxicity_subwords(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    return toxicity.scores(docs, toxicity.fit(docs, labels)).withColumnRenamed("id", "doc_id")


def exact_refinement(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_read(spark, folder, "documents"), hash_all=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def packing_gga(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_read(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def quality_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    judged = kneser_ney.judged(_read(spark, folder, "documents"), _read(spark, folder, "labels"))
    return judged.withColumnRenamed("id", "doc_id")


def nearest_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return hashing_index.nearest(_read(spark, folder, "embeddings"), F.col("id") % 100 == 0)


def pseudonyms_feistel(spark: SparkSession, folder: str) -> DataFrame:
    changed = pseudonyms.pseudonymised(_read(spark, folder, "documents"), pseudonyms.SAMPLE_KEY)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).alias(f"n_{k}") for k in pseudonyms.KINDS]
    return changed.select(F.col("id").alias("doc_id"), *counts, "spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def scores_trie(spark: SparkSession, folder: str) -> DataFrame:
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    scored, _ = trie_scores.trie_scores(_read(spark, folder, "documents"), training, order=3)
    return scored.withColumnRenamed("id", "doc_id")


def suffix_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_read(spark, folder, "documents")).drop("spans").withColumnRenamed("id", "doc_id")

def periodic_runs_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(0))
    cut_up = docs.select("doc_id", "text", F.when(h % 10 == 0, own).alias("own"), F.floor(h / 10).alias("g")).withColumn("n", F.size("own"))
    # Planted periods: the words from number a on repeat their first p.
    a = F.col("g") % F.col("n")
    placed = cut_up.withColumn("a", F.when(F.col("n") > 0, a).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    unit = F.slice("own", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("own", F.lit(1), F.col("a")), tail), " ")
    texts = placed.select("doc_id", F.coalesce(F.when(F.col("n") > 0, planted), "text").alias("text"))
    found = periodic_runs.periodic_runs(texts)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # Whole numbers tell lengths over periods apart exactly; runs are in the order that ties ask for.
    best = F.aggregate(
        F.col("runs"), F.element_at("runs", 1), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    )
    digests = found.select(
        "id",
        F.size("runs").cast("long").alias("n_runs"),
        F.when(F.size("runs") > 0, best).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return digests.select(
        F.col("id").alias("doc_id"),
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def fill_middle_query(spark: SparkSession, folder: str) -> DataFrame:
    cut_up = fill_middle.fill_in_middle(_read(spark, folder, "documents"))
    return cut_up.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


FILL_MIDDLE_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), drawn AS (
  SELECT doc_id, body, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM docs
), cut AS (
  SELECT doc_id, body, n, form, least(c1, c2) AS a, greatest(c1, c2) AS b FROM drawn
), parts AS (
  SELECT *, substr(body, 1, a) AS prefix, substr(body, a + 1, b - a) AS middle, substr(body, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""


def sharding_minimax(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.sharded(_read(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SHARDING_SQL = """
WITH RECURSIVE steps AS (
  SELECT 0 AS k, i, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS words FROM steps WHERE k = 8
), docs AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, sha256(coalesce(text, '')) AS digest,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
                         lambda a, b: xor(a >> 8, words[(xor(a, b) & 255)::BIGINT + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc
), groups AS MATERIALIZED (
  SELECT digest, sum(size)::BIGINT AS bytes, count(*) AS n FROM docs GROUP BY digest
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, digest) AS k,
         sum(bytes) OVER () - coalesce(sum(bytes) OVER (ORDER BY bytes DESC, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM groups
), peeled AS MATERIALIZED (
  SELECT digest, bytes, n, k, k < 24 AND bool_and(bytes * (25 - k) > rest) OVER (ORDER BY k) AS alone FROM ranked
), sums AS MATERIALIZED (
  SELECT digest, bytes, n, sum(bytes) OVER (ORDER BY digest)::BIGINT AS till, sum(n) OVER (ORDER BY digest)::BIGINT AS row_till FROM peeled WHERE NOT alone
), whole AS MATERIALIZED (
  SELECT (SELECT sum(bytes)::BIGINT FROM sums) AS total, (24 - (SELECT count(*) FROM peeled WHERE alone))::BIGINT AS shards
), search AS (
  SELECT (total + shards - 1) // shards AS low, total AS high, 0::BIGINT AS j, 0::BIGINT AS spot, total, shards FROM whole
  UNION ALL
  SELECT CASE WHEN failed THEN mid + 1 ELSE low END, CASE WHEN passed THEN mid ELSE high END,
         CASE WHEN passed OR failed THEN 0 ELSE j + 1 END, CASE WHEN passed OR failed THEN 0 ELSE reached END, total, shards
  FROM (SELECT *, spot + mid >= total AS passed, spot + mid < total AND (j + 1 >= shards OR reached <= spot) AS failed
        FROM (SELECT s.*, (s.low + s.high) // 2 AS mid, coalesce((SELECT max(till) FROM sums WHERE till <= s.spot + (s.low + s.high) // 2), 0) AS reached
              FROM search s WHERE s.low < s.high))
), capacity AS MATERIALIZED (
  SELECT max(low) AS c FROM search WHERE low = high
), cuts AS (
  SELECT 0::BIGINT AS j, 0::BIGINT AS spot
  UNION ALL
  SELECT j + 1, (SELECT max(till) FROM sums WHERE till <= cuts.spot + (SELECT c FROM capacity)) FROM cuts WHERE j + 1 < (SELECT shards FROM whole) AND spot < (SELECT total FROM whole)
), placed AS (
  SELECT digest, (SELECT count(*) FROM cuts WHERE cuts.j > 0 AND cuts.spot < till) + 24 - (SELECT shards FROM whole) AS shard FROM sums
  UNION ALL SELECT digest, k - 1 FROM peeled WHERE alone
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM docs JOIN placed USING (digest)
"""


QUERIES = {
    "op1_scores_trie": scores_trie,
    "op2_quality_kneser_ney": quality_kneser_ney,
    "op3_mixing_ipf": mixing_ipf,
    "op4_nearest_multi_index": nearest_multi_index,
    "op5_suffix_two_stage": suffix_two_stage,
    "op6_pseudonyms_feistel": pseudonyms_feistel,
    "op7_simhash_ball": simhash_ball,
    "op8_toxicity_subwords": toxicity_subwords,
    "op9_exact_refinement": exact_refinement,
    "op10_packing_gga": packing_gga,
    "op11_periodic_runs": periodic_runs_query,
    "op12_fill_middle": fill_middle_query,
    "op13_sharding_minimax": sharding_minimax,
}

ORACLES = {
    "op3_mixing_ipf": MIXING_SQL,
    "op9_exact_refinement": EXACT_SQL,
    "op12_fill_middle": FILL_MIDDLE_SQL,
    "op13_sharding_minimax": SHARDING_SQL,
}
