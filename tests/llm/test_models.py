"""Language-model scores, quality, toxicity and nearest neighbours."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowguard.llm import hashing_index, kneser_ney, toxicity, trie_scores
from rowguard.llm.elias_fano import Sequence, Trie, quantise, restore
from tests.llm.conftest import documents, prose

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
END = b" "


def tokens(text):
    return [*WORD.findall((text or "").encode().lower()), END]


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 10**9), (5, 6), (1000, 10**4), (1000, 10**13), (5000, 6000)])
def test_sequences_give_back_and_find_their_values(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n))
    held, size = Sequence.open(memoryview(Sequence.encode(values)))
    assert size == len(Sequence.encode(values))
    if len(values):
        assert held[np.arange(len(values))].tolist() == values.tolist()
    asked = np.concatenate([values, rng.integers(0, 2 * top + 2, 500), [-1]])
    place = {v: i for i, v in enumerate(values.tolist())}
    assert held.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]


def test_values_in_one_long_bucket_are_found():
    values = np.concatenate([np.arange(0, 60_000, 3), np.random.default_rng(3).integers(10**9, 10**12, 3000)])
    values = np.unique(values)
    held, _ = Sequence.open(memoryview(Sequence.encode(values)))
    asked = np.arange(0, 70_000)
    place = {v: i for i, v in enumerate(values.tolist())}
    assert held.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]
    assert (held[np.arange(len(values))] == values).all()


def test_a_trie_is_read_from_a_mapped_file_and_compact(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 3000, (40_000, 2)) * [3, 5], axis=0)
    codes = rng.integers(0, 65535, len(pairs)).astype(np.uint16)
    blob = Trie.build(pairs[:, 0], pairs[:, 1], codes)
    assert len(blob) < 6 * len(pairs)
    (tmp_path / "trie").write_bytes(blob)
    trie = Trie.open(np.memmap(tmp_path / "trie", np.uint8, "r"))
    place = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    asked = np.concatenate([pairs, rng.integers(0, 20_000, (20_000, 2))])
    asked = asked[np.lexsort((asked[:, 1], asked[:, 0]))]
    assert trie.find(asked[:, 0], asked[:, 1]).tolist() == [place.get(tuple(p), -1) for p in asked.tolist()]
    assert trie.codes.tolist() == codes.tolist()
    p = np.log10(rng.uniform(1e-9, 1, 100))
    assert np.abs(restore(quantise(p)) - p).max() < 1.3e-4


def test_scores_are_those_of_the_definition(spark, awkward, nothing):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60)) + rng.choice(["", f" new{i}"])) for i in range(100, 160)]
    docs = documents(spark, rows).unionByName(awkward)
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    scored, model = trie_scores.trie_scores(docs, training)
    got = scored.collect()
    assert len(got) == docs.count()
    texts = [(r.doc_id, tokens(r.text), zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1) for r in docs.collect()]
    single, pairs = collections.Counter(), collections.Counter()
    for _, x, held in texts:
        if not held:
            single.update(x)
            pairs.update(zip([END, *x], x))
    total, known = sum(single.values()), len(single)
    prior = trie_scores.PRIOR
    unigram = lambda w: (single[w] + 0.5) / (total + 0.5 * (known + 1))
    want = {}
    for i, x, held in texts:
        base = sum(math.log10(unigram(w)) for w in x)
        score = sum(math.log10((pairs[h, w] + prior * unigram(w)) / (single[h] + prior)) for h, w in zip([END, *x], x))
        want[i, len(x)] = (held, sum(single[w] > 0 for w in x), base, score)
    for r in got:
        held, n_known, base, score = want[r.id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, n_known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert abs(r.score - score) < 3e-4 * r.n_tokens
    assert sum(len(Trie.open(r.trie).codes) for r in model.collect()) == len(pairs)
    assert trie_scores.trie_scores(nothing, training)[0].count() == 0
    untrained, _ = trie_scores.trie_scores(awkward.limit(3), F.lit(False))
    assert {(r.n_known, r.score) for r in untrained.collect()} == {(0, 0.0)}


def test_tries_of_the_last_level_are_written_only_for_who_reads_them(spark, monkeypatch):
    written, cut = [], trie_scores.cut_lineage
    monkeypatch.setattr(trie_scores, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    rng = random.Random(5)
    docs = documents(spark, [(i, prose(rng, 30)) for i in range(40)])
    scored, model = trie_scores.trie_scores(docs, F.lit(True), order=3)
    assert scored.count() == 40
    assert [w.filter("kind = 1").count() > 0 for w in written if "kind" in w.columns] == [True, False]
    assert {r.level for r in model.filter("trie is not null").collect()} == {2, 3}


def test_what_the_last_level_exchanges_is_counts_alone(spark, monkeypatch):
    written, sent, cut, messages = [], [], trie_scores.cut_lineage, trie_scores._messages
    monkeypatch.setattr(trie_scores, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(trie_scores, "_messages", lambda *a: sent.append(messages(*a)) or sent[-1])
    rng = random.Random(15)
    docs = documents(spark, [(i, prose(rng, 30)) for i in range(300)])
    scored, _ = trie_scores.trie_scores(docs, F.lit(True), order=3)
    tokens_ = sum(r.n_tokens for r in scored.collect())

    def size(df):
        columns = [f.name for f in df.schema.fields if f.dataType.typeName() == "binary"]
        return df.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in columns))).first()[0]

    answers = [w for w in written if "kind" in w.columns][-1].filter("kind = 0")
    # Names of contexts and words, counts, and fixed bytes of some ten values in each of 32 messages.
    assert size(answers) < tokens_ and size(sent[1]) < 7 * tokens_ + 32 * 10 * 20


class Grouped:
    """Stands for messages by shard and keeps what a task would do with a shard."""

    def groupBy(self, key):
        return self

    def applyInArrow(self, work, layout):
        return work


def test_a_shard_looks_up_each_different_ngram_once(monkeypatch):
    asked, find = [], Trie.find
    monkeypatch.setattr(Trie, "find", lambda trie, contexts, words: asked.append(len(contexts)) or find(trie, contexts, words))
    rng = np.random.default_rng(16)
    every = np.unique(rng.integers(0, 60, (900, 2)), axis=0)
    sent, total = [], collections.Counter()
    for chunk in range(12):
        own = every[np.sort(rng.choice(len(every), 500, replace=False))]
        counts = rng.integers(0, 4, 500) if chunk % 4 else np.zeros(500, np.int64)
        total.update({tuple(g): c for g, c in zip(own.tolist(), counts.tolist())})
        sent.append((own, {"shard": 3, "chunk": chunk, "contexts": trie_scores.packed(np.diff(own[:, 0], prepend=0)), "words": trie_scores.packed(own[:, 1]), "counts": trie_scores.packed(counts)}))
    rows = pa.Table.from_pylist([m for _, m in sent])
    got = trie_scores._shards(Grouped(), 0.0, 300.0, 3, True, False)((pa.scalar(3),), rows).to_pylist()
    assert sum(asked) == len({tuple(g) for own, _ in sent for g in own.tolist()})
    answers = {r["chunk"]: trie_scores.unpacked(r["counts"]).tolist() for r in got if r["kind"] == 0}
    assert answers == {m["chunk"]: [total[tuple(g)] for g in own.tolist()] for own, m in sent}


@pytest.mark.parametrize("top", [1, 50, 1 << 40])
def test_rows_are_in_order_however_wide_their_parts(top):
    rng = np.random.default_rng(17)
    for n in (0, 1, 700):
        parts = [rng.integers(0, top, n), rng.integers(0, 30, n)]
        order, first, different = trie_scores._in_order(*parts)
        assert order.tolist() == np.lexsort(parts[::-1]).tolist()
        want = sorted(set(zip(*[x.tolist() for x in parts])))
        assert list(zip(*[x.tolist() for x in different])) == want
        assert [tuple(x[order[i]] for x in parts) for i in first] == want
    wide = [rng.integers(0, 1 << 50, 40).repeat(2), rng.integers(0, 1 << 50, 80)]
    assert trie_scores._in_order(*wide)[0].tolist() == np.lexsort(wide[::-1]).tolist()


@pytest.mark.parametrize("order", [3, 4])
def test_scores_of_higher_orders_are_those_of_the_definition(spark, awkward, monkeypatch, order):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 60), ("the", "of", "reed", "stone")) + rng.choice(["", " new"])) for i in range(100, 160)]
    docs = documents(spark, rows).unionByName(awkward)
    monkeypatch.setattr(trie_scores, "SPLIT", 40)
    scored, model = trie_scores.trie_scores(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1, order=order)
    texts = [(r.doc_id, tokens(r.text), (r.doc_id or 0) % 5 == 1) for r in docs.collect()]
    counts, contexts = collections.Counter(), collections.Counter()
    for _, x, held in texts:
        if not held:
            line = [END, *x]
            for k in range(1, order + 1):
                # A text's start is a context, not a word.
                found = [tuple(line[i : i + k]) for i in range(k == 1, len(line) - k + 1)]
                counts.update(found)
                contexts.update(g[:-1] for g in found)
    total, known = contexts[()], sum(len(g) == 1 for g in counts)
    prior = trie_scores.PRIOR

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.5) / (total + 0.5 * (known + 1))
        return (counts[gram] + prior * p(gram[1:])) / (contexts[gram[:-1]] + prior)

    want = {}
    for i, x, _ in texts:
        line = [END, *x]
        want[i, len(x)] = sum(math.log10(p(tuple(line[max(0, j + 1 - order) : j + 1]))) for j in range(1, len(line)))
    got = scored.collect()
    assert len(got) == len(texts)
    assert all(abs(r.score - want[r.id, r.n_tokens]) < 6e-4 * r.n_tokens for r in got)
    sizes = collections.Counter()
    for r in model.collect():
        sizes[r.level] += len(Trie.open(r.trie).codes)
    assert sizes == {k: sum(len(g) == k for g in counts) for k in range(2, order + 1)}


def test_colliding_words_and_text_ids_are_scored_apart(spark):
    sign = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    mirror = sign.translate(str.maketrans("ab", "ba"))
    docs = documents(spark, [(1, sign), (2, mirror), (3, f"{sign} {mirror}")])
    named = docs.withColumn("doc_id", F.when(F.col("doc_id") < 3, F.concat(F.lit("n"), F.col("doc_id"))))
    scored, _ = trie_scores.trie_scores(named, F.col("doc_id") == "n1")
    assert {(r.id, r.n_tokens, r.n_known) for r in scored.collect()} == {("n1", 2, 2), ("n2", 2, 1), (None, 3, 2)}


def test_hot_contexts_are_spread_without_changing_scores(spark, monkeypatch):
    rng = random.Random(4)
    docs = documents(spark, [(i, prose(rng, 40)) for i in range(30)])
    plain = {r.id: r.score for r in trie_scores.trie_scores(docs, F.col("doc_id") % 3 != 0)[0].collect()}
    monkeypatch.setattr(trie_scores, "SPLIT", 4)
    split = {r.id: r.score for r in trie_scores.trie_scores(docs, F.col("doc_id") % 3 != 0)[0].collect()}
    assert split == pytest.approx(plain)


def plain_kneser_ney(texts):
    tri = collections.Counter()
    for t in texts:
        x = [b"<", b"<", *tokens(t)]
        tri.update(zip(x, x[1:], x[2:]))
    bi = collections.Counter((v, w) for _, v, w in tri)
    uni = collections.Counter(w for _, w in bi)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y for k in (1, 2, 3)]
        return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]

    d3, d2, d1 = discounts(tri), discounts(bi), discounts(uni)
    off = lambda c, d: d[min(c, 3) - 1] if c else 0
    total = sum(uni.values())
    floor = sum(off(c, d1) for c in uni.values()) / total / (len(uni) + 1)

    def level(counts, d, context, count, lower):
        own = [c for k, c in counts.items() if k[:-1] == context]
        if not own:
            return lower
        return (count - off(count, d)) / sum(own) + sum(off(c, d) for c in own) / sum(own) * lower

    def p(u, v, w):
        p1 = (uni[w] - off(uni[w], d1)) / total + floor
        return level(tri, d3, (u, v), tri[u, v, w], level(bi, d2, (v,), bi[v, w], p1))

    return p, [w for w in uni]


def test_kneser_ney_is_that_of_the_definition(spark):
    rng = random.Random(6)
    trusted = [prose(rng, 12, ("the", "of", "reed", "stone")) for _ in range(12)] + [None, ""]
    model = kneser_ney.fit(documents(spark, list(enumerate(trusted))))
    p, vocabulary = plain_kneser_ney(trusted)
    assert sum(p(b"the", b"of", w) for w in [*vocabulary, b"unseen"]) == pytest.approx(1)
    texts = [*trusted[:3], "the unseen of reed", "", None, "new words all"]
    grams, n = kneser_ney.trigrams(pa.array(texts, pa.string()))
    got = np.add.reduceat(model.token_scores(grams), np.cumsum(n) - n)
    for text, score in zip(texts, got):
        x = [b"<", b"<", *tokens(text)]
        assert score == pytest.approx(sum(math.log(p(*g)) for g in zip(x, x[1:], x[2:])), rel=1e-5)


def test_quality_keeps_each_languages_best(spark, awkward, nothing):
    rng = random.Random(7)
    rows = [(i, prose(rng, 40), "en", "a") for i in range(100, 120)] + [(i, "zq%%% ## " * 20, "en", "a") for i in range(120, 123)]
    docs = documents(spark, rows).unionByName(awkward)
    labels = spark.createDataFrame([(i, 1) for i in range(100, 110)] + [(120, 0), (100, None)], "doc_id long, quality int")
    got = kneser_ney.judged(docs, labels).collect()
    assert len(got) == docs.count() and all(r.threshold is not None for r in got)
    for lang in {r.lang for r in got}:
        own = sorted(r.perplexity for r in got if r.lang == lang)
        assert {r.threshold for r in got if r.lang == lang} == {own[max(0, math.ceil(0.85 * len(own)) - 1)]}
    assert all(r.kept == (r.perplexity <= r.threshold) for r in got)
    assert not any(r.kept for r in got if r.id in (120, 121, 122))
    assert kneser_ney.judged(nothing, labels).count() == 0


def test_quality_counts_all_trusted_text_whatever_its_number_and_length(spark):
    rng = random.Random(8)
    trusted = [prose(rng, 4) for _ in range(3100)] + ["word " + prose(rng, 5000)]
    docs = documents(spark, [*enumerate(trusted), (5000, "word of reed new"), (5001, None)])
    labels = spark.createDataFrame([(i, 1) for i in range(len(trusted))], "doc_id long, quality int")
    got = {r.id: r.perplexity for r in kneser_ney.judged(docs, labels).collect()}
    p, _ = plain_kneser_ney(trusted)
    assert len(got) == len(trusted) + 2
    for i, text in [*list(enumerate(trusted))[:20], (5000, "word of reed new"), (5001, None)]:
        x = [b"<", b"<", *tokens(text)]
        logs = [math.log(p(*g)) for g in zip(x, x[1:], x[2:])]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-5)


def test_the_quality_model_is_written_as_a_row_per_shard(spark, monkeypatch):
    written, cut = [], kneser_ney.cut_lineage
    monkeypatch.setattr(kneser_ney, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    rng = random.Random(13)
    docs = documents(spark, [(i, prose(rng, 50)) for i in range(30)])
    assert kneser_ney.judged(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")).count() == 30
    kept = [w for w in written if "keys" in w.columns]
    assert len(kept) == 5 and all(w.groupBy("shard").count().filter("count > 1").isEmpty() for w in kept)
    assert sum(len(r.x) // 4 for w in kept for r in w.collect()) > 500


def test_quality_in_waves_is_that_of_the_definition_and_leaves_no_counts_behind(spark, monkeypatch):
    from rowguard import session

    monkeypatch.setattr(kneser_ney, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(kneser_ney, "PACKED_ROWS", 300)
    written, cut = [], kneser_ney.cut_lineage
    monkeypatch.setattr(kneser_ney, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)] + [None, "", "all new", "all new"]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.id: r.perplexity for r in kneser_ney.judged(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")).collect()}
    p, _ = plain_kneser_ney(texts[:50])
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        x = [b"<", b"<", *tokens(text)]
        logs = [math.log(p(*g)) for g in zip(x, x[1:], x[2:])]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-5)
    folder = session.shared_folder(spark)
    there = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def kept(df):
        path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        return there.exists(spark._jvm.org.apache.hadoop.fs.Path(path))

    counts = [w for w in written if w.columns in (["words", "often", "rows", "counts"], ["w", "c"], ["v", "w", "p2"])]
    chunks = [w for w in written if "stream" in w.columns]
    assert len(counts) == 3 + kneser_ney.FIT_WAVES and len(chunks) == kneser_ney.WAVES
    assert not any(kept(w) for w in [*counts, *chunks])
    assert all(kept(w) for w in written if "keys" in w.columns)


def test_asking_the_quality_model_moves_the_questions_alone(spark, monkeypatch):
    plans, answers = [], kneser_ney._answers

    def held(*given):
        found = answers(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(kneser_ney, "_answers", held)
    monkeypatch.setattr(kneser_ney, "CHUNK_BYTES", 1500)
    rng = random.Random(15)
    docs = documents(spark, [(i, prose(rng, 40)) for i in range(60)])
    assert kneser_ney.judged(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).count() == 60
    assert plans and all(plan.count("Exchange hashpartitioning") == 1 for plan in plans)


@pytest.mark.parametrize("trusted", [["one two one two three"], ["one"], [""], ["a b a b", "a b c", "a b a b"]])
def test_contexts_that_occur_once_have_their_weight(spark, trusted):
    model = kneser_ney.fit(documents(spark, list(enumerate(trusted))))
    p, _ = plain_kneser_ney(trusted)
    texts = [*trusted, "one two two", "two three", "b a c", "new"]
    grams, n = kneser_ney.trigrams(pa.array(texts, pa.string()))
    got = np.add.reduceat(model.token_scores(grams), np.cumsum(n) - n)
    for text, score in zip(texts, got):
        x = [b"<", b"<", *tokens(text)]
        assert score == pytest.approx(sum(math.log(p(*g)) for g in zip(x, x[1:], x[2:])), rel=1e-5)


def insults(rng, n):
    return prose(rng, n) + " " + rng.choice(["grumblef", "snorkwit"]) + rng.choice(["er", "ing", "ish", "o"]) + " " + prose(rng, n)


def test_toxicity_finds_spellings_it_has_not_seen(spark, awkward, nothing):
    rng = random.Random(9)
    rows = [(i, insults(rng, rng.randint(3, 60)) if i % 4 == 0 else prose(rng, rng.randint(6, 120))) for i in range(100, 700)]
    docs = documents(spark, rows).unionByName(awkward)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100, 700)] + [(101, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    tested = [r for r in got if r.id is not None and r.id >= 100 and r.held_out]
    assert len(tested) > 80
    assert sum(r.predicted == int(r.id % 4 == 0) for r in tested) >= 0.97 * len(tested)
    unseen = toxicity.score_texts(model, pa.array([prose(rng, 20) + " you grumblefff " + prose(rng, 20), "snorkwitty", prose(rng, 20), "", None]))
    assert (unseen[:2] >= 0.3).all() and (unseen[2:] < 0.3).all()
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id < 100 or doc_id is null").count() == 12
    assert toxicity.scores(nothing, model).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_long_texts_do_not_dilute_a_few_words():
    rng = random.Random(10)
    texts = [insults(rng, 20) if i % 3 == 0 else prose(rng, 40) for i in range(300)]
    model = toxicity.train(pa.array(texts), np.array([int(i % 3 == 0) for i in range(300)]))
    long = prose(rng, 20_000)
    scores = toxicity.score_texts(model, pa.array([long, long + " snorkwiter " + long]))
    assert scores[0] < 0.3 <= scores[1]


def test_pigeonhole_probing_misses_no_code_in_the_radius():
    rng = np.random.default_rng(1)
    for dims in (5, 16, 40, 64, 100):
        vectors = rng.normal(size=(600, dims))
        coder = hashing_index.fit_coder(vectors[:300])
        block = hashing_index.Block(np.arange(600), vectors, coder.codes(vectors))
        for q in range(0, 600, 60):
            gaps = np.bitwise_count(block.codes ^ block.codes[q]).sum(1)
            for radius in (0, 3, coder.radius):
                assert block.within(block.codes[q], radius).tolist() == np.flatnonzero(gaps <= radius).tolist()


def test_nearest_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    vectors = [(centres[i % 20] + 0.4 * rng.normal(size=24)).tolist() for i in range(1500)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows[200] = (200, vectors[7], "x")  # a tie with 7
    odd = [(5000, None, "x"), (5100, [], "x"), (5200, [0.0] * 24, "x"), (5300, [float("nan")] * 24, "x"), (5400, [None] * 24, "x"), (5500, [1.0, 2.0], "x"), (None, vectors[1], "x"), (0, vectors[0], "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, block string")
    found = hashing_index.nearest(table, F.col("id") % 100 == 0).collect()
    # Rows of no id and both rows of a repeated one take part; the other odd rows do not.
    named = [(r[0], r[1]) for r in rows] + [(None, vectors[1]), (0, vectors[0])]
    matrix = np.array([v for _, v in named])
    ids = [i for i, _ in named]
    hits = 0
    for q in range(0, 1500, 100):
        own = [(r.rank, r.vec_id, r.score) for r in found if r.query_id == q]
        twice = 2 if q == 0 else 1
        assert sorted(r for r, _, _ in own) == sorted([*range(1, 11)] * twice)
        far = np.sqrt(((matrix - matrix[q]) ** 2).sum(1))
        far[q] = np.inf
        order = sorted(range(len(ids)), key=lambda i: (far[i], ids[i] is None, ids[i] or 0))[:10]
        if twice == 1:
            own.sort()
            assert q not in [v for _, v, _ in own]
            assert all(s == pytest.approx(min(far[i] for i in range(len(ids)) if ids[i] == v), rel=1e-12) for _, v, s in own)
            assert [(s, v is None, v or 0) for _, v, s in own] == sorted((s, v is None, v or 0) for _, v, s in own)
        else:
            # Each of the two rows finds the other first.
            assert [(v, s) for r, v, s in own if r == 1] == [(0, 0.0)] * 2
        hits += len({v for _, v, _ in own} & {ids[i] for i in order})
    assert hits >= 0.9 * 150 and len(found) == 160
    assert [(r.vec_id, r.score) for r in hashing_index.nearest(table.filter("vec_id = 1 or vec_id is null or vec_id = 9"), F.col("id") == 1).collect()][0] == (None, 0.0)
    assert hashing_index.nearest(table.limit(0), F.col("id") % 100 == 0).count() == 0
    few = hashing_index.nearest(table.filter("vec_id < 4"), F.col("id") == 1).collect()
    assert sorted(r.vec_id for r in few) == [0, 0, 2, 3]
