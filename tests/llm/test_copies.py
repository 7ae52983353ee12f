"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rowguard.llm import exact_dedup, simhash, suffix_dedup
from tests.llm.conftest import documents, prose

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def test_exact_groups_of_awkward_rows(awkward):
    got = {(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(awkward).collect()}
    assert (1, 2, 2, False) in got and (2, 2, 2, True) in got  # null counts as empty
    assert (5, 6, 3, False) in got and (6, 6, 3, True) in got  # a repeated row counts
    assert (None, None, 1, True) in got and (8, 8, 1, True) in got
    assert exact_dedup.exact_groups(awkward).count() == 12


def test_exact_groups_go_on_past_equal_lengths_and_prefixes(spark):
    head = "p" * 200
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a"), (4, "q" * 201), (5, "Ab"), (6, "aB")]
    docs = documents(spark, rows)
    got = {r.id: (r.keep_id, r.group_size, r.sha256 is not None) for r in exact_dedup.exact_groups(docs).collect()}
    assert got[1] == (3, 2, True) and got[2] == (2, 1, True)
    assert got[5] == (5, 1, False)
    folded = {r.id: r.keep_id for r in exact_dedup.exact_groups(docs, normalise=lambda c: __import__("pyspark").sql.functions.lower(c)).collect()}
    assert folded[5] == 6


def test_dropping_exact_copies_keeps_columns_and_one_row_each(awkward, nothing):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4, 6, 7, 8, 9, 10]
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


def plain_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_the_definition(awkward):
    texts = [r.text for r in awkward.select("text").collect()]
    assert simhash.text_fingerprints(pa.array(texts, pa.string())).tolist() == [plain_fingerprint(t) for t in texts]


def plain_components(fps):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("bits", [8, 11, 16])
def test_ball_links_join_exactly_the_pairs_within_three_bits(bits):
    rng = random.Random(bits)
    fps = [0]
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.append(seed ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    fps = sorted(set(fps))
    bucket, sent = simhash._messages(np.array(fps, np.uint64), [(i // 2) + 32 * (i % 2) for i in range(bits)])
    at = [(i // 2) + 32 * (i % 2) for i in range(bits)]
    place = {f: i for i, f in enumerate(fps)}
    pairs = set()
    for b in np.unique(bucket):
        left, right = simhash._bucket_links(b, sent[bucket == b], at)
        pairs |= set(zip(left.tolist(), right.tolist()))
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    groups = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(groups[place[a]], groups[place[b]])
            if groups[place[a]] != low or groups[place[b]] != low:
                groups[place[a]] = groups[place[b]] = low
                changed = True
    assert groups == plain_components(fps)


def test_near_groups_of_awkward_rows(spark, awkward, nothing):
    rows = simhash.near_groups(awkward).collect()
    assert len(rows) == 12
    texts = {(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()}
    by_id = sorted(((i, plain_fingerprint(t)) for i, t in texts), key=lambda x: (x[0] is None, x[0]))
    tops = plain_components([f for _, f in by_id])
    want = {(i, by_id[t][0]) for (i, _), t in zip(by_id, tops)}
    assert {(r.id, r.component_id) for r in rows} == want
    assert simhash.near_groups(nothing).count() == 0
    kept = simhash.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(tops))


def test_text_ids_stay_text(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("10", None), ("9", " ")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r.id, r.component_id) for r in simhash.near_groups(docs).collect()} == {("b", "a"), ("a", "a"), ("10", "10"), ("9", "10")}
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {"a", "10"}


def test_rows_of_null_and_repeated_ids_stay_by_their_text(spark):
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(8)]
    near = texts[4] + " end"
    while (plain_fingerprint(near) ^ plain_fingerprint(texts[4])).bit_count() > 3:
        texts[4] = prose(rng, 300)
        near = texts[4] + " end"
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0]), (7, texts[3]), (8, texts[3]), (7, texts[5]), (9, texts[6]), (9, texts[7]), (None, texts[4]), (None, near)]
    docs = documents(spark, rows)
    exact = {(r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(docs).collect()}
    assert exact_dedup.drop_exact_copies(docs).count() == len(exact)
    assert exact == set(rows) - {(7, texts[3])}
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect()]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    tops = plain_components([plain_fingerprint(t) for _, t in order])
    assert len(kept) == len(set(tops)) == len(set(texts)) and set(kept) <= set(rows)
    of = dict(zip(order, tops))
    assert {of[k] for k in kept} == set(tops) and (8, texts[3]) not in kept


def plain_removal(texts, length):
    seen = {}
    for t in texts:
        for j in range(len(t) - length + 1):
            seen[t[j : j + length]] = seen.get(t[j : j + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        runs = sum(g and (q == 0 or not gone[q - 1]) for q, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_passages_of_documents_against_brute_force(spark, nothing):
    rng = random.Random(8)
    shared = [prose(rng, 60) for _ in range(3)]
    texts = [prose(rng, 50) + rng.choice(shared) + prose(rng, 50) for _ in range(12)]
    texts += [texts[0], texts[1][5:], "b" * 900, "b" * 199, None, "", ("é" * 150 + "x") * 2, "ab" * 101, "c" * 200]
    docs = documents(spark, list(enumerate(texts)))
    got = suffix_dedup.repeated_passages(docs, texts=True).collect()
    want = plain_removal([(t or "").encode() for t in texts], 200)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.id)] == want
    for r in got:
        raw = (texts[r.id] or "").encode()
        left = bytearray(raw)
        for s in reversed(r.spans):
            del left[s.begin : s.end]
        assert bytes(left) == bytes(r.kept)
    assert suffix_dedup.repeated_passages(nothing).count() == 0


def test_passages_of_awkward_rows(awkward):
    got = {(r.id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_passages(awkward).collect()}
    n = {r.doc_id: len((r.text or "").encode()) for r in awkward.collect()}
    assert (1, 0, 0) in got and (10, 1500, 1500) in got and (6, n[6], n[6]) in got and len(got) == 11


@pytest.mark.parametrize("trial", range(40))
def test_two_stage_order_and_segments(trial):
    rng = random.Random(trial)
    alphabet = rng.choice([b"ab", b"abc", b"a", bytes(range(97, 123)), bytes([0, 255])])
    pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(4)]
    texts = [b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
    length, window = rng.choice([20, 33, 40]), rng.choice([8, 12])
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    keys, _, begin, count, periodic = suffix_dedup.segments(data, offsets, length, window)
    at = {offsets[i] + j: t[j : j + length] for i, t in enumerate(texts) for j in range(len(t) - length + 1)}
    covered = {p: (k, s) for s, (k, b, c) in enumerate(zip(keys.tolist(), begin.tolist(), count.tolist())) for p in range(b, b + c)}
    assert set(covered) == set(at)
    for s, (b, c, twice) in enumerate(zip(begin.tolist(), count.tolist(), periodic.tolist())):
        inside = [at[p] for p in range(b, b + c)]
        assert twice or len(set(inside)) == len(inside)
    by_string = {}
    for p, x in at.items():
        by_string.setdefault(x, set()).add(covered[p][0])
    assert all(len(k) == 1 for k in by_string.values())
    if len(begin):
        padded = np.concatenate([data, np.zeros(length + 16, np.uint8)])
        order = suffix_dedup.two_stage_order(padded, begin, count, length)
        found = [at[p] for p in order.tolist()]
        assert found == sorted(found) and sorted(order.tolist()) == sorted(at)
        twice = {p for p, x in at.items() if list(at.values()).count(x) > 1} if len(at) < 400 else None
        marked = {p for p, m in zip(order.tolist(), suffix_dedup.repeated_starts(padded, order, length)) if m}
        assert twice is None or marked == twice
