"""Periodic runs, fill-in-middle and sharding against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from rowguard.llm import fill_middle, periodic_runs, sharding
from rowguard.llm.queries import QUERIES
from tests.llm.conftest import documents, prose

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(s, exponent=4, least=6):
    """Every stretch of every period, by looking at all pairs of neighbours that far apart."""
    out = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            if i > a and i + q - a >= max(least, exponent * q):
                out.setdefault((a, i + q), q)
            i += i == a
    return sorted((a, q, b) for (a, b), q in out.items())


def collapsed(s, runs):
    gone = {i for a, q, b in runs for i in range(a + q, b)}
    return " ".join(w for i, w in enumerate(s) if i not in gone)


def woven(rng, letters=3):
    s = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 7, 40, 150]))]
    for _ in range(rng.randint(0, 4)):
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 18))]
        if rng.random() < 0.4:
            unit = unit[:2] * rng.randint(1, 8) + unit
        at = rng.randint(0, len(s))
        s[at:at] = (unit * 9)[: rng.randint(0, 9 * len(unit))]
    return s


@pytest.mark.parametrize("exponent", [3, 4, 5])
def test_runs_equal_those_of_every_period(exponent):
    rng = random.Random(exponent)
    for _ in range(500):
        s = woven(rng, rng.choice([1, 2, 3, 6]))
        runs = periodic_runs.find_runs(np.array(s, np.int64), exponent)
        assert list(zip(runs.start.tolist(), runs.period.tolist(), runs.end.tolist())) == plain_runs(s, exponent)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, np.int64), 2)


def test_range_successor_of_the_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 31, 200):
        order = rng.permutation(n)
        tree = periodic_runs.Occurrences(order)
        for _ in range(100):
            low, high = sorted(rng.integers(0, n + 1, 2))
            bound = rng.integers(0, n + 1)
            own = np.sort(order[low:high])
            got = tree.before(np.array([low]), np.array([high]), np.array([bound]))[0]
            assert got == (own < bound).sum()
            if got < len(own):
                assert tree.at(np.array([low]), np.array([high]), np.array([got]))[0] == own[own >= bound][0]


def test_runs_of_awkward_texts(spark, awkward, nothing):
    rng = random.Random(4)
    rows = [(100 + i, " \t".join("abcÉ"[c] for c in woven(rng))) for i in range(60)]
    rows += [(300, "on and on " * 9000), (301, "no no no no no no"), (302, "No no No no No no"), (303, "no no no no no no\nthen more")]
    docs = documents(spark, rows).unionByName(awkward).repartition(3)
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == docs.count() and len([r for r in got if r.id == 6]) == 2
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(WORD.findall(r.text or ""))
    for r in got:
        s = texts[r.id][0]
        assert r.n_words == len(s)
        if len(s) < 5000:
            runs = plain_runs(s)
            assert [(x.start, x.period, x.start + x.length) for x in r.runs] == runs
            assert r.collapsed == collapsed(s, runs)
    by_id = {r.id: r for r in got}
    assert [(x.start, x.length, x.period) for x in by_id[300].runs] == [(0, 27000, 3)] and by_id[300].collapsed == "on and on"
    assert by_id[301].collapsed == "no" and by_id[302].runs == [] and by_id[303].collapsed == "no then more"
    assert by_id[1].runs == [] and by_id[1].collapsed == "" and by_id[None].n_words == 5
    assert periodic_runs.periodic_runs(nothing).count() == 0
    named = docs.limit(3).selectExpr("cast(doc_id as string) doc_id", "text")
    assert periodic_runs.periodic_runs(named).schema["id"].dataType.simpleString() == "string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_of_runs_plants_its_periods(spark, awkward, tmp_path):
    rng = random.Random(8)
    docs = documents(spark, [(i, prose(rng, rng.choice([1, 3, 60, 200, 300]))) for i in range(200, 620)]).unionByName(awkward.filter("text is null or length(text) < 100000"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count()
    planted = 0
    for r in got:
        s = WORD.findall(texts[r.doc_id] or "")
        n, h = len(s), zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
            planted += bool(plain_runs(s))
        runs = plain_runs(s)
        best = max(runs, key=lambda x: ((x[2] - x[0]) / x[1], -x[0], -x[1])) if runs else None
        told = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *told)
        assert r.runs_sha256 == sha("".join(f"{a},{b - a},{q}\n" for a, q, b in runs)) and r.collapsed_sha256 == sha(collapsed(s, runs))
    assert planted > 5


def test_fill_in_middle_goes_there_and_back(spark, awkward, nothing):
    rng = random.Random(6)
    rows = [(100 + i, "".join(rng.choice("ab <>PSM\né😀\r") for _ in range(rng.choice([1, 2, 9, 80])))) for i in range(200)]
    rows += [(400 + i, f"marked {m} text") for i, m in enumerate(["<P>", "<S>", "<M>", "<p>"])]
    docs = documents(spark, rows).unionByName(awkward)
    out = fill_middle.fill_in_middle(docs)
    back = out.withColumn("back", fill_middle.restored(out["output"], out["form"])).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text or "")
    assert len(back) == docs.count() and Counter(r.form for r in back).keys() == {"plain", "psm", "spm"}
    for r in back:
        text = texts[r.id][0]
        assert r.back == text and r.n == len(text)
        h = hashlib.sha256(f"1:{'' if r.id is None else r.id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (r.n + 1), h2 % (r.n + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            assert (r.form, r.prefix_units, r.middle_units, r.output) == ("plain", None, None, text)
        else:
            assert r.form == ("spm" if h4 % 100 < 20 else "psm") and (r.prefix_units, r.middle_units) == (a, b - a)
            parts = (f"<P>{text[:a]}<S>{text[b:]}" if r.form == "psm" else f"<S>{text[b:]}<P>{text[:a]}") + f"<M>{text[a:b]}"
            assert r.output == parts
    assert fill_middle.fill_in_middle(nothing).count() == 0


def test_fill_in_middle_by_words(spark):
    rng = random.Random(7)
    docs = documents(spark, [(i, prose(rng, 1 + i % 9)) for i in range(80)])
    out = fill_middle.fill_in_middle(docs, unit=r"\S+\s*").join(docs.selectExpr("doc_id as id", "text"), "id")
    for r in out.collect():
        assert r.n == len(r.text.split())
        if r.form == "psm":
            middle = r.output.split("<M>")[1]
            assert len(middle.split()) == r.middle_units and len(r.output.split("<S>")[0][3:].split()) == r.prefix_units
    with pytest.raises(Exception, match="do not cover"):
        fill_middle.fill_in_middle(docs, unit="[a-c]").count()


def plain_capacity(sizes, shards):
    """The smallest capacity by trying every sum of neighbours, from the least up."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    for capacity in np.unique(sums[None, :] - sums[:, None]):
        if capacity < max(sizes, default=0):
            continue
        at, used = 0, 0
        while at < len(sizes):
            at = int(np.searchsorted(sums, sums[at] + capacity, "right")) - 1
            used += 1
        if used <= shards:
            return int(capacity)
    return 0


@pytest.mark.parametrize("buckets", [5, 64, 1 << 14])
def test_capacity_is_the_smallest_of_all(spark, buckets):
    rng = random.Random(buckets)
    for kind in range(3):
        sizes = [rng.choice([8, 9, 30, rng.randint(8, 900), 5000 if kind == 1 else 12]) for _ in range([120, 60, 9][kind])]
        shards = [7, 5, 4][kind]
        sums = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "end long")
        cuts = sharding.minimax_cuts(sums, shards, sum(sizes), buckets)
        spots = [0, *cuts, sum(sizes)]
        assert len(cuts) == shards - 1 and set(cuts) <= set(np.cumsum(sizes).tolist())
        assert max(b - a for a, b in zip(spots, spots[1:])) == plain_capacity(sizes, shards)


def test_groups_stay_whole_and_slots_have_no_gaps(spark, awkward, nothing):
    rng = random.Random(2)
    hot = prose(rng, 30)
    rows = [(1000 + i, prose(rng, rng.choice([1, 5, 20, 400]))) for i in range(150)] + [(2000 + i, hot) for i in range(100)] + [(None, hot)] * 30
    docs = documents(spark, rows).unionByName(awkward).repartition(4)
    got = sharding.sharded(docs, shards=6, buckets=16, piece_rows=20).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(6))
    held = docs.select("doc_id", "text").collect()
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in held)
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == expected
    of_text = defaultdict(set)
    for r in got:
        of_text[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in of_text.values())
    # Groups above an even share of the rest are alone; the rest is cut with the least largest shard.
    groups = Counter()
    for r in held:
        groups[sha(r.text or "")] += len((r.text or "").encode()) + 8
    left, alone = sum(groups.values()), []
    for digest, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if len(alone) == 5 or size * (6 - len(alone)) <= left:
            break
        alone.append(digest)
        left -= size
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert [loads[k] for k in range(len(alone))] == [groups[d] for d in alone] and alone
    assert max(loads[k] for k in range(len(alone), 6)) == plain_capacity([groups[d] for d in sorted(groups) if d not in alone], 6 - len(alone))
    again = sharding.sharded(docs.repartition(2), shards=6, piece_rows=1000).collect()
    assert Counter((r.id, r.shard, r.text_crc32) for r in again) == Counter((r.id, r.shard, r.text_crc32) for r in got)
    assert sharding.sharded(nothing).count() == 0
    marked = sharding.with_shard(docs, 6, out="part_of")
    assert marked.columns == [*docs.columns, "part_of"]
    assert Counter(r.part_of for r in marked.collect()) == Counter(r.shard for r in got)
    few = sharding.sharded(documents(spark, [(1, "a"), (2, "b"), (3, "a"), (4, None)]), shards=24).collect()
    assert len(few) == 4 and len({r.shard for r in few}) == 3
