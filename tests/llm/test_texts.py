"""Words, pseudonyms, mixing and packing."""

import datetime
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowguard.llm import mixing, packing, pseudonyms
from rowguard.llm.words import slices, word_hashes, words
from tests.llm.conftest import documents, prose

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def test_words_and_hashes(awkward):
    texts = [r.text for r in awkward.select("text").collect()] + ["a\tB\x0bc ", "\x1f x"]
    for batch in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array([None, *texts], pa.string())[1:]):
        found = words(batch)
        data = found.data.tobytes()
        got = [[data[a:b] for a, b in zip(found.starts[i:j], found.ends[i:j])] for i, j in zip(found.first, found.first[1:])]
        assert got == [WORD.findall((t or "").encode().lower()) for t in texts]
        named = defaultdict(set)
        for name, word in zip(word_hashes(found).tolist(), [w for ws in got for w in ws]):
            named[word].add(name)
        assert all(len(n) == 1 for n in named.values()) and len({min(n) for n in named.values()}) == len(named)
    # A word that sums of powers modulo 2^64 cannot tell from its mirror, and long words that differ in one byte.
    sign = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    odd = [sign, sign.translate(str.maketrans("ab", "ba")), *("x" * n + y + "z" * (90 - n) for n in (0, 7, 8, 9, 63, 64, 65) for y in "pq")]
    odd += [w[:k] for w in odd[2:4] for k in (1, 7, 8, 9, 16, 63, 64)] + ["a\0", "a", "a\0\0"]
    assert len(set(word_hashes(words(pa.array(odd))).tolist())) == len(set(odd))
    cut = list(slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t", 100))
    assert [t for part in cut for t in part.column("t").to_pylist()] == texts


KEY = b"one key"


def test_permutations_are_permutations_and_undone():
    for size in (2, 3, 1000, 1024, 1025):
        moved = [pseudonyms.permute(i, size, KEY, "x") for i in range(size)]
        assert sorted(moved) == list(range(size))
        assert [pseudonyms.permute(m, size, KEY, "x", back=True) for m in moved] == list(range(size))
    assert moved != [pseudonyms.permute(i, size, b"other", "x") for i in range(size)]


TEXT = (
    "call +1 (988) 555-2485 or 988-555-2485, card 4041894974608795 and 4041 8949 7460 8795, ip 70.123.182.155, "
    "born 1984-02-29 or 31.12.1999, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00."
)
INVALID = "card 4041894974608796, ip 256.1.1.1 and 01.2.3.4, v4.0.0, date 1985-02-29, ssn 666-12-1234 and 900-12-1234, iban DE88370400440532013000, 0000000000000000"


def test_pseudonyms_are_valid_linked_and_undone():
    found = pseudonyms.spans(TEXT, KEY)
    assert [s.kind for s in found] == ["phone", "phone", "card", "card", "ip", "date", "date", "ssn", "iban"]
    new = pseudonyms.replaced(TEXT, found)
    assert re.sub(r"\d", "9", new.replace(found[4].pseudonym, "")) == re.sub(r"\d", "9", TEXT.replace("70.123.182.155", ""))
    digits = [re.sub(r"\D", "", s.pseudonym) for s in found]
    assert digits[0][1:] == digits[1] and digits[2] == digits[3] != "4041894974608795"
    assert int(digits[2][-1]) == pseudonyms.luhn_digit(digits[2][:-1])
    datetime.date.fromisoformat(found[5].pseudonym)
    iban = found[8].pseudonym.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pseudonyms.replaced(new, pseudonyms.spans(new, KEY, back=True)) == TEXT
    assert pseudonyms.spans(INVALID, KEY) == []


FORMS = [
    ("+1 (017) 555-7713", "phone"), ("1-988-555-2485", "phone"), ("(123) 055-2485", "phone"), ("+44 20 7946 0958", "phone"), ("+49 (0)30 1234567", "phone"), ("+33123456789", "phone"),
    ("GB82 WEST 1234 5698 7654 32", "iban"), ("NL91ABNA0417164300", "iban"), ("FR1420041010050500013M02606", "iban"), ("IT60 X054 2811 1010 0000 0123 456", "iban"),
    ("12/25/2020", "date"), ("12.25.2020", "date"), ("4041 8949 7460 8795", "card"),
]


def test_every_form_is_found_and_undone():
    for old, kind in FORMS:
        for text in (f"see {old}, and", f"see {old} Then", old):
            found = pseudonyms.spans(text, KEY)
            assert [(s.kind, text[s.start : s.end]) for s in found] == [(kind, old)]
            new = pseudonyms.replaced(text, found)
            assert new != text and re.sub("[A-Z]", "A", re.sub(r"\d", "9", new)) == re.sub("[A-Z]", "A", re.sub(r"\d", "9", text))
            assert pseudonyms.replaced(new, pseudonyms.spans(new, KEY, back=True)) == text
    paid = pseudonyms.spans("to GB82 WEST 1234 5698 7654 32 USD 100", KEY)
    assert [s.pseudonym for s in paid] == [pseudonyms.pseudonym("iban", "GB82 WEST 1234 5698 7654 32", KEY)]
    assert pseudonyms.pseudonym("date", "12/25/2020", KEY)[:5].split("/")[::-1] == pseudonyms.pseudonym("date", "25/12/2020", KEY)[:5].split("/")


def test_cards_beside_other_numbers_are_found_and_undone():
    rng = random.Random(4)
    plain = "4041894974608795"
    for before, after in (("", " 123"), ("12 ", ""), ("123 ", " 4"), ("", "-1234"), ("7-", ""), ("", " 123-45-6789"), ("1 2 3 4 5 6 7 8 9 10 11 ", " 12 13"), ("", " 5500005555555559")):
        text = f"x {before}{plain}{after} y"
        found = [s for s in pseudonyms.spans(text, KEY) if text[s.start : s.end] == plain]
        assert [s.pseudonym for s in found] == [pseudonyms.pseudonym("card", plain, KEY)]
    for _ in range(1500):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = body + str(pseudonyms.luhn_digit(body))
        if rng.random() < 0.7:
            card = rng.choice(" -").join(card[i : i + 4] for i in range(0, 16, 4))
        near = ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 4))) for _ in range(2)]
        text = rng.choice([f"{near[0]} {card}", f"{card} {near[1]}", f"{near[0]} {card} {near[1]}"])
        found = pseudonyms.spans(text, KEY)
        new = pseudonyms.replaced(text, found)
        assert found and pseudonyms.replaced(new, pseudonyms.spans(new, KEY, back=True)) == text
        assert card not in new


def test_different_values_stay_different():
    rng = random.Random(1)
    cards = set()
    while len(cards) < 500:
        body = "".join(rng.choice("0123456789") for _ in range(15))
        cards.add(body + str(pseudonyms.luhn_digit(body)))
    moved = {pseudonyms.pseudonym("card", c, KEY) for c in cards}
    assert len(moved) == 500 and not moved & cards
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(d)).isoformat() for d in range(0, 73049, 97)]
    assert len({pseudonyms.pseudonym("date", d, KEY) for d in days}) == len(days)


def test_pseudonymised_tables(spark, awkward, nothing):
    docs = documents(spark, [(100, TEXT), (101, "again 4041894974608795")]).unionByName(awkward)
    got = {r.id: r for r in pseudonyms.pseudonymised(docs, KEY).collect()}
    assert got[1].text is None and got[1].spans == [] and got[2].text == ""
    old = {r.doc_id: r.text for r in awkward.collect()}
    assert all(got[i].text == t for i, t in old.items())
    assert got[101].spans[0].pseudonym in got[100].text
    back = pseudonyms.pseudonymised(spark.createDataFrame([(100, got[100].text)], "doc_id long, text string"), KEY, back=True)
    assert back.first().text == TEXT
    assert pseudonyms.pseudonymised(nothing, KEY).count() == 0


def test_raking_meets_margins(spark):
    rng = random.Random(1)
    cells = [(s, t, float(rng.randint(1, 100))) for s in ("a", "b", None) for t in "xyz" if (s, t) != ("a", "z")] + [("b", "w", 0.0)]
    table = spark.createDataFrame(cells, "s string, t string, tokens double")
    goal_s = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 1.0), ("absent", 9.0)], "s string, share double")
    goal_t = spark.createDataFrame([("x", 0.5), ("y", 0.25), ("z", 0.25), ("w", 5.0)], "t string, share double")
    got = mixing.rake(table, {"s": goal_s, "t": goal_t}, rounds=30, every=10).collect()
    total = sum(r.weight for r in got)
    for v, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert sum(r.weight for r in got if r.s == v) / total == pytest.approx(share, abs=1e-6)
    for v, share in (("x", 0.5), ("y", 0.25), ("z", 0.25), ("w", 0)):
        assert sum(r.weight for r in got if r.t == v) / total == pytest.approx(share, abs=1e-6)


def test_mixing_of_awkward_rows(spark, awkward, nothing):
    rated = mixing.rated_documents(awkward).collect()
    assert len(rated) == 12 and all(0 <= r.probability <= 1 for r in rated)
    assert max(r.probability for r in rated) == pytest.approx(1)
    assert all(r.probability == 0 for r in rated if r._tokens == 0)
    kept = mixing.mixed(awkward)
    assert kept.columns == awkward.columns and kept.count() <= 12
    assert mixing.mixed(nothing).count() == 0


def test_rows_of_no_id_are_drawn_one_by_one(spark):
    rng = random.Random(21)
    docs = documents(spark, [(None, prose(rng, 20)) for _ in range(200)])
    for share in (0.25, 0.5):
        kept = mixing.mixed(docs, share=share)
        assert abs(kept.count() - 200 * share) < 35 and kept.select("text").distinct().count() == kept.count()


def test_a_sample_follows_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(20, 200)), rng.choice(["en", "fr"]), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    docs = documents(spark, rows)
    rated = mixing.rated_documents(docs).select("_tokens", "probability", F.col("_in_3").alias("source")).collect()
    whole, expected = Counter(), Counter()
    for r in rated:
        whole[r.source] += r._tokens
        expected[r.source] += r._tokens * r.probability
    goal = {s: n**0.8 for s, n in whole.items()}
    for s in whole:
        assert expected[s] / sum(expected.values()) == pytest.approx(goal[s] / sum(goal.values()), rel=1e-4)
    drawn = mixing.mixed(docs).count()
    assert drawn == pytest.approx(sum(r.probability for r in rated), rel=0.1)


def test_a_rare_cell_does_not_decide_what_stays(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(20, 200)), rng.choice(["en", "fr"]), "hot" if i % 3 else f"s{i % 5}") for i in range(1000)]
    rated = mixing.rated_documents(documents(spark, [*rows, (5000, prose(rng, 5), "en", "stray")])).collect()
    assert sum(r._tokens * r.probability for r in rated) == pytest.approx(0.5 * sum(r._tokens for r in rated), rel=1e-9)
    assert max(r.probability for r in rated) == 1 == [r.probability for r in rated if r._in_0 == 5000][0]


def test_a_budget_is_met_over_cells(spark):
    cells = [(t, r, t * r) for t, r in ((1000, 1.0), (500, 2.0), (10, 50.0), (1, 900.0), (7, 0.0))]
    rated = spark.createDataFrame(cells, "tokens long, _rate double, weight double")
    for share in (0.001, 0.3, 0.5, 0.9, 0.99, 1.0):
        factor = mixing._factor(rated, share)
        assert sum(t * min(1, factor * r) for t, r, _ in cells) == pytest.approx(min(share * 1518, 1511))
    assert mixing._factor(rated.limit(0), 0.5) == 0


def checked(rows, texts, capacity):
    by_sequence = defaultdict(list)
    encode = packing.public_encoding().encode_ordinary
    pieces = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.id].append((r.piece, r.start, r.length, r.ids_crc32))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts:
        ids = np.array([*encode(text or ""), 2], "<u4")
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
        assert sorted(pieces[i]) == sorted(want * sum(j == i for j, _ in texts))
    return len(by_sequence)


def test_packing_of_awkward_rows(awkward, nothing):
    texts = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    rows = packing.packed(awkward).collect()
    total = sum(r.length for r in rows)
    assert checked(rows, texts, 1024) <= -(-total // 1024) + 1
    assert packing.packed(nothing).count() == 0


def test_packing_in_blocks_is_near_the_bound(spark):
    rng = random.Random(3)
    docs = documents(spark, [(i, prose(rng, rng.randint(1, 60))) for i in range(600)])
    rows = packing.packed(docs, capacity=100, block=200).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert checked(rows, texts, 100) <= 1.04 * sum(r.length for r in rows) / 100 + 3


def test_ids_are_those_of_the_tokenizers_file(awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    public.encode_special_tokens = True
    texts = [r.text or "" for r in awkward.select("text").collect()] + ["<|endoftext|> x", "it's  \n\n 12,5 km   🙂", " " * 50 + "x"]
    encode = packing.public_encoding().encode_ordinary
    for text in texts:
        assert encode(text) == public.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts_are_those_of_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one page<|endoftext|>next page", "<|endoftext|>", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|> ", "<|endoftext |> it's", "plain"]
    got = {r.id: (r.length, r.ids_crc32) for r in packing.pieces(documents(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*public.encode(text, add_special_tokens=False).ids, packing.END], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_generations_never_lose_items_or_get_worse():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1024, 2000)
    first = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 1024)
    best = packing.evolve(sizes, [], 1024, 1, generations=8, population=4)
    assert np.bincount(best, sizes).max() <= 1024 and len(best) == 2000
    assert packing.fitness(sizes, best, 1024) >= packing.fitness(sizes, first, 1024)
    for filled in (packing.exact_fill(sizes, 1024), packing.exact_fill(sizes, 1024, rng)):
        assert np.bincount(filled, sizes).max() <= 1024 and np.bincount(filled).min() > 0
        assert filled.max() + 1 <= 1.01 * sizes.sum() / 1024 + 1
    other = packing.best_fit(sizes, rng.permutation(2000), 1024)
    child = packing.crossover(sizes, first, other, 1024, rng)
    assert (child >= 0).all() and np.bincount(child, sizes).max() <= 1024
    assert packing.best_fit(np.zeros(0, np.int64), np.zeros(0, np.int64), 1024).tolist() == []
