"""Similar values of a dictionary, found by equi-joins on signatures instead of all pairs.

Inputs are *distinct values*, never records. Two strings that keep a common subsequence of
given length share the string left after deleting the other characters, so short strings
meet on their deletion signatures; long ones meet on an untouched segment; strings whose
words contain one another meet on the rarest word; where a threshold lets substrings match, a
segment of the shorter string meets any place of the longer one. Each rule is complete for the
threshold, so a search loses no match and has no cap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.functions.text import composite_score, jaro_winkler_score, normalised, tokens_of
from rowguard.operators.joins import lookup_join, salted_join
from rowguard.operators.ranking import first_per_group
from rowguard.session import cut_lineage

MAX_DELETIONS = 2
DELETION_LENGTH = 24  # longer strings meet on segments, which are few at any length
# What the composite gives its partial (substring) forms, by how many times longer one string is.
PARTIAL_SCALES = ((0.9, 1.5, 8.0), (0.6, 8.0, math.inf))


def deletions(text: Column, count: int) -> Column:
    """All distinct strings left after deleting exactly ``count`` characters."""
    level = F.array(text)
    for _ in range(count):
        level = F.array_distinct(
            F.flatten(
                F.transform(
                    level,
                    lambda s: F.when(
                        F.length(s) > 0,
                        F.transform(
                            F.sequence(F.lit(1), F.length(s)),
                            lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))),
                        ),
                    ).otherwise(F.array()),
                )
            )
        )
    return level


# -- edit distance -------------------------------------------------------------------------


def edit_neighbours(values: DataFrame, column: str, distance: int = 1, group: str | None = None) -> DataFrame:
    """Pairs of distinct values (``left < right``) within an edit distance, within a group if given.

    Strings at distance d or less share a string reached by at most d deletions from each side, or,
    when they are long, a segment.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    keys = [group] if group else []
    base = values.select(*keys, F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
    close = (F.col("left") < F.col("right")) & (F.levenshtein("left", "right", distance) >= 0)
    every = F.array_distinct(F.concat(*[deletions(F.col("v"), i) for i in range(distance + 1)]))
    marks = base.filter(F.length("v") <= DELETION_LENGTH).select(*keys, "v", F.explode(every).alias("mark"))
    left = marks.select(*keys, "mark", F.col("v").alias("left"))
    right = marks.select(*keys, "mark", F.col("v").alias("right"))
    # Exploded signatures are taken for as small as their values, so Spark would broadcast them by itself.
    short = left.join(right.hint("merge"), [*keys, "mark"]).filter(close).select(*keys, "left", "right")
    # Longer strings: of distance + 1 segments one stays whole, at most ``distance`` places away.
    long = base.filter(F.length("v") > DELETION_LENGTH - distance)
    stock = _cut_up(long, F.length("v"), distance).select(*keys, "n", "no", F.col("v").alias("a"), F.col("v").substr(F.col("start") + 1, F.col("width")).alias("mark"))
    sizes = long.select("*", F.explode(F.sequence(F.length("v") - distance, F.length("v") + distance)).alias("size"))
    probes = _cut_up(sizes, F.col("size"), distance).select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - distance), F.col("start") + distance)).alias("at"))
    probes = probes.select(*keys, "n", "no", F.col("v").alias("b"), F.col("v").substr(F.col("at") + 1, F.col("width")).alias("mark")).distinct()
    met = salted_join(stock, probes, [*keys, "n", "no", "mark"], "inner", most=10_000).filter(F.col("a") != F.col("b"))
    met = met.select(*keys, F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).filter(close)
    pairs = short.unionByName(met).distinct()
    return pairs.withColumn("distance", F.levenshtein("left", "right"))


def _cut_up(df: DataFrame, size: Column, distance: int) -> DataFrame:
    """Rows once per segment of a string of ``size``: its number, start and width."""
    count = distance + 1
    sized = df.select("*", size.alias("n")).filter(F.col("n") >= count)
    cut = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("no"))
    start, stop = (F.floor((F.col("no") + i) * F.col("n") / count).cast("int") for i in (0, 1))
    return cut.select("*", start.alias("start"), (stop - start).alias("width"))


def spelling_edges(values: DataFrame, column: str = c.CITY, distance: int = 1, threshold: float = 97.0) -> DataFrame:
    """Pairs within an edit distance whose Jaro-Winkler similarity x 100 reaches ``threshold``."""
    near = edit_neighbours(values, column, distance)
    scored = near.withColumn("similarity_score_jellyfish", jaro_winkler_score("left", "right"))
    return scored.filter(F.col("similarity_score_jellyfish") >= threshold)


def closest_spelling(edges: DataFrame) -> DataFrame:
    """For each value of an edge its most similar partner; equal scores go to the smallest string."""
    both = _both_ways(edges.select("left", "right", "similarity_score_jellyfish"), "similarity_score_jellyfish")
    top = both.groupBy("value").agg(F.min(F.struct((-F.col("similarity_score_jellyfish")).alias("s"), "matched")).alias("m"))
    return top.select("value", F.col("m.matched").alias("matched"), (-F.col("m.s")).alias("similarity_score_jellyfish"))


def _both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    forth = edges.select(F.col("left").alias("value"), F.col("right").alias("matched"), *extra)
    back = edges.select(F.col("right").alias("value"), F.col("left").alias("matched"), *extra)
    return forth.unionByName(back)


# -- composite similarity ------------------------------------------------------------------


def _limits(threshold: float) -> tuple[float, float | None]:
    """Least plain ratio, and least word ratio (None if words alone cannot reach it), of a match.

    Scores are rounded, so a match may lie half a point lower.
    """
    if threshold <= 0:
        raise ValueError("a search needs a threshold above 0: every pair reaches 0")
    plain = (threshold - 0.5) / 100 - 1e-9
    word_points = math.ceil((threshold - 0.5) / 0.95 - 1e-9)
    return plain, ((word_points - 0.5) / 100 - 1e-9) if word_points <= 100 else None


def _short_limit(rate: float) -> int:
    """Longest string from which a match never needs more than MAX_DELETIONS deletions."""
    length = 1
    while (length + 1) * (1 - rate) / (1 - rate / 2) < MAX_DELETIONS + 1:
        length += 1
    return length


def _deletion_marks(keys: DataFrame, text: str, rate: float) -> DataFrame:
    """Signatures of the strings up to the short limit, with as many deletions as a match can need."""
    size = F.length(text)
    per_char = (1 - rate) / (1 - rate / 2)
    layers = [F.when(size * per_char + 1e-9 >= i, deletions(F.col(text), i)).otherwise(F.array()) for i in range(MAX_DELETIONS + 1)]
    short = keys.filter(size.between(1, _short_limit(rate)))
    marks = F.array_distinct(F.concat(*layers))
    return short.select("key", "name", "size", size.alias("text_size"), F.explode(marks).alias("mark"))


def _comparable(rate: float) -> Column:
    """Lengths under 1.5 to 1; a ratio of 0.8 or less is also within reach of other lengths."""
    return F.lit(rate <= 0.8) | (F.greatest("size", "other_size") < 1.5 * F.least("size", "other_size"))


def _sizes_allow(rate: float) -> Column:
    """The shared mark is long enough for both texts, and both keys are of comparable length."""
    enough = 2 * F.length("mark") >= rate * (F.col("text_size") + F.col("other_text_size"))
    return enough & _comparable(rate)


def _short_pairs(left: DataFrame, right: DataFrame, text: str, rate: float, best_only: bool) -> DataFrame:
    """Pairs that meet on a deletion signature.

    All strings of one length below one mark are equally good partners there, so when only the
    best partner counts, the two smallest names of each (mark, lengths) stand for all of them:
    a crowded mark costs one row per member instead of one per pair.
    """
    probe = _deletion_marks(left, text, rate)
    stock = _deletion_marks(right, text, rate)
    if best_only:
        stock = first_per_group(stock, ["mark", "text_size", "size"], [F.col("name")], 2)
    stock = stock.select(
        "mark", F.col("key").alias("other"), F.col("size").alias("other_size"), F.col("text_size").alias("other_text_size")
    )
    met = probe.join(stock.hint("merge"), "mark").filter((F.col("key") != F.col("other")) & _sizes_allow(rate))
    return met.select("key", "other").distinct()


def _long_pairs(left: DataFrame, right: DataFrame, text: str, rate: float) -> DataFrame:
    """Pairs whose longer text is beyond the short limit.

    The shorter text is cut into one segment more than a match may have edits, so one segment
    stays whole and lies in the other text at most as far off as the edits allow.
    """
    limit = _short_limit(rate)
    stretch = (2 - rate) / rate

    def segments(df: DataFrame) -> DataFrame:
        sized = df.select("key", "size", F.col(text).alias("text"), F.length(text).alias("n"))
        sized = sized.filter(F.col("n") * stretch + 1e-9 >= limit + 1)
        count = F.least(F.col("n"), (F.floor(F.col("n") * (2 * (1 - rate) / rate) + 1e-9) + 1).cast("int"))
        sized = sized.withColumn("count", count)
        cut = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("no"))
        start = F.floor(F.col("no") * F.col("n") / F.col("count")).cast("int")
        stop = F.floor((F.col("no") + 1) * F.col("n") / F.col("count")).cast("int")
        return cut.select("key", "size", "text", "n", "no", F.col("text").substr(start + 1, stop - start).alias("mark"))

    def windows(df: DataFrame, occurring: DataFrame) -> DataFrame:
        sized = df.select(F.col("key").alias("other"), F.col("size").alias("other_size"), F.col(text).alias("other_text"))
        sized = sized.withColumn("m", F.length("other_text")).filter(F.col("m") > limit)
        shortest = F.greatest(F.lit(1), F.ceil(F.col("m") / stretch - 1e-9).cast("int"))
        # Lengths that no text of the stock has are left out; there are at most as many as the longest text has characters.
        lengths = sized.select("*", F.explode(F.sequence(shortest, F.col("m"))).alias("n")).join(F.broadcast(occurring), "n")
        count = F.least(F.col("n"), (F.floor(F.col("n") * (2 * (1 - rate) / rate) + 1e-9) + 1).cast("int"))
        edits = F.floor((F.col("n") + F.col("m")) * (1 - rate) + 1e-9).cast("int")
        cut = lengths.select("*", count.alias("count"), edits.alias("edits"), F.explode(F.sequence(F.lit(0), count - 1)).alias("no"))
        start = F.floor(F.col("no") * F.col("n") / F.col("count")).cast("int")
        stop = F.floor((F.col("no") + 1) * F.col("n") / F.col("count")).cast("int")
        gap = F.col("m") - F.col("n")
        first = F.greatest(F.lit(0), start - F.floor((F.col("edits") - gap) / 2).cast("int"))
        last = F.least(F.col("m") - (stop - start), start + F.floor((F.col("edits") + gap) / 2).cast("int"))
        placed = cut.select("*", start.alias("start"), (stop - start).alias("width"), first.alias("first"), last.alias("last"))
        placed = placed.filter(F.col("first") <= F.col("last"))
        spots = placed.select("*", F.explode(F.sequence("first", "last")).alias("at"))
        mark = F.col("other_text").substr(F.col("at") + 1, F.col("width"))
        return spots.select("other", "other_size", "other_text", "m", "edits", "n", "no", mark.alias("mark")).distinct()

    # The edit distance never exceeds the insertions and deletions, so it rejects most meetings
    # inside the join, before anything is emitted.
    near = F.expr("levenshtein(text, other_text, edits) >= 0") & (F.col("key") != F.col("other"))
    comparable = _comparable(rate)

    def meet(stock: DataFrame, probes: DataFrame) -> DataFrame:
        # A segment that very many texts share is split over many tasks.
        occurring = stock.select(F.length(text).alias("n")).distinct()
        met = salted_join(segments(stock), windows(probes, occurring), ["n", "no", "mark"], "inner", most=10_000)
        return met.filter(near & comparable).select("key", "other")

    return _either_way(left, right, meet)


def _either_way(left: DataFrame, right: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pairs met with either side as the stock; of one table with itself the second is the mirror of the first."""
    forth = meet(left, right)
    back = forth if left is right else meet(right, left)
    return forth.unionByName(back.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct()


def _word_pairs(left: DataFrame, right: DataFrame, rate: float) -> DataFrame:
    """Pairs in which the words of one are, but for a few characters, among the words of the other.

    The nearly contained side is filed under its rarest words only - one, plus one for each word
    it may have for itself - so a word that most values use files almost none of them.
    """
    slack = (2 - 2 * rate) / (2 - rate)
    words = left.select("key", "size", "words").unionByName(right.select("key", "size", "words")).dropDuplicates(["key"])
    rarity = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))

    def filed(df: DataFrame) -> DataFrame:
        single = df.select("key", "size", "words", "sorted_text", F.explode("words").alias("word"))
        single = lookup_join(single, rarity, "word", "inner")
        ranked = single.groupBy("key").agg(
            F.first("size").alias("size"),
            F.first("words").alias("words"),
            F.first("sorted_text").alias("sorted_text"),
            F.sort_array(F.collect_list(F.struct("uses", "word"))).alias("ranked"),
        )
        own = F.floor(F.length("sorted_text") * slack / 2 + 1e-9).cast("int")
        ranked = ranked.withColumn("own", own)
        return ranked.select("key", "size", "words", "own", F.explode(F.slice("ranked", 1, F.col("own") + 1)).alias("r")).select(
            "key", "size", "words", "own", F.col("r.word").alias("word")
        )

    def meet(stock: DataFrame, probes: DataFrame) -> DataFrame:
        asked = probes.select(
            F.col("key").alias("other"), F.col("size").alias("other_size"), F.col("words").alias("other_words"), F.explode("words").alias("word")
        )
        inside = F.size(F.array_except("words", "other_words")) <= F.col("own")
        comparable = F.greatest("size", "other_size") < 1.5 * F.least("size", "other_size")
        met = salted_join(asked, filed(stock), ["word"], "inner")
        return met.filter((F.col("key") != F.col("other")) & inside & comparable).select("key", "other")

    return _either_way(left, right, meet)


def _overlap_pairs(left: DataFrame, right: DataFrame, rate: float) -> DataFrame:
    """Pairs with words in common whose texts, shared words first and own words after, reach ``rate``.

    No own word of one side is a word of the other, so each is touched by an edit, and an edit touches two
    words at most: a side has at most twice as many own words as there are edits. All other words are
    shared, so if both sides order their words by rarity, a shared word is among the first of both, one
    more than the own words there can be. Only those are filed, so common words meet on short texts alone.
    """
    words = left.select("key", "words").unionByName(right.select("key", "words")).dropDuplicates(["key"])
    rarity = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))

    def filed(df: DataFrame) -> DataFrame:
        single = lookup_join(df.select("key", F.explode("words").alias("word")), rarity, "word", "inner")
        ranked = single.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("uses", "word"))).alias("ranked"))
        # The other text is at most (2 - rate) / rate times as long.
        edits = F.floor(F.length("sorted_text") * F.lit(2 * (1 - rate) / rate) + 1e-9).cast("int")
        first = F.slice("ranked", F.lit(1), 2 * edits + 1)
        return df.join(ranked, "key").select("key", "size", "words", "sorted_text", F.explode(F.transform(first, lambda r: r["word"])).alias("word"))

    other = filed(right).select("word", *[F.col(x).alias(f"other_{x}") for x in ("key", "size", "words", "sorted_text")])
    lengths = F.length("sorted_text") + F.length("other_sorted_text")
    possible = 2 * F.least(F.length("sorted_text"), F.length("other_sorted_text")) >= rate * lengths - 1e-9
    met = salted_join(filed(left), other, ["word"], "inner").filter((F.col("key") != F.col("other_key")) & possible)
    met = met.filter(F.greatest("size", "other_size") < 1.5 * F.least("size", "other_size"))
    shared = F.array_intersect("words", "other_words")
    texts = [F.array_join(F.concat(shared, F.array_except(a, b)), " ") for a, b in (("words", "other_words"), ("other_words", "words"))]
    edits = F.floor(lengths * (1 - rate) + 1e-9).cast("int")
    near = met.select("key", F.col("other_key").alias("other"), texts[0].alias("a"), texts[1].alias("b"), edits.alias("edits"))
    # The edit distance never exceeds the insertions and deletions.
    return near.filter(F.expr("levenshtein(a, b, edits) >= 0")).select("key", "other").distinct()


def _partial_pairs(keys: DataFrame, others: DataFrame, text: str, rate: float, low: float, high: float) -> DataFrame:
    """Pairs of lengths ``low`` to ``high`` to one whose shorter text may be like a window of the longer one.

    A window has at most ``2 * (1 - rate)`` edits per character of the shorter text. Cut into one segment
    more than that, it has a segment that stands somewhere in the longer text as it is. A lower rate
    means shorter segments, more meetings and a dearer search, never a refused one.
    """
    per_char = 2 * (1 - rate)
    widest = int(1 / per_char) + 1 if per_char > 0 else 1 << 20

    def segments(df: DataFrame) -> DataFrame:
        sized = df.select("key", "size", F.length(text).alias("n"), F.col(text).alias("text")).filter(F.col("n") > 0)
        count = F.least(F.col("n"), (F.floor(F.col("n") * per_char + 1e-9) + 1).cast("int"))
        cut = sized.withColumn("count", count).select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("no"))
        start = F.floor(F.col("no") * F.col("n") / F.col("count")).cast("int")
        stop = F.floor((F.col("no") + 1) * F.col("n") / F.col("count")).cast("int")
        return cut.select("key", "size", "n", F.col("text").substr(start + 1, stop - start).alias("mark")).distinct()

    def windows(df: DataFrame) -> DataFrame:
        sized = df.select(F.col("key").alias("other"), F.col("size").alias("other_size"), F.length(text).alias("m"), F.col(text).alias("text"))
        widths = sized.filter(F.col("m") > 0).select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(widest)))).alias("width"))
        spots = widths.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("width") + 1)).alias("at"))
        return spots.select("other", "other_size", "m", F.col("text").substr(F.col("at"), F.col("width")).alias("mark")).distinct()

    spread = F.greatest("size", "other_size") / F.least("size", "other_size")
    apart = (spread >= low) & ((spread <= high) if high < math.inf else F.lit(True)) & (F.col("key") != F.col("other"))

    def meet(stock: DataFrame, probes: DataFrame) -> DataFrame:
        met = salted_join(segments(stock), windows(probes), ["mark"], "inner", most=10_000)
        return met.filter(apart & (F.col("n") <= F.col("m"))).select("key", "other").distinct()

    return _either_way(keys, others, meet)


def _shared_word_pairs(left: DataFrame, right: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs of lengths ``low`` to ``high`` to one with a word in common: the shared words are a window of either."""
    single = left.select("key", "size", F.explode("words").alias("word"))
    asked = right.select(F.col("key").alias("other"), F.col("size").alias("other_size"), F.explode("words").alias("word"))
    spread = F.greatest("size", "other_size") / F.least("size", "other_size")
    apart = (spread >= low) & ((spread <= high) if high < math.inf else F.lit(True)) & (F.col("key") != F.col("other"))
    return salted_join(single, asked, ["word"], "inner").filter(apart).select("key", "other").distinct()


def _keys(values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their normalised key, and one row per key named by its smallest value."""
    named = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    named = cut_lineage(named.withColumn("key", normalised("value")).filter(F.col("key") != ""))
    keys = named.groupBy("key").agg(F.min("value").alias("name"))
    keys = keys.select("key", "name", F.length("key").alias("size"), tokens_of(F.col("key")).alias("words"))
    return named, cut_lineage(keys.withColumn("sorted_text", F.array_join("words", " ")))


def candidate_keys(left: DataFrame, right: DataFrame, threshold: float, best_only: bool = False) -> DataFrame:
    """Every pair of different keys whose composite score can reach ``threshold``."""
    plain, word = _limits(threshold)
    found = _short_pairs(left, right, "key", plain, best_only).unionByName(_long_pairs(left, right, "key", plain))
    if word is not None:
        found = (
            found.unionByName(_short_pairs(left, right, "sorted_text", word, best_only))
            .unionByName(_long_pairs(left, right, "sorted_text", word))
            .unionByName(_word_pairs(left, right, word))
            .unionByName(_overlap_pairs(left, right, word))
        )
    for scale, low, high in PARTIAL_SCALES:
        for text, share in (("key", scale), ("sorted_text", 0.95 * scale)):
            points = math.ceil((threshold - 0.5) / share - 1e-9)
            if points <= 100:
                found = found.unionByName(_partial_pairs(left, right, text, (points - 0.5) / 100 - 1e-9, low, high))
        if threshold - 0.5 <= 95 * scale:
            found = found.unionByName(_shared_word_pairs(left, right, low, high))
    return found.distinct()


def best_matches(values: DataFrame, column: str = c.CITY, threshold: float = c.FUZZY_THRESHOLD) -> DataFrame:
    """For each distinct value the *other* value with the highest composite score, if it reaches ``threshold``.

    Equal scores go to the smallest string, so the result does not depend on any order.
    """
    named, keys = _keys(values, column)
    pairs = candidate_keys(keys, keys, threshold, best_only=True)
    scored = pairs.withColumn("score", composite_score("key", "other")).filter(F.col("score") >= threshold)
    partner = scored.join(keys.select(F.col("key").alias("other"), F.col("name").alias("matched")), "other")
    across = named.join(partner.select("key", "matched", "score"), "key").select("value", "matched", "score")
    # Values with one key score 100; the two smallest of a key are enough to name each one's partner.
    firsts = first_per_group(named, ["key"], [F.col("value")], 2).select("key", F.col("value").alias("matched"))
    alike = named.join(firsts, "key").filter(F.col("value") != F.col("matched")).select("value", "matched", F.lit(100.0).alias("score"))
    best = across.unionByName(alike).groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("s"), "matched")).alias("m"))
    return best.select("value", F.col("m.matched").alias("matched"), (-F.col("m.s")).alias("similarity_score_fuzzy"))


def match_pairs(
    values: DataFrame,
    column: str = c.CITY,
    threshold: float = c.FUZZY_THRESHOLD,
    jaro_winkler_threshold: float = c.JARO_WINKLER_THRESHOLD,
) -> DataFrame:
    """Best matches that also pass the Jaro-Winkler test, which guards short strings."""
    found = best_matches(values, column, threshold)
    tested = found.withColumn("similarity_score_jellyfish", jaro_winkler_score("value", "matched"))
    kept = tested.filter(F.col("similarity_score_jellyfish") >= jaro_winkler_threshold)
    return kept.withColumnsRenamed({"value": column, "matched": "matched_city"})


def fuzzy_join(left: DataFrame, right: DataFrame, condition_map: dict[str, list[str]], rate: float) -> DataFrame:
    """All row pairs of two tables in which some listed column pair scores at least ``rate``.

    Matching runs on the distinct values of each column pair; rows join on the matched values.
    Column names of the two tables must differ.
    """
    if not any(condition_map.values()):
        raise ValueError("the condition map names no column pair")
    given: list[tuple[str, str, DataFrame]] = []
    joined: DataFrame | None = None
    for a, b in [(a, b) for a, bs in condition_map.items() for b in bs]:
        matched = _matched_values(left, a, right, b, rate)
        rows = lookup_join(lookup_join(left.withColumn("_a", F.col(a)), matched, "_a", "inner").drop("_a"), right.withColumn("_b", F.col(b)), "_b", "inner").drop("_b")
        for x, y, earlier in given:
            # A row pair that an earlier column pair already gave is not given again: its match table says so.
            known = earlier.select(F.col("_a").alias(x), F.col("_b").alias(y), F.lit(True).alias("_given"))
            rows = lookup_join(rows, known, [x, y], "left").filter(F.col("_given").isNull()).drop("_given")
        given.append((a, b, matched))
        rows = rows.select(*left.columns, *right.columns)
        joined = rows if joined is None else joined.unionByName(rows)
    return joined


def _matched_values(left: DataFrame, a: str, right: DataFrame, b: str, rate: float) -> DataFrame:
    """``_a, _b``: the pairs of values of two columns that score at least ``rate``, each once."""
    values_a, keys_a = _keys(left, a)
    values_b, keys_b = _keys(right, b)
    pairs = candidate_keys(keys_a, keys_b, rate)
    same = keys_a.select("key").join(keys_b.select("key"), "key").select("key", F.col("key").alias("other"))
    scored = pairs.withColumn("score", composite_score("key", "other")).filter(F.col("score") >= rate)
    hits = scored.select("key", "other").unionByName(same)
    found = hits.join(values_a.select("key", F.col("value").alias("_a")), "key").join(values_b.select(F.col("key").alias("other"), F.col("value").alias("_b")), "other")
    return cut_lineage(found.select("_a", "_b"))
