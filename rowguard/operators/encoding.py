"""Integer codes for categories such that neighbouring codes are dissimilar words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.operators.joins import lookup_join


LOOK = 256  # words looked at first; each further look takes four times as many
_marks = np.zeros(0x110000, np.uint64)


def distances_to(word: str, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edit distance of one word to every row of a padded letter table.

    A column of the table of distances is two words of bits per row, where it rises and where it falls (Myers, 1999);
    words beyond 64 letters take the columns as numbers.
    """
    m = len(word)
    if not m:
        return sizes.astype(np.int64)
    if m > 64:
        return _long_distances(word, letters, sizes)
    for i, ch in enumerate(word):
        _marks[ord(ch)] |= np.uint64(1 << i)
    one, top = np.uint64(1), np.uint64(m - 1)
    rises, falls = np.full(len(letters), np.uint64(2**64 - 1)), np.zeros(len(letters), np.uint64)
    last = np.full(len(letters), m)
    out = last.copy()
    for j in range(letters.shape[1]):
        same = _marks[letters[:, j]]
        down = same | falls
        along = (((same & rises) + rises) ^ rises) | same
        more, less = falls | ~(along | rises), rises & along
        last = last + ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        rises, falls = less | ~(down | more), more & down
        np.copyto(out, last, where=sizes > j)
    for ch in word:
        _marks[ord(ch)] = 0
    return out


def _long_distances(word: str, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    width = letters.shape[1]
    row = np.repeat(np.arange(width + 1)[None, :], len(letters), axis=0)
    steps = np.arange(width + 1)
    for i, ch in enumerate(word, start=1):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != ord(ch)))
        new = np.concatenate([np.full((len(letters), 1), i), best], axis=1)
        # An insertion chain along the row costs one per step: a running minimum of value - position.
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(letters)), sizes]


def walk(words: list[str]) -> list[str]:
    """From the smallest word on, always to the farthest unused word; ties to the smallest.

    No word is farther than the longer of the two lengths, so words are tried from the longest down; those too
    short to beat the best one found are not compared, nor larger ones that could at best be as far.
    """
    words = sorted(words)
    sizes = np.array([len(w) for w in words])
    place = np.lexsort((np.arange(len(words)), -sizes))  # longest first, then smallest
    letters = np.zeros((len(words), max(1, sizes.max(initial=0))), np.int64)
    for row, i in enumerate(place.tolist()):
        letters[row, : sizes[i]] = [ord(ch) for ch in words[i]]
    unused = place != 0
    order = [0]
    for _ in range(len(words) - 1):
        open_ = np.flatnonzero(unused)
        if len(open_) * 2 < len(place):
            place, letters, unused = place[open_], letters[open_], unused[open_]
            open_ = np.arange(len(open_))
        here = words[order[-1]]
        best, at = -1, 0
        a, look = 0, LOOK
        while a < len(open_):
            bound = max(int(sizes[place[open_[a]]]), len(here))
            if bound < best:
                break
            part = open_[a : a + look]
            a, look = a + look, look * 4
            if bound == best:
                # As far at most, so only a smaller word counts.
                part = part[place[part] < at]
                if not len(part):
                    continue
            own = sizes[place[part]]
            far = distances_to(here, letters[part, : max(1, own[0])], own)
            top = int(far.max())
            found = int(place[part[far == top]].min())
            if top > best or (top == best and found < at):
                best, at = top, found
        order.append(at)
        unused[place == at] = False
    return [words[i] for i in order]


def encode_dictionary(
    df: DataFrame, category: str = c.STANDARD, partition: str = c.COMMON_CLUSTER, output: str = c.CODE, block: int | None = None
) -> DataFrame:
    """``<partition>, word, <output>``: codes 1, 2, ... running on across clusters.

    The walk is sequential, so it runs on distinct words only, one task per cluster, at any size.
    A caller with very large clusters can set ``block``: then every cluster, whatever its size, is
    dealt by hash to blocks of about that many words, walked side by side and numbered one after
    the other, so which word follows which is decided within a block.
    """
    distinct = df.select(F.col(partition).alias("part"), F.col(category).alias("word")).dropna().distinct()
    # A word is keyed to one cluster, the smallest, so that the dictionary never multiplies records.
    words = distinct.groupBy("word").agg(F.min("part").alias("part"))
    sizes = words.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.lit(1) if block is None else F.ceil(F.col("size") / block)
    blocks = blocks.cast("long")
    placed = words.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("word"), blocks))

    def number(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered = walk(group["word"].tolist())
        return pd.DataFrame({"part": key[0], "block": key[1], "word": ordered, "place": np.arange(1, len(ordered) + 1)})

    part_type = df.schema[partition].dataType.simpleString()
    walked = placed.select("part", "block", "word").groupBy("part", "block").applyInPandas(
        number, f"part {part_type}, block long, word string, place long"
    )
    # One row per block.
    filled = placed.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("part", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    coded = walked.join(starts, ["part", "block"])
    return coded.select(F.col("part").alias(partition), "word", (F.col("start") + F.col("place")).alias(output))


def encode(
    df: DataFrame, category: str = c.STANDARD, partition: str = c.COMMON_CLUSTER, output: str = c.CODE, block: int | None = None
) -> DataFrame:
    """Records with their category's code and the word it stands for; no category, no code."""
    codes = encode_dictionary(df, category, partition, output, block)
    codes = codes.select(F.col("word").alias(category), "word", output)
    return lookup_join(df, codes, category).select(*df.columns, output, "word")
