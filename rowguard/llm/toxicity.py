"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its byte n-grams (with marks at both ends), a window the mean of
its words, and a softmax over two classes is linear in that mean; embeddings and softmax are trained
jointly in numpy. Misspelled words share most n-grams with the words they stand for. A document's score is
that of its worst window, so that a few words in a long text are not averaged away; in training the window
that scores highest stands for the document.

Training reads a bounded sample of labelled rows (``MOST_DOCS`` documents, the lowest by hash of the id)
in one task, so texts never reach the driver, which sees the model alone (1 MB); scoring reads every whole
text and shuffles nothing. Null texts are empty, a text without words gets the score of the bias alone, and
a null label counts as no label. Of two texts of one id the larger string is learnt from; repeated rows are
each scored; columns of any other name play no part; an empty table has no scores and fits the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard.llm.tables import restored, shielded
from rowguard.llm.words import Words, prefix_sums, range_hash, slices, word_hashes, words

BUCKETS = 1 << 17
DIMENSIONS = 8
SIZES = (3, 4, 5, 6)
WINDOW = 3
MOST_DOCS = 4000
MOST_CHARS = 30_000  # longer documents are left out of training, never of scoring
EPOCHS = 12
RATE = 1.5
THRESHOLD = 0.3


class Model(NamedTuple):
    """``pull`` is embedding times (toxic - clean) row of the softmax: all that a score needs."""

    pull: np.ndarray
    bias: float
    window: int


def subwords(found: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of the words at ``keep``, and where each word's begin."""
    lengths = (found.ends - found.starts)[keep]
    size = lengths + 2
    places = np.concatenate([[0], np.cumsum(size)])
    data = np.empty(places[-1], np.uint8)
    data[places[:-1]], data[places[1:] - 1] = 60, 62
    inner = np.cumsum(lengths)
    offsets = np.arange(inner[-1] if len(inner) else 0) - np.repeat(inner - lengths, lengths)
    data[np.repeat(places[:-1] + 1, lengths) + offsets] = found.data[np.repeat(found.starts[keep], lengths) + offsets]
    sums = prefix_sums(data)
    counts = [np.maximum(size - n + 1, 0) for n in SIZES] + [np.ones(len(size), np.int64)]
    starts = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0))])
    out = np.empty(starts[-1], np.int64)
    filled = starts[:-1].copy()
    for n, count in zip((*SIZES, 0), counts):
        ends = np.cumsum(count)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        begin = np.repeat(places[:-1], count) + step
        end = begin + n if n else np.repeat(places[1:], count)
        out[np.repeat(filled, count) + step] = (range_hash(sums, begin, end) % np.uint64(BUCKETS)).astype(np.int64)
        filled += count
    return out, starts


def _window_means(values: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of every run of ``window`` words inside a document (all words if fewer), and their documents."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first[:-1], count)
    stop = np.minimum(at + window, np.repeat(first[1:], count))
    return (sums[stop] - sums[at]) / (stop - at), count


def worst_windows(values: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """The largest window mean per document; 0 where there are no words."""
    means, count = _window_means(values, first, window)
    out = np.zeros(len(first) - 1)
    filled = np.flatnonzero(count)
    if len(filled):
        out[filled] = np.maximum.reduceat(means, np.concatenate([[0], np.cumsum(count[filled])[:-1]]))
    return out


def word_pulls(model: Model, found: Words) -> np.ndarray:
    _, keep, back = np.unique(word_hashes(found), return_index=True, return_inverse=True)
    slots, starts = subwords(found, keep)
    if not len(keep):
        return np.zeros(0)
    return (np.add.reduceat(model.pull[slots], starts[:-1]) / np.diff(starts))[back]


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    found = words(texts)
    logits = worst_windows(word_pulls(model, found), found.first, model.window) + model.bias
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


class _Sample(NamedTuple):
    first: np.ndarray  # words of text i are first[i] to first[i + 1]
    vocab: np.ndarray  # place of every word's subwords
    slots: np.ndarray
    starts: np.ndarray


def _sample(texts: pa.Array) -> _Sample:
    """Words and subwords of all texts, slice by slice; subwords once per different word."""
    batch = pa.RecordBatch.from_arrays([texts], names=["body"])
    known, firsts, hashes, slots, widths = np.zeros(0, np.uint64), [np.zeros(1, np.int64)], [], [], []
    names = []
    for part in slices(batch, "body", 1 << 20):
        found = words(part.column("body"))
        own = word_hashes(found)
        different, at = np.unique(own, return_index=True)
        new = ~np.isin(different, known)
        known = np.union1d(known, different)
        part_slots, part_starts = subwords(found, at[new])
        slots.append(part_slots.astype(np.int32))
        widths.append(np.diff(part_starts))
        names.append(different[new])
        hashes.append(own)
        firsts.append(found.first[1:] + firsts[-1][-1])
    if not names:
        return _Sample(np.zeros(len(texts) + 1, np.int64), *(np.zeros(0, np.int32) for _ in range(2)), np.zeros(1, np.int64))
    order = np.argsort(np.concatenate(names))
    vocab = order[np.searchsorted(np.concatenate(names)[order], np.concatenate(hashes))].astype(np.int32)
    return _Sample(np.concatenate(firsts), vocab, np.concatenate(slots), np.concatenate([[0], np.cumsum(np.concatenate(widths))]))


def train(texts: pa.Array, labels: np.ndarray, seed: int = 1) -> Model:
    """Fit embeddings and softmax on the windows that stand for each document, by Adagrad."""
    first, vocab, slots, starts = _sample(texts)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    soft = rng.uniform(-1, 1, DIMENSIONS) / DIMENSIONS
    bias = 0.0
    seen_table, seen_soft, seen_bias = np.full(BUCKETS, 1e-3), 1e-3, 1e-3
    docs = np.flatnonzero(np.diff(first))
    if not len(docs) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))), WINDOW)
    for epoch in range(EPOCHS):
        pull = (table @ soft).astype(np.float32)
        values = (np.add.reduceat(pull[slots], starts[:-1]) / np.diff(starts))[vocab]
        means, count = _window_means(values, first, WINDOW)
        edges = np.concatenate([[0], np.cumsum(count)])
        order = rng.permutation(docs)
        for part in range(0, len(order), 64):
            picked = order[part : part + 64]
            at, target = [], []
            for d in picked.tolist():
                high = int(np.argmax(means[edges[d] : edges[d + 1]]))
                spread = 6 if epoch < 2 else 2
                chosen = {high} if epoch else set()
                if labels[d] == 0 or epoch == 0:
                    chosen |= set(rng.integers(0, count[d], spread).tolist())
                at += [first[d] + w for w in chosen]
                target += [labels[d]] * len(chosen)
            begin = np.array(at)
            stop = np.minimum(begin + WINDOW, first[np.searchsorted(first, begin, "right")])
            size = stop - begin
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(begin, size)
            w = vocab[where]
            width = starts[w + 1] - starts[w]
            tops = np.cumsum(width)
            grams = slots[np.arange(tops[-1]) - np.repeat(tops - width, width) + np.repeat(starts[w], width)]
            share = np.repeat(1 / (width * np.repeat(size, size)), width)
            bag = np.repeat(np.repeat(np.arange(len(size)), size), width)
            mean = np.stack([np.bincount(bag, share * table[grams, k], len(size)) for k in range(DIMENSIONS)], axis=1)
            logit = np.clip(mean @ soft + bias, -30, 30)
            error = 1 / (1 + np.exp(-logit)) - np.array(target)
            error /= len(picked) ** 0.5
            slot, back = np.unique(grams, return_inverse=True)
            weight = np.bincount(back, share * error[bag], len(slot))
            step = weight[:, None] * soft[None, :]
            seen_table[slot] += (step**2).sum(1)
            gradient = error @ mean
            table[slot] -= RATE * step / np.sqrt(seen_table[slot])[:, None]
            seen_soft += float((gradient**2).sum())
            soft = soft - RATE * gradient / np.sqrt(seen_soft)
            seen_bias += float(error.sum() ** 2)
            bias -= RATE * float(error.sum()) / np.sqrt(seen_bias)
    return Model(table @ soft, bias, WINDOW)


def _id_text(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(_id_text(id_col)) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_DOCS) -> Model:
    """Train on at most ``most`` labelled documents of up to ``MOST_CHARS`` characters that are not held out.

    A document labelled more than once counts as toxic if any label says so. Without labels of both kinds
    the score is the share of toxic ones.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & ~held_out("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    picked = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    # At most ``most`` rows, so it may go to every task.
    joined = rows.filter(F.length("body") <= MOST_CHARS).join(F.broadcast(picked), "id")
    sample = joined.groupBy("id").agg(F.max("body").alias("body"), F.max("label").alias("label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            found = pa.Table.from_batches(held).sort_by("id")
            model = train(found.column("body").combine_chunks(), found.column("label").to_numpy().astype(np.int64))
        else:
            model = train(pa.array([], pa.string()), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.pull.tobytes()]), pa.array([model.bias]), pa.array([model.window])], names=["pull", "bias", "window"])

    # One task holds the bounded sample; what comes back is one row of BUCKETS doubles.
    row = sample.repartition(1).mapInArrow(learn, "pull binary, bias double, window long").first()
    if row is None:
        return train(pa.array([], pa.string()), np.zeros(0, np.int64))
    return Model(np.frombuffer(bytes(row["pull"])), row["bias"], row["window"])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score_texts(model, part.column("body")))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(each, f"id {kind}, score double")
    return scored.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``, with their columns."""
    model = fit(docs, labels, id_col, text_col)
    renamed, at = shielded(docs)
    body = at[text_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body):
                yield part.filter(pa.array(score_texts(model, part.column(body)) < threshold))

    return restored(renamed.mapInArrow(each, renamed.schema), docs)
