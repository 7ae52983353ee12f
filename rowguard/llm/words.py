"""Words of many texts at once: positions and 64-bit hashes in numpy, one Arrow batch at a time.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z, other letters stay as they
are. Null texts are empty. Nothing here looks at more than one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 2 << 20
KEPT_POWERS = 1 << 24
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP_BACK = pow(_STEP, -1, 2**64)


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words of text i are first[i] to first[i + 1]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece has about ``most`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    part = (offsets[1:] - offsets[0]) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    raw, offsets = flat(texts)
    data = _LOWER[raw]
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        filled = np.flatnonzero(np.diff(offsets))
        before[offsets[filled]] = False
        after[offsets[filled + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


_held: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """``size`` powers at least; one array per base is kept and grown, up to ``KEPT_POWERS``."""
    out = _held.get(base)
    if out is None or len(out) < size:
        out = np.full(_room(size), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if len(out) <= KEPT_POWERS:
            _held[base] = out
    return out


def prefix_sums(data: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Sums of value * power up to every byte, modulo 2^64; see ``range_hash``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(values[data], _powers(_STEP, len(data))[: len(data)], out=sums[1:])
    return np.cumsum(sums, out=sums)


def _room(n: int) -> int:
    return 1 << max(20, int(n).bit_length())


def back_powers(sums: np.ndarray) -> np.ndarray:
    """What makes sums of equal bytes equal wherever they begin."""
    return _powers(_STEP_BACK, len(sums))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from each start to its end; equal bytes have equal hashes anywhere."""
    back = back_powers(sums)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(found: Words) -> np.ndarray:
    """64-bit hash per word; at 10^8 different words the chance that any two meet is about 3 in 10^4.

    Words are taken eight bytes at a time, all words at once; every step is mixed before the next one comes, so
    no sum of powers is left that repetitive words could cancel. Words over ``LONG_WORD`` bytes are hashed
    by XXH3.
    """
    starts, lengths = found.starts, found.ends - found.starts
    padded = np.concatenate([found.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(found.data) + 1, "<u8", padded, strides=(1,))
    out = mix(lengths.astype(np.uint64) * np.uint64(_STEP))
    live = np.flatnonzero(lengths <= LONG_WORD)
    done = 0
    while len(live):
        left = lengths[live] - done
        part = eight[starts[live] + done] & _LOW_BYTES[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ part) + part * np.uint64(_STEP)
        live = live[left > 8]
        done += 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxh3_64_intdigest(padded[starts[i] : found.ends[i]], 42)
    return out
