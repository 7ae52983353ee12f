"""Elias-Fano sequences and a two-level n-gram trie on them, read where they lie in one buffer.

A sequence keeps the low bits of its rising values in a packed array and the high bits in unary. A trie has
the context ids of its n-grams, a pointer per context to the range of its successors (monotone, so itself
Elias-Fano), the successor words of all contexts as one rising sequence (each word counted from where the
range before ended), and a quantised log probability per successor. ``Trie.open`` needs a buffer only: a
mapped file, an Arrow value or bytes; nothing is decoded but by look-ups of as many values as a sequence has,
which read it once from end to end.
"""

from __future__ import annotations

import struct

import numpy as np

SCALE = 4096.0  # a log10 probability p is kept as round(-p * SCALE), so to 1.3e-4, down to 1e-16

_U = np.uint64


def quantise(log10_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10_p * SCALE), 0, 65535).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return -(codes.astype(np.float64) / SCALE)


def _bits_at(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits from each bit position; ``words`` ends with a spare word."""
    if not width:
        return np.zeros(len(at), np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << width) - 1)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit number ``rank`` (from 0) in each word."""
    word, rank, place = word.copy(), rank.copy(), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
        go = rank >= below
        rank -= below * go
        place += width * go
        word >>= _U(width) * go.astype(np.uint64)
    return place


class Sequence:
    """A non-decreasing sequence of values below ``universe``."""

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray):
        self.size, self.width, self.low, self.high = size, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones)
        self.zeros = np.arange(1, len(high) + 1) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        width = max(0, int(universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = np.zeros(((n + (universe >> width) + 1) // 64 + 1) * 64, bool)
        bits[(values >> _U(width)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            rest = values & _U((1 << width) - 1)
            place = np.arange(n) * width
            shift = (place & 63).astype(np.uint64)
            np.bitwise_or.at(low, place >> 6, rest << shift)
            over = shift + _U(width) > 64
            np.bitwise_or.at(low, (place[over] >> 6) + 1, rest[over] >> (_U(64) - shift[over]))
        return struct.pack("<qqqq", n, width, len(low), len(high)) + low.tobytes() + high.tobytes()

    @classmethod
    def open(cls, buffer: memoryview) -> tuple[Sequence, int]:
        n, width, n_low, n_high = struct.unpack_from("<qqqq", buffer)
        low = np.frombuffer(buffer, np.uint64, n_low, 32)
        high = np.frombuffer(buffer, np.uint64, n_high, 32 + 8 * n_low)
        return cls(n, width, low, high), 32 + 8 * (n_low + n_high)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, at, "right")
        before = np.where(word > 0, self.ones[word - 1], 0)
        place = word * 64 + _select_in_word(self.high[word], at - before)
        return ((place - at) << self.width) | _bits_at(self.low, at * self.width, self.width).astype(np.int64)

    def _values(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        at = np.arange(self.size)
        return ((place - at) << self.width) | _bits_at(self.low, at * self.width, self.width).astype(np.int64)

    def _bucket_start(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits under ``bucket``."""
        rank = np.maximum(bucket - 1, 0)
        word = np.minimum(np.searchsorted(self.zeros, rank, "right"), len(self.high) - 1)
        before = np.where(word > 0, self.zeros[word - 1], 0)
        place = word * 64 + _select_in_word(~self.high[word], rank - before)
        return np.where(bucket > 0, np.minimum(place - rank, self.size), 0)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is not there (first place of equal ones)."""
        if self.size and len(values) >= self.size:
            held = self._values()
            at = np.searchsorted(held, values)
            return np.where(held[np.minimum(at, self.size - 1)] == values, at, -1)
        out = np.full(len(values), -1, np.int64)
        top = self.zeros[-1] if len(self.zeros) else 0
        open_ = np.flatnonzero((values >= 0) & ((values >> self.width) < top))
        if not self.size or not len(open_):
            return out
        bucket = values[open_] >> self.width
        at, end = self._bucket_start(bucket), self._bucket_start(bucket + 1)
        wanted = (values[open_] & ((1 << self.width) - 1)).astype(np.uint64)
        # Low bits rise within a bucket, which may be long where values are dense.
        low, high = at, end.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) >> 1
            under = _bits_at(self.low, middle * self.width, self.width) < wanted[live]
            low[live] = np.where(under, middle + 1, low[live])
            high[live] = np.where(under, high[live], middle)
        inside = np.flatnonzero(low < end)
        same = _bits_at(self.low, low[inside] * self.width, self.width) == wanted[inside]
        out[open_[inside[same]]] = low[inside[same]]
        return out


class Trie:
    """Codes of (context, word) pairs."""

    def __init__(self, contexts: Sequence, pointers: Sequence, successors: Sequence, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, codes: np.ndarray) -> bytes:
        """From different pairs in order of context, then word."""
        first = np.flatnonzero(np.diff(contexts, prepend=-1))
        last = np.append(first[1:], len(words))[: len(first)] - 1
        # Words of a range count from the end of the range before it, so the whole level rises.
        base = np.concatenate([[0], np.cumsum(words[last] + 1)])[: len(first)]
        rising = words + 1 + np.repeat(base, np.diff(np.append(first, len(words))))
        parts = [Sequence.encode(contexts[first]), Sequence.encode(np.append(first, len(words))), Sequence.encode(rising)]
        return b"".join(parts) + codes.astype("<u2").tobytes()

    @classmethod
    def open(cls, buffer) -> Trie:
        view, levels = memoryview(buffer), []
        for _ in range(3):
            level, size = Sequence.open(view)
            levels.append(level)
            view = view[size:]
        return cls(*levels, np.frombuffer(view, "<u2", levels[2].size))

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of each pair, -1 for pairs that are not there. Sorted contexts are looked up once each."""
        first = np.flatnonzero(np.diff(contexts, prepend=-1)) if len(contexts) else np.zeros(0, np.int64)
        runs = np.diff(np.append(first, len(contexts)))
        at = self.contexts.find(contexts[first])
        known = at >= 0
        begin, end, base = (np.zeros(len(first), np.int64) for _ in range(3))
        begin[known], end[known] = self.pointers[at[known]], self.pointers[at[known] + 1]
        later = known & (begin > 0)
        base[later] = self.successors[begin[later] - 1]
        place = self.successors.find(np.repeat(base, runs) + words + 1)
        inside = np.repeat(known, runs) & (place >= np.repeat(begin, runs)) & (place < np.repeat(end, runs))
        return np.where(inside, place, -1)
