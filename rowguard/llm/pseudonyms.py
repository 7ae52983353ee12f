"""Format-preserving pseudonyms for personal numbers and dates.

A value that passes its format's own check (Luhn digit, IBAN remainder, calendar, number plan) is read as
an index into the set of all valid values of that format, the index is permuted by a keyed Feistel network
(cycle-walking keeps it inside the set), and the new value is written in the punctuation of the old one.
The permutation depends on key and format alone, so equal values stay equal across documents however they
are punctuated, different ones stay different, and the holder of the key can turn them back. Texts are
changed where they lie; nothing is shuffled.

Cards are sought in whole runs of digit groups: unbroken ones first, then the usual groupings, then whatever
begins or ends the run. IBANs end at their country's length, or else at the last space where their remainder fits. Where a pseudonym would let
another reading of the same digits come first, it is walked on, so that it can always be turned back.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowguard.llm.words import slices

ROUNDS = 8
#: For tests and the registered query; a job passes its own secret.
SAMPLE_KEY = b"sample key, not a secret"

FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

_BEFORE, _AFTER = r"(?<![\w.+/-])", r"(?![\w/-]|\.\d)"
_REST = (
    r"(?P<date>\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<phone>(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d(?:[ ./-]?\(?\d\)?){7,14})"
)
_PATTERN = re.compile(_BEFORE + "(?:" + _REST + r"|(?P<card>\d(?:[ -]?\d){12,})|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z\d]){10,30}))" + _AFTER, re.ASCII)
_IN_RUN = re.compile(_BEFORE + "(?:" + _REST + ")" + _AFTER, re.ASCII)
#: Longer than any match of ``_IN_RUN``.
_REACH = 80
_GROUPINGS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4))
#: Country calling codes; no code begins another.
_CODE = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
KINDS = tuple(_PATTERN.groupindex)
#: Length of an IBAN by country.
_IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
        "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    pseudonym: str


def _round(key: bytes, label: bytes, number: int, half: int, bits: int) -> int:
    digest = hashlib.blake2b(label + number.to_bytes(1, "big") + half.to_bytes(16, "big"), key=key, digest_size=16).digest()
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, label: str, back: bool = False) -> int:
    """A keyed permutation of 0 to ``size`` - 1; ``back`` undoes it."""
    bits = max(1, -(-(size - 1).bit_length() // 2))
    low = (1 << bits) - 1
    tag = f"{label}:{size}:".encode()
    while True:
        left, right = value >> bits, value & low
        if back:
            for k in reversed(range(ROUNDS)):
                left, right = right ^ _round(key, tag, k, left, bits), left
        else:
            for k in range(ROUNDS):
                left, right = right, left ^ _round(key, tag, k, right, bits)
        value = left << bits | right
        if value < size:
            return value


def luhn_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(digits: str, move: Callable[[int, int, str], int]) -> str | None:
    if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    while True:  # a number of one repeated digit is not taken for a card, so it is no pseudonym either
        body = str(move(int(digits[:-1]), 10**n, f"card{n}")).zfill(n)
        digits = body + str(luhn_digit(body))
        if len(set(digits)) > 1:
            return digits


def _remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(old: str, move: Callable[[int, int, str], int]) -> str | None:
    country, check, body = old[:2], old[2:4], old[4:]
    if _remainder(body + country + check) != 1:
        return None
    sizes = [10 if c.isdigit() else 26 for c in body]
    value = 0
    for c, n in zip(body, sizes):
        value = value * n + (int(c) if n == 10 else ord(c) - 65)
    shape = str(len(body)) if set(sizes) == {10} else "".join("9" if n == 10 else "A" for n in sizes)
    value, new = move(value, math.prod(sizes), f"iban{country}{shape}"), ""
    for n in reversed(sizes):
        value, at = divmod(value, n)
        new = (str(at) if n == 10 else chr(at + 65)) + new
    return country + f"{98 - _remainder(new + country + '00'):02d}" + new


def _phone(old: str, digits: str, move: Callable[[int, int, str], int]) -> str:
    """The digits after the country code, which stays; without a code or with +1 a number is the same."""
    head = _CODE.match(digits).group() if old[0] == "+" else digits[:-10]
    n = len(digits) - len(head)
    label = "phone" if n == 10 and head in ("", "1") else f"phone{head}:{n}"
    return head + str(move(int(digits[len(head) :]), 10**n, label)).zfill(n)


def _ssn(digits: str, move: Callable[[int, int, str], int]) -> str | None:
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    at = area - 1 - (area > 666)
    value = move((at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    at = value // (99 * 9999) + 1
    return f"{at + (at >= 666):03d}{value // 9999 % 99 + 1:02d}{value % 9999 + 1:04d}"


def _date(day: int, month: int, year: int, move: Callable[[int, int, str], int]) -> datetime.date | None:
    """Days up to 12 stay among each other, so that a date reads in the same order again."""
    try:
        at = datetime.date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    while 0 <= at < DAYS:
        at = move(at, DAYS, "date")
        new = datetime.date.fromordinal(at + FIRST_DAY)
        if (new.day > 12) == (day > 12):
            return new
    return None


def _rewritten(kind: str, old: str, move: Callable[[int, int, str], int]) -> str | None:
    """``old`` with its value moved, in the same punctuation; None if it fails its check."""
    if kind == "ip":
        parts = old.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "date":
        if old[4] == "-":
            new = _date(int(old[8:]), int(old[5:7]), int(old[:4]), move)
            return new and new.isoformat()
        first, second, year = int(old[:2]), int(old[3:5]), int(old[6:])
        if first <= 12 < second:  # only the month can stand first
            new = _date(second, first, year, move)
            return new and f"{new.month:02d}{old[2]}{new.day:02d}{old[5]}{new.year:04d}"
        new = _date(first, second, year, move)
        return new and f"{new.day:02d}{old[2]}{new.month:02d}{old[5]}{new.year:04d}"
    if kind == "iban":
        new = _iban(old.replace(" ", ""), move)
    else:
        digits = re.sub(r"\D", "", old)
        new = _phone(old, digits, move) if kind == "phone" else {"card": _card, "ssn": _ssn}[kind](digits, move)
    if new is None:
        return None
    left = iter(new)
    return "".join(next(left) if c.isalnum() else c for c in old)


@lru_cache(1 << 16)
def pseudonym(kind: str, old: str, key: bytes, back: bool = False) -> str | None:
    return _rewritten(kind, old, lambda value, size, label: permute(value, size, key, label, back))


def _valid(kind: str, old: str) -> bool:
    return _rewritten(kind, old, lambda value, size, label: value) is not None


def _first_fits(text: str, offset: int, kind: str, readings: Iterable[tuple[int, int]], key: bytes, back: bool) -> list[Span]:
    """Readings of ``text`` that pass their check and meet no earlier one; ``offset`` is where it begins."""
    found, failed = [], []
    for a, b in readings:
        if any(a < s.end - offset and s.start - offset < b for s in found):
            continue
        new = pseudonym(kind, text[a:b], key, back)
        if new is None:
            failed.append((a, b))
            continue
        rivals = [(c, d) for c, d in failed if c < b and a < d]
        while any(_valid(kind, (text[:a] + new + text[b:])[c:d]) for c, d in rivals):
            new = pseudonym(kind, new, key, back)
        text = text[:a] + new + text[b:]
        found.append(Span(offset + a, offset + b, kind, new))
    return found


def _card_readings(run: str) -> Iterator[tuple[int, int]]:
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    size = [b - a for a, b in groups]
    last = len(groups) - 1
    yield from (g for g, n in zip(groups, size) if 13 <= n <= 19)
    for shape in _GROUPINGS:
        for i in range(len(groups) - len(shape) + 1):
            if tuple(size[i : i + len(shape)]) == shape:
                yield groups[i][0], groups[i + len(shape) - 1][1]
    ends = [(0, j) for j in range(min(last, 18), -1, -1)] + [(i, last) for i in range(max(1, last - 18), last + 1)]
    yield from ((groups[i][0], groups[j][1]) for i, j in ends if j > i and 13 <= sum(size[i : j + 1]) <= 19)


def _in_run(text: str, start: int, end: int, key: bytes, back: bool) -> tuple[list[Span], int]:
    """What a run of digit groups holds, other kinds before cards, and where to go on."""
    others, at = [], start
    while at < end and (match := _IN_RUN.search(text, at, end + _REACH)) and match.start() < end:
        new = pseudonym(match.lastgroup, match.group(), key, back)
        if new is not None and match.end() > end:
            end = match.start()
            break
        if new is not None:
            others.append(Span(match.start(), match.end(), match.lastgroup, new))
        at = match.start() + 1 if new is None else match.end()
    found = list(others)
    for a, b in zip([start, *[s.end for s in others]], [*[s.start for s in others], end]):
        found += _first_fits(text[a:b], a, "card", _card_readings(text[a:b]), key, back)
    return sorted(found), end


def spans(text: str, key: bytes, back: bool = False) -> list[Span]:
    found, at = [], 0
    while match := _PATTERN.search(text, at):
        kind, old = match.lastgroup, match.group()
        if kind == "card":
            new, at = _in_run(text, match.start(), match.end(), key, back)
        elif kind == "iban":
            ends = [len(old), *[i for i in range(len(old) - 1, 0, -1) if old[i] == " "]]
            sizes = {e: e - old[:e].count(" ") for e in ends}
            readings = [(0, e) for e in sorted(ends, key=lambda e: (sizes[e] != _IBAN_LENGTHS.get(old[:2]), -e)) if sizes[e] >= 14]
            new = _first_fits(old, match.start(), kind, readings, key, back)
            at = new[0].end if new else match.start() + 1
        else:
            moved = pseudonym(kind, old, key, back)
            new = [Span(match.start(), match.end(), kind, moved)] if moved is not None else []
            at = match.end() if new else match.start() + 1
        found += new
    return found


def replaced(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for span in found:
        out += [text[at : span.start], span.pseudonym]
        at = span.end
    return "".join([*out, text[at:]]) if out else text


SPANS = "array<struct<start:int,end:int,kind:string,pseudonym:string>>"


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """``id, text, spans``: every text with its valid numbers and dates replaced, and where they were.

    Null texts stay null and have no spans. Values that fail their check are left alone. With ``back`` the
    pseudonyms of the same key are turned into the values they stand for.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bodies = part.column("text").to_pylist()
                found = [spans(b, key, back) if b else [] for b in bodies]
                new = [b and replaced(b, s) for b, s in zip(bodies, found)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(new, pa.string()), pa.array([[s._asdict() for s in x] for x in found], kind)], names=["id", "text", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, text string, spans {SPANS}")
