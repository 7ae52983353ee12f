"""Fill-in-middle transformation by repeated-capture matching.

One fullmatch of ``(unit)*`` cuts a text into units: the regex library keeps every repetition of a group, so
``match.ends(1)`` is the end of each unit. Its length is the number of units, and the two cuts are looked up
in it by number; no unit is visited one by one. A unit is any pattern whose repetition covers the texts, by
default one code point.

Prefix and suffix come first and the middle last (``psm``), or suffix, prefix, middle (``spm``). Some texts
stay plain, and so does one that holds a marker, so that ``restored`` finds the text again from its output
and form. All choices are drawn from the SHA-256 of seed and id, so they are the same on every run.

Every text is worked on where it lies; nothing is shuffled. A task holds one batch, and for the text at hand
about 160 bytes a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard.llm.words import slices

CODE_POINT = r"(?s:.)"
SEED = "1"
PLAIN_FROM = 90  # of 100: texts drawn from here on stay plain
SPM_BELOW = 20  # of 100: of the others, those drawn below change places
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four numbers under 2^32 fixed by seed and id; a null id draws as an empty one would."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def unit_ends(unit: regex.Pattern, text: str) -> list[int]:
    """Where each unit of the text ends."""
    match = unit.fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover a text")
    return match.ends(1)


def rearranged(text: str, ends: list[int], first: int, second: int, form: str) -> str:
    """The text cut after ``first`` and ``second`` units, in the order of ``form``."""
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW
) -> DataFrame:
    """``id, n, form, prefix_units, middle_units, output``, one row per row of ``docs``.

    ``n`` counts units; the two lengths are in units and null for plain texts, whose output is the text. Null
    texts are empty, and empty texts plain. Repeated rows have the same result, null ids that of an empty id;
    other columns play no part, whatever their names; an empty table gives no rows. A text that the units do
    not cover ends the job.
    """
    pattern = f"({unit})*"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(pattern)
        for batch in batches:
            for part in slices(batch, "body"):
                columns = [part.column(c).to_pylist() for c in ("body", "plain", "h1", "h2", "h4")]
                out: dict[str, list] = {"n": [], "form": [], "prefix_units": [], "middle_units": [], "output": []}
                for text, plain, h1, h2, h4 in zip(*columns):
                    ends = unit_ends(units, text)
                    n = len(ends)
                    row = (n, "plain", None, None, text)
                    if not plain:
                        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                        form = "spm" if h4 % 100 < spm_below else "psm"
                        row = (n, form, first, second - first, rearranged(text, ends, first, second, form))
                    for values, value in zip(out.values(), row):
                        values.append(value)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["id", *out])

    h1, h2, h3, h4 = draws(F.col("id"), seed)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    marked = F.contains("body", F.lit(PREFIX)) | F.contains("body", F.lit(SUFFIX)) | F.contains("body", F.lit(MIDDLE))
    drawn = rows.select("id", "body", ((F.col("body") == "") | marked | (h3 % 100 >= plain_from)).alias("plain"), h1.alias("h1"), h2.alias("h2"), h4.alias("h4"))
    kind = rows.schema["id"].dataType.simpleString()
    return drawn.mapInArrow(each, f"id {kind}, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form; a rearranged text holds each marker once."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))
