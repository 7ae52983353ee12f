"""Column predicates and conditional columns, all JVM-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_true(columns: Sequence[str]) -> Column:
    """True when one of the boolean columns is true; a null counts as false."""
    return reduce(Column.__or__, (F.coalesce(F.col(c), F.lit(False)) for c in columns))


def first_true(columns: Sequence[str]) -> Column:
    """1-based position of the first true column, else null."""
    return F.coalesce(*[F.when(F.col(c), F.lit(i)) for i, c in enumerate(columns, start=1)])


def any_null(columns: Sequence[str]) -> Column:
    return reduce(Column.__or__, (F.col(c).isNull() for c in columns))


def is_invalid_name(column: str | Column) -> Column:
    """A name is invalid when it is missing or has a question mark on its first line."""
    value = F.col(column) if isinstance(column, str) else column
    return value.isNull() | F.substring_index(value, "\n", 1).contains("?")


def is_valid_point(lat: str, long: str) -> Column:
    """Both coordinates read as numbers and lie on the globe; never null."""
    y, x = F.col(lat).try_cast("double"), F.col(long).try_cast("double")
    return F.coalesce(y.between(-90, 90) & x.between(-180, 180), F.lit(False))


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def with_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([F.col(c).alias(c + suffix) for c in df.columns])


def cast_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def fill_max_plus_one(df: DataFrame, column: str) -> DataFrame:
    """Replace a missing code by the largest code plus one; the maximum is a subquery of the same plan."""
    largest = df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), largest + 1))


def marked(column: str | Column) -> Column:
    """Value followed by the manual-choice marker."""
    return F.concat_ws(" ", F.col(column) if isinstance(column, str) else column, F.lit("*"))


def outcome(truth: Column, prediction: Column) -> Column:
    """TP, FP, TN or FN of a 0/1 truth and prediction, else null."""
    return (
        F.when(truth & prediction, "TP")
        .when(~truth & prediction, "FP")
        .when(~truth & ~prediction, "TN")
        .when(truth & ~prediction, "FN")
    )


def marker_radius(score: str | Column) -> Column:
    """Map marker size of a score."""
    return F.abs(score) * F.lit(15)


def fuzzy_any(condition_map: Mapping[str, Sequence[str]], rate: float) -> Column:
    """One predicate over a pair row: some listed column pair scores at least ``rate``."""
    from rowguard.functions.text import composite_score

    tests = [composite_score(left, right) >= F.lit(float(rate)) for left, rights in condition_map.items() for right in rights]
    if not tests:
        raise ValueError("the condition map names no column pair")
    return reduce(Column.__or__, tests)
