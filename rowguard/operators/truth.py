"""Known errors: injecting them and profiling them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowguard import config as c
from rowguard.functions.predicates import any_true, first_true
from rowguard.operators.metrics import profile

# The error flags in their order.
ERROR_FLAGS = ("shuffle_postcode", "shuffle_lat", "shuffle_long", "swapped_geo", "typo_postcode")


def with_truth(df: DataFrame, flags: Sequence[str] = ERROR_FLAGS) -> DataFrame:
    """``is_error`` and the number of the first error kind."""
    return df.withColumns({"is_error": any_true(flags), "index_error": first_true(flags)})


def error_profile(df: DataFrame, flags: Sequence[str] = ERROR_FLAGS) -> DataFrame:
    return profile(df, list(flags))


def _hit(salt: int, one_in: int) -> Column:
    """About one row in ``one_in``, by the id alone."""
    mixed = F.pmod(F.col(c.ID), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(salt * 40503)
    return F.pmod(F.shiftright(F.pmod(mixed, F.lit(1 << 32)), 7), F.lit(one_in)) == 0


def inject_errors(df: DataFrame, one_in: int = 50, shift_lat: float = 9.0, shift_long: float = -13.0) -> DataFrame:
    """Add the five error flags and spoil the values they name.

    Postcodes get another digit order (shuffle) or lose their second character (typo),
    coordinates are moved or swapped. Choice and damage depend on the id only, so a rerun spoils
    the same rows.
    """
    flagged = df.withColumns({name: _hit(i, one_in) for i, name in enumerate(ERROR_FLAGS, start=1)})
    lat, long, code = F.col(c.LAT), F.col(c.LONG), F.col(c.POST_CODE)
    moved_lat = F.when(F.col("shuffle_lat"), lat + shift_lat).otherwise(lat)
    moved_long = F.when(F.col("shuffle_long"), long + shift_long).otherwise(long)
    shuffled = F.when(F.col("shuffle_postcode"), F.reverse(code)).otherwise(code)
    typed = F.when(F.col("typo_postcode"), F.concat(shuffled.substr(1, 1), shuffled.substr(F.lit(3), F.length(shuffled)))).otherwise(shuffled)
    return flagged.withColumns(
        {
            c.LAT: F.when(F.col("swapped_geo"), moved_long).otherwise(moved_lat),
            c.LONG: F.when(F.col("swapped_geo"), moved_lat).otherwise(moved_long),
            c.POST_CODE: typed,
        }
    )
