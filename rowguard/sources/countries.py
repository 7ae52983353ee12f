"""The country dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ISO 3166 alpha-2 codes in scope with their names, plus KV for Kosovo.
COUNTRIES = {
    "AM": "Armenia",
    "AT": "Austria",
    "BA": "Bosnia and Herzegovina",
    "BG": "Bulgaria",
    "CH": "Switzerland",
    "CY": "Cyprus",
    "CZ": "Czechia",
    "EE": "Estonia",
    "EG": "Egypt",
    "GB": "United Kingdom",
    "GR": "Greece",
    "HR": "Croatia",
    "HU": "Hungary",
    "IE": "Ireland",
    "IT": "Italy",
    "KV": "Kosovo",
    "LT": "Lithuania",
    "LV": "Latvia",
    "MD": "Moldova, Republic of",
    "ME": "Montenegro",
    "NG": "Nigeria",
    "PL": "Poland",
    "RO": "Romania",
    "RS": "Serbia",
    "SI": "Slovenia",
    "SK": "Slovakia",
    "UA": "Ukraine",
}


def country_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(COUNTRIES.items()), "country_code string, country_name string")


def with_country(df: DataFrame, code_col: str) -> DataFrame:
    """Add ``country_name`` and ``is_known_country``; the dimension is a fixed 27 rows, so it is broadcast."""
    dim = F.broadcast(country_table(df.sparkSession))
    joined = df.join(dim, F.upper(df[code_col]) == dim["country_code"], "left")
    return joined.withColumn("is_known_country", F.col("country_code").isNotNull()).drop("country_code")
