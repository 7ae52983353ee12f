"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

DataFrame functions only. Documents are added up to cells (one per combination of the margins); fitting
runs on cells alone, each round written to the shared folder, and documents get their probability from
their cell without moving. A margin's sums are window sums over cells, never over documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowguard.llm.tables import restored, shielded, text_digest
from rowguard.operators.joins import lookup_join
from rowguard.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 40
EXPONENT = 0.8
#: The token budget of a mix: the expected share of all tokens that stays.
SHARE = 0.5
SEED = "mix"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse topic by what a text holds; rules are tried in this order."""
    return (
        F.when(text.contains("icense"), "legal")
        .when(text.contains(" | "), "table")
        .when(text.contains("$$$") | text.contains("###"), "noise")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("long")
    )


def tempered(cells: DataFrame, column: str, exponent: float = EXPONENT) -> DataFrame:
    """Target shares of a margin: its token shares to a power under one, so that small values gain."""
    sums = cells.groupBy(column).agg(F.sum("tokens").cast("double").alias("s"))
    return sums.select(column, F.pow("s", F.lit(exponent)).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, every: int = 4) -> DataFrame:
    """``cells`` (margin columns, ``tokens``) with ``weight``: tokens raked to the targets' shares.

    A target has the margin's column and ``share`` (any positive scale). Values of a margin without a
    target get weight zero; targets without a cell are left out and the rest scaled up to one. Cells of
    no tokens have weight zero. Null is a value like any other. The last margin is met exactly, the
    others as far as ``rounds`` rounds bring them.
    """
    current = cells.withColumn("weight", F.col("tokens").cast("double"))
    for column, target in targets.items():
        wanted = target.groupBy(F.col(column).alias("_v")).agg(F.sum("share").alias("_share"))
        current = current.join(wanted, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")
        current = current.withColumnRenamed("_share", f"_t_{column}")
    current = current.withColumn("weight", F.when(F.least(*[F.coalesce(f"_t_{c}", F.lit(0.0)) for c in targets], F.lit(1e300)) > 0, F.col("weight")).otherwise(0.0))
    for column in targets:
        # A value's share is spread over its cells to add it up once, whatever their number.
        alive = F.sum(F.when(F.col("weight") > 0, 1.0)).over(Window.partitionBy(column))
        current = current.withColumn("_part", F.when(F.col("weight") > 0, F.col(f"_t_{column}") / alive))
        current = cut_lineage(current)
        current = current.withColumn(f"_t_{column}", F.col(f"_t_{column}") / current.agg(F.sum("_part")).scalar()).drop("_part")
    current = cut_lineage(current)
    for k in range(rounds):
        for column in targets:
            held = F.sum("weight").over(Window.partitionBy(column))
            current = current.withColumn("_held", held).withColumn("weight", F.when(F.col("_held") > 0, F.col("weight") * F.col(f"_t_{column}") / F.col("_held")).otherwise(0.0)).drop("_held")
        if k % every == every - 1:
            current = cut_lineage(current)
    return current.drop(*[f"_t_{c}" for c in targets])


def draw(id_col: Column, text_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by id, text and seed, equal on every run and engine; rows of one id draw by their texts."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), text_digest(text_col)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _factor(rated: DataFrame, share: float) -> float:
    """The factor c at which tokens x min(1, c x rate) add up to ``share`` of all tokens of ``rated`` cells.

    Cells that reach 1 are taken whole and c is found again for the rest of the budget. It only grows, so
    every round has more whole cells, and it is exact once their number stays. If the cells with a rate
    hold less than the budget, all of them end whole.
    """
    budget = share * (rated.agg(F.sum("tokens").cast("double")).first()[0] or 0.0)
    factor, before = 0.0, -1
    while True:
        whole = F.col("_rate") * F.lit(factor) >= 1
        held, rest, count = rated.filter("_rate > 0").agg(F.sum(F.when(whole, F.col("tokens").cast("double"))), F.sum(F.when(~whole, F.col("weight"))), F.count_if(whole)).first()
        if count == before or not rest:
            return factor
        factor, before = max(factor, (budget - (held or 0.0)) / rest), count


def probabilities(docs: DataFrame, margins: Sequence[str], tokens_col: str, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS, share: float | None = None) -> DataFrame:
    """``docs`` with ``probability``: proportional to raked weight over tokens.

    With ``share`` it is scaled to a token budget: the expected tokens of a sample are that share of all
    tokens, cells that would pass 1 stay whole, and the others follow the targets. Without it the largest
    probability is 1, so the sample follows the targets everywhere and the rarest cell decides its size.
    Without ``targets`` a margin aims at its tempered shares. Documents of no tokens get probability 0.
    """
    cells = docs.groupBy(*margins).agg(F.sum(tokens_col).alias("tokens"))
    cells = cut_lineage(cells)
    aims = {m: (targets or {}).get(m, None) for m in margins}
    aims = {m: tempered(cells, m) if t is None else t for m, t in aims.items()}
    raked = rake(cells, aims, rounds).withColumn("_rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    raked = cut_lineage(raked)
    scaled = F.col("_rate") / raked.agg(F.max("_rate")).scalar() if share is None else F.least(F.lit(1.0), F.col("_rate") * F.lit(_factor(raked, share)))
    rated = raked.withColumn("probability", F.when(F.col("_rate") > 0, scaled).otherwise(0.0))
    keys = [F.struct(F.coalesce(F.col(m).cast("string"), F.lit("")).alias("v"), F.col(m).isNull().alias("n")) for m in margins]
    cell = F.to_json(F.struct(*keys)).alias("_cell")
    # Documents of no tokens keep what their cell has; a rate of 0 is theirs by the last step.
    joined = lookup_join(docs.withColumn("_cell", cell), rated.select(cell, "probability"), "_cell", "left").drop("_cell")
    return joined.withColumn("probability", F.when(F.col(tokens_col) > 0, F.col("probability")).otherwise(0.0))


def rated_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", share: float | None = SHARE) -> DataFrame:
    """``docs`` with every column renamed (``tables.shielded``), ``_tokens``, ``_topic`` and ``probability``."""
    renamed, at = shielded(docs)
    body = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    counted = renamed.withColumn("_tokens", token_count(body))
    topics = counted.withColumn("_topic", topic(body, F.col("_tokens")))
    return probabilities(topics, [at[source_col], at[lang_col], "_topic"], "_tokens", share=share)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", share: float | None = SHARE) -> DataFrame:
    """The sampled rows of ``docs``, some ``share`` of their tokens, with their columns; a null id draws as an empty one would, each text for itself."""
    _, at = shielded(docs)
    rated = rated_documents(docs, text_col, source_col, lang_col, share)
    return restored(rated.filter(draw(F.col(at[id_col]), F.col(at[text_col])) < F.round("probability", 9)), docs)
