"""Confusion counts, score cuts, curves and histograms; one aggregation pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowguard.session import cut_lineage
from rowguard.operators.ranking import quantiles

# The sweep runs over 101 evenly spaced cuts from -0.9 to -0.4.
SWEEP_START = -0.9
SWEEP_STEP = 0.005
SWEEP_CUTS = 101


def _counts(truth: Column, predicted: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(truth & predicted),
        "tn": F.count_if(~truth & ~predicted),
        "fp": F.count_if(~truth & predicted),
        "fn": F.count_if(truth & ~predicted),
    }


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """TP, TN, FP and FN; a row with a null truth or prediction counts in none."""
    return df.agg(*[v.alias(k) for k, v in _counts(truth, predicted).items()])


def alert_precision(df: DataFrame, truth: Column) -> DataFrame:
    """TP, FP and precision when every emitted row with an id counts as positive."""
    from rowguard.config import ID

    present = F.col(ID).isNotNull()
    out = df.agg(F.count_if(truth & present).alias("tp"), F.count_if(~truth & present).alias("fp"))
    return out.withColumn("precision", _share("tp", F.col("tp") + F.col("fp")))


def _share(part: str, whole: Column) -> Column:
    return F.when(whole > 0, F.col(part) / whole).otherwise(F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of rows with tp, tn, fp, fn; 0 where a denominator is 0."""
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    with_rates = counts.withColumns(
        {
            "accuracy": F.when(tp + tn + fp + fn > 0, (tp + tn) / (tp + tn + fp + fn)).otherwise(F.lit(0.0)),
            "precision": _share("tp", tp + fp),
            "recall": _share("tp", tp + fn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return with_rates.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def confusion_at(df: DataFrame, score: str, truth: str, cuts: Sequence[float]) -> DataFrame:
    """One confusion row per cut (``score < cut`` is positive), all from one aggregation."""
    if not cuts:
        raise ValueError("no cut-off given")
    real = F.col(truth)
    packed = [
        F.struct(F.lit(float(cut)).alias("cut"), *[v.alias(k) for k, v in _counts(real, F.col(score) < cut).items()])
        for cut in cuts
    ]
    return df.agg(F.array(*packed).alias("rows")).select(F.inline("rows"))


def _cut(i: Column) -> Column:
    return F.lit(SWEEP_START) + i * F.lit(SWEEP_STEP)


def _cuts_at_or_below(score: Column) -> Column:
    """How many sweep cuts are <= score: the guess by division, corrected against the cut values themselves."""
    guess = F.greatest(F.lit(0), F.least(F.lit(SWEEP_CUTS), F.floor((score - SWEEP_START) / SWEEP_STEP))).cast("int")
    near = [F.when((i >= 0) & (i < SWEEP_CUTS) & (_cut(i) <= score), 1).otherwise(0) for i in (guess - 1, guess, guess + 1)]
    return F.greatest(F.lit(0), F.least(guess - 1, F.lit(SWEEP_CUTS))) + near[0] + near[1] + near[2]


def _placed(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Rows with a score and a truth, and the sweep cell of the score."""
    known = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(F.col(score).alias("score"), F.col(truth).alias("truth"))
    return known.withColumn("cell", _cuts_at_or_below(F.col("score")))


def _tally() -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth")).alias("pos")


def _sweep_cells(placed: DataFrame) -> DataFrame:
    """Rows and positives of each of the 102 cells, added up in the tasks first."""
    return placed.groupBy("cell").agg(*_tally(), F.min("score").alias("lowest"), F.max("score").alias("top"))


def _with_ties(placed: DataFrame) -> DataFrame:
    """Cells with the rows and positives at their highest score: a second pass, against 102 values."""
    cells = cut_lineage(_sweep_cells(placed))
    tops = F.broadcast(cells.select("cell", "top"))  # at most one row per cell
    ties = placed.join(tops, "cell").filter(F.col("score") == F.col("top")).groupBy("cell").agg(*_tally())
    ties = ties.select("cell", F.col("n").alias("n_top"), F.col("pos").alias("pos_top"))
    highest = F.struct(F.col("top").alias("score"), F.col("n_top").alias("n"), F.col("pos_top").alias("pos"))
    return cells.join(F.broadcast(ties), "cell").select("cell", "n", "pos", "lowest", highest.alias("highest"))


def _sweep_cuts(spark: SparkSession) -> DataFrame:
    return spark.range(SWEEP_CUTS).select(F.col("id").cast("int").alias("i"), _cut(F.col("id")).alias("threshold"))


def _running(known: DataFrame, spark: SparkSession) -> DataFrame:
    """Cuts with the rows and positives below each, the lowest score at or above it and the highest below it.

    A score is below cut i exactly when at most i cuts are <= it. The window runs over the
    fixed 101 cuts.
    """
    grid = spark.range(SWEEP_CUTS + 1).select(F.col("id").cast("int").alias("i")).join(known, F.col("i") == F.col("cell"), "left")
    upto = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    run = grid.select(
        "i",
        _cut(F.col("i")).alias("threshold"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("below"),
        F.coalesce(F.sum("pos").over(upto), F.lit(0)).alias("below_pos"),
        F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("total"),
        F.coalesce(F.sum("pos").over(whole), F.lit(0)).alias("total_pos"),
        *([F.max("highest").over(upto).alias("left_point")] if "highest" in known.columns else []),
        F.min("lowest").over(after).alias("right_point"),
    )
    return run.filter(F.col("i") < SWEEP_CUTS)


def sweep(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Confusion counts and F1 of ``score < threshold`` at each of the 101 cuts."""
    run = _running(_sweep_cells(_placed(df, score, truth)), df.sparkSession)
    counts = run.select(
        "threshold",
        F.col("below_pos").alias("tp"),
        (F.col("total") - F.col("total_pos") - F.col("below") + F.col("below_pos")).alias("tn"),
        (F.col("below") - F.col("below_pos")).alias("fp"),
        (F.col("total_pos") - F.col("below_pos")).alias("fn"),
    )
    return metrics(counts)


def best_cut(swept: DataFrame) -> DataFrame:
    """The first threshold with the highest F1."""
    best = swept.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("neg"))).alias("m"))
    return best.select((-F.col("m.neg")).alias("best_threshold"), F.col("m.f1").alias("best_f1"))


def precision_recall(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Precision and recall at the observed score nearest to each sweep cut.

    A point of the curve is an observed score v with ``score < v`` as the positive side, the
    same side as the sweep. The nearest point to a cut is the highest score below it or the
    lowest at or above it (the lower one when equally near), so the curve itself is never
    gathered: it stays a per-cell minimum and maximum.
    """
    run = _running(_with_ties(_placed(df, score, truth)), df.sparkSession)
    left, right = F.col("left_point.score"), F.col("right_point")
    use_left = right.isNull() | (F.col("threshold") - left <= right - F.col("threshold"))
    rows = F.when(use_left, F.col("below") - F.col("left_point.n")).otherwise(F.col("below"))
    hits = F.when(use_left, F.col("below_pos") - F.col("left_point.pos")).otherwise(F.col("below_pos"))
    picked = run.select(
        "threshold", F.when(use_left, left).otherwise(right).alias("score"), rows.alias("rows"), hits.alias("tp"), "total_pos"
    )
    return picked.select(
        "threshold",
        "score",
        F.when(F.col("rows") > 0, F.col("tp") / F.col("rows")).otherwise(F.lit(1.0)).alias("precision"),
        F.when(F.col("total_pos") > 0, F.col("tp") / F.col("total_pos")).otherwise(F.lit(0.0)).alias("recall"),
    )


def quartile_fence(df: DataFrame, score: str) -> float | None:
    """-(Q3 + 1.5 IQR) of the absolute score, quartiles interpolated."""
    size = df.select(F.abs(score).alias("v"))
    q1, q3 = quantiles(size, "v", [0.25, 0.75], interpolate=True)
    return None if q3 is None else -(q3 + 1.5 * (q3 - q1))


def z_tail(df: DataFrame, score: str, z: float = 1.5) -> DataFrame:
    """Minus the smallest absolute score whose z value, by population deviation, exceeds ``z``; null if none."""
    size = df.select(F.abs(score).alias("v"))
    mean, spread = size.agg(F.avg("v")).scalar(), size.agg(F.stddev_pop("v")).scalar()
    far = (spread > 0) & (F.col("v") - mean > F.lit(z) * spread)
    return size.agg((-F.min(F.when(far, F.col("v")))).alias("z_tail"))


def auto_cut(df: DataFrame, score: str) -> DataFrame:
    """Estimated cut: the lower of fence and z tail, 2 decimals."""
    fence = F.lit(quartile_fence(df, score)).cast("double")
    return z_tail(df, score).select(
        fence.alias("fence"), "z_tail", F.round(F.least(fence, F.col("z_tail")), 2).alias("estimated_threshold")
    )


def auto_threshold(df: DataFrame, score: str, truth: str) -> DataFrame:
    """The estimated cut beside the cut with the best F1."""
    best = best_cut(sweep(df, score, truth))
    return auto_cut(df, score).select(
        "estimated_threshold",
        best.select("best_threshold").scalar().alias("best_threshold"),
        best.select("best_f1").scalar().alias("best_f1"),
    )


def histogram(df: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """Counts of ``bins`` equal-width bins between the extremes; the last bin is closed."""
    values = df.select(F.col(score).alias("v")).filter(F.col("v").isNotNull())
    low, high = values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar()
    spot = F.when(high > low, F.floor((F.col("v") - low) / (high - low) * bins)).otherwise(F.lit(0))
    counts = values.groupBy(F.least(spot, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def value_range(df: DataFrame, score: str, flag: str) -> DataFrame:
    """Lowest and highest score of the flagged rows (the colour scale of a map)."""
    return df.filter(F.col(flag)).agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
