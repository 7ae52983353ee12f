"""How features relate: Pearson, Kendall, mutual information, label rates."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowguard.operators.ranking import dense_index, several_quantiles, steps_below
from rowguard.session import cut_lineage, shared_folder

MI_BINS = 32
KENDALL_BLOCK = 4096
RADIX = 8


def _matrix(pairs: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """Both directions of each pair plus the diagonal of ones."""
    spark = pairs.sparkSession
    mirrored = pairs.select(
        F.inline(
            F.array(
                F.struct("column_1", "column_2", value),
                F.struct(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"), F.col(value)),
            )
        )
    )
    diagonal = spark.createDataFrame([(c, c, 1.0) for c in columns], f"column_1 string, column_2 string, {value} double")
    return mirrored.unionByName(diagonal)


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in one aggregation pass."""
    cells = [
        F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"))
        for a, b in combinations(columns, 2)
    ]
    return _matrix(df.agg(F.array(*cells).alias("c")).select(F.inline("c")), columns, "pearson")


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    scaled = {}
    for name in columns:
        value = F.col(name).cast("double")
        low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
        scaled[name] = F.when(high > low, (value - low) / (high - low)).when(value.isNotNull(), F.lit(0.0))
    return df.withColumns(scaled)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: its number of distinct values and whether it is constant.

    The values of one column are grouped before they are counted, so each task counts its
    own share instead of one task holding a set of all of them.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    distinct = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).distinct()
    counts = distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    n = F.coalesce("n_distinct", F.lit(0))
    return every.join(counts, "column_name", "left").select("column_name", n.alias("n_distinct"), (n <= 1).alias("is_constant"))


def mutual_information(df: DataFrame, columns: Sequence[str], bins: int = MI_BINS) -> DataFrame:
    """Mutual information, in bits, of each pair over ``bins`` quantile bins of the columns,
    divided by the larger log2 of the two distinct counts.

    A value's bin is the number of cuts below it, the cuts being the k / ``bins`` quantiles; equal values share
    a bin. Rows collapse to at most ``bins * bins`` counts per pair before anything is compared.
    """
    complete = df.select(*columns).dropna()
    shares = [k / bins for k in range(1, bins)]
    cuts = several_quantiles(complete, [F.col(x) for x in columns], [shares] * len(columns))

    known = [[x for x in own if x is not None] for own in cuts]
    binned = complete.select(*[steps_below(F.col(x).cast("double"), own).alias(x) for x, own in zip(columns, known)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(a).alias("x"), F.col(b).alias("y"))
            for a, b in combinations(columns, 2)
        ]
    )
    # Rows with the same bins are counted before they are spread over the pairs.
    joint_bins = binned.groupBy(*columns).agg(F.count(F.lit(1)).alias("w"))
    joint = joint_bins.select("w", F.inline(cells)).groupBy("column_1", "column_2", "x", "y").agg(F.sum("w").alias("n"))
    pair = ["column_1", "column_2"]
    spread = joint.select(
        *pair,
        "n",
        F.sum("n").over(Window.partitionBy(*pair, "x")).alias("nx"),
        F.sum("n").over(Window.partitionBy(*pair, "y")).alias("ny"),
        F.sum("n").over(Window.partitionBy(*pair)).alias("total"),
    )
    # Doubles: products of counts leave the range of a long at a few billion rows.
    n, total, nx, ny = (F.col(x).cast("double") for x in ("n", "total", "nx", "ny"))
    bits = F.sum(n / total * F.log2((n / nx) * (total / ny)))
    mi = spread.groupBy(*pair).agg(bits.alias("mi"))
    sizes = distinct_counts(complete, columns).select("column_name", F.log2("n_distinct").alias("h"))
    first = sizes.select(F.col("column_name").alias("column_1"), F.col("h").alias("h1"))
    second = sizes.select(F.col("column_name").alias("column_2"), F.col("h").alias("h2"))
    h = F.greatest("h1", "h2")
    scored = mi.join(first, "column_1").join(second, "column_2").select(*pair, F.when(h > 0, F.col("mi") / h).otherwise(F.lit(0.0)).alias("nmi"))
    return _matrix(scored, columns, "nmi")


def _ranked_values(points: DataFrame, column: str, out: str) -> DataFrame:
    """The distinct values of a column with their weight and dense 0-based rank."""
    return dense_index(points.groupBy(column).agg(F.sum("w").alias("n")), [column], out)


def _tied(values: DataFrame, weight: str) -> tuple[int, int]:
    """Pairs of equal members, and the number of distinct ones; exact, in decimals of 38 digits."""
    n = F.col(weight).cast("decimal(18,0)")
    row = values.agg(F.sum((n * (n - F.lit(1).cast("decimal(1,0)"))).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    return int(row[0] or 0) // 2, row[1]


def _discordant(points: DataFrame, x_values: int, y_values: int) -> float:
    """Pairs ordered one way by x and the other way by y, from weighted ranked points (x, y, w).

    Two y ranks first differ at one digit of base RADIX. For each digit, the points that agree on
    all higher digits form a family; in it, a point is discordant with those to its left that have
    a larger digit. Each family is summed per x, then per block of x ranks, so a family that holds
    all rows is still spread over its blocks: whole blocks are paired by running block sums, and
    points within a block by running sums over the x values of that block.
    """
    digits = 1
    while RADIX**digits < y_values:
        digits += 1
    block = max(KENDALL_BLOCK, int(x_values**0.5) + 1)
    names = [f"s{v}" for v in range(RADIX)]
    digit = F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("d")
    shift = RADIX.bit_length() - 1
    parts = points.select("x", "y", "w", digit).select(
        "x", "w", "d", F.expr(f"shiftright(y, (d + 1) * {shift})").alias("family"), F.expr(f"shiftright(y, d * {shift}) & {RADIX - 1}").alias("v")
    )
    sums = [F.sum(F.when(F.col("v") == v, F.col("w")).otherwise(F.lit(0))).alias(n) for v, n in enumerate(names)]
    per_x = parts.groupBy("d", "family", "x").agg(*sums).withColumn("block", F.floor(F.col("x") / block))
    per_block = per_x.groupBy("d", "family", "block").agg(*[F.sum(n).alias(n) for n in names])

    def hits(df: DataFrame, window: Window) -> DataFrame:
        left = [F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"l{v}") for v, n in enumerate(names)]
        larger = [sum((F.col(f"l{u}") for u in range(v + 1, RADIX)), F.lit(0)) for v in range(RADIX - 1)]
        total = sum((F.col(names[v]).cast("double") * larger[v] for v in range(RADIX - 1)), F.lit(0.0))
        return df.select(*names, *left).select(total.alias("hits"))

    within = hits(per_x, Window.partitionBy("d", "family", "block").orderBy("x"))
    across = hits(per_block, Window.partitionBy("d", "family").orderBy("block"))
    return within.unionAll(across).agg(F.coalesce(F.sum("hits"), F.lit(0.0))).first()[0]


def kendall_pair(df: DataFrame, a: str, b: str) -> float | None:
    """Exact tau-b of two columns over the rows where both are known; null when one is constant."""
    known = df.select(F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")).dropna()
    points = cut_lineage(known.groupBy("u", "v").agg(F.count(F.lit(1)).alias("w")))
    total = points.agg(F.sum("w")).first()[0] or 0
    xs, ys = _ranked_values(points, "u", "x"), _ranked_values(points, "v", "y")
    (tied_x, x_values), (tied_y, y_values) = _tied(xs, "n"), _tied(ys, "n")
    pairs = total * (total - 1) // 2
    if pairs in (tied_x, tied_y):
        return None
    both, _ = _tied(points, "w")
    ranked = points.join(xs.select("u", "x"), "u").join(ys.select("v", "y"), "v").select("x", "y", "w")
    discordant = _discordant(ranked, x_values, y_values)
    concordant = pairs - tied_x - tied_y + both - discordant
    return (concordant - discordant) / ((pairs - tied_x) * (pairs - tied_y)) ** 0.5


def kendall(df: DataFrame, columns: Sequence[str], parallelism: int = 4) -> DataFrame:
    """Kendall tau-b of every pair; only the finished coefficients pass through the driver."""
    spark = df.sparkSession
    shared_folder(spark)

    def one(pair: tuple[str, str]) -> tuple[str, str, float | None]:
        return (*pair, kendall_pair(df, *pair))

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), combinations(columns, 2)))
    return _matrix(spark.createDataFrame(rows, "column_1 string, column_2 string, kendall double"), columns, "kendall")


def label_rate(df: DataFrame, feature: str, label: str) -> DataFrame:
    """How many labels each feature value has, and their mean."""
    return df.groupBy(feature).agg(F.count(label).alias("n_labels"), F.avg(label).alias("label_rate"))
