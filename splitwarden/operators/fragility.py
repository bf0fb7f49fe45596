"""How much results depend on the choice of split: spreads, quartiles, pivots, ratios, gaps and representative runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, safe_ratio
from .ranking import sums_in_order


def metric_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """mean, sample std, min and max of each metric."""
    return df.groupBy(*keys).agg(
        *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    )


def fragility_stats(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """n (all rows), and mean, population std, min, max, range and cv of the rows that are numbers; cv is null for a mean of 0."""
    x = finite(F.col(metric))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", safe_ratio(F.col("std"), F.col("mean")))


def quantiles(df: DataFrame, keys: list[str], metric: str, shares: list[float]) -> DataFrame:
    """n, the rows with a number, and q0, q1, ...: exact quantiles with linear interpolation, for each of ``keys``.

    A distributed selection: distinct values with their counts are dealt out by range, running counts tell which of them hold the wanted
    ranks, and only these, two for each quantile, are kept. No task and no state holds a group.
    """
    counts = df.groupBy(*keys).agg(F.count(metric).alias("n"))
    values = df.where(F.col(metric).isNotNull()).groupBy(*keys, F.col(metric).alias("__x")).agg(F.count("*").alias("__times"))
    rows = sums_in_order(values, keys, [F.col("__x")], F.col("__times"))
    found = []
    for k, share in enumerate(shares):
        at = F.lit(share) * (F.col("__n") - 1)
        for name, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__times"))
            found.append(F.max(F.when(here, F.col("__x"))).alias(f"__{name}{k}"))
    kept = rows.groupBy(*keys).agg(*found).select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[f"__{name}{k}" for k in range(len(shares)) for name in ("low", "high")])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    out = counts.join(kept, match, "left")
    for k, share in enumerate(shares):
        at = F.lit(share) * (F.col("n") - 1)
        low, high = F.col(f"__low{k}").cast("double"), F.col(f"__high{k}").cast("double")
        out = out.withColumn(f"q{k}", F.when(low == high, low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at))))
    return out.select(*keys, "n", *[f"q{k}" for k in range(len(shares))])


def quartiles(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """n, median, q25, q75 and iqr with linear interpolation; rows with a null key are left out."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    out = quantiles(rows, keys, metric, [0.25, 0.5, 0.75])
    return out.select(*keys, "n", F.col("q1").alias("median"), F.col("q0").alias("q25"), F.col("q2").alias("q75"), (F.col("q2") - F.col("q0")).alias("iqr"))


def pivot(df: DataFrame, index: str, column: str, value: str, values: list[str]) -> DataFrame:
    """One column for each of ``values``; a repeated cell fails the query."""
    cell = F.when(F.count(value) > 1, F.raise_error(F.lit(f"{index} and {column} repeat")).cast("double")).otherwise(F.max(value))
    return df.groupBy(index).pivot(column, values).agg(cell)


def ratios(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """A column a / b for each named pair of columns."""
    out = df
    for name, (a, b) in pairs.items():
        out = out.withColumn(name, safe_ratio(F.col(a), F.col(b)))
    return out


def gaps(df: DataFrame, test: str, val: str) -> DataFrame:
    """gap = test - val, and its size."""
    return df.withColumn("gap", F.col(test) - F.col(val)).withColumn("abs_gap", F.abs(F.col("gap")))


def representatives(df: DataFrame, keys: list[str], metric: str, run: str) -> DataFrame:
    """Worst, median (the upper of two) and best run of each group; a run with two of these roles takes the first."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__k", F.row_number().over(w.orderBy(metric, run))).withColumn("__n", F.count("*").over(w))
    role = F.when(F.col("__k") == 1, "worst").when(F.col("__k") == F.floor(F.col("__n") / 2) + 1, "median").when(F.col("__k") == F.col("__n"), "best")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("__k", "__n")


def best_by(df: DataFrame, keys: list[str], metric: str, ordinal: str) -> DataFrame:
    """The row with the highest metric of each group; NaN and null count as -1, ties go to the first."""
    value = F.coalesce(finite(F.col(metric)), F.lit(-1.0))
    rows = df.withColumn("__v", value)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__v").desc(), F.col(ordinal)))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r", "__v")


def in_order(df: DataFrame, column: str, order: list[str], name: str = "position") -> DataFrame:
    """The column's place in a given order; values not in it come last."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column)).cast("int")
    return df.withColumn(name, F.when(place > 0, place - 1).otherwise(len(order)))
