"""Ranks and running sums in a given order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shuffle_key
from ..shared import materialise


def sums_before(df: DataFrame, by: list[str], bucket: Column, order: list, value: Column | None = None) -> DataFrame:
    """``df`` with __before, the sum of ``value`` (1 by default) over the rows before each one within ``by``, and __n, the sum over ``by``.

    ``bucket`` must not decrease along the order. Sums run within (by, bucket); the buckets' totals, one row for each, are
    summed up to offsets. So a task sorts one bucket, however large the table is.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__value", F.lit(1).cast("long") if value is None else value)
    sizes = rows.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).withColumn("__n", F.sum("__size").over(group)).drop("__size")
    renamed = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bucket").alias("__by_bucket"), "__offset", "__n")
    match = F.col("__bucket").eqNullSafe(F.col("__by_bucket"))
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    within = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__local", F.coalesce(F.sum("__value").over(within), F.lit(0))).join(renamed, match)
    return out.withColumn("__before", F.col("__offset") + F.col("__local")).drop(
        "__local", "__offset", "__value", "__bucket", "__by_bucket", *[f"__by_{c}" for c in by]
    )


def rank_in_buckets(df: DataFrame, by: list[str], bucket: Column, order: list) -> DataFrame:
    """``df`` with __rank (1, 2, ...) within ``by`` and __n, the number of rows of ``by``; see sums_before."""
    return sums_before(df, by, bucket, order).withColumn("__rank", F.col("__before") + 1).drop("__before")


def sliced(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``df`` with __slice, which doesn't decrease along ``by`` and ``order``: Spark samples splitters and deals rows out by range.

    Slices have about as many rows each, however the values lie and however large one group of ``by`` is; only rows equal in all of these
    share one for certain. The table is written, so the numbers stay what they are when a task runs again.
    """
    return materialise(df.repartitionByRange(*by, *order).withColumn("__slice", F.spark_partition_id()), "sliced")


def sums_in_order(df: DataFrame, by: list[str], order: list, value: Column | None = None) -> DataFrame:
    """``df`` with __before and __n as of ``sums_before``, in two passes over sampled ranges: sums within a slice, and slices' totals as offsets."""
    return sums_before(sliced(df, by, order), by, F.col("__slice"), order, value).drop("__slice")


def key_bucket(key: str = "__key") -> Column:
    """The first four hex digits of a digest: 65536 buckets of like size, and as many offsets at most."""
    return F.substring(key, 1, 4)


def range_bucket(df: DataFrame, column: str, buckets: int = 256) -> Column:
    """A number that rises with the column: between which of its approximate quantiles (one aggregation) a value lies; null first.

    Strings have no quantiles in Spark; their cuts come from a sample of distinct values, chosen by hash, of 16 for each bucket.
    """
    kind = dict(df.dtypes)[column]
    if kind in ("string", "binary"):
        n = df.agg(F.approx_count_distinct(column)).first()[0]
        share = max(1, n // (16 * buckets))
        sample = [
            r[0] for r in df.select(column).where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(share)) == 0)).distinct().sort(column).collect()
        ]
        cuts = sample[:: max(1, len(sample) // buckets)]
    else:
        cuts = sorted(set(df.agg(F.percentile_approx(column, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("q")).first()["q"] or []))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(column)))


def ranked(df: DataFrame, id_col: str, seed, by: list[str] | None = None) -> DataFrame:
    """Ranks in the order of the seeded md5 of the id."""
    rows = df.withColumn("__key", shuffle_key(F.col(id_col), seed))
    return rank_in_buckets(rows, by or [], key_bucket(), [F.col("__key"), F.col(id_col)]).drop("__key")
