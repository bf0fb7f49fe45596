"""Split protocols, cross-validation folds and their summaries. All are deterministic in ids and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shuffle_key
from .ranking import key_bucket, rank_in_buckets, ranked, sums_before, sums_in_order

RATIOS = (0.8, 0.1, 0.1)


def part_of(rank: Column, n: Column, ratios=RATIOS) -> Column:
    """train, val or test by rank: half-even rounded cuts, the rest is test."""
    train, val = F.bround(F.lit(float(ratios[0])) * n), F.bround(F.lit(float(ratios[1])) * n)
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def with_seeds(df: DataFrame, seeds: list[int]) -> DataFrame:
    """Each row once for each seed."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def random_split(df: DataFrame, id_col: str, seed: int = 42, ratios=RATIOS) -> DataFrame:
    rows = ranked(df, id_col, seed)
    return rows.withColumn("partition", part_of(F.col("__rank"), F.col("__n"), ratios)).withColumnRenamed("__rank", "position").drop("__n")


def stratified_split(df: DataFrame, id_col: str, stratum: str, seed: int = 42, ratios=RATIOS) -> DataFrame:
    """The random split within each stratum."""
    rows = ranked(df, id_col, seed, [stratum])
    return rows.withColumn("partition", part_of(F.col("__rank"), F.col("__n"), ratios)).withColumnRenamed("__rank", "position").drop("__n")


def split_pool(df: DataFrame, id_col: str, seeds: list[int], stratum: str | None = None, ratios=RATIOS) -> DataFrame:
    """The splits of all seeds in one job: partitioned by seed, ordered by the seeded key."""
    by = ["seed"] + ([stratum] if stratum else [])
    rows = with_seeds(df, seeds)
    rows = rows.withColumn("__key", shuffle_key(F.col(id_col), F.col("seed")))
    rows = rank_in_buckets(rows, by, key_bucket(), [F.col("__key"), F.col(id_col)]).drop("__key")
    return rows.withColumn("partition", part_of(F.col("__rank"), F.col("__n"), ratios)).drop("__rank", "__n")


def greedy_clusters(df: DataFrame, cluster: str, seed: int = 42, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """(cluster, size, partition): whole clusters in seeded order fill test, then val, until each target is reached.

    A cluster goes to test if the clusters before it have not reached the target; sizes are positive, so this equals the greedy
    loop. Sums run over one row for each cluster, in buckets of the key.
    """
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size")).withColumn("__key", shuffle_key(F.col(cluster), seed))
    order = [F.col("__key"), F.col(cluster)]
    rows = sums_before(sizes, [], key_bucket(), order, F.col("size"))
    rows = rows.withColumn(
        "__is_test", F.col("__before") < F.bround(F.lit(test) * F.col("__n"))
    ).withColumn("__val", F.bround(F.lit(val) * F.col("__n"))).drop("__before", "__n")
    rows = sums_before(rows, ["__is_test"], key_bucket(), order, F.col("size"))
    part = F.when(F.col("__is_test"), "test").when(F.col("__before") < F.col("__val"), "val").otherwise("train")
    return rows.select(cluster, "size", part.alias("partition"))


def cluster_split(df: DataFrame, cluster: str, seed: int = 42, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """Rows with the partition of their cluster; null clusters form one cluster."""
    parts = greedy_clusters(df, cluster, seed, test, val).select(F.col(cluster).alias("__cluster"), "partition")
    return df.join(parts, F.col(cluster).eqNullSafe(F.col("__cluster"))).drop("__cluster")


group_split = cluster_split


def _times(df: DataFrame, time: str) -> DataFrame:
    """(__time, __before, __n): the rows before each distinct time, and all rows; sums run in sampled ranges of time."""
    times = df.groupBy(F.col(time).alias("__time")).agg(F.count("*").alias("__size"))
    return sums_in_order(times, [], [F.col("__time")], F.col("__size"))


def temporal_split(df: DataFrame, time: str, ratios=RATIOS) -> DataFrame:
    """Cuts by time; rows of one time stay together, in the part of the first of them. Only distinct times are ranked."""
    times = _times(df, time).select("__time", part_of(F.col("__before") + 1, F.col("__n"), ratios).alias("partition"))
    return df.join(times, F.col(time).eqNullSafe(F.col("__time"))).drop("__time")


def kfold(df: DataFrame, id_col: str, folds: int = 5, seed: int = 42, stratum: str | None = None) -> DataFrame:
    rows = ranked(df, id_col, seed, [stratum] if stratum else [])
    return rows.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__rank", "__n")


def group_kfold(df: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Groups in seeded order take the folds in turn; only groups are ranked."""
    groups = ranked(df.select(group).distinct(), group, seed)
    groups = groups.select(F.col(group).alias("__group"), ((F.col("__rank") - 1) % folds).cast("int").alias("fold"))
    return df.join(groups, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def time_series_folds(df: DataFrame, time: str, folds: int = 5) -> DataFrame:
    """Consecutive blocks of time, numbered; train on the blocks before the one tested."""
    return temporal_blocks(df, time, folds)


def temporal_blocks(df: DataFrame, time: str, blocks: int) -> DataFrame:
    times = _times(df, time).select("__time", F.floor(F.col("__before") * blocks / F.col("__n")).cast("int").alias("fold"))
    return df.join(times, F.col(time).eqNullSafe(F.col("__time"))).drop("__time")


def label_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key; null keys are left out."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def fractions(df: DataFrame, key: str = "partition") -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def integrity(df: DataFrame, id_col: str, reference: DataFrame) -> DataFrame:
    """One row: totals, and whether the parts hold each id of the reference exactly once."""
    split = df.agg(F.count("*").alias("n_rows"), F.countDistinct(id_col).alias("n_ids"))
    both = df.select(id_col).distinct().withColumn("__in", F.lit(1)).join(
        reference.select(id_col).distinct().withColumn("__ref", F.lit(1)), id_col, "full_outer"
    )
    gaps = both.agg(F.count(F.when(F.col("__in").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("__ref").isNull(), 1)).alias("n_unknown"))
    out = split.crossJoin(gaps)  # one row each
    return out.withColumn("ok", (F.col("n_rows") == F.col("n_ids")) & (F.col("n_missing") == 0) & (F.col("n_unknown") == 0))
