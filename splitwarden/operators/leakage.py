"""Leakage checks between the parts of a split. Each returns one row per pair of parts with findings counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = {
    "train_test": [("test", "train")], "train_val": [("train", "val")], "val_test": [("test", "val")],
    "all": [("test", "train"), ("test", "val"), ("train", "val")]
}


def _pairs(spark, scope: str) -> DataFrame:
    return spark.createDataFrame(PAIRS[scope], "part_a string, part_b string")


def shared_values(df: DataFrame, column: str, scope: str = "all", part: str = "partition") -> DataFrame:
    """(part_a, part_b, n_shared): distinct values of the column that both parts hold.

    Values are reduced to the set of their parts first (three flags), so a frequent value costs one row.
    """
    where = df.where(F.col(column).isNotNull()).groupBy(column).agg(*[F.max((F.col(part) == p).cast("int")).alias(p) for p in ("train", "val", "test")])
    counts = where.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in PAIRS[scope]])
    return counts.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), F.col(f"`{a}|{b}`").cast("long").alias("n_shared")) for a, b in PAIRS[scope]]
            )
        ).alias("x")
    ).select("x.*")


def index_overlap(df: DataFrame, id_col: str, scope: str = "all") -> DataFrame:
    return shared_values(df, id_col, scope)


def exact_duplicates(df: DataFrame, sequence: str, scope: str = "all") -> DataFrame:
    """Compares digests of the whole sequences."""
    return shared_values(df.withColumn("__digest", F.sha2(sequence, 256)), "__digest", scope)


def group_overlap(df: DataFrame, field: str, scope: str = "all") -> DataFrame:
    return shared_values(df, field, scope)


def similar_embeddings(pairs: DataFrame, parts: DataFrame, id_col: str, threshold: float, scope: str = "all") -> DataFrame:
    """(part_a, part_b, n_pairs, max_similarity) of pairs (a, b, similarity) across parts at or above the threshold.

    ``pairs`` must hold all of them, as similarity.pairs_above gives; pairs of nearest neighbours do not.
    """
    p = parts.select(F.col(id_col).alias("id"), "partition")
    both = pairs.where(F.col("similarity") >= threshold)
    both = both.join(
        p.select(F.col("id").alias("a"), F.col("partition").alias("pa")), "a"
    ).join(p.select(F.col("id").alias("b"), F.col("partition").alias("pb")), "b")
    both = both.where(F.col("pa") != F.col("pb")).select(
        F.least("pa", "pb").alias("part_a"), F.greatest("pa", "pb").alias("part_b"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"
    ).dropDuplicates(["a", "b"])
    found = both.groupBy("part_a", "part_b").agg(F.count("*").alias("n_pairs"), F.max("similarity").alias("max_similarity"))
    return _pairs(parts.sparkSession, scope).join(found, ["part_a", "part_b"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
