"""Bringing labels, embeddings and split indices together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import dedup_first


def lookup(probe: DataFrame, table: DataFrame, key: str, value: str, order: str, last: bool = False, strict: bool = False) -> DataFrame:
    """``probe`` with ``value`` of the first (or last) row of ``table`` for its key; with ``strict`` a missing key fails the query."""
    one = dedup_first(table.select(key, value, order), [key], [order], last).select(F.col(key).alias("__key"), F.col(value).alias(value))
    out = probe.join(one, F.col(key) == F.col("__key"), "left").drop("__key")
    if strict:
        kind = out.schema[value].dataType
        missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(kind)
        out = out.withColumn(value, F.coalesce(F.col(value), missing))
    return out


def gather(split: DataFrame, data: DataFrame, id_col: str) -> DataFrame:
    """The rows of the dataset that a split names, with its columns."""
    return split.join(data, id_col)


def alignment(a: DataFrame, b: DataFrame, position: str, sequence: str) -> DataFrame:
    """One row: sizes, rows whose sequence agrees at the same position, and the method to use (order or lookup)."""
    left = a.select(F.col(position).alias("pos"), F.col(sequence).alias("sa"), F.lit(1).alias("in_a"))
    right = b.select(F.col(position).alias("pos"), F.col(sequence).alias("sb"), F.lit(1).alias("in_b"))
    both = left.join(right, "pos", "full_outer")
    out = both.agg(
        F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"),
        F.count(F.when((F.col("in_a") == 1) & (F.col("in_b") == 1) & F.col("sa").eqNullSafe(F.col("sb")), 1)).alias("n_equal")
    )
    aligned = (F.col("n_a") == F.col("n_b")) & (F.col("n_a") == F.col("n_equal"))
    return out.withColumn("method", F.when(aligned, "order").otherwise("lookup"))


def labelled_in_order(embedded: DataFrame, data: DataFrame, position: str, sequence: str, label: str) -> tuple[DataFrame, dict]:
    """``embedded`` with ``label``, and how it was found: by position where every sequence agrees with ``data`` at its position, else by
    sequence (the last row of a repeated one; a sequence that ``data`` lacks fails the query)."""
    found = alignment(embedded, data, position, sequence).first().asDict()
    if found["method"] == "order":
        return embedded.join(data.select(position, label), position), found
    return lookup(embedded, data.select(sequence, label, position), sequence, label, position, last=True, strict=True), found
