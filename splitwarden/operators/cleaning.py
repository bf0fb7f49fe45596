"""Cleaning, casting, deduplication and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strip
from .ranking import ranked


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def clean_nonempty(df: DataFrame, column: str) -> DataFrame:
    """Text without outer white space; null and blank rows go."""
    return df.withColumn(column, strip(F.col(column).cast("string"))).where(F.length(column) > 0)


def binary_label(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """The column as 0 or 1. Values that aren't numbers go, or fail the query with ``strict``; other numbers fail it always."""
    value = F.expr(f"try_cast(`{column}` as double)")
    out = df.withColumn(column, value)
    if strict:
        out = out.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} has a value that is no number"))).otherwise(F.col(column)))
    out = out.where(F.col(column).isNotNull())
    return out.withColumn(
        column,
        F.when(F.col(column).isin(0.0, 1.0), F.col(column).cast("int")).otherwise(F.raise_error(F.lit(f"{column} has a value other than 0 and 1")).cast("int"))
    )


def dedup_first(df: DataFrame, key: list[str], order: list, last: bool = False) -> DataFrame:
    """One row for each key: the first by ``order`` (the last with ``last``)."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*key).orderBy(*[c.desc() if last else c.asc() for c in columns])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first of each value."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(column).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def stratified_sample(df: DataFrame, id_col: str, stratum: str, max_rows: int, seed: int) -> DataFrame:
    """About ``max_rows`` rows in the strata's proportions, at least one of each, at most ``max_rows`` in all; all rows if they fit."""
    rows = ranked(df, id_col, seed, [stratum])
    total = df.count()
    if total <= max_rows:
        return df
    share = F.greatest(F.lit(1.0), F.bround(F.lit(max_rows / total) * F.col("__n")))
    picked = rows.where(F.col("__rank") <= share).drop("__rank", "__n")
    again = ranked(picked, id_col, seed)
    return again.where(F.col("__rank") <= max_rows).drop("__rank", "__n")
