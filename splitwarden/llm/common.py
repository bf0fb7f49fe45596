"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import appended as appended  # for the operators here
from ..shared import materialise as materialise
from ..shared import new_path as new_path
from ..shared import ship as ship

#: The white space that separates words, as a Java and DuckDB character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable, rows: int = 500) -> Iterator:
    """The same rows in smaller Arrow batches, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where a column of ``df`` has one of them (upper and lower case are one)."""
    tail, taken = "", {c.lower() for c in df.columns}
    while any(f"{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"{n}{tail}" for n in names]


def body(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
