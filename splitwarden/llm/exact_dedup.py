"""Exact dedup by content sort.

Rows are range-partitioned and sorted by content: sampled splitters on a short leading key and a digest, then
the whole text. Equal texts so lie next to each other, and neighbours are compared in full (the window's group
boundary compares the whole text). Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def unchanged(text: Column) -> Column:
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, normalise=unchanged, lead_chars: int = 48) -> DataFrame:
    """All rows and columns of ``docs``, with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if ``normalise(text)`` is identical; null counts as empty. Of equal texts the row with the
    largest id stays (``largest=False``: the smallest); a null id stays only where all ids of the group are null.
    Of repeated rows (same id, equal text) exactly one stays. An empty table gives an empty result. Columns
    of ``docs`` that have the name of a result column are replaced.

    A text that more than a quarter of a partition's share of rows carry is hot: its rows are salted by id, so its
    group is spread over many sort ranges, and its totals come from a map-side aggregation; the parts of such a group are matched by
    SHA-256. At most 4 x partitions texts can be hot, which bounds both broadcasts.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    best = F.max if largest else F.min
    own = docs.drop(*RESULT).columns
    base = docs.drop(*RESULT).toDF(*[f"own{k}" for k in range(len(own))])  # so that no column has the name of an internal one
    id_col, text_col = (f"own{own.index(c)}" for c in (id_col, text_col))
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))

    threshold = max(64, base.count() // (4 * parts))
    hot = (
        base.groupBy(F.xxhash64(text).alias("__hot_key")).agg(F.count("*").alias("__hot_rows"))
        .where(F.col("__hot_rows") > threshold)
        .withColumn("__salts", F.ceil(F.col("__hot_rows") / threshold).cast("int")).drop("__hot_rows")
    )
    hot = F.broadcast(hot)
    totals = (
        base.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hot_key"), text.alias("__text"))
        .join(hot, "__hot_key", "left_semi")
        .groupBy(F.sha2("__text", 256).alias("text_sha256"))
        .agg(best("__id").alias("__hot_keep"), F.count("*").alias("__hot_size"))
    )

    rows = base.withColumn("__null", F.col(text_col).isNull()).withColumn("__body", F.coalesce(F.col(text_col), F.lit(""))).drop(text_col)
    rows = rows.withColumn("__key", normalise(F.col("__body"))) if normalise is not unchanged else rows
    key = "__body" if normalise is unchanged else "__key"
    rows = (
        rows.withColumn("__hot_key", F.xxhash64(key)).withColumn("__lead", F.substring(key, 1, lead_chars))
        .join(hot, "__hot_key", "left")
        .withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.col("__salts"))))
        .repartitionByRange(parts, "__lead", "__hot_key", "__salt")
    )
    group = Window.partitionBy("__lead", "__hot_key", "__salt", key)
    ordered = group.orderBy(F.col(id_col).desc_nulls_last() if largest else F.col(id_col).asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        rows.withColumn("__rank", F.row_number().over(ordered))
        .withColumn("__keep", F.first(id_col).over(whole))
        .withColumn("__size", F.count("*").over(whole))
        .withColumn("text_sha256", F.sha2(key, 256))
        .join(F.broadcast(totals), "text_sha256", "left")
    )
    is_hot = F.col("__hot_size").isNotNull()
    keep = F.when(is_hot, F.col("__hot_keep")).otherwise(F.col("__keep"))
    return rows.select(
        *[(F.when(~F.col("__null"), F.col("__body")) if c == text_col else F.col(c)).alias(name) for c, name in zip(base.columns, own)],
        keep.alias("keep_id"),
        F.coalesce("__hot_size", "__size").alias("group_size"),
        ((F.col("__rank") == 1) & F.col("__keep").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )
