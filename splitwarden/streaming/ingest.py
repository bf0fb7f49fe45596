"""Streams of run records and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from ..spec.registry import put_if_absent

RUN_SCHEMA = "run_id string, created_at_utc string, format_version string, notes string"


def ingest_runs(spark: SparkSession, folder: str, table: str | KeyedTable, checkpoint: str, schema: str = RUN_SCHEMA):
    """A query that puts run records which arrive as JSON files into a Parquet table, unless their run_id is there already.

    A KeyedTable takes several streams at once and a micro-batch that runs again; a plain folder is for one writer.

    ``availableNow`` takes all files that are there and stops; the checkpoint remembers them. Within a micro-batch the earliest record of
    an id wins.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
            F.min(F.struct("created_at_utc", *[c for c in batch.columns if c not in ("run_id", "created_at_utc")])).alias("r")
        ).select("run_id", "r.*").select(*batch.columns)
        if isinstance(table, KeyedTable):
            table.put(rows)
            return
        try:
            existing = spark.read.schema(batch.schema).parquet(table)
            existing.head(1)
        except Exception as error:  # no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            existing = spark.createDataFrame([], batch.schema)
        put_if_absent(existing.limit(0), rows.join(existing.select("run_id"), "run_id", "left_anti"), ["run_id"]).write.mode("append").parquet(table)

    stream = spark.readStream.schema(schema).option("multiLine", True).json(folder)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_counts(events: DataFrame, time: str, label: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows of each label and window; state of windows older than the watermark is dropped. Batch tables work too."""
    counted = events.withWatermark(time, late) if events.isStreaming else events
    return counted.groupBy(F.window(time, window), label).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), label, "n"
    )
