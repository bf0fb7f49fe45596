"""Results of runs: sinks for models, metrics, predictions and splits, loaders that say what is missing, and discovery of folders.

Paths go through Hadoop's file systems, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import require_columns
from .tables import read_table

PARTS = ("train", "val", "test")


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def folders(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's folders, sorted; numbers in them count as numbers, so seed_2 comes before seed_10."""
    found, system = _path(spark, folder)
    if not system.exists(found):
        raise FileNotFoundError(folder)
    names = [s.getPath().getName() for s in system.listStatus(found) if s.isDirectory()]
    return sorted(names, key=lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)])


def seeds(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> dict[int, str]:
    """seed -> path of the folders seed_<n>, rising; ``wanted`` seeds that are missing are an error."""
    found = {int(m[1]): f"{folder}/{n}" for n in folders(spark, folder) if (m := re.fullmatch(r"seed_(\d+)", n))}
    if missing := [s for s in wanted or () if s not in found]:
        raise FileNotFoundError(f"no folder for seeds {', '.join(map(str, missing))} in {folder}")
    return {s: p for s, p in sorted(found.items()) if wanted is None or s in wanted}


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small file, from the driver."""
    found, system = _path(spark, path)
    out = system.create(found, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def write_model(model, folder: str, overwrite: bool = False) -> str:
    """A fitted pipeline as <folder>/model."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(f"{folder}/model")
    return f"{folder}/model"


def write_metrics(spark: SparkSession, folder: str, metrics: dict, overwrite: bool = False) -> str:
    """metrics.json with the metrics of each part, as read_metrics reads them; numbers that aren't finite become null."""
    plain = {p: {k: (float(v) if v is not None and np.isfinite(v) else None) for k, v in m.items()} for p, m in metrics.items()}
    write_text(spark, f"{folder}/metrics.json", json.dumps(plain, indent=2, sort_keys=True), overwrite)
    return f"{folder}/metrics.json"


def write_predictions(predictions: DataFrame, folder: str, index: str, sequence: str, threshold: float = 0.5, mode: str = "ignore") -> str:
    """Parquet (dataset_index, sequence, y_true, y_prob, y_pred) in a folder for each part, if there are parts."""
    rows = predictions.withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int"))
    kept = [
        F.col(index).cast("long").alias("dataset_index"), F.col(sequence).cast("string").alias("sequence"), F.col("y_true").cast("int"),
        F.col("y_prob").cast("double"), "y_pred"
    ]
    writer = rows.select(*kept, *(["partition"] if "partition" in rows.columns else [])).write.mode(mode)
    (writer.partitionBy("partition") if "partition" in rows.columns else writer).parquet(f"{folder}/predictions")
    return f"{folder}/predictions"


def load_predictions(spark: SparkSession, folder: str, part: str = "test") -> DataFrame:
    """The predictions of one part; only its folder is read."""
    if not exists(spark, f"{folder}/predictions/partition={part}"):
        raise FileNotFoundError(f"no predictions of part {part}: {folder}/predictions/partition={part}")
    return spark.read.parquet(f"{folder}/predictions").where(F.col("partition") == part)


def load_summary(spark: SparkSession, case: str, run_id: str, schema) -> DataFrame:
    """The summary table of a run: <case>/executions/<run_id>/summary.parquet or .csv."""
    for suffix in ("parquet", "csv"):
        if exists(spark, f"{case}/executions/{run_id}/summary.{suffix}"):
            return read_table(spark, f"{case}/executions/{run_id}/summary.{suffix}", schema)
    raise FileNotFoundError(f"no summary of run {run_id}: {case}/executions/{run_id}/summary.parquet or .csv")


def load_execution(spark: SparkSession, case: str, run_id: str) -> dict:
    """The manifest of a run."""
    import yaml

    try:
        return yaml.safe_load(read_text(spark, f"{case}/executions/{run_id}/execution.yaml")) or {}
    except FileNotFoundError:
        raise FileNotFoundError(f"no manifest of run {run_id}: {case}/executions/{run_id}/execution.yaml") from None


def manifest_get(manifest: dict, path: str, default=None):
    """The value at a dotted path such as 'split.seed'; the default where any step is missing or null."""
    found = manifest
    for step in path.split("."):
        found = found.get(step) if isinstance(found, dict) else None
        if found is None:
            return default
    return found


def write_split(split: DataFrame, path: str, index: str = "dataset_index", mode: str = "ignore") -> None:
    """The assignment of a split: (dataset_index, position) in a folder for each part."""
    require_columns(split, index, "partition")
    kept = [F.col(index).cast("long").alias("dataset_index"), "partition"] + (["position"] if "position" in split.columns else [])
    split.select(*kept).write.mode(mode).partitionBy("partition").parquet(path)


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    """(position, dataset_index) of a one-dimensional .npy file of integers; executors read it."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                found = np.load(io.BytesIO(content), allow_pickle=False).astype(np.int64)
                if found.ndim != 1:
                    raise ValueError("an index vector has one dimension")
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["position", "dataset_index"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "position long, dataset_index long")


def load_split(spark: SparkSession, folder: str, part: str, data: DataFrame, schema, index: str = "dataset_index") -> DataFrame:
    """One part of a split: <part>.csv as it is; else the rows of ``data`` that <part>_idx.npy, or a table of write_split in
    ``assignment``, names by their ``index``, with dataset_index. None of the three is an error."""
    if exists(spark, f"{folder}/{part}.csv"):
        return read_table(spark, f"{folder}/{part}.csv", schema)
    if exists(spark, f"{folder}/{part}_idx.npy"):
        wanted = read_indices(spark, f"{folder}/{part}_idx.npy").select("dataset_index")
    elif exists(spark, f"{folder}/assignment/partition={part}"):
        wanted = spark.read.parquet(f"{folder}/assignment").where(F.col("partition") == part).select("dataset_index")
    else:
        raise FileNotFoundError(f"none of {part}.csv, {part}_idx.npy and assignment/partition={part} in {folder}")
    if index == "dataset_index":
        return wanted.join(data, "dataset_index")
    return wanted.join(data, F.col("dataset_index") == F.col(index))
