"""Scans, sinks and the small file work of runs."""

from __future__ import annotations

import hashlib
import platform
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By extension; .fasta gives (id, description, sequence). CSV needs a schema: types are never inferred from data."""
    suffix = Path(str(path).rstrip("/")).suffix.lower()
    if suffix in (".fasta", ".fa"):
        return read_fasta(spark, path)
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or path}; supported: {', '.join([*READERS, '.fasta'])}")
    reader = spark.read.format(READERS[suffix])
    if suffix == ".csv":
        if schema is None:
            raise ValueError("a CSV scan needs a schema")
        reader = reader.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).load(str(path))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records begin with '>' at the start of a line; sequences may span lines."""
    rows = spark.read.option("lineSep", "\n>").text(str(path)).select(F.regexp_replace("value", r"^>", "").alias("value"))
    rows = rows.where(F.length(F.trim("value")) > 0)
    head = F.rtrim(F.regexp_replace(F.split_part("value", F.lit("\n"), F.lit(1)), "\r", ""))
    sequence = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.expr("substr(value, instr(value, '\n') + 1)"), r"\s", "")).otherwise("")
    return rows.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), head.alias("description"), sequence.alias("sequence"))


def pick_path(spark: SparkSession, folder: str, name: str) -> str:
    """<folder>/<name>.parquet if it exists, else .csv, else an error; any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    for suffix in (".parquet", ".csv"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{suffix}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return f"{folder}/{name}{suffix}"
    raise FileNotFoundError(f"{folder}/{name}.parquet or .csv")


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON document for each run: <partition>/seed_<n>/<algorithm>/metrics.json with train, val and test metrics."""
    metrics = "struct<accuracy:double,balanced_accuracy:double,f1:double,mcc:double,auroc:double,auprc:double>"
    rows = spark.read.schema(
        f"train {metrics}, val {metrics}, test {metrics}"
    ).option("multiLine", True).json(pattern).withColumn("path", F.col("_metadata.file_path"))
    part = F.split("path", "/")
    return rows.select(
        F.element_at(part, -4).alias("folder"), F.regexp_extract("path", r"seed_(\d+)", 1).cast("int").alias("seed"), F.element_at(part, -2).alias("algorithm"),
        F.col("train.auprc").alias("auprc_train"), F.col("val.auprc").alias("auprc_val"), F.col("test.auprc").alias("auprc_test"),
    )


def classify_partition(folder) -> tuple:
    """(partition, k) of a folder name: cluster-aware folders end in k<clusters>."""
    kind = F.when(
        F.instr(folder, "cluster") > 0, "Cluster aware"
    ).when(F.instr(folder, "stratified") > 0, "Stratified").when(F.instr(folder, "random") > 0, "Random").otherwise(folder)
    k = F.when(F.instr(folder, "cluster") > 0, F.regexp_extract(folder, r"k(\d+)$", 1).try_cast("int"))
    return kind, k


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "ignore") -> None:
    """Parquet, or CSV by extension. The default leaves a table that exists alone; 'overwrite' replaces it."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if str(path).endswith(".csv"):
        writer.option("header", True).csv(str(path))
    else:
        writer.parquet(str(path))


def write_manifest(path, manifest: dict) -> Path:
    """A small YAML file, on the driver."""
    import yaml

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(manifest, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return path


def sha256_file(path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as source:
        while block := source.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def sha256_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of many files below 2 GB, read by the executors."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def environment(spark: SparkSession | None = None) -> dict:
    """What ran: versions, platform and git state; what can't be found is null."""

    def ask(*command):
        try:
            return subprocess.run(command, capture_output=True, text=True, timeout=20, check=True).stdout.strip() or None
        except (OSError, subprocess.SubprocessError):
            return None

    status = ask("git", "status", "--porcelain")
    packages = ask(sys.executable, "-m", "pip", "freeze")
    return {
        "python": platform.python_version(), "platform": platform.platform(), "spark": spark.version if spark else None,
        "git": {"commit": ask("git", "rev-parse", "HEAD"), "branch": ask("git", "rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(status)},
        "packages": packages.splitlines() if packages else None,
    }


def latest_run(runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    return runs.agg(F.max(run_id).alias("latest_run"))
