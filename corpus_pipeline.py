"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but the last return the columns
of docs. Columns are renamed while an operator runs, so none of them can clash with a result's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.llm.common import materialise, read, ship
from splitwarden.llm.exact_dedup import exact_dedup
from splitwarden.llm.mixing import mix
from splitwarden.llm.packing import pack
from splitwarden.llm.quality import quality_rules
from splitwarden.llm.queries import MIXING, QUALITY
from splitwarden.llm.simhash import near_duplicates


def _aside(docs: DataFrame) -> DataFrame:
    """The columns as c_<name>."""
    return docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the base rules or the line frequencies of their source reject, and takes boilerplate lines out of the others.

    A line counts once for each distinct text here: the copies of a text are left to the next stages, which keep one of them.
    n_chars follows the text where lines were taken out.
    """
    found = quality_rules(_aside(docs), "c_text", "c_source", clean=True, count="texts", **QUALITY).where("kept")
    if "n_chars" in docs.columns:
        length = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("c_n_chars", F.when(F.col("removed_lines") > 0, length).otherwise(F.col("c_n_chars")))
    return _back(found.withColumn("c_text", F.col("clean_text")), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts."""
    return _back(exact_dedup(_aside(docs), "c_doc_id", "c_text").where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more, found by SimHash).

    Rows that share an id stay or go together; rows without an id stay.
    """
    ship(spark)
    found = near_duplicates(docs.select("doc_id", "text"), least=0.8, words_per_shingle=5, seed=42)
    gone = found.where("node != root").select(F.col("node").alias("gone_id")).distinct()
    rows = _aside(docs)
    return _back(rows.join(gone, rows["c_doc_id"] == gone["gone_id"], "left_anti"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it, and drops those that it doesn't take. Rows are told apart by a number, not by their ids."""
    ship(spark)
    rows = materialise(_aside(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    taken = mix(rows, "c_doc_id", "c_text", "c_source", row_col="row", **MIXING).where("copies > 0").select("row", "copies")
    rows = rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return _back(rows, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2048 tokens."""
    ship(spark)
    return pack(docs.select("doc_id", "text"), capacity=2048, end_id=1)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixing), ("packing", packing)]

#: Fingerprints, random rounding and tokens are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written, and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k + 1}")
    return docs
