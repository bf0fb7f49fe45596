"""The queries of the text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .langid import identify, train
from .licenses import license_scan
from .mixing import mix
from .packing import pack
from .periodic import periodic_runs
from .pii import personal_data
from .quality import ORACLE as QUALITY_SQL
from .quality import quality_rules
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .topk import ORACLE as TOPK_SQL
from .topk import top_k
from .url_filter import ORACLE as URL_SQL
from .url_filter import RULES, parse_rule, url_verdicts

#: Production parameters.
QUALITY = {"max_docs": 20, "least_share": 0.3}
DIVERGENCE = {"least_docs": 3, "top": 200}
MIXING = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0, "seed": 42}


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, "doc_id", "text", largest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, [parse_rule(r) for r in RULES]).withColumnRenamed("id", "page_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, **MIXING).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules(docs, **QUALITY).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_rules_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 under the name it had while op5 judged short lines only."""
    return op5_quality_rules(spark, sf_dir)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, rows_per_label=200)
    return identify(docs, model).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), capacity=2048, end_id=1)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents").select("doc_id", "text"), containment=0.8)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_components(docs, "doc_id", "text", radius=2, words_per_shingle=3, seed=42)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), least=12, plant=True)
    return found.withColumnRenamed("id", "doc_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents").select("text", "lang", "source"), **DIVERGENCE)


QUERIES = {
    q.__name__: q
    for q in (
        op1_exact_dedup, op2_suffix_dedup, op3_url_filters, op4_mixing, op5_quality_rules, op5_quality_rules_whole, op6_language_id, op7_packing, op8_pii,
        op9_license_scan, op10_simhash, op11_exact_topk, op12_periodic_runs, op13_source_divergence
    )
}

ORACLE = {
    "op1_exact_dedup": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
          count(*) over (partition by coalesce(text, '')) as group_size,
          doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
          sha256(coalesce(text, '')) as text_sha256
        from documents""",
    "op3_url_filters": URL_SQL,
    "op5_quality_rules": QUALITY_SQL.format(**QUALITY),
    "op5_quality_rules_whole": QUALITY_SQL.format(**QUALITY),
    "op11_exact_topk": TOPK_SQL,
    "op13_source_divergence": DIVERGENCE_SQL.format(**DIVERGENCE),
}
