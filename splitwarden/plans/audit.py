"""Rules over many packs at once: a table of packs in, a table of issues out."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity_rank
from ..spec.rules import check_pack
from ..spec.schema import KINDS, SpecError, parse

COLUMNS = ["pack_id", "severity", "code", "path", "message", "hint"]


def pack_issues(packs: DataFrame, id_col: str = "pack_id") -> DataFrame:
    """Issues of packs whose columns dataset, split, ... hold JSON documents (null: not given). A malformed document is one ERROR, SPEC_SHAPE."""
    kinds = [k for k in KINDS if k in packs.columns]

    def run(batches):
        for batch in batches:
            out = []
            for pack, *documents in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                try:
                    specs = {k: parse(k, json.loads(d)) for k, d in zip(kinds, documents) if d is not None}
                    out += [(pack, i.severity, i.code, i.path, i.message, i.hint) for i in check_pack(**specs)]
                except (SpecError, json.JSONDecodeError) as error:
                    out.append((pack, "ERROR", "SPEC_SHAPE", getattr(error, "where", None), str(error), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*out)) or [()] * 6)], names=COLUMNS)

    rows = packs.select(F.col(id_col).cast("string"), *[F.col(k).cast("string") for k in kinds])
    return rows.mapInArrow(run, ", ".join(f"{c} string" for c in COLUMNS))


def severity_counts(issues: DataFrame, keys: list[str]) -> DataFrame:
    """errors, warnings and infos of each key; other severities are not counted."""
    return issues.groupBy(*keys).agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s.lower()}") for s in ("ERROR", "WARNING", "INFO")])


def issue_order(issues: DataFrame, *ties: str) -> DataFrame:
    """Every issue, by severity, code and path (null as ''), then by ``ties``: a range-partitioned sort."""
    return issues.orderBy(severity_rank(F.col("severity")), "code", F.coalesce("path", F.lit("")), *ties)
