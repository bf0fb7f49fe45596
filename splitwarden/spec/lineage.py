"""Lineage graphs: of one record in Python, and of a table of runs as DataFrames."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .provenance import Record
from .schema import KINDS

ARTIFACT_KEYS = ("kind", "path", "format", "checksum")


def artifact_id(run_id: str, artifact: dict) -> str:
    joined = "|".join([run_id, *(str(artifact.get(k)) for k in ARTIFACT_KEYS)])
    return "artifact:" + hashlib.sha256(joined.encode()).hexdigest()


def lineage(record: Record) -> dict[str, list[dict]]:
    """Nodes and edges: a run uses five specs and produces its artifacts."""
    run = f"run:{record.run_id}"
    specs = [
        {
            "id": f"{k}:{record.fingerprints[k]}", "type": "spec", "label": f"{k}:{record.names.get(k) or k}",
            "payload": {"fingerprint": record.fingerprints[k]}
        } for k in KINDS
    ]
    made = [
        {
            "id": artifact_id(record.run_id, a), "type": "artifact", "label": f"{a['kind']}:{a['path']}",
            "payload": {k: v for k, v in a.items() if v is not None}
        } for a in record.artifacts
    ]
    node = {
        "id": run, "type": "run", "label": f"run:{record.run_id[:12]}",
        "payload": {"created_at_utc": record.created_at_utc, "format_version": record.format_version}
    }
    edges = [{"source": run, "target": n["id"], "relation": r} for nodes, r in ((specs, "uses"), (made, "produces")) for n in nodes]
    return {"nodes": [*specs, node, *made], "edges": edges}


def artifact_id_column(run_id: Column, kind: Column, path: Column, format_: Column, checksum: Column) -> Column:
    """``artifact_id`` as an expression; a null part is the text None."""
    parts = [run_id, kind, path, format_, checksum]
    return F.concat(F.lit("artifact:"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]), 256))


def run_id_column(fingerprints: dict[str, Column], salt: Column | None = None) -> Column:
    """``compute_run_id`` as an expression, for fingerprints without characters that JSON escapes."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = {k: quoted(fingerprints[k]) for k in KINDS} | {"salt": F.lit("null") if salt is None else F.coalesce(quoted(salt), F.lit("null"))}
    body = []
    for n, k in enumerate(sorted(parts)):
        body += [F.lit(("," if n else "{") + f'"{k}":'), parts[k]]
    return F.sha2(F.concat(*body, F.lit("}")), 256)


def lineage_nodes(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, type, label) of runs (run_id, <kind>_fingerprint, <kind>_name) and artifacts (run_id, kind, path, format, checksum).

    One pass over the runs makes a run's six nodes; spec nodes that runs share are merged.
    """
    own = [
        F.struct(
            F.concat(F.lit(f"{k}:"), F.col(f"{k}_fingerprint")).alias("id"), F.lit("spec").alias("type"),
            F.concat(F.lit(f"{k}:"), F.coalesce(F.col(f"{k}_name"), F.lit(k))).alias("label")
        ) for k in KINDS
    ]
    run = F.struct(
        F.concat(F.lit("run:"), F.col("run_id")).alias("id"), F.lit("run").alias("type"), F.concat(F.lit("run:"), F.substring("run_id", 1, 12)).alias("label")
    )
    nodes = runs.select(F.explode(F.array(*own, run)).alias("n")).select("n.*")
    made = artifacts.select(
        artifact_id_column(*(F.col(c) for c in ("run_id", *ARTIFACT_KEYS))).alias("id"), F.lit("artifact").alias("type"),
        F.concat_ws(":", "kind", "path").alias("label")
    )
    return nodes.unionByName(made).distinct()


def lineage_edges(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    source = F.concat(F.lit("run:"), F.col("run_id")).alias("source")
    uses = runs.select(
        source, F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col(f"{k}_fingerprint")) for k in KINDS])).alias("target"), F.lit("uses").alias("relation")
    )
    made = artifacts.select(source, artifact_id_column(*(F.col(c) for c in ("run_id", *ARTIFACT_KEYS))).alias("target"), F.lit("produces").alias("relation"))
    return uses.unionByName(made)
