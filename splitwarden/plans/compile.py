"""Compiles what a specification declares: filters, redundancy control, split protocol and leakage checks.

Filters follow SQL's three-valued logic: a row whose field is null passes only ``exists: false``. Custom protocols, checks and methods, and
measures without a built-in plan, are looked up in ``CUSTOM`` by name; a name that isn't there is an error, not a silent skip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import identity, leakage, similarity, splits
from ..operators.cleaning import dedup_first, require_columns
from ..operators.components import connected_components
from ..spec.schema import Spec

#: name -> callable(df, spec) for whatever has no built-in plan, such as 'split:custom' or 'redundancy:custom'.
CUSTOM: dict[str, Callable] = {}
CUT = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c,
    v: c >= v
}


def virtual_fields(sequence_field: str) -> dict[str, Column]:
    """Fields that filters may use without their being columns."""
    s = F.col(sequence_field)
    return {"sequence_length": F.length(s), "has_noncanonical": s.rlike("[^ACDEFGHIKLMNPQRSTVWY]")}


def filter_column(df: DataFrame, rule: Spec, sequence_field: str = "sequence") -> Column:
    """The predicate of one rule."""
    if rule.field in df.columns:
        column, kind = F.col(f"`{rule.field}`"), df.schema[rule.field].dataType
    elif sequence_field in df.columns and rule.field in virtual_fields(sequence_field):
        column, kind = virtual_fields(sequence_field)[rule.field], None
    else:
        raise ValueError(f"filter on an unknown field: {rule.field}")
    op, v = rule.op, rule.value
    if op in CUT:
        return CUT[op](column, F.lit(v))
    if op in ("in", "not_in"):
        if not isinstance(v, (list, tuple)):
            raise ValueError(f"{op} takes a list")
        found = column.isin(*v) if v else (F.lit(False) & column.isNotNull())
        return found if op == "in" else ~found & column.isNotNull()
    if op in ("contains", "not_contains"):
        found = F.array_contains(column, v) if isinstance(kind, T.ArrayType) else F.instr(column.cast("string"), str(v)) > 0
        return found if op == "contains" else ~found
    if op == "between":
        if not isinstance(v, (list, tuple)) or len(v) != 2 or None in v:
            raise ValueError("between takes [low, high]")
        return column.between(*v)
    if op == "regex":
        return column.rlike(v)
    return column.isNull() if v is False else column.isNotNull()


def apply_filters(df: DataFrame, dataset: Spec) -> DataFrame:
    """All filters in one conjunction, so that Catalyst can push them to the scan."""
    for rule in dataset.filters:
        df = df.where(filter_column(df, rule, dataset.sequence_field))
    return df


def _custom(name: str, *args):
    if name not in CUSTOM:
        raise NotImplementedError(f"{name} has no built-in plan; register a callable in CUSTOM")
    return CUSTOM[name](*args)


def apply_redundancy(df: DataFrame, dataset: Spec) -> DataFrame:
    """none keeps all; sequence_identity keeps the smallest id of each cluster of similar sequences, of equal ones at 1; cluster keeps
    the smallest id of each value of parameters.field, or without one also clusters by sequence identity."""
    r = dataset.redundancy_control
    if r.method == "none":
        return df
    if r.method == "cluster" and r.parameters.get("field"):
        return dedup_first(df, [r.parameters["field"]], [dataset.id_field])
    if r.method in ("sequence_identity", "cluster"):
        if r.threshold == 1:
            return dedup_first(df, [dataset.sequence_field], [dataset.id_field])
        rows = identity.identity_clusters(df, dataset.id_field, dataset.sequence_field, r.threshold)
        return dedup_first(rows, ["cluster"], [dataset.id_field]).drop("cluster")
    return _custom(f"redundancy:{r.method}", df, dataset)


def compile_dataset(df: DataFrame, dataset: Spec) -> DataFrame:
    """Filters, then redundancy control, then the declared columns."""
    require_columns(df, dataset.id_field, dataset.sequence_field, *[x.name for x in dataset.labels], *[x.name for x in dataset.metadata if x.required])
    out = apply_redundancy(apply_filters(df, dataset), dataset)
    wanted = [dataset.id_field, dataset.sequence_field, *[x.name for x in dataset.labels], *[x.name for x in dataset.metadata if x.name in df.columns]]
    return out.select(*dict.fromkeys(wanted))


def cluster_column(df: DataFrame, measure: Spec, id_col: str, sequence: str | None, vectors: DataFrame | None) -> DataFrame | None:
    """``df`` with ``cluster`` by the identity's measure: a declared field, similar sequences, or similar embeddings (id, embedding);
    None where what the measure needs isn't there."""
    if field := (measure.parameters or {}).get("field"):
        return df.withColumn("cluster", F.col(field))
    if measure.measure == "sequence_identity" and sequence:
        return identity.identity_clusters(df, id_col, sequence, measure.threshold)
    if measure.measure == "embedding_similarity" and vectors is not None:
        roots = connected_components(similarity.pairs_above(vectors, measure.threshold), "a", "b")
        named = df.join(roots.select(F.col("node").alias("__node"), F.col("root").alias("__root")), F.col(id_col) == F.col("__node"), "left")
        return named.withColumn("cluster", F.coalesce("__root", id_col)).drop("__node", "__root")
    return None


def compile_split(
    df: DataFrame, split: Spec, id_col: str, cluster_col: str | None = None, sequence: str | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """``df`` with ``partition``."""
    r = (split.ratios.train, split.ratios.val, split.ratios.test)
    if split.protocol == "random":
        return splits.random_split(df, id_col, split.seed, r).drop("position")
    if split.protocol == "stratified":
        return splits.stratified_split(df, id_col, split.stratify_field, split.seed, r).drop("position")
    if split.protocol == "temporal":
        return splits.temporal_split(df, split.time_field, r)
    if split.protocol == "group":
        return splits.cluster_split(df, split.group_field, split.seed, r[2], r[1])
    if split.protocol in ("cluster_aware", "structure_aware"):
        rows = df.withColumn("cluster", F.col(cluster_col)) if cluster_col else cluster_column(df, split.identity, id_col, sequence, vectors)
        if rows is None:
            return _custom(f"split:{split.protocol}", df, split)
        return splits.cluster_split(rows, "cluster", split.seed, r[2], r[1]).select(*df.columns, "partition")
    return _custom("split:custom", df, split)


def compile_checks(parts: DataFrame, split: Spec, id_col: str, sequence: str, vectors: DataFrame | None = None) -> DataFrame:
    """(check, type, part_a, part_b, n_shared) of all declared checks; ``vectors`` (id, embedding) serve embedding_similarity."""
    out = None
    for k, check in enumerate(split.leakage_checks):
        if check.type == "exact_duplicate":
            found = leakage.exact_duplicates(parts, sequence, check.scope)
        elif check.type == "group_overlap":
            found = leakage.group_overlap(parts, check.field, check.scope)
        elif check.type == "sequence_identity":
            found = identity.similar_sequences(parts, id_col, sequence, check.threshold, check.scope).withColumnRenamed("n_pairs", "n_shared")
        elif check.type == "embedding_similarity" and vectors is not None:
            ids = parts.select(F.col(id_col).alias("id"), "partition")
            pairs = similarity.pairs_above(vectors.join(ids, "id"), check.threshold, part="partition")
            found = leakage.similar_embeddings(pairs, parts, id_col, check.threshold, check.scope).select(
                "part_a", "part_b", F.col("n_pairs").alias("n_shared")
            )
        else:
            found = _custom(f"check:{check.type}", parts, check)
        found = found.select(F.lit(k).alias("check"), F.lit(check.type).alias("type"), "part_a", "part_b", F.col("n_shared").cast("long"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = parts.sparkSession.createDataFrame([], "check int, type string, part_a string, part_b string, n_shared long")
    return out
