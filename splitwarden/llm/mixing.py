"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same expected number of copies. Its whole part is taken; the fraction
is rounded in pairs: word mass moves at random from one document of a pair to the other until one of the two is
integral, so that the pair's expected words never change. Leaves of bounded size are rounded in parallel; what is left
fractional in each is combined by a reduction tree, up to one document for a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import range_bucket, rank_in_buckets
from .common import WORD, body, materialise


def settle_large(share: np.ndarray, size: np.ndarray, rng: np.random.Generator, large: float = 0.03) -> np.ndarray:
    """Rounds each entry with over ``large`` of all mass in a pair with the pool of all smaller ones, the largest first, so that no large
    document is left for the end, where its rounding would miss the target.

    This is the move of ``pivotal`` with a pool in the place of the second document. All shares must be equal at the start. Let an
    entry have size s and share x, the pool mass m and share p. Mass u = min((1 - x) s, p m) can move into the entry, d = min(x s,
    (1 - p) m) out of it. Moving u with probability d / (u + d), else d, moves 0 in expectation, so every entry keeps its
    expectation, x s + p m stays as it is, and x and p stay within 0..1. Afterwards x is integral or p is. As all entries of the
    pool change by the same share, they stay equal, and the next largest can be rounded against the rest; once p is
    integral all of them are.
    """
    share = share.copy()
    order = np.argsort(-size, kind="stable")
    for place, k in enumerate(order.tolist()):
        rest = order[place + 1 :]
        mass = size[rest].sum()
        if not len(rest) or size[k] <= large * size.sum():
            break
        p = share[rest[0]]
        up, down = min((1 - share[k]) * size[k], p * mass), min(share[k] * size[k], (1 - p) * mass)
        if up + down <= 0:
            break
        moved = up if rng.random() * (up + down) < down else -down
        share[k] += moved / size[k]
        share[rest] = p - moved / mass
    return np.clip(share, 0, 1)


def pivotal(share: np.ndarray, size: np.ndarray, rng: np.random.Generator, tiny: float = 1e-9) -> np.ndarray:
    """``share`` (each in 0..1) with all but at most one entry rounded to 0 or 1; sum(share * size) does not change.

    Of the two ways to move mass within a pair, each is drawn with the other's length as its weight, so every entry keeps its
    expectation.
    """
    share = share.astype(float).copy()
    if len(share) > 1 and np.ptp(share) == 0:
        share = settle_large(share, size, rng)
        share = np.where(share < tiny, 0.0, np.where(share > 1 - tiny, 1.0, share))
    active = np.flatnonzero((share > tiny) & (share < 1 - tiny))
    while len(active) > 1:
        a, b, rest = active[0 : len(active) // 2 * 2 : 2], active[1::2], active[len(active) // 2 * 2 :]
        up = np.minimum((1 - share[a]) * size[a], share[b] * size[b])
        down = np.minimum(share[a] * size[a], (1 - share[b]) * size[b])
        raise_a = rng.random(len(a)) * (up + down) < down
        moved = np.where(raise_a, up, -down)
        share[a] += moved / size[a]
        share[b] -= moved / size[b]
        pair = np.concatenate([a, b])
        share[pair] = np.where(share[pair] < tiny, 0.0, np.where(share[pair] > 1 - tiny, 1.0, share[pair]))
        left = np.concatenate([np.stack([a, b], 1).ravel(), rest])
        active = left[(share[left] > 0) & (share[left] < 1)]
    return share


def targets(per_source: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``per_source`` (source, source_size, n) with target and a position ``rank`` of the source by code point, null last.

    Sources weigh ``weights`` in turn and share ``share`` of all sizes; a target stops at ``cap`` times its source's
    size and the excess is reshared by weight until none is above. Each round of that is one aggregation over the sources; ranks are
    taken in ranges of the source, so sources may be as many as hosts.
    """
    null_last = F.when(F.col("source").isNull(), 1 << 30).otherwise(range_bucket(per_source, "source"))
    rows = rank_in_buckets(per_source, [], null_last, [F.col("source").asc_nulls_last()]).withColumn("rank", F.col("__rank") - 1).drop("__rank", "__n")
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    rows = materialise(rows.withColumn("most", cap * F.col("source_size")), "ranks")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    capped, before, level = F.lit(False), -1, 0.0
    while True:
        spent, open_weight, n = rows.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if n == before or not open_weight:  # none is above, or all are at their cap
            break
        before, level = n, (total - (spent or 0.0)) / open_weight
        capped = F.col("most") < F.col("weight") * level
    return rows.select("source", "source_size", "n", "rank", F.when(capped, F.col("most")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _round_groups(seed: int, level: int):
    """Rounds one group of (id, size, fraction) rows; rows that stay fractional keep their fraction."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "id", "size"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(rows["rank"][0]), int(rows["leaf"][0])])
        rows["fraction"] = pivotal(rows["fraction"].to_numpy(float), rows["size"].to_numpy(float), rng)
        return rows

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5,
    cap: float = 2.0, seed: int = 42, leaf_rows: int = 4096, row_col: str | None = None
) -> DataFrame:
    """(id, size, source, source_size, target, copies, taken) of every row, and its ``row`` where ``row_col`` names a column of row numbers.

    ``size`` counts the words (null text: 0), ``copies`` is how often the mix takes the document, ``taken`` = copies x size.
    A source's taken words miss its target by less than one document: the last fractional one of a source is drawn with its fraction as
    the probability, so every document is taken target / source size times on average. No document is taken more than ceil(``cap``) times. Documents
    without words are all taken floor(target / source size) times. Randomness comes from ids, texts and ``seed`` only, so reruns and other
    partitionings agree. Null sources form one source, the last; null ids and repeated rows are rounded one by one; an empty table gives an
    empty result.

    A leaf holds about ``leaf_rows`` documents of one source, chosen by a hash of id, text and, among rows that share both, a number: a hot
    source, id or text just has more leaves. With ``row_col``, the row number takes that number's place, and decides which of such rows is taken.
    """
    text = body(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("digest"),
        *([F.col(row_col).cast("long").alias("row")] if row_col else [])
    )
    if not row_col:  # number the rows that are alike, in parts, so that no task numbers a hot one alone
        part = 1 << 16
        alike = rows.groupBy("id", "source", "size", "digest").agg(F.count("*").alias("n"))
        alike = alike.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {part})"))).repartition("id", "digest", "part")
        rows = alike.withColumn("row", F.explode(F.expr(f"sequence(part * {part}, least(n, (part + 1) * {part}) - 1)"))).drop("n", "part")
    rows = materialise(rows, "sizes")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, cap)
    per_source = materialise(per_source, "targets")
    most_rows = per_source.agg(F.max("n")).first()[0] or 0

    at = per_source.withColumnRenamed("source", "__source")
    rows = rows.join(at, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    near = F.round(rate)
    rate = F.when(F.abs(rate - near) < 1e-12, near).otherwise(rate)
    order = F.xxhash64(F.lit(seed), "id", "digest", "row")
    rows = (
        rows.withColumn("base", F.floor(rate).cast("long")).withColumn("fraction", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
        .withColumn("order", order).withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "digest", "row"), F.ceil(F.col("n") / leaf_rows)))
    )
    schema = rows.schema
    done = rows.where("fraction = 0")
    open_rows, level, groups = rows.where("fraction > 0"), 0, math.ceil(most_rows / leaf_rows)
    while True:
        rounded = materialise(open_rows.groupBy("rank", "leaf").applyInPandas(_round_groups(seed, level), schema), f"rounded{level}")
        left = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        done = done.unionByName(rounded.where(~left))
        open_rows = rounded.where(left)
        if groups <= 1:
            break
        groups, level = math.ceil(groups / leaf_rows), level + 1
        open_rows = open_rows.withColumn("leaf", F.floor(F.col("leaf") / leaf_rows))
    draw = F.xxhash64(F.lit(seed + 2), "source").bitwiseAND((1 << 52) - 1) / float(1 << 52)  # the last one of each source
    done = done.unionByName(open_rows.withColumn("fraction", F.when(draw < F.col("fraction"), 1.0).otherwise(0.0)))
    copies = F.col("base") + F.col("fraction").cast("long")
    return done.select(*(["row"] if row_col else []), "id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
