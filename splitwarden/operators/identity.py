"""Pairs of similar sequences: identity is 1 - edit distance / length of the longer sequence.

Above an identity of 0.5, candidates come from an index of what one or two deletions leave where no more edits are allowed, otherwise from an
inverted index of q-grams with an exact prefix filter, and the edit distance decides, with DataFrame functions only. At 0.5 or less edits may destroy every q-gram, so sequences of like length are compared block by block:
the characters that two of them can share bound their identity, and bit-parallel edit distances decide the rest. Both ways are exact.
What comes back is no larger than what is asked for: pairs, a spanning forest, or counts by the parts that hold the sequences.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import appended, materialise, new_path, ship
from . import alignment_kernel as kernel
from .blocks import neighbour_blocks
from .components import connected_components, spanning_forest
from .leakage import PAIRS

WILD, OTHER = "\ue000", "\ue001"  # what stands for any digit in a pattern, and in one that it is compared with


def most_edits(longer: Column, threshold: float) -> Column:
    return F.floor((1 - threshold) * longer + 1e-9)


def _edits_with_any(n, threshold: float, longest: int, least=min):
    """The most edits between a sequence of length n and any partner of that identity, which has at most n / threshold characters and no
    more than the ``longest`` sequence."""
    return (1 - threshold) * least(n / threshold, longest) + 1e-9


def _prefix_tokens(sequences: DataFrame, q: int, threshold: float, longest: int) -> DataFrame:
    """(rep, n, q, gram, k): the rarest q * edits + 1 of each sequence's q-grams; the k-th occurrence of a gram is a token of its own."""
    grams = sequences.where(F.length("seq") >= q).select(
        "rep", F.length("seq").alias("n"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - q + 1), lambda i: F.substring(F.col("seq"), i, F.lit(q)))).alias("gram")
    )
    grams = grams.groupBy("rep", "n", "gram").agg(F.count("*").cast("int").alias("times"))
    tokens = grams.select("rep", "n", "gram", F.explode(F.sequence(F.lit(1), "times")).alias("k"))
    frequency = tokens.groupBy("gram", "k").agg(F.count("*").alias("df"))
    edits = _edits_with_any(F.col("n"), threshold, longest, lambda x, y: F.least(x, F.lit(float(y))))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "gram", "k"))
    chosen = tokens.join(frequency, ["gram", "k"]).withColumn("place", place).where(F.col("place") <= q * F.floor(edits) + 1)
    return chosen.where("df > 1").select("rep", "n", F.lit(q).alias("q"), "gram", "k")


def _holds(mask: str, bit: int) -> Column:
    return F.col(mask).bitwiseAND(bit) > 0


def _holds_any(mask: str, pairs: list[tuple[int, int]]) -> Column:
    return reduce(or_, [_holds(mask, bit) for pair in pairs for bit in pair])


def _hold_across(x: str, y: str, across: list[tuple[int, int]]) -> Column:
    return reduce(or_, [(_holds(x, p) & _holds(y, q)) | (_holds(x, q) & _holds(y, p)) for p, q in across])


def _deletions(sequences: DataFrame, threshold: float, most: int) -> DataFrame:
    """``sequences`` with variant: each of what is left of a sequence when 0 to (1 - threshold) * length, at most ``most``, characters are deleted."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    edits, none = most_edits(F.length("seq"), threshold), F.array().cast("array<string>")
    level, found = F.array("seq"), F.array("seq")
    for k in range(1, most + 1):
        level = F.when((edits >= k) & (F.length("seq") >= k), F.array_distinct(F.flatten(F.transform(level, without)))).otherwise(none)
        found = F.concat(found, level)
    return sequences.withColumn("variant", F.explode(found))


def _deletion_pairs(sequences: DataFrame, threshold: float, most: int, across: list[tuple[int, int]] | None = None) -> DataFrame:
    """(a, b, mask_a, mask_b, identity) of all similar pairs of (rep, seq, mask), by equal variants: two sequences within d edits have equal ones
    with at most d characters deleted from each, and d is at most what the own length allows, since of a pair of unequal
    length the shorter one gives up one character less for each that the longer one has more.

    At ``most`` 1 a pair has just one variant in common (a run of equal characters gives one, and the longer of two gives the shorter itself).
    With ``across``, only pairs whose masks hold the two bits of one of its pairs.
    """
    groups = _deletions(sequences.select("rep", "seq", "mask"), threshold, most)
    groups = groups.groupBy("variant").agg(F.collect_list(F.struct("rep", "seq", "mask")).alias("g"), F.bit_or("mask").alias("masks")).where(F.size("g") > 1)
    if across is not None:
        groups = groups.where(_hold_across("masks", "masks", across))
    both = groups.select("g", F.explode("g").alias("x")).select("x", F.explode("g").alias("y")).where(F.col("x.rep") < F.col("y.rep"))
    if across is not None:
        both = both.where(_hold_across("x.mask", "y.mask", across))
    longer = F.greatest(F.length("x.seq"), F.length("y.seq"))
    both = both.withColumn("edits", F.levenshtein("x.seq", "y.seq", most)).where((F.col("edits") >= 0) & (F.col("edits") <= most_edits(longer, threshold)))
    found = both.select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.mask").alias("mask_a"), F.col("y.mask").alias("mask_b"), (1 - F.col("edits") / longer).alias("identity")
    )
    return found if most < 2 else found.dropDuplicates(["a", "b"])


def _most_deleted(sequences: DataFrame, threshold: float, variants: int = 300) -> int | None:
    """The edits between sequences as long as the longest, if these are 1 or 2 and sequences have few variants on average."""
    n = F.length("seq").cast("double")
    edits = most_edits(n, threshold)
    each = F.when(edits == 0, 1).when(edits == 1, n + 1).otherwise(1 + n + n * (n - 1) / 2)
    most, mean = sequences.agg(F.max(edits), F.avg(each)).first()
    return int(most) if most in (1, 2) and mean <= variants else None


def _forest(i: np.ndarray, j: np.ndarray, group: np.ndarray, other: np.ndarray, likely: np.ndarray, identities) -> tuple[np.ndarray, np.ndarray]:
    """Places and identities of those of the candidates (i, j) that connect groups, likely ones first: what is connected is not aligned any more."""
    names, at = np.unique(np.concatenate([group, other]), return_inverse=True)
    one, two = at[: len(group)][i], at[len(group) :][j]
    root = np.arange(len(names))
    left, taken, values, size = np.argsort(-likely, kind="stable"), [np.zeros(0, np.int64)], [np.zeros(0)], 512
    while True:
        left = left[root[one[left]] != root[two[left]]]
        if not len(left):
            return np.concatenate(taken), np.concatenate(values)
        some, left = left[:size], left[size:]
        found = identities(i[some], j[some])
        hit = found > 0
        some, found = some[hit], found[hit]
        keep = spanning_forest(root[one[some]], root[two[some]])
        for k in some[keep].tolist():
            root[root == root[two[k]]] = root[one[k]]
        taken.append(some[keep])
        values.append(found[keep])
        size = min(2 * size, 1 << 16)


def aligned_blocks(
    sequences: DataFrame, threshold: float, want: str, rows_per_block: int = 1024, across: list[tuple[int, int]] | None = None, hubs: int = 16, few: int = 2048, few_pairs: int = 1 << 21
) -> DataFrame:
    """Exact comparison of the distinct sequences (rep, seq, mask) at any threshold above 0, in blocks of like length.

    ``want`` is pairs: (a, b, identity) with a < b; forest: edges (a, b, identity) that connect what chains of pairs do; counts:
    (mask_a, mask_b, n, m), the number of pairs and the highest identity by the masks of the smaller and the larger rep (n may be 0 where a row only tells m,
    and has the two bits as masks; m may be less where a mask holds both bits, as its sequence with itself has 1). Sequences whose lengths differ by more than
    the threshold allows mostly never meet, and where the characters they can share rule a pair out it is not aligned; but pairs
    grow with the square of the number of distinct sequences of like length, as low thresholds let nearly all be partners. Therefore

    * a forest of more than ``few`` sequences first compares all with ``hubs`` of each band of lengths, then what is not in the largest component with eight times as
      many, and so on while that leaves under three quarters outside and more than ``few_pairs`` to compare; at last the rows of the largest components meet only what is not in them;
    * counts compare only sequences whose masks hold the two bits of one of the ``across`` pairs (None: all), and then large packs (so long a prefix
      in common that what is left can all be edited, or equal but for digits) are counted without being compared (``_packs``).
    """
    ship(sequences.sparkSession)
    length = F.length("seq")
    band = F.floor(F.log(length.cast("double")) / math.log(1 / threshold)) if threshold < 1 else length
    rows = sequences.where(length > 0).select(F.col("rep").alias("id"), "seq", "mask", band.cast("int").alias("band"))
    if want == "pairs":
        return _compared(rows.withColumn("kind", F.lit(0)), threshold, want, rows_per_block, lambda x, y: True)
    if want == "counts":
        if across is None:
            return _compared(rows.withColumn("kind", F.lit(0)), threshold, want, rows_per_block, lambda x, y: True)
        return _counted(rows, threshold, rows_per_block, across)
    rows = rows.withColumn("comp", F.col("id"))
    total = rows.count()
    if total <= few:
        return _compared(rows.withColumn("kind", F.lit(0)), threshold, want, rows_per_block, lambda x, y: True)
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64(F.lit(14), "id"), "id"))
    rows = materialise(rows.withColumn("place", place), "rows")
    path = new_path(sequences.sparkSession, "forest")
    forest = appended(_compared(rows.withColumn("kind", (F.col("place") <= hubs).cast("int")), threshold, want, rows_per_block, lambda x, y: x + y > 0), path)
    before = total
    while True:
        roots = materialise(connected_components(forest, "a", "b"), "roots")
        large = roots.groupBy("root").count().orderBy(F.desc("count"), "root").limit(8).collect()
        rank = F.coalesce(*[F.when(F.col("comp") == r["root"], k + 1) for k, r in enumerate(large)], F.lit(0)) if large else F.lit(0)
        named = rows.drop("comp").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
        named = materialise(named.withColumn("kind", rank), "rows")
        outside = total - large[0]["count"] - 1 if large else total
        hubs *= 8
        if 4 * outside > 3 * before or hubs >= total or outside * total <= few_pairs:
            break
        before = outside
        some = named.where((F.col("kind") != 1) | (F.col("place") <= hubs)).withColumn("kind", F.when(F.col("kind") == 1, 2).otherwise((F.col("place") <= hubs).cast("int")))
        forest = appended(_compared(some, threshold, want, rows_per_block, lambda x, y: x + y > 0 and x * y < 4), path)
    return forest.unionByName(_compared(named, threshold, want, rows_per_block, lambda x, y: x != y or x == 0))


def _compared(rows: DataFrame, threshold: float, want: str, rows_per_block: int, meets) -> DataFrame:
    """What ``aligned_blocks`` wants of the rows (id, seq, mask, band, kind, and comp for a forest) whose kinds meet."""

    def compare(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        (ids, a, more), (others, b, more_b) = ([t.column(c).to_pylist() for c in ("id", "seq", extra)] for t in (x, y))
        ids, others, more, more_b = (np.array(v, np.int64) for v in (ids, others, more, more_b))
        (u, m), (v, n) = kernel.codes(a), kernel.codes(b)
        longer = np.maximum(m[:, None], n[None, :])
        shared = kernel.most_shared(kernel.composition(u, m), kernel.composition(v, n))
        fits = shared >= threshold * longer - 1e-9
        if same:
            fits &= ids[:, None] < others[None, :]
        i, j = np.nonzero(fits)
        if want == "forest":
            at, found = _forest(i, j, more, more_b, shared[i, j] / longer[i, j], lambda i, j: kernel.identities(a, b, i, j, threshold))
            i, j = i[at], j[at]
        else:
            found = kernel.identities(a, b, i, j, threshold)
            hit = found >= threshold - 1e-9
            i, j, found = i[hit], j[hit], found[hit]
        first, second = np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])
        if want != "counts":
            return pa.table({"a": first, "b": second, "identity": found})
        turned = ids[i] > others[j]
        one, two = more[i].astype(np.int32), more_b[j].astype(np.int32)
        keys, which, n = np.unique(np.stack([np.where(turned, two, one), np.where(turned, one, two)]), axis=1, return_inverse=True, return_counts=True)
        best = np.zeros(len(n))
        np.maximum.at(best, which.ravel(), found)
        return pa.table({"mask_a": keys[0], "mask_b": keys[1], "n": n, "m": best})

    extra = "comp" if want == "forest" else "mask"
    schema = "mask_a int, mask_b int, n long, m double" if want == "counts" else "a long, b long, identity double"
    return neighbour_blocks(rows, ["seq", extra], compare, schema, rows_per_block, meets)


def _lie_across(x: int, y: int, across: list[tuple[int, int]]) -> bool:
    return any(x & p and y & q or x & q and y & p for p, q in across)


def _packs(rows: DataFrame, threshold: float, least: int, most: int = 16) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``rows`` with lead and pattern, numbers from 1 of the largest groups (at most ``most`` of each) of over ``least`` sequences, 0 for others, and
    two tables: patterns whose sequences are all similar, and patterns of which some may be.

    A lead is a common prefix in one band, of threshold * the longest length there: no more than the rest is edited. A pattern is a sequence without its
    digits. If no digit of one equals one of the other, patterns have their most edits, if all do, their fewest.
    """
    spark = rows.sparkSession
    longest = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.max(F.length("seq")).alias("n")).collect()}
    lead = F.lit(0)
    for band, n in longest.items():
        lead = F.when(F.col("band") == band, math.ceil(threshold * n - 1e-9)).otherwise(lead)
    rows = rows.withColumn("prefix", F.substring(F.col("seq"), F.lit(1), lead)).withColumn("shape", F.regexp_replace("seq", f"[0-9{WILD}{OTHER}]", WILD))
    found = []
    for name, keys in (("lead", ["band", "prefix"]), ("pattern", ["shape"])):
        large = rows.groupBy(*keys).count().where(F.col("count") > least).orderBy(F.desc("count"), *keys).limit(most).collect()
        if not large:
            rows = rows.withColumn(name, F.lit(0))
            continue
        table = spark.createDataFrame(pa.table({k: pa.array([r[k] for r in large], pa.int32() if k == "band" else pa.string()) for k in keys} | {name: pa.array(range(1, len(large) + 1), pa.int32())}))
        rows = rows.join(F.broadcast(table), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
        found = [r["shape"] for r in large] if name == "pattern" else []
    size = len(found) + 1
    sure, may = np.zeros((size, size), bool), np.ones((size, size), bool)
    if found:
        i, j = (v.ravel() for v in np.indices((size - 1, size - 1)))
        sure[i + 1, j + 1] = kernel.identities(found, [s.replace(WILD, OTHER) for s in found], i, j, threshold) > 0
        may[i + 1, j + 1] = kernel.identities(found, found, i, j, threshold) > 0
    return rows.drop("prefix", "shape"), sure, may


def _masks_one_apart(rows: DataFrame, n: int, places: list[int]) -> set[int]:
    """The masks of groups of the distinct sequences of length n that are equal but for one of the ``places``."""
    rest = lambda k: F.concat(F.substring(F.col("seq"), F.lit(1), k - 1), F.substring(F.col("seq"), k + 1, F.lit(n)))
    keys = F.transform(F.array(*[F.lit(k) for k in places]), lambda k: F.struct(k.alias("place"), rest(k).alias("rest")))
    groups = rows.where(F.length("seq") == n).select("mask", F.explode(keys).alias("key")).groupBy("key").agg(F.bit_or("mask").alias("mask"))
    return {r["mask"] for r in groups.select("mask").distinct().collect()}


def _highest(rows: DataFrame, threshold: float, sought: list[tuple[int, int]]) -> tuple[dict[tuple[int, int], float], list[tuple[int, int]]]:
    """({(bit, bit): identity}, rest): the highest identity between sequences whose masks hold one bit each, no mask both; the rest has no pair that
    an index of one or two edits finds. Of distinct sequences none are closer than the longest ones with one edit, so one such pair settles it."""
    rows = rows.where(_holds_any("mask", sought))
    n = rows.agg(F.max(F.length("seq"))).first()[0]
    best: dict = {}
    for places in ([n], list(range(1, n))):
        if sought and 1 - 1 / n > threshold and 0 < len(places) <= 300:
            masks = _masks_one_apart(rows.where(_holds_any("mask", sought)), n, places)
            best |= {(p, q): 1 - 1 / n for p, q in sought if any(m & p and m & q for m in masks)}
            sought = [x for x in sought if x not in best]
    for edits in (1, 2):
        t, some = 1 - edits / n, rows.where(_holds_any("mask", sought)) if sought else None
        if sought and t > threshold and _most_deleted(some, t):
            near = _deletion_pairs(some, t, edits, sought).groupBy("mask_a", "mask_b").agg(F.max("identity").alias("m")).collect()
            for x in sought:
                found = [r["m"] for r in near if _lie_across(r["mask_a"], r["mask_b"], [x])]
                best |= {x: max(found)} if found else {}
            sought = [x for x in sought if x not in best]
    return best, sought


def _counted(rows: DataFrame, threshold: float, rows_per_block: int, across: list[tuple[int, int]]) -> DataFrame:
    """The counts of ``aligned_blocks`` for the ``across`` pairs of bits. Pairs of packs that are certain are counted by the sizes of the packs; their highest
    identity is looked for where no mask holds both bits, and by comparing blocks only where ``_highest`` finds none."""
    rows, certain, may = _packs(rows, threshold, rows_per_block)
    rows = materialise(rows, "packs").withColumn("kind", (F.col("lead") * 64 + F.col("pattern")) * 8 + F.col("mask"))

    def sure(x: int, y: int) -> bool:
        (lead, pattern), (other, its) = divmod(x // 8, 64), divmod(y // 8, 64)
        return lead == other > 0 or bool(certain[pattern, its])

    open_ = lambda x, y: not sure(x, y) and may[x // 8 % 64, y // 8 % 64] and _lie_across(x % 8, y % 8, across)
    out = _compared(rows, threshold, "counts", rows_per_block, open_)
    sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    counted: dict = {}
    packed = set()
    for x, n in sizes.items():
        for y, k in sizes.items():
            pairs = n * (n - 1) // 2 if x == y else n * k
            if x <= y and pairs and sure(x, y) and _lie_across(x % 8, y % 8, across):
                key = min(x % 8, y % 8), max(x % 8, y % 8)
                counted[key] = counted.get(key, 0) + pairs
                packed |= {x, y}
    if not counted:
        return out
    sought = [x for x in across if any(_lie_across(*key, [x]) for key in counted) and not any(k & x[0] and k & x[1] for k in {kind % 8 for kind in sizes})]
    best = {}
    if sought:
        some = rows.where(F.col("kind").isin(*packed)).withColumn("rep", F.col("id"))
        best, sought = _highest(some, threshold, sought)
    found = [(*k, n, None) for k, n in counted.items()] + [(*k, 0, m) for k, m in best.items()]
    columns = zip(("mask_a", "mask_b", "n", "m"), zip(*found), (pa.int32(), pa.int32(), pa.int64(), pa.float64()))
    out = out.unionByName(rows.sparkSession.createDataFrame(pa.table({name: pa.array(v, t) for name, v, t in columns})))
    if sought:
        left = _compared(some, threshold, "counts", rows_per_block, lambda x, y: sure(x, y) and _lie_across(x % 8, y % 8, sought))
        out = out.unionByName(left.withColumn("n", F.lit(0).cast("long")))
    return out


def similar_pairs(sequences: DataFrame, threshold: float, want: str = "pairs") -> DataFrame:
    """(a, b, identity) of all pairs a < b of the distinct sequences (rep, seq) whose identity is at least ``threshold``. With
    ``want="forest"``, and a threshold of 0.5 or less, only enough of them to connect the same sequences.

    Short sequences, which can have two edits at most, go to ``_deletion_pairs``, whose candidates are hardly more than the pairs. Of others
    d edits destroy at most q * d of a sequence's q-grams, so among the q * d + 1 rarest of either sequence one is among those of the other.
    q is chosen by the mean length, so that these are a quarter of all grams at most (the frequent ones are then rarely among them). Sequences
    too short to have that many, and all that could be their partners, are also indexed by single characters, where the filter holds
    for any length. This needs a threshold above 0.5; others go to ``aligned_blocks``.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the identity threshold is above 0 and at most 1")
    if threshold <= 0.5:
        return aligned_blocks(sequences.select("rep", "seq", F.lit(0).alias("mask")), threshold, want)
    if threshold == 1:
        return sequences.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("identity")).limit(0)
    most = _most_deleted(sequences, threshold)
    if most:
        return _deletion_pairs(sequences.withColumn("mask", F.lit(0)), threshold, most).select("a", "b", "identity")
    mean, longest = (x or 1 for x in sequences.agg(F.avg(F.length("seq")), F.max(F.length("seq"))).first())
    most = min(5, math.ceil(threshold / (1 - threshold) - 1e-9) - 1)  # beyond it, no sequence has that many
    share = lambda n: (n * math.floor(_edits_with_any(mean, threshold, longest)) + 1) / max(1.0, mean - n + 1)
    q = max([n for n in range(1, most + 1) if share(n) <= 0.25], default=1)
    q = max(q, min(2, most))
    tokens = _prefix_tokens(sequences, q, threshold, longest)
    if q > 1:
        short = max((n for n in range(1, int(longest) + 1) if n - q + 1 < q * math.floor(_edits_with_any(n, threshold, longest)) + 1), default=0)
        tokens = tokens.unionByName(_prefix_tokens(sequences.where(F.length("seq") <= short / threshold), 1, threshold, longest))
    tokens = materialise(tokens, "tokens")
    left, right = (tokens.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), "q", "gram", "k") for side in "ab")
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    found = left.join(right, ["q", "gram", "k"]).where(fits).select("a", "b").distinct()
    found = found.join(
        sequences.select(F.col("rep").alias("a"), F.col("seq").alias("sa")), "a"
    ).join(sequences.select(F.col("rep").alias("b"), F.col("seq").alias("sb")), "b")
    longer = F.greatest(F.length("sa"), F.length("sb"))
    found = found.withColumn("edits", F.levenshtein("sa", "sb")).where(F.col("edits") <= most_edits(longer, threshold))
    return found.select("a", "b", (1 - F.col("edits") / longer).alias("identity"))


def distinct_sequences(df: DataFrame, id_col: str, sequence: str, *more: Column) -> DataFrame:
    """(rep, seq): each distinct sequence with its smallest id. Null sequences are left out."""
    return df.where(F.col(sequence).isNotNull()).groupBy(F.col(sequence).alias("seq")).agg(F.min(id_col).alias("rep"), *more)


def identity_clusters(df: DataFrame, id_col: str, sequence: str, threshold: float) -> DataFrame:
    """``df`` with cluster: the smallest id that a chain of similar sequences leads to. A row without a sequence is its own cluster."""
    sequences = materialise(distinct_sequences(df, id_col, sequence), "sequences")
    roots = connected_components(similar_pairs(sequences, threshold, "forest"), "a", "b")
    named = sequences.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("seq").alias("__seq"), F.coalesce("root", "rep").alias("__root"))
    return df.join(named, F.col(sequence) == F.col("__seq"), "left").withColumn("cluster", F.coalesce("__root", id_col)).drop("__seq", "__root")


def similar_sequences(parts: DataFrame, id_col: str, sequence: str, threshold: float, scope: str = "all") -> DataFrame:
    """(part_a, part_b, n_pairs, max_identity): pairs of distinct sequences, one of each part, that are similar; a sequence that both
    parts hold is a pair with itself. Copies of a sequence count once. Pairs are counted by the parts that hold their sequences, so
    at most 49 numbers are left of each task's pairs."""
    names = ("train", "val", "test")
    bits = [F.max((F.col("partition") == p).cast("int")) * (1 << k) for k, p in enumerate(names)]
    mask = F.coalesce(bits[0] + bits[1] + bits[2], F.lit(0))
    sequences = materialise(distinct_sequences(parts, id_col, sequence, mask.cast("int").alias("mask")), "sequences")
    if threshold <= 0.5:
        counts = aligned_blocks(sequences, threshold, "counts", across=[(1 << names.index(x), 1 << names.index(y)) for x, y in PAIRS[scope]])
    elif most := _most_deleted(sequences, threshold):
        pairs = _deletion_pairs(sequences, threshold, most)
        counts = pairs.groupBy("mask_a", "mask_b").agg(F.count("*").alias("n"), F.max("identity").alias("m"))
    else:
        pairs = similar_pairs(sequences.select("rep", "seq"), threshold)
        for side in "ab":
            pairs = pairs.join(sequences.select(F.col("rep").alias(side), F.col("mask").alias(f"mask_{side}")), side)
        counts = pairs.groupBy("mask_a", "mask_b").agg(F.count("*").alias("n"), F.max("identity").alias("m"))
    own = sequences.groupBy(F.col("mask").alias("mask_a"), F.col("mask").alias("mask_b")).agg(F.count("*").alias("n"), F.lit(1.0).alias("m"))
    counts = counts.select("mask_a", "mask_b", "n", "m").unionByName(own)
    holds = lambda side, part: F.col(f"mask_{side}").bitwiseAND(1 << names.index(part)) > 0
    across = lambda x, y: (holds("a", x) & holds("b", y)) | (holds("a", y) & holds("b", x))
    found = counts.agg(
        *[f(F.when(across(x, y), F.col(n))).alias(f"{n}|{x}|{y}") for x, y in PAIRS[scope] for n, f in (("n", F.sum), ("m", F.max))]
    )
    rows = [
        F.struct(
            F.lit(x).alias("part_a"), F.lit(y).alias("part_b"), F.coalesce(F.col(f"`n|{x}|{y}`"), F.lit(0)).cast("long").alias("n_pairs"), F.col(f"`m|{x}|{y}`").alias("max_identity")
        ) for x, y in PAIRS[scope]
    ]
    return found.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
