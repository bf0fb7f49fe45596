"""Exact top-k search by inner product with a KD-tree for each shard.

Components become integers, so scores are exact and ties are real ties. A shard's tree splits its rows at the median of the
dimension with the widest spread; its leaves, one row of the index each, have tight bounding boxes. A query visits nodes by the
highest score that a box allows, best first, and stops when that is below the k-th score it has.

A query is first searched in one shard. Its k-th score there goes with it to the other shards, which mostly need to look at fewer
leaves. Queries stream through a shard's tree, so a task holds one shard of bounded size and one batch of queries.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, slices

#: Rows of a leaf, bytes of a shard's vectors, and queries whose bounds are computed at once.
LEAF_ROWS, SHARD_BYTES, QUERY_ROWS = 128, 32 << 20, 256
#: Rows of a shard: as few as give all tasks work, between these.
SHARD_ROWS = (4096, 65536)

VECTORS = "vec_id long, dims long, v binary"
INDEX = "dims long, shard long, leaf long, row array<long>, vec_id array<long>, v binary"
HITS = "row long, query_id long, hit_row long, vec_id long, score string"


def _scaled(scale: float):
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            keep, sizes, parts = [], [], []
            values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)  # a null component becomes NaN
            lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(lengths)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale)
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            for k in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
                low, high = ends[k] - lengths[k], ends[k]
                if bad[low] == bad[high]:
                    keep.append(k)
                    sizes.append(int(lengths[k]))
                    parts.append(values[low:high].tobytes())
            columns = [ids.take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dims", "v"])

    return run


def median_splits(x: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """The rows of each leaf: halves at the median of the widest dimension, until a leaf is small enough.

    There are 2^h leaves, in the order of the tree, so that the nodes are those of a heap.
    """
    height = max(0, math.ceil(math.log2(max(1, len(x)) / leaf_rows)))
    leaves = [np.arange(len(x))]
    for _ in range(height):
        halves = []
        for rows in leaves:
            part, middle = x[rows], len(rows) // 2
            if x.shape[1] and middle:
                d = int((part.max(0) - part.min(0)).argmax())
                rows = rows[np.argpartition(part[:, d], middle)]
            halves += [rows[:middle], rows[middle:]]
        leaves = halves
    return leaves


class Tree:
    """The boxes of a shard's tree over its leaves' vectors, and the search in it."""

    def __init__(self, leaves: list[tuple[list, list, np.ndarray]]):
        self.leaves = leaves
        low, high = ([pick(v, axis=0) for _, _, v in leaves] for pick in (np.min, np.max))
        self.size = max((float(np.abs(v).max(initial=0)) for _, _, v in leaves), default=0.0)
        for side, pick in ((low, np.minimum), (high, np.maximum)):
            level = list(side)
            while len(level) > 1:
                level = [pick(a, b) for a, b in zip(level[::2], level[1::2])]
                side[:0] = level
        self.low, self.high = np.array(low), np.array(high)  # node k has the children 2k+1 and 2k+2

    def search(self, queries: np.ndarray, own: list[int], k: int, floors: list) -> list[list[tuple]]:
        """For each query the k best (score, id, row) of the shard that reach its floor, its own row left out."""
        low, high, vectors = self.low, self.high, [v for _, _, v in self.leaves]
        if self.size * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) >= 2**53:  # beyond doubles: whole numbers of any size
            whole = np.vectorize(int, otypes=[object])
            low, high, queries, *vectors = (whole(a) if a.size else a for a in (low, high, queries, *vectors))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        inner = len(self.leaves) - 1
        out = []
        for q, row, floor, bound in zip(queries, own, floors, bounds):
            best, open_ = [], [(-bound[0], 0)]  # best: the k best so far, the worst on top
            while open_:
                reach, node = heapq.heappop(open_)
                if -reach < floor:
                    break
                if node < inner:
                    for child in (2 * node + 1, 2 * node + 2):
                        if bound[child] >= floor:
                            heapq.heappush(open_, (-bound[child], child))
                    continue
                rows, ids, _ = self.leaves[node - inner]
                scores = vectors[node - inner] @ q
                least = max(floor, np.partition(scores, -k - 1)[-k - 1]) if len(scores) > k else floor  # the query's own row may be one of these
                for at in np.flatnonzero(scores >= least):
                    if rows[at] == row:
                        continue
                    number = ids[at]
                    hit = (int(scores[at]), number is not None, -number if number is not None else 0, -rows[at])  # a missing id comes last
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            out.append([(s, -n if there else None, -r) for s, there, n, r in best])
        return out


def _leaves(leaf_rows: int):
    """The index: a row for each leaf. Rows of a shard come together."""

    def leaves(at, held):
        x = np.array([v for _, _, v in held])
        for k, rows in enumerate(median_splits(x, leaf_rows)):
            yield (*at, k, [held[r][0] for r in rows], [held[r][1] for r in rows], x[rows].tobytes())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()])],
            names=["dims", "shard", "leaf", "row", "vec_id", "v"],
        )

    def run(batches):
        at, held = None, []
        for batch in slices(batches, 4096):
            for dims, shard, row, key, v in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (dims, shard) != at:
                    if held:
                        yield batch_of(list(leaves(at, held)))
                    at, held = (dims, shard), []
                held.append((row, key, np.frombuffer(v)))
        if held:
            yield batch_of(list(leaves(at, held)))

    return run


def _search(k: int):
    """Hits of the queries of each shard, which follow its leaves."""

    def run(batches):
        at, leaves, tree, held = None, [], None, []

        def flush():
            found = tree.search(np.array([h[2] for h in held]), [h[0] for h in held], k, [h[3] for h in held])
            rows = [(h[0], h[1], r, key, str(s)) for h, hits in zip(held, found) for s, key, r in hits]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, [pa.int64()] * 4 + [pa.string()])], names=["row", "query_id", "hit_row", "vec_id", "score"]
            )

        for batch in slices(batches, 256):
            for dims, shard, leaf, rows, ids, v, floor in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if (dims, shard) != at:
                    if held:
                        yield flush()
                    at, leaves, tree = (dims, shard), [], None
                if leaf is not None:
                    leaves.append((rows, ids, np.frombuffer(v).reshape(len(rows), dims)))
                    continue
                if not leaves:
                    continue
                if tree is None:
                    tree = Tree(leaves)
                held.append((rows[0], ids[0], np.frombuffer(v), -math.inf if floor is None else int(floor)))
                if len(held) == QUERY_ROWS:
                    yield flush()
        if held:
            yield flush()

    return run


def top_k(
    docs: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0,
    shard_rows: tuple[int, int] = SHARD_ROWS, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the k rows of the table with the highest inner product.

    Components are floor(scale * x) as doubles, so whole numbers; scores are exact, ties go to the smaller id, a missing id last. The
    query's own row is left out; other rows with its id or its vector are not. Rows whose vector is null, or holds a null or
    a component that isn't finite (before or after scaling), take no part; vectors of different lengths don't meet; empty vectors score 0.
    Repeated query rows each have their hits. A score beyond the range of long becomes the nearest long, after ranking. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    scaled = rows.where("asks").drop("asks").mapInArrow(_scaled(scale), VECTORS).withColumn("asks", F.lit(True)).unionByName(
        rows.where("not asks").drop("asks").mapInArrow(_scaled(scale), VECTORS).withColumn("asks", F.lit(False))
    )
    vectors = materialise(scaled.withColumn("row", F.monotonically_increasing_id()), "vectors")
    least, most = shard_rows
    fitting = f"greatest({leaf_rows}, least({most}, {SHARD_BYTES} div (8 * greatest(dims, 1)), greatest({least}, n div {2 * partitions(spark)})))"
    sizes = materialise(vectors.groupBy("dims").agg(F.count("*").alias("n")).select("dims", F.expr(f"cast(ceil(n / {fitting}) as bigint)").alias("shards")), "sizes")
    placed = vectors.join(sizes, "dims").withColumn("shard", F.expr("pmod(xxhash64(row), shards)"))
    own = placed.repartition("dims", "shard").sortWithinPartitions("dims", "shard").select("dims", "shard", "row", "vec_id", "v")
    index = materialise(own.mapInArrow(_leaves(leaf_rows), INDEX), "index")

    asked = placed.where("asks").select("dims", "shard", "shards", F.array("row").alias("row"), F.array("vec_id").alias("vec_id"), "v")

    def search(queries):
        queries = queries.select("dims", "shard", F.lit(None).cast("long").alias("leaf"), "row", "vec_id", "v", "floor")
        both = index.withColumn("floor", F.lit(None).cast("string")).unionByName(queries)
        both = both.repartition("dims", "shard").sortWithinPartitions("dims", "shard", F.col("leaf").isNull(), "leaf")
        return both.mapInArrow(_search(k), HITS)

    score = F.col("score").cast("decimal(38,0)")
    first = materialise(search(asked.withColumn("floor", F.lit(None).cast("string"))), "hits")
    enough = first.groupBy("row").agg(F.min(score).alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    floors = enough.select(F.array("row").alias("row"), F.col("least").cast("string").alias("floor"))
    rest = asked.join(floors, "row", "left").withColumn("home", F.col("shard")).withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)")))
    hits = first.unionByName(search(rest.where("shard <> home"))).withColumn("exact", score)
    place = Window.partitionBy("row").orderBy(F.desc("exact"), F.asc_nulls_last("vec_id"), "hit_row")
    ranked = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    long = F.greatest(F.least(F.col("exact"), top), -top).cast("long")
    return ranked.select("query_id", "rank", "vec_id", long.alias("score"))


#: The same by comparing each query with all rows.
ORACLE = """
    with v as (
      select row_number() over () as row, vec_id, [floor(1024 * x::double) for x in embedding] as x from embeddings
      where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    scores as (
      select q.row, q.vec_id as query_id, c.vec_id, c.row as hit, list_inner_product(q.x, c.x)::bigint as score
      from v q join v c on q.row <> c.row and len(q.x) = len(c.x) where q.vec_id % 100 = 0)
    select query_id, row_number() over (partition by row order by score desc, vec_id nulls last, hit) as rank, vec_id, score from scores qualify rank <= 10"""
