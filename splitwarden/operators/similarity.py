"""Exact nearest neighbours in balls, and exact pairs above a cosine similarity in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unit_vector
from ..shared import materialise, ship


def _matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """The rows of an array column, without a Python object for each number."""
    return table.column(column).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1 - x @ y.T
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):  # one dimension at a time, so that no array has three
        step = np.abs(x[:, k, None] - y[None, :, k])
        out += step if metric == "manhattan" else step * step
    return out if metric == "manhattan" else np.sqrt(out)


def _apart(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances that obey the triangle inequality: those of ``metric``, or for cosine the straight ones of unit vectors."""
    if metric == "manhattan":
        return _distances(x, y, metric)
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def _tile_rows(rows: int) -> int:
    """Rows of a tile: a 16th of all, from 2048 to 65536. A row that must look everywhere is so sent to about 16 tiles, however many rows
    there are up to 2^20, and beyond to one for each 65536 rows."""
    return max(2048, min(65536, -(-rows // 16)))


def _nearest(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k smallest finite distances of each row, of equal ones the first columns."""
    bound = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] if distance.shape[1] > k else np.inf
    row, column = np.nonzero((distance <= bound) & np.isfinite(distance))
    order = np.lexsort((column, distance[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


#: What ``_apart`` may be off by, through rounding.
SLACK = 1e-6


class _Grid:
    """A tile's vectors in whole steps of 6 bits, which bound Manhattan distances from below at a small part of their cost.

    Steps are as long in all dimensions and cover the middle 98 % of the widest; what rounding and cutting take from a row is its ``error``. The distance of
    two rows is at least that of their steps less both errors, and that of steps is the sum of both less twice the sum of their minima, which
    is added up four dimensions at a time in bytes.
    """

    levels = 63

    def __init__(self, y: np.ndarray):
        self.low, high = np.percentile(y, [1, 99], axis=0)
        self.step = float((high - self.low).max()) / self.levels or 1.0
        self.columns = np.ascontiguousarray(y.T)
        self.codes, self.error, self.sums = self._of(y)

    def _of(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps = np.clip(np.rint((z - self.low) / self.step), 0, self.levels)
        return np.ascontiguousarray(steps.T.astype(np.uint8)), np.abs(z - self.low - steps * self.step).sum(1), steps.sum(1)

    def within(self, x: np.ndarray, reach: np.ndarray, rows: int = 128, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Places (row, column) of all pairs that may be within the row's ``reach``."""
        codes, error, sums = self._of(x)
        need = np.floor((sums - (reach + error + SLACK) / self.step) / 2 - 1e-6)  # of the minima, less what the column needs
        given = np.floor((self.sums - self.error / self.step) / 2 - 1e-6)
        most = self.levels * len(codes) + np.abs(given).max()
        kind = np.int16 if most < 1 << 15 else np.int64
        need, given = np.clip(need, -most, most).astype(kind), given.astype(kind)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for r in range(0, len(x), rows):
            for c in range(0, len(given), columns):
                mine, its = codes[:, r : r + rows, None], self.codes[:, None, c : c + columns]
                total = np.repeat(-given[None, c : c + columns], mine.shape[1], axis=0)
                four, one = np.empty(total.shape, np.uint8), np.empty(total.shape, np.uint8)
                for k in range(0, len(codes), 4):
                    np.minimum(mine[k], its[k], out=four)
                    for more in range(k + 1, min(k + 4, len(codes))):
                        np.minimum(mine[more], its[more], out=one)
                        four += one
                    total += four
                i, j = np.divmod(np.flatnonzero(total >= need[r : r + rows, None]), total.shape[1])
                found.append((i + r, j + c))
        return tuple(np.concatenate(v) for v in zip(*found))

    def distances(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same numbers as ``_distances`` of the pairs x[i] and column j."""
        out = np.zeros(len(i))
        for mine, its in zip(np.ascontiguousarray(x.T), self.columns):
            out += np.abs(mine[i] - its[j])
        return out


def _nearest_in_steps(grid: _Grid, x: np.ndarray, y: np.ndarray, reach: np.ndarray | None, asked: np.ndarray, ids: np.ndarray, k: int, digits: int, some: int = 1024):
    """(row, column, rounded distance) of the k nearest in Manhattan distance within ``reach``, of equal ones the first columns. Rows
    with the id that was asked for are left out. Without a reach, the k-th of ``some`` vectors bounds the others."""
    if reach is None:
        distance = np.round(_distances(x, y[:some], "manhattan"), digits)
        distance[asked[:, None] == ids[None, :some]] = np.inf
        reach = np.partition(distance, k - 1, axis=1)[:, k - 1] + 10.0**-digits if distance.shape[1] >= k else np.full(len(x), np.inf)
    i, j = grid.within(x, reach)
    keep = asked[i] != ids[j]
    i, j = i[keep], j[keep]
    distance = np.round(grid.distances(x, i, j), digits) + 0.0
    order = np.lexsort((j, distance, i))
    i, j, distance = i[order], j[order], distance[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], distance[keep]


class Balls:
    """Balls of vectors around centres, in tiles of about ``rows_per_block`` rows (None: ``_tile_rows``).

    Centres are the vectors whose ids have the smallest hashes: one for each tile's worth of rows, ``most_centres`` at most, so what goes to the driver
    and to every task is bounded. A vector is in the ball of its nearest centre; a large ball just has more tiles.
    """

    def __init__(self, base: DataFrame, metric: str, rows_per_block: int | None = None, most_centres: int = 4096, payload: dict[str, str] | None = None):
        spark, self.metric = base.sparkSession, metric
        base = materialise(base, "vectors")
        count = base.count()
        rows_per_block = rows_per_block or _tile_rows(count)
        wanted = min(most_centres, -(-count // rows_per_block))
        chosen = base.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(max(1, wanted)).select("v").toArrow()
        self.empty = not chosen.num_rows
        self.centres = spark.sparkContext.broadcast(_matrix(chosen) if not self.empty else np.zeros((0, 0)))
        more = "".join(f"{c} {t}, " for c, t in (payload or {}).items())
        self.rows = materialise(base.select("id", "v", *(payload or {})).mapInArrow(self.nearest(*(payload or {})), f"id long, v array<double>, {more}ball int, gap double"), "balls")
        size = self.rows.groupBy("ball").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
        self.radius, self.tiles = np.full(len(self.centres.value), -1.0), np.zeros(len(self.centres.value), np.int64)
        self.n = sum(r["n"] for r in size)
        for r in size:
            self.radius[r["ball"]], self.tiles[r["ball"]] = r["radius"], -(-r["n"] // rows_per_block)
        sizes = spark.createDataFrame([(k, int(t)) for k, t in enumerate(self.tiles)], "ball int, tiles long")
        self.tiled = self.rows.withColumn("own", F.col("ball")).join(F.broadcast(sizes), "ball").withColumn("tile", F.pmod(F.xxhash64(F.lit(12), "id"), "tiles"))  # at most most_centres rows
        self.sizes = sizes

    def nearest(self, *more: str):
        """(id, v, *more, ball, gap): the nearest centre and the distance to it."""
        centres, metric = self.centres, self.metric
        few = max(1, (1 << 20) // max(1, len(self.centres.value)))  # rows at a time: their distances to all centres are held

        def run(batches):
            for whole in batches:
                for batch in (whole.slice(at, few) for at in range(0, whole.num_rows, few)):
                    far = _apart(_matrix(pa.Table.from_batches([batch])), centres.value, metric)
                    ball = far.argmin(1)
                    own = {c: batch.column(c) for c in ("id", "v", *more)}
                    yield pa.RecordBatch.from_pydict(own | {"ball": pa.array(ball.astype(np.int32)), "gap": pa.array(far[np.arange(len(ball)), ball])})

        return run

    def reached(self, *more: str):
        """(id, v, *more, ball): the balls that can hold a vector within ``reach`` of a query, by the triangle inequality."""
        centres, metric, radius = self.centres, self.metric, self.radius
        few = max(1, 65536 // max(1, len(radius)))  # rows at a time: each may come out once for every ball

        def run(batches):
            for whole in batches:
                for batch in (whole.slice(at, few) for at in range(0, whole.num_rows, few)):
                    far = _apart(_matrix(pa.Table.from_batches([batch])), centres.value, metric)
                    reach = batch.column("reach").to_numpy(zero_copy_only=False)
                    q, ball = np.nonzero((radius[None, :] >= 0) & (far - radius[None, :] <= reach[:, None] + SLACK))
                    yield pa.RecordBatch.from_pydict({c: batch.column(c).take(pa.array(q)) for c in ("id", "v", *more)} | {"ball": pa.array(ball.astype(np.int32))})

        return run


def ball_visits(balls: Balls, queries: DataFrame, k: int, digits: int, leave_out: bool) -> tuple[DataFrame, DataFrame, int]:
    """The neighbours from a first round, the (id, v, reach, ball, tile) that remain to be looked at, and the number of queries.

    Each query is first compared with one tile of the ball of its nearest centre. Its k-th distance there bounds the k-th of all, so
    other tiles count only if their ball reaches into that distance.
    """
    near = queries.mapInArrow(balls.nearest(), "id long, v array<double>, ball int, gap double").join(F.broadcast(balls.sizes.where("tiles > 0")), "ball")
    home = materialise(near.select("id", "v", "ball", F.pmod(F.xxhash64(F.lit(12), "id"), "tiles").alias("tile")), "home")
    count = home.count()
    first = materialise(_visit(balls, home, count, k, digits, leave_out), "first")
    least = first.groupBy("a").agg(F.max("distance").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= k)
    worst = F.coalesce("worst", F.lit(float("inf"))) + 10.0**-digits  # distances are rounded
    reach = F.sqrt(2 * worst) if balls.metric == "cosine" else worst  # a cosine distance is at least half of the squared straight one
    asked = home.withColumnsRenamed({"ball": "home_ball", "tile": "home_tile"}).join(least.select(F.col("a").alias("id"), "worst"), "id", "left").withColumn("reach", reach)
    rest = asked.select("id", "v", "reach").mapInArrow(balls.reached("reach"), "id long, v array<double>, reach double, ball int").join(F.broadcast(balls.sizes), "ball")
    rest = rest.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    seen = home.select("id", "ball", "tile").distinct()
    return first, rest.select("id", "v", "reach", "ball", "tile").join(seen, ["id", "ball", "tile"], "left_anti"), count


def _stream(balls: Balls, visits: DataFrame, queries: int, payload: dict[str, str], meet, schema: str, queries_per_task: int = 1 << 18, cells: int = 1 << 21) -> DataFrame:
    """The batches that ``meet(some, x, tile, y)`` yields for visiting queries and their tile: Arrow tables of id and the ``payload``
    columns (and their types; null where tiles lack them) and matrices of the vectors, as many queries as make ``cells`` distances, 1024 at most. ``queries`` is how many there are. They
    stream through a task that holds one tile; tiles with many are held by several."""
    parts = max(1, -(-queries // min(queries_per_task, max(1 << 13, -(-queries // 4)))))
    share = F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(parts))
    own = ["id", "v", *payload]
    left = visits.select("ball", "tile", share.alias("share"), F.lit(1).alias("asks"), *own)
    tiled = balls.tiled.withColumns({c: F.lit(None).cast(t) for c, t in payload.items() if c not in balls.tiled.columns})
    right = tiled.select("ball", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("share"), F.lit(0).alias("asks"), *own)
    both = right.unionByName(left).repartition("ball", "tile", "share").sortWithinPartitions("ball", "tile", "share", "asks", "id")

    def run(batches):
        at, held, tile, y = None, [], None, None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("ball", "tile", "share", "asks")]
            if not batch.num_rows:
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                here, piece = tuple(int(c[s]) for c in columns[:3]), pa.Table.from_batches([batch.slice(s, e - s)]).select(own)
                if here != at:
                    at, held, tile = here, [], None
                if not columns[3][s]:
                    held.append(piece)
                elif held or tile is not None:
                    if tile is None:
                        tile, held = pa.concat_tables(held), []
                        y = _matrix(tile)
                    many = max(1, min(1024, cells // tile.num_rows))
                    for low in range(0, piece.num_rows, many):
                        some = piece.slice(low, many)
                        yield meet(some, _matrix(some), tile, y)

    return both.mapInArrow(run, schema)


def _visit(balls: Balls, visits: DataFrame, queries: int, k: int, digits: int, leave_out: bool) -> DataFrame:
    """(a, b, distance): up to k neighbours of each visiting query in its tile."""
    metric = balls.metric
    grids: list = []  # of the tile that the task holds

    def meet(some, x, tile, y):
        asked, ids = some.column("id").to_numpy(), tile.column("id").to_numpy()
        if metric == "manhattan" and np.isfinite(x).all() and np.isfinite(y).all():
            if not grids or grids[0][0] is not y:
                grids[:] = [(y, _Grid(y))]
            reach = some.column("reach").to_numpy() if payload else None
            i, j, found = _nearest_in_steps(grids[0][1], x, y, reach, asked if leave_out else np.full(len(asked), np.nan), ids, k, digits)
        else:
            distance = np.round(_distances(x, y, metric), digits) + 0.0
            if leave_out:
                distance[asked[:, None] == ids[None, :]] = np.inf
            i, j = _nearest(distance, k)  # the tile is in the order of its ids
            found = distance[i, j]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (asked[i], ids[j], found)], names=["a", "b", "distance"])

    payload = {"reach": "double"} if metric == "manhattan" and "reach" in visits.columns else {}
    return _stream(balls, visits, queries, payload, meet, "a long, b long, distance double", cells=1 << 22 if metric == "manhattan" else 1 << 21)


def knn(
    queries: DataFrame, base: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", rows_per_block: int | None = None, digits: int = 9,
    metric: str = "cosine", leave_out: bool = True
) -> DataFrame:
    """(a, b, distance, rank): the k rows of ``base`` nearest to each row of ``queries``, itself left out (with ``leave_out``).

    ``metric`` is cosine, euclidean or manhattan. Distances are rounded to ``digits``, and ties go to the smaller id. ``base`` is cut into balls (``Balls``);
    a first round gives each query a bound, and the second looks only at balls that reach into it (``ball_visits``), so nothing is missed, and
    clustered vectors are compared with few tiles. Unclustered ones in many dimensions are compared with all. Null vectors are left out; vectors of
    a different length than the first don't occur.
    """
    ship(base.sparkSession)
    unit = (unit_vector(F.col(vector)) if metric == "cosine" else F.transform(vector, lambda x: x.cast("double"))).alias("v")
    rows, asked = (df.select(F.col(id_col).cast("long").alias("id"), unit).where("v is not null") for df in (base, queries))
    balls = Balls(rows, metric, rows_per_block)
    if balls.empty:
        return base.sparkSession.createDataFrame([], "a long, b long, distance double, rank int")
    first, rest, count = ball_visits(balls, asked, k, digits, leave_out)
    found = first.unionByName(_visit(balls, rest, count, k, digits, leave_out))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pairs_above(
    vectors: DataFrame, threshold: float, id_col: str = "id", vector: str = "embedding", part: str | None = None, rows_per_block: int | None = None, digits: int = 9,
    count: bool = False
) -> DataFrame:
    """(a, b, similarity): all pairs a < b with a cosine similarity (rounded to ``digits``) of at least ``threshold``, of different parts if
    ``part`` names a column. With ``count``, (ball, rows, compared, candidates, pairs) instead: what each ball's tiles had to do.

    Rows are cut into balls (``Balls``). A row looks only at balls that reach into the threshold's distance of it, and of two balls only the rows
    of the one with the smaller number look at the other. Within a tile the dimensions of the largest spread go first: their product and the
    norms of what is left of both rows bound the similarity (Cauchy-Schwarz), and only pairs that this leaves are worked out. Nothing is
    lost; a low threshold prunes little. A zero vector's similarity to any other is 0; null vectors are left out.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), unit_vector(F.col(vector)).alias("v"), (F.col(part) if part else F.lit(None)).cast("string").alias("part")
    ).where("v is not null")
    schema = "ball int, rows long, compared long, candidates long, pairs long" if count else "a long, b long, similarity double"
    balls = Balls(rows, "cosine", rows_per_block, payload={"part": "string"})
    if balls.empty:
        return vectors.sparkSession.createDataFrame([], schema)
    reach = math.sqrt(max(0.0, 2 - 2 * (threshold - 10.0**-digits)))
    own = balls.rows.withColumn("reach", F.lit(reach)).withColumn("own", F.col("ball"))
    visits = own.select("id", "v", "reach", "part", "own").mapInArrow(balls.reached("part", "own"), "id long, v array<double>, part string, own int, ball int")
    visits = visits.where("ball >= own").join(F.broadcast(balls.sizes), "ball").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    spread = np.argsort(-balls.centres.value.var(axis=0), kind="stable")
    lead, rest = np.split(spread, [len(spread) // 4])

    def meet(some, x, tile, y):
        asked, ids = some.column("id").to_numpy(), tile.column("id").to_numpy()
        within = (some.column("own").to_numpy() == tile.column("own").to_numpy()[0])[:, None]
        wanted = np.where(within, asked[:, None] < ids[None, :], asked[:, None] != ids[None, :])
        if part:
            codes = pa.chunked_array(some.column("part").chunks + tile.column("part").chunks).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            wanted &= codes[: len(asked), None] != codes[None, len(asked) :]
        compared = int(wanted.sum())
        left = [np.sqrt(np.maximum((m[:, rest] ** 2).sum(1), 0)) for m in (x, y)]
        wanted &= x[:, lead] @ y[:, lead].T + left[0][:, None] * left[1][None, :] >= threshold - 10.0**-digits - SLACK
        i, j = np.nonzero(wanted)
        exact = np.einsum("nd,nd->n", x[i], y[j]) if 8 * len(i) < wanted.size else (x @ y.T)[i, j]
        found = np.round(exact, digits)
        hit = found >= threshold
        if count:
            numbers = [tile.column("own").to_numpy()[:1], [tile.num_rows], [compared], [len(i)], [int(hit.sum())]]
            return pa.RecordBatch.from_arrays([pa.array(n) for n in numbers], names=["ball", "rows", "compared", "candidates", "pairs"])
        a, b = asked[i[hit]], ids[j[hit]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(found[hit])], names=["a", "b", "similarity"])

    return _stream(balls, visits.select("id", "v", "part", "own", "ball", "tile"), balls.n, {"part": "string", "own": "int"}, meet, schema)


def knn_vote(neighbours: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """(id, predicted, score): the label with most votes among the neighbours, ties to the smaller label; score is its share."""
    votes = neighbours.join(labels.select(F.col("id").alias("b"), "label"), "b")
    weight = F.when(F.col("distance") > 0, 1 / F.col("distance")).otherwise(1e12) if weighted else F.lit(1.0)
    votes = votes.withColumn("w", weight).groupBy("a", "label").agg(F.sum("w").alias("w"))
    each = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best"), F.sum("w").alias("all"))
    return each.select(F.col("a").alias("id"), F.col("best.label").alias("predicted"), (-F.col("best.w") / F.col("all")).alias("score"))
