"""Comparing rows block by block: rows are dealt into bands, and only a band and the next one meet."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _block_pairs(tiles: list[int], meet: list[tuple[int, int]]) -> int:
    return sum(tiles[x] * (tiles[x] + 1) // 2 if x == y else tiles[x] * tiles[y] for x, y in meet)


def neighbour_blocks(rows: DataFrame, payload: list[str], compare: Callable, schema: str, rows_per_block: int, meets: Callable | None = None, least_rows: int = 64) -> DataFrame:
    """What ``compare(x, y, same)`` returns for all pairs of blocks of one ``band`` (an int column of ``rows``) or of two that follow each other.

    With ``meets``, only rows of kinds (an int column ``kind``) for which the symmetric ``meets(kind, other kind)`` is true are brought together.
    Rows of one band and kind are cut into blocks of about ``rows_per_block`` rows by a hash of ``id``, of fewer (``least_rows`` at least) where
    that would leave cores idle. x and y are Arrow tables with id and the ``payload``, neither of them empty; ``same`` says that they are one
    block. The driver sees one count for each band and kind, so both must be few.
    """
    spark = rows.sparkSession
    rows = rows if meets else rows.withColumn("kind", F.lit(0))
    sizes = {(r["band"], r["kind"]): r["n"] for r in rows.groupBy("band", "kind").agg(F.count("*").alias("n")).collect()}
    names = [field.split()[0] for field in schema.split(", ")]
    cells = sorted(sizes)
    meet = [
        (x, y) for x, (band, kind) in enumerate(cells) for y, (other, its) in enumerate(cells)
        if (other == band and y >= x or other == band + 1) and (not meets or meets(kind, its))
    ]
    of = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    kinds = [of[field.split()[1]] for field in schema.split(", ")]
    if not meet:
        return spark.createDataFrame(pa.table({n: pa.array([], t) for n, t in zip(names, kinds)}))
    wanted = max(64, 4 * spark.sparkContext.defaultParallelism)
    while True:
        tiles = [-(-sizes[c] // rows_per_block) for c in cells]
        tasks = _block_pairs(tiles, meet)
        if tasks >= wanted or rows_per_block <= least_rows:
            break
        rows_per_block = max(least_rows, rows_per_block // 2)
    of_kinds = lambda of: F.create_map(*[x for (band, kind), v in of.items() for x in (F.lit(f"{band}|{kind}"), v)])
    cell = of_kinds({c: F.lit(k) for k, c in enumerate(cells)})[F.concat_ws("|", "band", "kind")]
    count = F.create_map(*[F.lit(x) for k, n in enumerate(tiles) for x in (k, n)])
    rows = rows.withColumn("cell", cell).withColumn("mine", F.pmod(F.xxhash64("id"), count[F.col("cell")]).cast("int"))

    def side(at: str, other: str) -> DataFrame:
        """Each row once for every block that its own meets on the other side."""
        partners = {k: [y if at == "l" else x for x, y in meet if (x if at == "l" else y) == k] for k in range(len(cells))}
        met = F.create_map(*[x for k, p in partners.items() if p for x in (F.lit(k), F.array(*[F.lit(c) for c in p]))])
        out = rows.withColumn(f"{other}_cell", F.explode(met[F.col("cell")]))
        out = out.withColumn(f"{other}_tile", F.explode(F.sequence(F.lit(0), count[F.col(f"{other}_cell")] - 1)))
        own = [F.col(c).alias(f"{at}_{c}") for c in ("id", *payload, "cell")]
        return out.select(*own, F.col("mine").alias(f"{at}_tile"), f"{other}_cell", f"{other}_tile")

    keys = ["l_cell", "l_tile", "r_cell", "r_tile"]
    once = (F.col("l_cell") != F.col("r_cell")) | (F.col("l_tile") <= F.col("r_tile"))

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        same = all(x.column(f"l_{k}")[0].as_py() == x.column(f"r_{k}")[0].as_py() for k in ("cell", "tile"))
        x, y = (t.select([f"{at}_{c}" for c in ("id", *payload)]).rename_columns(["id", *payload]) for at, t in (("l", x), ("r", y)))
        return compare(x, y, same)

    parts = max(1, min(2 * tasks, 2048))  # a number, since few bytes can be much work and would be put into one task
    left, right = (side(*at).where(once).repartition(parts, *keys) for at in ("lr", "rl"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, schema)
