"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared in blocks: bit planes are stored vertically (one bit of a word for each fingerprint), the
distances of 64 pairs at a time are counted with carry-save bitwise counters, and a block is abandoned
as soon as all of its pairs exceed the radius.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import appended, body, materialise, new_path, slices

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, words_per_shingle: int, seed: int) -> np.ndarray:
    """The hash of every shingle, repeats included; a shorter text is one shingle, a text without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    k, digest, join = words_per_shingle, xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + k]), seed) for i in range(max(1, len(words) - k + 1))), np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words whose bits are set in over half of the rows of ``hashes`` (n x words)."""
    n, width = hashes.shape
    set_in = np.zeros(64 * width, np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8), axis=1, bitorder="little")
        lanes = bits.view(np.uint64)  # eight counters in a word, which hold 255 rows each
        set_in += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * set_in > n, bitorder="little").view(np.uint64)


def fingerprint(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text; 0 for a text without words."""
    hashes = shingle_hashes(text, words_per_shingle, seed)
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(t, words_per_shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), body(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """One row of words for each bit of the fingerprints (n x words): bit j of row p is bit p of fingerprint j."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    packed = np.zeros((len(bits), -(-n // 64) * 8), np.uint8)
    packed[:, : -(-n // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return packed.view(np.uint64)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the pairs whose count exceeds the radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def close_pairs(fps: np.ndarray, radii: list[int], rows_at_once: int = 128, look_every: int = 8, first_rows: int | None = None) -> list[np.ndarray]:
    """A bit matrix (n x words) for each of the rising radii: bit j of row i is set if j > i and fps[i], fps[j] differ in at most
    that many bits. Fingerprints are rows of one or more 64-bit words. With ``first_rows``, only so many rows are compared with those after them."""
    n = len(fps)
    compared = n if first_rows is None else first_rows
    fps = np.ascontiguousarray(fps).reshape(n, -1)
    planes = _planes(fps)
    width, most = planes.shape[1], radii[-1]
    out = [np.zeros((n, width), np.uint64) for _ in radii]
    position = np.arange(width * 64)
    for at in range(0, compared, rows_at_once):
        rows = np.arange(at, min(compared, at + rows_at_once))
        first = at // 64
        valid = (position[None, first * 64 :] > rows[:, None]) & (position[None, first * 64 :] < n)
        over = ~np.packbits(valid, axis=1, bitorder="little").view(np.uint64)
        mine = np.unpackbits(fps[rows].view(np.uint8), axis=1, bitorder="little")
        masks = np.where(mine, ALL, np.uint64(0))
        counters = [np.zeros_like(over) for _ in range(max(1, most.bit_length()))]
        for p in range(len(planes)):
            carry = planes[p, first:][None, :] ^ masks[:, p][:, None]
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
            if p % look_every == look_every - 1 and ((over | _above(counters, most)) == ALL).all():
                break
        else:
            for matrix, radius in zip(out, radii):
                matrix[rows, first:] = ~(over | _above(counters, radius))
    return out


def forest(levels: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph whose upper half is the last bit matrix; edges of earlier matrices come first."""
    edges, parent = [], list(range(len(levels[0])))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for links in levels:
        for i in np.flatnonzero(links.any(axis=1)).tolist():
            for j in np.flatnonzero(np.unpackbits(links[i].view(np.uint8), bitorder="little")).tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[b] = a
                    edges.append((i, j))
    return edges


def forests(pairs: list[tuple[int, int]], groups: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The edges of up to ``count`` spanning forests over the groups of nodes, each of pairs that no forest before it took."""
    taken: dict = {}
    for _ in range(count):
        parent, before = {}, len(taken)

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for i, j in pairs:
            if (i, j) not in taken:
                a, b = root(groups[i]), root(groups[j])
                if a != b:
                    parent[b] = a
                    taken[i, j] = True
        if len(taken) == before:
            break
    return list(taken)


def _link_blocks(radii: list[int], block: int, keys: int):
    """Reads rows (``keys`` columns, rep, words of the fingerprint) sorted by the keys, and compares whole buckets, several small ones
    at a time. Smaller reps come first, so that a clique becomes a star around its smallest rep."""

    def compare(fps, reps):
        fps, reps = np.concatenate(fps), np.concatenate(reps)
        reps, first = np.unique(reps, return_index=True)
        pairs = forest(close_pairs(fps[first], radii, 512, 8 * fps.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(reps[[p[k] for p in pairs]], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        fps, reps, held, last = [], [], 0, None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, rep, fp = columns[:keys], columns[keys], np.stack(columns[keys + 1 :], 1).view(np.uint64)
            if not len(rep):
                continue
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(rep)]):
                here = tuple(k[s] for k in key)
                if here != last and held >= block:
                    yield compare(fps, reps)
                    fps, reps, held = [], [], 0
                last = here
                fps.append(fp[s:e])
                reps.append(rep[s:e])
                held += e - s
        if held:
            yield compare(fps, reps)

    return run


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, blocks: int = 4, words_per_shingle: int = 3, seed: int = 42,
    tile: int = 2048
) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable by links.

    Two rows link if their fingerprints differ in at most ``radius`` bits. Null texts count as empty; texts without words
    have fingerprint 0 and link like any other. Rows with a null id get the component of rows with the same
    fingerprint, or null. Repeated rows are kept, each with its component. Other columns are not read.

    Equal fingerprints are first reduced to one row with a map-side aggregation, so copies cost nothing. Of ``blocks``
    parts of a fingerprint at least ``blocks - radius`` are equal within the radius; every choice of them is a
    bucket key, so no link is lost. A bucket with more than ``tile`` distinct fingerprints is cut into tiles, and
    each pair of tiles is compared in a task of its own. A bucket yields a spanning forest, not its pairs.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words_per_shingle, seed), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    edges_at = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << edges_at[k + 1]) - 1) ^ ((1 << edges_at[k]) - 1) for k in range(blocks)]
    choices = [sum(masks[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in choices]
    keyed = reps.where(F.col("rep").isNotNull()).select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)])).alias("at")
    ).select("at.combo", "at.key", "fp", "rep")
    sizes = keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    mine = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("tiles")).cast("int")
    tiled = (
        keyed.join(sizes, ["combo", "key"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("combo", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "rep", "fp")
    )
    sorted_rows = tiled.repartition("combo", "key", "low", "high").sortWithinPartitions("combo", "key", "low", "high")
    links = sorted_rows.mapInArrow(_link_blocks([radius], 512, 4), "a long, b long")
    roots = connected_components(links, "a", "b")
    classes = reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    classes = materialise(classes, "classes")  # so that the join shuffles both sides, and adaptive execution can split a hot fingerprint
    return fps.join(classes, "fp").select("id", "fp", "component_id")


# ---- near duplicates by Jaccard similarity ----


@lru_cache(maxsize=4)
def _mixers(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, width, np.uint64)


def wide_fingerprint(text: str, words_per_shingle: int, seed: int, width: int) -> tuple[int, ...] | None:
    """A SimHash of ``width`` signed words: every shingle's hash is mixed into as many. None for a text without words."""
    hashes = shingle_hashes(text, words_per_shingle, seed)
    if not len(hashes):
        return None
    x = hashes[:, None] ^ _mixers(seed, width)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return tuple(majority(x ^ (x >> np.uint64(33))).view(np.int64).tolist())


def differing_share(jaccard: float) -> float:
    """The expected share of differing bits of two texts whose shingle sets, of like size, have that similarity."""
    return math.acos(2 * jaccard / (1 + jaccard)) / math.pi


def choose_bands(rows: int, least: float, bits: int, seed: int, per_bucket: int = 256, recall: float = 0.999) -> np.ndarray:
    """bands x positions: which bits make the key of each band.

    A key has so many bits that a bucket of unlike texts holds about ``per_bucket``; there are so many bands that a pair of
    similarity ``least`` shares a key with probability ``recall``. The number of bands grows as rows to the power 0.24.
    """
    if not 0.5 <= least < 1:
        raise ValueError("the similarity is from 0.5 to under 1")
    long = max(6, math.ceil(math.log2(max(1, rows / per_bucket))))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing_share(least)) ** long))
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(bits, long, replace=False) for _ in range(count)])


def _band_keys(bands: np.ndarray):
    weights = 1 << np.arange(bands.shape[1], dtype=np.int64)

    def run(batches):
        for batch in slices(batches, 2000):
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rep, fp = columns[0], np.stack(columns[1:], 1)
            bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
            keys = np.stack([bits[:, band].astype(np.int64) @ weights for band in bands], 1) * len(bands) + np.arange(len(bands))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), *(pa.array(np.repeat(c, len(bands))) for c in [rep, *fp.T])], names=["key", *batch.schema.names]
            )

    return run


def _jaccard(least: float, words_per_shingle: int, seed: int):
    """Reads (a, ta, b, tb) and yields whether their shingle sets are alike enough; rows with one a lie side by side."""

    def run(batches):
        last, set_a = None, None
        for batch in slices(batches):
            alike = []
            for a, ta, b, tb in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, ta) != last:
                    last, set_a = (a, ta), np.unique(shingle_hashes(ta, words_per_shingle, seed))
                set_b = np.unique(shingle_hashes(tb, words_per_shingle, seed))
                both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                alike.append(both > 0 and both >= least * (len(set_a) + len(set_b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    return run


def _band_masks(bands: np.ndarray, bits: int) -> np.ndarray:
    """bands x words: the bits of each band's key."""
    chosen = np.zeros((len(bands), bits), np.uint8)
    chosen[np.arange(len(bands))[:, None], bands] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)


def _meet_earlier(x: np.ndarray, masks: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Whether pairs whose fingerprints differ in the bits of ``x`` share the key of one of these bands."""
    out = np.zeros(len(x), bool)
    for low in range(0, len(x) if len(masks) else 0, at_once):
        out[low : low + at_once] = ((x[low : low + at_once, None, :] & masks[None]) == 0).all(-1).any(-1)
    return out


def _proposals(radii: list[int], count: int, masks: np.ndarray):
    """Reads rows (key, i, j, side, a, b, words of the fingerprint) sorted by the first four: of side 0 and 1 are the texts (rep a, root b) that
    are to be compared, of side 2 the pairs (a, b) that were not alike. Yields (key, a, b) of ``count`` forests of the other close pairs
    of texts with different roots. A pair counts in the first band only that it shares, so that buckets don't propose it again and again."""

    def compare(key, parts):
        left, right, failed = (np.concatenate(x) if x else np.zeros((0, parts[0][0].shape[1]), np.int64) for x in parts)
        both = np.concatenate([left, right])
        reps, roots = both[:, 0], both[:, 1]
        n = len(left)
        at = [dict(zip(reps[:n].tolist(), range(n))), dict(zip(reps[n:].tolist(), range(n, len(reps))))]
        fps, earlier = both[:, 2:].copy().view(np.uint64), masks[: key[0] % len(masks)]
        levels = close_pairs(fps, radii, 128, 8 * fps.shape[1], n)
        fresh = np.zeros((n, len(reps)), bool)
        fresh[:, n:] = roots[:n, None] != roots[None, n:]
        for a, b in failed[:, :2].tolist():
            for x, y in ((a, b), (b, a)):
                if x in at[0] and y in at[1]:
                    fresh[at[0][x], at[1][y]] = False
        pairs = []
        for links in levels:
            here = np.unpackbits(links[:n].view(np.uint8), axis=1, bitorder="little")[:, : len(reps)].astype(bool) & fresh
            fresh &= ~here
            i, j = np.nonzero(here)
            own = ~_meet_earlier(fps[i] ^ fps[j], earlier)
            pairs += zip(i[own].tolist(), j[own].tolist())
        found = np.array(sorted({tuple(sorted((int(reps[i]), int(reps[j])))) for i, j in forests(pairs, roots.tolist(), count)}), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key[0])), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["key", "a", "b"])

    def run(batches):
        last, parts = None, ([], [], [])
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns[:4]], axis=0)) + 1
            rows = np.stack(columns[4:], 1)
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                here = tuple(int(k[s]) for k in columns[:3])
                if here != last:
                    if last and parts[0]:
                        yield compare(last, parts)
                    last, parts = here, ([], [], [])
                parts[columns[3][s]].append(rows[s:e])
        if last and parts[0]:
            yield compare(last, parts)

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words_per_shingle: int = 5, seed: int = 42, width: int = 4, tile: int = 1024
) -> DataFrame:
    """(node, root) for every id that is linked to another; root is the smallest id reachable by links.

    Two rows link if the Jaccard similarity of their sets of word shingles is at least ``least``. SimHash fingerprints of 64 x
    ``width`` bits choose the pairs: texts that share the key of a band are compared bit-sliced, within a radius three standard
    deviations above the mean distance at ``least``, and the exact similarity decides. No link is wrong; a link is missed only if no band or
    the radius holds its pair.

    Pairs are verified in rounds. First a bucket yields one spanning forest of its close pairs, closest first. Then texts that had a close
    pair (all texts of buckets of over ``tile``) are compared again, but only where the links found so far leave them in different groups:
    each text outside a bucket's largest group with all others, in tiles. A bucket yields one forest of pairs that it hasn't tried,
    then four, sixteen and so on, until no bucket has an untried close pair between two groups; a bucket without one is done for good. So a group costs about as many
    verifications as it has texts, plus those of the pairs that fail. Rounds read only the texts that can be in a pair, and verdicts of all rounds are one table,
    so neither the driver's plans nor its tasks grow with the rounds.

    Rows with a null id and texts without words have no links; rows that share an id are one node.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), body(F.col(text_col)).alias("t")).where(F.col("id").isNotNull())
    names = [f"f{k}" for k in range(width)]

    def sketch(batches):
        for batch in slices(batches):
            fps = [wide_fingerprint(t, words_per_shingle, seed, width) for t in batch.column(1).to_pylist()]
            at = [k for k, f in enumerate(fps) if f]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([fps[k][w] for k in at], pa.int64()) for w in range(width))], names=["id", *names])

    fps = materialise(texts.mapInArrow(sketch, "id long, " + ", ".join(f"{n} long" for n in names)), "sketches")
    reps = materialise(fps.groupBy(*names).agg(F.min("id").alias("rep")).select("rep", *names), "reps")
    copies = fps.join(reps, names).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    bits = 64 * width
    bands = choose_bands(reps.count(), least, bits, seed)
    mean = differing_share(least)
    spread = math.sqrt(bits * mean * (1 - mean))
    radii = [round(bits * differing_share((1 + least) / 2)), *(round(bits * mean + k * spread) for k in (0, 1.5, 3))]

    def verified(pairs: DataFrame) -> DataFrame:
        one = asked.select(F.col("id").alias("b"), F.col("t").alias("tb"))
        two = asked.select(F.col("id").alias("a"), F.col("t").alias("ta"))
        met = pairs.distinct().join(one, "b").join(two, "a").select("a", "ta", "b", "tb")
        found = met.mapInArrow(_jaccard(least, words_per_shingle, seed), "a long, b long, alike boolean")
        return materialise(found.groupBy("a", "b").agg(F.max("alike").alias("alike")), "verified")  # rows that share an id: any

    keyed = reps.mapInArrow(_band_keys(bands), "key long, rep long, " + ", ".join(f"{n} long" for n in names))
    crowded = materialise(keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1"), "tiles")
    tiled = keyed.join(crowded, "key", "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("tiles")), F.lit(0)).cast("int"))
    grouped = tiled.select("key", "tile", "rep", *names).repartition("key", "tile").sortWithinPartitions("key", "tile", "rep")
    first = materialise(grouped.mapInArrow(_link_blocks(radii, 128, 2), "a long, b long").distinct(), "first")
    close = first.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    again = keyed.join(crowded.select("key", F.lit(True).alias("crowd")), "key", "left").join(close.withColumn("close", F.lit(True)), "rep", "left")
    again = materialise(again.where("crowd or close").select("key", "rep", *names), "again")
    ids = again.select(F.col("rep").alias("id")).unionByName(copies.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    asked = materialise(texts.join(ids, "id", "left_semi"), "asked")
    tried, fallen = new_path(docs.sparkSession, "tried"), new_path(docs.sparkSession, "fallen")
    verdicts = appended(verified(first.unionByName(copies)), tried)
    failed = None
    count = 1
    roots = connected_components(verdicts.where("alike").select("a", "b"), "a", "b")
    while True:
        rows = again.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        rows = materialise(rows.select("key", "rep", "root", *names), "rooted")
        groups = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
            F.max_by("root", "n").alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")
        ).where("most < n")
        groups = groups.select("key", "main", F.ceil((F.col("n") - F.col("most")) / tile).alias("lefts"), F.ceil(F.col("n") / tile).alias("rights"))
        groups = materialise(groups, "groups")

        def at(rep: str, of: str):
            return F.pmod(F.xxhash64(F.lit(7), rep), F.col(of))

        def every(of: str):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

        live = rows.join(groups, "key")
        sides = [
            live.where("root != main").withColumn("i", at("rep", "lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(0)),
            live.withColumn("j", at("rep", "rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(1)),
        ]
        wanted = ["key", "i", "j", "side", F.col("rep").alias("a"), F.col("root").alias("b"), *names]
        input_rows = sides[0].select(*wanted).unionByName(sides[1].select(*wanted))
        if failed is not None:
            pairs = failed.join(groups, "key").withColumn("side", F.lit(2)).withColumns({n: F.lit(0).cast("long") for n in names})
            for x, y in (("a", "b"), ("b", "a")):
                input_rows = input_rows.unionByName(pairs.withColumn("i", at(x, "lefts")).withColumn("j", at(y, "rights")).select("key", "i", "j", "side", "a", "b", *names))
        input_rows = input_rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "a")
        found = materialise(input_rows.mapInArrow(_proposals(radii, count, _band_masks(bands, bits)), "key long, a long, b long"), "proposals")
        if not found.take(1):
            return roots
        new = verified(found.select("a", "b").join(verdicts, ["a", "b"], "left_anti"))
        verdicts = appended(new, tried)
        joined = materialise(new.where("alike").select("a", "b"), "joined")
        if joined.take(1):  # groups join groups: only these are worked out anew
            for side in "ab":
                of = roots.select(F.col("node").alias(side), F.col("root").alias("of"))
                joined = joined.join(of, side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
            moved = connected_components(joined, "a", "b").select(F.col("node").alias("old"), F.col("root").alias("new"))
            kept = roots.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
            roots = materialise(kept.unionByName(moved.select(F.col("old").alias("node"), F.col("new").alias("root"))), "roots")
        gone = found.join(verdicts.where("not alike").select("a", "b"), ["a", "b"]).select("key", "a", "b")
        failed = appended(gone, fallen)
        again = materialise(again.join(found.select("key").distinct(), "key", "left_semi"), "again")  # groups only grow, so the others are done
        count *= 4
