"""Suffix-array dedup: removes every byte that a repeated string of ``length`` bytes covers, and finds passages of words that
other documents repeat.

A text is read in two units: its bytes, and its words (as 64-bit hashes). Every window of a unit's length is assigned to its anchor,
the gram of least hash in it, so equal windows have equal anchors at equal places. Consecutive windows of one anchor form a context
of under 2 x length symbols. Anchors that occur once are dropped. Contexts of one anchor with equal digests (64 bits of BLAKE2b) are
taken for equal and repeat in whole; of the others, the distinct contexts of an anchor are compared by a hash-compared
suffix sort: prefix polynomial hashes and binary search find how far two contexts agree to the right and to the left of
the anchor, a mergesort orders them with that comparison, and neighbours in both orders give the longest extensions, which
are verified symbol by symbol.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, materialise, partitions, slices

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
POSITION = np.uint64(0xFFFFFF)
_powers: dict = {}
_words: dict = {}


@dataclass(frozen=True)
class Unit:
    """What a text's symbols are, how long a repeated string is, and how long an anchor. ``apart``: a repeat within its own document
    does not count."""

    name: str
    length: int
    gram: int
    apart: bool

    @property
    def kind(self) -> type:
        return np.uint8 if self.name == "bytes" else np.uint64

    def symbols(self, data: bytes) -> np.ndarray:
        if self.name == "bytes":
            return np.frombuffer(data, np.uint8)
        words = data.split()  # bytes: split() knows ASCII white space only
        found = list(map(_words.get, words))
        if None in found:
            if len(_words) > 200_000:
                _words.clear()
            found = [_words.setdefault(w, xxhash.xxh64_intdigest(w)) if f is None else f for w, f in zip(words, found)]
        return np.array(found, np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """g with g[j] - g[i] = the polynomial hash of data[i:j] times BASE**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def contexts(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(part, first window, windows, anchor, key) of every context of the parts of a buffer that end at ``ends``."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    g = prefix_hashes(data)
    key = mixed((g[gram:] - g[: n - gram + 1]) * powers(INVERSE, n - gram + 1))
    ranked = (key & ~POSITION) | np.arange(len(key), dtype=np.uint64)  # ties: the leftmost
    anchor = (least_of(ranked, length - gram + 1) & POSITION).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    part = np.repeat(np.arange(len(ends)), ends - starts)[: n - length + 1]
    window = np.flatnonzero(ends[part] - np.arange(n - length + 1) >= length)
    if not len(window):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    anchor, part = anchor[window], part[window]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
    count = np.diff(np.concatenate([first, [len(window)]]))
    return part[first], window[first], count, anchor[first], key[anchor[first]]


def _contexts_of(units: list[Unit], buffer_symbols: int = 1 << 19):
    names = ["unit", "key", "ctx", "doc", "th", "at", "back", "wins"]

    def rows(number, unit, parts):
        """parts: (doc, th, offset in its text, symbols)"""
        buffer = np.concatenate([p[3] for p in parts])
        size = np.array([len(p[3]) for p in parts])
        part, window, count, anchor, key = contexts(buffer, np.cumsum(size), unit.length, unit.gram)
        digest = [hashlib.blake2b(buffer[i : i + c + unit.length - 1].tobytes(), digest_size=8).digest() for i, c in zip(window.tolist(), count.tolist())]
        at = window - (np.cumsum(size) - size)[part] + np.array([p[2] for p in parts], np.int64)[part]
        doc = pa.array([parts[k][0] for k in part.tolist()], pa.int64())
        th = np.array([p[1] for p in parts], np.int64)[part]
        columns = [
            np.full(len(part), number, np.int32), key.view(np.int64), np.frombuffer(b"".join(digest), np.int64), doc, th, at,
            (anchor - window).astype(np.int32), count.astype(np.int32)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches):
        for batch in slices(batches):
            texts = [(d, t, x.encode("utf-8", "surrogatepass")) for d, t, x in zip(*(c.to_pylist() for c in batch.columns))]
            for number, unit in enumerate(units):
                held, size = [], 0
                for doc, th, data in texts:
                    symbols = unit.symbols(data)
                    for at in range(0, len(symbols) - unit.length + 1, buffer_symbols):  # long texts in parts that share length - 1 symbols
                        piece = symbols[at : at + buffer_symbols + unit.length - 1]
                        held.append((doc, th, at, piece))
                        size += len(piece)
                        if size >= buffer_symbols:
                            yield rows(number, unit, held)
                            held, size = [], 0
                if held:
                    yield rows(number, unit, held)

    return run


class Suffixes:
    """Contexts of several anchors in one buffer, compared from their anchors to the right and to the left."""

    def __init__(self, chunks: list[bytes], back: np.ndarray, kind: type = np.uint8):
        self.data = np.frombuffer(b"".join(chunks), kind)
        size = np.array([len(c) // self.data.itemsize for c in chunks], np.int64)
        self.start = np.cumsum(size) - size
        self.anchor = self.start + back
        self.right, self.left = size - back, back.astype(np.int64)
        self.g = prefix_hashes(self.data)
        self.p = powers(BASE, len(self.data) + 1)

    def extent(self, x: np.ndarray, y: np.ndarray, left: bool) -> np.ndarray:
        """How many symbols contexts x and y share from their anchors on, by binary search over hashes."""
        a, b = self.anchor[x], self.anchor[y]
        high = np.minimum(self.left[x], self.left[y]) if left else np.minimum(self.right[x], self.right[y])
        low = np.zeros_like(high)
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            p, q = (a - mid, b - mid) if left else (a, b)
            same = (self.g[p + mid] - self.g[p]) * self.p[q] == (self.g[q + mid] - self.g[q]) * self.p[p]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, left: bool) -> np.ndarray:
        """Whether context x sorts before y; equal ones sort by their number."""
        shared = self.extent(x, y, left)
        size = self.left if left else self.right
        at = (lambda k: self.anchor[k] - shared - 1) if left else (lambda k: self.anchor[k] + shared)
        symbol = lambda k: self.data[np.clip(at(k), 0, len(self.data) - 1)]
        more_x, more_y, sx, sy = shared < size[x], shared < size[y], symbol(x), symbol(y)
        differ = more_x & more_y & (sx != sy)
        return np.where(differ, sx < sy, np.where(more_x != more_y, more_y, x < y))

    def order(self, low: np.ndarray, high: np.ndarray, left: bool) -> np.ndarray:
        """The contexts in suffix order within their groups [low, high), by a mergesort of all groups at once.

        In each pass, an element's place in the merged run is its place in its own run plus the number of elements of the other
        run that sort before it, which a binary search finds.
        """
        order, here, width = np.arange(len(low)), np.arange(len(low)), 1
        while width < (high - low).max(initial=0):
            run = (here - low) // width
            first = np.minimum(low + (run ^ 1) * width, high)
            a, b = first.copy(), np.minimum(first + width, high)
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                less = self.before(order[mid], order[open_], left)
                a[open_] = np.where(less, mid + 1, a[open_])
                b[open_] = np.where(less, b[open_], mid)
            merged = np.empty_like(order)
            merged[low + (run // 2) * 2 * width + (here - low - run * width) + (a - first)] = order
            order, width = merged, width * 2
        return order

    def neighbours(self, low: np.ndarray, high: np.ndarray, left: bool, owner: np.ndarray):
        """For each context, the neighbour in suffix order of another owner that shares most, how much, and the order with its extents."""
        order = self.order(low, high, left)
        n = len(order)
        group, own = low[order], owner[order]
        inner = np.flatnonzero(group[1:] == group[:-1])
        step = np.full(n + 1, -1, np.int64)  # step[i]: shared by order[i - 1] and order[i]
        step[inner + 1] = self.extent(order[inner], order[inner + 1], left)
        change = np.concatenate([[True], (group[1:] != group[:-1]) | (own[1:] != own[:-1])])
        run = np.cumsum(change)
        deep = int(step.max(initial=0)) + 2
        least = lambda v, r: np.minimum.accumulate(v - r * deep) + r * deep  # the minimum since a run began
        to_before = least(step[:-1], run)
        to_after = least(step[1:][::-1], (run[-1] - run)[::-1])[::-1] if n else step[1:]
        start = np.flatnonzero(change)
        before, after = start[run - 1] - 1, np.append(start[1:], n)[run - 1]
        take_after = to_after > to_before
        other = order[np.clip(np.where(take_after, after, before), 0, n - 1)]
        best, much = np.empty(n, np.int64), np.empty(n, np.int64)
        best[order], much[order] = other, np.maximum(to_after, to_before)
        return best, much, order, step


def repeated_windows(
    chunks: list[bytes], back: np.ndarray, wins: np.ndarray, group: np.ndarray, ask: np.ndarray, length: int, kind: type = np.uint8,
    owner: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """(context, first, last): windows (numbered from the context's start) that a context of its group and another owner holds too.

    ``group`` is sorted; without ``owner`` every context is its own. A window that starts d symbols left of the anchor repeats where
    another context shares d symbols to the left and length - d to the right.
    """
    owner = np.arange(len(group)) if owner is None else owner
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    low, high = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    s = Suffixes(chunks, back, kind)
    y, most_right, order, step = s.neighbours(low, high, False, owner)
    z, most_left, _, _ = s.neighbours(low, high, True, owner)
    d_low, d_high = np.maximum(back - wins + 1, length - most_right), np.minimum(back, most_left)
    open_ = np.flatnonzero(ask & (high - low > 1) & (d_low <= d_high))
    if not len(open_):
        return []
    left_of_y, right_of_z = s.extent(open_, y[open_], True), s.extent(open_, z[open_], False)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = []

    def add(x, other, a, b):
        """Windows d = a..b, after verifying the symbols."""
        i, j = int(s.anchor[x]) - b, int(s.anchor[other]) - b
        if not np.array_equal(s.data[i : i + b - a + length], s.data[j : j + b - a + length]):
            raise ArithmeticError("two different strings have one hash; choose another BASE")
        out.append((int(x), int(back[x]) - b, int(back[x]) - a))

    for x, ly, rz in zip(open_.tolist(), left_of_y.tolist(), right_of_z.tolist()):
        a, b = int(d_low[x]), int(d_high[x])
        to_y, from_z = min(b, ly), max(a, length - rz)
        if to_y >= a:
            add(x, y[x], a, to_y)
        if from_z <= b and to_y < b:
            add(x, z[x], max(from_z, a), b)
        if max(to_y, a - 1) >= from_z - 1 or to_y >= b:
            continue
        # neither neighbour decides: look at all contexts that share enough to the right
        lo, hi, at = int(low[x]), int(high[x]), int(place[x])
        shared = np.concatenate([np.minimum.accumulate(step[at:lo:-1])[::-1], np.minimum.accumulate(step[at + 1 : hi])])
        others = np.concatenate([order[lo:at], order[at + 1 : hi]])
        near = (shared >= length - b) & (owner[others] != owner[x])
        others, shared = others[near], shared[near]
        lefts = s.extent(np.full(len(others), x), others, True)
        best: dict = {}
        for o, r, le in zip(others.tolist(), shared.tolist(), lefts.tolist()):
            u, v = max(a, length - r), min(b, le)
            if u <= v and best.get(u, (-1,))[0] < v:
                best[u] = (v, o)
        reach = -1
        for u in sorted(best):
            if best[u][0] > reach:
                reach = best[u][0]
                add(x, best[u][1], u, reach)
    return out


def _resolve(units: list[Unit], batch_bytes: int = 1 << 21):
    names = ["unit", "doc", "th", "s", "e"]

    def decide(unit, rows):
        """rows: (group, ask, doc, th, at, back, wins, chunk)"""
        group, ask, doc, th, at, back, wins, chunks = zip(*rows)
        owner = None
        if units[unit].apart:
            codes: dict = {}
            owner = np.array([codes.setdefault(d, len(codes)) for d in zip(doc, th)])
        length = units[unit].length
        found = repeated_windows(
            list(chunks), np.array(back, np.int64), np.array(wins, np.int64), np.array(group), np.array(ask, bool), length, units[unit].kind, owner
        )
        out = list(zip(*[(unit, doc[x], th[x], at[x] + i, at[x] + j + length) for x, i, j in found])) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int32()] + [pa.int64()] * 4)], names=names)

    def run(batches):
        held, size, last, number = [], 0, None, 0
        for batch in slices(batches, 2000):
            for unit, key, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (unit, key, low, high) != last:
                    if held and (size >= batch_bytes or last[0] != unit):
                        yield decide(last[0], held)
                        held, size = [], 0
                    last, number = (unit, key, low, high), number + 1
                held.append((number, *row))
                size += len(row[-1])
        if held:
            yield decide(last[0], held)

    return run


def _chunks_of(units: list[Unit]):
    names = ["unit", "key", "ask", "tiles", "doc", "th", "at", "back", "wins", "chunk"]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in slices(batches, 200):
            out = []
            for doc, th, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                data, symbols = text.encode("utf-8", "surrogatepass"), {}
                for q in asked:
                    u = q["unit"]
                    if u not in symbols:
                        symbols[u] = units[u].symbols(data)
                    chunk = symbols[u][q["at"] : q["at"] + q["wins"] + units[u].length - 1].tobytes()
                    out.append((u, q["key"], q["ask"], q["tiles"], doc, th, q["at"], q["back"], q["wins"], chunk))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names=names)

    return run


def _merged(spans: list) -> list[list[int]]:
    """The maximal runs that the spans cover."""
    runs: list = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def repeated_spans(docs: DataFrame, units: list[Unit], id_col: str = "doc_id", text_col: str = "text", tile: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has (doc, th, text) rows; spans (unit, doc, th, s, e), symbols that repeated strings cover.

    A row is known by its id and the hash of its text (th), so null and repeated ids do no harm. An anchor with more than ``tile``
    distinct contexts is cut into tiles, and each pair of tiles is a group of its own. Many rows can hold one context: those with
    more rows than a quarter of a partition's share (at most 4 x partitions of them, which bounds the broadcast) are salted by their count.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(body(F.col(text_col))).alias("th"), body(F.col(text_col)).alias("text"))
    apart = F.element_at(F.array(*[F.lit(u.apart) for u in units]), F.col("unit") + 1)
    length = F.element_at(F.array(*[F.lit(u.length) for u in units]), F.col("unit") + 1)
    # a text of fewer bytes than any window can hold no repeat
    found = texts.where(F.octet_length("text") >= min(u.length if u.name == "bytes" else 2 * u.length - 1 for u in units))
    found = materialise(found.mapInArrow(_contexts_of(units), "unit int, key long, ctx long, doc long, th long, at long, back int, wins int"), "contexts")
    who = F.xxhash64("doc", "th")
    several = (F.min(who) != F.max(who)).alias("several")  # documents
    keys = found.groupBy("unit", "key").agg(F.count("*").alias("n"), (F.min("ctx") == F.max("ctx")).alias("alike"), several)
    keys = keys.where((F.col("n") > 1) & (F.col("several") | ~apart)).select("unit", "key", "alike")
    keys = materialise(keys, "keys")  # so that the join shuffles both sides, and adaptive execution can split a hot key
    again = materialise(found.join(keys, ["unit", "key"]), "repeated")
    whole = lambda rows: rows.select("unit", "doc", "th", F.col("at").alias("s"), (F.col("at") + F.col("wins") + length - 1).alias("e"))
    other = again.where(~F.col("alike"))

    # per context: whether it repeats in whole, which its rows then do
    distinct = other.groupBy("unit", "key", "ctx").agg(F.count("*").alias("n"), several, F.min(F.struct("doc", "th", "at", "back", "wins")).alias("one"))
    distinct = materialise(distinct.withColumn("full", F.when(apart, F.col("several")).otherwise(F.col("n") > 1)), "distinct")
    threshold = max(64, other.count() // (4 * partitions(spark)))
    salts = F.ceil(F.col("n") / threshold).cast("int")
    hot = F.broadcast(distinct.where(F.col("n") > threshold).select("unit", "key", "ctx", salts.alias("salts")))
    salted = distinct.select("unit", "key", "ctx", "full", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    spread = other.join(hot, ["unit", "key", "ctx"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("doc", "th", "at"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    spread = materialise(spread.join(salted, ["unit", "key", "ctx", "salt"]).select("full", "unit", "key", "doc", "th", "at", "back", "wins"), "spread")

    # the others are compared: all their rows ask, against one row of each context that repeats in whole
    tiles = materialise(
        distinct.groupBy("unit", "key").agg(F.ceil(F.sum(F.when(F.col("full"), 1).otherwise(F.col("n"))) / tile).cast("int").alias("tiles")), "tiles"
    )
    ask = spread.where(~F.col("full")).select("unit", "key", F.lit(True).alias("ask"), "doc", "th", "at", "back", "wins")
    held = distinct.where("full").select("unit", "key", F.lit(False).alias("ask"), "one.*")
    asked = ask.unionByName(held).join(tiles, ["unit", "key"]).groupBy("doc", "th").agg(
        F.collect_list(F.struct("unit", "key", "ask", "tiles", "at", "back", "wins")).alias("asked")
    )
    chunks = texts.join(
        asked.select(F.col("doc").alias("asked_doc"), F.col("th").alias("asked_th"), "asked"),
        F.col("doc").eqNullSafe(F.col("asked_doc")) & (F.col("th") == F.col("asked_th"))
    )
    chunks = chunks.select("doc", "th", "text", "asked").mapInArrow(
        _chunks_of(units), "unit int, key long, ask boolean, tiles int, doc long, th long, at long, back int, wins int, chunk binary"
    )
    chunks = (
        chunks.withColumn("mine", F.pmod(F.xxhash64("doc", "th", "at"), F.col("tiles")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "unit", "key", F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"), "ask", "doc", "th", "at", "back", "wins", "chunk"
        )
    )
    group = ["unit", "key", "low", "high"]
    parts = chunks.repartition(*group).sortWithinPartitions(*group).mapInArrow(_resolve(units), "unit int, doc long, th long, s long, e long")
    return texts, whole(again.where("alike")).unionByName(whole(spread.where("full"))).unionByName(parts)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100, passage: int = 50, with_text: bool = False, **settings
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words) of every row, and ``kept`` bytes with ``with_text``.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in any row, judged on the input. A passage is
    a maximal run of words that strings of ``passage`` words cover which other documents hold too (any white space between the words);
    it is reported, not removed. Null texts count as empty; shorter rows lose nothing; a repeated row repeats all of itself, but is
    no other document; an empty table gives an empty result; other columns are not read.
    """
    units = [Unit("bytes", length, gram, False), Unit("words", passage, max(1, passage // 4), True)]
    texts, spans = repeated_spans(docs, units, id_col, text_col, **settings)
    per_doc = spans.groupBy("doc", "th").agg(F.collect_set(F.struct("unit", "s", "e")).alias("spans")).select(
        F.col("doc").alias("span_doc"), F.col("th").alias("span_th"), "spans"
    )
    rows = texts.join(per_doc, F.col("doc").eqNullSafe(F.col("span_doc")) & (F.col("th") == F.col("span_th")), "left").select("doc", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"] + ["kept"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.binary()] * with_text

    def run(batches):
        for batch in slices(batches):
            out = []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass")
                runs, passages = (_merged([(x["s"], x["e"]) for x in found or () if x["unit"] == u]) for u in (0, 1))
                kept = b"".join([data[s:e] for s, e in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)])])
                row = (doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(passages), sum(e - s for s, e in passages))
                out.append((*row, kept) if with_text else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long"
    return rows.mapInArrow(run, schema + ", kept binary" * with_text)
