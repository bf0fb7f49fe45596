"""Packing by cutting-stock column generation.

A document's ids are cut at every ``capacity``-th; full pieces are sequences of their own. The rest go by length class
into a histogram, whose linear program over patterns is solved by column generation: the dual prices of the
classes enter a knapsack dynamic program, which finds the next pattern. Rounded-down patterns take documents by
their rank in the class; the few that are left go into patterns that fill a sequence best. Only the histogram, at most one count
for each class, reaches the driver.
"""

from __future__ import annotations

import importlib
import json
import struct
import warnings
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialise, slices

#: How word_bpe_49k.json prepares a text, which the shortcut relies on.
CHUNK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": CHUNK_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
CHUNK = regex.compile(CHUNK_PATTERN)
LATIN, LAST = regex.compile("[\x21-\x7e\xa1-ɏ]+"), "ɏ"


class WordCoder:
    """The ids of a text as little-endian 32-bit integers.

    A tokenizer that prepares texts as word_bpe_49k.json does never joins across white space: ids are then kept for words and for the
    chunks in them (a chunk is a word too), so the tokenizer runs once for each new chunk. Texts in which white space or special strings could mean
    something else than to str.split(), and all texts for other tokenizers, go to the tokenizer whole. What is kept
    is bounded by ``most_bytes``; frequent words come early, so the first ones are kept until ``forget``.
    """

    def __init__(self, path: str, most_bytes: int = 96 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        self.by_word = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER and made["model"]["type"] == "BPE" and all(
            t["content"].startswith("<|") for t in made["added_tokens"]
        )
        self.most_bytes, self.held_bytes = most_bytes, 0
        self.words: dict = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level vocabularies
        other = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}

    def forget(self) -> None:
        self.words, self.held_bytes = {}, 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        """The ids of a piece of a lower-case word that the tokenizer does not split before its merges."""
        got = self.words.get(chunk)
        if got is None:
            spelled = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(spelled)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            self.keep(chunk, got)
        return got

    def keep(self, word: str, ids: bytes) -> None:
        if self.held_bytes < self.most_bytes:
            self.held_bytes += len(word) + len(ids) + 200  # and the objects around them
            self.words[word] = ids

    def word(self, word: str) -> bytes:
        low = word.lower()
        if low.isalpha() and (low.isascii() or max(low) <= LAST and max(word) <= LAST):  # no combining mark is below LAST, so it is NFC
            got = self.chunk(low)
            if low == word:
                return got
        elif low.isascii() and low.isprintable() or LATIN.fullmatch(low) and LATIN.fullmatch(word):
            if low[-1] in ".," and low[:-1].isalpha():
                got = self.chunk(low[:-1]) + self.chunk(low[-1])
            else:
                got = b"".join([self.chunk(c) for c in CHUNK.findall(low)])
        else:
            got = self.whole(word)
        self.keep(word, got)
        return got

    def encode(self, text: str) -> bytes:
        if not self.by_word or "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.whole(text)
        words = text.split()
        got = list(map(self.words.get, words))
        if None in got:
            word = self.word
            got = [word(w) if g is None else g for w, g in zip(words, got)]
        return b"".join(got)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def cut(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, quantum: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, class, part, k): the pieces of every document's ids, of which each task numbers
    those of a length class."""

    def run(batches):
        code, part, seen = coder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = code.encode(text) + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    length = min(capacity, n - s)
                    c = -(-length // quantum)
                    rows.append((key, s, length, zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n, c, part, seen.get(c, 0)))
                    seen[c] = seen.get(c, 0) + 1
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "k"]
            )
        code.forget()  # the worker process outlives the task

    rows = docs.select(F.col(id_col).cast("long").alias("id"), body(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, part long, k long")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack with repetition: counts of the sizes within the capacity of the highest total price."""
    useful = np.flatnonzero(prices > 1e-12)
    counts = np.zeros(len(sizes))
    if not len(useful):
        return 0.0, counts
    s, p = sizes[useful], prices[useful]
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(s, room, "right")  # sizes are sorted
        value[room] = value[room - 1]
        if fits:
            worth = value[room - s[:fits]] + p[:fits]
            k = int(worth.argmax())
            if worth[k] > value[room] + 1e-15:
                value[room], choice[room] = worth[k], k
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[useful[choice[room]]] += 1
            room -= int(s[choice[room]])
    return float(value[capacity]), counts


def column_generation(sizes: list[int], needs: list[int], capacity: int, pool: list[dict], gap: float = 1e-3, most_rounds: int = 20_000) -> tuple[list[tuple[dict, float]], float]:
    """Patterns and how often each is used, of a linear program that covers ``needs`` pieces of ``sizes``, and a lower bound of the number
    of sequences.

    A revised simplex method from one pattern for each size. A size with a negative price (a surplus column) and the patterns known so
    far, at first those of ``pool``, compete by what they save; where none saves anything, the knapsack prices a new pattern, at
    prices smoothed by the best ones so far, or at the plain ones if that finds none. Prices divided by the dearest pattern's
    price bound the number of sequences, as does the total length; the method stops within ``gap`` of the higher bound, or at the optimum. A
    warning is given if it stops at ``most_rounds``.
    """
    order = np.argsort(sizes)
    s, n = np.asarray(sizes)[order], np.asarray(needs, float)[order]
    place = {int(v): k for k, v in enumerate(s)}
    known = np.zeros((len(s), len(pool)))
    for j, pattern in enumerate(pool):
        known[[place[v] for v in pattern], j] = list(pattern.values())
    start = capacity // s
    basis, cost = np.diag(start.astype(float)), np.ones(len(s))
    inverse, x = np.diag(1.0 / start), n / start
    bound, best, best_bound = float((s * n).sum() / capacity), None, 0.0
    for _ in range(most_rounds):
        prices = cost @ inverse
        low, worth = int(prices.argmin()), prices @ known
        fit = int(worth.argmax()) if len(worth) else -1
        saved = worth[fit] - 1 if len(worth) else 0.0
        if -prices[low] > max(1e-7, saved):
            column, price = np.zeros(len(s)), 0.0
            column[low] = -1
        elif saved > 1e-7:
            column, price = known[:, fit], 1.0
        else:
            if float(cost @ x) <= bound * (1 + gap):
                break
            plain, price = np.maximum(prices, 0), 1.0
            for smooth in ([] if best is None else [0.7 * best + 0.3 * plain]) + [plain]:
                value, column = best_pattern(s, smooth, capacity)
                reached = float(n @ smooth) / max(value, 1e-9)
                if reached > best_bound:
                    best, best_bound = smooth / max(value, 1e-9), reached
                if prices @ column > 1 + 1e-7:
                    break
            else:
                bound = max(bound, best_bound)
                break  # no pattern saves anything
            bound, known = max(bound, best_bound), np.column_stack([known, column])
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        x = np.maximum(x - step * direction, 0)
        x[out], basis[:, out], cost[out] = step, column, price
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    else:
        warnings.warn(f"the linear program stopped after {most_rounds} rounds at {cost @ x:.1f} sequences, {bound:.1f} at least", stacklevel=2)
    return [({int(s[k]): int(basis[k, j]) for k in np.flatnonzero(basis[:, j])}, float(x[j])) for j in range(len(s)) if cost[j]], bound


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The pattern of the longest piece and the others that fill its rest best."""
    first = max(left)
    taken = {first: 1}
    room, sums, trail = capacity - first, 1, []
    for s in sorted(left, reverse=True):
        for _ in range(min(left[s] - taken.get(s, 0), room // s)):
            trail.append((s, sums))  # sums: bit r is set if the pieces so far can add up to r
            sums |= sums << s & (1 << room + 1) - 1
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    for s, before in reversed(trail):
        if not before >> at & 1:
            taken[s] = taken.get(s, 0) + 1
            at -= s
    return taken


def fill(needs: dict[int, int], capacity: int) -> list[tuple[dict, int]]:
    """(pattern, times) of fullest patterns, each used as often as its pieces last."""
    left, out = {s: c for s, c in needs.items() if c}, []
    while left:
        pattern = fullest(left, capacity)
        times = min(left[s] // c for s, c in pattern.items())
        out.append((pattern, times))
        for s, c in pattern.items():
            left[s] -= times * c
            if not left[s]:
                del left[s]
    return out


def plan(needs: dict[int, int], capacity: int) -> list[tuple[dict, int]]:
    """(pattern, times) that cut exactly ``needs``: the program's patterns rounded down and ``fill`` for what is left, or ``fill`` alone
    where that takes fewer sequences."""
    if not needs:
        return []
    plain = fill(needs, capacity)
    used, left = [], dict(needs)
    patterns, _ = column_generation(list(needs), list(needs.values()), capacity, [p for p, _ in plain])
    for pattern, times in sorted(patterns, key=lambda p: -p[1]):
        times = min([int(times + 1e-6), *(left[s] // c for s, c in pattern.items())])
        if times:
            used.append((pattern, times))
            for s, c in pattern.items():
                left[s] -= times * c
    return min(used + fill(left, capacity), plain, key=lambda found: sum(times for _, times in found))


def slots_of(counts: dict[int, int], whole: int) -> dict[str, np.ndarray]:
    """Ranges of ranks in a class, sorted by class and rank: each range goes to one place (``slot``) of one pattern's sequences, of which
    ``base`` is the first; a sequence takes ``each`` pieces of it."""
    patterns = ([({whole: 1}, counts[whole])] if counts.get(whole) else []) + plan({c: n for c, n in counts.items() if c != whole}, whole)
    rows, given, base = [], dict.fromkeys(counts, 0), 0
    for pattern, times in patterns:
        slot = 0
        for c, each in sorted(pattern.items(), reverse=True):
            rows.append((c, given[c], each, base, slot))
            given[c] += each * times
            slot += each
        base += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("class", "low", "each", "base", "slot"), columns))


def _place(shared):
    def run(batches):
        slots = shared.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            kind, rank = (columns[c].to_numpy(zero_copy_only=False) for c in ("class", "rank"))
            at = np.searchsorted((slots["class"] << 44) + slots["low"], (kind << 44) + rank, "right") - 1
            turn, each = rank - slots["low"][at], slots["each"][at]
            sequence, place = slots["base"][at] + turn // each, slots["slot"][at] + turn % each
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in names), pa.array(sequence), pa.array(place)], names=[*names, "sequence_id", "at"])

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, quantum: int = 8
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row.

    Null texts count as empty: one piece that holds ``end_id``. Repeated rows and rows with a null id are packed like any
    other; an empty table gives an empty result; other columns are not read. Lengths are rounded up to ``quantum`` to form
    classes, so a sequence loses at most ``quantum - 1`` tokens for each piece in it.

    A piece's rank in its class is its number within the task that cut it plus the counts of the tasks before, so no class is
    sorted, and none meets in one task.
    """
    spark = docs.sparkSession
    pieces = materialise(cut(docs, id_col, text_col, tokenizer or tokenizer_path(), capacity, end_id, quantum), "pieces")
    per_task = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(per_task.select("class", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    counts = {r["class"]: r["n"] for r in offsets.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots_of(counts, capacity // quantum))
    ranked = pieces.join(offsets.drop("n"), ["class", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank")
    placed = placed.mapInArrow(_place(shared), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, at long")
    in_sequence = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
