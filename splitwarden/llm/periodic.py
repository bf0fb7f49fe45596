"""Periodic runs of words by the runs theorem.

Every maximal repetition has a Lyndon root that is the longest Lyndon word at its place under the order of the words or
under the opposite order. Longest Lyndon words end at the next smaller value of the inverse suffix array (the next greater
one for the opposite order). Each is extended by the common extension of its start and its end, to the right in the text
and to the left in the reversed text: range minima over the LCP array, from a sparse table.

Documents are put one after another, in chunks of similar length, and numpy works on a chunk at a time; suffixes are ranked
within their documents only, so nothing crosses a border.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, body, slices

#: Words of the documents of a chunk; a longer document is a chunk of its own.
CHUNK_WORDS = 1 << 17

SCHEMA = (
    "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "n_words long, n_dropped long"
)
_word = re.compile(WORD)


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a document after the change that its id asks for: from word a on, one in ten repeats p words over and over."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def suffix_ranks(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ: by document, then by words; a suffix that ends is the
    smaller. ``ends`` is the end of each position's document.

    Only suffixes that still share a rank are sorted again. A rank is the number of suffixes that are smaller.
    """
    n = len(codes)
    key = doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    levels = [rank]
    open_ = order[np.repeat(sizes > 1, sizes)]  # in the order of their ranks
    width = 1
    while len(open_):
        after = open_ + width
        second = np.where(after < ends[open_], rank[np.minimum(after, n - 1)], -1)
        first = rank[open_]
        turn = np.argsort(first * (n + 1) + second + 1, kind="stable")
        first, second, open_ = first[turn], second[turn], open_[turn]
        at = np.arange(len(open_))
        group = np.r_[True, np.diff(first) != 0]
        head = group | np.r_[True, np.diff(second) != 0]
        starts = np.flatnonzero(head)
        inside = at[starts] - np.maximum.accumulate(np.where(group, at, 0))[starts]  # place of a subgroup in its group
        sizes = np.diff(np.r_[starts, len(open_)])
        rank = rank.copy()
        rank[open_] = np.repeat(first[starts] + inside, sizes)
        levels.append(rank)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        width *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """The LCP array: for each rank, the words that its suffix shares with the suffix before it (0 at a document's first)."""
    rank = levels[-1]
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    same = np.flatnonzero(ends[a] == ends[b])
    a, b, a_end, b_end = a[same], b[same], ends[a[same]], ends[b[same]]
    began = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        equal = (a < a_end) & (b < b_end)
        equal[equal] = levels[k][a[equal]] == levels[k][b[equal]]
        a += equal << k
        b += equal << k
    lcp[1:][same] = a - began
    return lcp


def sparse_table(values: np.ndarray, reach: int, pick=np.minimum) -> list[np.ndarray]:
    """Level k holds ``pick`` over 2^k values from each place on, for ranges of up to ``reach`` values."""
    table = [values]
    while 2 << len(table) - 1 <= reach:
        half, last = 1 << len(table) - 1, table[-1]
        table.append(pick(last[:-half], last[half:]))
    return table


def range_minima(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of each range low..high, both included, from two overlapping blocks of a table."""
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), np.int64)
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[k][low[here]], table[k][high[here] - (1 << k) + 1])
    return out


def next_beyond(rank: np.ndarray, ends: np.ndarray, reach: int, smaller: bool) -> np.ndarray:
    """For each place, the next one of its document whose rank is smaller (or greater); the document's end where there is none."""
    table = sparse_table(rank, reach, np.minimum if smaller else np.maximum)
    at = np.arange(len(rank)) + 1
    for k in range(len(table) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) <= ends)
        block = table[k][at[fits]]
        at[fits[block > rank[fits] if smaller else block < rank[fits]]] += 1 << k
    return at


class Extensions:
    """Lengths of common extensions of two places of a document to the right."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, reach: int):
        levels = suffix_ranks(codes, doc, ends)
        self.rank = levels[-1]
        self.table = sparse_table(common_prefixes(levels, ends), reach)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        return range_minima(self.table, low, high)


def runs(codes: np.ndarray, lengths: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of at least ``least`` words and two periods, by document, start and period.

    ``codes`` are the words of documents of the given lengths, one document after another; starts are places in a document.
    """
    n, reach = len(codes), int(lengths.max(initial=0))
    if not n:
        return (np.zeros(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(lengths)), lengths)
    stops = np.cumsum(lengths)
    begins = (stops - lengths)[doc]
    ends = stops[doc]
    right = Extensions(codes, doc, ends, reach)
    left = Extensions(codes[::-1].copy(), (len(lengths) - 1 - doc)[::-1].copy(), (n - begins)[::-1].copy(), reach)
    found = []
    for smaller in (True, False):
        over = next_beyond(right.rank, ends, reach, smaller)
        i = np.flatnonzero(over < ends)  # a run holds two periods, so the root that begins in its first one ends before it does
        j = over[i]
        more = right(i, j)
        before = np.zeros(len(i), np.int64)
        inside = np.flatnonzero(i > begins[i])
        before[inside] = left(n - i[inside], n - j[inside])  # the places before i and j, in the reversed text
        start, length, period = i - before, before + (j - i) + more, j - i
        good = length >= np.maximum(least, 2 * period)
        found.append(np.stack([start[good], length[good], period[good]]))
    rows = np.unique(np.concatenate(found, axis=1).T, axis=0).T
    start, length, period = rows
    which = doc[start] if len(start) else start
    start = start - (stops - lengths)[which]
    order = np.lexsort((period, start, which))
    return which[order], start[order], length[order], period[order]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _row(key, words: list[str], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    if not len(start):
        return key, 0, None, None, None, None, _sha(""), _sha(" ".join(words)), len(words), 0
    best = np.lexsort((period, start, -length))[0]
    s, m, q = int(start[best]), int(length[best]), int(period[best])
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist()))
    return key, len(start), s, m, q, 1000 * m // q, _sha(lines), _sha(" ".join([words[k] for k in kept])), len(words), len(words) - len(kept)


def _chunks(docs: list[tuple], chunk_words: int) -> list[list[tuple]]:
    """(id, words) pairs in chunks of at most ``chunk_words`` words, shorter ones first, so those of a chunk are about as long."""
    out, room = [], -1
    for pair in sorted(docs, key=lambda d: len(d[1])):
        if len(pair[1]) > room:
            out.append([])
            room = chunk_words
        out[-1].append(pair)
        room -= len(pair[1])
    return out


def _runs_of(batches, least: int, plant: bool, chunk_words: int):
    for batch in slices(batches):
        docs, held = [], 0
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        for k, key in enumerate(keys):
            words = _word.findall(texts[k].as_py())
            docs.append((key, planted(words, key) if plant else words))
            held += len(words)
            if held >= 4 * chunk_words or k == len(keys) - 1:
                yield from _found(docs, least, chunk_words)
                docs, held = [], 0


def _found(docs: list[tuple], least: int, chunk_words: int):
    rows = []
    for chunk in _chunks(docs, chunk_words):
        lengths = np.array([len(w) for _, w in chunk])
        codes = pd.factorize(np.array([w for _, words in chunk for w in words], object))[0].astype(np.int64)
        which, *found = runs(codes, lengths, least)
        cuts = np.searchsorted(which, np.arange(len(chunk) + 1))
        rows += [_row(key, words, *(c[a:b] for c in found)) for (key, words), a, b in zip(chunk, cuts, cuts[1:])]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, plant: bool = False, chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """The runs of every row's words: their number, the longest one, and digests of all runs and of the text without repetitions.

    (id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_dropped). A run is a stretch of at least
    ``least`` words and two of its smallest period that can't be made longer. ``plant`` first applies the change that an id asks for
    (``planted``). Null and empty texts and those of white space have no words, so no runs; rows without an id are never changed;
    repeated rows give a row each; an empty table gives an empty result; other columns are not read. A document is worked on
    by one task, whatever its length, in memory proportional to its words times their number's logarithm.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body(F.col(text_col)).alias("t"))
    return rows.mapInArrow(lambda batches: _runs_of(batches, least, plant, chunk_words), SCHEMA)
