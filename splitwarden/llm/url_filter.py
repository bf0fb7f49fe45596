"""URL filters by a sorted digest array.

Rules become the sorted 64-bit xxhash keys of their strings, in a file that each Python worker maps into memory; a batch
of URLs probes it with a vectorised binary search, and hits are confirmed on the stored full strings.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains), the start of a path ('' or '/...'), and a verdict."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """'block example.com/en/' -> Rule('example.com', '/en/', 'block')."""
    verdict, _, where = line.partition(" ")
    host, slash, path = where.partition("/")
    return Rule(host, slash + path, verdict)


class DigestArray:
    """Sorted xxhash keys, offsets and the strings themselves; keys and offsets are memory-mapped read-only."""

    def __init__(self, texts: list[str]):
        encoded = [t.encode() for t in texts]
        keys = np.array([xxhash.xxh64_intdigest(e) for e in encoded], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.blob = b"".join(encoded[k] for k in order)
        ends = np.cumsum([0] + [len(encoded[k]) for k in order]).astype(np.uint64)
        self.count, self.bytes = len(texts), np.concatenate([keys[order], order.astype(np.uint64), ends]).tobytes()
        self.map = None

    def open(self) -> None:
        """Map the array; the file is unlinked at once, so it goes when the process ends."""
        if self.map is None:
            handle, path = tempfile.mkstemp(prefix="digests-")
            with os.fdopen(handle, "wb") as out:
                out.write(self.bytes)
            self.map = np.memmap(path, np.uint64, "r")
            os.unlink(path)
            n = self.count
            self.keys, self.order, self.ends = self.map[:n], self.map[n : 2 * n], self.map[2 * n :]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The original index of each probe's string, or -1."""
        self.open()
        out = np.full(len(probes), -1, np.int64)
        if not self.count or not probes:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        for k in np.flatnonzero(self.keys[np.minimum(at, self.count - 1)] == digests):
            j = int(at[k])
            while j < self.count and self.keys[j] == digests[k]:  # equal keys: the full string decides
                if self.blob[int(self.ends[j]) : int(self.ends[j + 1])] == probes[k]:
                    out[k] = int(self.order[j])
                    break
                j += 1
        return out

    def __getstate__(self):
        return {"blob": self.blob, "count": self.count, "bytes": self.bytes, "map": None}


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://'."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(hosts: list[str], paths: list[str], rules: list[Rule], array: DigestArray, lengths: list[int], longest: int, at_once: int = 1 << 16) -> list[int]:
    """The index of the longest rule that fits each URL, or -1. Suffixes of a host that are longer than any rule's host can't fit."""
    best = [-1] * len(hosts)
    probes, owner = [], []

    def look():
        found = array.find(probes)
        for p in np.flatnonzero(found >= 0):
            k, r = owner[p], int(found[p])
            if best[k] < 0 or len(rules[r].text) > len(rules[best[k]].text):
                best[k] = r
        probes.clear()
        owner.clear()

    for k, (host, path) in enumerate(zip(hosts, paths)):
        starts = [path[:n] for n in lengths if n <= len(path)]
        at = 0 if len(host) <= longest else host.find(".", len(host) - longest - 1) + 1 or len(host) + 1
        while at <= len(host):
            for start in starts:
                probes.append((host[at:] + start).encode("utf-8", "surrogatepass"))
                owner.append(k)
            at = host.find(".", at) + 1 or len(host) + 1
        if len(probes) >= at_once:
            look()
    look()
    return best


def url_verdicts(
    pages: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id", default: str = "allow", most_rule_bytes: int = 64 << 20
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; the longest rule that fits a URL's host and path decides.

    Null urls and urls without '://' have an empty host and path, fit no rule, and get ``default``, as does every URL
    that no rule fits. Repeated rows are judged alike; an empty table gives an empty result; other columns are not
    read. A host and a path that spell a rule's string only when joined (host 'a', path '/b' against 'a/b') are the
    same string, since no host holds a '/'. The rules travel with the tasks, so their size is checked against ``most_rule_bytes``.
    """
    rules = list(dict.fromkeys(rules))
    if len({r.text for r in rules}) != len(rules):
        raise ValueError("two rules of one host and path differ in their verdict")
    if sum(len(r.text.encode()) + 24 for r in rules) > most_rule_bytes:
        raise ValueError(f"rules exceed {most_rule_bytes} bytes; split them by host and judge each part")
    array = DigestArray([r.text for r in rules])
    lengths, longest = sorted({len(r.path) for r in rules}), max((len(r.host) for r in rules), default=0)
    shared = pages.sparkSession.sparkContext.broadcast(array)

    def run(batches):
        for batch in slices(batches, 2000):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best = judge(hosts, paths, rules, shared.value, lengths, longest)
            rule = pa.array([rules[k].text if k >= 0 else None for k in best], pa.string())
            verdict = pa.array([rules[k].verdict if k >= 0 else default for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string")


#: The rules of the query.
RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]

ORACLE = r"""
with p as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest, contains(coalesce(url, ''), '://') as there from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select q.page_id, q.host, q.path, r.host || r.path as rule, r.verdict,
  row_number() over (partition by q.page_id order by length(r.host || r.path) desc) as k
  from q left join r on (q.host = r.host or ends_with(q.host, '.' || r.host)) and starts_with(q.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""
