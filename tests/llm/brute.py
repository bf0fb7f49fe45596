"""Plain versions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def suffix(docs, length, passage):
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words)."""
    data = [(d, t or "") for d, t in docs]
    seen, holders = Counter(), defaultdict(set)
    for d, t in data:
        b, words = t.encode(), WORD.findall(t)
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
        for i in range(len(words) - passage + 1):
            holders[tuple(words[i : i + passage])].add((d, t))

    def covered(n, width, repeats):
        gone = bytearray(n)
        for i in range(n - width + 1):
            if repeats(i):
                gone[i : i + width] = b"\1" * width
        return gone, sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))

    out = []
    for d, t in data:
        b, words = t.encode(), WORD.findall(t)
        gone, spans = covered(len(b), length, lambda i: seen[b[i : i + length]] > 1)
        inside, passages = covered(len(words), passage, lambda i: len(holders[tuple(words[i : i + passage])]) > 1)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), passages, sum(inside)))
    return out


def boilerplate(docs, max_docs, count="documents"):
    """A test of (source, line): whether more than max_docs documents, or distinct texts, of the source hold the line."""
    holders = defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    for k, (_, t, s) in enumerate(docs):
        for line in (t or "").split("\n"):
            if norm(line):
                holders[s, norm(line)].add(k if count == "documents" else t)
    return lambda s, line: len(holders[s, norm(line)]) > max_docs


def quality(docs, max_docs, least_share, count="documents"):
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)} of (doc_id, text, source) rows."""
    often, out = boilerplate(docs, max_docs, count), {}
    for d, t, s in docs:
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(windows)
        covered = {p for i, w in enumerate(windows) if many[w] > 1 for p in (i, i + 1, i + 2)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        lost = sum(len(WORD.findall(x)) for x in t.split("\n") if often(s, x))
        out[d] = (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed,
            not failed and len(words) - lost >= least_share * len(words)
        )
    return out


def fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, radius=2):
    """{doc_id: (fingerprint, component)} by comparing all pairs."""
    fps = {d: fingerprint(t) for d, t in docs}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (fps[d], find(d)) for d in ids}


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target}, by resharing until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level > cap * sizes[s]]
        if not above:
            return out | {s: weight[s] * level for s in open_}
        for s in above:
            out[s] = cap * sizes[s]
        open_ = [s for s in open_ if s not in out]
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """(start, kind, end) of the patterns as they are written down."""

    def holds(kind, match):
        digits = [int(c) for c in match if c.isdigit()]
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return {
            "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15,
        }[kind]

    found = [(m.start(), kind, m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if holds(kind, m.group())]
    return sorted(found, key=lambda x: (x[0], list(PATTERNS).index(x[1])))


def contained(text, template, words_per_shingle=5, containment=0.8, stretch=1.5):
    """Whether some stretch of 1.5 template lengths holds 80 % of the template's distinct shingles."""
    k = words_per_shingle
    t, w = (re.findall(r"[^\W_]+", x.lower()) for x in (template, text))
    own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    shingles = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    reach = max(1, int(stretch * (len(t) - k + 1)))
    return any(len(own & set(shingles[i : i + reach])) >= containment * len(own) for i in range(max(1, len(shingles) - reach + 1)))
