"""Edit distances of many pairs of strings at a time, by bit-parallel columns."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings, one row each, padded with zeros, and their lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(strings), int(lengths.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def composition(rows: np.ndarray, lengths: np.ndarray, buckets: int = 64) -> np.ndarray:
    """How many characters of each string fall into each bucket of code points."""
    row = np.repeat(np.arange(len(rows)), lengths)
    folded = rows[np.arange(rows.shape[1]) < lengths[:, None]] % buckets
    return np.bincount(row * buckets + folded, minlength=len(rows) * buckets).reshape(-1, buckets).astype(np.int32)


def most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of compositions the characters that the strings can share at most."""
    out = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        if x[:, k].any() and y[:, k].any():
            out += np.minimum(x[:, k, None], y[None, :, k])
    return out


def _short(patterns: np.ndarray, m: np.ndarray, texts: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of patterns[i] (of 1 to 64 characters) and texts[j], one word of bits for each pair."""
    letters, at = np.unique(np.concatenate([patterns.ravel(), texts.ravel()]), return_inverse=True)
    p, t = at[: patterns.size].reshape(patterns.shape), at[patterns.size :].reshape(texts.shape)
    equal = np.zeros((len(patterns), len(letters)), np.uint64)
    for k in range(patterns.shape[1]):
        here = np.flatnonzero(m > k)
        equal[here, p[here, k]] |= ONE << np.uint64(k)
    order = np.argsort(-n[j], kind="stable")  # longer texts first, so that those still open are the first ones
    i, j = i[order], j[order]
    steps, last = n[j], (m[i] - 1).astype(np.uint64)
    up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
    score = m[i].copy()
    for k in range(int(steps.max(initial=0))):
        live = int(np.searchsorted(-steps, -k))  # steps > k
        pv, mv = up[:live], down[:live]
        eq = equal[i[:live], t[j[:live], k]]
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[:live] += (ph >> last[:live] & ONE).astype(np.int64) - (mh >> last[:live] & ONE).astype(np.int64)
        ph, mh = ph << ONE | ONE, mh << ONE
        up[:live], down[:live] = mh | ~(xv | ph), ph & xv
    out = np.empty(len(i), np.int64)
    out[order] = score
    return out


def _long(patterns: np.ndarray, m: np.ndarray, texts: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, pairs: int = 1 << 13) -> np.ndarray | None:
    """As ``_short`` for patterns of any length, several words of bits for each pair, at most ``pairs`` at a time. All words of a column are
    worked out together, only the carry of the sum goes from word to word. None where the table of letters would be large."""
    letters, at = np.unique(np.concatenate([patterns.ravel(), texts.ravel()]), return_inverse=True)
    p, t = at[: patterns.size].reshape(patterns.shape), at[patterns.size :].reshape(texts.shape)
    words = -(-patterns.shape[1] // 64)
    if words * len(patterns) * len(letters) > 1 << 23:
        return None
    equal = np.zeros((words, len(patterns), len(letters)), np.uint64)
    for k in range(patterns.shape[1]):
        here = np.flatnonzero(m > k)
        equal[k // 64, here, p[here, k]] |= ONE << np.uint64(k % 64)
    flat, table = equal.ravel(), len(patterns) * len(letters)
    columns = np.ascontiguousarray(t.T)
    final, top = (m - 1) // 64, np.uint64(63)
    order = np.lexsort((-n[j], final[i]))
    ends = final[i[order]]
    out = np.empty(len(i), np.int64)
    low = 0
    while low < len(order):  # pairs of as many words, longer texts first, so that those still open are the first ones
        used = int(ends[low]) + 1
        here = order[low : min(low + min(pairs, max(64, (1 << 18) // used)), int(np.searchsorted(ends, ends[low], side="right")))]
        low += len(here)
        a, b = i[here], j[here]
        steps = n[b]
        shift = ((m[a] - 1) % 64).astype(np.uint64)
        score = m[a].astype(np.int64)
        base = a[None, :] * len(letters) + (np.arange(used) * table)[:, None]
        pv, mv = np.full((used, len(a)), ~np.uint64(0)), np.zeros((used, len(a)), np.uint64)
        live = 0
        for k in range(int(steps[0]) if len(steps) else 0):
            still = int(np.searchsorted(-steps, -k))  # steps > k
            if still != live:
                live = still
                pv, mv, base, who = pv[:, :live].copy(), mv[:, :live].copy(), base[:, :live].copy(), b[:live].copy()
                eq, xh, ph, mh = (np.empty((used, live), np.uint64) for _ in range(4))
                last, over = shift[:live].copy(), np.empty((used, live), bool)
            np.take(flat, base + columns[k][who], out=eq, mode="clip")
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            np.less(xh, pv, out=over)
            carry = over[:-1]
            while carry.any():  # into the next words, and on from those that it fills
                xh[1:] += carry
                carry &= xh[1:] == 0
                carry[1:], carry[:1] = carry[:-1].copy(), False
            xh ^= pv
            xh |= eq
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            np.bitwise_and(pv, xh, out=mh)
            score[:live] += (ph[-1] >> last & ONE).astype(np.int64)
            score[:live] -= (mh[-1] >> last & ONE).astype(np.int64)
            eq |= mv
            up, down = ph[:-1] >> top, mh[:-1] >> top
            ph <<= ONE
            mh <<= ONE
            ph[0] |= ONE
            ph[1:] |= up
            mh[1:] |= down
            np.bitwise_or(eq, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            np.bitwise_and(ph, eq, out=mv)
        out[here] = score
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance, or a number above ``most`` where it is above that. The columns are whole numbers of len(a) bits."""
    m = len(a)
    if not m:
        return len(b)
    equal: dict = {}
    for k, c in enumerate(a):
        equal[c] = equal.get(c, 0) | 1 << k
    all_, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, left = all_, 0, m, len(b)
    for c in b:
        eq = equal.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | all_ & ~(xh | pv), pv & xh
        left -= 1
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - left > most:
            return most + 1
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = all_ & (mh | ~(xv | ph)), ph & xv & all_
    return score


def identities(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """1 - edits / longer length of each pair a[i], b[j]; 0 where it is below the threshold (and may not have been worked out)."""
    (x, m), (y, n) = codes(a), codes(b)
    longer = np.maximum(m[i], n[j])
    most = np.floor((1 - threshold) * longer + 1e-9).astype(np.int64)
    edits = np.empty(len(i), np.int64)
    first = m[i] <= 64
    second = ~first & (n[j] <= 64)
    for here, *args in ((first, x, m, y, n, i, j), (second, y, n, x, m, j, i)):
        at = np.flatnonzero(here)
        if len(at):
            of = np.unique(args[4][at])
            wide = int(args[1][of].max())
            edits[at] = _short(args[0][:, : min(64, wide)], np.minimum(args[1], 64), args[2], args[3], args[4][at], args[5][at])
    rest = np.flatnonzero(~first & ~second)
    found = _long(x, m, y, n, i[rest], j[rest]) if len(rest) >= 64 else None
    if found is not None:
        edits[rest], rest = found, rest[:0]
    for k in rest.tolist():
        edits[k] = edit_distance(a[i[k]], b[j[k]], int(most[k]))
    return np.where(edits <= most, 1 - edits / np.maximum(longer, 1), 0.0)
