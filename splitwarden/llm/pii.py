"""Personal data: patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The network is written and trained in numpy, from generated sentences whose spans are labelled. Texts are read through
overlapping windows, which are decoded with Viterbi and reconciled over the whole text. A span must hold a digit, '@', '(at)' or
'[at]' to be valid, and windows cover all that a valid span around one of these can reach, so skipping the rest loses none.

``train_tagger`` is deterministic and takes some minutes; ``python -m splitwarden.llm.pii`` runs it and writes its weights to
tagger.npz beside this file, which ``trained`` reads.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, slices

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"  # labelled by the network beside the four kinds: passwords, tokens and keys
#: The patterns of the base spans, as parts that each run through a text in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = r"[(\[]\s?at\s?[)\]]"
#: Every valid span holds one of these.
TRIGGER = re.compile(rf"[0-9]+|(?<=[\w\s.%+-])@(?=\s?[\w-])|{AT}")
RUN = re.compile(r"[A-Za-z0-9_./+=-]*")
#: Leaders, as in a table of contents or a form: the network reads them as blanks.
LEADER = re.compile(r"([._=*~-])\1{2,}")
RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_./+=-")
LONGEST_RUN, LONGEST_LOCAL, LONGEST_DOMAIN = 128, 64, 253
PUNCTUATION = " \n\t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LABELS = ["O"] + [f"{p}-{k}" for k in (*KINDS, SECRET) for p in "BI"]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def in_byte(number: str) -> bool:
    return len(number.lstrip("0")) <= 3 and int(number.lstrip("0") or "0") <= 255


def emails(text: str):
    """Leftmost matches of local part, '@', domain: a local part reaches back from its '@' to the last match or to another character."""
    floor = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def ips(text: str):
    """Every four numbers of a dotted chain, if none is over 255."""
    for m in DOTTED.finditer(text):
        if m.group(1):
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(map(in_byte, parts[k : k + 4])):
                    yield at, at + size
                at += size + 1


def cards(text: str):
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' leftmost non-overlapping matches that are valid, sorted."""
    finders = [(emails, "@" in text), (phones, "+" in text)]
    if re.search("[0-9]", text):
        finders += [(ips, "." in text), (cards, True)]
    kinds = {emails: "email", ips: "ip", cards: "card", phones: "phone"}
    return in_order([(s, kinds[f], e) for f, wanted in finders if wanted for s, e in f(text)])


def in_order(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[0], (*KINDS, SECRET).index(s[1])))


# ---- the network ----


def char_classes(text: str) -> np.ndarray:
    """A small alphabet: digit, lower, upper, other letter, other, and each ASCII punctuation mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(codes, len(TABLE) - 1)]


def _table() -> np.ndarray:
    out = np.full(0x250, 4, np.int64)  # letters beyond ASCII, and everything else from there on
    out[:0x80] = 5
    out[ord("0") : ord("9") + 1], out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1] = 1, 2, 3
    for k, c in enumerate(PUNCTUATION):
        out[ord(c)] = 6 + k
    return out


TABLE = _table()
SYMBOLS = 6 + len(PUNCTUATION)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, forward and backward LSTM, linear emissions, CRF transitions."""

    def __init__(self, hidden: int = 20, embed: int = 12, seed: int = 8):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h, n = hidden, len(LABELS)
        self.w = {
            "embed": draw(SYMBOLS, embed) * 2, "out": draw(2 * hidden, n), "out_b": np.zeros(n, np.float32), "trans": np.zeros((n, n), np.float32),
            "first": np.zeros(n, np.float32)
        }
        for d in "fb":
            self.w[f"{d}x"], self.w[f"{d}h"] = draw(embed, 4 * hidden), draw(hidden, 4 * hidden)
            self.w[f"{d}b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.forbidden = np.array([[0 if not b.startswith("I-") or a != "O" and a[2:] == b[2:] else -1e4 for b in LABELS] for a in LABELS], np.float32)
        self.no_start = np.array([-1e4 if b.startswith("I-") else 0 for b in LABELS], np.float32)

    def lstm(self, x, d, keep):
        """x: steps x batch x embed. Gates in order: input, forget, output, candidate."""
        h = self.h
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        pre = x @ self.w[f"{d}x"] + self.w[f"{d}b"]
        out = np.zeros((*x.shape[:2], h), np.float32)
        state, cell, trace = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), []
        for t in steps:
            z = pre[t] + state @ self.w[f"{d}h"]
            gates, cand = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, cell = cell, gates[:, h : 2 * h] * cell + gates[:, :h] * cand
            squashed = np.tanh(cell)
            if keep:
                trace.append((t, gates, cand, before, squashed, state))
            state = gates[:, 2 * h : 3 * h] * squashed
            out[t] = state
        return out, trace

    def emissions(self, codes, keep=False):
        x = self.w["embed"][codes.T]
        f, ft = self.lstm(x, "f", keep)
        b, bt = self.lstm(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.w["out"] + self.w["out_b"], (x, both, ft, bt)

    def lstm_gradient(self, d, x, trace, dout, grads):
        h, dstate, dcell, dx = self.h, 0, 0, np.zeros_like(x)
        for t, gates, cand, before, squashed, state in reversed(trace):
            ds = dout[t] + dstate
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h : 3 * h]
            dc = dcell + ds * o * (1 - squashed**2)
            dz = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - cand**2)], 1)
            grads[f"{d}x"] += x[t].T @ dz
            grads[f"{d}h"] += state.T @ dz
            grads[f"{d}b"] += dz.sum(0)
            dx[t] = dz @ self.w[f"{d}x"].T
            dstate, dcell = dz @ self.w[f"{d}h"].T, dc * f
        return dx

    def gradient(self, codes, labels):
        """Loss and gradients of the CRF's negative log-likelihood, averaged over the batch."""
        e, (x, both, ft, bt) = self.emissions(codes, keep=True)
        steps, batch, n = e.shape
        y = labels.T
        trans, first = self.w["trans"] + self.forbidden, self.w["first"] + self.no_start
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + first
        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        truth = np.eye(n, dtype=np.float32)[y]
        de = np.exp(alpha + beta - z[:, None]) - truth
        gold = (e * truth).sum((0, 2)) + first[y[0]] + trans[y[:-1], y[1:]].sum(0)
        dtrans = np.zeros((n, n), np.float32)
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]
            dtrans += np.exp(pair).sum(0)
        np.subtract.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), 1)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["trans"], grads["first"] = dtrans, de[0].sum(0)
        grads["out"], grads["out_b"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, n), de.sum((0, 1))
        dboth = de @ self.w["out"].T
        dx = self.lstm_gradient("f", x, ft, dboth[:, :, : self.h], grads) + self.lstm_gradient("b", x, bt, dboth[:, :, self.h :], grads)
        np.add.at(grads["embed"], codes.T, dx)
        return float((z - gold).mean()), {k: v / batch for k, v in grads.items()}

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best label path of each window (batch x steps)."""
        e, _ = self.emissions(codes)
        trans = self.w["trans"] + self.forbidden
        score, back = e[0] + self.w["first"] + self.no_start, []
        for t in range(1, len(e)):
            step = score[:, :, None] + trans
            back.append(step.argmax(1).astype(np.uint8))
            score = step.max(1) + e[t]
        path = [score.argmax(1)]
        for b in reversed(back):
            path.append(b[np.arange(len(b)), path[-1]])
        return np.array(path[::-1]).T


# ---- labelled sentences ----


def labelled_text(rng: np.random.Generator, least: int, personal_share: float = 0.14) -> tuple[str, list[tuple[int, str, int]]]:
    """Invented text with labelled personal data and secrets, also in forms that the patterns miss, and with look-alikes."""
    pick = lambda *options: options[rng.integers(len(options))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    number = lambda n: pick(*"123456789") + digits(n - 1)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10)))
    spell = lambda n, letters: "".join(letters[c] for c in rng.integers(0, len(letters), n))
    hexed = lambda n: spell(n, "0123456789abcdef")
    mixed = lambda n: spell(n, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

    def number_with_luhn():
        body_ = pick("4", "5", "37", "6011") + digits(12)
        return next(body_[:15] + str(d) for d in range(10) if luhn(body_[:15] + str(d)))

    def personal():
        """(kind, before, span, after)"""
        kind = pick(*KINDS, *KINDS, SECRET, SECRET)
        if kind == "email":
            user = pick(word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}.{word()}")
            return kind, "", user + pick(
                "@", "@", "@", " (at) ", " [at] ", "(at)", "[at]"
            ) + pick(word(), f"mail{digits(1)}.{word()}") + pick(".com", ".org", ".net", ".de"), ""
        if kind == "ip":
            return kind, pick("", "", "ip ", "host "), pick(".", ".", "[.]", "(.)").join(
                str(v) for v in rng.integers(0, 256, 4)
            ), pick("", "", "", f":{digits(4)}")
        if kind == "card":
            c = number_with_luhn()
            return kind, pick("", "", "card "), pick(c, *(j.join(c[k : k + 4] for k in range(0, 16, 4)) for j in " -.")), ""
        if kind == SECRET:
            name = pick("password", "passwd", "token", "secret", "api_key", "access_token", "TOKEN", "Password")
            free = pick(hexed(int(rng.integers(16, 49))), mixed(int(rng.integers(12, 41))), f"{word()}{digits(3)}{pick(*'_-.')}{word()}")
            return pick(
                (kind, name + pick("=", ": ", " = ", ":"), free, ""), (kind, f"{name} = \"", free, '"'), (kind, f"{name}='", free, "'"),
                (kind, "", "AKIA" + spell(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ""), (kind, "", "ghp_" + mixed(36), ""), (kind, "", "sk-" + mixed(32), ""),
            )
        a, b, c = digits(3), digits(3), digits(4)
        forms = (
            f"+1 ({a}) {b}-{c}", f"+{pick('44', '49', '33', '34')} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}",
            f"00{pick('44', '49')} {a} {b}{c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}"
        )
        return kind, pick("", "", "call ", "tel. ", "phone: "), pick(*forms), ""

    def look_alike():
        return pick(
            f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 29)}/{rng.integers(1, 13)}/{rng.integers(1900, 2030)}", f"version {digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}",
            f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", digits(rng.integers(1, 8)), number(int(rng.integers(8, 16))), f"page {digits(3)}", f"{digits(4)}-{digits(4)}", f"{number(5)}/{number(5)}", f"{number(4)}/{number(6)}",
            f"#{digits(6)}", f"@{word()}", f"{digits(1)} @ {digits(2)}", f"{word()} at {word()}", hexed(32), f"sha1 {hexed(40)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(1)},{digits(3)}.{digits(2)}", f"{digits(3)}-{digits(3)}",
            f"{number(2)}.{digits(4)}, {number(2)}.{digits(4)}", f"{number(3)} {number(3)}", f"id {number(9)}", f"password {word()}", f"token {word()}", f"{word()}{digits(2)}", f"{word()}_{word()}", f"({word()})", f"[{digits(2)}]",
        )

    text, marks = "", []
    while len(text) < least:
        draw = rng.random()
        if draw < personal_share:
            kind, before, span, after = personal()
            text += before
            marks.append((len(text), kind, len(text) + len(span)))
            text += span + after
        elif draw < personal_share + 0.14:
            text += look_alike()
        else:
            text += word().capitalize() if draw < personal_share + 0.22 else word()
        text += pick(" ", " ", " ", " ", ", ", ". ", "\n", "; ", ": ", ") ", '" ', "! ")
    return text, marks


def labelled_windows(count: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of labelled_text as codes and labels; none starts inside a span."""
    rng = np.random.default_rng(seed)
    codes, labels = np.zeros((count, width), np.int64), np.zeros((count, width), np.int64)
    for row in range(count):
        text, marks = labelled_text(rng, 3 * width)
        tags = np.zeros(len(text), np.int64)
        for s, kind, e in marks:
            tags[s:e] = LABELS.index(f"I-{kind}")
            tags[s] = LABELS.index(f"B-{kind}")
        free = [s for s in range(len(text) - width) if not LABELS[tags[s]].startswith("I-")]
        at = int(free[rng.integers(len(free))])
        codes[row], labels[row] = char_classes(text[at : at + width]), tags[at : at + width]
    return codes, labels


def train_tagger(windows: int = 4096, width: int = 160, epochs: int = 16, batch: int = 64, rate: float = 0.02, seed: int = 8) -> Tagger:
    """A tagger trained with Adam; deterministic."""
    codes, labels = labelled_windows(windows, width, seed)
    tagger, rng = Tagger(seed=seed), np.random.default_rng(seed)
    m, v, step = {k: 0 for k in tagger.w}, {k: 0 for k in tagger.w}, 0
    total = epochs * (windows // batch)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for at in range(0, windows - batch + 1, batch):
            rows = order[at : at + batch]
            _, grads = tagger.gradient(codes[rows], labels[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            lr = rate * (1 - step / (total + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                tagger.w[k] = (tagger.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


WEIGHTS = Path(__file__).with_name("tagger.npz")


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger that train_tagger() makes, from its written weights."""
    tagger = Tagger()
    with np.load(WEIGHTS) as held:
        if set(held.files) != set(tagger.w) or any(held[k].shape != w.shape for k, w in tagger.w.items()):
            raise ValueError(f"{WEIGHTS.name} does not fit the network; write it anew with python -m splitwarden.llm.pii")
        tagger.w = {k: held[k] for k in tagger.w}
    return tagger


# ---- texts ----


def _words_with_digits(run: str) -> list[tuple[int, int]]:
    """The words of a run that hold a digit and are no longer than a secret, with as much of the run around them as a secret can span,
    merged where they meet."""
    codes = np.frombuffer(run.encode(), np.uint8)
    word = np.r_[False, ~np.isin(codes, np.frombuffer(b"./+=-", np.uint8)), False]
    digits = np.r_[0, np.cumsum((codes >= 48) & (codes <= 57))]
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    good = (end - start <= LONGEST_RUN) & (digits[end] > digits[start])
    low, high = np.maximum(start[good] - LONGEST_RUN, 0), np.minimum(end[good] + LONGEST_RUN, len(run))
    apart = np.flatnonzero(low[1:] > high[:-1]) + 1 if len(low) else []
    return [(int(low[s]), int(high[e - 1])) for s, e in zip([0, *apart], [*apart, len(low)])] if len(low) else []


def regions_of(text: str, around: int = 48) -> list[tuple[int, int]]:
    """Where valid spans can lie, and ``around`` characters on both sides: parts of the text that do not overlap, in order.

    Around '@' and '(at)' these are the longest local part and domain. Around a digit it is the run of letters, digits and _./+=-
    that holds it. A run longer than any secret is cut at the characters a span may border on (./+=-): around each of its words with a digit
    the region is as wide as the longest secret. Words longer than that have none, since a span must not end inside a word.
    """
    out: list = []
    done = 0

    def add(low, high):
        low, high = max(0, low - around), min(len(text), high + around)
        if out and low <= out[-1][1]:
            out[-1] = (min(out[-1][0], low), max(out[-1][1], high))
        else:
            out.append((low, high))

    for m in TRIGGER.finditer(text):
        if not m.group()[0].isdigit():
            add(m.start() - LONGEST_LOCAL - 1, m.end() + LONGEST_DOMAIN + 1)
        elif m.start() >= done:
            done = RUN.match(text, m.start()).end()
            low = m.start()
            while low > 0 and m.start() - low <= LONGEST_RUN and text[low - 1] in RUN_CHARS:
                low -= 1
            if done - low <= LONGEST_RUN:
                add(low, done)
                continue
            for start, end in _words_with_digits(text[low:done]):
                add(low + start, low + end)
    return out


def windows_of(text: str, width: int) -> list[tuple[int, int, int]]:
    """(start, low, high) of windows that overlap by half; each of a region's characters is read, in low..high, where its window is
    nearest to being centred on it."""
    out, half = [], width // 2
    for low, high in regions_of(text):
        starts = list(range(low, max(low + 1, high - half), half))
        for k, s in enumerate(starts):
            out.append((s, s + half // 2 if k else low, s + half // 2 + half if k < len(starts) - 1 else high))
    return out


def valid(kind: str, text: str) -> bool:
    """Whether a span of the network can be what it is said to be."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        m = re.fullmatch(rf"([\w.%+-]+)\s?(?:@|{AT})\s?([\w-]+(?:\.[\w-]+)+)", text)
        return bool(m) and len(m.group(1)) <= LONGEST_LOCAL and len(m.group(2)) <= LONGEST_DOMAIN
    if kind == "phone":
        return bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", text)) and 9 <= len(digits) <= 15 and bool(re.search("[ ()./-]", text))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]+([ .-]?[0-9]+)*", text)) and 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}((\.|\[\.\]|\(\.\))[0-9]{1,3}){3}", text)) and all(map(in_byte, re.findall("[0-9]+", text)))
    return bool(re.fullmatch(rf"[A-Za-z0-9_./+=-]{{8,{LONGEST_RUN}}}", text)) and bool(re.search("[0-9]", text)) and bool(re.search("[A-Za-z]", text))


def add_spans(tagger: Tagger, texts: list[str], base: list[list], width: int = 224, batch: int = 512) -> list[list]:
    """The base spans of each text with those of the network that overlap none of them.

    Every character takes its label from one window; runs of one kind, over window borders too, are a span.
    """
    out = [list(b) for b in base]
    texts = [LEADER.sub(lambda m: " " * len(m.group()), t) for t in texts]
    jobs = ((k, *w) for k, t in enumerate(texts) for w in windows_of(t, width))
    tags, codes, held = {}, {}, []

    def decode():
        rows = np.full((len(held), width), TABLE[ord(" ")])
        for r, (k, s, _, _) in enumerate(held):
            part = codes[k][s : s + width]
            rows[r, : len(part)] = part
        seen: dict = {}
        which = [seen.setdefault(row.tobytes(), len(seen)) for row in rows]  # long runs of a few characters fill many windows alike
        paths = tagger.decode(np.array([np.frombuffer(row, rows.dtype) for row in seen]))
        for (k, s, low, high), path in zip(held, (paths[x] for x in which)):
            tags[k][low:high] = path[low - s : high - s]

    for job in jobs:
        if job[0] not in tags:
            codes[job[0]] = char_classes(texts[job[0]])
            tags[job[0]] = np.zeros(len(texts[job[0]]), np.uint8)
        held.append(job)
        if len(held) == batch:
            decode()
            held = []
            for k in [k for k in codes if k != job[0]]:
                del codes[k]
    if held:
        decode()
    for k, row in tags.items():
        text, n = texts[k], len(texts[k])
        for at in np.flatnonzero(row % 2 == 1).tolist():  # B-kind
            end = at + 1
            while end < n and row[end] == row[at] + 1:
                end += 1
            kind = (*KINDS, SECRET)[(int(row[at]) - 1) // 2]
            end = at + len(text[at:end].rstrip(" \n\t.,;:!?'\""))
            if valid(kind, text[at:end]) and not any(s < end and at < e for s, _, e in base[k]) and not _continues(text, at, end):
                out[k].append((at, kind, end))
    return [in_order(spans) for spans in out]


def _continues(text: str, start: int, end: int) -> bool:
    """Whether the span is only a part of a longer word or number."""
    return bool(start and re.match(r"[\w@]", text[start - 1]) or end < len(text) and re.match(r"[\w@]", text[end]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_secret, secrets, n_found) of every row.

    The counts of the four kinds and the digest are of base spans; ``spans`` and ``n_spans`` of all spans of the four kinds;
    ``n_secret`` and ``secrets`` of passwords, tokens and keys, which only the network finds; ``n_found`` is the sum of both. Null texts count as empty and have no
    span. Ends are exclusive and positions are code points of the whole text. Repeated rows give equal results; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_secret", "secrets", "n_found"]

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            both = add_spans(shared.value, texts, base)
            spell = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
            every, secret = [[x for x in b if x[1] != SECRET] for b in both], [[x for x in b if x[1] == SECRET] for b in both]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(spell(b).encode()).hexdigest() for b in base], pa.string())
            sizes = [pa.array([len(b) for b in x], pa.int64()) for x in (every, secret, both)]
            more = [pa.array([spell(b) for b in every], pa.string()), *sizes[:2], pa.array([spell(b) for b in secret], pa.string()), sizes[2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, *more], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), body(F.col(text_col)).alias("t"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long, n_secret long, secrets string, n_found long"
    return rows.mapInArrow(run, schema)


if __name__ == "__main__":
    np.savez(WEIGHTS, **train_tagger().w)
