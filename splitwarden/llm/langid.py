"""Language identification by string kernels.

The kernel is the blended spectrum over n-gram presence: the number of distinct 1- to 4-grams two texts share, normalised by
both counts. Nyström landmarks turn it into a finite feature map, one-versus-rest kernel ridge regression learns on a
bounded sample of labelled rows, and texts are scored by batched matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


@dataclass
class Postings:
    """Which landmarks have each n-gram: those of n-gram k are landmarks[starts[k]:starts[k + 1]]."""

    starts: np.ndarray
    landmarks: np.ndarray
    count: int  # of all landmarks

    @classmethod
    def of(cls, grams: np.ndarray, marks: list[np.ndarray]) -> Postings:
        at = np.searchsorted(grams, np.concatenate(marks)) if marks else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(marks), dtype=np.int32), [len(m) for m in marks])
        order = np.argsort(at, kind="stable")
        return cls(np.searchsorted(at[order], np.arange(len(grams) + 1)), which[order], len(marks))


@dataclass
class LanguageModel:
    labels: list
    grams: np.ndarray  # the sorted codes of all n-grams that a landmark has
    landmarks: Postings
    landmark_norms: np.ndarray
    weights: np.ndarray  # m x labels
    orders: int

    def size(self) -> int:
        """Bytes of its arrays."""
        return sum(a.nbytes for a in (self.grams, self.landmarks.starts, self.landmarks.landmarks, self.landmark_norms, self.weights))


def gram_codes(text: str, orders: int) -> np.ndarray:
    """The distinct 64-bit codes of the n-grams of the whole lower-cased text, n = 1..orders, sorted. Code points are mixed one to one
    into 64 bits and added up by a polynomial, so two n-grams of one code are a matter of 2**-64."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    gram, found = np.zeros(len(x), np.uint64), []
    for n in range(1, min(orders, len(x)) + 1):
        gram = gram[: len(x) - n + 1] * np.uint64(0xD1342543DE82EF95) + x[n - 1 :]
        found.append(_distinct(gram + np.uint64(n)))
    return np.sort(np.concatenate(found)) if found else gram


def _distinct(codes: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """np.unique of an array in parts, so that a long text needs no more room than its distinct codes."""
    held = np.unique(codes[:at_once])
    for at in range(at_once, len(codes), at_once):
        held = np.union1d(held, codes[at : at + at_once])
    return held


def _features(codes: list[np.ndarray], grams: np.ndarray, landmarks: Postings | np.ndarray, landmark_norms: np.ndarray) -> np.ndarray:
    """The kernel of each text with each landmark: shared n-grams over the root of both counts. ``landmarks`` may be a matrix, n-grams x landmarks."""
    if isinstance(landmarks, np.ndarray):
        landmarks = Postings.of(grams, [grams[c > 0] for c in landmarks.T])
    sizes = [len(c) for c in codes]
    shared = np.zeros(len(codes) * landmarks.count, np.int64)
    if len(grams) and sum(sizes):
        all_codes, text = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
        at = np.minimum(np.searchsorted(grams, all_codes), len(grams) - 1)
        known = grams[at] == all_codes
        at, text = at[known], text[known]
        for low in range(0, len(at), 1 << 16):  # so that what is looked up at once is bounded by the landmarks
            first, row = landmarks.starts[at[low : low + (1 << 16)]], text[low : low + (1 << 16)]
            many = landmarks.starts[at[low : low + (1 << 16)] + 1] - first
            place = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
            shared += np.bincount(np.repeat(row * landmarks.count, many) + landmarks.landmarks[place], minlength=len(shared))
    norms = np.sqrt(np.maximum(sizes, 1))
    return shared.reshape(len(codes), landmarks.count).astype(np.float32) / (norms[:, None] * landmark_norms[None, :])


def fit(
    texts: list[str], labels: list, landmarks_per_label: int = 24, landmark_chars: int = 500, orders: int = 4, ridge: float = 1e-2, batch: int = 64
) -> LanguageModel:
    """Kernel ridge regression on the Nyström features of a bounded sample; deterministic in the order of the rows.

    A label's landmarks are its shortest sampled texts of ``landmark_chars`` characters or more, then its longest others: whole texts.
    """
    names = sorted(set(labels))
    codes = [gram_codes(t, orders) for t in texts]
    first = sorted(range(len(texts)), key=lambda k: (len(texts[k]) < landmark_chars, len(texts[k]) if len(texts[k]) >= landmark_chars else -len(texts[k])))
    chosen = [k for name in names for k in [i for i in first if labels[i] == name][:landmarks_per_label]]
    marks = [codes[k] for k in chosen]
    grams = np.unique(np.concatenate(marks))
    z = Postings.of(grams, marks)
    zn = np.sqrt(np.maximum([len(m) for m in marks], 1))
    kernel = lambda held: np.concatenate([_features(held[k : k + batch], grams, z, zn) for k in range(0, len(held), batch)]).astype(float)
    values, vectors = np.linalg.eigh(kernel(marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel(codes) @ root
    truth = np.array([[y == name for name in names] for y in labels], float)
    share = truth.sum(0)
    balance = (truth / share).sum(1) * len(labels) / len(names)  # each label weighs alike
    weighted = features * balance[:, None]
    solution = np.linalg.solve(weighted.T @ features + ridge * np.eye(features.shape[1]), weighted.T @ truth)
    return LanguageModel(names, grams, z, zn, (root @ solution).astype(np.float32), orders)


def predict(model: LanguageModel, texts: list, batch: int = 64) -> tuple[list, list]:
    """(label, score) of each text; ('und', 0) for null and for texts without a letter. Scores are clipped to 0..1."""
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for at in range(0, len(known) if model.labels else 0, batch):
        rows = known[at : at + batch]
        s = _features([gram_codes(texts[k], model.orders) for k in rows], model.grams, model.landmarks, model.landmark_norms) @ model.weights
        best = s.argmax(1)
        for r, b, v in zip(rows, best, s[np.arange(len(rows)), best]):
            labels[r], scores[r] = model.labels[b], float(min(1.0, max(0.0, v)))
    return labels, scores


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_label: int, most_broadcast: int = 100_000) -> DataFrame:
    """At most ``rows_per_label`` (text, lang) rows of every label, by the order of a hash of the id.

    Texts of 200 to 20,000 characters come first, so what the driver fetches stays small. Only ids, labels and lengths are
    ranked (each task first keeps its own best); the texts of the chosen ids are then looked up.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("id")) & F.col("id").isNotNull())
    size = F.length("text")
    ranked = rows.select(
        "id", "lang", F.when(size.between(200, 20000), 0).when(size < 200, 1).otherwise(2).alias("tier"), F.xxhash64(F.lit(6), "id").alias("h")
    )
    best = ranked.withColumn(
        "k", F.row_number().over(Window.partitionBy("lang").orderBy("tier", "h", "id"))
    ).where(F.col("k") <= rows_per_label).select("id", "lang", "k").dropDuplicates(["id", "lang"])
    best = materialise(best, "chosen")
    if best.count() <= most_broadcast:  # ids and labels only; beyond that both sides are shuffled
        best = F.broadcast(best)
    return rows.join(best, ["id", "lang"]).dropDuplicates(["id", "lang"]).select("lang", "k", "id", "text").orderBy("lang", "k", "id")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_label: int = 200, **settings) -> LanguageModel:
    sample = training_sample(docs, id_col, text_col, lang_col, rows_per_label).collect()
    if not sample:
        return LanguageModel([], np.zeros(0, np.uint64), Postings.of(np.zeros(0, np.uint64), []), np.zeros(0), np.zeros((0, 0), np.float32), 1)
    return fit([r.text for r in sample], [r.lang for r in sample], **settings)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 512 << 20) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, from the whole text alone.

    Null texts and texts without a letter (also empty ones) are 'und' with score 0, as is everything where no label was learned.
    Repeated rows get equal results; a null id is not held out; an empty table gives an empty result. A model of over ``most_bytes``, which the
    number of labels and of landmarks for each decides, is an error: it goes to every executor.
    """
    if model.size() > most_bytes:
        raise ValueError(f"the model has {model.size()} bytes; fit it with fewer landmarks for each label")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                labels, scores = predict(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                    names=["id", "held_out", "lang_pred", "score"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
