"""Logistic regressions of many splits and penalties at once.

Every pass over the rows works out loss and gradient of all models: a task's rows are one matrix, all models' coefficients another, and a
mask says which rows train which split. Tasks add up their gradients before they are shuffled, and are added up by model on the
executors; the driver holds one vector for each model, and moves each by its own limited-memory quasi-Newton step. So the number of passes is that of
the slowest model, however large the grid is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..shared import materialise, ship


@dataclass
class LogisticModels:
    """Coefficients (models x features) and intercepts on the features as they are, and what each model was fitted for."""

    splits: list
    penalties: list[float]
    coefficients: np.ndarray
    intercepts: np.ndarray
    passes: int = 0

    def predict(self, rows: DataFrame, *keep: str) -> DataFrame:
        """(split, C, *keep, y_prob) of every row and model; ``rows`` has features, an array of doubles."""
        ship(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast(self)  # models x features
        kinds = dict(rows.dtypes)

        def run(batches):
            models = shared.value
            splits, penalties = pa.array(models.splits), pa.array(models.penalties, pa.float64())
            for batch in batches:
                if not batch.num_rows:
                    continue
                p = 1 / (1 + np.exp(-(_rows(batch.column(0)) @ models.coefficients.T + models.intercepts)))
                n, m = p.shape
                row, model = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
                kept = {c: batch.column(c).take(row) for c in keep}
                yield pa.RecordBatch.from_pydict({"split": splits.take(model), "C": penalties.take(model)} | kept | {"y_prob": pa.array(p.ravel())})

        kind = "string" if self.splits and isinstance(self.splits[0], str) else "long"
        return rows.select("features", *keep).mapInArrow(run, f"split {kind}, C double, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "y_prob double")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, per_batch, models: int) -> np.ndarray:
    """The sum over all rows of ``per_batch(features, label, splits)``, a matrix with a row for each model (or split): added up in each
    task, then by model on the executors."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = per_batch(_rows(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"model": pa.array(np.arange(len(total))), "v": pa.array([r.tobytes() for r in total], pa.binary())})

    def together(batches):
        total: dict = {}
        for batch in batches:
            for model, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(v)
                total[model] = total[model] + v if model in total else v
        yield pa.RecordBatch.from_pydict({"model": pa.array(list(total), pa.int64()), "v": pa.array([r.tobytes() for r in total.values()], pa.binary())})

    schema = "model long, v binary"
    found = rows.mapInArrow(partial, schema).repartition(min(models, 64), "model").mapInArrow(together, schema).toArrow()
    return np.array([np.frombuffer(v) for _, v in sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))])


def _mask(splits: pa.Array, count: int) -> np.ndarray:
    """rows x splits: whether a row trains a split."""
    out = np.zeros((len(splits), count))
    lengths = np.nan_to_num(splits.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    out[np.repeat(np.arange(len(splits)), lengths), splits.flatten().to_numpy(zero_copy_only=False)] = 1
    return out


@dataclass
class _Descent:
    """One model's limited-memory quasi-Newton descent with a backtracking search; ``at`` is where it wants the loss next."""

    x: np.ndarray
    memory: int = 10
    tolerance: float = 1e-7
    loss: float = np.inf
    gradient: np.ndarray | None = None
    steps: list = field(default_factory=list)
    done: bool = False

    def __post_init__(self):
        self.at, self.direction, self.length = self.x, np.zeros_like(self.x), 1.0

    def told(self, loss: float, gradient: np.ndarray) -> None:
        slope = float(self.gradient @ self.direction) if self.gradient is not None else 0.0
        if self.gradient is not None and not loss <= self.loss + 1e-4 * self.length * slope + 1e-15 * abs(self.loss):
            self.length /= 2
            self.done = self.length < 1e-12
            self.at = self.x + self.length * self.direction
            return
        if self.gradient is not None:
            s, y = self.at - self.x, gradient - self.gradient
            if s @ y > 1e-14:
                self.steps = [*self.steps, (s, y)][-self.memory :]
        self.x, self.loss, self.gradient = self.at, loss, gradient
        if np.abs(gradient).max() <= self.tolerance:
            self.done = True
            return
        q, scales = gradient.copy(), []
        for s, y in reversed(self.steps):
            scales.append(s @ q / (s @ y))
            q -= scales[-1] * y
        if self.steps:
            s, y = self.steps[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(self.steps, reversed(scales)):
            q += s * (a - y @ q / (s @ y))
        self.direction = -q
        self.length = 1.0 if self.steps else min(1.0, 1 / np.abs(gradient).sum())
        self.at = self.x + self.length * self.direction


def fit_many(rows: DataFrame, wanted: list[tuple[int, float]], names: list, most_passes: int = 500) -> LogisticModels:
    """A logistic regression for each (split number, C): L2 penalty 1 / (C n) on features scaled to the split's mean and deviation, a free intercept.

    ``rows`` has features (array of doubles, one length), label (0 or 1) and splits (the numbers of the splits that a row trains); ``names`` are the
    splits' names. Rows without features or label are left out. The same as a scaler and a logistic regression of pyspark.ml fitted
    on each split by itself. A split needs two rows with features that differ, others give coefficients of 0 where they don't.
    """
    ship(rows.sparkSession)
    rows = rows.select(F.transform("features", lambda x: x.cast("double")).alias("features"), F.col("label").cast("double").alias("label"), F.col("splits").cast("array<long>").alias("splits"))
    rows = materialise(rows.where("features is not null and label is not null"), "training")
    count = len(names)

    def moments(x, y, splits):
        mask = _mask(splits, count)
        return np.concatenate([mask.sum(0)[:, None], mask.T @ x, mask.T @ (x * x)], 1)

    sums = _summed(rows, moments, count)
    if not len(sums):
        raise ValueError("no rows to train on")
    n, d = sums[:, 0], (sums.shape[1] - 1) // 2
    mean = sums[:, 1 : d + 1] / np.maximum(n, 1)[:, None]
    variance = np.maximum(sums[:, d + 1 :] - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None]
    inverse = np.divide(1, np.sqrt(variance), out=np.zeros_like(variance), where=variance > 1e-24)  # a constant feature counts for nothing
    of = np.array([s for s, _ in wanted])
    penalty = np.array([1 / (c * max(n[s], 1)) for s, c in wanted])
    descents, passes = [_Descent(np.zeros(d + 1)) for _ in wanted], 0
    while passes < most_passes and (live := [k for k, m in enumerate(descents) if not m.done]):
        w = np.array([descents[k].at for k in live])
        scale, centre, at = inverse[of[live]], mean[of[live]], of[live]
        raw = w[:, :d] * scale  # on the features as they are
        shift = w[:, d] - (raw * centre).sum(1)

        def losses(x, y, splits, raw=raw, shift=shift, at=at):
            mask = _mask(splits, count)[:, at]
            margin = x @ raw.T + shift
            off = mask * (1 / (1 + np.exp(-margin)) - y[:, None])
            loss = (mask * (np.logaddexp(0, margin) - y[:, None] * margin)).sum(0)
            return np.concatenate([loss[:, None], off.sum(0)[:, None], off.T @ x], 1)

        found = _summed(rows, losses, len(live))
        passes += 1
        for row, k in enumerate(live):
            size, m = max(n[of[k]], 1), descents[k]
            loss = found[row, 0] / size + penalty[k] / 2 * float(w[row, :d] @ w[row, :d])
            slope = (found[row, 2:] - centre[row] * found[row, 1]) * scale[row] / size + penalty[k] * w[row, :d]
            m.told(loss, np.append(slope, found[row, 1] / size))
    x = np.array([m.x for m in descents])
    coefficients = x[:, :d] * inverse[of]
    intercepts = x[:, d] - (coefficients * mean[of]).sum(1)
    return LogisticModels([names[s] for s, _ in wanted], [float(c) for _, c in wanted], coefficients, intercepts, passes)


def fit_best_many(rows: DataFrame, assignments: DataFrame, penalties: list[float], select_by: str = "auprc") -> dict:
    """For every split the best C by a metric on val (ties: the first; undefined counts as -1), refitted on train and val: as ``fit_best`` does for one.

    ``rows`` has id, features and label, ``assignments`` (split, id, partition). Returns params ({split: C}), model (of the refits), and
    metrics, a table by split and partition. Train and val of all splits are fitted and scored together, twice.
    """
    held = assignments.join(rows.where("features is not null and label is not null"), "id")
    held = materialise(held.select("split", "id", "partition", "features", "label"), "assigned")
    names = sorted(r[0] for r in held.select("split").distinct().collect())
    number = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("split")) - 1

    def fitted(parts: list[str], wanted: list) -> LogisticModels:
        members = held.where(F.col("partition").isin(parts)).groupBy("id").agg(F.first("features").alias("features"), F.first("label").alias("label"), F.collect_set(number).alias("splits"))
        return fit_many(members, wanted, names)

    def judged(model: LogisticModels, keys: list[str], where=None) -> DataFrame:
        some = held if where is None else held.where(where)
        each = model.predict(some.withColumn("own", F.col("split")), "own", "partition", "label").where("split = own").drop("own")
        scored = metrics.threshold(each.withColumn("y_true", F.col("label").cast("int")))
        out = metrics.binary_metrics(scored, keys)
        for more in (metrics.auroc(scored, keys), metrics.average_precision(scored, keys)):
            out = out.join(more, keys)
        return out

    grid = [(s, c) for s in range(len(names)) for c in penalties]
    best: dict = {}
    for r in judged(fitted(["train"], grid), ["split", "C"], "partition = 'val'").collect():
        score = -1.0 if r[select_by] is None else r[select_by]
        key = (-score, penalties.index(r["C"]))
        best[r["split"]] = min(best.get(r["split"], key), key)
    params = {s: penalties[best[s][1]] if s in best else penalties[0] for s in names}
    final = fitted(["train", "val"], [(k, params[s]) for k, s in enumerate(names)])
    return {"params": params, "model": final, "metrics": judged(final, ["split", "partition"])}
