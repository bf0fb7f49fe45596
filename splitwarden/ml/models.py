"""Estimators, grids, and selection on a given validation part."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logistic
from ..operators import metrics
from ..operators.similarity import knn

METRICS = ("accuracy", "balanced_accuracy", "f1", "mcc", "auroc", "auprc")
#: The grids searched by default, and the wide ones.
GRIDS = {
    "rf": {"n_estimators": [500], "max_depth": [None], "min_samples_split": [2], "min_samples_leaf": [1], "class_weight": ["balanced"]},
    "svm": {"C": [1.0], "kernel": ["rbf"], "gamma": ["scale"]},
    "knn": {"n_neighbors": [5, 15], "weights": ["uniform", "distance"]},
    "lr": {"C": [1.0, 0.3, 3.0]},
}
WIDE_GRIDS = {
    "rf": {"n_estimators": [200, 500], "max_depth": [None, 20], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2], "class_weight": [None, "balanced"]},
    "svm": {"C": [0.3, 1.0, 3.0], "kernel": ["rbf", "linear"], "gamma": ["scale"]},
    "knn": {"n_neighbors": [3, 5, 11, 21], "weights": ["uniform", "distance"], "p": [1, 2]},
    "lr": {"C": [0.1, 0.3, 1.0, 3.0, 10.0]},
}


def grid(model: str, wide: bool = False, **axes) -> list[dict]:
    """All combinations of a model's axes, in order; given axes replace the default ones."""
    known = WIDE_GRIDS if wide else GRIDS
    if model not in known:
        raise NotImplementedError(f"no model {model}; there are {', '.join(known)}")
    space = known[model] | axes
    return [dict(zip(space, values)) for values in product(*space.values())]


def features(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the RBF kernel exp(-gamma |x - y|^2); gamma 0 stands for 1 / dimensions, the scale of scaled features."""

    gamma = Param(Params._dummy(), "gamma", "kernel width, 0: 1 / dimensions", typeConverter=TypeConverters.toFloat)
    dims = Param(Params._dummy(), "dims", "number of features", typeConverter=TypeConverters.toInt)

    def __init__(self, inputCol: str = "scaled", outputCol: str = "fourier", gamma: float = 0.0, dims: int = 512, seed: int = 42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, dims=dims, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, dims, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.dims), self.getSeed()

        @F.pandas_udf("array<double>")
        def mapped(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_list())
            rng = np.random.default_rng(seed)
            w = rng.standard_normal((x.shape[1], dims)) * np.sqrt(2 * (gamma or 1 / x.shape[1]))
            return pd.Series(list(np.sqrt(2 / dims) * np.cos(x @ w + rng.uniform(0, 2 * np.pi, dims))))

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


class Neighbours:
    """k nearest neighbours on scaled features; ``fit`` gives a model with ``transform``, as a pipeline does.

    Rows need a unique long column ``id``. Weights are uniform or by inverse distance, where rows at distance 0 outvote all others; p is 1
    (Manhattan) or 2 (Euclidean). A row of the training part is among its own neighbours, as it is for other models.
    """

    def __init__(self, n_neighbors: int = 5, weights: str = "uniform", p: int = 2):
        if weights not in ("uniform", "distance") or p not in (1, 2):
            raise ValueError("weights is 'uniform' or 'distance', p is 1 or 2")
        self.n_neighbors, self.weights, self.p, self.scaler, self.rows = n_neighbors, weights, p, None, None

    def _scaled(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(df).select("id", vector_to_array("scaled").alias("embedding"))

    def fit(self, df: DataFrame) -> Neighbours:
        fitted = Neighbours(self.n_neighbors, self.weights, self.p)
        fitted.scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(df)
        fitted.rows = df.select("id", "features", "label")
        return fitted

    def transform(self, df: DataFrame) -> DataFrame:
        found = knn(self._scaled(df), self._scaled(self.rows), self.n_neighbors, metric={1: "manhattan", 2: "euclidean"}[self.p], leave_out=False)
        votes = found.join(self.rows.select(F.col("id").alias("b"), F.col("label").alias("vote")), "b")
        nearest = F.min("distance").over(Window.partitionBy("a"))
        weight = F.lit(1.0) if self.weights == "uniform" else F.when(nearest == 0, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
        share = votes.withColumn("w", weight).groupBy("a").agg((F.sum(F.when(F.col("vote") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("y_prob"))
        return df.join(share.withColumnRenamed("a", "id"), "id")


def estimator(
    model: str, rows: int, seed: int = 42, C: float = 1.0, kernel: str = "rbf", gamma: str | float = "scale", n_estimators: int = 500, max_depth: int | None = None,
    min_samples_split: int = 2, min_samples_leaf: int = 1, class_weight: str | None = None, n_neighbors: int = 5, weights: str = "uniform", p: int = 2,
):
    """What fits a model with these settings; all but rf scale their features first.

    rf trees without a depth limit stop at 30, the deepest that pyspark.ml grows, and a node keeps max(leaf, split / 2) rows, since
    there is no limit on the node that is split. svm is linear on 512 random Fourier features of its RBF kernel, or on the features
    themselves, and its probabilities are Platt's, fitted on the margins. class_weight='balanced' needs balance() rows.
    """
    weight = {"weightCol": "weight"} if class_weight == "balanced" else {}
    scale = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled")
    if model == "lr":
        return Pipeline(stages=[scale, LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1 / (C * rows), maxIter=200, **weight)])
    if model == "svm":
        if kernel not in ("rbf", "linear"):
            raise NotImplementedError(f"kernel {kernel}; there are rbf and linear")
        mapped = [FourierFeatures(gamma=0.0 if gamma == "scale" else float(gamma), seed=seed)] if kernel == "rbf" else []
        machine = LinearSVC(
            featuresCol="fourier" if mapped else "scaled", labelCol="label", regParam=1 / (C * rows), maxIter=100, rawPredictionCol="margin",
            predictionCol="side", **weight
        )
        return Pipeline(stages=[scale, *mapped, machine, LogisticRegression(featuresCol="margin", labelCol="label")])
    if model == "rf":
        least = max(min_samples_leaf, -(-min_samples_split // 2))
        return Pipeline(
            stages=[
                RandomForestClassifier(
                    labelCol="label", numTrees=n_estimators, maxDepth=30 if max_depth is None else max_depth, minInstancesPerNode=least, seed=seed, **weight
                )
            ]
        )
    if model == "knn":
        return Neighbours(n_neighbors, weights, p)
    raise NotImplementedError(f"no model {model}; there are {', '.join(GRIDS)}")


def balance(df: DataFrame) -> DataFrame:
    """A weight for each row, under which both labels weigh alike."""
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col("label") == k, total / (len(counts) * n)) for k, n in counts.items()])
    return df.withColumn("weight", weight)


def probabilities(scored: DataFrame) -> DataFrame:
    """y_prob: the probability of label 1, or the logistic of the decision score where the model has no probability."""
    if "y_prob" in scored.columns:
        return scored
    if "probability" in scored.columns:
        return scored.withColumn("y_prob", vector_to_array("probability")[1])
    return scored.withColumn("y_prob", logistic(vector_to_array("rawPrediction")[1]))


def predict(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    rows = probabilities(model.transform(df)).withColumn("y_true", F.col("label").cast("int"))
    return metrics.threshold(rows, at=threshold)


def evaluate(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """The six metrics of each group of predictions (y_true, y_prob, y_pred)."""
    rows = predictions.select(*keys, "y_true", "y_prob", "y_pred")
    out = metrics.binary_metrics(rows, keys)
    for part in (metrics.auroc(rows, keys), metrics.average_precision(rows, keys)):
        out = out.join(part, keys) if keys else out.crossJoin(part)  # one row each without keys
    return out


def fit_best(df: DataFrame, model: str, candidates: list[dict] | None = None, select_by: str = "auprc", seed: int = 42, balanced: bool = False) -> dict:
    """Fits each candidate on train, takes the best on val (ties: the first; undefined counts as -1), and refits it on train and val.

    ``df`` has features, label and partition (and id for knn). With ``balanced`` every candidate weighs its labels alike; otherwise
    those do that ask for it by class_weight. Returns params, search (val metrics before the refit), model, and metrics of all parts
    after it; only the search metrics of val are free of training rows.
    """
    more = {"class_weight": "balanced"} if balanced else {}
    df = balance(df).persist()
    train, val = df.where("partition = 'train'"), df.where("partition = 'val'")
    n_train, best = train.count(), None
    for params in candidates or grid(model):
        fitted = estimator(model, n_train, seed, **params | more).fit(train)
        found = evaluate(predict(fitted, val).withColumn("partition", F.lit("val")), ["partition"]).first().asDict()
        score = -1.0 if found[select_by] is None else found[select_by]
        if best is None or score > best["score"]:
            best = {"params": params, "score": score, "search": found}
    both = df.where("partition in ('train', 'val')")
    final = estimator(model, both.count(), seed, **best["params"] | more).fit(both)
    predictions = predict(final, df)
    return best | {
        "model": final, "predictions": predictions, "metrics": {r.partition: {m: r[m] for m in METRICS} for r in evaluate(predictions, ["partition"]).collect()}
    }


def clusters(df: DataFrame, k: int = 200, seed: int = 0, normalise: bool = True) -> DataFrame:
    """``df`` with cluster_id from k-means on its features."""
    column = "features"
    if normalise:
        df, column = Normalizer(inputCol="features", outputCol="unit", p=2.0).transform(df), "unit"
    model = KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster_id").fit(df)
    return model.transform(df).drop("unit")
