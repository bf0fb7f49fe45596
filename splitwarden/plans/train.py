"""Executes a train specification on rows with features, label and partition: task and model family, cross-validation, calibration, metrics."""

from __future__ import annotations

import inspect

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ml import models
from ..ml.calibration import calibrate
from ..operators import metrics, splits
from ..spec.schema import Spec
from .compile import CUSTOM

CLASSIFICATION = {
    "accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "f1": "f1", "mcc": "mcc", "auroc": "auroc", "roc_auc": "auroc", "auprc": "auprc",
    "pr_auc": "auprc"
}
REGRESSION = {"rmse": "rmse", "mae": "mae", "r2": "r2"}


def _settings(f, given: dict, seed: int) -> dict:
    """The hyperparameters under the names that ``f`` takes; one that it doesn't take is an error, random_state is the seed."""
    known, given = set(inspect.signature(f).parameters), dict(given)
    seed = given.pop("random_state", seed)
    if unknown := set(given) - known:
        raise ValueError(f"hyperparameters without a counterpart: {', '.join(sorted(unknown))}")
    return given | {"seed": seed}


def _classifier(family: str, df: DataFrame, hyperparams: dict, seed: int):
    names = {"linear": "lr", "rf": "rf", "svm": "svm"}
    if family in names:
        return models.estimator(names[family], df.count(), **_settings(models.estimator, hyperparams, seed))
    if family == "xgb":
        return boosted(GBTClassifier, **_settings(boosted, hyperparams, seed))
    return network(len(df.select("features").first()[0]), **_settings(network, hyperparams, seed))


def boosted(kind, n_estimators: int = 50, max_depth: int = 5, learning_rate: float = 0.1, seed: int = 42):
    """Gradient-boosted trees."""
    return kind(featuresCol="features", labelCol="label", maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=seed)


def network(dims: int, hidden: tuple = (32,), max_iter: int = 100, seed: int = 42) -> Pipeline:
    """A perceptron with hidden layers, on scaled features, for two classes."""
    scale = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled")
    return Pipeline(
        stages=[scale, MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[dims, *hidden, 2], maxIter=max_iter, seed=seed)]
    )


def forest(n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol="label", numTrees=n_estimators, maxDepth=30 if max_depth is None else max_depth, minInstancesPerNode=min_samples_leaf, seed=seed
    )


def linear(alpha: float = 0.0, l1_ratio: float = 0.0, seed: int = 42) -> LinearRegression:
    """Least squares with elastic-net penalty; ``seed`` has no effect."""
    return LinearRegression(labelCol="label", regParam=alpha, elasticNetParam=l1_ratio)


def centres(n_clusters: int = 8, max_iter: int = 20, seed: int = 42) -> KMeans:
    return KMeans(k=n_clusters, maxIter=max_iter, seed=seed, predictionCol="cluster_id")


def compile_train(spec: Spec, df: DataFrame):
    """What fits the task with the family; custom ones come from CUSTOM under train:<task>:<family>, all that pyspark.ml lacks is an error."""
    task, family = spec.task, spec.model_family
    if f"train:{task}:{family}" in CUSTOM:
        return CUSTOM[f"train:{task}:{family}"](df, spec)
    if task == "classification" and family in ("linear", "rf", "svm", "xgb", "nn"):
        return _classifier(family, df, spec.hyperparams, spec.seed)
    if task == "regression" and family in ("linear", "rf", "xgb"):
        if family == "xgb":
            return boosted(GBTRegressor, **_settings(boosted, spec.hyperparams, spec.seed))
        f = {"linear": linear, "rf": forest}[family]
        return f(**_settings(f, spec.hyperparams, spec.seed))
    if task == "unsupervised" and family == "linear":
        return centres(**_settings(centres, spec.hyperparams, spec.seed))
    raise NotImplementedError(f"{task} with {family} has no counterpart in pyspark.ml; register a callable as train:{task}:{family}")


def metric_names(spec: Spec) -> dict[str, str]:
    """The spec's metric -> the column that holds it."""
    known = {"classification": CLASSIFICATION, "regression": REGRESSION}.get(spec.task, {})
    if unknown := [m for m in spec.metrics if m.lower() not in known]:
        raise ValueError(f"metrics unknown to {spec.task}: {', '.join(unknown)}")
    return {m: known[m.lower()] for m in spec.metrics}


def score(spec: Spec, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the spec's metrics."""
    if spec.task == "regression":
        found = metrics.regression_metrics(predictions, keys, "label", "prediction")
    else:
        found = models.evaluate(predictions, keys)
    return found.select(*keys, *[F.col(c).alias(m) for m, c in metric_names(spec).items()])


def _predict(spec: Spec, fitted, df: DataFrame) -> DataFrame:
    return models.predict(fitted, df) if spec.task == "classification" else fitted.transform(df)


def fold_of(df: DataFrame, spec: Spec, id_col: str, time: str | None = None) -> DataFrame:
    """``df`` with fold, by the spec's cross-validation."""
    cv = spec.cross_validation
    if cv.strategy == "kfold":
        return splits.kfold(df, id_col, cv.folds, spec.seed)
    if cv.strategy == "stratified_kfold":
        return splits.kfold(df, id_col, cv.folds, spec.seed, stratum="label")
    if cv.strategy == "group_kfold":
        return splits.group_kfold(df, cv.group_field, cv.folds, spec.seed)
    if cv.strategy == "time_series":
        if not time:
            raise ValueError("time_series needs the column of the time")
        return splits.time_series_folds(df, time, cv.folds)
    return CUSTOM["cv:custom"](df, spec)


def cross_validate(df: DataFrame, spec: Spec, id_col: str = "id", time: str | None = None) -> DataFrame:
    """(fold, metrics) of each fold by a model of the others; with time_series of the earlier ones, so the first has none."""
    rows = fold_of(df, spec, id_col, time).persist()
    earlier = spec.cross_validation.strategy == "time_series"
    scored = None
    for k in range(1 if earlier else 0, spec.cross_validation.folds):
        rest = rows.where(F.col("fold") < k) if earlier else rows.where(F.col("fold") != k)
        fitted = compile_train(spec, rest).fit(rest)
        found = score(spec, _predict(spec, fitted, rows.where(F.col("fold") == k)), ["fold"])
        scored = found if scored is None else scored.unionByName(found)
    return scored


def run_train(df: DataFrame, spec: Spec, id_col: str = "id", time: str | None = None) -> dict:
    """{model, predictions, metrics by part, folds}: fitted on train, calibrated on val where the spec asks for it, scored on all parts."""
    df = (models.balance(df) if spec.task == "classification" else df).persist()
    train = df.where("partition = 'train'")
    fitted = compile_train(spec, train).fit(train)
    predictions = _predict(spec, fitted, df)
    if spec.calibration and spec.calibration.enabled:
        val = predictions.where("partition = 'val'").select("y_true", "y_prob")
        calibrated = CUSTOM["calibration:custom"](val, predictions) if spec.calibration.method == "custom" else calibrate(
            val, predictions, spec.calibration.method
        )
        predictions = metrics.threshold(calibrated)
    found = {} if spec.task == "unsupervised" else {r["partition"]: {m: r[m] for m in spec.metrics} for r in score(spec, predictions, ["partition"]).collect()}
    folds = None
    if spec.cross_validation and spec.cross_validation.enabled:
        folds = cross_validate(train, spec, id_col, time)
    return {"model": fitted, "predictions": predictions, "metrics": found, "folds": folds}
