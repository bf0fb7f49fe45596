"""Calibration of scores: Platt, isotonic and temperature."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _logit(p):
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(q / (1 - q))


def temperature(val: DataFrame, low: float = 0.05, high: float = 20.0, rounds: int = 4, points: int = 25) -> float:
    """The temperature of least log-loss, by a grid that narrows; a round is one aggregation over all its points."""
    rows = val.select(_logit(F.col("y_prob")).alias("z"), F.col("y_true").cast("double").alias("y")).persist()
    for _ in range(rounds):
        grid = [low * (high / low) ** (k / (points - 1)) for k in range(points)]
        loss = lambda t: F.avg(F.log1p(F.exp(-F.abs(F.col("z") / t))) + F.greatest(F.col("z") / t, F.lit(0.0)) - F.col("y") * F.col("z") / t)
        found = rows.agg(*[loss(t).alias(str(k)) for k, t in enumerate(grid)]).first()
        best = min(range(points), key=lambda k: found[k])
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    rows.unpersist()
    return (low * high) ** 0.5


def calibrate(val: DataFrame, scored: DataFrame, method: str = "platt") -> DataFrame:
    """``scored`` with y_prob calibrated on ``val`` (y_true, y_prob)."""
    if method == "temperature":
        return scored.withColumn("y_prob", 1 / (1 + F.exp(-_logit(F.col("y_prob")) / temperature(val))))
    if method == "platt":
        with_z = lambda df: df.withColumn("__z", array_to_vector(F.array(_logit(F.col("y_prob")))))
        model = LogisticRegression(
            featuresCol="__z", labelCol="__y", predictionCol="__p", rawPredictionCol="__r", probabilityCol="__q"
        ).fit(with_z(val).withColumn("__y", F.col("y_true").cast("double")))
        return model.transform(with_z(scored)).withColumn("y_prob", vector_to_array("__q")[1]).drop("__z", "__p", "__r", "__q")
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="y_prob", labelCol="__y", predictionCol="__p").fit(val.withColumn("__y", F.col("y_true").cast("double")))
        return model.transform(scored).withColumn("y_prob", F.col("__p")).drop("__p")
    raise NotImplementedError(f"calibration {method}; there are platt, isotonic and temperature")
