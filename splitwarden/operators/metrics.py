"""Evaluation of predictions, for any number of groups (strategy, seed, model) in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from .ranking import sliced


def threshold(df: DataFrame, prob: str = "y_prob", at: float = 0.5) -> DataFrame:
    return df.withColumn("y_pred", (F.col(prob) >= at).cast("int"))


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    def count(t, p):
        return F.count(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), 1)).cast("double")

    return df.groupBy(*keys).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn"))


def binary_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, balanced_accuracy (classes that occur), f1 and mcc (0 where undefined) from y_true and y_pred."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall_1, recall_0 = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    both = F.when(recall_1.isNull(), recall_0).when(recall_0.isNull(), recall_1).otherwise((recall_1 + recall_0) / 2)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return confusion(df, keys).select(
        *keys, F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), both.alias("balanced_accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0)).alias("mcc"),
    )


def score_steps(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct score: rows n, positives p, both cumulated from the highest score (cn, cp), and totals (total, pos).

    Scores are grouped first, so ties are one row and map-side aggregation does most of the work. Cumulative sums run within sampled
    ranges of keys and score and are completed by the ranges' totals, so a group of many scores meets in no single task, however close they
    are. Rows without a score count in the totals only.
    """
    steps = df.groupBy(*keys, F.col("y_prob").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("y_true").cast("long")).alias("p"))
    steps = sliced(steps, keys, [F.col("score").desc()]).withColumnRenamed("__slice", "slice")
    slices = steps.groupBy(*keys, "slice").agg(F.sum("n").alias("sn"), F.sum("p").alias("sp"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *[F.col(k).alias(f"k_{k}") for k in keys], F.col("slice").alias("k_slice"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("an"),
        F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("ap"), F.sum("sn").over(group).alias("total"), F.sum("sp").over(group).alias("pos")
    )
    match = F.col("slice") == F.col("k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    within = Window.partitionBy(*keys, "slice").orderBy(F.col("score").desc())
    steps = steps.where(F.col("score").isNotNull()).withColumn("wn", F.sum("n").over(within)).withColumn("wp", F.sum("p").over(within)).join(slices, match)
    return steps.select(*keys, "score", "n", "p", (F.col("an") + F.col("wn")).alias("cn"), (F.col("ap") + F.col("wp")).alias("cp"), "total", "pos")


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve, ties count half; null where a class is absent."""
    s = score_steps(df, keys)
    area = F.sum((F.col("n") - F.col("p")) * (F.col("cp") - F.col("p") + F.col("p") / 2.0))
    return s.groupBy(*keys).agg(area.alias("area"), F.max("pos").alias("pos"), F.max("total").alias("total")).select(
        *keys, F.try_divide(F.col("area"), (F.col("pos") * (F.col("total") - F.col("pos"))).cast("double")).alias("auroc")
    )


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision by steps of recall, without interpolation; null without positives."""
    s = score_steps(df, keys)
    return s.groupBy(*keys).agg(F.sum(F.try_divide(F.col("p").cast("double"), F.col("pos").cast("double")) * F.col("cp") / F.col("cn")).alias("auprc"))


def calibration_curve(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Rows, mean score and share of positives of each non-empty bin; a score on an inner edge belongs to the bin below it."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    bin_ = sum((F.when(F.col("y_prob") > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn("bin", bin_.cast("int")).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg("y_prob").alias("mean_predicted"), F.avg(F.col("y_true").cast("double")).alias("fraction_positive")
    )


def errors(df: DataFrame) -> DataFrame:
    return df.where(F.col("y_true") != F.col("y_pred"))


def error_jaccard(df: DataFrame, seed: str, id_col: str, seeds: DataFrame) -> DataFrame:
    """(seed_a, seed_b, jaccard) of the error sets of every two seeds: 1 on the diagonal and where both are empty.

    Intersections come from an inverted index: rows meet only where two seeds err on one id. ``seeds`` is a table of seeds, so
    the pairs are few.
    """
    wrong = errors(df).select(F.col(seed).alias("s"), F.col(id_col).alias("i")).distinct()
    sizes = seeds.select(F.col(seed).alias("s")).distinct().join(
        wrong.groupBy("s").agg(F.count("*").alias("n")), "s", "left"
    ).select("s", F.coalesce("n", F.lit(0)).alias("n"))
    lists = wrong.groupBy("i").agg(F.array_sort(F.collect_list("s")).alias("held"))
    both = lists.select("held", F.explode("held").alias("seed_a")).select(
        "seed_a", F.explode("held").alias("seed_b")
    ).groupBy("seed_a", "seed_b").agg(F.count("*").alias("shared"))
    grid = sizes.select(F.col("s").alias("seed_a"), F.col("n").alias("na")).crossJoin(sizes.select(F.col("s").alias("seed_b"), F.col("n").alias("nb")))
    out = grid.join(both, ["seed_a", "seed_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return out.select(
        "seed_a", "seed_b", F.when(union == 0, 1.0).otherwise(F.try_divide(F.col("shared").cast("double"), union.cast("double"))).alias("jaccard")
    )


def regression_metrics(df: DataFrame, keys: list[str], truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """rmse, mae and r2 (null where the truth is constant)."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"), F.avg(F.abs(t - p)).alias("mae"),
        (1 - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t))).alias("r2")
    )
