"""Models of many splits in one pass against models fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwarden.ml import many, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6)) * np.array([1, 5, 0.1, 2, 1, 0]) + np.array([0, 3, 9, -1, 0, 4])  # the last feature is constant
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=400) > 0.7).astype(float)
    return spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label double").cache()


def assigned(rows, splits):
    part = F.expr("case when pmod(xxhash64(split, id), 10) < 6 then 'train' when pmod(xxhash64(split, id), 10) < 8 then 'val' else 'test' end")
    return rows.select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"), "id").withColumn("partition", part)


def test_many_models_equal_single_fits(spark, rows):
    names, penalties = ["s1", "s2", "s3"], [0.1, 1.0, 10.0]
    parts = assigned(rows, names).where("partition = 'train'")
    number = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("split")) - 1
    members = rows.join(parts.groupBy("id").agg(F.collect_set(number).alias("splits")), "id", "left")
    wanted = [(s, c) for s in range(3) for c in penalties]
    got = many.fit_many(members, wanted, names)
    assert got.splits == [names[s] for s, _ in wanted] and got.penalties == [c for _, c in wanted]
    for k, (s, c) in enumerate(wanted):
        train = models.features(rows.join(parts.where(F.col("split") == names[s]).select("id"), "id").withColumnRenamed("features", "embedding"))
        scaler, logistic = models.estimator("lr", train.count(), C=c).fit(train).stages
        w = np.divide(logistic.coefficients.toArray(), scaler.std.toArray(), out=np.zeros(6), where=scaler.std.toArray() > 0)
        assert np.allclose(got.coefficients[k], w, atol=1e-4) and got.intercepts[k] == pytest.approx(logistic.intercept - w @ scaler.mean.toArray(), abs=1e-3)
    alone = [many.fit_many(members, [one], names) for one in (wanted[0], wanted[-1])]
    assert np.allclose(alone[1].coefficients[0], got.coefficients[-1], atol=1e-6)
    assert got.passes <= 2 * max(a.passes for a in alone)  # nine models take about as many passes as one


def test_best_of_every_split(spark, rows):
    names, penalties = ["a", "b"], [0.001, 1.0]
    parts = assigned(rows, names)
    best = many.fit_best_many(rows, parts, penalties)
    found = {(r.split, r.partition): r for r in best["metrics"].collect()}
    assert set(found) == {(s, p) for s in names for p in ("train", "val", "test")}
    for s in names:
        df = models.features(rows.join(parts.where(F.col("split") == s).select("id", "partition"), "id").withColumnRenamed("features", "embedding"))
        one = models.fit_best(df, "lr", [{"C": c} for c in penalties])
        assert one["params"] == {"C": best["params"][s]}
        for p in ("train", "val", "test"):
            assert all(found[s, p][m] == pytest.approx(one["metrics"][p][m], abs=1e-3) for m in models.METRICS)


def test_awkward_rows(spark):
    rows = [(1, None, 1.0, [0]), (2, [1.0], None, [0]), (3, [1.0], 1.0, None), (4, [2.0], 0.0, []), (5, [1.0], 0.0, [0]), (6, [3.0], 1.0, [0]), (6, [3.0], 1.0, [0])]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, splits array<long>")
    got = many.fit_many(df, [(0, 1.0), (1, 1.0)], ["x", "empty"])
    assert got.coefficients[0, 0] > 0 == got.coefficients[1, 0] and np.isfinite(got.intercepts).all()
    assert got.predict(df.where("features is not null"), "id").count() == 12
    with pytest.raises(ValueError, match="no rows"):
        many.fit_many(df.limit(0), [(0, 1.0)], ["x"])
