"""Every relational query against its SQL on DuckDB, and invariants that SQL doesn't state."""

import duckdb
import pytest
from pyspark.sql import functions as F

from splitwarden import catalog
from splitwarden.operators import cleaning, fragility, metrics, splits
from splitwarden.operators.similarity import knn
from splitwarden.plans import compile as plans
from splitwarden.sources import tables
from splitwarden.spec.schema import parse

NAMES = "region nation customer supplier part orders lineitem events documents embeddings labels"


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in NAMES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (a == pytest.approx(b, rel=1e-9, abs=1e-6) or a != a and b != b)
    return a == b


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) and len(catalog.QUERIES) > 80


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = db.execute(catalog.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    rows = sorted(want.fetchall(), key=str)
    assert len(got) == len(rows)
    if got != rows:
        assert all(same(x, y) for a, b in zip(got, rows) for x, y in zip(a, b))


def test_issue_sort_all_returns_every_issue_in_order(spark, db, sf_dir):
    got = [tuple(r) for r in catalog.QUERIES["issue_sort_all"](spark, sf_dir).collect()]
    assert got == db.execute(catalog.ORACLE["issue_sort_all"]).fetchall()
    assert len(got) == db.execute("select count(*) from events").fetchone()[0] > 100


# ---- splits ----


def test_split_sizes_and_determinism(spark):
    df = spark.range(1003).withColumnRenamed("id", "doc")
    one = {r.doc: r.partition for r in splits.random_split(df, "doc", 7).collect()}
    assert one == {r.doc: r.partition for r in splits.random_split(df.repartition(9), "doc", 7).collect()}
    sizes = [list(one.values()).count(p) for p in ("train", "val", "test")]
    assert sizes == [round(0.8 * 1003), round(0.1 * 1003), 1003 - round(0.8 * 1003) - round(0.1 * 1003)]
    assert one != {r.doc: r.partition for r in splits.random_split(df, "doc", 8).collect()}


def test_published_stratified_counts(spark):
    """6021 and 3979 rows of two labels give 4817/602/602 and 3183/398/398."""
    df = spark.range(10000).withColumn("y", (F.col("id") < 3979).cast("int"))
    got = {(r.partition, r.y): r.n for r in splits.label_counts(splits.stratified_split(df, "id", "y", 1), "partition", "y").collect()}
    assert got == {("train", 0): 4817, ("val", 0): 602, ("test", 0): 602, ("train", 1): 3183, ("val", 1): 398, ("test", 1): 398}


def test_greedy_clusters_equal_the_loop(spark):
    import hashlib

    sizes = {f"c{k}": 1 + k * k % 17 for k in range(40)}
    df = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "c string")
    total, filled, want = sum(sizes.values()), {"test": 0, "val": 0}, {}
    goal = {"test": round(0.2 * total), "val": round(0.1 * total)}
    for c in sorted(sizes, key=lambda c: (hashlib.md5(f"{c}:42".encode()).hexdigest(), c)):
        part = next((p for p in ("test", "val") if filled[p] < goal[p]), "train")
        want[c] = part
        if part in filled:
            filled[part] += sizes[c]
    assert {r.c: r.partition for r in splits.greedy_clusters(df, "c").collect()} == want


def test_temporal_split_keeps_ties(spark):
    df = spark.createDataFrame([(i, i // 10) for i in range(100)], "id long, t long")
    rows = splits.temporal_split(df, "t").collect()
    assert all(len({r.partition for r in rows if r.t == t}) == 1 for t in range(10))
    assert max(r.t for r in rows if r.partition == "train") < min(r.t for r in rows if r.partition == "test")


def test_folds_are_balanced_and_disjoint(spark):
    df = spark.range(103)
    counts = [r["count"] for r in splits.kfold(df, "id", 5).groupBy("fold").count().collect()]
    assert sorted(counts) == [20, 20, 21, 21, 21]


def test_stratified_sample_bounds(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 5, "rare").otherwise("common"))
    got = cleaning.stratified_sample(df, "id", "y", 50, 3).collect()
    assert 48 <= len(got) <= 50 and cleaning.stratified_sample(df, "id", "y", 5000, 3).count() == 1000


# ---- metrics ----


def test_metrics_against_plain_versions(spark):
    import random

    rng = random.Random(1)
    rows = [(k % 2, int(rng.random() < 0.4), rng.choice([0.0, 0.1, 0.2, 0.30000000000000004, 0.5, 0.9, 1.0])) for k in range(400)] + [(2, 1, 0.5)] * 3
    df = metrics.threshold(spark.createDataFrame(rows, "g int, y_true int, y_prob double"))
    area, ap = ({r.g: r[1] for r in f(df, ["g"]).collect()} for f in (metrics.auroc, metrics.average_precision))
    for g in (0, 1):
        pos, neg = ([p for k, y, p in rows if k == g and y == c] for c in (1, 0))
        assert area[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
        mine = [(p, y) for k, y, p in rows if k == g]
        want = 0.0
        for t in sorted({p for p, _ in mine}, reverse=True):
            here = [y for p, y in mine if p >= t]
            want += sum(y for p, y in mine if p == t) / len(pos) * sum(here) / len(here)
        assert ap[g] == pytest.approx(want)
    assert area[2] is None and ap[2] == 1.0
    m = {r.g: r for r in metrics.binary_metrics(df, ["g"]).collect()}
    assert (m[2].accuracy, m[2].balanced_accuracy, m[2].f1, m[2].mcc) == (1.0, 1.0, 1.0, 0.0)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(p, 1) for p in (0.0, 0.1, 0.3, 0.30000000000000004, 0.7, 1.0)], "y_prob double, y_true int")
    assert sorted((r.bin, r.n) for r in metrics.calibration_curve(df, []).collect()) == [(0, 2), (2, 2), (6, 1), (9, 1)]


def test_jaccard_edges(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 0), (1, "b", 1, 1), (2, "a", 1, 1), (3, "b", 0, 0), (4, "a", 1, 0), (4, "c", 1, 0)], "seed int, i string, y_true int, y_pred int"
    )
    got = {(r.seed_a, r.seed_b): r.jaccard for r in metrics.error_jaccard(df, "seed", "i", df.select("seed")).collect()}
    assert len(got) == 16 and got[1, 4] == 0.5 and got[2, 3] == 1.0 and got[1, 2] == 0.0 and all(got[k, k] == 1.0 for k in range(1, 5))


def test_fragility_ignores_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan"))], "k string, x double")
    r = fragility.fragility_stats(df, ["k"], "x").first()
    assert (r.n, r["mean"], r["std"], r["range"], r.cv) == (3, 2.0, 1.0, 2.0, 0.5)
    assert fragility.best_by(df.withColumn("o", F.lit(1)), ["k"], "x", "o").first().x == 3.0


def test_pivot_rejects_repeated_cells(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 2.0)], "i string, c string, v double")
    with pytest.raises(Exception, match="repeat"):
        fragility.pivot(df, "i", "c", "v", ["p"]).collect()


def test_knn_excludes_itself_among_duplicates(spark):
    df = spark.createDataFrame([(k, [float(k // 2), 1.0]) for k in range(8)], "id long, embedding array<float>")
    rows = knn(df, df, 2, rows_per_block=3).collect()
    assert len(rows) == 16 and all(r.a != r.b for r in rows) and all(r.b == r.a ^ 1 and r.distance == 0 for r in rows if r["rank"] == 1)


# ---- cleaning, plans, sources ----


def test_binary_label_rules(spark):
    df = spark.createDataFrame([("1",), ("0.0",), ("x",), (None,)], "y string")
    assert sorted(r.y for r in cleaning.binary_label(df, "y").collect()) == [0, 1]
    for bad, strict in ((df, True), (spark.createDataFrame([("2",)], "y string"), False)):
        with pytest.raises(Exception, match="y has a value"):
            cleaning.binary_label(bad, "y", strict).collect()


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1, "MKV", ["a"]), (2, "MKX", ["b"]), (3, None, None)], "id long, sequence string, tags array<string>")
    ids = lambda *rules: [
        r.id for r in plans.apply_filters(
            df,
            parse("dataset", {"name": "d", "sources": [{"type": "internal", "name": "s"}], "filters": [dict(zip(("field", "op", "value"), r)) for r in rules]})
        ).orderBy("id").collect()
    ]
    assert ids(("has_noncanonical", "eq", False)) == [1] and ids(("tags", "contains", "b")) == [2] and ids(("sequence", "exists", False)) == [3]
    assert ids(("id", "in", [])) == [] and ids(("id", "not_in", [])) == [1, 2, 3] and ids(("sequence", "not_contains", "V")) == [2]
    with pytest.raises(ValueError):
        ids(("nothing", "eq", 1))


def test_custom_needs_registration(spark):
    spec = parse(
        "split", {"split_name": "s", "protocol": "custom", "ratios": {"train": 0.8, "val": 0.1, "test": 0.1}, "seed": 1, "leakage_checks": [{"type": "custom"}]}
    )
    with pytest.raises(NotImplementedError):
        plans.compile_split(spark.range(3), spec, "id")


def test_sources(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a size>3 b\r\nMK\r\nV\r\n>b\nGG\n>c\n>d x\nA")
    assert [
        tuple(r) for r in tables.read_table(spark, str(tmp_path / "x.fasta")).collect()
    ] == [("a", "a size>3 b", "MKV"), ("b", "b", "GG"), ("c", "c", ""), ("d", "d x", "A")]
    df = spark.createDataFrame([(1, 'a "q", b\nc')], "id long, s string")
    tables.write_table(df, f"{tmp_path}/t.csv")
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/t.csv")
    assert tables.pick_path(spark, str(tmp_path), "t").endswith("t.csv")
    tables.write_table(df, f"{tmp_path}/t.parquet", mode="overwrite")
    assert tables.pick_path(spark, str(tmp_path), "t").endswith("t.parquet") and tables.read_table(spark, f"{tmp_path}/t.parquet").first().s == df.first().s
    with pytest.raises(FileNotFoundError):
        tables.pick_path(spark, str(tmp_path), "none")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.h5")
    path = tmp_path / "random/seed_3/lr/metrics.json"
    path.parent.mkdir(parents=True)
    path.write_text('{"train": {"auprc": 0.9}, "val": {"auprc": 0.8}, "test": {"auprc": 0.7}}')
    r = tables.read_metrics(spark, f"{tmp_path}/*/*/*/metrics.json").first()
    assert (r.folder, r.seed, r.algorithm, r.auprc_test) == ("random", 3, "lr", 0.7)
    (digest,) = tables.sha256_files(spark, str(path)).select("sha256").first()
    assert digest == tables.sha256_file(path) and tables.environment(spark)["python"]


def test_functions():
    from splitwarden.functions import natural_columns, seed_list

    assert seed_list("1-3") == [1, 2, 3] and seed_list("1,5") == [1, 5] and seed_list("7", 2) == [7, 8]
    assert natural_columns(["p_10", "p_2", "x"]) == ["p_2", "p_10"] and natural_columns(["p_b", "p_a"]) == ["p_a", "p_b"] and natural_columns(["x"], fallback=["x"]) == ["x"]


# ---- streaming and models ----


def test_ingest_puts_if_absent(spark, tmp_path):
    import json

    from splitwarden.streaming.ingest import ingest_runs

    drop, table = tmp_path / "drop", str(tmp_path / "runs")
    drop.mkdir()
    for n, (run, notes) in enumerate([("a" * 16, "first"), ("b" * 16, "second"), ("a" * 16, "again")]):
        (drop / f"{n}.json").write_text(json.dumps({"run_id": run, "created_at_utc": f"2024-01-0{n + 1}", "notes": notes}))
        ingest_runs(spark, str(drop), table, str(tmp_path / "state")).awaitTermination(60)
    assert {r.run_id[0]: r.notes for r in spark.read.parquet(table).collect()} == {"a": "first", "b": "second"}


def test_models_select_refit_and_calibrate(spark, sf_dir):
    from splitwarden.ml import calibration, embedding, models

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", (F.col("label") < 5).cast("double").alias("label"))
    rows = splits.stratified_split(models.features(v), "vec_id", "label").repartition(2)
    best = models.fit_best(rows, "lr", models.grid("lr", C=[0.01, 1.0]), balanced=True)
    assert best["params"]["C"] in (0.01, 1.0) and set(best["metrics"]) == {"train", "val", "test"} and 0 <= best["metrics"]["test"]["auroc"] <= 1
    val = best["predictions"].where("partition = 'val'").select("y_true", "y_prob")
    for method in ("platt", "isotonic", "temperature"):
        assert all(0 <= r.y_prob <= 1 for r in calibration.calibrate(val, val, method).collect())
    with pytest.raises(NotImplementedError):
        models.estimator("xgb", 10)
    assert models.clusters(rows, 4).select("cluster_id").distinct().count() <= 4
    e = embedding.embed(spark.createDataFrame([("MKVMKV",), ("",)], "s string"), "s").collect()
    assert len(e[0].embedding) == 256 and sum(x * x for x in e[0].embedding) == pytest.approx(1, abs=1e-5)


def test_grids_and_every_model(spark, sf_dir, tmp_path):
    from pyspark.ml import PipelineModel

    from splitwarden.ml import models

    assert [len(models.grid(m)) for m in ("rf", "svm", "knn", "lr")] == [1, 1, 4, 3] and [
        len(models.grid(m, wide=True)) for m in ("rf", "svm", "knn", "lr")
    ] == [32, 6, 16, 5]
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("kind")).limit(200)
    # a circle within a ring: no plane parts them
    angle, far = F.col("id") * 0.7, F.col("id") % 2
    ring = v.withColumn("label", far.cast("double")).withColumn(
        "embedding", F.array((F.cos(angle) * (1 + 2 * far)).cast("float"), (F.sin(angle) * (1 + 2 * far)).cast("float"))
    )
    rows = models.features(splits.stratified_split(ring.select("id", "label", "embedding"), "id", "label")).repartition(2).cache()
    area = {}
    for model, params in (
        ("rf", {"n_estimators": 10}), ("svm", {"kernel": "rbf"}), ("svm", {"kernel": "linear"}), ("knn", {"weights": "distance", "p": 1}),
        ("knn", {"n_neighbors": 15})
    ):
        best = models.fit_best(rows, model, [params])
        area[model, params.get("kernel")] = best["metrics"]["test"]["auroc"]
        assert all(0 <= r.y_prob <= 1 for r in best["predictions"].collect())
        if params.get("kernel") == "rbf":
            best["model"].write().overwrite().save(str(tmp_path / "svm"))
            again = PipelineModel.load(str(tmp_path / "svm"))
            assert {r.id: r.y_prob for r in models.predict(again, rows).collect()} == pytest.approx({r.id: r.y_prob for r in best["predictions"].collect()})
    assert area["rf", None] > 0.9 and area["svm", "rbf"] > 0.9 > 0.8 > area["svm", "linear"] and area["knn", None] > 0.9


def test_neighbours_equal_a_plain_version(spark):
    import random

    import numpy as np

    from splitwarden.ml import models

    rng = random.Random(4)
    points = [(k, [rng.gauss(0, 1), rng.gauss(0, 2)], float(rng.random() < 0.4)) for k in range(60)]
    df = models.features(spark.createDataFrame(points, "id long, embedding array<double>, label double"))
    x = np.array([p for _, p, _ in points])
    x, y = (x - x.mean(0)) / x.std(0, ddof=1), np.array([label for *_, label in points])
    for p, weights in ((1, "uniform"), (2, "distance")):
        got = {r.id: r.y_prob for r in models.Neighbours(7, weights, p).fit(df).transform(df).collect()}
        for k in range(60):
            d = (np.abs(x - x[k]) ** p).sum(1) ** (1 / p)
            near = np.argsort(d, kind="stable")[:7]
            w = np.ones(7) if weights == "uniform" else (d[near] == 0).astype(float)  # a row is its own neighbour
            assert got[k] == pytest.approx((w * y[near]).sum() / w.sum())


def test_result_sinks_and_loaders(spark, sf_dir, tmp_path):
    import numpy as np

    from splitwarden.sources import results

    folder = str(tmp_path / "case/random/seed_2/lr")
    found = spark.createDataFrame([(1, "MK", 1, 0.7, "test"), (2, None, 0, 0.2, "val")], "i long, s string, y_true int, y_prob double, partition string")
    results.write_predictions(found, folder, "i", "s", threshold=0.8)
    assert [tuple(r) for r in results.load_predictions(spark, folder).collect()] == [(1, "MK", 1, 0.7, 0, "test")]
    with pytest.raises(FileNotFoundError, match="part train"):
        results.load_predictions(spark, folder, "train")
    results.write_metrics(spark, folder, {"train": {"auprc": 0.9}, "val": {"auprc": None}, "test": {"auprc": float("nan")}})
    with pytest.raises(Exception, match="exists"):
        results.write_metrics(spark, folder, {"train": {}})
    r = tables.read_metrics(spark, f"{tmp_path}/case/*/*/*/metrics.json").first()
    assert (r.seed, r.auprc_train, r.auprc_val, r.auprc_test) == (2, 0.9, None, None)

    (tmp_path / "case/random/seed_10").mkdir()
    assert results.folders(spark, f"{tmp_path}/case/random") == ["seed_2", "seed_10"] and list(results.seeds(spark, f"{tmp_path}/case/random")) == [2, 10]
    with pytest.raises(FileNotFoundError, match="seeds 3"):
        results.seeds(spark, f"{tmp_path}/case/random", [2, 3])

    run = tmp_path / "case/executions/r1"
    run.mkdir(parents=True)
    for load in (lambda: results.load_summary(spark, f"{tmp_path}/case", "r1", "seed int"), lambda: results.load_execution(spark, f"{tmp_path}/case", "r1")):
        with pytest.raises(FileNotFoundError, match="of run r1"):
            load()
    (run / "summary.csv").write_text("seed\n4\n")
    tables.write_manifest(run / "execution.yaml", {"split": {"seed": 4, "notes": None}})
    assert results.load_summary(spark, f"{tmp_path}/case", "r1", "seed int").first().seed == 4
    manifest = results.load_execution(spark, f"{tmp_path}/case", "r1")
    assert [results.manifest_get(manifest, k, "none") for k in ("split.seed", "split.notes", "split.seed.x", "model")] == [4, "none", "none", "none"]

    data = spark.createDataFrame([(k, f"s{k}") for k in range(6)], "row long, sequence string")
    where = tmp_path / "split"
    where.mkdir()
    with pytest.raises(FileNotFoundError, match="none of"):
        results.load_split(spark, str(where), "val", data, "sequence string", "row")
    results.write_split(spark.createDataFrame([(1, "val"), (5, "val"), (2, "test")], "dataset_index long, partition string"), f"{where}/assignment")
    rows = lambda part: sorted(r.sequence for r in results.load_split(spark, str(where), part, data, "sequence string", "row").collect())
    assert rows("val") == ["s1", "s5"]
    np.save(where / "val_idx.npy", np.array([3, 0]))
    assert rows("val") == ["s0", "s3"] and [tuple(r) for r in results.read_indices(spark, f"{where}/val_idx.npy").collect()] == [(0, 3), (1, 0)]
    (where / "val.csv").write_text("sequence\nother\n")
    assert rows("val") == ["other"] and rows("test") == ["s2"]


def test_labels_by_order_or_lookup(spark):
    from splitwarden.operators.alignment import labelled_in_order

    data = spark.createDataFrame([(0, "A", 1), (1, "B", 0), (2, "A", 0)], "position long, sequence string, label int")
    same = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "position long, sequence string")
    rows, how = labelled_in_order(same, data, "position", "sequence", "label")
    assert how["method"] == "order" and [(r.position, r.label) for r in rows.orderBy("position").collect()] == [(0, 1), (1, 0), (2, 0)]
    rows, how = labelled_in_order(same.where("position > 0"), data, "position", "sequence", "label")
    assert how["method"] == "lookup" and how["n_equal"] == 2 and {r.sequence: r.label for r in rows.collect()} == {"A": 0, "B": 0}
    with pytest.raises(Exception, match="no label for sequence C"):
        labelled_in_order(spark.createDataFrame([(0, "C")], "position long, sequence string"), data, "position", "sequence", "label")[0].collect()


def test_identity_pairs_against_all_pairs(spark):
    import random

    from splitwarden.operators.identity import identity_clusters, most_edits, similar_pairs

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    base = ["".join(rng.choice("ACDEFGHIKL") for _ in range(rng.choice([2, 5, 9, 14, 40]))) for _ in range(25)]
    texts = set(base)
    for _ in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "K"])
        texts.add("".join(t))
    rows = [(k, t) for k, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "rep long, seq string").cache()
    for threshold in (0.6, 0.75, 0.9, 0.95):
        want = {(a, b) for a, x in rows for b, y in rows if a < b and edits(x, y) <= int((1 - threshold) * max(len(x), len(y)) + 1e-9)}
        assert {(r.a, r.b) for r in similar_pairs(df, threshold).collect()} == want and (len(want) > 5 or threshold > 0.9)
    assert spark.range(1).select(most_edits(F.lit(10), 0.9)).first()[0] == 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, ""), (4, "MKV"), (None, "MKV")], "id long, s string")
    assert sorted(((r.id, r.cluster) for r in identity_clusters(odd, "id", "s", 0.8).collect()), key=str) == [(1, 1), (2, 2), (3, 2), (4, 4), (None, 4)]
    with pytest.raises(ValueError):
        similar_pairs(df, 0.0)


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_of_many_pairs():
    import random

    import numpy as np

    from splitwarden.operators import alignment_kernel as kernel

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé日𝄞") for _ in range(n)) for n in (1, 2, 5, 20, 40, 62, 63, 64, 65, 66, 90, 130) for _ in range(2)]
    i, j = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    exact = np.array([1 - edits_between(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])) for a, b in zip(i, j)])
    for threshold in (0.001, 0.3, 0.7):
        assert np.allclose(kernel.identities(texts, texts, i, j, threshold), np.where(exact >= threshold - 1e-9, exact, 0))
    rows, lengths = kernel.codes(texts)
    shared = kernel.most_shared(*[kernel.composition(rows, lengths)] * 2)
    assert (shared[i, j] >= exact * np.maximum(lengths[i], lengths[j]) - 1e-9).all()
    assert kernel.edit_distance("", "abc", 9) == 3 and kernel.edit_distance("abc", "", 9) == 3 and kernel.edit_distance("a" * 50, "b" * 50, 10) == 11


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5])
def test_identity_at_low_thresholds_against_all_pairs(spark, threshold):
    """500 sequences of families with many edits, in several blocks: pairs, forests and counts."""
    import random

    from splitwarden.operators import identity

    rng = random.Random(7)
    texts = set()
    while len(texts) < 500:
        base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.choice([1, 3, 8, 15, 30, 70]))]
        for _ in range(rng.randint(1, 20)):
            t = [rng.choice(["", "A", "K", c]) if rng.random() < 0.5 else c for c in base]
            texts.add("".join(t) or "Y")
    rows = [(k, t) for k, t in enumerate(sorted(texts)[:500])]
    want = {}
    for a, x in rows:
        for b, y in rows:
            n = max(len(x), len(y))
            if a < b and (e := edits_between(x, y)) <= int((1 - threshold) * n + 1e-9):
                want[a, b] = 1 - e / n
    df = spark.createDataFrame(rows, "rep long, seq string")
    got = {(r.a, r.b): r.identity for r in identity.aligned_blocks(df.withColumn("mask", F.lit(1)), threshold, "pairs", rows_per_block=100).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 100
    assert {(r.a, r.b) for r in identity.similar_pairs(df, threshold).collect()} == set(want)

    root = {a: a for a, _ in rows}
    for _ in range(30):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    clusters = identity.identity_clusters(df, "rep", "seq", threshold).collect()
    assert {r.rep: r.cluster for r in clusters} == root

    parts = df.withColumn("partition", F.expr("element_at(array('train', 'val', 'test'), cast(rep % 3 + 1 as int))"))
    names = ["train", "val", "test"]
    for r in identity.similar_sequences(parts, "rep", "seq", threshold).collect():
        across = [v for (a, b), v in want.items() if {names[a % 3], names[b % 3]} == {r.part_a, r.part_b}]
        assert r.n_pairs == len(across) and r.max_identity == pytest.approx(max(across))


def test_a_split_at_low_identity_runs(spark):
    """Clusters at 0.3 and their checks, with a spec as it is shipped with examples; odd rows too."""
    from splitwarden.plans.compile import compile_checks, compile_split
    from splitwarden.spec.schema import parse

    spec = parse("split", {
        "split_name": "seqid30", "protocol": "cluster_aware", "ratios": {"train": 0.8, "val": 0.1, "test": 0.1}, "seed": 42,
        "identity": {"measure": "sequence_identity", "threshold": 0.3, "tool": "mmseqs2"},
        "leakage_checks": [{"type": "sequence_identity", "scope": "train_test", "threshold": 0.3, "description": "homology"}, {"type": "exact_duplicate", "scope": "all"}],
    })
    rows = [(k, t) for k, t in enumerate([None, "", "", "MKVL", "MKVL", "MKVA", "W" * 100, "W" * 30, "PPPPPPPP", "日本語日本語", "CCCC" * 3000])]
    df = spark.createDataFrame(rows, "id long, seq string")
    parts = compile_split(df, spec, "id", sequence="seq")
    assert parts.count() == len(rows)
    assert {r.n_shared for r in compile_checks(parts, spec, "id", "seq").collect()} == {0}
    empty = compile_split(df.limit(0), spec, "id", sequence="seq")
    assert empty.count() == 0 and {r.n_shared for r in compile_checks(empty, spec, "id", "seq").collect()} == {0}


def plain_neighbours(rows, k, metric, leave_out=True):
    import numpy as np

    x = np.array([v for _, v in rows], float)
    if metric == "cosine":
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, norm, out=x.copy(), where=norm > 0)
    out = []
    for i, (a, _) in enumerate(rows):
        step = np.abs(x - x[i])
        far = 1 - x @ x[i] if metric == "cosine" else step.sum(1) if metric == "manhattan" else np.sqrt((step * step).sum(1))
        near = sorted((round(float(d), 9) + 0.0, b) for (b, _), d in zip(rows, far) if b != a or not leave_out)[:k]
        out += [(a, b, r + 1) for r, (_, b) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_knn_in_balls_against_all_rows(spark, metric):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6)) * 4
    x = centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 6)) / 8
    x[7], x[8], x[9] = 0, 0, x[10]
    rows = [(k, r.tolist()) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = sorted((r.a, r.b, r["rank"]) for r in knn(df, df, 5, rows_per_block=20, metric=metric).collect())
    assert got == plain_neighbours(rows, 5, metric)
    assert knn(df, df.limit(0), 5, metric=metric).count() == 0 == knn(df.limit(0), df, 5, metric=metric).count()
    few = knn(df.where("id < 2"), df.where("id < 4"), 5, metric=metric, rows_per_block=2).collect()
    assert sorted((r.a, r["rank"]) for r in few) == [(a, k) for a in (0, 1) for k in (1, 2, 3)]


@pytest.mark.parametrize("threshold", [0.4, 0.9])
def test_pairs_above_counts_what_it_compares(spark, threshold):
    """All pairs, and fewer candidates than pairs that a comparison of all blocks would work out."""
    import numpy as np

    from splitwarden.operators.similarity import pairs_above

    rng = np.random.default_rng(4)
    x = (rng.normal(size=(15, 24)) * np.linspace(3, 0.2, 24))[rng.integers(0, 15, 600)] + rng.normal(size=(600, 24)) / 6
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    i, j = np.nonzero(np.triu(np.round(unit @ unit.T, 9) >= threshold, 1))
    got = pairs_above(df, threshold, rows_per_block=40)
    assert sorted((r.a, r.b) for r in got.select("a", "b").collect()) == sorted(zip(i.tolist(), j.tolist()))
    done = pairs_above(df, threshold, rows_per_block=40, count=True).agg(F.sum("compared"), F.sum("candidates"), F.sum("pairs")).first()
    assert done[2] == len(i) <= done[1] <= done[0] <= 600 * 599 / 2
    assert threshold < 0.9 or done[1] < 0.5 * 600 * 599 / 2


def test_clustered_queries_visit_few_tiles(spark):
    import numpy as np

    from splitwarden.operators.similarity import Balls, ball_visits

    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, 32)) * 3)[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 32)) / 5
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>")
    balls = Balls(df, "euclidean", 50)
    first, rest, _ = ball_visits(balls, df, 5, 9, True)
    assert first.count() > 0
    assert 2000 + rest.count() < 2000 * int(balls.tiles.sum()) / 2  # what a comparison of all blocks would take


def test_pairs_above_against_all_pairs(spark):
    import numpy as np

    from splitwarden.operators.similarity import pairs_above

    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 4))
    x = np.concatenate([x, x[:50] + 0.05 * rng.standard_normal((50, 4)), np.zeros((2, 4))])
    df = spark.createDataFrame([(k, v.tolist(), "ab"[k % 2]) for k, v in enumerate(x)] + [(999, None, "a")], "id long, embedding array<double>, part string")
    with np.errstate(invalid="ignore"):
        unit = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
    cos = np.round(unit @ unit.T, 9)
    for threshold, part in ((0.99, None), (0.9, "part"), (0.2, None)):
        want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if cos[a, b] >= threshold and not (part and a % 2 == b % 2)}
        got = [(r.a, r.b) for r in pairs_above(df, threshold, part=part, rows_per_block=17).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pairs_above(df.limit(0), 0.5).count() == 0


def test_temporal_split_without_truncation(spark):
    from splitwarden.operators.ranking import range_bucket, sums_before

    df = spark.createDataFrame([(k, f"2024-01-{1 + k % 28:02d} 10:{k % 60:02d}") if k % 50 else (k, None) for k in range(2000)], "id long, t string")
    for kind in ("string", "timestamp", "date"):
        rows = df.withColumn("t", F.col("t").cast(kind))
        got = sums_before(rows, [], range_bucket(rows, "t", 7), [F.col("t"), F.col("id")]).orderBy("__before").collect()
        assert [r["__before"] for r in got] == list(range(2000)) and [
            (r.t is not None, r.t, r.id) for r in got if r.t
        ] == sorted((r.t is not None, r.t, r.id) for r in got if r.t)


def test_train_specs_run(spark, sf_dir):
    from splitwarden.plans import train

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.slice("embedding", 1, 6).alias("embedding")
    ).limit(160)
    v = v.withColumn("label", (F.col("embedding")[0] > 0).cast("double"))
    from splitwarden.ml import models

    rows = models.features(splits.stratified_split(v, "id", "label", ratios=(0.6, 0.2, 0.2))).repartition(2).cache()
    base = {"name": "t", "task": "classification", "model_family": "linear", "metrics": ["accuracy", "ROC_AUC"], "seed": 3}
    spec = lambda **more: parse("train", base | more)
    for family, hyperparams in (
        ("linear", {"C": 10.0, "random_state": 1}), ("rf", {"n_estimators": 5}), ("xgb", {"n_estimators": 3}), ("nn", {"hidden": [4], "max_iter": 30})
    ):
        out = train.run_train(rows, spec(model_family=family, hyperparams=hyperparams))
        assert set(out["metrics"]) == {"train", "val", "test"} and out["metrics"]["train"]["ROC_AUC"] > 0.9
    cv = {"enabled": True, "folds": 3}
    out = train.run_train(
        rows, spec(calibration={"enabled": True, "method": "platt"}, cross_validation=cv | {"strategy": "group_kfold", "group_field": "kind"})
    )
    assert sorted(r.fold for r in out["folds"].collect()) == [0, 1, 2] and all(0 <= r.y_prob <= 1 for r in out["predictions"].collect())
    for strategy, folds in (("stratified_kfold", [0, 1, 2]), ("time_series", [1, 2])):
        assert sorted(
            r.fold for r in train.cross_validate(rows.where("partition = 'train'"), spec(cross_validation=cv | {"strategy": strategy}), time="id").collect()
        ) == folds
    numbers = rows.withColumn("label", F.col("embedding")[0].cast("double") * 3 + 1)
    for family, hyperparams in (("linear", {}), ("rf", {"n_estimators": 5}), ("xgb", {"n_estimators": 3})):
        out = train.run_train(numbers, spec(task="regression", model_family=family, hyperparams=hyperparams, metrics=["rmse", "mae", "r2"]))
        assert out["metrics"]["train"]["r2"] > (0.999 if family == "linear" else 0.3)
    assert train.run_train(
        rows, spec(task="unsupervised", metrics=[], hyperparams={"n_clusters": 3})
    )["predictions"].select("cluster_id").distinct().count() <= 3
    for more, error in (
        ({"model_family": "gdl"}, NotImplementedError), ({"task": "ranking"}, NotImplementedError), ({"hyperparams": {"depth": 3}}, ValueError),
        ({"metrics": ["bleu"]}, ValueError)
    ):
        with pytest.raises(error):
            train.run_train(rows, spec(**more))


def test_pooling_and_layers(spark):
    from splitwarden.ml import embedding

    tokens = spark.createDataFrame(
        [("a", 1, [2.0, 0.0], 3.0), ("a", 0, [0.0, 4.0], 1.0), ("a", 2, [9.0, 9.0], 0.0), ("b", 0, [1.0, 1.0], 1.0)],
        "id string, pos int, v array<double>, w double"
    )
    got = lambda method, **more: {r.id: r.embedding for r in embedding.pool(tokens, "id", "pos", "v", method, **more).collect()}
    assert got("mean", max_length=2) == {"a": [1, 2], "b": [1, 1]} and got("sum", max_length=2)["a"] == [2, 4] and got("cls")["a"] == [0, 4] and got("attention", weight="w")["a"] == [1.5, 1]
    for method, error in (("attention", ValueError), ("custom", NotImplementedError)):
        with pytest.raises(error):
            got(method)

    class Embedder:
        layer_idx = 3

    e = Embedder()
    assert embedding.select_layer(e)["attribute"] == "layer_idx" and e.layer_idx == -1 and embedding.select_layer(object())["attribute"] is None
    wide = spark.createDataFrame([(1, 2.0, 3.0, None)], "id long, p_1 double, p_2 double, sequence string")
    assert tuple(embedding.feature_matrix(wide, ["p_1", "p_2"]).select("embedding", "sequence").first()) == ([2.0, 3.0], "<missing_seq>")


def test_slices_follow_the_rows_not_the_values(spark):
    """Scores within a millionth of each other, most of one group, still lie in all slices, and the area is right."""
    import random

    from splitwarden.operators import metrics
    from splitwarden.operators.ranking import sliced

    rng = random.Random(1)
    rows = [("hot" if k % 10 else f"g{k % 3}", 0.5 + rng.random() * 1e-6, rng.randrange(2)) for k in range(4000)] + [("hot", None, 1), (None, 0.5, 0), (None, 0.6, 1)]
    df = spark.createDataFrame(rows, "g string, y_prob double, y_true int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would make one task of so few rows
    try:
        counts = [r["count"] for r in sliced(df, ["g"], [F.col("y_prob")]).groupBy("__slice").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4 and max(counts) < 2 * 4003 / 4
    got = {r.g: r.auroc for r in metrics.auroc(df.where("y_prob is not null"), ["g"]).collect()}
    for group in ("hot", "g0", None):
        pos, neg = ([p for g, p, y in rows if g == group and p is not None and y == v] for v in (1, 0))
        area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[group] == pytest.approx(area)


def test_quantiles_by_selection(spark):
    import numpy as np

    from splitwarden.operators import fragility

    rng = np.random.default_rng(2)
    groups = {("a", 1): rng.normal(size=900), ("a", None): rng.integers(0, 3, 400).astype(float), ("b", 2): np.array([5.0]), ("c", 3): np.array([])}
    rows = [(*key, float(v)) for key, values in groups.items() for v in values] + [("a", 1, None), ("c", 3, None)]
    df = spark.createDataFrame(rows, "g string, h int, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.h): (r.n, [r[f"q{k}"] for k in range(6)]) for r in fragility.quantiles(df, ["g", "h"], "x", shares).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key][0] == len(values)
        assert got[key][1] == ([None] * 6 if not len(values) else [pytest.approx(q) for q in np.quantile(values, shares)])
    assert fragility.quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0
    whole = fragility.quantiles(df, [], "x", [0.5]).first()
    assert whole.q0 == pytest.approx(np.median(np.concatenate(list(groups.values()))))
