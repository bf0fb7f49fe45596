"""Every relational query of the engine, on the driver's tables, with its SQL.

A query is registered by ``@query(sql)`` under its function's name; it takes (spark, sf_dir). SQL is None where SQL can't express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import embedding_id, run_stamp, seed_id, severity_rank, split_id
from .operators import alignment, cleaning, fragility, identity, leakage, metrics, splits
from .operators.similarity import knn, knn_vote, pairs_above
from .plans import compile as plans
from .plans.audit import issue_order
from .shared import new_path, ship
from .sources import tables
from .spec.lineage import artifact_id_column, run_id_column
from .spec.lineage import lineage_edges as edges_of
from .spec.lineage import lineage_nodes as nodes_of
from .spec.registry import put_if_absent
from .spec.schema import KINDS, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- bindings of the driver's tables ----


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents without repeated texts, with their labels. Only ids and digests are deduplicated."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "source", "lang")
    return cleaning.dedup_first(docs, ["digest"], ["doc_id"]).drop("digest").join(table(spark, d, "labels"), "doc_id")


LABELLED = """
    labelled as (select d.doc_id, source, lang, quality, toxic from (select doc_id, source, lang, row_number() over (partition by text
    order by doc_id) as rn from documents) d join labels l on d.doc_id = l.doc_id where rn = 1)
"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One prediction for each event: strategy by user parity, seed by user."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", (F.col("user_id") % 2).alias("strategy"), (F.col("user_id") % 10).alias("seed"), (F.col("event_type") == "purchase").cast("int").alias("y_true"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("y_prob"),
    )


PREDICTIONS = """
    preds as (select event_id, user_id % 2 as strategy, user_id % 10 as seed, cast(event_type = 'purchase' as int) as y_true, least(value / 500, cast(1.0
    as double)) as y_prob from events)
"""
THRESHOLDED = PREDICTIONS + ", p as (select *, cast(y_prob >= cast(0.1 as double) as int) as y_pred from preds)"


def decided(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold(predictions(spark, d), at=0.1)


def results(spark: SparkSession, d: str) -> DataFrame:
    """A table of runs: algorithm, partition, seed and a metric."""
    o = table(spark, d, "orders")
    part = F.when(F.col("o_orderstatus") == "F", "Random").when(F.col("o_orderstatus") == "O", "Stratified").otherwise("Cluster aware")
    return o.select(
        F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("algorithm"), part.alias("partition"), (F.col("o_custkey") % 10).alias("seed"),
        F.col("o_totalprice").alias("metric"), "o_custkey"
    )


RESULTS = """
    r as (select o_orderkey as run, o_orderpriority as algorithm, case o_orderstatus when 'F' then 'Random' when 'O' then 'Stratified' else
    'Cluster aware' end as partition, o_custkey % 10 as seed, o_totalprice as metric from orders)
"""


def by_k(spark: SparkSession, d: str) -> DataFrame:
    """Runs with a number of clusters; k is null for some."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_type").alias("algorithm"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("k"), F.col("p_retailprice").alias("test"),
        (F.col("p_retailprice") - F.col("p_size") * 1.5).alias("val")
    )


BY_K = """
    k as (select p_type as algorithm, case when p_size > 5 then p_size end as k, p_retailprice as test, p_retailprice - p_size * cast(1.5 as double) as
    val from part)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, since sums depend on the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- sources ----

CSV_SCHEMA = "id long, name string, size int, price double"


@query("select r_regionkey as id, r_name as name, length(r_name) as size, cast(r_regionkey as double) / 4 as price from region")
def scan_csv(spark, d):
    """Writes a CSV and reads it back with a schema."""
    path = new_path(spark, "scan") + ".csv"
    rows = table(spark, d, "region").select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.length("r_name").alias("size"),
        (F.col("r_regionkey") / 4).alias("price")
    )
    tables.write_table(rows, path)
    return tables.read_table(spark, path, CSV_SCHEMA)


@query("select n_nationkey, n_name, n_regionkey from nation")
def scan_parquet(spark, d):
    return tables.read_table(spark, f"{d}/nation.parquet")


@query("select max('run_' || lpad(cast(o_orderkey as varchar), 12, '0')) as latest_run from orders")
def latest_run(spark, d):
    return tables.latest_run(table(spark, d, "orders").select(F.concat(F.lit("run_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_id")))


@query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def json_metric(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


# ---- projections and filters ----


@query("select doc_id, lang, n_chars from documents")
def project_columns(spark, d):
    return table(spark, d, "documents").drop("text", "source")


@query("""
    select doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) as text from documents
    where length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) > 0
""")
def clean_nonempty(spark, d):
    return cleaning.clean_nonempty(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("""
    select event_id, cast(try_cast(json_extract_string(props, '$.k') as double) > 50 as int) as label from events
    where try_cast(json_extract_string(props, '$.k') as double) is not null
""")
def binary_label_clean(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", F.when(F.get_json_object("props", "$.k").cast("double") > 50, "1.0").when(F.get_json_object("props", "$.k").isNotNull(), "0").alias("label")
    )
    return cleaning.binary_label(raw, "label")


@query("""
    select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) - l_quantity * 1000, 4) as gap, round(abs(l_extendedprice * (1 - l_discount)
    - l_quantity * 1000), 4) as abs_gap from lineitem
""")
def generalization_gap(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("test"), (F.col("l_quantity") * 1000).alias("val")
    )
    return rounded(fragility.gaps(rows, "test", "val").drop("test", "val"), 4)


@query("""
    select 'train' as stage, o_orderkey as run, o_totalprice as metric from orders union all select 'test' as stage, s_suppkey as run, s_acctbal as metric
    from supplier
""")
def stage_union(spark, d):
    a = table(spark, d, "orders").select(F.lit("train").alias("stage"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("metric"))
    b = table(spark, d, "supplier").select(F.lit("test").alias("stage"), F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("metric"))
    return a.unionByName(b)


@query(f"with {THRESHOLDED} select strategy, seed, event_id from p where y_true <> y_pred")
def filter_errors(spark, d):
    return metrics.errors(decided(spark, d)).select("strategy", "seed", "event_id")


@query("select doc_id, source from documents where source in ('src1', 'src3', 'src5')")
def cluster_membership(spark, d):
    docs = table(spark, d, "documents")
    chosen = docs.select("source").distinct().where(F.col("source").isin("src1", "src3", "src5"))
    return docs.join(chosen, "source", "left_semi").select("doc_id", "source")


@query("""
    with f as (select p_partkey, case p_partkey % 3 when 0 then 'cluster_aware_k' || cast(p_size as varchar) when 1 then 'random' else 'stratified' end as
    folder from part) select p_partkey, case when contains(folder, 'cluster') then 'Cluster aware' when contains(folder, 'stratified') then 'Stratified'
    else 'Random' end as partition, case when contains(folder, 'cluster') then try_cast(regexp_extract(folder, 'k([0-9]+)$', 1) as int) end as k from f
""")
def partition_classify(spark, d):
    folder = F.when(
        F.col("p_partkey") % 3 == 0, F.concat(F.lit("cluster_aware_k"), F.col("p_size").cast("string"))
    ).when(F.col("p_partkey") % 3 == 1, "random").otherwise("stratified")
    rows = table(spark, d, "part").select("p_partkey", folder.alias("folder"))
    kind, k = tables.classify_partition(F.col("folder"))
    return rows.select("p_partkey", kind.alias("partition"), k.alias("k"))


@query(f"with {PREDICTIONS} select event_id, y_true, y_prob, cast(y_prob >= cast(0.5 as double) as int) as y_pred from preds")
def predictions_threshold(spark, d):
    return metrics.threshold(predictions(spark, d)).select("event_id", "y_true", "y_prob", "y_pred")


def _filtered(rules: list[tuple], select: tuple, source: str = "part"):
    def run(spark, d):
        df = table(spark, d, source)
        for field, op, value in rules:
            df = df.where(plans.filter_column(df, parse("filter", {"field": field, "op": op, "value": value}), "p_name"))
        return df.select(*select)

    return run


def _filter_query(name: str, rules: list[tuple], where: str):
    QUERIES[name] = _filtered(rules, ("p_partkey", "p_name"))
    ORACLE[name] = f"select p_partkey, p_name from part where {where}"


_filter_query("filter_eq", [("p_type", "eq", "SMALL")], "p_type = 'SMALL'")
_filter_query("filter_ne", [("p_type", "ne", "SMALL")], "p_type <> 'SMALL'")
_filter_query(
    "filter_cmp", [("p_size", "gt", 10), ("p_size", "le", 40), ("p_retailprice", "ge", 901.0), ("p_retailprice", "lt", 980.5)],
    "p_size > 10 and p_size <= 40 and p_retailprice >= 901 and p_retailprice < 980.5"
)
_filter_query("filter_in", [("p_brand", "in", ["Brand#1", "Brand#2"])], "p_brand in ('Brand#1', 'Brand#2')")
_filter_query("filter_not_in", [("p_brand", "not_in", ["Brand#1", "Brand#2"])], "p_brand not in ('Brand#1', 'Brand#2')")
_filter_query("filter_contains", [("p_name", "contains", "ring")], "contains(p_name, 'ring')")
_filter_query("filter_not_contains", [("p_name", "not_contains", "ring")], "not contains(p_name, 'ring')")
_filter_query("filter_between", [("sequence_length", "between", [8, 10])], "length(p_name) between 8 and 10")
_filter_query("filter_regex", [("p_name", "regex", "^(small|red) .*t$")], "regexp_matches(p_name, '^(small|red) .*t$')")
_filter_query("filter_exists", [("p_brand", "exists", True)], "p_brand is not null")


@query(
    "select event_id, event_type || '__random__seed_' || cast(user_id as varchar) as split, event_type || '_seed_' || cast(user_id as varchar) as seed_dir, "
    "'embedding_esm2_t6_mean_last_bs' || cast(user_id as varchar) || '_cpu_fp32' as embedding, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp from events"
)
def composed_ids(spark, d):
    kind, n = F.col("event_type"), F.col("user_id")
    ids = [
        split_id(kind, F.lit("random"), n).alias("split"), seed_id(kind, n).alias("seed_dir"),
        embedding_id(F.lit("org/esm2-t6"), F.lit("mean"), n, F.lit("cpu"), F.lit("fp32")).alias("embedding")
    ]
    return table(spark, d, "events").select("event_id", *ids, run_stamp(F.col("ts")).alias("stamp"))


# ---- joins ----


@query(f"""
    with {RESULTS}, a as (select partition, seed, median(metric) as m from r
    group by 1, 2) select x.seed, round(x.m, 4) as random, round(y.m, 4) as stratified from a x join a y on x.seed = y.seed
    where x.partition = 'Random' and y.partition = 'Stratified'
""")
def paired_seed_join(spark, d):
    m = results(spark, d).groupBy("partition", "seed").agg(F.median("metric").alias("m"))
    a = m.where("partition = 'Random'").select("seed", F.col("m").alias("random"))
    return rounded(a.join(m.where("partition = 'Stratified'").select("seed", F.col("m").alias("stratified")), "seed"), 4)


@query(f"""
    with {RESULTS}, i as (select algorithm, partition, quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25) as iqr from r group by 1, 2),
    g as (select algorithm, partition, median(metric - 1000 * seed) as gap from r
    group by 1, 2) select algorithm, partition, round(iqr, 4) as iqr, round(gap, 4) as gap from i join g using (algorithm, partition)
""")
def fragility_gap_join(spark, d):
    r = results(spark, d)
    iqr = fragility.quartiles(r, ["algorithm", "partition"], "metric").select("algorithm", "partition", "iqr")
    gap = fragility.quartiles(
        fragility.gaps(r.withColumn("val", F.col("seed") * 1000), "metric", "val"), ["algorithm", "partition"], "gap"
    ).select("algorithm", "partition", F.col("median").alias("gap"))
    return rounded(iqr.join(gap, ["algorithm", "partition"]), 4)


def _lookup(spark, d, last):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return alignment.lookup(e.select("user_id").distinct(), e, "user_id", "event_type", "event_id", last, strict=True)


@query("select user_id, arg_max(event_type, event_id) as event_type from events group by 1")
def label_lookup_last(spark, d):
    return _lookup(spark, d, True)


@query("select user_id, arg_min(event_type, event_id) as event_type from events group by 1")
def label_lookup_first(spark, d):
    return _lookup(spark, d, False)


def ranked_sql(source: str, id_: str, seed: int = 42, by: str = "", keep: str = "") -> str:
    part = f"partition by {by} " if by else ""
    over = f"over ({part.strip()})" if part else "over ()"
    return f"select {keep}{id_}, row_number() over ({part}order by md5(cast({id_} as varchar) || ':{seed}'), {id_}) as rk, count(*) {over} as n from {source}"


CUT_SQL = """
    case when rk <= round_even(cast(0.8 as double) * n, 0) then 'train' when rk <= round_even(cast(0.8 as double) * n, 0) + round_even(cast(0.1 as double)
    * n, 0) then 'val' else 'test' end as partition
"""


@query(
    f"with s as ({ranked_sql('documents', 'doc_id')}) select s.doc_id, {CUT_SQL}, rk as position, lang, n_chars from s join documents d on s.doc_id = d.doc_id"
)
def split_gather(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    split = splits.random_split(docs.select("doc_id"), "doc_id")
    return alignment.gather(split, docs, "doc_id")


@query("""
    with a as (select event_id as p, event_type as s from events), b as (select event_id as p, case when event_id % 100 = 7 then 'x' else event_type end
    as s from events where event_id % 1000 <> 999) select count(a.p) as n_a, count(b.p) as n_b, count(*) filter (where a.s = b.s) as n_equal, case when
    count(a.p) = count(b.p) and count(a.p) = count(*) filter (where a.s = b.s) then 'order' else 'lookup' end as method from a full outer
    join b on a.p = b.p
""")
def alignment_check(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    other = e.where("event_id % 1000 <> 999").withColumn("event_type", F.when(F.col("event_id") % 100 == 7, "x").otherwise(F.col("event_type")))
    return alignment.alignment(e, other, "event_id", "event_type")


# ---- similarity ----

NEIGHBOURS = """
    n as (select a, b, distance, rk from (select a.vec_id as a, b.vec_id as b, round(1 - list_cosine_similarity(cast(a.embedding as double[]),
    cast(b.embedding as double[])), 9) as distance, row_number() over (partition by a.vec_id
    order by round(1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9), b.vec_id) as rk from embeddings a
    join embeddings b on a.vec_id <> b.vec_id) where rk <= 10)
"""


def _neighbours(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn(v, v, 10)


@query(f"with {NEIGHBOURS} select a as source_index, b as neighbor_index, round(distance, 6) as distance from n")
def knn_graph(spark, d):
    return _neighbours(spark, d).select(F.col("a").alias("source_index"), F.col("b").alias("neighbor_index"), F.round("distance", 6).alias("distance"))


@query(f"""
    with {NEIGHBOURS}, v as (select a, label, count(*) as w from n join embeddings e on n.b = e.vec_id
    group by 1, 2) select a as id, label as predicted, w / cast(sum(w) over (partition by a) as double) as score from v
    qualify row_number() over (partition by a order by w desc, label) = 1
""")
def knn_vote_labels(spark, d):
    return knn_vote(_neighbours(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"))


QUERIES["knn_vote"], ORACLE["knn_vote"] = QUERIES.pop("knn_vote_labels"), ORACLE.pop("knn_vote_labels")


MANHATTAN = """
    n as (select a, b, distance, rk from (select x.vec_id as a, y.vec_id as b, round(list_sum(list_transform(list_zip(x.embedding, y.embedding),
    lambda z: abs(cast(z[1] as double) - cast(z[2] as double)))), 9) as distance, row_number() over (partition by x.vec_id
    order by round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: abs(cast(z[1] as double) - cast(z[2] as double)))), 9),
    y.vec_id) as rk from embeddings x join embeddings y on x.vec_id <> y.vec_id where x.vec_id % 10 = 0) where rk <= 5)
"""


@query(f"""
    with {MANHATTAN}, v as (select a, label, sum(1 / distance) as w from n join embeddings e on n.b = e.vec_id
    group by 1, 2) select a as id, label as predicted, round(w / sum(w) over (partition by a), 6) as score from v
    qualify row_number() over (partition by a order by w desc, label) = 1
""")
def knn_vote_manhattan(spark, d):
    """Five neighbours by Manhattan distance, weighted by it; the queries are the vectors whose id is divisible by ten."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rounded(knn_vote(knn(v.where("id % 10 = 0"), v, 5, metric="manhattan"), v.select("id", "label"), weighted=True))


# ---- aggregates ----


@query("select quality, count(*) as n from labels where quality is not null group by 1")
def label_counts(spark, d):
    return splits.label_counts(table(spark, d, "labels"), "quality")


@query(f"""
    with {LABELLED}, s as ({ranked_sql('labelled', 'doc_id', by='quality', keep='quality, ')}), t as (select quality, {CUT_SQL}
    from s) select partition, quality, count(*) as n from t group by 1, 2
""")
def split_label_counts(spark, d):
    """The flagship: deduplicate, join labels, split within labels, count."""
    rows = splits.stratified_split(labelled(spark, d).select("doc_id", "quality"), "doc_id", "quality")
    return splits.label_counts(rows, "partition", "quality")


@query("select count(distinct source) as n_clusters from documents")
def cluster_count(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("source").alias("n_clusters"))


@query("select distinct o_orderpriority as algorithm, o_orderstatus as status from orders")
def distinct_values(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("algorithm"), F.col("o_orderstatus").alias("status")).distinct()


@query(f"""
    with {RESULTS} select algorithm, round(avg(metric), 4) as metric_mean, round(stddev_samp(metric), 4) as metric_std, round(min(metric),
    4) as metric_min, round(max(metric), 4) as metric_max from r group by 1
""")
def metrics_by_strategy(spark, d):
    return rounded(fragility.metric_summary(results(spark, d), ["algorithm"], ["metric"]), 4)


@query(f"""
    with {RESULTS} select algorithm, partition, count(*) as n, round(avg(metric), 4) as mean, round(stddev_pop(metric), 4) as std, round(min(metric),
    4) as min, round(max(metric), 4) as max, round(max(metric) - min(metric), 4) as range, round(stddev_pop(metric) / avg(metric), 4) as cv from r
    group by 1, 2
""")
def fragility_stats(spark, d):
    return rounded(fragility.fragility_stats(results(spark, d), ["algorithm", "partition"], "metric"), 4)


def quartile_sql(source: str, keys: str, x: str, where: str = "true") -> str:
    return f"select {keys}, count({x}) as n, round(median({x}), 4) as median, round(quantile_cont({x}, 0.25), 4) as q25, round(quantile_cont({x}, 0.75), 4) as q75, round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 4) as iqr from {source} where {where} group by all"


@query(f"with {RESULTS} {quartile_sql('r', 'algorithm, partition', 'metric')}")
def fragility_iqr(spark, d):
    return rounded(fragility.quartiles(results(spark, d), ["algorithm", "partition"], "metric"), 4)


@query(f"with {RESULTS} {quartile_sql('r', 'algorithm, partition', 'metric - 1000 * seed')}")
def gap_summary(spark, d):
    rows = fragility.gaps(results(spark, d).withColumn("val", F.col("seed") * 1000), "metric", "val")
    return rounded(fragility.quartiles(rows, ["algorithm", "partition"], "gap"), 4)


@query(f"with {BY_K} select algorithm, k, count(*) as n, round(median(test), 4) as median from k where k is not null group by 1, 2")
def perf_by_k(spark, d):
    return rounded(fragility.quartiles(by_k(spark, d), ["algorithm", "k"], "test").select("algorithm", "k", "n", "median"), 4)


@query(f"with {BY_K} {quartile_sql('k', 'algorithm, k', 'test', 'k is not null')}")
def frag_by_k(spark, d):
    return rounded(fragility.quartiles(by_k(spark, d), ["algorithm", "k"], "test"), 4)


@query(f"with {BY_K} {quartile_sql('k', 'algorithm, k', 'test - val', 'k is not null')}")
def gap_by_k(spark, d):
    return rounded(fragility.quartiles(fragility.gaps(by_k(spark, d), "test", "val"), ["algorithm", "k"], "gap"), 4)


@query("""
    select cast(min(length(text)) as bigint) as min, cast(max(length(text)) as bigint) as max, round(avg(length(text)),
    4) as mean, round(median(length(text)), 4) as median from documents
""")
def length_stats(spark, d):
    n = F.length("text").cast("long")
    return rounded(table(spark, d, "documents").agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.median(n).alias("median")), 4)


@query("select doc_id, source from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def dedup_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return cleaning.dedup_first(docs, ["digest"], ["doc_id"]).drop("digest")


@query("select count(*) as n_rows, count(distinct text) as n_distinct, count(*) - count(distinct text) as n_duplicates from documents")
def duplicate_count(spark, d):
    return cleaning.duplicate_count(table(spark, d, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query(f"""with {THRESHOLDED}, c as (select strategy, seed, cast(count(*) filter (where y_true = 1 and y_pred = 1) as double) as tp, cast(count(*) filter (where y_true = 0 and y_pred = 1) as double) as fp, cast(count(*) filter (where y_true = 0 and y_pred = 0) as double) as tn, cast(count(*) filter (where y_true = 1 and y_pred = 0) as double) as fn from p group by 1, 2)
select strategy, seed, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(case when tp + fn = 0 then tn / (tn + fp) when tn + fp = 0 then tp / (tp + fn) else (tp / (tp + fn) + tn / (tn + fp)) / 2 end, 6) as balanced_accuracy, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1,
round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0 else (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) end, 6) as mcc from c""")
def binary_metrics(spark, d):
    return rounded(metrics.binary_metrics(decided(spark, d), ["strategy", "seed"]))


STEPS = PREDICTIONS + """
    , g as (select strategy, seed, y_prob, count(*) as n, sum(y_true) as p from preds group by 1, 2, 3),
    s as (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by strategy, seed) as total, sum(p) over (partition by strategy,
    seed) as pos from g window w as (partition by strategy, seed order by y_prob desc))
"""


@query(f"""
    with {STEPS} select strategy, seed, round(cast(sum((n - p) * (cp - p + p / cast(2 as double))) as double) / nullif(cast(max(pos) * (max(total) -
    max(pos)) as double), 0), 6) as auroc from s group by 1, 2
""")
def auroc(spark, d):
    return rounded(metrics.auroc(predictions(spark, d), ["strategy", "seed"]))


@query(f"""
    with {STEPS} select strategy, seed, round(sum(cast(p as double) / nullif(cast(pos as double), 0) * (cast(cp as double) / cast(cn as double))),
    6) as auprc from s group by 1, 2
""")
def auprc(spark, d):
    return rounded(metrics.average_precision(predictions(spark, d), ["strategy", "seed"]))


EDGES = "[" + ", ".join(f"cast({i * 0.1!r} as double)" for i in range(1, 10)) + "]"


@query(f"""
    with {PREDICTIONS} select strategy, cast(len(list_filter({EDGES}, lambda e: e < y_prob)) as int) as bin, count(*) as n, round(avg(y_prob),
    6) as mean_predicted, round(avg(y_true), 6) as fraction_positive from preds group by 1, 2
""")
def calibration_curve(spark, d):
    return rounded(metrics.calibration_curve(predictions(spark, d), ["strategy"]))


@query(f"""
    with {THRESHOLDED}, e as (select distinct seed as s, user_group as i from (select seed, event_id % 1000 as user_group from p where y_true <> y_pred)),
    z as (select distinct seed as s from p), c as (select z.s, count(e.i) as n from z left join e on z.s = e.s group by 1),
    b as (select x.s as sa, y.s as sb, count(*) as shared from e x join e y on x.i = y.i
    group by 1, 2) select a.s as seed_a, c.s as seed_b, round(case when a.n + c.n - coalesce(shared, 0) = 0 then 1 else coalesce(shared, 0) / cast(a.n +
    c.n - coalesce(shared, 0) as double) end, 6) as jaccard from c a cross join c left join b on b.sa = a.s and b.sb = c.s
""")
def error_jaccard(spark, d):
    p = decided(spark, d).withColumn("item", F.col("event_id") % 1000)
    return rounded(metrics.error_jaccard(p, "seed", "item", p.select("seed").distinct()))


@query("""
    select cast(count(*) as bigint) as n_rows, count(distinct doc_id) as n_ids, cast(0 as bigint) as n_missing, cast(0 as bigint) as n_unknown, true as ok
    from documents
""")
def split_integrity(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return splits.integrity(splits.random_split(docs, "doc_id"), "doc_id", docs)


IQR = f"""
    with {RESULTS}, q as (select algorithm, partition, quantile_cont(metric, 0.75) - quantile_cont(metric, 0.25) as iqr from r group by 1, 2),
    v as (select algorithm, max(iqr) filter (where partition = 'Cluster aware') as c, max(iqr) filter (where partition = 'Random') as r, max(iqr) filter
    (where partition = 'Stratified') as s from q group by 1)
"""
PARTITIONS = ["Cluster aware", "Random", "Stratified"]


def _pivot(spark, d):
    return fragility.pivot(fragility.quartiles(results(spark, d), ["algorithm", "partition"], "metric"), "algorithm", "partition", "iqr", PARTITIONS)


def _ratios(spark, d):
    r, s, c = "Random", "Stratified", "Cluster aware"
    return fragility.ratios(_pivot(spark, d), {"cluster_random": (c, r), "cluster_stratified": (c, s), "random_stratified": (r, s)})


@query(f'{IQR} select algorithm, round(c, 4) as "Cluster aware", round(r, 4) as "Random", round(s, 4) as "Stratified" from v')
def fragility_pivot(spark, d):
    return rounded(_pivot(spark, d), 4)


@query(f"{IQR} select algorithm, round(c / r, 6) as cluster_random, round(c / s, 6) as cluster_stratified, round(r / s, 6) as random_stratified from v")
def fragility_ratio(spark, d):
    return rounded(_ratios(spark, d).select("algorithm", "cluster_random", "cluster_stratified", "random_stratified"))


@query(f"""
    {IQR} select algorithm, 'cluster_random' as comparison, round(c / r, 6) as ratio from v
    union all select algorithm, 'cluster_stratified', round(c / s, 6) from v union all select algorithm, 'random_stratified', round(r / s, 6) from v
""")
def fragility_ratio_long(spark, d):
    return rounded(_ratios(spark, d).unpivot(["algorithm"], ["cluster_random", "cluster_stratified", "random_stratified"], "comparison", "ratio"))


SEVERITY = "case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' when 'click' then 'INFO' else 'OTHER' end"


def _issues(spark, d):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARNING").when(kind == "click", "INFO").otherwise("OTHER")
    return table(spark, d, "events").select(
        "event_id", severity.alias("severity"), kind.alias("code"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("path")
    )


@query(f"""
    select severity, coalesce(n, 0) as n from (values ('ERROR'), ('WARNING'), ('INFO')) t(severity) left
    join (select {SEVERITY} as severity, count(*) as n from events group by 1) using (severity)
""")
def issue_severity_counts(spark, d):
    counts = _issues(spark, d).groupBy("severity").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([("ERROR",), ("WARNING",), ("INFO",)], "severity string")
    return known.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""
    with i as (select event_id, {SEVERITY} as severity, event_type as code, case when user_id % 3 > 0 then 'user' || cast(user_id as varchar) end as path
    from events), o as (select *, row_number() over (order by case severity when 'ERROR' then 0 when 'WARNING' then 1 when 'INFO' then 2 else 9 end, code,
    coalesce(path, ''), event_id) as place from i) select place, severity, code, path from o where place <= 100
""")
def issue_top_100(spark, d):
    """A top-k report: the first hundred issues in order; issue_sort_all returns them all."""
    order = [severity_rank(F.col("severity")), F.col("code"), F.coalesce("path", F.lit("")), F.col("event_id")]
    first = _issues(spark, d).orderBy(*order).limit(100)
    return first.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "severity", "code", "path")


@query(f"""
    with i as (select event_id, {SEVERITY} as severity, event_type as code, case when user_id % 3 > 0 then 'user' || cast(user_id as varchar) end as path
    from events) select event_id, severity, code, path from i order by case severity when 'ERROR' then 0 when 'WARNING' then 1 when 'INFO' then 2 else 9
    end, code, coalesce(path, ''), event_id
""")
def issue_sort_all(spark, d):
    """Every issue, in order."""
    return issue_order(_issues(spark, d), "event_id").select("event_id", "severity", "code", "path")


@query(f"""
    with s as ({ranked_sql('documents', 'doc_id')}), t as (select {CUT_SQL}
    from s) select partition, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as fraction from t group by 1
""")
def split_fractions(spark, d):
    return rounded(splits.fractions(splits.random_split(table(spark, d, "documents").select("doc_id"), "doc_id")))


# ---- splits ----


@query(f"with s as ({ranked_sql('documents', 'doc_id')}) select doc_id, rk as position, {CUT_SQL} from s")
def split_random(spark, d):
    return splits.random_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"with {LABELLED}, s as ({ranked_sql('labelled', 'doc_id', by='quality', keep='quality, ')}) select doc_id, quality, rk as position, {CUT_SQL} from s")
def split_stratified(spark, d):
    return splits.stratified_split(labelled(spark, d).select("doc_id", "quality"), "doc_id", "quality")


POOL = """
    with x as (select doc_id, lang, s.seed from documents, (values (1), (2), (3)) s(seed)), s as (select *, row_number() over (partition by seed, lang
    order by md5(cast(doc_id as varchar) || ':' || cast(seed as varchar)), doc_id) as rk, count(*) over (partition by seed, lang) as n from x)
"""


@query(f"{POOL}, t as (select seed, lang, {CUT_SQL} from s) select seed, lang, partition, count(*) as n from t group by 1, 2, 3")
def split_pools(spark, d):
    rows = splits.split_pool(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", [1, 2, 3], "lang")
    return splits.label_counts(rows, "seed", "lang", "partition")


@query(f"""
    with {LABELLED}, s as ({ranked_sql('labelled', 'doc_id', 7, by='quality', keep='quality, ')}), t as (select count(*) as total from labelled),
    u as (select doc_id, quality from s, t where rk <= greatest(1, round_even(cast(60 as double) / total * n, 0))),
    v as ({ranked_sql('u', 'doc_id', 7, keep='quality, ')}) select doc_id, quality from v where rk <= 60
""")
def stratified_sample(spark, d):
    return cleaning.stratified_sample(labelled(spark, d).select("doc_id", "quality"), "doc_id", "quality", 60, 7)


GREEDY = """
    c as (select source, count(*) as size from documents group by 1), o as (select *, coalesce(sum(size) over (order by md5(source || ':42'),
    source rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as total from c),
    x as (select *, before < round_even(cast(0.2 as double) * total, 0) as is_test from o), y as (select *, coalesce(sum(size) over (partition by is_test
    order by md5(source || ':42'), source rows between unbounded preceding and 1 preceding), 0) as rest from x),
    z as (select source, size, case when is_test then 'test' when rest < round_even(cast(0.1 as double) * total, 0) then 'val' else 'train' end as
    partition from y)
"""


@query(f"with {GREEDY} select source, cast(size as bigint) as size, partition from z")
def greedy_cluster_split(spark, d):
    return splits.greedy_clusters(table(spark, d, "documents"), "source")


@query(f"with {GREEDY} select doc_id, d.source, partition from documents d join z on d.source = z.source")
def split_group(spark, d):
    return splits.cluster_split(table(spark, d, "documents").select("doc_id", "source"), "source")


@query(f"""
    with t as (select ts, row_number() over (order by ts) as k, count(*) over () as n from events), h as (select ts, min(k) as rk, max(n) as n from t group by 1)
    select event_id, {CUT_SQL} from events join h using (ts)
""")
def split_temporal(spark, d):
    return splits.temporal_split(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


@query(f"with s as ({ranked_sql('documents', 'doc_id')}) select doc_id, cast((rk - 1) % 5 as int) as fold from s")
def kfold_assignment(spark, d):
    return splits.kfold(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"with s as ({ranked_sql('documents', 'doc_id', by='lang', keep='lang, ')}) select doc_id, lang, cast((rk - 1) % 5 as int) as fold from s")
def stratified_kfold(spark, d):
    return splits.kfold(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", stratum="lang")


@query("""
    with g as (select distinct source from documents), s as (select source, row_number() over (order by md5(source || ':42'), source) as rk
    from g) select doc_id, source, cast((rk - 1) % 5 as int) as fold from documents join s using (source)
""")
def group_kfold(spark, d):
    return splits.group_kfold(table(spark, d, "documents").select("doc_id", "source"), "source")


@query("""
    with t as (select ts, count(*) as n from events group by 1), f as (select ts, cast(floor(coalesce(sum(n) over (order by ts rows between unbounded
    preceding and 1 preceding), 0) * 5 / cast(sum(n) over () as double)) as int) as fold from t) select event_id, fold from events join f using (ts)
""")
def time_series_folds(spark, d):
    return splits.time_series_folds(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


# ---- leakage ----

PARTS = f"s as ({ranked_sql('documents', 'doc_id')}), parts as (select doc_id, {CUT_SQL} from s)"


def pairs_sql(value: str) -> str:
    return f"select a.part_a, a.part_b, count(x.v) as n_shared from (values ('test', 'train'), ('test', 'val'), ('train', 'val')) a(part_a, part_b) left join (select distinct p.partition as pa, q.partition as pb, p.v from (select {value} as v, partition from full_parts) p join (select {value} as v, partition from full_parts) q on p.v = q.v) x on x.pa = a.part_a and x.pb = a.part_b group by 1, 2"


def _parts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return splits.random_split(docs.select("doc_id"), "doc_id").join(docs, "doc_id")


FULL = f"with {PARTS}, full_parts as (select p.doc_id, partition, text, source from parts p join documents d on p.doc_id = d.doc_id) "


@query(FULL + pairs_sql("doc_id"))
def leak_index_overlap(spark, d):
    return leakage.index_overlap(splits.random_split(table(spark, d, "documents").select("doc_id"), "doc_id"), "doc_id")


@query(FULL + pairs_sql("text"))
def leak_exact_duplicate(spark, d):
    return leakage.exact_duplicates(_parts(spark, d), "text")


@query(FULL + pairs_sql("source"))
def leak_group_overlap(spark, d):
    return leakage.group_overlap(_parts(spark, d), "source")


SIMILARITY = "round(list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])), 9)"


@query(
    f"with s as ({ranked_sql('embeddings', 'vec_id')}), parts as (select vec_id, {CUT_SQL} from s), v as (select vec_id, partition, embedding from embeddings join parts using (vec_id)), "
    f"x as (select least(x.partition, y.partition) as part_a, greatest(x.partition, y.partition) as part_b, x.vec_id as a, {SIMILARITY} as similarity from v x join v y on x.vec_id < y.vec_id and x.partition <> y.partition where {SIMILARITY} >= 0.4) "
    "select part_a, part_b, count(x.a) as n_pairs, round(max(similarity), 6) as max_similarity from (values ('test', 'train'), ('test', 'val'), ('train', 'val')) t(part_a, part_b) left join x using (part_a, part_b) group by 1, 2"
)
def leak_embedding_similarity(spark, d):
    """All pairs of different parts at the threshold."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    parts = splits.random_split(v.select("vec_id"), "vec_id").select("vec_id", "partition")
    found = pairs_above(v.join(parts, "vec_id"), 0.4, "vec_id", part="partition")
    return rounded(leakage.similar_embeddings(found, parts, "vec_id", 0.4))


@query(
    f"select x.vec_id as a, y.vec_id as b, round({SIMILARITY}, 6) as similarity from embeddings x join embeddings y on x.vec_id < y.vec_id where {SIMILARITY} >= 0.45"
)
def similar_embedding_pairs(spark, d):
    return rounded(pairs_above(table(spark, d, "embeddings"), 0.45, "vec_id"))


def alike_sql(x: str, y: str, threshold: float) -> str:
    return f"levenshtein({x}, {y}) <= floor((1 - cast({threshold} as double)) * greatest(length({x}), length({y})) + 1e-9)"


def leak_identity_sql(threshold: float) -> str:
    return (
        f"with s as ({ranked_sql('customer', 'c_custkey')}), v as (select c_name as seq, {CUT_SQL} from s join customer using (c_custkey)), u as (select distinct seq, partition from v), "
        "p as (select distinct least(a.partition, b.partition) as part_a, greatest(a.partition, b.partition) as part_b, least(a.seq, b.seq) as sa, greatest(a.seq, b.seq) as sb "
        f"from u a join u b on a.partition < b.partition and {alike_sql('a.seq', 'b.seq', threshold)}) "
        "select part_a, part_b, count(p.sa) as n_pairs, round(max(1 - levenshtein(sa, sb) / cast(greatest(length(sa), length(sb)) as double)), 6) as max_identity "
        "from (values ('test', 'train'), ('test', 'val'), ('train', 'val')) t(part_a, part_b) left join p using (part_a, part_b) group by 1, 2"
    )


def named_parts(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return splits.random_split(c.select("c_custkey"), "c_custkey").join(c, "c_custkey")


@query(leak_identity_sql(0.9))
def leak_sequence_identity(spark, d):
    """Names as sequences: pairs of different parts with an identity of 0.9 or more."""
    return rounded(identity.similar_sequences(named_parts(spark, d), "c_custkey", "c_name", 0.9))


@query(leak_identity_sql(0.3))
def leak_sequence_identity_low(spark, d):
    """The same at 0.3, where blocks of names are compared; they share a word, so nearly all pairs are similar, and are only counted."""
    return rounded(identity.similar_sequences(named_parts(spark, d), "c_custkey", "c_name", 0.3))


def clustered_sql(name: str, key: str, seq: str, threshold: float) -> str:
    """Recursive tables: seqs (seq, rep), edges (a, b), both ways, and clusters (seq, cluster)."""
    return (
        f"seqs as (select {seq} as seq, min({key}) as rep from {name} group by 1), "
        f"edges as (select a.rep as a, b.rep as b from seqs a join seqs b on {alike_sql('a.seq', 'b.seq', threshold)}), "
        "reach as (select rep as node, rep as root from seqs union select e.b, r.root from reach r join edges e on e.a = r.node), "
        "clusters as (select seq, min(root) as cluster from reach join seqs on node = rep group by 1)"
    )


CLUSTERED = clustered_sql("part", "p_partkey", "p_name", 0.75)


@query(f"with recursive {CLUSTERED} select p_partkey, cluster from part join clusters on seq = p_name")
def identity_clusters(spark, d):
    """Clusters of names by chains of an identity of 0.75 or more."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return identity.identity_clusters(p, "p_partkey", "p_name", 0.75).select("p_partkey", "cluster")


# ---- order and selection ----


@query(f"""
    with {RESULTS}, o as (select *, row_number() over (partition by algorithm, partition
    order by metric, run) as k, count(*) over (partition by algorithm, partition) as n
    from r) select algorithm, partition, run, metric, case when k = 1 then 'worst' when k = n // 2 + 1 then 'median' else 'best' end as role from o
    where k in (1, n // 2 + 1, n)
""")
def representative_seeds(spark, d):
    return fragility.representatives(results(spark, d), ["algorithm", "partition"], "metric", "run").select("algorithm", "partition", "run", "metric", "role")


@query(f"with {RESULTS} select algorithm, partition, seed, metric from r order by algorithm, partition, seed, metric")
def sort_summary(spark, d):
    return results(spark, d).select("algorithm", "partition", "seed", "metric").orderBy("algorithm", "partition", "seed", "metric")


@query(
    f"with {RESULTS} select distinct algorithm, partition, cast(case partition when 'Random' then 0 when 'Stratified' then 1 else 2 end as int) as position from r"
)
def category_order(spark, d):
    rows = results(spark, d).select("algorithm", "partition").distinct()
    return fragility.in_order(rows, "partition", ["Random", "Stratified", "Cluster aware"])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query(f"with {RESULTS} select algorithm, seed, run, metric from r qualify row_number() over (partition by algorithm, seed order by metric desc, run) = 1")
def best_params(spark, d):
    return fragility.best_by(results(spark, d), ["algorithm", "seed"], "metric", "run").select("algorithm", "seed", "run", "metric")


@query(f"select place, doc_id from (select row_number() over (order by md5(cast(doc_id as varchar) || ':3'), doc_id) as place, doc_id from documents)")
def shuffle_order(spark, d):
    from .operators.ranking import ranked

    return ranked(table(spark, d, "documents").select("doc_id"), "doc_id", 3).select(F.col("__rank").alias("place"), "doc_id")


# ---- provenance ----


def runs(spark, d) -> DataFrame:
    """A run for each supplier; its specs' fingerprints are digests of nation keys, which runs share."""
    s = table(spark, d, "supplier")
    prints: dict[str, Column] = {
        k: F.sha2(F.concat(F.lit(f"{k}:"), F.pmod(F.col("s_nationkey") + n, F.lit(7)).cast("string")), 256) for n, k in enumerate(KINDS)
    }
    rows = s.select(
        "s_suppkey", *[c.alias(f"{k}_fingerprint") for k, c in prints.items()],
        *[F.concat(F.lit(f"{k}_"), F.pmod(F.col("s_nationkey") + n, F.lit(7)).cast("string")).alias(f"{k}_name") for n, k in enumerate(KINDS)]
    )
    salt = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string"))
    return rows.withColumn("run_id", run_id_column({k: F.col(f"{k}_fingerprint") for k in KINDS}, salt))


def artifacts(spark, d) -> DataFrame:
    """A metrics file and a model without checksum for each run."""
    kinds = F.explode(
        F.array(
            F.struct(F.lit("metrics").alias("kind"), F.lit("json").alias("format"), F.lit("c0ffee").alias("checksum")),
            F.struct(F.lit("model").alias("kind"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("checksum"))
        )
    )
    return runs(spark, d).select("run_id", "s_suppkey", kinds.alias("a")).select(
        "run_id", "a.kind", F.concat(F.lit("out/"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("a.kind")).alias("path"), "a.format", "a.checksum"
    )


def _runs_sql() -> str:
    prints = ", ".join(
        f"sha256('{k}:' || cast((s_nationkey + {n}) % 7 as varchar)) as {k}_fingerprint, '{k}_' || cast((s_nationkey + {n}) % 7 as varchar) as {k}_name" for n,
        k in enumerate(KINDS)
    )
    body = " || ".join(
        f"'{',' if n else '{'}\"{k}\":' || " + (
            "case when s_suppkey % 2 = 0 then '\"' || cast(s_suppkey as varchar) || '\"' else 'null' end" if k == "salt" else f"'\"' || {k}_fingerprint || '\"'"
        ) for n,
        k in enumerate(sorted([*KINDS, "salt"]))
    )
    return f"with base as (select s_suppkey, {prints} from supplier), runs as (select *, sha256({body} || '}}') as run_id from base), artifacts as (select run_id, kind, 'out/' || cast(s_suppkey as varchar) || '/' || kind as path, format, checksum from runs, (values ('metrics', 'json', 'c0ffee'), ('model', null, null)) a(kind, format, checksum)) "


ARTIFACT_SQL = "'artifact:' || sha256(run_id || '|' || kind || '|' || path || '|' || coalesce(format, 'None') || '|' || coalesce(checksum, 'None'))"


@query(_runs_sql() + "select s_suppkey, run_id from runs")
def run_id_hash(spark, d):
    return runs(spark, d).select("s_suppkey", "run_id")


@query(_runs_sql() + f"select path, {ARTIFACT_SQL} as artifact_id from artifacts")
def artifact_node_id(spark, d):
    return artifacts(spark, d).select("path", artifact_id_column(*(F.col(c) for c in ("run_id", "kind", "path", "format", "checksum"))).alias("artifact_id"))


@query(
    _runs_sql() + " union ".join(
        f"select '{k}:' || {k}_fingerprint as id, 'spec' as type, '{k}:' || {k}_name as label from runs" for k in KINDS
    ) + f" union select 'run:' || run_id, 'run', 'run:' || substr(run_id, 1, 12) from runs union select {ARTIFACT_SQL}, 'artifact', kind || ':' || path from artifacts"
)
def lineage_nodes(spark, d):
    return nodes_of(runs(spark, d), artifacts(spark, d))


@query(
    _runs_sql() + " union all ".join(
        f"select 'run:' || run_id as source, '{k}:' || {k}_fingerprint as target, 'uses' as relation from runs" for k in KINDS
    ) + f" union all select 'run:' || run_id, {ARTIFACT_SQL}, 'produces' from artifacts"
)
def lineage_edges(spark, d):
    return edges_of(runs(spark, d), artifacts(spark, d))


@query("""
    select p_partkey as key, 'old' as value from part where p_partkey % 3 = 0 union all select p_partkey, 'new' from part
    where p_partkey % 2 = 0 and p_partkey % 3 <> 0
""")
def registry_put_if_absent(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return put_if_absent(p.where("key % 3 = 0").withColumn("value", F.lit("old")), p.where("key % 2 = 0").withColumn("value", F.lit("new")), ["key"])


@query("""
    select l_returnflag as model, l_linestatus as status, round(sqrt(avg(power(l_extendedprice - 1000 * l_quantity, 2))),
    4) as rmse, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 4) as mae, round(1 - sum(power(l_extendedprice - 1000 * l_quantity, 2)) /
    (var_pop(l_extendedprice) * count(*)), 6) as r2 from lineitem group by 1, 2
""")
def regression_metrics(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * 1000).alias("y_pred")
    )
    m = metrics.regression_metrics(rows, ["model", "status"])
    return m.select("model", "status", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as \"end\", event_type, count(*) as n from events group by 1, 2, 3")
def label_drift(spark, d):
    from .streaming.ingest import label_counts as counts

    return counts(table(spark, d, "events"), "ts", "event_type")


# ---- compiled specifications ----

SPLIT_SPEC = {
    "split_name": "audit", "protocol": "group", "ratios": {"train": 0.7, "val": 0.1, "test": 0.2}, "seed": 42, "group_field": "source",
    "leakage_checks": [{"type": "group_overlap", "field": "source"}, {"type": "exact_duplicate", "scope": "train_test"}],
}


@query(f"""
    with {GREEDY}, full_parts as (select d.doc_id, d.source, text, partition from documents d join z on d.source = z.source),
    e as ({pairs_sql('text')}) select cast(0 as int) as \"check\", 'group_overlap' as type, part_a, part_b, cast(0 as bigint) as n_shared from e
    union all select 1, 'exact_duplicate', part_a, part_b, n_shared from e where part_b = 'train'
""")
def compiled_checks(spark, d):
    spec = parse("split", SPLIT_SPEC)
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return plans.compile_checks(plans.compile_split(docs, spec, "doc_id"), spec, "doc_id", "text")


DATASET_SPEC = {
    "name": "documents", "sources": [{"type": "internal", "name": "driver"}], "id_field": "doc_id", "sequence_field": "text", "metadata": [{"name": "lang", "dtype": "category"}, {"name": "source", "dtype": "str"}],
    "filters": [{"field": "sequence_length", "op": "between", "value": [500, 3000]}, {"field": "lang", "op": "in", "value": ["en", "de"]}], "redundancy_control": {"method": "sequence_identity", "threshold": 1.0},
}


@query("""
    select doc_id, lang, source from (select *, row_number() over (partition by text order by doc_id) as rn from documents
    where length(text) between 500 and 3000 and lang in ('en', 'de')) where rn = 1
""")
def compiled_dataset(spark, d):
    return plans.compile_dataset(table(spark, d, "documents"), parse("dataset", DATASET_SPEC)).drop("text")


IDENTITY_SPEC = DATASET_SPEC | {
    "id_field": "p_partkey", "sequence_field": "p_name", "metadata": [{"name": "p_brand", "dtype": "str"}], "filters": [], "redundancy_control": {"method": "sequence_identity", "threshold": 0.75},
}


@query(f"with recursive {CLUSTERED} select p_partkey, p_name, p_brand from part join clusters on seq = p_name where p_partkey = cluster")
def redundancy_identity(spark, d):
    """One row of each cluster of similar names: that with the smallest id."""
    return plans.compile_dataset(table(spark, d, "part"), parse("dataset", IDENTITY_SPEC))


IDENTITY_SPLIT = SPLIT_SPEC | {
    "protocol": "cluster_aware", "group_field": None, "identity": {"measure": "sequence_identity", "threshold": 0.75},
    "leakage_checks": [{"type": "sequence_identity", "threshold": 0.75}]
}


def split_checks_sql(name: str, key: str, seq: str, threshold: float, test: float, val: float, checks: str, where: str = "true") -> str:
    """Clusters of similar sequences, packed into parts, and then ``checks`` of u (rep, seq, partition) and edges."""
    return f"""
        with recursive rows as (select * from {name} where {where}), {clustered_sql('rows', key, seq, threshold)},
        c as (select cluster, count(*) as size from rows join clusters on seq = {seq} group by 1),
        o as (select *, coalesce(sum(size) over (order by md5(cluster || ':42'), cluster rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as total from c),
        x as (select *, before < round_even(cast({test} as double) * total, 0) as is_test from o),
        y as (select *, coalesce(sum(size) over (partition by is_test order by md5(cluster || ':42'), cluster rows between unbounded preceding and 1 preceding), 0) as rest from x),
        z as (select cluster, case when is_test then 'test' when rest < round_even(cast({val} as double) * total, 0) then 'val' else 'train' end as partition from y),
        u as (select distinct rep, seq, partition from clusters join z using (cluster) join seqs using (seq)),
        p as (select a.partition as part_a, b.partition as part_b, count(*) as n from u a join edges e on a.rep = e.a join u b on b.rep = e.b where a.partition < b.partition group by 1, 2)
        {checks}"""


@query(split_checks_sql(
    "part", "p_partkey", "p_name", 0.75, 0.2, 0.1,
    "select cast(0 as int) as \"check\", 'sequence_identity' as type, part_a, part_b, coalesce(n, 0) as n_shared from (values ('test', 'train'), ('test', 'val'), ('train', 'val')) t(part_a, part_b) left join p using (part_a, part_b)",
))
def identity_split_checks(spark, d):
    """A cluster-aware split by sequence identity has no pair of similar names across its parts."""
    spec = parse("split", IDENTITY_SPLIT)
    parts = plans.compile_split(table(spark, d, "part").select("p_partkey", "p_name"), spec, "p_partkey", sequence="p_name")
    return plans.compile_checks(parts, spec, "p_partkey", "p_name")


def short_documents(spark, d):
    """Documents with their text in ASCII: DuckDB's levenshtein counts bytes."""
    return table(spark, d, "documents").withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))


SHORT_SQL = "(select * replace (regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') as text) from documents)"

LOW_DATASET = DATASET_SPEC | {
    "filters": [{"field": "sequence_length", "op": "between", "value": [1, 500]}], "redundancy_control": {"method": "sequence_identity", "threshold": 0.3},
}


@query(
    f"with recursive rows as (select * from {SHORT_SQL} where length(text) between 1 and 500), {clustered_sql('rows', 'doc_id', 'text', 0.3)} "
    "select doc_id, lang, source from rows join clusters on seq = text where doc_id = cluster"
)
def redundancy_identity_low(spark, d):
    """Short documents, one of each cluster of an identity of 0.3."""
    return plans.compile_dataset(short_documents(spark, d), parse("dataset", LOW_DATASET)).drop("text")


LOW_SPLIT = SPLIT_SPEC | {
    "split_name": "low", "protocol": "cluster_aware", "ratios": {"train": 0.8, "val": 0.1, "test": 0.1}, "group_field": None,
    "identity": {"measure": "sequence_identity", "threshold": 0.3},
    "leakage_checks": [{"type": "sequence_identity", "scope": "train_test", "threshold": 0.3}, {"type": "sequence_identity", "scope": "all", "threshold": 0.25}, {"type": "exact_duplicate", "scope": "all"}],
}


@query(split_checks_sql(
    SHORT_SQL, "doc_id", "text", 0.3, 0.1, 0.1,
    f"""
        , q as (select a.partition as part_a, b.partition as part_b, count(*) as n from u a join u b on a.partition < b.partition and {alike_sql('a.seq', 'b.seq', 0.25)} group by 1, 2),
        t as (select * from (values ('test', 'train'), ('test', 'val'), ('train', 'val')) t(part_a, part_b))
        select cast(0 as int) as "check", 'sequence_identity' as type, part_a, part_b, coalesce(n, 0) as n_shared from t left join p using (part_a, part_b) where part_b = 'train'
        union all select 1, 'sequence_identity', part_a, part_b, coalesce(n, 0) from t left join q using (part_a, part_b)
        union all select 2, 'exact_duplicate', part_a, part_b, 0 from t""",
    "length(text) between 1 and 500",
))
def identity_split_low(spark, d):
    """A cluster-aware split of short documents at an identity of 0.3: none across train and test; some at 0.25."""
    spec = parse("split", LOW_SPLIT)
    docs = short_documents(spark, d).select("doc_id", "text").where("length(text) between 1 and 500")
    return plans.compile_checks(plans.compile_split(docs, spec, "doc_id", sequence="text"), spec, "doc_id", "text")
