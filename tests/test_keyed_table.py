"""A table that several writers put rows into at once."""

import threading

from pyspark.sql import functions as F

from splitwarden.sources.keyed import KeyedTable

SCHEMA = "key long, value string"


def test_two_writers_at_once_leave_one_row_for_each_key(spark, tmp_path):
    folder, failed, put = f"file://{tmp_path}/a table", [], {}

    def write(name, low, high):
        try:
            table = KeyedTable(spark, folder, SCHEMA, ["key"])
            put[name] = sum(table.put(spark.range(low + k, high + k).select(F.col("id").alias("key"), F.lit(name).alias("value"))) for k in range(3))
        except Exception as error:
            failed.append(error)

    writers = [threading.Thread(target=write, args=a) for a in (("x", 0, 60), ("y", 30, 90), ("z", 0, 90))]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed
    table = KeyedTable(spark, folder, SCHEMA, ["key"])
    rows = table.read().collect()
    assert sorted(r.key for r in rows) == list(range(92)) and sum(put.values()) == 92
    assert len(table.commits()) == len(set(table.commits())) >= 2
    assert table.put(spark.createDataFrame(rows, SCHEMA)) == 0


def test_a_commit_is_made_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["key"])
    assert table.read().count() == 0 == table.put(spark.createDataFrame([], SCHEMA))
    assert [table._create(0, "rows-a"), table._create(0, "rows-b"), table._create(1, "rows-c")] == [True, False, True]
    assert table.commits() == ["rows-a", "rows-c"]


def test_first_of_a_key_and_null_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["key"])
    rows = [(1, "b"), (1, "a"), (None, "n"), (None, "m"), (2, None)]
    assert table.put(spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1)), order=["value"]) == 3
    assert table.put(spark.createDataFrame([(None, "later"), (3, "c")], SCHEMA)) == 1
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([(1, "a"), (2, None), (None, "m"), (3, "c")], key=str)
    (tmp_path / "t" / "rows-lost").mkdir()  # what a writer left that failed before its commit
    assert table.read().count() == 4


def test_two_streams_into_one_table(spark, tmp_path):
    import json

    from splitwarden.streaming.ingest import RUN_SCHEMA, ingest_runs

    table = KeyedTable(spark, str(tmp_path / "runs"), RUN_SCHEMA, ["run_id"])
    streams = []
    for name, ids in (("one", "abc"), ("two", "bcd")):
        (tmp_path / name).mkdir()
        for k in ids:
            (tmp_path / name / f"{k}.json").write_text(json.dumps({"run_id": k * 16, "created_at_utc": "2024-01-01", "notes": name}))
        streams.append(ingest_runs(spark, str(tmp_path / name), table, str(tmp_path / f"{name}-state")))
    [s.awaitTermination(120) for s in streams]
    rows = table.read().collect()
    assert sorted(r.run_id[0] for r in rows) == ["a", "b", "c", "d"] and {r.notes for r in rows} == {"one", "two"}
