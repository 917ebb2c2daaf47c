"""State kept over several runs of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.streaming import state

SCHEMA = "key long, at timestamp, ident long, value string"


def put(spark, path, n, rows):
    df = spark.createDataFrame([(k, f"2024-01-{d:02d} 00:00:00", i, v) for k, d, i, v in rows], "key long, at string, ident long, value string")
    df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{path}/in", mode="append")


def run(spark, path, make, mode="append"):
    """What one run over all that is new gives; the checkpoint is kept."""
    got = []
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = make(s).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def test_changes_across_runs(spark, tmp_path):
    put(spark, tmp_path, 1, [(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, "b"), (2, 1, 4, "x")])
    assert sorted(r.ident for r in run(spark, tmp_path, state.changes)) == [1, 3, 4]
    put(spark, tmp_path, 2, [(1, 4, 5, "b"), (2, 2, 6, "y")])
    assert [r.ident for r in run(spark, tmp_path, state.changes)] == [6]


def test_actions_across_runs(spark, tmp_path):
    make = lambda s: state.actions(s.select("key", "at", "ident", F.col("value").alias("hash")))
    put(spark, tmp_path, 1, [(1, 1, 1, "h1"), (1, 2, 2, "h1"), (2, 1, 3, None)])
    assert {r.ident: r.action for r in run(spark, tmp_path, make)} == {1: "index", 2: "skip", 3: "skip"}
    put(spark, tmp_path, 2, [(1, 3, 4, None), (1, 4, 5, None), (1, 5, 6, "h1"), (1, 6, 7, "h2"), (2, 2, 8, "h")])
    assert {r.ident: r.action for r in run(spark, tmp_path, make)} == {4: "delete", 5: "skip", 6: "restore", 7: "reindex", 8: "index"}


def test_idle_tasks_end(spark, tmp_path):
    put(spark, tmp_path, 1, [(1, 1, 1, "scraping")])
    make = lambda s: state.tasks(s, ttl="24 hours")
    assert [(r.key, r.value, r.expired) for r in run(spark, tmp_path, make)] == [(1, "scraping", False)]
    put(spark, tmp_path, 2, [(2, 9, 2, "done")])
    got = run(spark, tmp_path, make)
    put(spark, tmp_path, 3, [(3, 10, 3, "done")])
    got += run(spark, tmp_path, make)
    assert (1, "scraping", True) in [(r.key, r.value, r.expired) for r in got]


def test_once(spark, tmp_path):
    put(spark, tmp_path, 1, [(1, 1, 1, "a"), (1, 1, 2, "a"), (1, 1, 3, "b")])
    make = lambda s: state.once_within(s, ["key", "value"], late="30 days")
    assert sorted(r.value for r in run(spark, tmp_path, make)) == ["a", "b"]
    put(spark, tmp_path, 2, [(1, 2, 4, "a"), (1, 2, 5, "c")])
    assert [r.value for r in run(spark, tmp_path, make)] == ["c"]
