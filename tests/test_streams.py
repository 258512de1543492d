"""Streams fed file by file."""

import datetime as dt

from gleanery.operators import reports
from gleanery.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def put(spark, path, rows, schema, k):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}")


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_sessions_close_after_the_gap(spark, tmp_path):
    schema = "library_id string, key string, captured_at timestamp"
    at = lambda h: T0 + dt.timedelta(hours=h)
    for k, hours in enumerate([[0, 4], [8], [13, 40]]):
        put(spark, f"{tmp_path}/in", [("l", f"k{h}", at(h)) for h in hours], schema, k)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drained(streams.stream_sessions(src), "closed")
    assert {r.n for r in spark.table("closed").collect()} == {3, 1}


def test_pairs_arrive_in_either_order(spark, tmp_path):
    schema = "library_id string, key string, captured_at timestamp"
    for k, rows in enumerate([[("l", "b", T0 + dt.timedelta(minutes=50))], [("l", "a", T0), ("l", "c", T0 + dt.timedelta(minutes=111))]]):
        put(spark, f"{tmp_path}/in", rows, schema, k)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drained(streams.stream_candidate_pairs(src), "paired")
    assert [(r.key_a, r.key_b) for r in spark.table("paired").collect()] == [("a", "b")]


def test_journal_folds_to_a_snapshot(spark, tmp_path):
    schema = "seq long, key string, value string"
    put(spark, f"{tmp_path}/in", [(i, f"k{i}", "pick") for i in range(20)], schema, 0)
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    go = lambda: streams.keep_snapshot(src, f"{tmp_path}/snap", f"{tmp_path}/check").awaitTermination()
    go()
    put(spark, f"{tmp_path}/in", [(30, "k1", "reject"), (31, "k2", None)], schema, 1)
    go()
    got = {r.key: r.decision for r in streams.read_snapshot(spark, f"{tmp_path}/snap").collect()}
    assert len(got) == 19 and got["k1"] == "reject" and "k2" not in got


def test_pending_deletions_stay_live(spark, tmp_path):
    schema, day = "date_us long, asset_keys array<string>", 86_400 * 1_000_000
    src = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen, now = [], [40 * day]
    show = lambda df: seen.extend((r.pending, r.oldest_us) for r in df.collect())
    go = lambda: streams.stream_pending_deletions(src(), f"{tmp_path}/ledger", f"{tmp_path}/check", show, lambda: now[0]).awaitTermination()
    put(spark, f"{tmp_path}/in", [(9 * day, ["old"] * 50), (39 * day, ["a"] * 100)], schema, 0)
    go()
    put(spark, f"{tmp_path}/in", [(41 * day, ["b"] * 7)], schema, 1)
    now[0] = 42 * day
    go()
    assert seen == [(100, 39 * day), (107, 39 * day)]
    whole = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert streams.read_pending(spark, f"{tmp_path}/ledger", 70 * day).collect() == reports.pending_deletions(whole, 70 * day).collect()


def test_changes_are_debounced_and_versions_come_once(spark, tmp_path):
    schema = "library_id string, key string, ts timestamp, modification_date timestamp"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    put(spark, f"{tmp_path}/in", [("l", "a", at(s), T0) for s in (0, 1, 2.5)] + [("l", "b", at(60), T0)], schema, 0)
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drained(streams.debounce_changes(src), "quiet")
    assert [r.changes for r in spark.table("quiet").collect()] == [3]
    drained(streams.stream_assets(spark, f"{tmp_path}/in/0", schema), "versions")
    assert spark.table("versions").count() == 2


def test_latest_decisions_stream(spark, tmp_path):
    schema = "seq long, key string, value string"
    put(spark, f"{tmp_path}/in", [(1, "a", "pick"), (2, "a", None), (3, "b", "reject")], schema, 0)
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drained(streams.stream_decisions(src), "latest", "complete")
    assert sorted(map(tuple, spark.table("latest").collect())) == [("a", None, 2), ("b", "reject", 3)]


def test_a_ledger_stream_writes_each_batch_once(spark, tmp_path):
    schema = "date_us long, asset_keys array<string>"
    src = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for k in range(3):
        put(spark, f"{tmp_path}/in", [(k, [f"k{k}"] * (k + 1))], schema, k)
        streams.stream_ledger(src(), f"{tmp_path}/ledger", f"{tmp_path}/check").awaitTermination()
    assert streams.Ledger(spark, f"{tmp_path}/ledger").total().first().total == 6
