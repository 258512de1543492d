"""Stores that are kept between runs: whole states, batches once, crashes between the steps."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import components
from gleanery.operators.cache import BucketCache
from gleanery.operators.components import LiveComponents
from gleanery.sources import ledgers
from gleanery.sources.ledgers import Journal, Ledger, commit_deletions
from gleanery.storage import Versions

DAY = 86_400 * 1_000_000


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), Journal.SCHEMA)


def held(journal):
    return {r.key: r.decision for r in journal.read().collect()}


def files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


class Crash(Exception):
    pass


@pytest.fixture
def dies(monkeypatch):
    """Make the n-th call of a method of Versions die, before or after its work."""

    def set_up(method, nth, after=False):
        real, calls = getattr(Versions, method), [0]

        def wrapped(self, *a, **b):
            calls[0] += 1
            if calls[0] != nth:
                return real(self, *a, **b)
            if after:
                real(self, *a, **b)
            raise Crash

        monkeypatch.setattr(Versions, method, wrapped)
        return lambda: monkeypatch.setattr(Versions, method, real)

    return set_up


def test_journal_survives_relaunch_and_folding(spark, tmp_path):
    path = f"{tmp_path}/j"
    Journal(spark, path, 100).append(entries(spark, *((i, f"photos:{i}", "reject") for i in range(110))), 0)
    Journal(spark, path, 100).append(entries(spark, (200, "photos:0", None)), 1)
    Journal(spark, path, 100).append(entries(spark, (201, "photos:1", "pick")), 2)
    got = held(Journal(spark, path, 100))
    assert len(got) == 109 and "photos:0" not in got and got["photos:1"] == "pick" and got["photos:2"] == "reject"


def test_number_of_files_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgers, "MOST_PARTS", 4)
    j, most = Journal(spark, f"{tmp_path}/j", 10**6), 0
    for i in range(12):
        assert j.append(entries(spark, (i, f"k{i % 5}", "pick" if i % 2 else None)), i)
        most = max(most, files(f"{tmp_path}/j"))
    assert held(j) == {k: v for k, v in {f"k{i % 5}": "pick" if i % 2 else None for i in range(12)}.items() if v}
    # Two states are kept: at most the parts of a full tail and those of two snapshots.
    assert most <= 4 * 4 + 2 * 4 and len(os.listdir(f"{tmp_path}/j/states")) <= 2 * 2 + 1


@pytest.mark.parametrize(("method", "nth", "after"), [("put", 1, False), ("put", 1, True), ("commit", 1, False), ("commit", 1, True), ("put", 2, True), ("commit", 2, False), ("commit", 2, True), ("_clean", 1, False), ("_clean", 2, False)])
def test_a_crash_at_any_step_loses_and_doubles_nothing(spark, tmp_path, dies, method, nth, after):
    j = Journal(spark, f"{tmp_path}/j", 3)
    j.append(entries(spark, (1, "a", "pick"), (2, "b", "reject")), 0)
    mend = dies(method, nth, after)
    with pytest.raises(Crash):
        j.append(entries(spark, (3, "a", None), (4, "c", "pick")), 1)  # appends, then folds
    mend()
    before = held(Journal(spark, f"{tmp_path}/j", 3))
    assert before in ({"a": "pick", "b": "reject"}, {"b": "reject", "c": "pick"})  # all of the batch or nothing
    again = Journal(spark, f"{tmp_path}/j", 3)
    again.append(entries(spark, (3, "a", None), (4, "c", "pick")), 1)
    again.append(entries(spark, (5, "d", "pick")), 2)
    assert held(again) == {"b": "reject", "c": "pick", "d": "pick"}


def test_a_torn_state_is_ignored(spark, tmp_path):
    j = Journal(spark, f"{tmp_path}/j")
    j.append(entries(spark, (1, "kept", "reject")), 0)
    with open(f"{tmp_path}/j/states/000000000002.json", "w") as f:
        f.write('{"tail": [{"pa')  # killed while writing
    assert held(Journal(spark, f"{tmp_path}/j")) == {"kept": "reject"}
    j.append(entries(spark, (2, "more", "pick")), 1)
    assert held(j) == {"kept": "reject", "more": "pick"}


def test_of_two_writers_one_fails(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/v")
    v.commit(0, {"x": 1})
    with pytest.raises(Exception, match="already exists"):
        v.commit(0, {"x": 2})
    assert v.latest() == (1, {"x": 1})


def test_repeated_batches_of_the_ledger_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgers, "MOST_PARTS", 3)
    ledger = Ledger(spark, f"{tmp_path}/l")
    rows = lambda i: spark.createDataFrame([(i * DAY, [f"k{i}"] * (i + 1))], "date_us long, asset_keys array<string>")
    for i in range(6):
        assert ledger.append(f"b{i}", rows(i))
        assert not ledger.append(f"b{i}", rows(i))
    assert not ledger.append("b0", rows(0))  # long since folded
    assert ledger.total().first().total == 21
    assert tuple(ledger.pending(33 * DAY).first()) == (11, 4 * DAY)
    ledger.prune(33 * DAY)
    assert ledger.total().first().total == 11


def library(spark, keys):
    return spark.createDataFrame([("l", k, "userLibrary" if k != "synced" else "iTunesSynced") for k in keys], "library_id string, key string, source_type string")


@pytest.mark.parametrize(("method", "nth", "after"), [("put", 1, True), ("commit", 1, False), ("commit", 1, True), ("put", 2, False), ("commit", 2, False), ("commit", 2, True)])
def test_an_interrupted_commit_is_finished_by_its_repetition(spark, tmp_path, dies, method, nth, after):
    ledger, journal = Ledger(spark, f"{tmp_path}/l"), Journal(spark, f"{tmp_path}/j")
    journal.append(entries(spark, *((i, k, "reject") for i, k in enumerate(["a", "b", "c", "synced"])), (9, "p", "pick")), 0)
    candidates = spark.createDataFrame([("l", k) for k in ("a", "b", "gone", "synced")], "library_id string, key string")
    mend = dies(method, nth, after)
    with pytest.raises(Crash):
        commit_deletions(ledger, journal, 1, candidates, library(spark, ["a", "b", "c", "p", "synced"]), 40 * DAY, 10)
    mend()
    recorded = not ledger.read().isEmpty()
    journal.append(entries(spark, (20, "b", "pick")), 1)  # decided anew before the repetition
    # The library has changed meanwhile: "a" is gone, so only a batch that was recorded in time still has it.
    for _ in range(2):
        commit_deletions(ledger, journal, 1, candidates, library(spark, ["b", "c", "p", "synced"]), 40 * DAY, 10)
    assert ledger.total().first().total == (2 if recorded else 1)
    assert ledger.pending(41 * DAY).first().pending == (2 if recorded else 1)
    got = held(journal)
    assert got.pop("a", None) == (None if recorded else "reject")
    assert got == {"b": "pick", "c": "reject", "synced": "reject", "p": "pick"}


CACHE = "key string, seq long, value string"


def test_cache_rewrites_only_touched_buckets(spark, tmp_path):
    c = BucketCache(spark, f"{tmp_path}/c", CACHE, buckets=16)
    make = lambda *rows: spark.createDataFrame(list(rows), CACHE)
    c.upsert(make(*((f"k{i}", 1, f"v{i}") for i in range(400))))
    before = c.versions.latest()[1]["buckets"]
    on_disk = {f: os.stat(f).st_mtime_ns for f in parquet_files(f"{tmp_path}/c")}
    c.upsert(make(("k7", 2, "new"), ("k8", 0, "old"), ("fresh", 1, "x"), ("fresh", 3, "y")))
    after = c.versions.latest()[1]["buckets"]
    touched = set(map(str, c.buckets.touched(make(("k7", 0, ""), ("k8", 0, ""), ("fresh", 0, "")))))
    assert len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == touched
    for f, t in on_disk.items():
        if f"__bucket={f.split('__bucket=')[1].split('/')[0]}" not in {f"__bucket={b}" for b in touched}:
            assert os.stat(f).st_mtime_ns == t
    got = {r.key: (r.seq, r.value) for r in c.read().collect()}
    assert len(got) == 401 and got["k7"] == (2, "new") and got["k8"] == (1, "v8") and got["fresh"] == (3, "y")
    c.prune(make(*((f"k{i}", 0, "") for i in range(400) if i != 9)))
    last = c.versions.latest()[1]["buckets"]
    assert {r.key for r in c.read().collect()} == {f"k{i}" for i in range(400) if i != 9}
    assert sum(last[b] != after.get(b) for b in last) <= 2


def parquet_files(path):
    return [f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_cache_equals_a_dictionary(spark, tmp_path):
    r, want = random.Random(1), {}
    c = BucketCache(spark, f"{tmp_path}/c", CACHE, buckets=4)
    for batch in range(5):
        rows = [(f"k{r.randint(0, 30)}", batch * 10 + i, f"v{batch}-{i}") for i in range(8)]
        for k, s, v in rows:
            want[k] = (s, v)
        assert c.upsert(spark.createDataFrame(rows, CACHE), batch)
        assert not c.upsert(spark.createDataFrame(rows, CACHE), batch)
        if batch == 2:
            want = {k: v for k, v in want.items() if k < "k2"}
            c.prune(spark.createDataFrame([(k,) for k in want], "key string"))
        assert {x.key: (x.seq, x.value) for x in c.read().collect()} == want


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("fold", [0.0, 0.5])
def test_live_components_equal_union_find(spark, tmp_path, fold):
    r, seen = random.Random(int(fold * 10)), []
    live = LiveComponents(spark, f"{tmp_path}/c", "long", fold)
    assert live.read().count() == 0
    for batch in range(4):
        edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.choice([0, 4, 12]))] + [(None, 3), (5, 5)]
        edges += [(1000 - batch, 1001 - batch)]  # a chain that grows at its smaller end
        seen += edges
        df = spark.createDataFrame(edges, "a long, b long")
        assert live.add(df, batch) and not live.add(df, batch)
        assert {x.node: x.component for x in LiveComponents(spark, f"{tmp_path}/c", "long", fold).read().collect()} == union_find(seen)


def test_hubs_are_joined_where_their_edges_are(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_EDGES", 50)
    monkeypatch.setattr(components, "HUB_SHARE", 0.05)
    r = random.Random(3)
    edges = [(7, 1000 + i) for i in range(200)] + [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in components.connected_components(df).collect()}
    assert got == union_find(edges)
    lows = df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    plan = components._with_lows(df, lows, len(edges))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    assert lows.filter("n > 50").count() == 1
