"""Boundaries of sessions, pairs, brackets and groups on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleanery.config import Engine
from gleanery.functions import scalars as S
from gleanery.operators import decisions, groups, pairs, reports, sessions
from gleanery.operators.components import connected_components
from gleanery.sources.assets import asset_schema

BASE = dt.datetime(2023, 11, 14, tzinfo=dt.timezone.utc)
OK = {"tier": "ok", "metrics": None, "reasons": []}
BROKEN = {"tier": "obviouslyBroken", "metrics": None, "reasons": ["Almost entirely black"]}
SOFT = {"tier": "probablyBad", "metrics": None, "reasons": ["Out of focus or motion-blurred"]}
NOW_US = int(dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc).timestamp() * 1e6)


def asset(key, at=0.0, **more):
    row = dict.fromkeys(asset_schema().names)
    when = BASE + dt.timedelta(seconds=at) if at is not None else None
    row |= {"key": key, "library_id": "l", "captured_at": when, "modification_date": when, "media_type": "image", "source_type": "userLibrary", "quality": OK}
    row |= {c: False for c in ("is_screenshot", "is_screen_recording", "is_live_photo", "is_burst_user_pick", "is_burst_auto_pick", "is_favorite", "is_edited_version", "scored_from_stand_in")}
    return row | more


def vector(*v):
    return {"revision": 2, "crop": "scaleFill", "vector": list(map(float, v))}


@pytest.fixture
def made(spark):
    def run(*rows):
        df = spark.createDataFrame(list(rows), asset_schema())
        g = groups.make_groups(groups.make_members(df), NOW_US).collect()
        return {(r.kind, tuple(r.member_keys)): r for r in g}

    return run


def test_hash_across_time_and_a_year_apart(made):
    year = 365 * 86_400
    assert made(asset("a", 0, fingerprint=vector(1)), asset("b", year, fingerprint=vector(1))) == {}
    assert list(made(asset("a", 0, original_hash="h"), asset("b", year, original_hash="h"))) == [("exactDuplicate", ("a", "b"))]
    assert made(asset("a", content_hash="h"), asset("b", content_hash="h")) == {}


def test_undeletable_copy_is_kept(made):
    g = made(asset("mine", 0, original_hash="h"), asset("synced", 5, original_hash="h", source_type="iTunesSynced"))["exactDuplicate", ("mine", "synced")]
    assert (g.keeper, list(g.flagged)) == ("synced", ["mine"])


def test_brackets_and_bursts(made):
    rows = [asset(k, i / 2, exposure_bias=b, fingerprint=vector(1)) for i, (k, b) in enumerate([("a", -2.0), ("b", 0.0), ("c", 2.0)])]
    assert list(made(*rows)) == [("bracket", ("a", "b", "c"))]
    burst = [asset(k, i / 2, exposure_bias=b, burst_identifier="x") for i, (k, b) in enumerate([("a", -1.0), ("b", 0.0), ("c", 1.0)])]
    assert list(made(*burst)) == [("bracket", ("a", "b", "c"))]
    soft = [asset("a", 0, burst_identifier="x", is_burst_user_pick=True), asset("b", 1, burst_identifier="x", quality=SOFT), asset("c", 2, burst_identifier="x", quality=SOFT)]
    g = made(*soft)["burst", ("a", "b", "c")]
    assert (g.keeper, list(g.flagged), round(g.certainty, 3)) == ("a", [], 0.82)


def test_edit_and_original(made):
    g = made(asset("o", 0, fingerprint=vector(1)), asset("e", 10, fingerprint=vector(1), is_edited_version=True))["versions", ("o", "e")]
    assert (g.keeper, list(g.flagged)) == ("e", ["o"])


def test_screenshots_expire_and_videos_stay_out(made):
    month = NOW_US / 1e6 - BASE.timestamp()
    rows = [asset("new", month - 7 * 86_400, is_screenshot=True), asset("old", month - 60 * 86_400, is_screenshot=True), asset("v", 0, media_type="video", quality=BROKEN)]
    g = made(*rows)
    assert list(g) == [("expiredUtility", ("old", "new"))] and list(g["expiredUtility", ("old", "new")].flagged) == ["old"]


def test_unset_clock_makes_no_pairs(spark):
    rows = [asset(f"k{i:02d}", captured_at=dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)) for i in range(50)]
    assert pairs.candidate_pairs(spark.createDataFrame(rows, asset_schema())).count() == 0


@pytest.mark.parametrize(("gap", "pairs_", "n_sessions"), [(3600, 1, 1), (3601, 0, 1), (4 * 3600, 0, 1), (4 * 3600 + 1, 0, 2)])
def test_session_and_window_edges(spark, gap, pairs_, n_sessions):
    df = spark.createDataFrame([asset("a", 0), asset("b", gap)], asset_schema())
    assert pairs.candidate_pairs(df).count() == pairs_
    assert sessions.sessionize(df).select("session_id").distinct().count() == n_sessions


def test_threshold_steps(spark):
    gaps = [0, 2_900_000, 3_000_000, 119_000_000, 120_000_000, 3_599_000_000, 3_600_000_000]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(gaps)], "i int, g long").select("i", S.threshold_for_gap(F.col("g")).alias("t")).orderBy("i")
    assert [r.t for r in rows.collect()] == [0.45, 0.45, 0.35, 0.35, 0.25, 0.25, None]


def test_fnv_of_any_text(spark):
    def plain(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "burst|a|b", "é日"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.fnv1a64_hex(F.col("t")).alias("h")).collect()
    assert all(r.h == plain(r.t) for r in got)


def test_components_match_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(7, 7), (5, 6), (5, 6)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in used}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_row_order_changes_nothing_and_each_asset_is_in_one_group(made):
    r = random.Random(1)
    rows = [asset(f"k{i:02d}", r.randrange(20_000), original_hash=f"h{r.randrange(20)}" if i % 5 == 0 else None, burst_identifier=f"b{r.randrange(6)}" if i % 4 == 0 else None,
                  fingerprint=vector(r.random() / 3), quality=BROKEN if i % 9 == 0 else OK, is_favorite=i % 7 == 0) for i in range(60)]
    first = made(*rows)
    r.shuffle(rows)
    assert {k: v.group_id for k, v in first.items()} == {k: v.group_id for k, v in made(*rows).items()}
    keys = [k for _, members in first for k in members]
    assert len(keys) == len(set(keys))
    favorites = {x["key"] for x in rows if x["is_favorite"]}
    assert not favorites & {k for g in first.values() for k in g.flagged}


def test_ledger_retention(spark):
    day = 86_400_000_000
    ledger = spark.createDataFrame([(NOW_US, ["k"] * 100), (NOW_US - 31 * day, ["k"] * 50)], "date_us long, asset_keys array<string>")
    assert reports.pending_deletions(ledger, NOW_US).first().pending == 100
    assert reports.total_deleted(ledger).first().total == 150
    assert reports.prune_deletions(ledger, NOW_US).count() == 1


def test_batches_can_be_undone(spark):
    before = spark.createDataFrame([("a", "pick"), ("b", "reject")], "key string, decision string")
    updates = spark.createDataFrame([("a", "unreviewed"), ("b", "pick"), ("c", "reject")], "key string, decision string")
    after, snapshot = decisions.apply_batch(before, updates)
    assert sorted(map(tuple, after.collect())) == [("b", "pick"), ("c", "reject")]
    assert sorted(map(tuple, decisions.restore(after, snapshot).collect())) == sorted(map(tuple, before.collect()))


def test_empty_library(spark):
    df = spark.createDataFrame([], asset_schema())
    members = groups.make_members(df, Engine())
    assert groups.make_groups(members, NOW_US).count() == 0 and groups.library_summary(df, members).count() == 0
