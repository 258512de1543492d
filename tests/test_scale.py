"""Ranks, neighbours and distances of libraries that hold a large share of all rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.config import US, NearConfig
from gleanery.functions.scalars import euclidean
from gleanery.operators import decisions, groups, pairs, reports, sessions
from gleanery.ordering import Ranges, has_neighbour
from gleanery.storage import Tables


@pytest.fixture
def many_ranges(spark):
    """As many ranges as partitions, so that small tables are cut too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def skewed_rows(seed=1, n=1500):
    """A third of the rows in one library, ties in time, missing times, a missing library."""
    r = random.Random(seed)
    library = lambda: r.choice(["big", "big", "big", "a", "b", "c", "d", "e", None])
    return [(library(), f"k{i:05d}", r.choice([None, *range(40)]), r.randint(0, 5)) for i in range(n)]


SCHEMA = "library_id string, key string, t long, __at int"


def test_ranks_equal_a_window_over_the_library(spark, many_ranges):
    df = spark.createDataFrame(skewed_rows(), SCHEMA)
    order = [F.col("t").desc_nulls_last(), F.asc("key")]
    ranges = Ranges(df, ["library_id"], order)
    got = ranges.rank("place", "total")
    w = Window.partitionBy("library_id")
    want = df.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("total", F.count("*").over(w))
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    sizes = [r["count"] for r in ranges.rows.groupBy(F.shiftright(ranges.at, 33)).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 500  # the big library has over 450 rows and is in several ranges
    assert Ranges(df.filter("false"), ["library_id"], order).rank("place").count() == 0


def windows(df):
    """Window operators of the plan with what they are partitioned by, and the plan's text below each."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [(m[1], plan[m.end() :]) for m in re.finditer(r"\+- Window \[[^\n]*?\], \[([^\]]*)\][^\n]*\n|^Window \[[^\n]*?\], \[([^\]]*)\][^\n]*\n", plan)]


def test_no_window_sees_the_rows_of_a_library(spark):
    rows = [(lib, k, None, r, "pending", "burst", 0.5, f"g{k}", 3) for lib, k, _, r in skewed_rows(n=40)]
    df = spark.createDataFrame(rows, "library_id string, key string, captured_at timestamp, size int, state string, kind string, certainty double, group_id string, use_us long")
    made = [reports.newest_first(df), reports.systematic_sample(df), groups.deck_order(df), groups.order_members(df)]
    for out in made:
        for _, below in windows(out):
            # The next operator down that is no window or projection aggregates: a row for each range.
            first = next(line for line in below.splitlines() if not re.search(r"(Project|Window)", line))
            assert "Aggregate" in first, first
    limited = reports.next_undecided(df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in limited


def test_neighbours_equal_lag_and_lead(spark, many_ranges):
    r = random.Random(5)
    rows = [(lib, k, None if t is None else r.choice([t * 10, t * 10, t * 10 + r.randint(-12, 12), -7 * t]), n) for lib, k, t, n in skewed_rows(n=400)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (0, 1, 3, 10, 25):
        w = Window.partitionBy("library_id").orderBy("t", "key")
        near = F.least(F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t")) <= limit
        want = df.filter("t is not null").withColumn("near", near).filter("near").drop("near")
        got = has_neighbour(df, ["library_id"], "t", limit)
        assert got.columns == df.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "Window" not in has_neighbour(df, ["library_id"], "t", 3)._jdf.queryExecution().optimizedPlan().toString()


def prints(seed, n=500):
    """Prints of three sessions, one with a crowded hour; equal times, other revisions and lengths, missing ones."""
    r, g = random.Random(seed), np.random.default_rng(seed)
    rows = []
    for i in range(n):
        session = r.choice([0, 0, 0, 1, 2])
        at = (r.choice([0, 1, 2]) * 3600 + r.choice([r.randint(0, 60), r.randint(0, 3600)])) * US + r.choice([0, 0, 1])
        vector = np.round(g.normal(size=4) * 0.3, 2).astype(np.float32).tolist()
        vector = r.choice([vector] * 12 + [vector[:3], [], None, [None, 1.0, 2.0, 3.0]])
        mark = r.choice([(2, "scaleFill")] * 8 + [(1, "scaleFill"), (2, "other"), (None, "scaleFill")])
        rows.append(("lib" if i % 7 else "other", session, f"k{r.randint(0, 10**6):07d}-{i}", at, None if i % 50 == 3 else (*mark, vector)))
    return rows


PRINTS = "library_id string, session_id long, key string, ts_us long, fingerprint struct<revision:int,crop:string,vector:array<float>>"


@pytest.mark.parametrize("tile", [2048, 20])
def test_blocks_give_the_edges_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    df = spark.createDataFrame(prints(3), PRINTS)
    near, window, keys = NearConfig(), 3600 * US, ["library_id", "session_id"]
    want = pairs.near_duplicate_edges(pairs.pairs_in_window(df, window, keys), df, near, euclidean)
    got = pairs.edges_in_blocks(df, keys, window, near)
    rows = lambda e: Counter((r.library_id, r.key_a, r.key_b, r.gap_us, r.distance, r.margin) for r in e.collect())
    assert rows(got) == rows(want) and got.count() > 50


def test_blocks_take_another_distance(spark, monkeypatch):
    monkeypatch.setattr(pairs, "_AT_ONCE", 50)
    df = spark.createDataFrame(prints(4), PRINTS)
    near, window, keys = NearConfig(steps=((3, 1.0), (3600, 0.6))), 3600 * US, ["library_id", "session_id"]
    column = lambda x, y: F.when(F.size(x) > 0, F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    want = pairs.near_duplicate_edges(pairs.pairs_in_window(df, window, keys), df, near, column)
    got = pairs.edges_in_blocks(df, keys, window, near, lambda x, y: abs(x - y).cumsum(axis=1)[:, -1])
    rows = lambda e: Counter((r.library_id, r.key_a, r.key_b, r.gap_us, r.distance, r.margin) for r in e.collect())
    assert rows(got) == rows(want) and got.count() > 50
    plan = entry.queries()["edges_with_metric"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan  # no join of pairs with their vectors


def test_flags_of_a_large_group_are_joined(spark):
    keys = [f"k{i}" for i in range(50)]
    g = spark.createDataFrame([("l", "g", "expiredUtility", None, keys, keys[::3]), ("l", "h", "burst", "m", ["m"], [])], "library_id string, group_id string, kind string, keeper string, member_keys array<string>, flagged array<string>")
    a = spark.createDataFrame([("l", k, "userLibrary", False, "image", False) for k in [*keys, "m"]], "library_id string, key string, source_type string, is_favorite boolean, media_type string, is_screen_recording boolean")
    rows = decisions.long_form(g, a, spark.createDataFrame([], "key string, decision string"))
    assert {(r.group_id, r.key, r.pos) for r in rows.collect() if r.is_flagged} == {("g", k, 3 * i) for i, k in enumerate(keys[::3])}
    assert rows.count() == 51 and "array_contains" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_next_undecided_has_the_place_in_the_whole_deck(spark):
    got = entry.queries()["next_undecided"](spark, "/root/testdata/sf0.001")
    places = {(r.library_id, r.group_id): r.position for r in entry.queries()["make_groups"](spark, "/root/testdata/sf0.001").collect()}
    rows = got.collect()
    assert got.columns == ["library_id", "group_id", "position"] and rows
    assert all(places[r.library_id, r.group_id] == r.position for r in rows)
    assert any(r.position > 5 for r in rows)  # decided groups have places too


@pytest.mark.parametrize("tile", [2048, 20])
def test_links_join_what_edges_join(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    rows = [(lib, s, f"{k}.{c}", at, f) for lib, s, k, at, f in prints(6, 200) for c in range(6)] + [("lib", None, f"n{i}", 5, (2, "c", [1.0])) for i in range(2)]
    rows += [("lib", 9, f"x{i}", 5, (2, "c", [float("nan") if i < 3 else float("inf")])) for i in range(6)]
    df = spark.createDataFrame(rows, PRINTS)
    keys = ["library_id", "session_id"]

    def joined(e):
        """Members and greatest margin of each component."""
        edges = [(r.library_id, r.key_a, r.key_b, r.margin) for r in e.collect()]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for lib, a, b, _ in edges:
            root[find((lib, a))] = find((lib, b))
        out = {}
        for lib, a, b, m in edges:
            members, top = out.get(find((lib, a)), (set(), 0.0))
            out[find((lib, a))] = (members | {a, b}, max(top, m))
        return sorted((sorted(members), top) for members, top in out.values()), len(edges)

    want, pairs_ = joined(pairs.edges_in_blocks(df, keys, 3600 * US))
    got, links = joined(pairs.links_in_blocks(df, keys, 3600 * US, NearConfig(), Tables(spark, "links")))
    assert got == want and len(got) > 20
    assert 2 * links < pairs_


def test_links_of_one_time_and_print(spark):
    """300 copies are 44,850 edges, and 299 links."""
    df = spark.createDataFrame([("l", 0, f"k{i:03d}", 7, (2, "c", [1.0, 2.0])) for i in range(300)], PRINTS)
    got = pairs.links_in_blocks(df, ["library_id", "session_id"], 3600 * US, NearConfig(), Tables(spark, "links")).collect()
    assert {(r.key_a, r.margin) for r in got} == {("k000", 1.0)} and len({r.key_b for r in got}) == len(got) == 299


def test_a_limit_is_met_exactly(spark):
    near = NearConfig(steps=((3, 0.5),))
    rows = [("l", 0, "a", 0, (2, "c", [0.0, 0.0])), ("l", 0, "b", 0, (2, "c", [0.3, 0.4])), ("l", 0, "c", 1, (2, "c", [0.0, 0.5])), ("l", 0, "d", 3 * US, (2, "c", [0.0, 0.0]))]
    df = spark.createDataFrame(rows, PRINTS)
    got = {(r.key_a, r.key_b): r.distance for r in pairs.edges_in_blocks(df, ["library_id", "session_id"], 3600 * US, near).collect()}
    want = pairs.near_duplicate_edges(pairs.pairs_in_window(df, 3600 * US, ["library_id", "session_id"]), df, near)
    assert got == {(r.key_a, r.key_b): r.distance for r in want.collect()} and got["a", "c"] == 0.5


def test_vectors_are_shuffled_once_a_bucket_not_once_a_pair(spark):
    rows = [("l", 0, f"k{i}", i * US, (2, "c", [float(i % 7)] * 8)) for i in range(600)]
    df = spark.createDataFrame(rows, PRINTS)
    plan = pairs.edges_in_blocks(df, ["library_id", "session_id"], 3600 * US)
    # 600 rows in one bucket and, as earlier halves, in the next: 1200 rows meet, for 179,700 pairs.
    assert pairs.pairs_in_window(df, 3600 * US, ["library_id", "session_id"]).count() == 179_700
    dealt = plan._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count("MapInArrow") == 1
    assert plan.count() == want_edges(rows)


def want_edges(rows):
    steps = NearConfig().steps
    n = 0
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            limit = next((x for g, x in steps if b[3] - a[3] < g * US), None)
            n += limit is not None and float(np.linalg.norm(np.subtract(a[4][2], b[4][2]))) <= limit
    return n


def test_bracket_candidates_at_equal_times(spark):
    from tests.test_groups import asset
    from gleanery.sources.assets import asset_schema

    rows = [asset("a", 0), asset("b", 0), asset("c", 100), asset("d", 115), asset("e", 131), asset("f", 500), asset("v", 501, media_type="video")]
    got = {r.key for r in sessions.bracket_candidates(spark.createDataFrame(rows, asset_schema())).collect()}
    assert got == {"a", "b", "c", "d"}


def dense(seed, n, kinds, width=6):
    """A block of an hour and the hour before: ``n`` rows with the prints of ``kinds``, and rows that nothing is near."""
    g = np.random.default_rng(seed)
    every = g.normal(size=(kinds, width)) * 0.2
    number = g.integers(0, kinds, n)
    vectors = every[number].astype(np.float32).astype(np.float64)
    vectors[::50] += 100 * (1 + np.arange(len(vectors[::50])))[:, None]
    number[::50] = -1 - np.arange(len(number[::50]))
    ts = g.integers(0, 7200, n) * US
    return number, ts, np.where(ts >= 3600 * US, pairs._BOTH, pairs._LEFT), vectors


@pytest.mark.parametrize(("kinds", "width", "steps"), [(80, 6, ((3, 0.45), (120, 0.35), (3600, 0.25))), (5000, 3, ((3, 0.2), (120, 0.1), (3600, 0.04))), (600, 5, ((3, 0.1), (120, 0.3), (3600, 0.05)))])
def test_links_of_a_crowded_block_join_what_edges_join(kinds, width, steps):
    number, ts, roles, vectors = dense(kinds, 1500, kinds, width)
    near, window = NearConfig(steps=steps), 3600 * US
    # As link_classes does: equal prints of an hour have one head, and are sure.
    classes = {}
    for i, x in enumerate(zip(number.tolist(), (ts // window).tolist(), strict=True)):
        classes.setdefault(x, []).append(i)
    head, sure = np.array([f"k{i:05d}" for i in range(len(ts))], object), np.zeros(len(ts), bool)
    for members in classes.values():
        head[members], sure[members] = head[members[0]], len(members) > 1
    row = np.arange(len(ts)).astype(str).astype(object)

    def joined(found, start):
        root, top = start.copy(), Counter()
        for a, b, *_ in found:
            pairs._unite(root, a, b)
        for i in np.flatnonzero(sure):
            top[root[i]] = 1.0
        for a, _, _, _, margin in found:
            for x, m in zip(root[a].tolist(), margin.tolist(), strict=True):
                top[x] = max(top[x], m)
        return root.tolist(), dict(top)

    _, at, of = np.unique(head, return_index=True, return_inverse=True)
    want = joined(list(pairs.tile_edges(row, ts, roles, vectors, window, near)), at[of])
    got = joined(list(pairs.tile_links(head, ts, roles | np.where(sure, pairs._SURE, 0), vectors, window, near)), at[of])
    assert got == want and 10 < len(set(got[0])) < 1450


def test_a_crowded_block_is_not_compared_in_pairs(monkeypatch):
    """Rows that are joined with each other need a strip of distances, not one to each of the others."""
    number, ts, roles, vectors = dense(1, 4000, 60)
    seen = []
    strips = pairs._strips
    monkeypatch.setattr(pairs, "_strips", lambda keys, *more: seen.append(len(keys)) or strips(keys, *more))
    head = np.array([f"k{x:05d}" for x in number], object)
    list(pairs.tile_links(head, ts, roles | pairs._SURE, vectors, 3600 * US, NearConfig()))
    assert sum(seen) == 0


def test_a_path_of_many_nodes_and_a_star_around_its_greatest(spark):
    from gleanery.operators.components import connected_components

    r = random.Random(8)
    names = list(range(60))
    r.shuffle(names)
    edges = [*zip(names, names[1:], strict=False), *((999, 100 + i) for i in range(50)), (2000, 2001)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys([*range(100, 150), 999], 100), 2000: 2000, 2001: 2000}


def sent(rows, window_us=3600 * US):
    """The rows of all blocks that have something to compare, as their workers see them."""

    def count(keys, *_):
        yield np.zeros(1, int), np.zeros(1, int), np.array([len(keys)]), np.zeros(1), np.zeros(1)

    return pairs._in_blocks(rows, ["library_id", "session_id"], window_us, NearConfig(), count)


def test_a_crowded_bucket_is_sent_once(spark):
    """5,000 rows of an hour are one tile: they were nine, and each row was in six of them."""
    rows = spark.range(5000).selectExpr("'l' as library_id", "0L as session_id", "concat('k', id) as key", "id * 700000 as ts_us", "2 as revision", "'c' as crop", "array(cast(id as float), 1.0f) as vector")
    assert sum(r.gap_us for r in sent(rows).collect()) == 5000
    assert pairs._strip(100) == pairs._STRIP and pairs._strip(2 * pairs.TILE) * 2 * pairs.TILE <= pairs._CELLS


def test_rows_of_blocks_are_shuffled_once(spark):
    """Only buckets that must be split have sizes to join, and they are few; so no join shuffles the vectors."""
    rows = [("l", 0, f"k{i}", i * 60 * US, 2, "c", [float(i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "library_id string, session_id long, key string, ts_us long, revision int, crop string, vector array<float>")
    plan = sent(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_vectors_are_written_once(spark, monkeypatch):
    """Classes are found by marks of the prints; before, the vectors were shuffled, sorted and written for them too."""
    from tests.test_groups import asset
    from gleanery.sources.assets import asset_schema

    seen, write = [], Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df, *more: seen.append(df.schema.simpleString()) or write(self, df, *more))
    rows = [asset(f"k{i}", 10 * i, fingerprint=(2, "scaleFill", [float(i % 2), 1.0])) for i in range(6)]
    members = groups.make_members(spark.createDataFrame(rows, asset_schema())).collect()
    assert len({r.seed for r in members if r.kind == "nearDuplicate"}) == 2 and len(members) == 6
    assert sum("vector" in s for s in seen) == 1


@pytest.mark.parametrize("number", ["float", "double"])
def test_marks_tell_prints_apart(spark, number):
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 2.0], [2.0, 1.0], [0.0, 1.0], [-0.0, 1.0], [1.0], [inf, 1.0], [1.0, -inf], [nan, 1.0], [None, 1.0], [1.0, None], [], None]
    rows = [(i, (2, "c", v)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"i int, fingerprint struct<revision:int,crop:string,vector:array<{number}>>")
    marks = [r.m for r in df.select("i", pairs.print_mark().alias("m")).orderBy("i").collect()]
    assert [m and m.finite for m in marks] == [True] * 5 + [False] * 5 + [None] * 2
    assert marks[2] == marks[3] and len({(m.hash, m.width) for m in marks[:5]}) == len({(m.more, m.width) for m in marks[:5]}) == 4


def manhattan(x, y):
    return abs(x - y).cumsum(axis=1)[:, -1]


def test_far_prints_get_no_distance(monkeypatch):
    """A metric sees vectors once, however many rows have them, and only those its bound leaves; it saw every pair of rows."""
    g = np.random.default_rng(2)
    n, every = 3000, g.normal(size=(300, 16)).astype(np.float32).astype(np.float64)
    ts, seen = g.integers(0, 7200, n) * US, []
    exact = lambda x, y: (seen.append(len(x)), manhattan(x, y))[1]
    near = NearConfig(steps=((3, 9.0), (3600, 7.0)))
    block = np.arange(n).astype(str).astype(object), ts, np.where(ts >= 3600 * US, pairs._BOTH, pairs._LEFT), every[g.integers(0, 300, n)]
    for metric in (exact, pairs.Bounded(exact, pairs.least_manhattan)):
        seen.clear()
        edges = sum(len(x[0]) for x in pairs.tile_edges(*block, 3600 * US, near, metric))
        assert edges > 5_000 and sum(seen) < n * n / (10 if metric is exact else 100)


@pytest.mark.parametrize("kinds", [1, 40, 5000])
def test_distinct_vectors_give_the_pairs_of_all_rows(monkeypatch, kinds):
    monkeypatch.setattr(pairs, "_AT_ONCE", 300)
    monkeypatch.setattr(pairs, "_strip", lambda others: 16)
    number, ts, roles, vectors = dense(kinds, 400, kinds)
    vectors[3], vectors[4], vectors[5, 0], vectors[6] = np.inf, -np.inf, np.nan, -0.0
    roles[::9], ts[::7] = pairs._RIGHT, ts[0]
    keys = np.array([f"k{i % 390:03d}" for i in range(400)], object)
    near, window = NearConfig(steps=((3, 0.9), (120, 0.3), (600, 0.7), (3600, 0.5))), 3600 * US
    rows = lambda: Counter((int(a), int(b), int(gap), float(d), float(m)) for x in pairs.tile_edges(keys, ts, roles, vectors, window, near, metric) for a, b, gap, d, m in zip(*x, strict=True))  # noqa: E731, B023
    for metric in (manhattan, pairs.Bounded(manhattan, pairs.least_manhattan)):
        got = rows()
        monkeypatch.setattr(pairs, "_FEW", 10**9)
        assert got == rows() and len(got) > 100
        monkeypatch.setattr(pairs, "_FEW", 0)


@pytest.mark.parametrize("width", [1, 64, 2000])
def test_a_bound_is_never_above_the_distance(width):
    g = np.random.default_rng(width)
    x, y = g.normal(size=(40, width)), g.normal(size=(50, width))
    x[1], x[2], y[3], y[4] = x[0], 0, 1000 * y[3], x[0] + 1e-7
    least, want = pairs.least_manhattan(x, y), np.abs(x[:, None] - y[None]).sum(axis=2)
    assert (least <= want).all()
    assert np.delete(want - least, 3, axis=1).max() < (0.02 if width < 2000 else 0.001) * width * 1.2
    x[5, 0], y[6, 0] = np.inf, np.nan
    least = pairs.least_manhattan(x, y)
    assert (least[5] == -np.inf).all() and (least[:, 6] == -np.inf).all() and np.isfinite(np.delete(least[:5], 6, axis=1)).all()
    assert (pairs.least_manhattan(np.zeros((2, width)), np.zeros((3, width))) <= 0).all()


def test_live_components_take_stars_not_all_edges(spark, tmp_path, monkeypatch):
    """300 copies of one time are 44,850 edges, and 299 links; the components are the same."""
    from gleanery.plans import registry

    for name in ("documents", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    n = spark.read.parquet(f"{tmp_path}/embeddings.parquet").count()
    spark.range(1, 301).selectExpr(f"id * {n} as event_id", "timestamp_micros(1704067200000000 + id) as ts", "0L as user_id", "'view' as event_type", "1.0d as value").write.parquet(f"{tmp_path}/events.parquet")
    added, real = [], registry.LiveComponents.add
    monkeypatch.setattr(registry.LiveComponents, "add", lambda self, edges, batch: added.append(edges.count()) or real(self, edges, batch))
    assert entry.queries()["near_duplicate_edges"](spark, str(tmp_path)).count() > 40_000
    got = {r.node: r.component for r in entry.queries()["live_components"](spark, str(tmp_path)).collect()}
    assert len(got) > 280 and set(got.values()) == {min(got)} and sum(added) == len(got) - 1


def test_pairs_of_few_rows_are_made_by_all_tasks(spark):
    """Rows of a few kilobytes were merged to one task, however many pairs they make."""
    rows = spark.range(400).selectExpr("'l' as library_id", "0L as session_id", "concat('k', id) as key", "id * 600000000 as ts_us")
    made = pairs.pairs_in_window(rows, 3600 * US, ["library_id", "session_id"])
    assert made.count() == 400 * 6 - 21
    assert made.select(F.spark_partition_id().alias("at")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
