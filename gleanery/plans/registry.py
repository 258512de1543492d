"""Queries over the given tables, one or more per operator, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import US
from gleanery.functions import predicates as P
from gleanery.functions import scalars as S
from gleanery.operators import cache, decisions, groups, pairs, ranking, reports, sessions
from gleanery.operators.components import LiveComponents
from gleanery.operators.live import LiveLibrary
from gleanery.plans import views
from gleanery.plans.group_sql import STAGES, fnv
from gleanery.plans.views import ENGINE, NOW_US, SQL, table
from gleanery.sources import assets as sources
from gleanery.sources.ledgers import Journal, Ledger
from gleanery.storage import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def column(name: str, make: Callable[[], Column], sql: str) -> None:
    """A query of one column function: key and value of every asset."""
    query(name, f"{SQL} SELECT key, {sql} AS value FROM soft")(lambda spark, d: views.assets(spark, d, False).select("key", make().alias("value")))


def joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "|") for n in names})


# Predicates and scalar functions.
column("is_deletable", P.is_deletable, "deletable")
column("is_proposable", P.is_proposable, "proposable")
column("is_expired_utility", P.is_expired_utility, "is_screenshot OR is_screen_recording")
column("is_contained_video", P.is_contained_video, "media_type = 'video' AND NOT is_screen_recording")
column("usable_date", lambda: F.floor(P.usable_us() / US), "us // 1000000")
column("quality_is_bad", P.quality_is_bad, "tier <> 'ok'")
column("quality_is_exposure_based", P.quality_is_exposure_based, "len(list_filter(reasons, lambda r: contains(r, 'blown out') OR contains(r, 'black') OR contains(r, 'clipped'))) > 0")
column("is_soft", P.is_soft, "is_soft")
column("strip_key_prefix", lambda: P.strip_key_prefix("key", "a:"), "substr(key, 3)")
column("classify_quality", lambda: F.concat_ws("|", "quality.tier", F.array_join("quality.reasons", "|")), "CASE WHEN len(reasons) > 0 THEN tier || '|' || array_to_string(reasons, '|') ELSE tier || '|' END")
column("exposure_score", lambda: F.round(S.exposure_score(), 6), "round(1 - least(1, hi + lo), 6)")
column("confidence", lambda: S.confidence(F.col("scored_from_stand_in")), "CASE WHEN stand_in THEN 'low' ELSE 'normal' END")
column("utc_year", lambda: S.utc_year(P.usable_us()), "year(make_timestamp(us))")
column("time_gap", lambda: S.time_gap_us(P.usable_us(), F.unix_micros("modification_date")), "abs(us - modified_us)")
column("fnv1a64_hex", lambda: S.fnv1a64_hex(F.col("key")), fnv("key"))
column("stand_in_flag", lambda: S.stand_in_flag(F.col("event_id") % 200, F.col("event_id") % 150, F.col("scored_from_stand_in")), "stand_in OR greatest(i % 200, i % 150) < 128")
column("content_hash", lambda: S.content_hash(F.col("event_id") % 7, F.col("event_id") % 5, F.encode("key", "UTF-8"), F.col("scored_from_stand_in")),
       "CASE WHEN NOT stand_in THEN sha256(unhex(lpad(to_hex(i % 7), 2, '0') || '00000000000000' || lpad(to_hex(i % 5), 2, '0') || '00000000000000') || key::BLOB) END")



@query("is_reviewed", f"SELECT * FROM (SELECT user_id::VARCHAR AS key, max_by(CASE event_type WHEN 'purchase' THEN true WHEN 'view' THEN true WHEN 'click' THEN true WHEN 'signup' THEN false END, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id)")
def is_reviewed(spark, d):
    return decisions.fold_journal(views.journal(spark, d).filter("value is not null")).select("key", P.is_reviewed().alias("value"))


@query("kind_traits", f"{SQL}{STAGES} SELECT kind, count(*) AS n, bool_and(kind = 'bracket') AS keeps_all, bool_and(kind IN ('burst', 'nearDuplicate')) AS keep_one, bool_and(kind IN ('burst', 'nearDuplicate', 'versions')) AS best_shot, CASE kind WHEN 'failedFrame' THEN 'Failed frames' WHEN 'exactDuplicate' THEN 'Exact copies' WHEN 'burst' THEN 'Burst' WHEN 'expiredUtility' THEN 'Old screen captures' WHEN 'nearDuplicate' THEN 'Near duplicates' WHEN 'bracket' THEN 'Exposure bracket' WHEN 'versions' THEN 'Original and edit' END AS title FROM groups GROUP BY kind")
def kind_traits(spark, d):
    traits = F.broadcast(P.kind_traits(spark))  # nine fixed rows
    return all_groups(spark, d).join(traits, "kind").groupBy("kind", "title").agg(F.count("*").alias("n"), F.bool_and("keeps_all").alias("keeps_all"), F.bool_and("proposes_keep_one").alias("keep_one"), F.bool_and("has_best_shot").alias("best_shot"))


def near_vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id")


@query("euclidean", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def euclidean(spark, d):
    return near_vectors(spark, d).select("vec_id", F.round(S.euclidean(F.col("embedding"), F.col("other")), 6).alias("value"))


_PLANE = "list_transform(embedding, lambda x: (x::DOUBLE + 1) * 127.5)"
_INNER = "list_transform(list_filter(range(1, 65), lambda i: (i - 1) % 8 BETWEEN 1 AND 6 AND (i - 1) // 8 BETWEEN 1 AND 6), lambda i: 4 * p[i] - p[i - 1] - p[i + 1] - p[i - 8] - p[i + 8])"


def planes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5).alias("p"))


@query("laplacian_variance", f"WITH q AS (SELECT vec_id, {_PLANE} AS p FROM embeddings) SELECT vec_id, round(list_var_pop({_INNER}), 4) AS value FROM q")
def laplacian_variance(spark, d):
    return planes(spark, d).select("vec_id", F.round(S.laplacian_variance("p", F.lit(8), F.lit(8)), 4).alias("value"))


@query("clip_fraction", f"WITH q AS (SELECT vec_id, {_PLANE} AS p FROM embeddings) SELECT vec_id, round(len(list_filter(p, lambda x: x >= 150)) / 64.0::DOUBLE, 6) AS high, round(len(list_filter(p, lambda x: x <= 110)) / 64.0::DOUBLE, 6) AS low FROM q")
def clip_fraction(spark, d):
    return planes(spark, d).select("vec_id", F.round(S.clip_fraction(F.col("p"), high=150), 6).alias("high"), F.round(S.clip_fraction(F.col("p"), low=110), 6).alias("low"))


@query("uniformity", f"WITH q AS (SELECT vec_id, {_PLANE} AS p FROM embeddings) SELECT vec_id, round(1 - least(list_stddev_pop(p) / 255, 1), 6) AS value FROM q")
def uniformity(spark, d):
    return planes(spark, d).select("vec_id", F.round(S.uniformity(F.col("p")), 6).alias("value"))


@query("measure", f"WITH q AS (SELECT vec_id, {_PLANE} AS p FROM embeddings) SELECT vec_id, round(list_var_pop({_INNER}), 4) AS global_sharpness, round(1 - least(list_stddev_pop(p) / 255, 1), 6) AS frame_uniformity FROM q")
def measure(spark, d):
    rect = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    m = planes(spark, d).select("vec_id", S.measure(F.lit(8), F.lit(8), F.col("p"), rect).alias("m"))
    return m.select("vec_id", F.round("m.global_sharpness", 4).alias("global_sharpness"), F.round("m.frame_uniformity", 6).alias("frame_uniformity"))


#: The middle quarter of an 8 x 8 plane; inset, it is 4 x 4 pixels, whose inner ones are 2 x 2.
_MIDDLE = _INNER.replace("BETWEEN 1 AND 6", "BETWEEN 3 AND 4")


@query("measure_subject", f"WITH q AS (SELECT vec_id, {_PLANE} AS p FROM embeddings) SELECT vec_id, round(list_var_pop({_MIDDLE}), 4) AS subject_sharpness, round(len(list_filter(p, lambda x: x >= 252.5)) / 64.0::DOUBLE, 6) AS clipped_highlights, round(len(list_filter(p, lambda x: x <= 2.5)) / 64.0::DOUBLE, 6) AS clipped_shadows, vec_id % 2 = 0 AS subject_is_face FROM q")
def measure_subject(spark, d):
    rect = F.struct(F.lit(0.25).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"), (F.col("vec_id") % 2 == 0).alias("is_face"))
    m = planes(spark, d).select("vec_id", S.measure(F.lit(8), F.lit(8), F.col("p"), rect).alias("m"))
    return m.select("vec_id", F.round("m.subject_sharpness", 4).alias("subject_sharpness"), F.round("m.clipped_highlights", 6).alias("clipped_highlights"), F.round("m.clipped_shadows", 6).alias("clipped_shadows"), "m.subject_is_face")


@query("session_text", f"SELECT user_id, 'Earlier session: ' || n || CASE WHEN n = 1 THEN ' photo' ELSE ' photos' END || ' decided, ' || CASE WHEN age < 60 THEN age || ' min' WHEN age < 1440 THEN age // 60 || ' h' ELSE age // 1440 || ' d' END || ' ago' AS value FROM (SELECT user_id, count(*) AS n, ({NOW_US} - max(epoch_us(ts::TIMESTAMP))) // 60000000 AS age FROM events GROUP BY user_id)")
def session_text(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"))
    return e.select("user_id", S.session_text(F.col("n"), F.col("last"), F.lit(NOW_US)).alias("value"))


@query("commit_text", f"{SQL} SELECT library_id, count(*) || CASE WHEN count(*) = 1 THEN ' item ' ELSE ' items ' END || coalesce(sum(byte_size), 0) || ' bytes: ' || CASE WHEN bool_or(stand_in) THEN 'frees cloud space' ELSE 'frees device space' END AS value FROM assets GROUP BY library_id")
def commit_text(spark, d):
    a = views.assets(spark, d, False).groupBy("library_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("s"), F.bool_or("scored_from_stand_in").alias("e"))
    return a.select("library_id", S.commit_text(F.col("n"), F.col("s"), F.when(F.col("e"), F.lit("optimising")).otherwise(F.lit("fullCopies"))).alias("value"))


# Sources.
@query("read_assets", f"{SQL} SELECT library_id, count(*) AS n, count(us) AS dated, sum(raw_us // 1000000)::BIGINT AS total FROM assets GROUP BY library_id")
def read_assets(spark, d):
    """The assets written in the library's schema, and read again."""
    kept = Tables(spark, "assets").write(views.as_assets(views.assets(spark, d, False), sources.asset_schema()))
    a = sources.read_assets(spark, kept._gleanery_path)
    us = F.unix_micros("captured_at")
    return a.groupBy("library_id").agg(F.count("*").alias("n"), F.count(P.usable_us()).alias("dated"), F.sum((us / US).cast("long")).alias("total"))


@query("write_groups", f"{SQL}{STAGES} SELECT library_id, kind, count(*) AS n, sum(len(ks))::BIGINT AS members FROM groups GROUP BY library_id, kind")
def write_groups(spark, d):
    """The groups written by library, twice, and read again: a run overwrites what was there."""
    g, path = all_groups(spark, d), f"{Tables(spark, 'written').root}/groups"
    for _ in range(2):
        sources.write_result(g, path)
    return spark.read.parquet(path).groupBy("library_id", "kind").agg(F.count("*").alias("n"), F.sum(F.size("member_keys")).alias("members"))


# A plane's pixels as SQL: the same values as views.renditions, p from its place and l the Laplacian inside [x0, x1) x [y0, y1).
_PIXELS = "list_transform(embedding, lambda v: floor(greatest(0, least(255, CASE WHEN vec_id % 11 = 0 THEN 255 WHEN vec_id % 11 = 1 THEN 0 WHEN vec_id % 11 = 2 THEN 128 + v::DOUBLE ELSE (v::DOUBLE + 1) * 127.5 END)))::DOUBLE)"
_RENDITIONS = f"""WITH r AS (SELECT vec_id, {_PIXELS} AS p, CASE WHEN vec_id % 3 = 0 THEN 16 ELSE 8 END AS w, CASE WHEN vec_id % 3 = 0 THEN 4 ELSE 8 END AS h, vec_id % 2 = 0 AS face, vec_id % 13 <> 5 AS whole FROM embeddings),
    s AS (SELECT *, CASE WHEN face AND w = 8 THEN 2 WHEN w = 8 OR face THEN 0 ELSE 1 END AS x0, CASE WHEN face AND w = 8 THEN 6 WHEN w = 8 THEN 8 WHEN face THEN 16 ELSE 15 END AS x1, CASE WHEN face AND w = 8 THEN 2 ELSE 0 END AS y0, CASE WHEN face AND w = 8 THEN 6 ELSE h END AS y1 FROM r),
    v AS (SELECT *, list_transform(list_filter(range(0, 64), lambda i: i % w > 0 AND i % w < w - 1 AND i // w > 0 AND i // w < h - 1), lambda i: 4 * p[i + 1] - p[i] - p[i + 2] - p[i + 1 - w] - p[i + 1 + w]) AS l,
        list_transform(list_filter(range(0, 64), lambda i: i % w > x0 AND i % w < x1 - 1 AND i // w > y0 AND i // w < y1 - 1), lambda i: 4 * p[i + 1] - p[i] - p[i + 2] - p[i + 1 - w] - p[i + 1 + w]) AS ls FROM s),
    m AS (SELECT vec_id, whole, face, list_var_pop(ls) AS subject, list_var_pop(l) AS global_, len(list_filter(p, lambda x: x >= 252.5)) / 64.0::DOUBLE AS hi, len(list_filter(p, lambda x: x <= 2.5)) / 64.0::DOUBLE AS lo, 1 - least(1, list_stddev_pop(p) / 255) AS uni FROM v)"""


@query("measure_renditions", f"{_RENDITIONS} SELECT vec_id::VARCHAR AS key, CASE WHEN whole THEN round(subject, 4) END AS subject_sharpness, CASE WHEN whole THEN round(global_, 4) END AS global_sharpness, CASE WHEN whole THEN round(hi, 6) END AS clipped_highlights, CASE WHEN whole THEN round(lo, 6) END AS clipped_shadows, CASE WHEN whole THEN round(uni, 6) END AS frame_uniformity, true AS stand_in, CASE WHEN NOT whole THEN NULL WHEN uni >= 0.995 OR hi >= 0.97 OR lo >= 0.97 THEN 'obviouslyBroken' WHEN subject < 12 OR (hi >= 0.15 AND lo >= 0.15) THEN 'probablyBad' ELSE 'ok' END AS tier FROM m")
def measure_renditions(spark, d):
    """From a table of renditions to tiers; all are stand-ins here, as planes of 64 pixels are small."""
    kept = Tables(spark, "renditions").write(views.renditions(spark, d))
    m = sources.measure_renditions(sources.read_renditions(spark, kept._gleanery_path))
    m = m.withColumn("tier", F.when(F.col("metrics").isNotNull(), S.classify_quality("metrics", ENGINE.quality)["tier"]))
    shown_ = [F.round(f"metrics.{c}", n).alias(c) for c, n in (("subject_sharpness", 4), ("global_sharpness", 4), ("clipped_highlights", 6), ("clipped_shadows", 6), ("frame_uniformity", 6))]
    return m.select("key", *shown_, F.col("scored_from_stand_in").alias("stand_in"), "tier")


@query("subject_rect", """WITH f AS (SELECT l_orderkey AS key, l_discount::DOUBLE * 5 AS x, l_tax::DOUBLE * 5 AS y, l_quantity::DOUBLE / 100 AS w, l_linenumber::DOUBLE / 10 AS h, l_linenumber AS n FROM lineitem WHERE l_linenumber > 1),
    b AS (SELECT key, first(x ORDER BY w * h DESC, n, x, y, w, h) AS x, first(y ORDER BY w * h DESC, n, x, y, w, h) AS y, first(w ORDER BY w * h DESC, n, x, y, w, h) AS w, first(h ORDER BY w * h DESC, n, x, y, w, h) AS h FROM f GROUP BY key),
    g AS (SELECT key, greatest(0, least(1, x - w * 0.05)) AS x0, greatest(0, least(1, y - h * 0.05)) AS y0, greatest(0, least(1, x + w * 1.05)) AS x1, greatest(0, least(1, y + h * 1.05)) AS y1 FROM b)
    SELECT o_orderkey AS key, round(CASE WHEN x0 IS NOT NULL THEN x0 WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS x, round(CASE WHEN x0 IS NOT NULL THEN 1 - y0 - (y1 - y0) WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS y,
        round(CASE WHEN x0 IS NOT NULL THEN x1 - x0 WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 1 END, 6)::DOUBLE AS w, round(CASE WHEN x0 IS NOT NULL THEN y1 - y0 WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 1 END, 6)::DOUBLE AS h
    FROM orders LEFT JOIN g ON g.key = o_orderkey""")
def subject_rect(spark, d):
    """An order's further lines as faces; a fixed salient area for every second order."""
    n = lambda c, k: (F.col(c).cast("double") * k)
    face = F.struct("l_linenumber", n("l_discount", 5).alias("x"), n("l_tax", 5).alias("y"), (F.col("l_quantity").cast("double") / 100).alias("w"), (F.col("l_linenumber").cast("double") / 10).alias("h"))
    found = table(spark, d, "lineitem").filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(face)), lambda f: F.struct(*(f[c].alias(c) for c in "xywh"))).alias("faces"))
    salient = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit(0.25).alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h")))
    rows = table(spark, d, "orders").join(found, "o_orderkey", "left")
    r = rows.select(F.col("o_orderkey").alias("key"), S.subject_rect(F.coalesce("faces", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")), salient).alias("r"))
    return r.select("key", *(F.round(f"r.{c}", 6).alias(c) for c in "xywh"))


@query("map_asset_codes", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' ELSE 'unknown' END AS media_type, CASE event_id % 6 WHEN 1 THEN 'userLibrary' WHEN 2 THEN 'cloudShared' WHEN 4 THEN 'iTunesSynced' ELSE 'other' END AS source_type, (user_id & 4) <> 0 AS is_screenshot, (user_id & 8) <> 0 AS is_live_photo FROM events")
def map_asset_codes(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", (i % 5).alias("media_code"), (i % 6).alias("source_code"), F.col("user_id").cast("long").alias("subtype_bits"))
    return sources.map_asset_codes(e).select("event_id", "media_type", "source_type", "is_screenshot", "is_live_photo")


def order_resources(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("long")
    return li.select(F.col("l_orderkey").alias("key"), n.alias("type_code"), (n == 1).alias("is_primary"), (F.col("l_partkey") % 50 != 0).alias("readable"), F.encode(F.col("l_partkey").cast("string"), "UTF-8").alias("bytes"))


@query("original_hash", "SELECT l_orderkey AS key, CASE WHEN bool_or(l_linenumber = 1) AND bool_and(l_partkey % 50 <> 0) THEN sha256(string_agg(l_linenumber::VARCHAR || l_partkey::VARCHAR, '' ORDER BY l_linenumber, l_partkey::VARCHAR)) END AS original_hash FROM lineitem GROUP BY l_orderkey")
def original_hash(spark, d):
    return sources.original_hash(order_resources(spark, d))


@query("resource_sizes", "SELECT o_orderkey AS key, coalesce(sum(l_partkey) FILTER (l_returnflag IN ('A', 'R')), 0)::BIGINT AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def resource_sizes(spark, d):
    kind = F.when(F.col("l_returnflag").isin("A", "R"), F.lit("video")).otherwise(F.lit("photo"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), kind.alias("type"), F.col("l_partkey").alias("bytes"))
    return reports.resource_sizes(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), r)


# Sessions, brackets, pairs, edges, components.
_ALL_SESSIONS = ", s0 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY library_id ORDER BY us, key) > 14400000000 THEN 1 ELSE 0 END AS st FROM assets WHERE us IS NOT NULL), s1 AS (SELECT *, sum(st) OVER (PARTITION BY library_id ORDER BY us, key)::BIGINT AS sid FROM s0)"


@query("sessionize", f"{SQL}{_ALL_SESSIONS} SELECT library_id, key, sid AS session_id FROM s1")
def sessionize(spark, d):
    return sessions.sessionize(views.assets(spark, d, False)).select("library_id", "key", "session_id")


@query("candidate_pairs", f"{SQL}{_ALL_SESSIONS} SELECT a.library_id, a.key AS key_a, b.key AS key_b, b.us - a.us AS gap_us FROM s1 a JOIN s1 b ON a.library_id = b.library_id AND a.sid = b.sid AND b.us - a.us BETWEEN 0 AND 3600000000 AND (b.us > a.us OR a.key < b.key)")
def candidate_pairs(spark, d):
    return pairs.candidate_pairs(views.assets(spark, d, False)).select("library_id", "key_a", "key_b", "gap_us")


@query("pair_groupable", f"{SQL}{_ALL_SESSIONS} SELECT a.key AS key_a, b.key AS key_b, CASE WHEN b.us - a.us < 3000000 THEN 0.45 WHEN b.us - a.us < 120000000 THEN 0.35 WHEN b.us - a.us < 3600000000 THEN 0.25 END::DOUBLE AS limit_, b.us - a.us < 3600000000 AS groupable FROM s1 a JOIN s1 b ON a.library_id = b.library_id AND a.sid = b.sid AND b.us - a.us BETWEEN 0 AND 3600000000 AND (b.us > a.us OR a.key < b.key)")
def pair_groupable(spark, d):
    p = pairs.candidate_pairs(views.assets(spark, d, False))
    return p.select("key_a", "key_b", S.threshold_for_gap(F.col("gap_us")).alias("limit_"), S.pair_groupable(F.col("gap_us")).alias("groupable"))


@query("candidate_assets", f"{SQL}{_ALL_SESSIONS} SELECT library_id, key FROM (SELECT *, least(us - lag(us) OVER w, lead(us) OVER w - us) AS near FROM s1 WINDOW w AS (PARTITION BY library_id, sid ORDER BY us, key)) WHERE near <= 3600000000 AND media_type = 'image' AND NOT is_screenshot AND NOT is_screen_recording AND burst_identifier IS NULL")
def candidate_assets(spark, d):
    return pairs.candidate_assets(views.assets(spark, d, False)).select("library_id", "key")


@query("bracket_candidates", f"{SQL} SELECT library_id, key FROM (SELECT *, least(us - lag(us) OVER w, lead(us) OVER w - us) AS near FROM assets WHERE media_type = 'image' AND NOT is_screenshot AND NOT is_screen_recording AND us IS NOT NULL WINDOW w AS (PARTITION BY library_id ORDER BY us, key)) WHERE near <= 1800000000")
def bracket_candidates(spark, d):
    return sessions.bracket_candidates(views.assets(spark, d, False), ENGINE.group).select("library_id", "key")


@query("near_duplicate_edges", f"{SQL}{_ALL_SESSIONS}, p AS (SELECT a.key AS key_a, b.key AS key_b, CASE WHEN b.us - a.us < 3000000 THEN 1.35 WHEN b.us - a.us < 120000000 THEN 1.30 WHEN b.us - a.us < 3600000000 THEN 1.20 END::DOUBLE AS lim, list_distance(a.vector, b.vector) AS dist FROM s1 a JOIN s1 b ON a.library_id = b.library_id AND a.sid = b.sid AND b.us - a.us BETWEEN 0 AND 3600000000 AND (b.us > a.us OR a.key < b.key)) SELECT key_a, key_b, round(dist, 6) AS distance, round((lim - dist) / lim, 6) AS margin FROM p WHERE dist <= lim")
def near_duplicate_edges(spark, d):
    rows = sessions.sessionize(views.assets(spark, d))
    e = pairs.edges_in_blocks(rows, ["library_id", "session_id"], int(ENGINE.group.pair_window * US), ENGINE.near)
    return e.select("key_a", "key_b", F.round("distance", 6).alias("distance"), F.round("margin", 6).alias("margin"))


@query("edges_with_metric", ORACLE["near_duplicate_edges"].replace("list_distance(a.vector, b.vector)", "list_sum(list_transform(list_zip(a.vector, b.vector), lambda x: abs(x[1] - x[2]))) / 6"))
def edges_with_metric(spark, d):
    """Another distance: a sixth of the sum of differences."""
    rows = sessions.sessionize(views.assets(spark, d))
    # Added up in order, as SQL does.
    sixth = pairs.Bounded(lambda x, y: abs(x - y).cumsum(axis=1)[:, -1] / 6, lambda x, y: pairs.least_manhattan(x, y) / 6)
    e = pairs.edges_in_blocks(rows, ["library_id", "session_id"], int(ENGINE.group.pair_window * US), ENGINE.near, sixth)
    return e.select("key_a", "key_b", F.round("distance", 6).alias("distance"), F.round("margin", 6).alias("margin"))


@query("connected_components", f"{SQL}{STAGES} SELECT key AS node, c AS component FROM comp")
def components(spark, d):
    m = make_members(spark, d)
    return m.filter(F.col("kind").isin("nearDuplicate", "versions")).select(F.col("key").alias("node"), F.substring_index("seed", "/", -1).alias("component"))


# Groups.
def make_members(spark, d) -> DataFrame:
    """Written once, since groups, their members and ranks all read it; none of them reads a print."""
    return Tables(spark, "members").write(groups.make_members(views.assets(spark, d), ENGINE).drop("fingerprint"))


def all_groups(spark, d) -> DataFrame:
    """Written once, since states, orders and decisions join the groups with what is derived from them."""
    return Tables(spark, "groups").write(groups.make_groups(make_members(spark, d), NOW_US, ENGINE))


_OUT = ["library_id", "group_id", "kind", "members", "representative", "span_start", "span_end", "certainty", "flagged", "keeper", "headline"]


def shown(g: DataFrame, *more: str) -> DataFrame:
    g = joined(g.withColumn("members", F.col("member_keys")), "members", "flagged")
    seconds = {c: F.floor(F.col(c) / US) for c in ("span_start", "span_end")}
    return g.withColumns(seconds).withColumn("certainty", F.round("certainty", 6)).select(*_OUT, *more)


@query("make_groups", f"{SQL}{STAGES} SELECT {', '.join(_OUT)}, position FROM groups")
def make_groups(spark, d):
    return shown(groups.deck_order(all_groups(spark, d)), "position")


def kind_query(name: str, *kinds: str) -> None:
    names = ", ".join(f"'{k}'" for k in kinds)
    query(name, f"{SQL}{STAGES} SELECT {', '.join(_OUT)} FROM groups WHERE kind IN ({names})")(lambda spark, d: shown(groups.make_groups(make_members(spark, d).filter(F.col("kind").isin(*kinds)), NOW_US, ENGINE)))


def early(spark, d) -> DataFrame:
    rows = views.assets(spark, d, False).withColumn("use_us", P.usable_us()).withColumn("raw_us", F.unix_micros("captured_at")).withColumn("margin", F.lit(None).cast("double"))
    return groups.stage_duplicates(rows)


def stage_query(name: str, kind: str, stage: Callable[[DataFrame], DataFrame]) -> None:
    """Early kinds need no sessions or vectors."""
    query(name, f"{SQL}{STAGES} SELECT {', '.join(_OUT)} FROM groups WHERE kind = '{kind}'")(lambda spark, d: shown(groups.make_groups(stage(early(spark, d)).filter(F.col("kind") == kind), NOW_US, ENGINE)))


stage_query("exact_duplicate_groups", "exactDuplicate", lambda r: r)
stage_query("expired_utility_groups", "expiredUtility", groups.stage_utility)
stage_query("burst_groups", "burst", lambda r: groups.stage_bursts(groups.stage_utility(r), ENGINE))
kind_query("bracket_groups", "bracket")
kind_query("near_duplicate_groups", "nearDuplicate")
kind_query("version_groups", "versions")
kind_query("failed_frame_groups", "failedFrame")


@query("library_summary", f"{SQL}{STAGES} SELECT a.*, coalesce(g.exact_duplicate_count, 0)::BIGINT AS exact_duplicate_count, coalesce(g.group_count, 0) AS group_count FROM (SELECT library_id, count(*) AS total_assets, count(*) FILTER (media_type = 'video' AND NOT is_screen_recording) AS video_count, count(*) FILTER (is_screen_recording) AS screen_recording_count, count(*) FILTER (is_screenshot) AS screenshot_count, count(*) FILTER (tier = 'obviouslyBroken') AS failed_frame_count FROM assets GROUP BY library_id) a LEFT JOIN (SELECT library_id, sum(CASE WHEN kind = 'exactDuplicate' THEN len(ks) ELSE 0 END) AS exact_duplicate_count, count(*) AS group_count FROM groups GROUP BY library_id) g USING (library_id)")
def library_summary(spark, d):
    return groups.library_summary(views.assets(spark, d, False), make_members(spark, d))


_SETTLED = ", stl AS (SELECT 'a:' || lpad(event_id::VARCHAR, 9, '0') AS key, CASE WHEN event_id % 11 < 5 THEN 'resolved' WHEN event_id % 11 < 8 THEN 'dismissed' END AS state FROM events WHERE event_id % 11 < 8)"
_CARRIED = ", car AS (SELECT group_id, CASE WHEN bool_and(coalesce(state, '') = 'dismissed') THEN 'dismissed' WHEN bool_and(state IS NOT NULL) THEN 'resolved' END AS carried FROM (SELECT group_id, unnest(ks) AS key FROM groups) LEFT JOIN stl USING (key) GROUP BY group_id)"


@query("carried_state", f"{SQL}{STAGES}{_SETTLED}{_CARRIED} SELECT * FROM car")
def carried_state(spark, d):
    return groups.carried_state(all_groups(spark, d), views.settled(spark, d))


def some_states(g: DataFrame) -> DataFrame:
    """States of the groups whose id starts with a digit under 4."""
    return g.filter(F.substring("group_id", 1, 1) < "4").select("group_id", F.when(F.substring("group_id", 1, 1) < "2", F.lit("dismissed")).otherwise(F.lit("resolved")).alias("state"))


_STATE = "CASE WHEN left(group_id, 1) < '2' THEN 'dismissed' WHEN left(group_id, 1) < '4' THEN 'resolved'"


@query("apply_group_state", f"{SQL}{STAGES}{_SETTLED}{_CARRIED} SELECT group_id, {_STATE} ELSE coalesce(carried, 'pending') END AS state FROM groups JOIN car USING (group_id)")
def apply_group_state(spark, d):
    g = all_groups(spark, d)
    return groups.apply_group_state(g, some_states(g), views.settled(spark, d)).select("group_id", "state")


@query("next_undecided", f"{SQL}{STAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY position) AS r FROM groups WHERE left(group_id, 1) >= '4') SELECT library_id, group_id, position FROM o WHERE r <= 5")
def next_undecided(spark, d):
    """With their places in the whole deck, decided groups included."""
    g = all_groups(spark, d)
    states = some_states(g).withColumnRenamed("state", "s")
    g = groups.deck_order(g).join(states, "group_id", "left").withColumn("state", F.coalesce("s", "state"))
    return reports.next_undecided(g, 5).select("library_id", "group_id", "position")


# Ranking.
_MEMBERS = ", rm AS (SELECT g.group_id, g.kind, a.*, list_position(g.ks, a.key) - 1 AS pos, len(g.ks) AS n FROM (SELECT *, unnest(ks) AS key FROM groups WHERE kind IN ('burst', 'versions', 'bracket', 'nearDuplicate', 'exactDuplicate')) g JOIN soft a USING (library_id, key))"
_Z = lambda c: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 1 END"
_SCORES = f"""{_MEMBERS}, sc AS (SELECT group_id, kind, key, pos, CASE WHEN n = 1 THEN 1 WHEN kind = 'versions' THEN is_edited::INT WHEN kind = 'bracket' THEN 1
    WHEN bool_or(user_pick OR auto_pick) OVER w THEN CASE WHEN bool_or(user_pick) OVER w THEN user_pick ELSE auto_pick END::INT
    WHEN count(faceq) OVER w = n THEN {_Z('faceq')} WHEN count(looks) OVER w = n THEN {_Z('looks')}
    ELSE 0.7 * ({_Z('sharp')}) + 0.3 * ({_Z('(1 - least(1, hi + lo))')}) END::DOUBLE AS total,
    CASE WHEN n = 1 THEN '' WHEN kind = 'versions' THEN CASE WHEN is_edited THEN 'Edited version' ELSE 'Unedited original' END WHEN kind = 'bracket' THEN 'Keep all'
    WHEN bool_or(user_pick OR auto_pick) OVER w THEN CASE WHEN bool_or(user_pick) OVER w THEN CASE WHEN user_pick THEN 'Picked by you at capture' ELSE '' END ELSE CASE WHEN auto_pick THEN 'Picked at capture' ELSE '' END END
    WHEN count(faceq) OVER w = n THEN CASE WHEN faceq = max(faceq) OVER w THEN 'Best face' ELSE '' END WHEN count(looks) OVER w = n THEN CASE WHEN looks = max(looks) OVER w THEN 'Strongest composition' ELSE '' END
    ELSE array_to_string(list_filter([CASE WHEN sharp >= 0 AND sharp = max(sharp) OVER w THEN 'Sharpest subject' WHEN 1 - least(1, hi + lo) = max(1 - least(1, hi + lo)) OVER w THEN 'Best exposed' END, CASE WHEN tier <> 'ok' THEN coalesce(reasons[1], 'Unusable') END], lambda x: x IS NOT NULL), '|') END AS reasons
    FROM rm WINDOW w AS (PARTITION BY group_id))"""


def ranked_members(spark, d) -> tuple[DataFrame, DataFrame]:
    m = make_members(spark, d)
    g = Tables(spark, "ranked").write(groups.make_groups(m, NOW_US, ENGINE).filter(F.col("kind").isin("burst", "versions", "bracket", "nearDuplicate", "exactDuplicate")))
    long = g.select("library_id", "group_id", F.posexplode("member_keys").alias("pos", "key"))
    return g, m.join(long, ["library_id", "key"])


def ranked(spark, d, ranker: ranking.Ranker = ranking.rank_members) -> tuple[DataFrame, DataFrame]:
    g, members = ranked_members(spark, d)
    return g, ranker(members)


@query("rank_members", f"{SQL}{STAGES}{_SCORES} SELECT group_id, key, round(total, 6) AS total, reasons FROM sc")
def rank_members(spark, d):
    return joined(ranked(spark, d)[1], "reasons").select("group_id", "key", F.round("total", 6).alias("total"), "reasons")


def by_sharpness(members: DataFrame) -> DataFrame:
    """Another ranker: the sharpest subject wins, whatever the kind."""
    sharp = F.coalesce("quality.metrics.subject_sharpness", F.lit(-1.0))
    return members.select("group_id", "kind", "key", "pos", sharp.alias("total"), F.array().cast("array<string>").alias("reasons"), F.lit("normal").alias("confidence"))


@query("suggest_with_ranker", f"{SQL}{STAGES}{_MEMBERS} SELECT group_id, first(key ORDER BY coalesce(sharp, -1) DESC, pos) AS key FROM rm WHERE n > 1 GROUP BY group_id")
def suggest_with_ranker(spark, d):
    return ranking.suggest(ranked_members(spark, d)[1], by_sharpness)


@query("top_candidates", f"{SQL}{STAGES}{_SCORES} SELECT group_id, key FROM (SELECT *, max(total) OVER (PARTITION BY group_id) AS best FROM sc) WHERE total >= best * 0.95 - 1e-12")
def top_candidates(spark, d):
    return ranking.top_candidates(ranked(spark, d)[1]).select("group_id", "key")


@query("best_of", f"{SQL}{STAGES}{_SCORES} SELECT group_id, first(key ORDER BY round(total, 9) DESC, pos) AS key FROM sc GROUP BY group_id")
def best_of(spark, d):
    return ranking.best_of(ranked(spark, d)[1].withColumn("total", F.round("total", 9))).select("group_id", "key")


@query("rank_tiers", f"{SQL}{STAGES}{_SCORES} SELECT group_id, key, CASE WHEN n > 1 AND kind IN ('burst', 'nearDuplicate', 'versions') THEN CASE WHEN r = 1 THEN 'best' WHEN t >= 0.5 THEN 'good' ELSE 'weaker' END END AS tier FROM (SELECT *, round(total, 9) AS t, row_number() OVER (PARTITION BY group_id ORDER BY round(total, 9) DESC, pos) AS r, count(*) OVER (PARTITION BY group_id) AS n FROM sc)")
def rank_tiers(spark, d):
    s = ranked(spark, d)[1].withColumn("total", F.round("total", 9))
    return ranking.rank_tiers(s, F.col("kind").isin("burst", "nearDuplicate", "versions")).select("group_id", "key", "tier")


@query("set_order", f"{SQL}{STAGES}{_SCORES} SELECT group_id, key, row_number() OVER (PARTITION BY group_id ORDER BY round(total, 9) DESC, pos) AS place FROM sc")
def set_order(spark, d):
    return ranking.set_order(ranked(spark, d)[1].withColumn("total", F.round("total", 9))).select("group_id", "key", "place")


_DECIDED = ", dec AS (SELECT 'a:' || lpad(event_id::VARCHAR, 9, '0') AS key, CASE event_id % 7 WHEN 1 THEN 'pick' WHEN 2 THEN 'reject' WHEN 4 THEN 'maybe' END AS decision FROM events WHERE event_id % 7 IN (1, 2, 4))"
_KEEPERS = f"{_SCORES}{_DECIDED}, kp AS (SELECT g.group_id, g.kind, g.ks, coalesce(p.key, g.keeper, b.key) AS keeper FROM groups g JOIN (SELECT group_id, first(key ORDER BY round(total, 9) DESC, pos) AS key FROM sc GROUP BY group_id) b USING (group_id) LEFT JOIN (SELECT group_id, first(key ORDER BY pos) AS key FROM sc JOIN dec USING (key) WHERE decision = 'pick' GROUP BY group_id) p USING (group_id))"


def kept(spark, d) -> tuple[DataFrame, DataFrame]:
    g, s = ranked(spark, d)
    return g, ranking.keeper(g, s.withColumn("total", F.round("total", 9)), views.decisions(spark, d))


@query("keeper", f"{SQL}{STAGES}{_KEEPERS} SELECT group_id, keeper FROM kp")
def keeper(spark, d):
    return kept(spark, d)[1]


@query("review_order", f"{SQL}{STAGES}{_KEEPERS} SELECT group_id, key, row_number() OVER (PARTITION BY group_id ORDER BY (key = keeper) DESC, pos) AS place FROM (SELECT group_id, keeper, unnest(ks) AS key, generate_subscripts(ks, 1) AS pos FROM kp)")
def review_order(spark, d):
    g, k = kept(spark, d)
    return ranking.review_order(g.select("group_id", F.posexplode("member_keys").alias("pos", "key")), k).select("group_id", "key", "place")


# Caches and merges.
_CACHE = "SELECT 'a:' || lpad(event_id::VARCHAR, 9, '0') AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE epoch_us(ts::TIMESTAMP) + CASE WHEN event_id % 3 = 0 THEN 1000000 ELSE 500000 END END AS cached, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS revision FROM events WHERE event_id % 6 <> 0"


def print_cache(spark, d) -> DataFrame:
    i, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    moved = F.when(i % 4 != 0, F.timestamp_micros(at + F.when(i % 3 == 0, 1_000_000).otherwise(500_000)))
    return table(spark, d, "events").filter(i % 6 != 0).select(views.key_of(i).alias("key"), moved.alias("cached_date"), F.when(i % 5 == 0, 1).otherwise(2).alias("revision"), F.lit("scaleFill").alias("crop"), F.array(i.cast("float")).alias("vector"))


@query("fresh_fingerprints", f"{SQL}, ca AS ({_CACHE}) SELECT key FROM ca JOIN assets USING (key) WHERE revision = 2 AND abs(cached - modified_us) < 1000000")
def fresh_fingerprints(spark, d):
    return cache.fresh_fingerprints(views.assets(spark, d, False), print_cache(spark, d)).select("key")


@query("prints_comparable", f"SELECT key, revision = 2 AS value FROM ({_CACHE})")
def prints_comparable(spark, d):
    own = F.struct(F.lit(2).alias("revision"), F.lit("scaleFill").alias("crop"))
    rows = print_cache(spark, d).select("key", F.struct("revision", "crop").alias("a"), own.alias("b"))
    return rows.select("key", P.prints_comparable("a", "b").alias("value"))


@query("stale_keys", f"SELECT key FROM ({_CACHE}) WHERE revision <> 2")
def stale_keys(spark, d):
    return cache.stale_keys(print_cache(spark, d))


@query("prune_cache", f"{SQL} SELECT key, revision FROM ({_CACHE}) c SEMI JOIN (SELECT key FROM assets WHERE media_type = 'image') USING (key)")
def prune_cache(spark, d):
    return cache.prune_cache(print_cache(spark, d), views.assets(spark, d, False).filter("media_type = 'image'")).select("key", "revision")


@query("upsert_cache", "SELECT user_id::VARCHAR AS key, max_by(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY user_id")
def upsert_cache(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_type", F.col("event_id").alias("seq"))
    return cache.upsert(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1")).select("key", "event_type", "seq")


def without_quality(a: DataFrame) -> DataFrame:
    """Two of three assets have lost their quality."""
    return a.withColumn("quality", F.when(F.col("event_id") % 3 == 0, F.col("quality")))


@query("apply_quality_cache", f"{SQL} SELECT key, CASE WHEN i % 3 = 0 THEN tier WHEN media_type = 'image' AND i % 2 = 0 AND i % 10 <> 4 THEN 'cached' END AS tier FROM assets")
def apply_quality_cache(spark, d):
    a = views.assets(spark, d, False)
    held = a.filter("event_id % 2 = 0").withColumn("quality", F.col("quality").withField("tier", F.lit("cached")))
    held = held.withColumn("modification_date", F.when(F.col("event_id") % 10 == 4, F.col("modification_date") + F.expr("interval 1 second")).otherwise(F.col("modification_date")))
    return cache.apply_quality_cache(without_quality(a), held).select("key", F.col("quality.tier").alias("tier"))


@query("needs_quality", f"{SQL} SELECT key FROM assets WHERE media_type = 'image' AND i % 3 <> 0 AND i % 31 <> 0")
def needs_quality(spark, d):
    a = views.assets(spark, d, False)
    return cache.needs_quality(without_quality(a), a.filter("event_id % 31 = 0")).select("key")


@query("merge_analysis", f"{SQL} SELECT key, CASE WHEN i % 2 = 0 AND i % 10 <> 4 THEN 'new' WHEN i % 3 = 0 THEN tier END AS tier, is_edited OR (i % 2 = 0 AND i % 10 <> 4 AND i % 29 = 0) AS is_edited_version FROM assets WHERE i % 41 <> 0")
def merge_analysis(spark, d):
    a = views.assets(spark, d, False)
    new = a.filter("event_id % 2 = 0").withColumn("quality", F.col("quality").withField("tier", F.lit("new"))).withColumn("is_edited_version", F.col("event_id") % 29 == 0)
    new = new.withColumn("modification_date", F.when(F.col("event_id") % 10 == 4, F.col("modification_date") + F.expr("interval 1 second")).otherwise(F.col("modification_date")))
    now = without_quality(a).filter("event_id % 41 <> 0")
    return cache.merge_analysis(now, new, ["quality"]).select("key", F.col("quality.tier").alias("tier"), "is_edited_version")


@query("attach_candidate_metadata", f"{SQL}, nb AS (SELECT key FROM (SELECT *, least(us - lag(us) OVER w, lead(us) OVER w - us) AS near FROM assets WHERE media_type = 'image' AND NOT is_screenshot AND NOT is_screen_recording AND us IS NOT NULL WINDOW w AS (PARTITION BY library_id ORDER BY us, key)) WHERE near <= 1800000000) SELECT key, CASE WHEN i % 4 = 0 AND key IN (FROM nb) THEN 9.0 ELSE bias END::DOUBLE AS exposure_bias FROM assets")
def attach_candidate_metadata(spark, d):
    a = views.assets(spark, d, False)
    meta = a.filter("event_id % 4 = 0").select("key", F.lit(True).alias("has_adjustments"), F.lit(9.0).alias("bias"))
    near = sessions.bracket_candidates(a, ENGINE.group)
    return cache.attach_candidate_metadata(a, meta, pairs.candidate_assets(a), near).select("key", "exposure_bias")


@query("attach_adjustments", f"{SQL}{_ALL_SESSIONS}, pc AS (SELECT key FROM (SELECT *, least(us - lag(us) OVER w, lead(us) OVER w - us) AS near FROM s1 WINDOW w AS (PARTITION BY library_id, sid ORDER BY us, key)) WHERE near <= 3600000000 AND media_type = 'image' AND NOT is_screenshot AND NOT is_screen_recording AND burst_identifier IS NULL) SELECT key, is_edited OR (i % 4 = 0 AND key IN (FROM pc)) AS is_edited_version FROM assets")
def attach_adjustments(spark, d):
    a = views.assets(spark, d, False)
    meta = a.filter("event_id % 4 = 0").select("key", F.lit(True).alias("has_adjustments"), F.lit(9.0).alias("bias"))
    return cache.attach_candidate_metadata(a, meta, pairs.candidate_assets(a), sessions.bracket_candidates(a, ENGINE.group)).select("key", "is_edited_version")


@query("nominate_duplicates", f"{SQL} SELECT library_id, key FROM (SELECT *, count(*) OVER (PARTITION BY library_id, content_hash) AS n FROM assets WHERE media_type = 'image' AND content_hash IS NOT NULL) WHERE n > 1")
def nominate_duplicates(spark, d):
    return cache.nominate_duplicates(views.assets(spark, d, False)).select("library_id", "key")


# Decisions.
_FOLD = "SELECT user_id::VARCHAR AS key, max_by(CASE event_type WHEN 'purchase' THEN 'pick' WHEN 'view' THEN 'maybe' WHEN 'click' THEN 'reject' WHEN 'signup' THEN 'unreviewed' ELSE '' END, (ts, event_id)) AS decision FROM events GROUP BY user_id"


@query("fold_journal", f"SELECT * FROM ({_FOLD}) WHERE decision <> ''")
def fold_journal(spark, d):
    return decisions.fold_journal(views.journal(spark, d).withColumn("value", F.coalesce("value", F.lit("")))).filter("decision <> ''")


_UPD = ", upd AS (SELECT key, CASE WHEN i % 5 = 0 THEN 'unreviewed' WHEN i % 5 = 1 THEN 'pick' ELSE 'reject' END AS nd FROM assets WHERE i % 5 < 3)"


def updates(spark, d) -> DataFrame:
    i = F.col("event_id")
    new = F.when(i % 5 == 0, F.lit("unreviewed")).when(i % 5 == 1, F.lit("pick")).otherwise(F.lit("reject"))
    return views.assets(spark, d, False).filter(i % 5 < 3).select("key", new.alias("decision"))


@query("apply_batch", f"{SQL}{_DECIDED}{_UPD} SELECT key, coalesce(nd, decision) AS decision FROM dec FULL JOIN upd USING (key) WHERE coalesce(nd, decision) <> 'unreviewed'")
def apply_batch(spark, d):
    return decisions.apply_batch(views.decisions(spark, d), updates(spark, d))[0]


@query("batch_snapshot", f"{SQL}{_DECIDED}{_UPD} SELECT key, coalesce(decision, 'unreviewed') AS decision FROM upd LEFT JOIN dec USING (key)")
def batch_snapshot(spark, d):
    return decisions.apply_batch(views.decisions(spark, d), updates(spark, d))[1]


@query("restore", f"{SQL}{_DECIDED} SELECT key, decision FROM dec")
def restore(spark, d):
    return decisions.restore(*decisions.apply_batch(views.decisions(spark, d), updates(spark, d)))


_LONG = f"{_DECIDED}{_SETTLED}, lf AS (SELECT g.library_id, g.group_id, g.kind, g.keeper, len(g.ks) AS n, a.key, a.deletable, a.proposable, list_contains(g.fl, a.key) AS is_flagged, coalesce(dec.decision, 'unreviewed') AS decision, stl.state IS NOT NULL AS is_settled FROM (SELECT *, unnest(ks) AS key FROM groups) g JOIN assets a USING (library_id, key) LEFT JOIN dec USING (key) LEFT JOIN stl USING (key)), mk AS (SELECT *, (is_flagged AND decision <> 'pick' AND NOT is_settled) OR decision = 'reject' AS marked FROM lf)"


def long_rows(spark, d) -> DataFrame:
    rows = decisions.long_form(all_groups(spark, d), views.assets(spark, d, False), views.decisions(spark, d), views.settled(spark, d))
    return rows.withColumn("marked", decisions.initial_mark())


@query("initial_marks", f"{SQL}{STAGES}{_LONG} SELECT group_id, key, marked FROM mk")
def initial_marks(spark, d):
    return long_rows(spark, d).select("group_id", "key", "marked")


@query("propose_keep_one", f"{SQL}{STAGES}{_LONG} SELECT group_id, key, decision = 'reject' OR (NOT is_settled AND key <> keeper AND decision <> 'pick' AND proposable) AS marked FROM lf WHERE kind IN ('burst', 'nearDuplicate') AND n > 1 AND keeper IS NOT NULL")
def propose_keep_one(spark, d):
    return decisions.propose_keep_one(long_rows(spark, d)).select("group_id", "key", "marked")


@query("reduce_to_one", f"{SQL}{STAGES}{_LONG} SELECT group_id, key, key <> keeper AND decision <> 'pick' AND proposable AS marked FROM lf WHERE keeper IS NOT NULL")
def reduce_to_one(spark, d):
    return decisions.reduce_to_one(long_rows(spark, d).filter("keeper is not null")).select("group_id", "key", "marked")


def resolve_query(mode: str, reject: str, clears: str) -> None:
    sql = f"{SQL}{STAGES}{_LONG}, rj AS (SELECT *, {reject} AS rj FROM mk), ra AS (SELECT *, bool_or(rj) OVER (PARTITION BY group_id) AS any_rj FROM rj) SELECT key, CASE WHEN rj THEN 'reject' ELSE 'unreviewed' END AS decision FROM ra WHERE rj OR (decision = 'reject' AND {clears})"
    query(f"resolve_{mode}", sql)(lambda spark, d: decisions.resolve(long_rows(spark, d), mode))


resolve_query("keep", "false", "true")
resolve_query("discard", "kind <> 'bracket' AND ((marked AND decision <> 'pick') OR (NOT marked AND n = 1 AND deletable))", "NOT any_rj")
resolve_query("resolve", "marked AND deletable AND decision <> 'pick'", "true")


def chosen(spark, d, rows: DataFrame) -> DataFrame:
    return rows.groupBy("group_id").agg(F.max("key").alias("chosen"))


_CHOSEN = ", ch AS (SELECT *, max(key) OVER (PARTITION BY group_id) AS chosen FROM lf)"


@query("keep_only", f"{SQL}{STAGES}{_LONG}{_CHOSEN}, kn AS (SELECT key, CASE WHEN key = chosen THEN CASE WHEN decision <> 'pick' THEN 'pick' END WHEN proposable THEN CASE WHEN decision <> 'reject' THEN 'reject' END WHEN decision = 'pick' THEN 'unreviewed' END AS decision FROM ch) SELECT * FROM kn WHERE decision IS NOT NULL")
def keep_only(spark, d):
    rows = long_rows(spark, d)
    return decisions.keep_only(rows, chosen(spark, d, rows))


@query("set_keeper", f"{SQL}{STAGES}{_LONG}{_CHOSEN} SELECT key, CASE WHEN key = chosen THEN 'pick' ELSE 'unreviewed' END AS decision FROM ch WHERE (key = chosen AND decision <> 'pick') OR (key <> chosen AND decision = 'pick')")
def set_keeper(spark, d):
    rows = long_rows(spark, d)
    return decisions.set_keeper(rows, chosen(spark, d, rows))


def third(spark, d) -> DataFrame:
    return views.assets(spark, d, False).filter("event_id % 3 = 1").select("key")


@query("mark_for_deletion", f"{SQL}{_DECIDED} SELECT key, 'reject' AS decision FROM assets WHERE i % 3 = 1 AND deletable AND key NOT IN (SELECT key FROM dec WHERE decision = 'reject')")
def mark_for_deletion(spark, d):
    return decisions.mark_for_deletion(views.assets(spark, d, False), views.decisions(spark, d), third(spark, d))


@query("clear_rejects", f"{SQL}{_DECIDED} SELECT key, 'unreviewed' AS decision FROM dec SEMI JOIN (SELECT key FROM assets WHERE i % 3 = 1) USING (key) WHERE decision = 'reject'")
def clear_rejects(spark, d):
    return decisions.clear_rejects(views.decisions(spark, d), third(spark, d))


@query("pick", f"{SQL}{_DECIDED} SELECT key, 'pick' AS decision FROM assets WHERE i % 3 = 1 AND key NOT IN (SELECT key FROM dec WHERE decision = 'pick')")
def pick(spark, d):
    return decisions.pick(views.decisions(spark, d), third(spark, d))


@query("remove_picks", f"{SQL}{_DECIDED} SELECT key, 'unreviewed' AS decision FROM dec SEMI JOIN (SELECT key FROM assets WHERE i % 3 = 1) USING (key) WHERE decision = 'pick'")
def remove_picks(spark, d):
    return decisions.remove_picks(views.decisions(spark, d), third(spark, d))


@query("deletion_candidates", f"{SQL}{_DECIDED} SELECT library_id, key FROM assets JOIN dec USING (key) WHERE decision = 'reject' AND deletable")
def deletion_candidates(spark, d):
    return decisions.deletion_candidates(views.assets(spark, d, False), views.decisions(spark, d))


@query("commit_batch", f"{SQL}{_DECIDED} SELECT library_id, string_agg(key, '|' ORDER BY key) AS asset_keys, {NOW_US} AS date_us FROM assets JOIN dec USING (key) WHERE decision = 'reject' AND deletable AND i % 9 <> 0 GROUP BY library_id")
def commit_batch(spark, d):
    a, dec = views.assets(spark, d, False), views.decisions(spark, d)
    ledger, _ = decisions.commit_batch(decisions.deletion_candidates(a, dec), a.filter("event_id % 9 <> 0"), dec, NOW_US)
    return joined(ledger, "asset_keys")


@query("commit_batch_decisions", f"{SQL}{_DECIDED} SELECT dec.* FROM dec LEFT JOIN assets USING (key) WHERE NOT (decision = 'reject' AND deletable AND i % 9 <> 0)")
def commit_batch_decisions(spark, d):
    a, dec = views.assets(spark, d, False), views.decisions(spark, d)
    return decisions.commit_batch(decisions.deletion_candidates(a, dec), a.filter("event_id % 9 <> 0"), dec, NOW_US)[1]


@query("save_group_states", f"{SQL}{STAGES} SELECT group_id, {_STATE} ELSE 'pending' END AS state FROM groups WHERE left(group_id, 1) < '6'")
def save_group_states(spark, d):
    g = all_groups(spark, d)
    up = state_updates(g)
    return decisions.save_group_state(some_states(g), views.settled(spark, d), up, g.select("group_id", F.explode("member_keys").alias("key")))[0]


def state_updates(g: DataFrame) -> DataFrame:
    """New states of the groups whose id starts with a digit under 6."""
    first = F.substring("group_id", 1, 1)
    return g.filter(first < "6").select("group_id", F.when(first < "2", F.lit("dismissed")).when(first < "4", F.lit("resolved")).otherwise(F.lit("pending")).alias("state"))


@query("save_group_state", f"{SQL}{STAGES}{_SETTLED}, up AS (SELECT group_id, ks, {_STATE} WHEN left(group_id, 1) < '6' THEN 'pending' END AS state FROM groups WHERE left(group_id, 1) < '6'), tk AS (SELECT unnest(ks) AS key, state FROM up) SELECT key, state FROM stl WHERE key NOT IN (SELECT key FROM tk) UNION ALL SELECT key, state FROM tk WHERE state <> 'pending'")
def save_group_state(spark, d):
    g = all_groups(spark, d)
    members = g.select("group_id", F.explode("member_keys").alias("key"))
    return decisions.save_group_state(some_states(g), views.settled(spark, d), state_updates(g), members)[1]


@query("start_over", f"{SQL}{_SETTLED} SELECT key, state FROM stl WHERE state = 'dismissed'")
def start_over(spark, d):
    s = views.settled(spark, d)
    return decisions.start_over(s.withColumnRenamed("key", "group_id"), s, False)[1]


@query("start_over_states", f"{SQL}{STAGES} SELECT group_id, 'dismissed' AS state FROM groups WHERE left(group_id, 1) < '2'")
def start_over_states(spark, d):
    return decisions.start_over(some_states(all_groups(spark, d)), views.settled(spark, d), False)[0]


@query("start_over_all", f"{SQL}{_SETTLED} SELECT key, state FROM stl WHERE false")
def start_over_all(spark, d):
    s = views.settled(spark, d)
    return decisions.start_over(s.withColumnRenamed("key", "group_id"), s, True)[1]


@query("carry_cards", f"{SQL}{STAGES}{_LONG} SELECT group_id, CASE WHEN left(group_id, 1) < '8' THEN array_to_string(list_sort(list_filter(ks, lambda k: right(k, 1) < '5')), '|') ELSE coalesce(string_agg(mk.key, '|' ORDER BY mk.key) FILTER (mk.marked), '') END AS marks, CASE WHEN left(group_id, 1) < '8' THEN ks[1] END AS suggestion, left(group_id, 1) < '5' AS user_edited, CASE WHEN left(group_id, 1) < '3' THEN len(ks) END AS deferred FROM (SELECT group_id, ks FROM groups WHERE left(group_id, 1) <> '7') JOIN mk USING (group_id) GROUP BY group_id, ks")
def carry_cards(spark, d):
    g = all_groups(spark, d)
    first = F.substring("group_id", 1, 1)
    low = F.filter("member_keys", lambda k: F.right(k, F.lit(1)) < "5")
    old = g.filter(first < "8").select("group_id", F.concat(low, F.array(F.lit("gone"))).alias("marks"), F.element_at("member_keys", 1).alias("suggestion"), (first < "5").alias("user_edited"), F.when(first < "3", F.size("member_keys")).alias("deferred"))
    rows = decisions.long_form(g, views.assets(spark, d, False), views.decisions(spark, d), views.settled(spark, d)).filter(decisions.initial_mark())
    now = g.withColumn("state", F.when(first == "7", F.lit("resolved")).otherwise(F.lit("pending")))
    return joined(decisions.carry_cards(old, now, rows.groupBy("group_id").agg(F.collect_list("key").alias("marks"))), "marks")


@query("carry_marks", f"{SQL}{STAGES} SELECT group_id, array_to_string(list_sort(list_filter(ks, lambda k: right(k, 1) < '5')), '|') AS marks FROM groups WHERE left(group_id, 1) < '8'")
def carry_marks(spark, d):
    g = all_groups(spark, d)
    old = g.filter(F.substring("group_id", 1, 1) < "8").select("group_id", F.concat(F.filter("member_keys", lambda k: F.right(k, F.lit(1)) < "5"), F.array(F.lit("gone"))).alias("marks"))
    return joined(decisions.carry_marks(old, g), "marks")


@query("deck_queue", f"{SQL}{STAGES}{_LONG} SELECT g.library_id, g.group_id, g.position, string_agg(mk.key, '|' ORDER BY mk.key) FILTER (mk.marked) AS marks FROM groups g JOIN mk USING (group_id) WHERE left(g.group_id, 1) >= '4' GROUP BY ALL")
def deck_queue(spark, d):
    held = all_groups(spark, d)
    g = groups.deck_order(held)
    rows = decisions.long_form(held, views.assets(spark, d, False), views.decisions(spark, d), views.settled(spark, d)).withColumn("marked", decisions.initial_mark())
    marks = rows.groupBy("group_id").agg(F.array_sort(F.collect_list(F.when(F.col("marked"), F.col("key")))).alias("m"))
    open_ = g.join(some_states(g).select("group_id"), "group_id", "left_anti")
    return open_.join(marks, "group_id").select("library_id", "group_id", "position", F.when(F.size("m") > 0, F.array_join("m", "|")).alias("marks"))


# Reports.
@query("pending_deletions", "SELECT count(*) AS pending, min(epoch_us(o_orderdate::TIMESTAMP)) AS oldest_us FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE epoch_us(o_orderdate::TIMESTAMP) > 880000000000000 - 2592000000000")
def pending_deletions(spark, d):
    return reports.pending_deletions(views.ledger(spark, d), 880_000_000_000_000)


@query("prune_deletions", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE epoch_us(o_orderdate::TIMESTAMP) > 880000000000000 - 2592000000000 GROUP BY o_orderkey")
def prune_deletions(spark, d):
    return reports.prune_deletions(views.ledger(spark, d), 880_000_000_000_000).select("o_orderkey", F.size("asset_keys").cast("long").alias("n"))


@query("total_deleted", "SELECT count(*) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def total_deleted(spark, d):
    return reports.total_deleted(views.ledger(spark, d))


@query("total_size", f"{SQL}{_DECIDED} SELECT coalesce(sum(coalesce(byte_size, 0)), 0)::BIGINT AS total_size FROM dec JOIN assets USING (key) WHERE decision = 'reject'")
def total_size(spark, d):
    a = views.assets(spark, d, False)
    return reports.total_size(views.decisions(spark, d).filter("decision = 'reject'"), a.select("key", F.col("byte_size").alias("size")))


@query("review_progress", f"{SQL}{STAGES}{_DECIDED} SELECT (SELECT count(*) FROM groups WHERE left(group_id, 1) >= '4') AS pending_groups, (SELECT count(*) FROM dec) AS reviewed")
def review_progress(spark, d):
    g = all_groups(spark, d)
    g = groups.apply_group_state(g, some_states(g), views.settled(spark, d).filter("false"))
    return reports.review_progress(g, views.decisions(spark, d))


_SAMPLE = ", sm0 AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY captured_at NULLS FIRST, key) - 1 AS r, greatest(count(*) OVER (PARTITION BY library_id) // 24, 1) AS st FROM assets), sm AS (SELECT * FROM sm0 WHERE r % st = 0 AND r < st * 24)"


@query("systematic_sample", f"{SQL}{_SAMPLE} SELECT library_id, key FROM sm")
def systematic_sample(spark, d):
    return reports.systematic_sample(views.assets(spark, d, False)).select("library_id", "key")


@query("storage_situation", f"{SQL}{_SAMPLE} SELECT library_id, CASE WHEN bool_or(stand_in) THEN 'optimising' ELSE 'fullCopies' END AS situation FROM sm GROUP BY library_id")
def storage_situation(spark, d):
    s = reports.systematic_sample(views.assets(spark, d, False))
    return reports.storage_situation(s.withColumn("evicted", F.col("scored_from_stand_in")))


@query("face_summary", "SELECT l_orderkey AS key, first(l_linenumber ORDER BY l_quantity * l_discount DESC, l_linenumber) AS largest_face, min(l_tax) AS face_capture_quality FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) GROUP BY l_orderkey")
def face_summary(spark, d):
    c = lambda n: F.col(n).cast("double")
    return reports.face_summary(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("face"), c("l_quantity").alias("w"), c("l_discount").alias("h"), c("l_tax").alias("quality")))


@query("newest_first", f"{SQL} SELECT library_id, key, row_number() OVER (PARTITION BY library_id ORDER BY captured_at DESC NULLS LAST, key) AS place FROM assets")
def newest_first(spark, d):
    return reports.newest_first(views.assets(spark, d, False)).select("library_id", "key", "place")


@query("biggest_first", f"{SQL} SELECT library_id, key, row_number() OVER (PARTITION BY library_id ORDER BY coalesce(byte_size, 0) DESC, captured_at DESC NULLS LAST, key) AS place FROM assets WHERE media_type = 'video' AND NOT is_screen_recording")
def biggest_first(spark, d):
    a = views.assets(spark, d, False)
    return reports.biggest_first(a, a.select("key", F.col("byte_size").alias("size"))).select("library_id", "key", "place")


@query("member_order", f"{SQL} SELECT library_id, key, row_number() OVER (PARTITION BY library_id ORDER BY us NULLS LAST, key) AS place FROM assets")
def member_order(spark, d):
    a = views.assets(spark, d, False).select("library_id", "key", P.usable_us().alias("use_us"))
    return groups.order_members(a).select("library_id", "key", "place")


def filter_query(name: str, condition: str, category: str) -> None:
    query(f"category_{name}", f"{SQL} SELECT library_id, key FROM soft WHERE {condition}")(lambda spark, d: reports.category_filter(views.assets(spark, d, False), category).select("library_id", "key"))


filter_query("all", "true", "all")
filter_query("failed", "tier = 'obviouslyBroken'", "failed")
filter_query("screenshots", "is_screenshot", "screenshots")
filter_query("recordings", "is_screen_recording", "recordings")
filter_query("videos", "media_type = 'video' AND NOT is_screen_recording", "videos")


@query("category_duplicates", f"{SQL}{STAGES} SELECT library_id, key FROM fin WHERE kind = 'exactDuplicate'")
def category_duplicates(spark, d):
    g = groups.make_groups(early(spark, d).filter("kind is not null"), NOW_US, ENGINE)
    return reports.category_filter(views.assets(spark, d, False), "duplicates", g).select("library_id", "key")


def review_query(what: str, condition: str) -> None:
    query(f"review_{what}", f"{SQL}{_DECIDED} SELECT library_id, key FROM assets JOIN dec USING (key) WHERE {condition}")(lambda spark, d: reports.review_filter(views.assets(spark, d, False), views.decisions(spark, d), what).select("library_id", "key"))


review_query("picks", "decision = 'pick'")
review_query("marked", "decision = 'reject'")


@query("review_videos", f"{SQL} SELECT library_id, key, coalesce(byte_size, 0) AS size, row_number() OVER (PARTITION BY library_id ORDER BY coalesce(byte_size, 0) DESC, captured_at DESC NULLS LAST, key) AS place FROM assets WHERE media_type = 'video' AND NOT is_screen_recording")
def review_videos(spark, d):
    a = views.assets(spark, d, False)
    sizes = a.select("key", F.col("byte_size").alias("size"))
    return reports.review_filter(a, views.decisions(spark, d), "videos", sizes=sizes).select("library_id", "key", "size", "place")


@query("review_sets", f"{SQL}{STAGES} SELECT library_id, key FROM (SELECT library_id, unnest(ks) AS key FROM groups)")
def review_sets(spark, d):
    return reports.review_filter(views.assets(spark, d, False), views.decisions(spark, d), "sets", all_groups(spark, d)).select("library_id", "key")


# Stores that are kept between runs, fed batch by batch; each under a fresh path.
def store_path(spark, name: str) -> str:
    return Tables(spark, name).root


@query("journal_snapshot", "SELECT key, value AS decision FROM (SELECT user_id::VARCHAR AS key, first(CASE event_type WHEN 'purchase' THEN 'pick' WHEN 'view' THEN 'maybe' WHEN 'click' THEN 'reject' WHEN 'signup' THEN 'unreviewed' END ORDER BY event_id DESC) AS value FROM events GROUP BY user_id) WHERE value IS NOT NULL")
def journal_snapshot(spark, d):
    """The journal in four batches by its sequence, the last one twice; errors remove. It folds on the way."""
    entries = views.journal(spark, d).select(F.col("seq.event_id").cast("long").alias("seq"), "key", "value")
    last = entries.agg(F.max("seq")).first()[0] or 0
    kept, step = Journal(spark, store_path(spark, "journal"), fold_after=2000), last // 4 + 1
    for k in (0, 1, 2, 3, 3):
        kept.append(entries.filter(F.col("seq").between(k * step, (k + 1) * step - 1)), k)
    return kept.read()


@query("ledger_once", f"WITH b AS (SELECT o_orderkey, epoch_us(o_orderdate::TIMESTAMP) AS date_us, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT count(*) AS batches, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (date_us > {NOW_US} - 11 * 365 * 86400000000), 0)::BIGINT AS pending FROM b")
def ledger_once(spark, d):
    """Orders as deletions, a batch for each priority, every batch twice."""
    rows = views.ledger(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    kept = Ledger(spark, store_path(spark, "ledger"))
    for p in [r[0] for r in rows.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()] * 2:
        kept.append(p, rows.filter(F.col("o_orderpriority") == p))
    pending = kept.pending(NOW_US, 11 * 365).first().pending
    return kept.read().agg(F.count("*").alias("batches"), F.sum(F.size("asset_keys")).alias("total")).withColumn("pending", F.lit(pending).cast("long"))


@query("cache_in_buckets", "SELECT user_id::VARCHAR AS key, max_by(event_type, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0")
def cache_in_buckets(spark, d):
    """Last event of a user, from two batches; users without a purchase are pruned."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    kept = cache.BucketCache(spark, store_path(spark, "cache"), "key string, seq long, value string", buckets=16)
    kept.upsert(e.filter("seq % 2 = 1"), 0)
    kept.upsert(e.filter("seq % 2 = 0"), 1)
    kept.prune(e.filter("value = 'purchase'").select("key").distinct())
    return kept.read().select("key", "value", "seq")


@query("live_components", f"{ORACLE['near_duplicate_edges'].rsplit(' SELECT ', 1)[0]}, ed AS (SELECT key_a AS a, key_b AS b FROM p WHERE dist <= lim), both_ AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(x, y) AS (SELECT a, a FROM both_ UNION SELECT r.x, e.b FROM reach r JOIN both_ e ON e.a = r.y) SELECT x AS node, min(y) AS component FROM reach GROUP BY x")
def live_components(spark, d):
    """The near-duplicate edges in three batches: of each block, a star for each component of its edges joins the same."""
    rows, tables = sessions.sessionize(views.assets(spark, d)), Tables(spark, "edges")
    links = pairs.links_in_blocks(rows, ["library_id", "session_id"], int(ENGINE.group.pair_window * US), ENGINE.near, tables)
    edges = tables.write(links.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
    tables.drop_but(edges)
    kept = LiveComponents(spark, store_path(spark, "live"))
    for k in range(3):
        kept.add(edges.filter(F.pmod(F.xxhash64("a"), F.lit(3)) == k), k)
    return kept.read()


@query("live_groups", f"{SQL}{STAGES} SELECT {', '.join(_OUT)} FROM groups")
def live_groups(spark, d):
    """The library in two batches of assets by time of event: the groups of a run over all."""
    a = views.as_assets(views.assets(spark, d), sources.asset_schema())
    kept = LiveLibrary(spark, store_path(spark, "library"), NOW_US, ENGINE, buckets=16)
    half = views.assets(spark, d, False).agg(F.percentile_approx(F.unix_micros("modification_date"), 0.9)).first()[0] or 0
    late = F.unix_micros("modification_date") > half
    kept.apply(a.filter(~late), batch=0)
    kept.apply(a.filter(late), batch=1)
    return shown(kept.groups())
