"""The given tables seen as assets, journals and ledgers, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.config import Engine, GroupConfig, NearConfig
from gleanery.functions.scalars import classify_quality

#: Events are minutes apart and embeddings far from each other, so bracket gaps and distances are wider here.
ENGINE = Engine(group=GroupConfig(bracket_max_gap=1800), near=NearConfig(steps=((3, 1.35), (120, 1.30), (3600, 1.20))))
NOW_US = 1_707_955_200_000_000  # 2024-02-15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(number: Column) -> Column:
    return F.concat(F.lit("a:"), F.lpad(number.cast("string"), 9, "0"))


def assets(spark: SparkSession, sf_dir: str, prints: bool = True) -> DataFrame:
    """One asset per event, hashes from the document and the vector from the embedding of its number."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.sha2("text", 256).alias("original_hash"), F.sha2(F.replace("text", F.lit(" "), F.lit("")), 256).alias("content_hash"), F.col("n_chars").alias("byte_size"))
    i = F.col("event_id")
    every = lambda n, r=0: i % n == r
    at = F.col("ts").cast("timestamp")
    share = lambda m, n: (i * m) % n / F.lit(float(n - 1))
    rows = e.join(docs, "event_id", "left").select(
        "event_id", "user_id", "event_type", "value", key_of(i).alias("key"), F.concat(F.lit("lib"), (F.col("user_id") % 20).cast("string")).alias("library_id"),
        F.when(every(89), None).when(every(97), F.lit("2000-01-01").cast("timestamp")).otherwise(at).alias("captured_at"), at.alias("modification_date"),
        F.when(F.col("event_type") == "error", F.lit("video")).otherwise(F.lit("image")).alias("media_type"),
        ((F.col("event_type") == "signup") & every(4)).alias("is_screenshot"), ((F.col("event_type") == "error") & every(3)).alias("is_screen_recording"),
        F.when(i % 10 < 3, F.concat(F.lit("b"), F.floor(i / 10).cast("string"))).alias("burst_identifier"),
        every(50, 1).alias("is_burst_user_pick"), every(30, 2).alias("is_burst_auto_pick"),
        F.when(every(13), F.lit("iTunesSynced")).when(every(29), F.lit("cloudShared")).otherwise(F.lit("userLibrary")).alias("source_type"),
        every(17).alias("is_favorite"), every(23).alias("is_edited_version"), F.when(i % 40 < 12, (i % 4 - 1).cast("double")).alias("exposure_bias"),
        F.struct(
            F.col("value").alias("subject_sharpness"), F.col("value").alias("global_sharpness"), share(1, 101).alias("clipped_highlights"),
            share(7, 103).alias("clipped_shadows"), share(13, 1009).alias("frame_uniformity"), every(19).alias("subject_is_face"),
        ).alias("metrics"),
        "original_hash", "content_hash", "byte_size", every(37).alias("scored_from_stand_in"),
        F.when(every(5), share(3, 11)).alias("aesthetics_score"), F.when(every(7), share(5, 13)).alias("face_capture_quality"),
    )
    q = classify_quality("metrics", ENGINE.quality)
    rows = rows.withColumn("quality", F.struct(q["tier"].alias("tier"), F.col("metrics"), q["reasons"].alias("reasons"))).drop("metrics")
    if not prints:
        return rows.withColumn("fingerprint", F.lit(None).cast("struct<revision:int,crop:string,vector:array<float>>"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    print_ = F.when(F.col("embedding").isNotNull(), F.struct(F.lit(2).alias("revision"), F.lit("scaleFill").alias("crop"), F.col("embedding").alias("vector")))
    return rows.withColumn("vec_id", i % n).join(vectors, "vec_id", "left").withColumn("fingerprint", print_).drop("vec_id", "embedding")


def as_assets(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, null where it has none."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane of 64 pixels for each embedding, 8 x 8 or 16 x 4; some white, black, flat or broken; every second with a face."""
    i, x = F.col("vec_id"), F.col("embedding")
    value = lambda v: F.when(i % 11 == 0, 255).when(i % 11 == 1, 0).when(i % 11 == 2, 128 + v.cast("double")).otherwise((v.cast("double") + 1) * 127.5)
    octets = F.transform(x, lambda v: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value(v)))).cast("long")), 2, "0"))
    rect = lambda a, b: F.struct(F.lit(a).alias("x"), F.lit(a).alias("y"), F.lit(b).alias("w"), F.lit(b).alias("h"))
    return table(spark, sf_dir, "embeddings").select(
        i.cast("string").alias("key"), F.when(i % 3 == 0, 16).otherwise(8).alias("width"), F.when(i % 3 == 0, 4).otherwise(8).alias("height"),
        F.when(i % 13 != 5, F.unhex(F.array_join(octets, ""))).alias("pixels"), F.when(i % 2 == 0, F.array(rect(0.0, 0.1), rect(0.25, 0.5), rect(0.5, 0.5))).alias("faces"),
        F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("saliency"), (i % 17 == 0).alias("fallback"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a decision journal: seq, key (of the user), value; null removes."""
    t = F.col("event_type")
    value = F.when(t == "purchase", F.lit("pick")).when(t == "view", F.lit("maybe")).when(t == "click", F.lit("reject")).when(t == "signup", F.lit("unreviewed"))
    return table(spark, sf_dir, "events").select(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), value.alias("value"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for three of seven assets."""
    i = F.col("event_id")
    value = F.when(i % 7 == 1, F.lit("pick")).when(i % 7 == 2, F.lit("reject")).when(i % 7 == 4, F.lit("maybe"))
    return table(spark, sf_dir, "events").select(key_of(i).alias("key"), value.alias("decision")).filter("decision is not null")


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    value = F.when(i % 11 < 5, F.lit("resolved")).when(i % 11 < 8, F.lit("dismissed"))
    return table(spark, sf_dir, "events").select(key_of(i).alias("key"), value.alias("state")).filter("state is not null")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deletion batches, their parts as keys."""
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("asset_keys"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("date_us"))
    return orders.join(keys, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "date_us", "asset_keys")


#: The same views for DuckDB: the first CTEs of every query.
SQL = """
WITH RECURSIVE emb AS (SELECT vec_id, embedding::DOUBLE[] AS vector, count(*) OVER () AS c FROM embeddings),
base AS (
  SELECT event_id AS i, user_id, event_type, value, 'a:' || lpad(event_id::VARCHAR, 9, '0') AS key, 'lib' || (user_id % 20)::VARCHAR AS library_id,
    CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN TIMESTAMP '2000-01-01' ELSE ts::TIMESTAMP END AS captured_at,
    epoch_us(ts::TIMESTAMP) AS modified_us,
    CASE WHEN event_type = 'error' THEN 'video' ELSE 'image' END AS media_type,
    (event_type = 'signup' AND event_id % 4 = 0) AS is_screenshot, (event_type = 'error' AND event_id % 3 = 0) AS is_screen_recording,
    CASE WHEN event_id % 10 < 3 THEN 'b' || (event_id // 10)::VARCHAR END AS burst_identifier,
    event_id % 50 = 1 AS user_pick, event_id % 30 = 2 AS auto_pick,
    CASE WHEN event_id % 13 = 0 THEN 'iTunesSynced' WHEN event_id % 29 = 0 THEN 'cloudShared' ELSE 'userLibrary' END AS source_type,
    event_id % 17 = 0 AS is_favorite, event_id % 23 = 0 AS is_edited, CASE WHEN event_id % 40 < 12 THEN (event_id % 4 - 1)::DOUBLE END AS bias,
    value AS sharp, (event_id % 101) / 100.0::DOUBLE AS hi, ((event_id * 7) % 103) / 102.0::DOUBLE AS lo, ((event_id * 13) % 1009) / 1008.0::DOUBLE AS uni,
    event_id % 19 = 0 AS face, event_id % 37 = 0 AS stand_in,
    CASE WHEN event_id % 5 = 0 THEN ((event_id * 3) % 11) / 10.0::DOUBLE END AS looks, CASE WHEN event_id % 7 = 0 THEN ((event_id * 5) % 13) / 12.0::DOUBLE END AS faceq
  FROM events),
assets AS (
  SELECT b.*, epoch_us(captured_at) AS raw_us, CASE WHEN captured_at > TIMESTAMP '2005-01-01' THEN epoch_us(captured_at) END AS us,
    sha256(d.text) AS original_hash, sha256(replace(d.text, ' ', '')) AS content_hash, d.n_chars AS byte_size, m.vector,
    CASE WHEN uni >= 0.995 OR hi >= 0.97 OR lo >= 0.97 THEN 'obviouslyBroken' WHEN sharp < 12 OR (hi >= 0.15 AND lo >= 0.15) THEN 'probablyBad' ELSE 'ok' END AS tier,
    CASE WHEN uni >= 0.995 THEN ['Nearly one colour: covered lens or accidental press'] WHEN hi >= 0.97 THEN ['Almost entirely blown out'] WHEN lo >= 0.97 THEN ['Almost entirely black']
         ELSE list_filter([CASE WHEN sharp < 12 THEN CASE WHEN face THEN 'Face is out of focus' ELSE 'Out of focus or motion-blurred' END END, CASE WHEN hi >= 0.15 AND lo >= 0.15 THEN 'Severely clipped exposure' END], lambda x: x IS NOT NULL) END AS reasons,
    source_type = 'userLibrary' AS deletable, source_type = 'userLibrary' AND NOT is_favorite AS proposable
  FROM base b LEFT JOIN documents d ON d.doc_id = b.i LEFT JOIN emb m ON m.vec_id = b.i % m.c),
soft AS (SELECT *, tier <> 'ok' AND len(list_filter(reasons, lambda r: contains(r, 'blown out') OR contains(r, 'black') OR contains(r, 'clipped'))) = 0 AS is_soft FROM assets)
"""
