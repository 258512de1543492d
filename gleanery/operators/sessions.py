"""Capture sessions and exposure runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.config import US, GroupConfig
from gleanery.functions.predicates import is_expired_utility, usable_us
from gleanery.ordering import has_neighbour


def sessionize(assets: DataFrame, config: GroupConfig = GroupConfig()) -> DataFrame:
    """Dated rows with ts_us and session_id (number of the session in its library).

    A gap strictly above the limit starts a session. Rows of one bucket of the gap's width can't be split, so breaks are
    found between buckets: a library's rows are summed to a row per bucket before the window sees them.
    """
    gap = int(config.session_gap * US)
    dated = assets.withColumn("ts_us", usable_us(config)).filter("ts_us is not null").withColumn("__b", F.floor(F.col("ts_us") / gap))
    buckets = dated.groupBy("library_id", "__b").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    w = Window.partitionBy("library_id").orderBy("__b")
    starts = F.when(F.col("lo") - F.lag("hi").over(w) > gap, 1).otherwise(0)
    buckets = buckets.withColumn("start", starts).withColumn("session_id", F.sum("start").over(w))
    return dated.join(buckets.select("library_id", "__b", "session_id"), ["library_id", "__b"]).drop("__b")


def bracket_runs(sessions: DataFrame, config: GroupConfig = GroupConfig()) -> DataFrame:
    """Rows with a bias, and their run: (session, island, chunk). A run breaks on a missing bias, a gap or a repeat."""
    w = Window.partitionBy("library_id", "session_id").orderBy("ts_us", "key")
    bias = F.round(F.col("exposure_bias") * 10)
    rows = sessions.withColumn("b10", bias).withColumn("p10", F.lag("b10").over(w)).withColumn("pts", F.lag("ts_us").over(w))
    cut = F.col("b10").isNull() | F.col("p10").isNull() | (F.col("ts_us") - F.col("pts") > int(config.bracket_max_gap * US)) | (F.col("b10") == F.col("p10"))
    rows = rows.withColumn("island", F.sum(cut.cast("int")).over(w)).filter("b10 is not null")
    inside = Window.partitionBy("library_id", "session_id", "island").orderBy("ts_us", "key")
    rows = rows.withColumn("chunk", F.floor((F.row_number().over(inside) - 1) / config.bracket_max_count))
    return rows.drop("p10", "pts")


def progression_filter(config: GroupConfig = GroupConfig()):
    """HAVING condition over aggregates n, n_bias, n_distinct, span of a group."""
    return (F.col("n") == F.col("n_bias")) & F.col("n").between(2, config.bracket_max_count) & (F.col("n_distinct") == F.col("n")) & (F.col("bias_span") >= config.bracket_min_span)


def progression_aggregates() -> list:
    b = F.col("exposure_bias")
    return [F.count("*").alias("n"), F.count(b).alias("n_bias"), F.count_distinct(F.round(b * 10)).alias("n_distinct"), (F.max(b) - F.min(b)).alias("bias_span")]


def bracket_candidates(assets: DataFrame, config: GroupConfig = GroupConfig()) -> DataFrame:
    """Dated images, no screen captures, that have a neighbour within the bracket gap."""
    rows = assets.withColumn("ts_us", usable_us(config)).filter((F.col("media_type") == "image") & ~is_expired_utility() & F.col("ts_us").isNotNull())
    return has_neighbour(rows, ["library_id"], "ts_us", int(config.bracket_max_gap * US))
