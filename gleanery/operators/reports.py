"""Counts, sizes, orders and filters that screens and ledgers ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.config import US
from gleanery.functions.predicates import is_contained_video
from gleanery.operators.groups import deck_keys
from gleanery.ordering import Ranges


def pending_deletions(ledger: DataFrame, now_us: int, days: int = 30) -> DataFrame:
    """Keys and oldest date of batches younger than the retention; ``ledger(date_us, asset_keys)``."""
    young = ledger.filter(F.col("date_us") > now_us - days * 86_400 * US)
    return young.agg(F.coalesce(F.sum(F.size("asset_keys")), F.lit(0)).alias("pending"), F.min("date_us").alias("oldest_us"))


def prune_deletions(ledger: DataFrame, now_us: int, days: int = 30) -> DataFrame:
    return ledger.filter(F.col("date_us") > now_us - days * 86_400 * US)


def total_deleted(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum(F.size("asset_keys")), F.lit(0)).alias("total"))


def resource_sizes(assets: DataFrame, resources: DataFrame) -> DataFrame:
    """Bytes of an asset's video resources; unmeasured ones count 0. ``resources(key, type, bytes)``."""
    sizes = resources.filter(F.col("type").contains("ideo")).groupBy("key").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("size"))
    return assets.select("key").join(sizes, "key", "left").select("key", F.coalesce("size", F.lit(0)).alias("size"))


def total_size(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    return keys.select("key").join(sizes, "key", "left").agg(F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)).alias("total_size"))


def review_progress(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending groups and reviewed photos, one row."""
    zero = F.lit(0).cast("long")
    left = groups.select(F.when(F.col("state") == "pending", 1).otherwise(zero).alias("p"), zero.alias("r"))
    right = decisions.select(zero.alias("p"), F.when(F.col("decision") != "unreviewed", 1).otherwise(zero).alias("r"))
    return left.union(right).agg(F.coalesce(F.sum("p"), zero).alias("pending_groups"), F.coalesce(F.sum("r"), zero).alias("reviewed"))


def systematic_sample(assets: DataFrame, n: int = 24) -> DataFrame:
    """Per library every max(count / n, 1)-th row by date, then key, at most n."""
    rows = Ranges(assets, ["library_id"], [F.col("captured_at").asc_nulls_first(), F.asc("key")]).rank("__rank", "__n")
    step, i = F.greatest(F.floor(F.col("__n") / n), F.lit(1)), F.col("__rank") - 1
    return rows.filter((i % step == 0) & (i < step * n)).drop("__rank", "__n")


def storage_situation(sample: DataFrame) -> DataFrame:
    """Per library: any evicted original, optimising; none, fullCopies. A library without a sample is undetermined."""
    return sample.groupBy("library_id").agg(F.when(F.count("evicted") == 0, F.lit("undetermined")).when(F.bool_or("evicted"), F.lit("optimising")).otherwise(F.lit("fullCopies")).alias("situation"))


def face_summary(detections: DataFrame) -> DataFrame:
    """Per asset the largest face (first of equals) and the least capture quality. ``detections(key, face, w, h, quality)``."""
    return detections.groupBy("key").agg(F.min(F.struct((-F.col("w") * F.col("h")).alias("a"), "face"))["face"].alias("largest_face"), F.min("quality").alias("face_capture_quality"))


def newest_first(assets: DataFrame) -> DataFrame:
    """Order for pages: capture date descending, missing last, then key. ``place`` is per library."""
    return Ranges(assets, ["library_id"], [F.col("captured_at").desc_nulls_last(), F.asc("key")]).rank("place")


def biggest_first(assets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Contained videos by size, then newest first."""
    rows = assets.filter(is_contained_video()).join(sizes, "key", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return Ranges(rows, ["library_id"], [F.desc("size"), F.col("captured_at").desc_nulls_last(), F.asc("key")]).rank("place")


def next_undecided(groups: DataFrame, k: int) -> DataFrame:
    """The first k pending groups of each library in deck order, with their ``rank``.

    The filter is a limit on the window, so each task keeps k groups of a library before anything is shuffled.
    """
    w = Window.partitionBy("library_id").orderBy(*deck_keys())
    return groups.filter("state = 'pending'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def category_filter(assets: DataFrame, category: str, groups: DataFrame | None = None) -> DataFrame:
    """all, failed, duplicates (needs groups), screenshots, recordings or videos."""
    if category == "duplicates":
        keys = groups.filter("kind = 'exactDuplicate'").select("library_id", F.explode("member_keys").alias("key"))
        return assets.join(keys, ["library_id", "key"], "left_semi")
    wanted = {
        "all": F.lit(True), "failed": F.coalesce(F.col("quality.tier") == "obviouslyBroken", F.lit(False)), "screenshots": F.col("is_screenshot"),
        "recordings": F.col("is_screen_recording"), "videos": is_contained_video(),
    }
    return assets.filter(wanted[category])


def review_filter(assets: DataFrame, decisions: DataFrame, what: str, groups: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """What a review list holds.

    sets: members of any group, whatever its state (needs groups). picks or marked: assets with that decision. videos: all
    contained videos, decided or not, biggest first (needs ``sizes(key, size)``; adds size and place).
    """
    if what == "sets":
        keys = groups.select("library_id", F.explode("member_keys").alias("key"))
        return assets.join(keys, ["library_id", "key"], "left_semi")
    if what == "videos":
        return biggest_first(assets, sizes)
    value = {"picks": "pick", "marked": "reject"}[what]
    return assets.join(decisions.filter(F.col("decision") == value).select("key"), "key", "left_semi")
