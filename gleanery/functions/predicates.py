"""Predicates on an asset's columns; each is a Column, so Catalyst pushes and fuses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import US, GroupConfig

#: kind -> (deck rank, keeps all, proposes keep one, has a best shot, title)
KINDS = {
    "failedFrame": (0, False, False, False, "Failed frames"),
    "exactDuplicate": (1, False, False, False, "Exact copies"),
    "burst": (2, False, True, True, "Burst"),
    "expiredUtility": (3, False, False, False, "Old screen captures"),
    "nearDuplicate": (4, False, True, True, "Near duplicates"),
    "bracket": (5, True, False, False, "Exposure bracket"),
    "versions": (5, False, False, True, "Original and edit"),
    "session": (6, True, False, False, "Session"),
    "video": (7, True, False, False, "Video"),
}


def is_deletable(source: str = "source_type") -> Column:
    return F.col(source) == "userLibrary"


def is_proposable() -> Column:
    return is_deletable() & ~F.col("is_favorite")


def is_expired_utility() -> Column:
    return F.col("is_screenshot") | F.col("is_screen_recording")


def is_contained_video() -> Column:
    return (F.col("media_type") == "video") & ~F.col("is_screen_recording")


def usable_us(config: GroupConfig = GroupConfig(), date: str = "captured_at") -> Column:
    """Micros of a capture date that can be trusted, else null."""
    us = F.unix_micros(F.col(date))
    return F.when(us > config.usable_after * US, us)


def is_reviewed(decision: str = "decision") -> Column:
    return F.col(decision) != "unreviewed"


def quality_is_bad(tier: str = "quality.tier") -> Column:
    return F.coalesce(F.col(tier) != "ok", F.lit(False))


def quality_is_exposure_based(reasons: str = "quality.reasons") -> Column:
    words = ("blown out", "black", "clipped")
    return F.coalesce(F.exists(reasons, lambda r: r.contains(words[0]) | r.contains(words[1]) | r.contains(words[2])), F.lit(False))


def is_soft() -> Column:
    return quality_is_bad() & ~quality_is_exposure_based()


def prints_comparable(a: str, b: str) -> Column:
    return (F.col(f"{a}.revision") == F.col(f"{b}.revision")) & (F.col(f"{a}.crop") == F.col(f"{b}.crop"))


def strip_key_prefix(key: str = "key", prefix: str = "photos:") -> Column:
    """Drops as many characters as the prefix has; every key has it."""
    return F.substr(F.col(key), F.lit(len(prefix) + 1))


def kind_traits(spark: SparkSession) -> DataFrame:
    """Nine rows: kind, deck_rank, keeps_all, proposes_keep_one, has_best_shot, title."""
    return spark.createDataFrame([(k, *v) for k, v in KINDS.items()], "kind string, deck_rank int, keeps_all boolean, proposes_keep_one boolean, has_best_shot boolean, title string")


def deck_rank(kind: str = "kind") -> Column:
    out = F.lit(None).cast("int")
    for k, v in KINDS.items():
        out = F.when(F.col(kind) == k, F.lit(v[0])).otherwise(out)
    return out
