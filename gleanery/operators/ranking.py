"""Ranking inside a group: five rungs as columns of one window pass; the first that fits the whole group counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.predicates import quality_is_bad
from gleanery.functions.scalars import confidence, exposure_score


# Reasons of a rank.
SHARPEST, EXPOSED, FACE, LOOKS = "Sharpest subject", "Best exposed", "Best face", "Strongest composition"
EDITED, UNEDITED, KEEP_ALL, UNUSABLE = "Edited version", "Unedited original", "Keep all", "Unusable"
USER_PICK, AUTO_PICK = "Picked by you at capture", "Picked at capture"


#: From members (group_id, kind, pos, ...asset columns) to scores (group_id, kind, key, pos, total, reasons, confidence).
Ranker = Callable[[DataFrame], DataFrame]


def min_max(value: Column, w) -> Column:
    """(v - min) / (max - min) over the group; 1 where all are equal."""
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.lit(1.0))


def rank_members(members: DataFrame) -> DataFrame:
    """group_id, key, pos, total, reasons, confidence.

    ``members(group_id, kind, pos, ...asset columns)``. A group is one partition of the window, as large as the group.
    """
    w = Window.partitionBy("group_id")
    n = F.count("*").over(w)
    user, auto = F.col("is_burst_user_pick"), F.col("is_burst_auto_pick")
    any_user, any_auto = F.bool_or(user).over(w), F.bool_or(auto).over(w)
    sharp, light = F.coalesce("quality.metrics.subject_sharpness", F.lit(-1.0)), exposure_score()
    picked = F.when(any_user, user).otherwise(auto)
    face, looks = F.col("face_capture_quality"), F.col("aesthetics_score")
    all_have = lambda c: F.count(c).over(w) == n
    top = lambda c: c == F.max(c).over(w)
    one = lambda cond, text: F.array_compact(F.array(F.when(cond, F.lit(text))))
    best_sharp, best_light = (sharp >= 0) & top(sharp), (light >= 0) & top(light)
    bad = F.when(quality_is_bad(), F.coalesce(F.try_element_at("quality.reasons", F.lit(1)), F.lit(UNUSABLE)))
    measured = F.array_compact(F.array(F.when(best_sharp, F.lit(SHARPEST)).when(best_light, F.lit(EXPOSED)), bad))
    none = F.array().cast("array<string>")
    k = F.col("kind")
    rungs = [
        (n == 1, F.lit(1.0), none),
        (k == "versions", F.col("is_edited_version").cast("double"), F.array(F.when(F.col("is_edited_version"), F.lit(EDITED)).otherwise(F.lit(UNEDITED)))),
        (k == "bracket", F.lit(1.0), F.array(F.lit(KEEP_ALL))),
        (any_user | any_auto, picked.cast("double"), F.when(picked, F.array(F.when(any_user, F.lit(USER_PICK)).otherwise(F.lit(AUTO_PICK)))).otherwise(none)),
        (all_have(face), min_max(face, w), one(top(face), FACE)),
        (all_have(looks), min_max(looks, w), one(top(looks), LOOKS)),
    ]
    total, reasons = 0.7 * min_max(sharp, w) + 0.3 * min_max(light, w), measured
    for fits, t, r in reversed(rungs):
        total, reasons = F.when(fits, t).otherwise(total), F.when(fits, r).otherwise(reasons)
    return members.select("group_id", "kind", "key", "pos", total.alias("total"), reasons.alias("reasons"), confidence(F.col("scored_from_stand_in")).alias("confidence"))


def top_candidates(scores: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """All within the tolerance of a group's best; ties are reported, not broken."""
    best = F.max("total").over(Window.partitionBy("group_id"))
    return scores.withColumn("best", best).filter(F.col("total") >= F.col("best") * (1 - tolerance)).drop("best")


def best_of(scores: DataFrame) -> DataFrame:
    """The highest total of a group; ties go to the earliest member."""
    best = scores.groupBy("group_id").agg(F.min(F.struct((-F.col("total")).alias("t"), "pos", "key")).alias("b"))
    return best.select("group_id", "b.key", (-F.col("b.t")).alias("total"))


def suggest(members: DataFrame, ranker: Ranker = rank_members) -> DataFrame:
    """group_id, key: the best shot of every group of several members, by any ranker."""
    w = Window.partitionBy("group_id")
    several = members.withColumn("__n", F.count("*").over(w)).filter("__n > 1").drop("__n")
    return best_of(ranker(several)).select("group_id", "key")


def rank_tiers(scores: DataFrame, has_best_shot: Column) -> DataFrame:
    """best, good (from 0.5) or weaker, in groups of several members whose kind has a best shot; else null."""
    w = Window.partitionBy("group_id")
    place = F.row_number().over(w.orderBy(F.desc("total"), "pos"))
    tier = F.when(place == 1, F.lit("best")).when(F.col("total") >= 0.5, F.lit("good")).otherwise(F.lit("weaker"))
    return scores.withColumn("tier", F.when((F.count("*").over(w) > 1) & has_best_shot, tier))


def keeper(groups: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """group_id, keeper: the first picked member, else the suggestion, else the best score."""
    long = groups.select("group_id", F.posexplode("member_keys").alias("pos", "key")).join(decisions, "key")
    picks = long.filter("decision = 'pick'").groupBy("group_id").agg(F.min_by("key", "pos").alias("picked"))
    best = best_of(scores).select("group_id", F.col("key").alias("scored"))
    rows = groups.select("group_id", F.col("keeper").alias("suggested")).join(picks, "group_id", "left").join(best, "group_id", "left")
    return rows.select("group_id", F.coalesce("picked", "suggested", "scored").alias("keeper"))


def set_order(scores: DataFrame) -> DataFrame:
    """Position in a set's page: the best first, then by score, then by member order."""
    w = Window.partitionBy("group_id").orderBy(F.desc("total"), "pos")
    return scores.withColumn("place", F.row_number().over(w))


def review_order(members: DataFrame, keepers: DataFrame) -> DataFrame:
    """Position in a review: the keeper first, the rest in member order."""
    rows = members.join(keepers.select("group_id", F.col("keeper").alias("__keeper")), "group_id", "left")
    w = Window.partitionBy("group_id").orderBy(F.desc(F.coalesce(F.col("key") == F.col("__keeper"), F.lit(False))), "pos")
    return rows.withColumn("place", F.row_number().over(w)).drop("__keeper")
