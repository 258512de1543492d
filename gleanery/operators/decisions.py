"""Decision tables: batches, marks and resolutions as joins on the long form of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.predicates import is_proposable


def fold_journal(journal: DataFrame) -> DataFrame:
    """The decisions that a journal (seq, key, value) leaves; the last write counts, a null value removes."""
    return journal.groupBy("key").agg(F.max_by("value", "seq").alias("decision")).filter("decision is not null")


def apply_batch(decisions: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions after, snapshot): ``unreviewed`` clears; the snapshot has what each updated key had before."""
    new = updates.select("key", F.col("decision").alias("__new"))
    rows = decisions.join(new, "key", "full_outer")
    after = rows.withColumn("decision", F.coalesce("__new", "decision")).filter("decision <> 'unreviewed'").select("key", "decision")
    snapshot = rows.filter("__new is not null").select("key", F.coalesce("decision", F.lit("unreviewed")).alias("decision"))
    return after, snapshot


def restore(decisions: DataFrame, snapshot: DataFrame) -> DataFrame:
    return apply_batch(decisions, snapshot)[0]


def long_form(groups: DataFrame, assets: DataFrame, decisions: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """One row per group and member: pos, flagged, decision, is_settled, deletable, proposable."""
    rows = groups.select("library_id", "group_id", "kind", "keeper", F.size("member_keys").alias("n"), F.posexplode("member_keys").alias("pos", "key"))
    # By a join: to search a group's flagged keys for each member is the square of its size.
    flagged = groups.select("group_id", F.explode("flagged").alias("key")).distinct().withColumn("is_flagged", F.lit(True))
    rows = rows.join(flagged, ["group_id", "key"], "left").withColumn("is_flagged", F.coalesce("is_flagged", F.lit(False)))
    info = assets.select("library_id", "key", (F.col("source_type") == "userLibrary").alias("deletable"), is_proposable().alias("proposable"))
    rows = rows.join(info, ["library_id", "key"], "left").join(decisions.select("key", "decision"), "key", "left")
    rows = rows.withColumn("decision", F.coalesce("decision", F.lit("unreviewed")))
    if settled is None:
        return rows.withColumn("is_settled", F.lit(False))
    return rows.join(settled.select("key", F.lit(True).alias("is_settled")), "key", "left").withColumn("is_settled", F.coalesce("is_settled", F.lit(False)))


def initial_mark() -> Column:
    """Flagged and neither picked nor settled, or rejected already."""
    return (F.col("is_flagged") & (F.col("decision") != "pick") & ~F.col("is_settled")) | (F.col("decision") == "reject")


def keep_one_mark(keeper: str = "keeper") -> Column:
    """Rejected already, or an unsettled proposable member that is neither the keeper nor a pick."""
    spared = F.col("is_settled") | (F.col("key") == F.col(keeper)) | (F.col("decision") == "pick")
    return (F.col("decision") == "reject") | (~spared & F.coalesce("proposable", F.lit(False)))


def propose_keep_one(rows: DataFrame) -> DataFrame:
    """Members of bursts and near-duplicate sets with a keeper, with ``marked``."""
    return rows.filter(F.col("kind").isin("burst", "nearDuplicate") & (F.col("n") > 1) & F.col("keeper").isNotNull()).withColumn("marked", keep_one_mark())


def reduce_to_one(rows: DataFrame) -> DataFrame:
    spared = (F.col("key") == F.col("keeper")) | (F.col("decision") == "pick")
    return rows.withColumn("marked", ~spared & F.coalesce("proposable", F.lit(False)))


def resolve(rows: DataFrame, mode: str) -> DataFrame:
    """Updates (key, decision) that closing each group makes; ``rows`` have ``marked``. Modes: keep, discard, resolve."""
    deletable, picked = F.coalesce("deletable", F.lit(False)), F.col("decision") == "pick"
    keeps_all = F.col("kind").isin("bracket", "session", "video")
    if mode == "resolve":
        reject = F.col("marked") & deletable & ~picked
    elif mode == "discard":
        reject = ~keeps_all & ((F.col("marked") & ~picked) | (~F.col("marked") & (F.col("n") == 1) & deletable))
    else:
        reject = F.lit(False)
    rows = rows.withColumn("rejected", reject)
    some = rows.groupBy("library_id", "group_id").agg(F.bool_or("rejected").alias("any_rejected"))
    rows = rows.join(some, ["library_id", "group_id"])
    clears = F.lit(True) if mode in ("keep", "resolve") else ~F.col("any_rejected")
    decision = F.when(F.col("rejected"), F.lit("reject")).when(clears & (F.col("decision") == "reject"), F.lit("unreviewed"))
    return rows.select("key", decision.alias("decision")).filter("decision is not null")


def keep_only(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Updates for ``chosen(group_id, chosen)``: it is picked, other proposable members are rejected, other picks cleared."""
    rows = rows.join(chosen, "group_id")
    own, d = F.col("key") == F.col("chosen"), F.col("decision")
    new = F.when(own, F.when(d != "pick", F.lit("pick"))).when(F.coalesce("proposable", F.lit(False)), F.when(d != "reject", F.lit("reject"))).when(d == "pick", F.lit("unreviewed"))
    return rows.select("key", new.alias("decision")).filter("decision is not null")


def set_keeper(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Updates that move a group's pick to ``chosen``."""
    rows = rows.join(chosen, "group_id")
    own, d = F.col("key") == F.col("chosen"), F.col("decision")
    new = F.when(own & (d != "pick"), F.lit("pick")).when(~own & (d == "pick"), F.lit("unreviewed"))
    return rows.select("key", new.alias("decision")).filter("decision is not null")


def mark_for_deletion(assets: DataFrame, decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Reject updates for chosen keys that exist and can be deleted; an explicit choice covers favourites and videos."""
    can = assets.filter(F.col("source_type") == "userLibrary").select("key")
    held = decisions.filter("decision = 'reject'").select("key")
    return keys.select("key").distinct().join(can, "key", "left_semi").join(held, "key", "left_anti").withColumn("decision", F.lit("reject"))


def clear_rejects(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    return decisions.filter("decision = 'reject'").join(keys.select("key"), "key", "left_semi").select("key", F.lit("unreviewed").alias("decision"))


def pick(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    held = decisions.filter("decision = 'pick'").select("key")
    return keys.select("key").distinct().join(held, "key", "left_anti").withColumn("decision", F.lit("pick"))


def remove_picks(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    return decisions.filter("decision = 'pick'").join(keys.select("key"), "key", "left_semi").select("key", F.lit("unreviewed").alias("decision"))


def deletion_candidates(assets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rejected keys whose asset exists and can be deleted, in key order."""
    rejects = decisions.filter("decision = 'reject'").select("key")
    return assets.filter(F.col("source_type") == "userLibrary").join(rejects, "key", "left_semi").select("library_id", "key").orderBy("key")


def commit_batch(candidates: DataFrame, live: DataFrame, decisions: DataFrame, date_us: int) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, decisions left): keys are checked once more against the live assets; nothing is deleted here."""
    still = deletion_candidates(live, candidates.select("key", F.lit("reject").alias("decision")))
    ledger = still.groupBy("library_id").agg(F.array_sort(F.collect_list("key")).alias("asset_keys")).withColumn("date_us", F.lit(date_us))
    return ledger, decisions.join(still.select("key"), "key", "left_anti")


def save_group_state(states: DataFrame, settled: DataFrame, updates: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, settled) after ``updates(group_id, state)``: members are settled with their group, or not if it is pending."""
    new_states = states.join(updates.select("group_id"), "group_id", "left_anti").unionByName(updates.select("group_id", "state"))
    touched = members.select("group_id", "key").join(updates, "group_id").groupBy("key").agg(F.max_by("state", "group_id").alias("state"))
    new_settled = settled.join(touched.select("key"), "key", "left_anti").unionByName(touched.filter("state <> 'pending'"))
    return new_states, new_settled


def start_over(states: DataFrame, settled: DataFrame, including_ignored: bool) -> tuple[DataFrame, DataFrame]:
    """What is left of states and settled members; decisions are all cleared."""
    keep = F.lit(False) if including_ignored else F.col("state") == "dismissed"
    return states.filter(keep), settled.filter(keep)


def carry_marks(old: DataFrame, groups: DataFrame) -> DataFrame:
    """Marks (group_id, marks) of groups that survived a rerun, clipped to their members."""
    return groups.join(old, "group_id").select("group_id", F.array_sort(F.array_intersect("marks", "member_keys")).alias("marks"))


def carry_cards(old: DataFrame, groups: DataFrame, fresh: DataFrame) -> DataFrame:
    """group_id, marks, suggestion, user_edited, deferred of the pending groups after a rerun.

    ``old(group_id, marks, suggestion, user_edited, deferred)`` are the cards before; a group that is among them keeps what
    it had, its marks clipped to its members; ``deferred`` is its place in the pile for later, or null, and survivors keep
    their order with gaps. Others take ``fresh(group_id, marks)`` and are neither suggested, edited nor deferred.
    """
    pending = groups.filter("state = 'pending'").select("group_id", "member_keys")
    rows = pending.join(old.withColumnRenamed("marks", "__old").withColumn("__had", F.lit(True)), "group_id", "left").join(fresh.select("group_id", F.col("marks").alias("__new")), "group_id", "left")
    none = F.array().cast("array<string>")
    kept = F.array_intersect(F.coalesce("__old", none), "member_keys")
    marks = F.array_sort(F.when(F.col("__had"), kept).otherwise(F.coalesce("__new", none)))
    return rows.select("group_id", marks.alias("marks"), "suggestion", F.coalesce("user_edited", F.lit(False)).alias("user_edited"), "deferred")
