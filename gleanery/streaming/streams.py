"""Incremental forms: Structured Streaming over files of changes, decisions and analysis results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.config import US, GroupConfig
from gleanery.operators.live import LiveLibrary, newest
from gleanery.sources.ledgers import FOLD_AFTER, Journal, Ledger


def stream_assets(spark: SparkSession, path: str, schema, delay: str = "1 day") -> DataFrame:
    """New versions of assets, each (key, modification_date) once within the delay."""
    changes = spark.readStream.schema(schema).parquet(path).withWatermark("modification_date", delay)
    return changes.dropDuplicatesWithinWatermark(["key", "modification_date"])


def stream_sessions(assets: DataFrame, config: GroupConfig = GroupConfig(), delay: str = "1 hour") -> DataFrame:
    """Closed capture sessions per library: start, end of the last capture, n. Rows exactly a gap apart stay together."""
    gap = f"{int(config.session_gap * US)} microseconds"
    dated = assets.filter(F.unix_seconds("captured_at") > config.usable_after).withWatermark("captured_at", delay)
    grouped = dated.groupBy("library_id", F.session_window("captured_at", gap).alias("w"))
    return grouped.agg(F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"), F.count("*").alias("n")).drop("w")


def stream_candidate_pairs(assets: DataFrame, config: GroupConfig = GroupConfig(), delay: str = "1 hour") -> DataFrame:
    """Pairs of captures within the window, as either side arrives; both sides are watermarked, so state is bounded."""
    rows = assets.filter(F.unix_seconds("captured_at") > config.usable_after).select("library_id", "key", "captured_at").withWatermark("captured_at", delay)
    side = lambda x: rows.select(F.col("library_id").alias(f"library_{x}"), F.col("key").alias(f"key_{x}"), F.col("captured_at").alias(f"at_{x}"))
    a, b = side("a"), side("b")
    window = F.expr(f"INTERVAL {int(config.pair_window)} SECONDS")
    near = (F.col("library_a") == F.col("library_b")) & (F.col("at_b") >= F.col("at_a")) & (F.col("at_b") <= F.col("at_a") + window)
    ordered = (F.col("at_b") > F.col("at_a")) | (F.col("key_a") < F.col("key_b"))
    gap = F.unix_micros("at_b") - F.unix_micros("at_a")
    return a.join(b, near & ordered).select(F.col("library_a").alias("library_id"), "key_a", "key_b", gap.alias("gap_us"))


def stream_decisions(journal: DataFrame) -> DataFrame:
    """Latest decision per key of ``journal(seq, key, value)``, for update mode; a null value removes."""
    return journal.groupBy("key").agg(F.max_by("value", "seq").alias("decision"), F.max("seq").alias("seq"))


def keep_snapshot(journal: DataFrame, path: str, checkpoint: str, fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """Append each batch of ``journal(seq, key, value)`` to a ``Journal``, which folds itself; a repeated batch adds nothing."""
    kept = Journal(journal.sparkSession, path, fold_after)

    def put(batch: DataFrame, number: int) -> None:
        kept.append(batch, number, source=checkpoint)

    return journal.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return Journal(spark, path).read()


def debounce_changes(changes: DataFrame, quiet: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """One row per library and burst of ``changes(library_id, ts)``, once it has been quiet."""
    grouped = changes.withWatermark("ts", delay).groupBy("library_id", F.session_window("ts", quiet).alias("w"))
    return grouped.agg(F.count("*").alias("changes"), F.max("ts").alias("last_at")).drop("w")


def incremental_analysis(changes: DataFrame, library: LiveLibrary, checkpoint: str, renditions: Callable[[], DataFrame] | None = None, deleted: str = "is_deleted") -> StreamingQuery:
    """Keep ``library`` up to date with a stream of changed assets: each micro-batch is analysed, merged and regrouped.

    A row whose ``deleted`` column is true takes its asset away. ``renditions`` gives what can be measured at the time.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = newest(batch)
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted in batch.columns else F.lit(False)
        library.apply(last.filter(~gone).drop(deleted), last.filter(gone).select("key"), renditions() if renditions else None, number)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def stream_ledger(ledger: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Deletion batches of ``ledger(date_us, asset_keys)`` as they come, each once."""
    return stream_pending_deletions(ledger, path, checkpoint, lambda _: None, lambda: 0)


def stream_pending_deletions(ledger: DataFrame, path: str, checkpoint: str, show: Callable[[DataFrame], None], now_us: Callable[[], int], days: int = 30) -> StreamingQuery:
    """Keep the figure of pending deletions live: each batch of ``ledger(date_us, asset_keys)`` is written, then the report runs anew.

    A repeated batch is known by its number and checkpoint, so nothing is counted twice.
    """
    kept = Ledger(ledger.sparkSession, path)

    def run(batch: DataFrame, number: int) -> None:
        kept.append(f"{checkpoint}:{number}", batch)
        show(kept.pending(now_us(), days))

    return ledger.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def read_pending(spark: SparkSession, path: str, now_us: int, days: int = 30) -> DataFrame:
    """What is pending at ``now_us``; it also changes without new batches, as old ones expire."""
    return Ledger(spark, path).pending(now_us, days)
