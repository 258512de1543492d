"""The decision journal and the ledger of deletions: kept between runs, read whole, written once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import reports
from gleanery.operators.decisions import commit_batch
from gleanery.storage import Versions

#: Fixed value: entries of the journal's tail that are tolerated before it is folded.
FOLD_AFTER = 2_000
#: Parts of a tail that are tolerated, however small they are.
MOST_PARTS = 50


class Journal:
    """Decisions as a snapshot and a tail of entries (seq, key, value); the last seq counts, a null value removes.

    A batch appends a part to the tail; past ``fold_after`` entries the tail goes into the snapshot. Either is one new
    state, so readers never see half of it, and the number of files is bounded. A batch has a source and a number that
    grows; one that was applied before changes nothing. Entries come in the order of seq, up to those of one tail.
    """

    SCHEMA = "seq long, key string, value string"

    def __init__(self, spark: SparkSession, path: str, fold_after: int = FOLD_AFTER):
        self.versions, self.fold_after = Versions(spark, path), fold_after

    def append(self, entries: DataFrame, batch: int, source: str = "stream") -> bool:
        """Whether the batch was new."""
        number, state = self.versions.latest()
        if batch <= state.get("batches", {}).get(source, -1):
            return False
        part = self.versions.put(entries.select(F.col("seq").cast("long"), F.col("key").cast("string"), F.col("value").cast("string")))
        n = self.versions.get([part], self.SCHEMA).count()
        tail = [*state.get("tail", []), {"part": part, "n": n}]
        state = state | {"tail": tail, "batches": state.get("batches", {}) | {source: batch}}
        self.versions.commit(number, state)
        if sum(x["n"] for x in tail) >= self.fold_after or len(tail) >= MOST_PARTS:
            self.fold()
        return True

    def _entries(self, state: dict) -> DataFrame:
        parts = [x["part"] for x in state.get("tail", [])] + ([state["snapshot"]] if state.get("snapshot") else [])
        rows = self.versions.get(parts, self.SCHEMA)
        return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")).filter("value is not null")

    def fold(self) -> None:
        number, state = self.versions.latest()
        if state.get("tail"):
            snapshot = self.versions.put(self._entries(state).select("seq", "key", "value"))
            self.versions.commit(number, state | {"snapshot": snapshot, "tail": []})

    def read(self) -> DataFrame:
        """(key, decision) as of the newest state."""
        return self._entries(self.versions.latest()[1]).select("key", F.col("value").alias("decision"))


class Ledger:
    """Batches of deleted keys (date_us, asset_keys), each once: an id that is there already is not written again.

    Parts are folded into one past ``MOST_PARTS``; the rows carry their batch, so an id is known for ever.
    """

    SCHEMA = "batch string, library_id string, date_us long, asset_keys array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path)

    def read(self, batch: str | None = None) -> DataFrame:
        rows = self.versions.get([x["part"] for x in self.versions.latest()[1].get("parts", [])], self.SCHEMA)
        return rows if batch is None else rows.filter(F.col("batch") == batch)

    def append(self, batch: str, rows: DataFrame) -> bool:
        """Whether the batch was new; an empty one leaves no trace."""
        number, state = self.versions.latest()
        parts = state.get("parts", [])
        if any(batch == x["batch"] for x in parts) or not self.read(batch).isEmpty():
            return False
        library = F.col("library_id") if "library_id" in rows.columns else F.lit(None).cast("string")
        part = self.versions.put(rows.select(F.lit(batch).alias("batch"), library.alias("library_id"), F.col("date_us").cast("long"), "asset_keys"))
        parts = [*parts, {"batch": batch, "part": part}]
        if len(parts) > MOST_PARTS:
            parts = [{"batch": None, "part": self.versions.put(self.versions.get([x["part"] for x in parts], self.SCHEMA))}]
        self.versions.commit(number, {"parts": parts})
        return True

    def pending(self, now_us: int, days: int = 30) -> DataFrame:
        return reports.pending_deletions(self.read(), now_us, days)

    def total(self) -> DataFrame:
        return reports.total_deleted(self.read())

    def prune(self, now_us: int, days: int = 30) -> None:
        """Forget the batches that are older than the retention, and with them their ids."""
        number, _ = self.versions.latest()
        part = self.versions.put(reports.prune_deletions(self.read(), now_us, days))
        self.versions.commit(number, {"parts": [{"batch": None, "part": part}]})


def commit_deletions(ledger: Ledger, journal: Journal, batch: int, candidates: DataFrame, live: DataFrame, date_us: int, seq: int) -> bool:
    """Record a batch of deletions and clear their decisions; whether it was new.

    The keys are checked against the live assets and recorded first. What is cleared are the keys that the ledger has for
    this batch, at ``seq``: a run that is repeated, or that died between the two steps, clears the same keys, and no
    decision made since.
    """
    rows, _ = commit_batch(candidates, live, journal.read(), date_us)
    new = ledger.append(f"commit-{batch}", rows)
    cleared = ledger.read(f"commit-{batch}").select(F.explode("asset_keys").alias("key"))
    journal.append(cleared.select(F.lit(seq).alias("seq"), "key", F.lit(None).cast("string").alias("value")), batch, "commit")
    return new
