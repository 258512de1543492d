"""Substring dedup of words by recompression: remove each word covered by a window of ``length`` words that starts more than once.

Rounds of recompression rewrite every document: a maximal run of one symbol becomes a symbol, then every pair of a left and
a right symbol does; a hash bit of the name, drawn anew each round, says which side a symbol is on. A symbol's name is a
64-bit hash of what it stands for, so equal texts get equal names in every document without a table of names, and the
rounds need no shuffle. With each symbol goes the span of words that decided it (its own and the neighbours that were
looked at): wherever these words stand, the same symbol does.

So equal windows hold the same symbols among those that were decided inside. Each window takes one of them as its anchor:
of the highest level, and there the least hash. Neighbouring windows with the same anchor are a context. Spark counts the
anchors (named by all words that decided them) over all documents; contexts of an anchor that occurs once are dropped, and
so are those where neither the anchor with the words before it nor the one with the words after it recurs, as one of them
must in a repeated window. What is left shares high-level symbols with other places: equal contexts are one row with the
number of their places, and distinct ones of one anchor are compared window by window, on the words themselves. Anchors
with too many distinct contexts for one task are dealt anew with whole windows as anchors.

Edge cases: null and empty texts have no words; texts shorter than ``length`` lose nothing; repeats inside one document
count; repeated rows, null and equal ids count as places and each is reported; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.rolling import Spans, mix64
from gleanery.llm.suffix_dedup import merge_spans, packed
from gleanery.storage import Tables

#: Rounds of recompression; a symbol of the last one has about two words and was decided by about nine.
ROUNDS = 3
#: Bytes of texts rewritten at once; a longer text is rewritten alone.
CHUNK_BYTES = 1 << 18
#: Bytes of contexts in a shard, about, and distinct contexts of one anchor that may share one.
SHARD_BYTES, SHARD_CONTEXTS = 3 << 20, 4096

_A, _B, _ROUND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), 0x8EBC6AF09C88C6E3


class Symbols:
    """Symbols of one level in text order: name, and the span of words [low, high) that decided each.

    ``first`` and ``last`` are the bounds of the document of each symbol; a symbol that the edge of its document decided
    has a span beyond it.
    """

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.name, self.low, self.high, self.first, self.last = name, low, high, first, last

    def joined(self) -> np.ndarray:
        """Whether a symbol and its successor are of one document."""
        return self.first[1:] == self.first[:-1]

    def runs(self, salt: np.uint64) -> Symbols:
        """Maximal runs of one symbol as one; each is decided by its neighbours too, which are other symbols."""
        same = self.joined()
        head = np.concatenate(([True], (self.name[1:] != self.name[:-1]) | ~same))
        a = np.flatnonzero(head)
        b = np.append(a[1:], len(head)) - 1
        n = b - a + 1
        before, after = np.concatenate(([False], same))[a], np.append(same, False)[b]
        low = np.where(before, self.low[a - 1], self.first[a] - 1)
        high = np.where(after, self.high[np.minimum(b + 1, len(head) - 1)], self.last[a] + 1)
        name = self.name[a]
        long = n > 1
        name[long] = mix64(name[long] * _A + n[long].astype(np.uint64) * _B + salt)
        return Symbols(name, low, high, self.first[a], self.last[a])

    def pairs(self, salt: np.uint64) -> Symbols:
        """A left symbol and the right one after it as one; others stay, decided by the neighbour they did not join too."""
        same = self.joined()
        right = (mix64(self.name ^ salt) >> np.uint64(63)).astype(bool)
        joins = np.append(~right[:-1] & right[1:] & same, False)
        tail = np.concatenate(([False], joins[:-1]))
        after = np.append(np.where(same, self.high[1:], self.last[:-1] + 1), self.last[-1:] + 1)
        before = np.concatenate((self.first[:1] - 1, np.where(same, self.low[:-1], self.first[1:] - 1)))
        low = np.where(right & ~tail, before, self.low)
        high = np.where(~right, np.where(joins, np.append(self.high[1:], 0), after), self.high)
        name = self.name.copy()
        j = np.flatnonzero(joins)
        name[j] = mix64(self.name[j] * _A + mix64(self.name[j + 1] ^ salt) * _B)
        keep = ~tail
        return Symbols(name[keep], low[keep], high[keep], self.first[keep], self.last[keep])


def levels(words: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int) -> list[Symbols]:
    """The words as symbols, and the symbols after each round."""
    at = np.arange(len(words))
    out = [Symbols(words, at, at + 1, first, last)]
    for k in range(1, rounds + 1):
        salt = np.uint64(_ROUND * k % 2**64)
        out.append(out[-1].runs(salt).pairs(mix64(np.array([salt]))[0]))
    return out


def anchors(words: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of a window inside its document: the start, and the span of words that decided its anchor."""
    n = len(words)
    starts = np.flatnonzero(np.arange(n) + length <= last)
    low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    left = np.arange(len(starts))
    for level in reversed(levels(words, first, last, rounds)):
        if not len(left):
            break
        i = starts[left]
        # Spans grow with the place, so a window's symbols are neighbours: those from x to before y.
        x = np.searchsorted(level.low, i)
        y = np.searchsorted(level.high, i + length, "right")
        some = y > x
        x, y, here = x[some], y[some], left[some]
        best = np.zeros(len(x), np.int64)
        power = np.frexp((y - x).astype(np.float64))[1] - 1
        least = mix64(level.name) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(level.name), dtype=np.uint64)
        for k in range(int(power.max()) + 1 if len(power) else 0):
            at = np.flatnonzero(power == k)
            found = np.minimum(least[x[at]], least[y[at] - (1 << k)])
            best[at] = (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
            least = np.minimum(least[: max(0, len(least) - (1 << k))], least[1 << k :])
        low[here], high[here] = level.low[best], level.high[best]
        left = left[~some]
    return starts, low, high


def contexts(texts: list[list[bytes]], length: int, whole: bool) -> tuple[np.ndarray, ...] | None:
    """Contexts of documents given as words: document, first window, windows, anchor, anchor with the words before and after it, digest."""
    sizes = np.array([len(t) for t in texts])
    data = b" ".join([w for t in texts for w in t])
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], ends + 1)), np.append(ends, len(data))
    if sizes.sum() < length:
        return None
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first, last = begin[doc], (begin + sizes)[doc]
    spans = Spans(np.frombuffer(data, np.uint8))
    of = lambda a, b: spans.hash(starts[a], ends[b - 1])
    if whole:
        at = np.flatnonzero(np.arange(len(doc)) + length <= last)
        low, high = at, at + length
    else:
        at, low, high = anchors(of(np.arange(len(doc)), np.arange(len(doc)) + 1), first, last, length, ROUNDS)
    if not len(at):
        return None
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (doc[at[1:]] != doc[at[:-1]])))
    head = np.flatnonzero(new)
    a, low, high = at[head], low[head], high[head]
    windows = np.diff(np.append(head, len(at)))
    stop = a + windows + length - 1
    half = -(-(length - high + low) // 2)
    side = lambda ok, x, y: np.where(ok, of(np.where(ok, x, 0), np.where(ok, y, 1)) | np.uint64(1), np.uint64(0)).view(np.int64)
    digests = np.array([hashlib.sha256(data[x:y]).digest()[:16] for x, y in zip(starts[a].tolist(), ends[stop - 1].tolist(), strict=True)], "V16")
    return doc[a], a - first[a], windows, of(low, high).view(np.int64), side(low - half >= a, low - half, high), side(high + half <= stop, low, high + half), digests


_CONTEXTS = "doc_id long, kid long, a int, windows int, h long, left long, right long, c binary, repeats int, n long"


def find_contexts(docs: DataFrame, length: int, whole: bool) -> DataFrame:
    """Contexts of all of ``docs(doc_id, kid, raw, times)``; neighbours that are equal, as in a text of one repeated word, are one row."""

    def emit(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch | None:
        found = contexts(texts, length, whole)
        if found is None:
            return None
        doc, a, windows, h, left, right, c = found
        first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (a[1:] != a[:-1] + windows[:-1]))))
        repeats, pick = np.diff(np.append(first, len(h))), pa.array(doc[first])
        n = part.column("times").to_numpy()[doc[first]] * repeats
        ints = [pa.array(x[first], t) for x, t in ((a, pa.int32()), (windows, pa.int32()), (h, pa.int64()), (left, pa.int64()), (right, pa.int64()))]
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(np.ascontiguousarray(c[first]).tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pick), part.column("kid").take(pick), *ints, digests, pa.array(repeats, pa.int32()), pa.array(n, pa.int64())], names=["doc_id", "kid", "a", "windows", "h", "left", "right", "c", "repeats", "n"])

    def run(batches):
        for batch in batches:
            texts, first, size = [], 0, 0
            for i, t in enumerate(batch.column("raw")):
                raw = t.as_py()
                texts.append(raw.split())
                size += len(raw)
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    made = emit(batch.slice(first, i + 1 - first), texts)
                    if made is not None:
                        yield made
                    texts, first, size = [], i + 1, 0

    return docs.mapInArrow(run, _CONTEXTS)


def _context_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted(h, c, n, doc_id, kid, a, windows)`` with the words, read from one of their places: (h, c, n, bytes)."""
    lists = wanted.groupBy("kid", F.col("doc_id").alias("id")).agg(*(F.collect_list(x).alias(x) for x in ("h", "c", "n", "a", "windows")))

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("raw")):
                h, c, n, a, windows = (batch.column(x)[i].values for x in ("h", "c", "n", "a", "windows"))
                words, start = text.as_py().split(), a.to_numpy()
                cut = [b" ".join(words[x:y]) for x, y in zip(start.tolist(), (start + windows.to_numpy() + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([h, c, n, pa.array(cut, pa.binary())], names=["h", "c", "n", "bytes"])

    # The lists of a row are gathered in one order; no value is null.
    one = docs.join(lists, (docs["kid"] == lists["kid"]) & docs["doc_id"].eqNullSafe(lists["id"])).select("raw", "h", "c", "n", "a", "windows")
    return one.mapInArrow(run, "h long, c binary, n long, bytes binary").dropDuplicates(["h", "c"])


def repeated_windows(texts: list[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window) of the windows that occur more than once, ``times[i]`` being the places of the i-th text."""
    data = b" ".join(texts)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], ends + 1)), np.append(ends, len(data))
    sizes = np.array([t.count(b" ") + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.arange(len(owner)) + length <= (begin + sizes)[owner])
    hashes = Spans(np.frombuffer(data, np.uint8)).hash(starts[at], ends[at + length - 1])
    _, one, group = np.unique(hashes, return_index=True, return_inverse=True)
    twin = at[one[group]]
    # Windows that follow each other, as their twins do, are compared as one stretch.
    head = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(twin) != 1) | (owner[at[1:]] != owner[at[:-1]]))))
    tail = np.append(head[1:], len(at)) - 1
    exact = all(
        x == y or data[starts[x] : ends[x + k + length - 1]] == data[starts[y] : ends[y + k + length - 1]]
        for x, y, k in zip(at[head].tolist(), twin[head].tolist(), (tail - head).tolist(), strict=True)
    )
    if not exact:  # two different windows share a hash
        table: dict[bytes, int] = {}
        group = np.array([table.setdefault(data[starts[x] : ends[x + length - 1]], len(table)) for x in at.tolist()])
    often = np.bincount(group, np.minimum(times, 2)[owner[at]])[group] > 1
    found = at[often]
    owner = owner[found]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(found) != 1) | (np.diff(owner) != 0)))) if len(found) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(found)) - 1 if len(found) else cut
    return owner[cut], found[cut] - begin[owner[cut]], found[last] - begin[owner[cut]]


def _compared(rows: DataFrame, shards: int, length: int) -> DataFrame:
    """(h, c, s, e): repeated windows, first and last, of contexts with the same anchor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, s, e = repeated_windows([bytes(b) for b in pdf["bytes"]], pdf["n"].to_numpy(), length)
        return pd.DataFrame({"h": pdf["h"].to_numpy()[x], "c": pdf["c"].to_numpy()[x], "s": s, "e": e})

    return rows.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInPandas(run, "h long, c binary, s long, e long")


def _again(crowd: DataFrame, length: int, tables: Tables) -> DataFrame:
    """The same for anchors with too many contexts for a shard: every context is a text, and its windows are dealt one by one."""
    texts = crowd.select(F.col("h").alias("doc_id"), F.xxhash64("c").alias("kid"), F.col("bytes").alias("raw"), F.col("n").alias("times"), "c")
    found = repeated_spans(texts.drop("c"), length, tables, True).withColumnsRenamed({"kid": "k", "spans": "found"})
    rows = texts.join(found, (texts["kid"] == found["k"]) & (texts["doc_id"] == found["id"])).select(F.col("doc_id").alias("h"), "c", F.explode("found").alias("x"))
    return rows.select("h", "c", F.shiftright("x", 32).alias("s"), (F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)) - length).alias("e"))


def repeated_spans(docs: DataFrame, length: int, tables: Tables, whole: bool = False) -> DataFrame:
    """(kid, id, spans): word spans to remove from each text of ``docs(doc_id, kid, raw, times)`` that has any, unmerged; start << 32 | end."""
    every = tables.write(find_contexts(docs, length, whole), "lz4")  # mostly hashes, which no codec makes smaller
    often = every.groupBy("h").agg(F.sum("n").alias("k")).filter("k > 1").select("h")
    cand = tables.write(every.join(often, "h"))
    tables.drop(every)
    place = F.struct("kid", "doc_id", "a", "windows", "left", "right")
    # A side that a context doesn't hold is 0; names of sides are odd, so an even hash of the context stands for no other's.
    alone = lambda x: F.when(F.col(f"p.{x}") == 0, F.xxhash64("c").bitwiseAND(F.lit(-2))).otherwise(F.col(f"p.{x}")).alias(x)
    distinct = cand.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(place).alias("p"))
    distinct = tables.write(distinct.select("h", "c", "n", *(f"p.{x}" for x in ("kid", "doc_id", "a", "windows")), alone("left"), alone("right")))
    # All windows of a context with several places are repeats.
    edges = distinct.filter("n > 1").select("h", "c", F.lit(0).cast("long").alias("s"), (F.col("windows") - 1).cast("long").alias("e"))
    made = []
    if not whole:
        sides = [distinct.filter(F.col(x).bitwiseAND(F.lit(1)) == 1).groupBy(x).agg(F.sum("n").alias("k")).filter("k > 1").select(x, F.lit(True).alias(f"some_{x}")) for x in ("left", "right")]
        kept = distinct.join(sides[0], "left", "left").join(sides[1], "right", "left").filter("some_left or some_right")
        single = kept.groupBy("h").agg(F.count("*").alias("k"), F.max("n").alias("m")).filter("k > 1").select("h", "k")
        kept = kept.join(single, "h").select("h", "c", "n", "doc_id", "kid", "a", "windows")
        bytes_ = tables.write(_context_bytes(docs, kept, length))
        total = bytes_.agg(F.sum(F.length("bytes"))).first()[0] or 0
        crowded = tables.write(bytes_.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > SHARD_CONTEXTS).select("h"))
        made = [bytes_, crowded]
        some = not crowded.isEmpty()
        found = _compared(bytes_.join(crowded, "h", "left_anti") if some else bytes_, max(1, -(-total // SHARD_BYTES)), length)
        if some:
            found = found.union(_again(tables.write(bytes_.join(crowded, "h")), length, tables))
        edges = edges.union(found)
    edges = tables.write(edges)
    hits = cand.join(edges, ["h", "c"])
    first = F.col("a") + F.col("s")
    # Of contexts that follow each other and are equal, the whole is a repeat.
    more = F.when(F.col("repeats") > 1, F.col("windows") * (F.col("repeats") - 1)).otherwise(F.lit(0))
    start = F.when(more > 0, F.col("a")).otherwise(first).cast("long")
    end = (F.when(more > 0, F.col("a") + F.col("windows") + more - 1).otherwise(F.col("a") + F.col("e")) + length).cast("long")
    spans = tables.write(hits.groupBy("kid", F.col("doc_id").alias("id")).agg(F.collect_list(packed(start, end)).alias("spans")))
    tables.drop(cand, distinct, edges, *made)
    return spans


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept (the remaining words with one space between them), kept_sha256."""
    tables = Tables(docs.sparkSession, "recompression")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("kid"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.lit(1).cast("long").alias("times"))
    spans = repeated_spans(docs, length, tables)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cols: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept", "kept_sha256")}
                for raw, found in zip(part.column("raw").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = raw.split()
                    left, at = [], 0
                    for a, b in merge_spans(found or []):
                        left += words[at:a]
                        at = b
                    left += words[at:]
                    kept = b" ".join(left)
                    for c, v in zip(cols, (len(words), len(words) - len(left), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                        cols[c].append(v)
                text = pa.array(cols["kept"], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols["n_words"], pa.int64()), pa.array(cols["n_removed"], pa.int64()), text, pa.array(cols["kept_sha256"])], names=["doc_id", *cols])

    joined = docs.join(spans, (docs["kid"] == spans["kid"]) & docs["doc_id"].eqNullSafe(spans["id"]), "left").select(docs["doc_id"], "raw", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
