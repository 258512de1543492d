"""Exact substring dedup: remove each byte covered by a string of ``length`` bytes that starts more than once.

The corpus is dealt to independent suffix problems first. Every window of ``length`` bytes picks the least hash of its
32-byte grams; equal windows pick equal grams, so occurrences of a window meet under one anchor. A run of windows with
the same anchor is a context. A context is dropped if its anchor occurs once, or if it occurs once and neither the anchor
with the bytes before it nor the one with the bytes after it recurs (one of them must, in a repeat). The others are dealt to shards of a
few MB by anchor, each distinct context once, with the number of its occurrences (equal contexts by SHA-256). An anchor
with too many distinct contexts for a shard is dealt anew, its contexts cut by longer grams; the last grams are whole
windows, of which every one is distinct.

In a shard, threshold-bounded interval expansion finds all repeats: suffixes are ordered by their first ``length`` bytes,
and a breadth-first backward extension on the Burrows-Wheeler transform sets common prefix values in increasing order; it
stops at ``length``. The suffixes between two set values are an interval that shares ``length`` bytes; it is a repeat if its
contexts occur more than once in sum. Values below ``FIRST`` are read off the sort keys, which gives the first intervals.

Edge cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; a repeat inside one document
counts; repeated rows, null and equal ids count as occurrences and each is reported; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.rolling import Spans
from gleanery.storage import Tables

#: Bytes of the grams that deal windows, and of those that deal an anchor with too many contexts again.
GRAM, LONGER = 32, 128
#: Bytes of contexts in a shard, about, and distinct contexts of one anchor that may share one.
SHARD_BYTES, SHARD_CONTEXTS = 3 << 20, 4096
#: Bytes of contexts in one suffix problem; a shard is several, of whole anchors. Positions fit in POSITION_BITS.
PROBLEM_BYTES, POSITION_BITS = 1 << 20, 21
#: Symbols in the first sort key.
FIRST = 5
#: Bytes of texts hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 18
#: What ends a context in a suffix problem; no byte of UTF-8.
STOP = 0xFF


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in texts that start at ``at[:-1]`` of ``data``: text, start, windows, anchor, anchor with what is before and after it.

    The last two are 0 where the run does not hold that much: of a window's bytes beside its anchor, half must be on one side.
    """
    n, empty = len(data), np.zeros(0, np.int64)
    if n < length:
        return (empty,) * 6
    spans = Spans(data)
    hashes = spans.grams(gram)
    if gram < length:
        keyed = hashes & np.uint64(0xFFFFFFFF00000000)
        keyed |= np.arange(len(hashes), dtype=np.uint64)
        anchor = sliding_min(keyed, length - gram + 1).astype(np.uint32).astype(np.int64)  # its low half is the place
    else:
        anchor = np.arange(len(hashes))
    valid = np.zeros(len(anchor), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        valid[a : max(a, b - length + 1)] = True
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    text = np.searchsorted(at, a, "right") - 1
    p, half = anchor[a], (length - gram + 1) // 2
    before, after = p - half >= a, p + gram + half <= b + length
    side = lambda ok, start: np.where(ok, spans.hash(np.where(ok, start, 0), np.where(ok, start + gram + half, 0)) | np.uint64(1), np.uint64(0)).view(np.int64)
    return text, a - at[text], b - a + 1, hashes[p].view(np.int64), side(before, p - half), side(after, p)


def runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchored_runs of all of ``docs(doc_id, kid, raw, times)``, with c, a digest of the run's bytes.

    Neighbouring runs of equal bytes, as in a text of one repeated byte, are one row; its ``n`` counts all, in all copies.
    """

    def emit(part: pa.RecordBatch, raw: list[bytes]) -> pa.RecordBatch:
        at, data = np.concatenate(([0], np.cumsum([len(r) for r in raw]))), b"".join(raw)
        text, a, windows, h, left, right = anchored_runs(np.frombuffer(data, np.uint8), at, length, gram)
        begin = at[text] + a
        digests = [hashlib.sha256(data[x:y]).digest()[:16] for x, y in zip(begin.tolist(), (begin + windows - 1 + length).tolist(), strict=True)]
        c = np.array(digests, "V16") if digests else np.zeros(0, "V16")
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (begin[1:] != begin[:-1] + windows[:-1]) | (text[1:] != text[:-1]) | (c[1:] != c[:-1])))) if len(h) else np.zeros(0, np.int64)
        repeats, pick = np.diff(np.append(first, len(h))), pa.array(text[first])
        n = part.column("times").to_numpy()[text[first]] * repeats
        ints = [pa.array(x[first]) for x in (a, windows, h, left, right)]
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pick), part.column("kid").take(pick), *ints, pa.array([digests[i] for i in first.tolist()], pa.binary()), pa.array(repeats), pa.array(n, pa.int64())], names=["doc_id", "kid", "a", "windows", "h", "left", "right", "c", "repeats", "n"])

    def run(batches):
        for batch in batches:
            raw, first, size = [], 0, 0
            for i, t in enumerate(batch.column("raw")):
                raw.append(t.as_py())
                size += len(raw[-1])
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    yield emit(batch.slice(first, i + 1 - first), raw)
                    raw, first, size = [], i + 1, 0

    return docs.mapInArrow(run, "doc_id long, kid long, a long, windows long, h long, left long, right long, c binary, repeats long, n long")


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of ``symbols`` (bytes) ordered by their first ``depth`` symbols, by prefix doubling of what is tied; and the first keys in order."""
    n, low = len(symbols), np.uint64((1 << POSITION_BITS) - 1)
    shift, wide, place = np.uint64(POSITION_BITS), np.uint64(2 * POSITION_BITS), np.arange(n, dtype=np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        key = (key << np.uint64(8)) | np.roll(symbols, -k)
    key = (key << shift) | place
    key.sort()
    order = (key & low).astype(np.int64)
    first = key >> shift
    head = np.concatenate(([True], first[1:] != first[:-1]))
    rank = np.empty(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(head, place, np.uint64(0)))
    known = FIRST
    while known < depth:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        p = order[tied]
        later = p + known
        later[later >= n] %= n
        key = (rank[p] << wide) | (rank[later] << shift) | p.astype(np.uint64)
        key.sort()
        p = (key & low).astype(np.int64)
        key >>= shift
        order[tied] = p
        split = np.concatenate(([True], key[1:] != key[:-1]))
        head[tied] = split
        rank[p] = tied[np.maximum.accumulate(np.where(split, np.arange(len(p)), 0))]
        known *= 2
    return order, first


def shared_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rotations, and the common prefix of each with the one before it; -1 for ``length`` or more.

    By bounded interval expansion from the intervals of FIRST symbols whose end has the value FIRST - 1.
    """
    n = len(symbols)
    order, keys = suffix_order(symbols, length)
    before = symbols[order - 1]
    back = np.argsort(before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[back] = np.arange(n)
    first = before[back]
    prefix = np.full(n + 1, -1, np.int16)
    prefix[0] = prefix[n] = 0
    equal = FIRST - 1 - (np.frexp((keys[1:] ^ keys[:-1]).astype(np.float64))[1] - 1) // 8
    prefix[1:n] = np.where(equal < min(FIRST, length), equal, -1)
    ends = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) + 1
    low, high = np.concatenate(([0], ends[:-1])), ends
    fresh = prefix[high] == FIRST - 1
    low, high = low[fresh], high[fresh]
    for common in range(FIRST, length):
        if not len(low):
            break
        sizes = high - low
        each = np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        each += np.arange(len(each))
        key = (lf[each] << 32) | np.repeat(np.arange(len(low)), sizes)
        key.sort()
        to = key >> 32
        lead = first[to]
        at = np.flatnonzero(np.concatenate(([True], (key[1:] - key[:-1] != 1 << 32) | (lead[1:] != lead[:-1]))))
        low, high = to[at], np.append(to[at[1:] - 1], to[-1]) + 1
        fresh = prefix[high] < 0
        low, high = low[fresh], high[fresh]
        prefix[high] = common
    return order, prefix


def repeats_in_contexts(contexts: list[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, last window) of the windows that occur more than once, ``times[i]`` being the occurrences of the i-th context."""
    symbols = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    order, prefix = shared_prefixes(symbols, length)
    starts = np.flatnonzero(prefix[:-1] >= 0)
    often = np.add.reduceat(np.minimum(times, 2)[owner[order]], starts) > 1
    found = np.sort(order[np.repeat(often, np.diff(np.append(starts, len(order))))])
    found = found[found + length <= ends[owner[found]]]
    owner = owner[found]
    cut = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1] + 1) | (owner[1:] != owner[:-1])))) if len(found) else np.zeros(0, np.int64)
    last = np.append(cut[1:] - 1, len(found) - 1) if len(found) else cut
    start = ends - sizes
    return owner[cut], found[cut] - start[owner[cut]], found[last] - start[owner[cut]]


def _context_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted(h, c, n, doc_id, kid, a, windows)`` with the bytes, read from one of their places: (h, c, n, bytes)."""
    lists = wanted.groupBy("kid", F.col("doc_id").alias("id")).agg(*(F.collect_list(x).alias(x) for x in ("h", "c", "n", "a", "windows")))

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("raw")):
                h, c, n, a, windows = (batch.column(x)[i].values for x in ("h", "c", "n", "a", "windows"))
                raw, start = text.as_py(), a.to_numpy()
                cut = [raw[x:y] for x, y in zip(start.tolist(), (start + windows.to_numpy() - 1 + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([h, c, n, pa.array(cut, pa.binary())], names=["h", "c", "n", "bytes"])

    # The lists of a row are gathered in one order; no value is null.
    one = docs.join(lists, (docs["kid"] == lists["kid"]) & docs["doc_id"].eqNullSafe(lists["id"])).select("raw", "h", "c", "n", "a", "windows")
    return one.mapInArrow(run, "h long, c binary, n long, bytes binary").dropDuplicates(["h", "c"])


def _by_expansion(contexts: DataFrame, shards: int, length: int) -> DataFrame:
    """(h, c, s, e): repeated windows of the contexts, shard by shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        h, n, rows, c = pdf["h"].to_numpy(), pdf["n"].to_numpy(), [bytes(b) for b in pdf["bytes"]], pdf["c"].to_numpy()
        size = np.cumsum([len(b) + 1 for b in rows])
        anchors = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h)).tolist()
        out, begin = [], 0
        for k in range(1, len(anchors)):
            last = k == len(anchors) - 1
            if last or size[anchors[k + 1] - 1] - (size[begin - 1] if begin else 0) > PROBLEM_BYTES:
                end = anchors[k]
                x, s, e = repeats_in_contexts(rows[begin:end], n[begin:end], length)
                out.append(pd.DataFrame({"h": h[begin:end][x], "c": c[begin:end][x], "s": s, "e": e}))
                begin = end
        return pd.concat(out)

    return contexts.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInPandas(run, "h long, c binary, s long, e long")


def _again(crowd: DataFrame, length: int, tables: Tables, gram: int) -> DataFrame:
    """The same for anchors with too many contexts for a shard: their contexts are dealt by longer grams."""
    docs = crowd.select(F.col("h").alias("doc_id"), F.xxhash64("c").alias("kid"), F.col("bytes").alias("raw"), F.col("n").alias("times"), "c")
    found = repeated_spans(docs.drop("c"), length, tables, gram).withColumnsRenamed({"kid": "k", "spans": "found"})
    rows = docs.join(found, (docs["kid"] == found["k"]) & (docs["doc_id"] == found["id"])).select(F.col("doc_id").alias("h"), "c", F.explode("found").alias("x"))
    return rows.select("h", "c", F.shiftright("x", 32).alias("s"), (F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)) - length).alias("e"))


def packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 32).bitwiseOR(b)


def repeated_spans(docs: DataFrame, length: int, tables: Tables, gram: int = GRAM) -> DataFrame:
    """(kid, id, spans): byte spans to remove from each text of ``docs(doc_id, kid, raw, times)`` that has any, unmerged; start << 32 | end."""
    every = tables.write(runs(docs, length, gram), "lz4")  # mostly hashes, which no codec makes smaller
    often = every.groupBy("h").agg(F.sum("n").alias("k")).filter("k > 1").select("h")
    cand = tables.write(every.join(often, "h"))
    tables.drop(every)
    place = F.struct("kid", "doc_id", "a", "windows", "left", "right")
    contexts = tables.write(cand.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(place).alias("p")).select("h", "c", "n", "p.*"))
    sides = [contexts.filter(F.col(x) != 0).groupBy(x).agg(F.sum("n").alias("k")).filter("k > 1").select(x, F.lit(True).alias(f"some_{x}")) for x in ("left", "right")]
    kept = contexts.join(sides[0], "left", "left").join(sides[1], "right", "left").filter("n > 1 or some_left or some_right")
    bytes_ = tables.write(_context_bytes(docs, kept.select("h", "c", "n", "doc_id", "kid", "a", "windows"), length))
    total = bytes_.agg(F.sum(F.length("bytes"))).first()[0] or 0
    crowded = tables.write(bytes_.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > SHARD_CONTEXTS).select("h")) if gram < length else None
    some = crowded is not None and not crowded.isEmpty()
    edges = _by_expansion(bytes_.join(crowded, "h", "left_anti") if some else bytes_, max(1, -(-total // SHARD_BYTES)), length)
    if some:
        edges = edges.union(_again(tables.write(bytes_.join(crowded, "h")), length, tables, LONGER if gram < LONGER < length else length))
    edges = tables.write(edges)
    found = cand.join(edges, ["h", "c"])
    first, step = F.col("a") + F.col("s"), F.when(F.col("repeats") > 1, F.col("windows") * (F.col("repeats") - 1)).otherwise(F.lit(0))
    # Of runs that follow each other and are equal, the whole is a repeat.
    span = packed(F.when(step > 0, F.col("a")).otherwise(first), F.when(step > 0, F.col("a") + F.col("windows") + step - 1).otherwise(F.col("a") + F.col("e")) + length)
    spans = tables.write(found.groupBy("kid", F.col("doc_id").alias("id")).agg(F.collect_list(span).alias("spans")))
    tables.drop(cand, contexts, bytes_, edges, *([crowded] if gram < length else []))
    return spans


def merge_spans(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal spans; those that touch are one."""
    out: list[tuple[int, int]] = []
    a = b = -1
    for x in sorted(spans):
        s, e = x >> 32, x & 0xFFFFFFFF
        if s > b:
            if b >= 0:
                out.append((a, b))
            a, b = s, e
        elif e > b:
            b = e
    return out if b < 0 else [*out, (a, b)]


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256."""
    tables = Tables(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("kid"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.lit(1).cast("long").alias("times"))
    spans = repeated_spans(docs, length, tables)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cols: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
                for raw, found in zip(part.column("raw").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    merged = merge_spans(found or [])
                    ends = [0, *(b for _, b in merged)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in merged), len(raw)], strict=True))
                    for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(merged), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                        cols[c].append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(cols.values(), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], names=["doc_id", *cols])

    joined = docs.join(spans, (docs["kid"] == spans["kid"]) & docs["doc_id"].eqNullSafe(spans["id"]), "left").select(docs["doc_id"], "raw", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
