"""Near-duplicate classes by HyperMinHash sketches, banding and exact verification.

A document's set is its distinct 5-word shingles (64-bit hashes). Its sketch has 128 registers: hashes fall into buckets
by their first bits, and a register stores the least hash of its bucket as a leading-zero count (6 bits) and a mantissa
(10 bits). Bands of 4 registers give candidates; the sketches' collision-corrected Jaccard estimate drops the hopeless
ones; the full sets confirm the rest. A pair at the limit of 0.75 shares a band with probability over 0.99999.

Work is on classes of equal word sequences, so copies cost one row. Inside a bucket no pairs are listed: every member is
held against the bucket's pivot, a random member that differs from band to band. Classes that related pivots connect make
a family. Buckets that still hold several families are compared sketch against sketch between the families, in a grid of
blocks if they are large, and hopeful pairs join theirs. A family is compared in a block of bounded size, or in a grid of
blocks, sketch against sketch; hopeful pairs are confirmed on the spot unless they are in one component already. So every
banded pair ends in one component or has been given up by its sizes, its estimate or its full sets, and what leaves a block
is at most one link per class.

Edge cases: null, empty and blank texts have size 0 and link with nothing; under five words the whole sequence is the one
shingle; repeated rows are one class; a null doc_id counts as a member but names a component only if all ids are null;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.columns import packed, unpacked
from gleanery.llm.rolling import Spans, mix64
from gleanery.operators.components import connected_components
from gleanery.storage import Tables

REGISTERS, BAND, MANTISSA = 128, 4, 10
EMPTY = 0xFFFF
#: Shingles and classes, about, of either part of a block.
BLOCK_SHINGLES, BLOCK_ROWS = 2_000_000, 8192
#: Standard errors below the limit at which an estimate is given up.
SLACK = 3.5
#: Least estimate for a bucket's pivot to tie a member to its family. A pivot under this has only a common line or passage
#: with the member, which is then compared with the other families of the bucket.
KIN = 0.3


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words start (one entry more than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return Spans(data).hash(starts, ends), np.searchsorted(starts, at)


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[list[bytes], list[np.ndarray]]:
    """Per text: a digest of its word sequence, and its sorted distinct shingle hashes."""
    words, at = word_hashes(texts)
    all_sh = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        all_sh = all_sh * np.uint64(0x9DDFEA08EB382D69) + words[k : k + len(all_sh)]
    all_sh = mix64(all_sh)
    keys, sets = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        keys.append(hashlib.md5(words[a:b].tobytes()).digest())
        if b - a >= width:
            sets.append(np.unique(all_sh[a : b - width + 1]))
        elif b > a:
            sets.append(np.frombuffer(hashlib.md5(b"short" + words[a:b].tobytes()).digest()[:8], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return keys, sets


def sketch(values: np.ndarray) -> np.ndarray:
    """Registers of sorted distinct 64-bit hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(values):
        bits = REGISTERS.bit_length() - 1
        bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        low = (values[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits: exact as a double
        length = np.frexp(low.astype(np.float64))[1]
        zeros = 53 - length
        mantissa = ((low << (zeros + 1).astype(np.uint64)) & np.uint64(2**53 - 1)) >> np.uint64(53 - MANTISSA)
        out[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, and the number of registers that speak.

    Corrected for chance: different minima agree in a register's few bits about 0.1699 * 2**(p - r) times per sketch
    pair of like sizes, less for unlike sizes.
    """
    full = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(full.sum(-1), 1)
    equal = ((a == b) & full).sum(-1)
    ratio = np.maximum(na, nb) / np.maximum(1, np.minimum(na, nb))
    chance = 0.169919487 * REGISTERS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2 * n / REGISTERS
    return np.maximum(equal - chance, 0) / np.maximum(n - chance, 1e-9), n


def hopeful(a, b, na, nb, limit: float) -> np.ndarray:
    est, n = estimate(a, b, na, nb)
    return est >= limit - SLACK * np.sqrt(limit * (1 - limit) / n)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, kid (hash of the text), nk (digest of the word sequence), n (size of the set), regs."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                keys, sets = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("kid"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "kid", "nk", "n", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("kid")).mapInArrow(run, "doc_id long, kid long, nk binary, n long, regs binary")


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                keys, sets = shingle_sets(batch.slice(i, 512).column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"nk": pa.array(keys, pa.binary()), "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.select("text").mapInArrow(run, "nk binary, members binary").dropDuplicates(["nk"])


def bands(nodes: DataFrame) -> DataFrame:
    """(key, nk) for every band that has a register in use."""
    size = BAND * 2
    every = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.struct(i.alias("i"), F.substring(F.col("regs"), i * size + 1, F.lit(size)).alias("part")))
    used = F.filter(every, lambda x: F.hex(x["part"]) != "F" * 2 * size)
    return nodes.select("nk", F.explode(F.transform(used, lambda x: F.xxhash64(x["i"], x["part"]))).alias("key"))


def _estimated(pairs: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """Pairs (a, b) with an estimate of KIN or more, or with hope for the limit."""
    side = lambda x: nodes.select(F.col("nk").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            kin = (estimate(ra, rb, na, nb)[0] >= KIN) | hopeful(ra, rb, na, nb, limit)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kin))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a binary, b binary")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two full sets have 100 * intersection >= percent * union."""
    both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows(key, nk, family)`` of the keys with several families, with main (the largest one) and members."""
    per = rows.groupBy("key", "family").agg(F.count("*").alias("n"))
    keys = per.groupBy("key").agg(F.max(F.struct("n", "family")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("families")).filter("families > 1")
    return rows.join(keys.select("key", F.col("top.family").alias("main"), "members"), "key")


def kin_inside(rows: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """(class, class) pairs that join families of a bucket: sizes allow the limit and the estimate is hopeful.

    Members of the main family are not compared with each other; families that are joined by then count as one.
    """
    rows = sorted(rows, key=lambda r: r["n"])
    n = np.array([r["n"] for r in rows])
    regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(-1, REGISTERS)
    number = {f: i for i, f in enumerate({r["family"] for r in rows})}
    root, main, out = np.array([number[r["family"]] for r in rows]), np.array([r["family"] == r["main"] for r in rows]), []
    for k in np.flatnonzero(~main).tolist():
        low, high = np.searchsorted(n, -(-n[k] * percent // 100), "left"), np.searchsorted(n, n[k] * 100 // percent, "right")
        other = np.arange(low, high)
        other = other[(root[low:high] != root[k]) & (main[low:high] | (other > k))]
        if len(other):
            other = other[hopeful(regs[k][None, :], regs[other], np.full(len(other), n[k]), n[other], percent / 100)]
        for m in other.tolist():
            if root[m] != root[k]:
                root[root == root[m]] = root[k]
                out.append((rows[k]["nk"], rows[m]["nk"]))
    return out


def _blockwise(dealt: DataFrame, keys: list[str], pairs_of, percent: int) -> DataFrame:
    """``pairs_of`` every block of rows with equal ``keys``, streamed from rows that are sorted by block."""

    def made(rows: list[dict]):
        if len(rows) > 1 and (pairs := pairs_of(rows, percent)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], names=["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                k = tuple(row[x] for x in keys)
                if k != key:
                    yield from made(rows)
                    key, rows = k, []
                rows.append(row)
        yield from made(rows)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def _grid(rows: DataFrame) -> DataFrame:
    """``rows(nk, parts, ...)`` in blocks (i, j), i <= j, that hold the i-th and the j-th part: every pair meets in some block."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("nk"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "parts")


def _between(hits: DataFrame, family: DataFrame, nodes: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """kin_inside of every bucket that holds several families."""
    named = hits.join(family, "nk", "left").select("key", "nk", F.coalesce("family", "nk").alias("family"))
    mixed = tables.write(_mixed(named))
    rows = mixed.withColumn("parts", F.ceil(F.col("members") / BLOCK_ROWS).cast("int"))
    rows = _grid(rows.select("key", "nk", "family", "main", "parts")).join(nodes.select("nk", "n", "regs"), "nk")
    return _blockwise(rows, ["key", "i", "j"], kin_inside, percent)


def _families(family: DataFrame, nodes: DataFrame) -> DataFrame:
    """Families dealt to blocks: one that fits is one block, a larger one a grid."""
    placed = family.join(nodes.select("nk", "n", "regs"), "nk")
    sizes = placed.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("parts"))
    return _grid(placed.join(sizes, "family")).select("family", "i", "j", "nk", "n", "regs")


def links_inside(rows: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """(class, class) links that join a block's classes into its components.

    Every pair with sizes that allow the limit and a hopeful estimate is held against its full sets, unless both are in
    one component by then.
    """
    rows = sorted(rows, key=lambda r: r["n"])
    n = np.array([r["n"] for r in rows])
    regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(-1, REGISTERS)
    root, out = np.arange(len(rows)), []
    for k, x in enumerate(rows):
        high = int(np.searchsorted(n, x["n"] * 100 // percent, "right"))
        other = k + 1 + np.flatnonzero(root[k + 1 : high] != root[k])
        if len(other):
            other = other[hopeful(regs[k][None, :], regs[other], np.full(len(other), x["n"]), n[other], percent / 100)]
        for m in other.tolist():
            if root[m] != root[k] and similar(x["members"], rows[m]["members"], percent):
                root[root == root[m]] = root[k]
                out.append((x["nk"], rows[m]["nk"]))
    return out


def _links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """links_inside of every block."""
    return _blockwise(families.join(sets, "nk"), ["family", "i", "j"], links_inside, percent)


def components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, kid (hash of the text), n_shingles, component (null without words), component_id."""
    spark, limit = docs.sparkSession, percent / 100
    tables = Tables(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = tables.write(signatures(docs))
    nodes = tables.write(sig.filter("n > 0").groupBy("nk").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    banded = bands(nodes)
    pivots = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "nk").alias("h"), "nk"))["nk"].alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    hits = tables.write(banded.join(pivots, "key").select("key", "nk", "pivot"))
    pairs = hits.filter("nk <> pivot").select(F.least("nk", "pivot").alias("a"), F.greatest("nk", "pivot").alias("b")).distinct()
    kin = tables.write(_estimated(pairs, nodes, limit).select("a", "b"))
    connected = lambda edges: tables.write(connected_components(edges, tables).select(F.col("node").alias("nk"), F.col("component").alias("family")))
    family = connected(kin)
    between = tables.write(_between(hits, family, nodes, tables, percent))
    if not between.isEmpty():
        family = connected(family.select(F.col("nk").alias("a"), F.col("family").alias("b")).union(between))
    tables.drop(hits, between)
    needed = nodes.join(family, "nk", "left_semi").select(F.col("doc_id").alias("need")).distinct()
    sets = tables.write(full_sets(docs.join(needed, F.col("doc_id").eqNullSafe(F.col("need")), "left_semi")))
    links = tables.write(_links(_families(family, nodes), sets, percent))
    tables.drop(kin, family, sets)
    comps = tables.write(connected_components(links, tables))

    named = nodes.select("nk", "doc_id").join(comps.withColumnRenamed("node", "nk"), "nk", "left").withColumn("component", F.coalesce("component", "nk"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = tables.write(named.join(least, "component").select("nk", "component", "component_id"))
    tables.drop(nodes, links, comps)
    out = sig.select("doc_id", "kid", "nk", F.col("n").alias("n_shingles")).join(names, "nk", "left")
    return out.select("doc_id", "kid", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    return components(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component, one with the smallest doc_id; rows that only share a doc_id are different documents.

    Documents without words have no component and all stay.
    """
    # Keys without nulls, so that the join and the choice among equal rows share one shuffle of the rows.
    place = lambda c: [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("place"), F.col(c).isNull().alias("no_id")]
    least = components(docs, percent).filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "kid")).alias("x")).select(F.col("x.doc_id").alias("doc_id"), F.col("x.kid").alias("kid"))
    own = docs.select(packed(docs), *place("doc_id"), F.xxhash64("text").alias("kid"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    keys = ["place", "no_id", "kid"]
    full = own.filter("worded").join(least.select(*place("doc_id"), "kid"), keys, "left_semi").dropDuplicates(keys)
    return full.select(unpacked(docs.columns)).union(own.filter("not worded").select(unpacked(docs.columns)))
