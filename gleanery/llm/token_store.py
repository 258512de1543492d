"""Token-ID output: fixed-width bit packing in blocks, in document order.

Format: a Parquet dataset of blocks. A block holds whole documents, so it can be decoded alone:
``bucket, block`` (its place in the order), ``bits`` (width of an id), ``n_ids``, ``doc_ids`` and ``ends`` (each
document's id and the position after its last id), ``payload`` (the ids, ``bits`` bits each, least significant first).
A block is closed once it has ``block_ids`` ids; one document is never split. The document at position *k* is
``unpack(payload, bits, ends[k-1], ends[k])``: a slice of the bytes, no scan of what stands before.

Edge cases: a null text is an empty one; an empty text is the end id alone; equal ``doc_id`` rows are all kept, ordered
by the hash of their text; null ``doc_id`` comes first; an empty table gives an empty dataset; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.ordering import range_bucket
from gleanery.storage import Tables

BLOCKS = "bucket int, block int, bits int, n_ids long, doc_ids array<long>, ends array<long>, payload binary"
DOCS = "bucket int, block int, doc_id long, at long, n_tokens long, ids_crc32 long"

#: Bytes of texts encoded at once.
CHUNK_BYTES = 4 << 20
# Marks that often follow a word, and capitals whose lower case depends on what follows or is two letters.
_MARKS = ",.;:!?"
MARKS, ODD_CASE = frozenset(_MARKS), frozenset("Σİ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (each below 2**bits) as a bit string, least significant bit first, padded to a whole byte."""
    ids = np.asarray(ids, np.uint32)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = ((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(rows.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a packed block; touches only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", end - start, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-end * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    raw = raw[start * bits - first * 8 :][: (end - start) * bits].reshape(-1, bits).astype(np.uint32)
    return (raw << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class WordEncoder:
    """Encodes whole texts with the tokenizers library, once per distinct word.

    The tokenizer splits at white space before it merges, so a text's ids are its words' ids in order. Words are cut at
    spaces and newlines only; rarer white space stays inside a word and is left to the tokenizer. Arrow numbers the
    distinct words of a chunk of texts, parts them into stems and marks, and a chunk's ids are gathered from theirs at once. The memory of words is
    bounded: once it holds ``most`` of them a new one begins, and the old one serves until the next change.
    """

    def __init__(self, path: str, most: int = 250_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        # For lower-case words of letters, on which the full preparation has no effect: the same merges without it.
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.parting,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.fixed = {"": b""} | {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in MARKS}
        self.known, self.old = dict(self.fixed), {}

    def learn(self, words: list[str]) -> None:
        """A word of letters, with or without one mark after it, is known by its lower-case letters and the mark: the
        tokenizer lowers all letters and parts runs of letters from other characters. Others are encoded as they are."""
        parts, known, old = {}, self.known, self.old
        known.update((w, old[w]) for w in words if w in old)
        words = [w for w in words if w not in known] if old else words
        self._encode(self.light, [w for w in words if w.isascii() and w.isalpha() and w.islower()])
        words = [w for w in words if w not in known]
        for w in words:
            letters, mark = (w[:-1], w[-1]) if w[-1] in MARKS else (w, "")
            if letters.isalpha() and (letters.isascii() or (is_normalized("NFC", letters) and not ODD_CASE.intersection(letters))):
                parts[w] = (letters.lower(), mark)
        self._encode(self.light, list({p for p, _ in parts.values() if p not in known}))
        self._encode(self.tokenizer, [w for w in words if w not in parts and w not in known])
        known.update((w, known[p] + known[mark]) for w, (p, mark) in parts.items())

    def _encode(self, tokenizer, words: list[str]) -> None:
        """Words without a 0 go 200 to a string, with the digit as parting word: digits are always tokens of their own."""
        plain = [w for w in words if "0" not in w and "<|" not in w]
        rows = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for part, made in zip(rows, tokenizer.encode_batch_fast([" 0 ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            cut = np.flatnonzero(ids == self.parting)
            if len(cut) != len(part) - 1:
                raise ValueError("the parting word stands inside a word")
            raw, first, last = ids.tobytes(), [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), 4 * len(ids)]
            self.known.update(zip(part, map(raw.__getitem__, map(slice, first, last)), strict=True))
        odd = [w for w in words if "0" in w or "<|" in w]
        self.known.update(zip(odd, (np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` after it, and the position after each text's last id."""
        if len(self.known) > self.most:
            self.known, self.old = dict(self.fixed), self.known
        known, cut = self.known, pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        # Words of ASCII letters are lowered and parted from their mark before they are looked up.
        plain = pc.match_substring_regex(coded.dictionary, f"^[A-Za-z]+[{_MARKS}]?$")
        stems = pc.if_else(plain, pc.ascii_lower(pc.ascii_rtrim(coded.dictionary, characters=_MARKS)), coded.dictionary).dictionary_encode()
        marks = pc.index_in(pc.if_else(plain, pc.utf8_slice_codeunits(coded.dictionary, -1), ""), value_set=pa.array(list(_MARKS)))
        words = stems.dictionary.to_pylist()
        self.learn([w for w in words if w not in known])
        each = [known[w] for w in [*words, *_MARKS]]
        each.append(np.array([end_id], "<u4").tobytes())
        ids, sizes = np.frombuffer(b"".join(each), "<u4"), np.array([len(x) for x in each]) // 4
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        # A word is its stem's number and its mark's, or -1 without one.
        pairs = np.stack((stems.indices.to_numpy(), pc.add(pc.fill_null(marks, -1 - len(words)), len(words)).to_numpy(zero_copy_only=False)), axis=1)
        number = pairs[coded.indices.to_numpy()].ravel()
        used = number >= 0
        ends = np.concatenate(([0], np.cumsum(used)))[2 * ends]
        number = np.insert(number[used], ends, len(each) - 1)
        size = sizes[number]
        after = np.cumsum(size)
        place = np.repeat((np.cumsum(sizes) - sizes)[number] - (after - size), size)
        place += np.arange(len(place))
        return ids[place], after[ends + np.arange(len(ends))]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of ``column``; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        stop = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, stop - first)
        first = stop


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, bits: int, block_ids: int = 1 << 16) -> DataFrame:
    """Blocks of the format above for every row of ``docs(doc_id, text)``, one shuffle of the texts by id range."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("bucket", range_bucket(docs, "doc_id", 1000))
    n = max(1, docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"), "text")

    def run(batches):
        enc = _encoder(tokenizer)
        bucket, block, keys, ends, parts, size = None, 0, [], [], [], 0

        def out():
            packed = pack(np.concatenate(parts), bits)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "block": pa.array([block], pa.int32()), "bits": pa.array([bits], pa.int32()), "n_ids": pa.array([size], pa.int64()), "doc_ids": pa.array([keys], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int64())), "payload": pa.array([packed], pa.binary())})

        for batch in batches:
            for part in chunks(batch, "text"):
                ids, after = enc.encode(part.column("text"), end_id)
                begin = 0
                for key, b, stop in zip(part.column("doc_id").to_pylist(), part.column("bucket").to_pylist(), after.tolist(), strict=True):
                    if keys and (b != bucket or size >= block_ids):
                        yield out()
                        block, keys, ends, parts, size = block + 1, [], [], [], 0
                    if b != bucket:
                        bucket, block = b, 0
                    keys.append(key)
                    parts.append(ids[begin:stop])
                    size += stop - begin
                    ends.append(size)
                    begin = stop
        if keys:
            yield out()

    return ordered.mapInArrow(run, BLOCKS)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            starts = [0, *row["ends"][:-1]]
            crc = [zlib.crc32(unpack(row["payload"], row["bits"], a, b).astype("<u4").tobytes()) for a, b in zip(starts, row["ends"], strict=True)]
            n = len(starts)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([row["bucket"]] * n, pa.int32()), "block": pa.array([row["block"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "at": pa.array(starts, pa.int64()), "n_tokens": pa.array(np.subtract(row["ends"], starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the blocks.

    Starts come from two sums, over buckets and over the blocks of a bucket; neither reads the payload.
    """
    sizes = blocks.select("bucket", "block", "n_ids")
    in_bucket = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket, bounded in number
    buckets = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_at"))
    starts = sizes.withColumn("block_at", F.coalesce(F.sum("n_ids").over(in_bucket), F.lit(0))).join(buckets, "bucket")
    starts = starts.select("bucket", "block", (F.col("bucket_at") + F.col("block_at")).alias("base"))
    docs = blocks.mapInArrow(_read, DOCS)
    return docs.join(starts, ["bucket", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    """Write the dataset into the shared folder and return the table that reads it."""
    bits = max(1, int(max(vocabulary, end_id + 1) - 1).bit_length())
    return Tables(spark, "tokens").write(token_blocks(docs, tokenizer, end_id, bits))


def look_up(blocks: DataFrame, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document; only the blocks that list it are decoded."""
    rows = blocks.filter(F.array_contains("doc_ids", doc_id)).collect()
    return [unpack(bytes(r["payload"]), r["bits"], k and r["ends"][k - 1], r["ends"][k]) for r in rows for k, d in enumerate(r["doc_ids"]) if d == doc_id]
