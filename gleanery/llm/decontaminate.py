"""Benchmark decontamination: find benchmark items, edited or not, inside documents.

Method: the CGK random walk maps a string to a longer one so that a small edit distance becomes a small Hamming distance;
repeated bit sampling of the walks is the hash family of an LSH; candidates are confirmed by an exact edit distance
(bit-parallel, free ends in the document). Texts are compared in lower case with runs of white space as one space. An item
of L characters is found with at most ``floor(rate * L)`` edits, fewer for items under 54 characters.

Windows have the item's size. They are not placed everywhere: an item is cut into P pieces of 8 characters, of which at
least P - d survive d edits (pigeonhole), shifted against each other by at most d. So only windows that hold that many
pieces, at starts that differ by at most d, are embedded. d is below P for every item, so this loses nothing. Windows whose
starts follow each other within d are one place: it is verified once, over all its windows, if one of them agrees with
the item in a round.

The walk writes pairs of neighbouring characters, so that unrelated texts hardly ever agree on a step; single characters
agree on every ninth. Each round has a walk of its own and samples ``bits`` of its first L steps (later ones are mostly
padding). Walks drift apart after each edit: measured at the edit limit of ``rate`` 0.1, and for the hardest kind of edit,
rounds agree as often as if ``agreement`` / sqrt(L) of the steps did. An item's rounds repeat until the chance of missing
such a window is below 1 - ``recall``: 64 rounds at 53 characters, 640 at 236, 3,584 at 757. They come in batches, and a
place that has agreed leaves; an unedited item agrees in the first round. Of random windows of documents 0.5 to 0.8 % pass
(53 to 236 characters), of unrelated invented prose 0.1 %. Windows with twice the allowed edits mostly pass, since the
distortion of the embedding grows with the edits; the exact distance settles them. Items under 8 characters are matched
exactly.

Benchmarks are dealt to the tasks by broadcast in blocks of about ``block_chars`` characters. ``find_items`` makes one pass
over the documents for each block, ``decontaminate`` drops rows block by block in one pass; neither shuffles a text.

Edge cases: null or blank texts hold nothing; null and blank items match nothing; every row is judged by its own text, so
null ids, equal ids and repeated rows are each reported or dropped alone; equal items are each reported; an empty table on
either side gives an empty result, or all documents; ``find_items`` reads no other columns, ``decontaminate`` keeps them.
"""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.columns import arrow_filter

GRAM = 8
SPACE = re.compile(r"\s+")
#: Steps x walks x windows that are embedded at once, and rounds of a batch.
WALK_CELLS, BATCH = 4_000_000, 64
FOUND = "doc_id long, item_id long, distance int, item_chars int, start long"


def normal(text: str | None) -> str:
    return SPACE.sub(" ", (text or "").lower()).strip()


def allowed_edits(size: int, rate: float) -> int:
    """At most rate * size, and few enough that three pieces of GRAM characters survive; below 0: too short to match."""
    return min(int(rate * size), max(0, size // GRAM - 3)) if size >= GRAM else -1


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_keys(chars: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A 64-bit key of every ``width`` neighbouring characters."""
    n = len(chars) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    wide = chars.astype(np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + len(out)]
    return out ^ (out >> np.uint64(31))


def pair_symbols(text: str) -> np.ndarray:
    """A symbol above zero for every character and the one after it."""
    chars = codes(text)
    after = np.append(chars[1:], np.zeros(min(1, len(chars)), np.uint32))
    mixed = chars * np.uint32(0x9E3779B1) + after * np.uint32(0x85EBCA77)
    return np.maximum(mixed ^ (mixed >> np.uint32(15)), np.uint32(1))


def rounds_for(size: int, recall: float, agreement: float, bits: int) -> int:
    """Rounds, in whole batches, after which a window at the edit limit is missed with probability 1 - ``recall``."""
    per = min(1.0, agreement / math.sqrt(size)) ** bits
    return BATCH * max(1, math.ceil(math.log(1 - recall) / math.log(1 - per) / BATCH)) if per < 1 else BATCH


def cgk_walks(rows: np.ndarray, steps: int, walks: int, seed: int = 0) -> np.ndarray:
    """steps x walks x rows: CGK embeddings of zero-padded rows. Every step writes the symbol it stands on and then
    advances or not by a random bit of the walk, the step and the symbol. At a row's end it stays and writes zeros."""
    wide = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint32)
    wide[:, :-1] = rows
    flat, at = wide.ravel(), np.tile(np.arange(rows.shape[0]) * wide.shape[1], (walks, 1))
    bits, own = np.random.default_rng((9, seed)), np.arange(walks)[:, None] * 1024
    out = np.zeros((steps, walks, rows.shape[0]), np.uint32)
    for step in range(steps):
        char = flat[at]
        out[step] = char
        turn = bits.integers(0, 2, (walks, 1024), np.uint8)
        turn[:, 0] = 0
        at += turn.ravel()[own + np.where(char > 1023, char % 1023 + 1, char)]
    return out


def edit_distance_inside(item: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text``, and that substring's end; most + 1 if above most."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, distance, whole, high = (1 << m) - 1, 0, m, (1 << m) - 1, 1 << (m - 1)
    best, end = m, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & whole, plus & xh
        if ph & high:
            distance += 1
        elif mh & high:
            distance -= 1
        ph, mh = ph << 1 & whole, mh << 1 & whole
        plus, minus = mh | ~(xv | ph) & whole, ph & xv
        if distance < best:
            best, end = distance, k + 1
    return (best, end) if best <= most else (most + 1, 0)


class Index:
    """What a task needs of one block of items: piece grams, sampled walks, texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, recall: float, agreement: float, bits: int):
        known = [(i, t, allowed_edits(len(t), rate)) for i, t in items if t]
        self.items = [x for x in known if x[2] >= 0]
        self.short: dict[int, dict[str, list[int]]] = {}
        for i, t, e in known:
            if e < 0:
                self.short.setdefault(len(t), {}).setdefault(t, []).append(i)
        cuts = [np.arange(len(t) // GRAM) * GRAM for _, t, _ in self.items]
        keys = np.concatenate([np.zeros(0, np.uint64), *(gram_keys(codes(t))[c] for (_, t, _), c in zip(self.items, cuts, strict=True))])
        by = np.argsort(keys, kind="stable")
        self.gram_items = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])[by]
        self.gram_offsets = np.concatenate([np.zeros(0, np.int64), *cuts])[by]
        self.keys, self.first = np.unique(keys[by], return_index=True)
        self.many = np.diff(np.append(self.first, len(by)))
        self.edits = np.array([e for _, _, e in self.items], np.int64)
        self.need = np.array([len(t) // GRAM - e for _, t, e in self.items], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.bits = bits
        self.rounds = np.array([rounds_for(len(t), recall, agreement, bits) for _, t, _ in self.items], np.int64)
        self.signs: dict[tuple[int, int], np.ndarray] = {}

    def _signs(self, windows: list[str], item_sizes: list[int], batch: int) -> np.ndarray:
        """BATCH x windows: a hash of the sampled steps, drawn within the item's size."""
        sizes = np.array(item_sizes)
        rows = np.zeros((len(windows), max(sizes)), np.uint32)
        for k, w in enumerate(windows):
            rows[k, : len(w)] = pair_symbols(w)
        walked = cgk_walks(rows, rows.shape[1], BATCH, batch)
        out = np.zeros((BATCH, len(windows)), np.uint64)
        each, every = np.arange(BATCH)[:, None], np.arange(len(windows))[None, :]
        for s in np.random.default_rng((8, batch)).random((self.bits, BATCH)):
            out = out * np.uint64(0x9E3779B97F4A7C15) + walked[(s[:, None] * sizes[None, :]).astype(np.int64), each, every] + np.uint64(1)
        return out

    def near(self, rows: list[tuple[int, str, int]]) -> set[int]:
        """The places, of rows (place, window, item), that have a window which agrees with its item in some round.

        Rows are ordered by the item's size."""
        found: set[int] = set()
        batch = 0
        while rows:
            at = 0
            while at < len(rows):
                size = len(self.items[rows[min(at + 255, len(rows) - 1)][2]][1])
                part = rows[at : at + max(1, min(256, WALK_CELLS // (size * BATCH)))]
                at += len(part)
                part = [x for x in part if x[0] not in found]
                new = sorted({n for _, _, n in part if (n, batch) not in self.signs})
                if not part:
                    continue
                texts = [self.items[n][1] for n in new]
                signs = self._signs([*texts, *(w for _, w, _ in part)], [*map(len, texts), *(len(self.items[n][1]) for _, _, n in part)], batch)
                self.signs |= {(n, batch): signs[:, k] for k, n in enumerate(new)}
                mine = np.stack([self.signs[n, batch] for _, _, n in part], 1)
                agree = (signs[:, len(new) :] == mine).any(0).tolist()
                found.update(x[0] for x, yes in zip(part, agree, strict=True) if yes)
            batch += 1
            rows = [x for x in rows if x[0] not in found and batch * BATCH < self.rounds[x[2]]]
        return found

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, start) of the windows to embed: starts on which enough pieces of the item agree."""
        chars = codes("\0".join(texts))
        keys = gram_keys(chars)
        if not len(self.keys) or not len(keys):
            return []
        hits = np.flatnonzero(self.filter[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, keys[hits]), len(self.keys) - 1)
        real = self.keys[place] == keys[hits]
        hits, place = hits[real], place[real]
        many = self.many[place]
        entry = np.repeat(self.first[place] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        owner = np.repeat(np.searchsorted(begins, hits, "right") - 1, many)
        item = self.gram_items[entry]
        offset = self.gram_offsets[entry]
        start = np.repeat(hits, many) - offset
        by = np.lexsort((start, item, owner))
        owner, item, start, offset = owner[by], item[by], start[by], offset[by]
        pair = owner * len(self.items) + item
        far = np.arange(len(start)) + self.need[item] - 1
        reach = np.minimum(far, len(start) - 1)
        good = (far < len(start)) & (pair[reach] == pair) & (start[reach] - start <= self.edits[item])
        line = pair * (len(chars) + 2 * len(max((t for _, t, _ in self.items), key=len))) + start  # ascending
        last = np.searchsorted(line, (line + self.edits[item])[good], "right")
        rows = set()
        for i, end in zip(np.flatnonzero(good).tolist(), last, strict=True):
            n, k = int(item[i]), int(owner[i])
            if len(set(offset[i:end].tolist())) >= self.need[n]:  # of different pieces
                rows.add((k, n, max(0, int(start[i] - begins[k]))))
        return sorted(rows)

    def exact(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item id, size, start) of the items too short for pieces."""
        chars, out = codes("\0".join(texts)), []
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        for size, own in self.short.items():
            by = {int(gram_keys(codes(t), size)[0]): (t, ids) for t, ids in own.items()}
            keys = gram_keys(chars, size)
            hits = np.flatnonzero(np.isin(keys, np.array(list(by), np.uint64)))
            owner = np.searchsorted(begins, hits, "right") - 1
            _, first = np.unique(np.stack((owner.astype(np.uint64), keys[hits])), axis=1, return_index=True) if len(hits) else (None, [])
            for i in first:
                k, s = int(owner[i]), int(hits[i] - begins[owner[i]])
                t, ids = by[int(keys[hits[i]])]
                if texts[k][s : s + size] == t:
                    out += [(k, item, size, s) for item in ids]
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, distance, item size, start) of the best match of every item found in every text."""
        out = [(i + k, item, 0, size, s) for i in range(0, len(texts), 128) for k, item, size, s in self.exact(texts[i : i + 128])] if self.short else []
        cand = [(i + k, n, s) for i in range(0, len(texts), 128) for k, n, s in self.candidates(texts[i : i + 128])]
        places: list[tuple[int, int, list[int]]] = []
        for k, n, s in cand:
            if places and places[-1][:2] == (k, n) and s - places[-1][2][-1] <= self.items[n][2]:
                places[-1][2].append(s)
            else:
                places.append((k, n, [s]))
        places.sort(key=lambda p: len(self.items[p[1]][1]))
        near = self.near([(p, texts[k][s : s + len(self.items[n][1])], n) for p, (k, n, starts) in enumerate(places) for s in starts])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for p, (k, n, starts) in enumerate(places):
            if p in near and best.get((k, n), (1,))[0] > 0:
                _, item, edits = self.items[n]
                low = max(0, starts[0] - edits)
                d, end = edit_distance_inside(item, texts[k][low : starts[-1] + len(item) + 2 * edits], edits)
                if d <= edits and d < best.get((k, n), (edits + 1,))[0]:
                    best[k, n] = (d, max(0, low + end - len(item)))
        return out + [(k, self.items[n][0], d, len(self.items[n][1]), s) for (k, n), (d, s) in best.items()]


#: The last index of this worker, by the name of its block.
_LAST: dict[str, Index] = {}


def _blocks(benchmark: DataFrame, block_chars: int, how: tuple) -> list:
    """A function per block of items that gives its index inside a task."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))

    def made(block: int):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_chars
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item_id, normal(r.text)) for r in own])

        def index() -> Index:
            if name not in _LAST:
                _LAST.clear()
                _LAST[name] = Index(shared.value, *how)
            return _LAST[name]

        return index

    return [made(b) for b in range(blocks)]


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, recall: float = 0.99, agreement: float = 3.0, bits: int = 3, block_chars: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, distance, item_chars, start) for every document and item of ``benchmark`` that it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def passed(index) -> DataFrame:
        def run(batches):
            ix = index()
            for batch in batches:
                found = ix.search([normal(t) for t in batch.column("text").to_pylist()])
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                cols = ([f[k] for f in found] for k in range(1, 5))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True))], names=["doc_id", "item_id", "distance", "item_chars", "start"])

        return docs.mapInArrow(run, FOUND)

    return reduce(DataFrame.unionByName, [passed(index) for index in _blocks(benchmark, block_chars, (rate, recall, agreement, bits))])


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, recall: float = 0.99, agreement: float = 3.0, bits: int = 3, block_chars: int = 8 << 20) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    for index in _blocks(benchmark, block_chars, (rate, recall, agreement, bits)):

        def clean(index=index):
            ix = index()

            def keep(texts):
                held = {f[0] for f in ix.search([normal(t) for t in texts])}
                return [k not in held for k in range(len(texts))]

            return keep

        docs = arrow_filter(docs, clean)
    return docs
