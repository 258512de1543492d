"""Periodic runs of words: a suffix automaton whose link tree is walked by link-cut accesses.

A run is a stretch of words with smallest period q, at least ``min_words`` and ``min_exponent * q`` long, that no neighbour
extends. The automaton of a stretch of text is built word by word; its suffix links form a tree in which the path from a
prefix to the root holds all suffixes of that prefix. Access of prefix i makes that path preferred and colours it i, so a
preferred path always carries the end of its last occurrence. What an access passes are segments of older colours: a
segment of colour p with the longest suffix of length L says that L words end both at p and at i and no longer match does.
If i - p <= L, the two overlap or touch: a square of period i - p that starts at p - L. Of one run only the first square is
taken; it has the run's start, and is extended to the right. The period is the smallest one, since a smaller one would have
left a later colour.

Automata are only built where a run can be. In a run of period q the k-grams (k = 8) from its (q+1)-th word on have all
occurred q words before, and q is at most half of that chain of k-grams plus k; chains whose nearest earlier occurrences
are farther off are cut there. What remains is widened by the longest period the chain allows and one word, so no run is
lost and each is seen with both neighbours. Equal words have equal hashes, so hashing loses nothing either; automata read
the words themselves.

Documents are rows and never meet, so the plan has no shuffle and a lost executor costs the batches it was reading.

Edge cases: null and empty texts have no words and no run; repeated rows and null ids are rows of their own; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the grams that tell where a run can be: min_words - min_words / min_exponent words of a run repeat earlier ones.
GRAM = 8
#: Rows in a batch that goes back to Spark.
ROWS = 256

Run = tuple[int, int, int]


class LastEnds:
    """A link-cut tree over suffix links; ``access`` colours the path of a state and tells what it was coloured before.

    A preferred path is a splay tree ordered by depth; ``up`` of its root is the path's parent. The colour stands at the
    root only, since a path has one colour. State 0, the empty word, is not in it.
    """

    def __init__(self, links: list[int]):
        n = len(links)
        self.up, self.left, self.right, self.colour = list(links), [0] * n, [0] * n, [-1] * n

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                # The outer rotation comes first if both steps go the same way.
                straight = (left[p] == x) == (left[g] == p)
                self._rotate(p if straight else x)
            self._rotate(x)
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            left[p] = b = right[x]
            right[x] = p
        else:
            right[p] = b = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """(deepest state, colour before) of each segment of the path from ``v`` to the root that had a colour."""
        up, right, colours = self.up, self.right, self.colour
        seen, below, x = [], 0, v
        while x:
            self._splay(x)
            c = colours[x]
            if c >= 0:
                seen.append((x, c))
            if right[x]:
                colours[right[x]] = c
            right[x] = below
            below, x = x, up[x]
        self._splay(v)
        colours[v] = colour
        return seen


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states of the suffix automaton of ``words``, and the state of each prefix."""
    links, lengths, steps, prefixes, last = [-1], [0], [{}], [], 0
    for w in words:
        now = len(links)
        lengths.append(lengths[last] + 1)
        steps.append({})
        links.append(0)
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = now
            p = links[p]
        if p >= 0:
            q = steps[p][w]
            if lengths[q] == lengths[p] + 1:
                links[now] = q
            else:
                twin = len(links)
                lengths.append(lengths[p] + 1)
                steps.append(dict(steps[q]))
                links.append(links[q])
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = twin
                    p = links[p]
                links[q] = links[now] = twin
        prefixes.append(now)
        last = now
    return links, lengths, prefixes


def squares_to_runs(words: list, min_words: int, min_exponent: int) -> list[Run]:
    """(start, length, period) of all runs of ``words``, by one automaton."""
    links, lengths, prefixes = automaton(words)
    tree, n = LastEnds([max(x, 0) for x in links]), len(words)
    reach: dict[int, int] = {}
    found = []
    for i, state in enumerate(prefixes):
        for x, p in tree.access(state, i):
            period = i - p
            if period > lengths[x] or reach.get(period, -1) >= i:
                continue
            end = i + 1
            while end < n and words[end] == words[end - period]:
                end += 1
            reach[period] = end - 1
            start = p - lengths[x] + 1
            if end - start >= max(min_words, min_exponent * period):
                found.append((start, end - start, period))
    return found


def places(words: list, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """Spans of ``words`` outside of which no run has a word; disjoint, with a word around each run."""
    n, k = len(words), GRAM
    # Words of a run that repeat those a period earlier, at least: the longest period takes 1 / min_exponent of it.
    fewest = min_words - min_words // min_exponent - k + 1
    if n < min_words:
        return []
    if min_exponent < 2 or fewest < 2:
        return [(0, n)]
    g = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    width = 1
    while width < k:
        g = g[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + (g[width:] ^ (g[width:] >> np.uint64(29)))
        width *= 2
    order = np.sort(g)
    same = order[1:] == order[:-1]
    if int(same.sum()) < fewest:
        return []
    at = np.flatnonzero(np.isin(g, order[1:][same]))
    by = np.argsort(g[at], kind="stable")
    near = np.full(len(at), n)
    twin = g[at[by[1:]]] == g[at[by[:-1]]]
    near[by[1:][twin]] = (at[by[1:]] - at[by[:-1]])[twin]
    out = []
    while len(at):
        # Chains of neighbours; a run's period is at most (chain + k) / (min_exponent - 1).
        head = np.concatenate(([True], at[1:] != at[:-1] + 1))
        chain = np.cumsum(head) - 1
        sizes = np.bincount(chain)
        allowed = (sizes + k - 1) // (min_exponent - 1)
        keep = (near <= allowed[chain]) & (sizes >= fewest)[chain]
        if keep.all():
            first = at[head]
            last = np.append(at[np.flatnonzero(head)[1:] - 1], at[-1])
            for a, b, q in zip(first.tolist(), last.tolist(), allowed.tolist(), strict=True):
                a, b = max(0, a - q - 1), min(n, b + k + 1)
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], max(b, out[-1][1]))
                else:
                    out.append((a, b))
            break
        at, near = at[keep], near[keep]
    return out


def word_runs(words: list, min_words: int = 24, min_exponent: int = 3) -> list[Run]:
    """(start, length, period) of the runs of ``words``, by start, then period."""
    found = []
    for a, b in places(words, min_words, min_exponent):
        found += [(a + s, n, q) for s, n, q in squares_to_runs(words[a:b], min_words, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[Run]) -> list:
    """``words`` without what follows the first period of a run."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for s, n, q in runs:
        drop[s + q : s + n] = b"\1" * (n - q)
    return [w for w, d in zip(words, drop, strict=True) if not d]


_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, min_words: int = 24, min_exponent: int = 3, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, runs (start, length, period by start, then period), collapsed.

    Words are what white space (0x20, 0x09 to 0x0D) parts. ``collapsed`` has the kept words with one space between them.
    ``edit`` may change a document's words first; it gets the id and the words as UTF-8.
    """
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                sizes, found, kept = [], [], []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), part.column("raw").to_pylist(), strict=True):
                    words = raw.split()
                    if edit:
                        words = edit(doc_id, words)
                    runs = word_runs(words, min_words, min_exponent)
                    sizes.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    kept.append(b" ".join(collapse(words, runs)))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, runs_type), text], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, _SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """Digests of ``find_runs``: the number of runs, the one of greatest length / period (then smallest start, then period), and hashes."""
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    # Exact fractions: a / b > c / d as a * d > c * b.
    better = lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], x).otherwise(y)
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)), lambda acc, r: better(r, acc))
    rows = found.withColumn("__best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__best.start").alias("start"), F.col("__best.length").alias("length"), F.col("__best.period").alias("period"),
        F.floor(1000 * F.col("__best.length") / F.col("__best.period")).alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
