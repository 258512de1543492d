"""Hard negatives by exact inner product: anchors are clustered, and each cluster walks one shared list of candidates.

The anchors of a cluster lie within an angle b of its centre, so a candidate x at angle t from the centre has an inner
product of at most |a| |x| cos(max(t - b, 0)) with any member a. Candidates are sorted by |x| cos(max(t - b, 0)) once for the
cluster; every member walks that list from its top and stops as soon as the next bound times |a| is below what it still
looks for: the walk's end is certified, and results are those of comparing all.

Spark deals candidates to blocks and the members of clusters to groups of a bounded size; a group meets every block once in
each of two passes. The first finds an anchor's positives, its best rows of the same label; the second looks for the best
rows of other labels in the band of scores below each positive. A block gives as many rows for an anchor as the result
has, so what is merged is small. A cluster with very many members, such as copies of one vector, is split into parts that
walk their own lists. Centres are fitted to at most ``FIT_ROWS`` anchors, chosen by a hash; they decide how long walks are,
never the result.

Edge cases: rows with a null label, a null vector or a null component take no part; vectors of different lengths are
compared as if zeros followed the shorter one; a repeated row is a row of its own, so it may be another's positive; equal
scores are ordered by id, null ids last; an anchor without a row of its label has no positive and is not in the result,
like a positive without a row in its band; an empty table gives an empty result; extra columns are not read. Sums beyond
a long are reported as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import Tables

#: Anchors that centres are fitted to at most, anchors for each centre, centres at most, and rounds of fitting.
FIT_ROWS, PER_CENTRE, CENTRES, FIT_ROUNDS = 2048, 16, 64, 8
#: Anchors of a cluster that walk one list together, and anchors in a group, about.
PART, GROUP = 256, 2048
#: Candidates in a block: a 64th of all within these bounds.
BLOCK_LEAST, BLOCK_MOST = 1024, 1 << 16
#: Steps of a walk: candidates whose scores are computed at once.
STEP = 256
_EXACT, _LAST_ID = float(1 << 53), (1 << 63) - 1


def fit_centres(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors by spherical k-means from evenly spaced rows."""
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors[norms > 0] / norms[norms > 0, None]
    k = min(CENTRES, len(unit) // PER_CENTRE)
    if k < 2:
        return np.eye(1, vectors.shape[1]) if not len(unit) else _unit(unit.sum(axis=0, keepdims=True), unit[:1])
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(FIT_ROUNDS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        centres = _unit(sums, centres)
    return centres


def _unit(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(norms > 1e-12, rows / np.maximum(norms, 1e-12), other)


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of integers as rows, zeros after the shorter ones."""
    rows = [np.asarray(x, np.int64) for x in column.to_pylist()] if len(column) else []
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for r, x in zip(out, rows, strict=True):
        r[: len(x)] = x
    return out


def angles(vectors: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angle of each row to the centre; 0 for a zero vector."""
    return np.arccos(np.clip(np.where(norms > 0, vectors @ centre / np.maximum(norms, 1e-300), 1.0), -1, 1))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class SharedList:
    """Candidates in the order of their angular upper bound for one cluster of anchors."""

    def __init__(self, vectors: np.ndarray, members: np.ndarray, centre: np.ndarray):
        norms, own = np.linalg.norm(vectors.astype(np.float64), axis=1), np.linalg.norm(members.astype(np.float64), axis=1)
        apart = angles(members.astype(np.float64), own, centre).max(initial=0.0)
        # The margins here and in a walk are wider than the errors of the computation.
        bound = norms * (np.cos(np.maximum(angles(vectors.astype(np.float64), norms, centre) - apart - 1e-6, 0)) + 1e-9)
        self.order = np.argsort(-bound, kind="stable")
        self.bound, self.vectors, self.members, self.norms = bound[self.order], vectors, members, own

    def walk(self, needed: np.ndarray):
        """(active members, candidates, scores), step by step; ``needed`` holds what each member must still exceed or equal and may grow meanwhile."""
        for i in range(0, len(self.order), STEP):
            limit = self.norms * self.bound[i]
            active = np.flatnonzero(limit + np.abs(limit) * 1e-9 + 1e-3 >= needed)
            if not len(active):
                return
            at = self.order[i : i + STEP]
            yield active, at, scores(self.members[active], self.vectors[at])


def best(found: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """The first ``most`` of (score, id, row): high scores first, ties by id."""
    return sorted(found, key=lambda x: (-x[0], x[1], x[2]))[:most]


def positives_of(block: SharedList, ids, rows, labels, own_rows, own_labels, most: int) -> list[list[tuple[int, int, int]]]:
    """For each member its best rows of the same label, itself excluded."""
    found: list[list] = [[] for _ in own_rows]
    needed = np.full(len(own_rows), -np.inf)
    for active, at, s in block.walk(needed):
        fits = (s >= needed[active][:, None]) & (labels[at][None, :] == own_labels[active][:, None]) & (rows[at][None, :] != own_rows[active][:, None])
        for k in np.flatnonzero(fits.any(axis=1)).tolist():
            m = int(active[k])
            x = np.flatnonzero(fits[k])
            found[m] = best(found[m] + list(zip(s[k][x].tolist(), ids[at[x]].tolist(), rows[at[x]].tolist(), strict=True)), most)
            if len(found[m]) == most:
                needed[m] = found[m][-1][0]
    return found


def negatives_of(block: SharedList, ids, rows, labels, own_labels, bands: list[dict[int, tuple[int, int]]], most: int) -> list[dict[int, list[tuple[int, int, int]]]]:
    """For each member and positive score the best rows of other labels inside its band (least and greatest score)."""
    found: list[dict[int, list]] = [{p: [] for p in b} for b in bands]
    needed = np.array([min((low for low, _ in b.values()), default=np.inf) for b in bands], np.float64)
    top = np.array([max((high for _, high in b.values()), default=-1) for b in bands], np.int64)
    for active, at, s in block.walk(needed):
        fits = (s >= needed[active][:, None]) & (s <= top[active][:, None]) & (labels[at][None, :] != own_labels[active][:, None])
        for k in np.flatnonzero(fits.any(axis=1)).tolist():
            m = int(active[k])
            x = np.flatnonzero(fits[k])
            new = list(zip(s[k][x].tolist(), ids[at[x]].tolist(), rows[at[x]].tolist(), strict=True))
            least = []
            for p, (low, high) in bands[m].items():
                inside = [y for y in new if low <= y[0] <= high]
                if inside:
                    found[m][p] = best(found[m][p] + inside, most)
                least.append(found[m][p][-1][0] if len(found[m][p]) == most else low)
            needed[m] = min(least)
    return found


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _clusters(items: pa.Table, members: pa.Table, centres: np.ndarray):
    """Each cluster part of the members with its list over the block."""
    vectors = matrix(items.column("vector"), centres.shape[1])
    own = matrix(members.column("vector"), vectors.shape[1])
    if own.shape[1] > vectors.shape[1]:
        vectors = np.pad(vectors, ((0, 0), (0, own.shape[1] - vectors.shape[1])))
    wide = np.pad(centres, ((0, 0), (0, vectors.shape[1] - centres.shape[1])))
    parts = np.stack([_numbers(members, "cluster"), _numbers(members, "part")], axis=1)
    for c, p in np.unique(parts, axis=0).tolist():
        at = np.flatnonzero((parts[:, 0] == c) & (parts[:, 1] == p))
        yield at, SharedList(vectors, own[at], wide[c])


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors(vec_id, label, vector)`` of integers.

    ``anchors`` is a condition over vec_id. For each anchor and each of its ``positives`` best rows of the same label, the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "negatives")
    whole = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector")).filter(whole)
    rows = tables.write(rows.withColumn("row", F.monotonically_increasing_id()))
    count = rows.agg(F.count("*").alias("n"), F.count_if(anchors).alias("m")).first()
    sample = rows.filter(anchors).orderBy(F.xxhash64("vec_id", "vector"), "row").limit(FIT_ROWS).select("vector")
    centres = fit_centres(matrix(pa.array([r.vector for r in sample.collect()], pa.list_(pa.int64())), 1).astype(np.float64))

    def place(batches):
        for batch in batches:
            own = matrix(batch.column("vector"), centres.shape[1])
            near = (own.astype(np.float64) @ np.pad(centres, ((0, 0), (0, own.shape[1] - centres.shape[1]))).T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(near, pa.int64()))

    placed = rows.filter(anchors).mapInArrow(place, "vec_id long, label long, vector array<long>, row long, cluster long")
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count("*") / PART).alias("parts"))
    groups = max(1, -(-count["m"] // GROUP))
    # A row for each centre, of which there are at most CENTRES.
    placed = placed.join(F.broadcast(sizes), "cluster").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    placed = tables.write(placed.withColumn("g", F.pmod(F.xxhash64("cluster", "part"), F.lit(groups))).drop("parts"))
    size = min(BLOCK_MOST, max(BLOCK_LEAST, count["n"] // 64))
    blocks = max(1, -(-count["n"] // size))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks))).select("*", numbers(groups).alias("g"))
    spread = lambda df: df.select("*", numbers(blocks).alias("b"))

    def first(items: pa.Table, members: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("a_row", "row", "vec_id", "score")}
        if items.num_rows and members.num_rows:
            ids, own = items.column("vec_id").fill_null(_LAST_ID).to_numpy(), _numbers(members, "row")
            for at, shared in _clusters(items, members, centres):
                for m, best_ in zip(at, positives_of(shared, ids, _numbers(items, "row"), _numbers(items, "label"), own[at], _numbers(members, "label")[at], positives), strict=True):
                    for s, i, r in best_:
                        for c, v in zip(out, (int(own[m]), r, i, s), strict=True):
                            out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    met = dealt.groupBy("g", "b").cogroup(spread(placed).groupBy("g", "b")).applyInArrow(first, "a_row long, row long, vec_id long, score long")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row"))
    pairs = tables.write(met.withColumn("place", rank("a_row")).filter(F.col("place") <= positives))
    wanted = pairs.groupBy("a_row").agg(F.collect_set("score").alias("wanted"))  # at most ``positives`` scores
    seeking = placed.join(wanted, placed["row"] == wanted["a_row"]).drop("a_row")

    def second(items: pa.Table, members: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("a_row", "positive_score", "row", "vec_id", "score")}
        if items.num_rows and members.num_rows:
            ids, own = items.column("vec_id").fill_null(_LAST_ID).to_numpy(), _numbers(members, "row")
            bands = [{p: (-(-low * p // 100), high * p // 100) for p in x if -(-low * p // 100) <= high * p // 100} for x in members.column("wanted").to_pylist()]
            for at, shared in _clusters(items, members, centres):
                for m, found in zip(at, negatives_of(shared, ids, _numbers(items, "row"), _numbers(items, "label"), _numbers(members, "label")[at], [bands[m] for m in at], negatives), strict=True):
                    for p, best_ in found.items():
                        for s, i, r in best_:
                            for c, v in zip(out, (int(own[m]), p, r, i, s), strict=True):
                                out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = dealt.groupBy("g", "b").cogroup(spread(seeking).groupBy("g", "b")).applyInArrow(second, "a_row long, positive_score long, row long, vec_id long, score long")
    found = tables.write(found.withColumn("rank", rank("a_row", "positive_score")).filter(F.col("rank") <= negatives))
    id_ = lambda c: F.when(F.col(c) != _LAST_ID, F.col(c))
    left = pairs.select("a_row", id_("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    right = found.select("a_row", "positive_score", "rank", id_("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = left.join(right, ["a_row", "positive_score"]).join(placed.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id")), "a_row")
    out = tables.write(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    tables.drop_but(out)
    return out
