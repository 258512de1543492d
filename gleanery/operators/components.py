"""Connected components of an edge table, by alternating large-star and small-star rounds; at once or batch by batch.

First every node gives way to its smallest neighbour, which leaves little of stars and of dense parts for the rounds. A round is a ``min`` per node (summed on the map side) and one join. Nodes with a large share of all edges would make one
task of that join long: they are few, so they are joined by broadcast and their edges stay where they are. Each round is a
written table in the shared folder: lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.storage import Tables, Versions

#: A node with more edges than both is a hub: so many, and the given share of all. So there are at most 2 / HUB_SHARE hubs.
HUB_EDGES, HUB_SHARE = 50_000, 1e-4
#: Edges or nodes of a written partition, about.
PART_ROWS = 50_000


def _with_lows(edges: DataFrame, lows: DataFrame, all_edges: int) -> DataFrame:
    """``edges(a, b)`` with ``lows(a, m, n)``; the edges of hubs are joined where they are."""
    limit = max(HUB_EDGES, int(all_edges * HUB_SHARE))
    hubs = F.broadcast(lows.filter(F.col("n") > limit).select("a", "m"))
    rest = lows.filter(F.col("n") <= limit).select("a", "m")
    if all_edges <= limit:
        return edges.join(rest, "a")
    marked = edges.join(hubs, "a", "left")
    at_hubs = marked.filter("m is not null").select("a", "b", "m")
    return marked.filter("m is null").select("a", "b").join(rest, "a").select("a", "b", "m").unionByName(at_hubs)


def _star(edges: DataFrame, large: bool, all_edges: int) -> DataFrame:
    """Large: link each node's larger neighbours to its smallest one; small: the smaller ones and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    joined = _with_lows(both, low, all_edges)
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _chained(edges: DataFrame) -> DataFrame:
    """Nodes that keep the edges (a larger, b smaller) from being stars around the smallest node."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").select("v")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as so many rows need, but one for each core at least: small rounds make few files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(now: DataFrame, tables: Tables) -> DataFrame:
    """``now(a, b)``, a clean table, as stars around the smallest nodes."""
    # Done when no edge ends in a node that has a smaller neighbour, and no node has two: all are stars.
    while not _chained(now).isEmpty():
        n = now.count()
        # A large star has no more edges than there were, a small one at most twice as many.
        mid = tables.write(_sized(_star(now, True, n), n))
        then = tables.write(_sized(_star(mid, False, n), 2 * n))
        tables.drop(now, mid)
        now = then
    return now


def connected_components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node that is reachable.

    Nodes may be of any orderable type. Edges with a null end and loops are ignored, repeated edges are one; a node
    without an edge isn't listed.
    """
    tables = tables or Tables(edges.sparkSession, "components")
    now = tables.write(_clean(edges))
    # A node stands for itself or for its smallest neighbour, which is in its component; so edges between those who stand
    # for others join the same, and the smallest node of a component stands for itself.
    both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = now.count()
    lows = tables.write(_sized(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), 2 * n))
    half = _with_lows(now, lows, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    rest = tables.write(_sized(_clean(_with_lows(half, lows, n).select(F.col("b").alias("a"), F.col("m").alias("b"))), n))
    tables.drop(now)
    found = _stars(rest, tables).select(F.col("a").alias("__low"), F.col("b").alias("component"))
    return lows.join(found, F.col("m") == F.col("__low"), "left").select(F.col("a").alias("node"), F.coalesce("component", "m").alias("component"))


class LiveComponents:
    """Components that are kept between runs and grow with batches of edges.

    What is kept are the stars (node, component) and, apart, components that have since joined smaller ones. A batch looks
    its ends up, and only the graph of the labels found is solved; new nodes and changed labels are appended. Once the
    changed labels are more than ``fold`` of the stars, they are folded into them. A batch that was applied before changes
    nothing, and readers see whole batches.
    """

    def __init__(self, spark: SparkSession, path: str, node_type: str = "string", fold: float = 0.1):
        self.versions, self.fold = Versions(spark, path), fold
        self.stars, self.moves = f"node {node_type}, component {node_type}", f"was {node_type}, component {node_type}"

    def _read(self, state: dict) -> tuple[DataFrame, DataFrame]:
        return self.versions.get(state.get("stars", []), self.stars), self.versions.get(state.get("moves", []), self.moves)

    @staticmethod
    def _current(stars: DataFrame, moves: DataFrame) -> DataFrame:
        held = moves.withColumnRenamed("component", "__now")
        return stars.join(held, stars["component"] == held["was"], "left").select("node", F.coalesce("__now", "component").alias("component"))

    def read(self) -> DataFrame:
        """(node, component), component being the smallest node that is reachable."""
        return self._current(*self._read(self.versions.latest()[1]))

    def add(self, edges: DataFrame, batch: int) -> bool:
        """Whether the batch of ``edges(a, b)`` was new; ``batch`` is a growing number."""
        number, state = self.versions.latest()
        if batch <= state.get("batch", -1):
            return False
        tables = Tables(edges.sparkSession, "live")
        stars, moves = self._read(state)
        new = tables.write(_clean(edges))
        ends = tables.write(new.select(F.col("a").alias("node")).union(new.select("b")).distinct())
        found = self._current(stars.join(ends, "node", "left_semi"), moves)
        labels = tables.write(ends.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("fresh")))
        side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
        graph = new.join(side("a"), "a").join(side("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        joined = tables.write(connected_components(graph, tables).filter("node <> component"))
        # Fresh nodes are stars at once; labels that were kept before move, and so do those that had moved to them.
        fresh = labels.filter("fresh").select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        old = joined.join(labels.filter("fresh").select("node"), "node", "left_anti").select(F.col("node").alias("was"), "component")
        again = joined.withColumnsRenamed({"node": "__label", "component": "__now"})
        earlier = moves.join(again, moves["component"] == again["__label"], "left").select("was", F.coalesce("__now", "component").alias("component"))
        put = self.versions.put
        state = state | {"batch": batch, "stars": [*state.get("stars", []), put(fresh)], "moves": [put(earlier.union(old))]}
        stars, moves = self._read(state)
        if moves.count() > self.fold * stars.count() or len(state["stars"]) > 50:
            state = state | {"stars": [put(self._current(stars, moves))], "moves": []}
        self.versions.commit(number, state)
        tables.drop_but()
        return True
