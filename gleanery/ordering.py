"""Range buckets: the base of global orders, offsets and neighbours without a one-partition window."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import Tables

_FAN = 128


def range_bucket(df: DataFrame, key: str, rows_per_bucket: int = 4000, max_buckets: int = 16_000) -> Column:
    """A column that numbers ``df``'s rows by ranges of the integer ``key``; ranges hold about as many rows each.

    Bucket order is key order and equal keys share a bucket; null keys are in bucket 0. The cuts are approximate
    quantiles, at most ``max_buckets`` literals, searched in two steps.
    """
    n = df.count()
    k = min(max_buckets, max(1, math.ceil(n / rows_per_bucket)))
    cuts: list[int] = []
    if k > 1:
        at = [i / k for i in range(1, k)]
        got = df.select(F.percentile_approx(key, at, max(10_000, 20 * k)).alias("c")).first()["c"]
        cuts = sorted(set(got or []))
    if not cuts:
        return F.lit(0)
    value = F.col(key)
    below = lambda a: F.size(F.filter(a, lambda b: b < value))
    chunks = [cuts[i : i + _FAN] for i in range(0, len(cuts), _FAN)]
    heads = F.array(*[F.lit(c[0]) for c in chunks])
    head = below(heads)
    inside = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), F.greatest(head, F.lit(1)))
    return F.when(value.isNull() | (head == 0), F.lit(0)).otherwise((head - 1) * _FAN + below(inside))


class Ranges:
    """Rows in ranges of a composite order, as a written table: the base of ranks within ``by``.

    Spark cuts (by, order) at sampled quantiles and sorts each range, so a ``by`` with a third of all rows is spread over a
    third of the ranges. A row remembers its range and its place there. Ranks need one row for each range and ``by``
    besides: its rows are counted and the counts summed up, and no window sees the rows themselves. The number of ranges
    is the session's number of shuffle partitions; small ones are merged.

    Null ``by`` is a value of its own, equal rows get ranks in any order.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column], tables: Tables | None = None):
        self.by, self.at = list(by), "__at"
        while self.at in df.columns:
            self.at += "_"
        keys = [*(F.col(c).asc_nulls_first() for c in by), *order]
        parted = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        # The id counts a range's rows in order; the range stands above bit 33.
        self.rows = (tables or Tables(df.sparkSession, "ranges")).write(parted.withColumn(self.at, F.monotonically_increasing_id()))

    def _counts(self) -> DataFrame:
        """range, by, n, first place, and the number of the by's rows in earlier ranges."""
        number = F.shiftright(self.at, 33).alias("__range")
        counts = self.rows.groupBy(*self.by, number).agg(F.count("*").alias("__n"), F.min(self.at).alias("__first"))
        earlier = Window.partitionBy(*self.by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))

    def rank(self, name: str, total: str | None = None) -> DataFrame:
        """The rows with their rank within ``by``, from 1, and with the number of rows there if ``total`` names a column."""
        counts = self._counts()
        if total:
            counts = counts.withColumn("__total", F.sum("__n").over(Window.partitionBy(*self.by)))
        counts = counts.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(self.by)})
        same = F.shiftright(self.at, 33) == F.col("__range")
        for i, c in enumerate(self.by):
            same = same & F.col(c).eqNullSafe(F.col(f"__c{i}"))
        found = self.rows.join(counts, same).withColumn(name, (F.col(self.at) - F.col("__first") + F.col("__before") + 1).cast("long"))
        names = [c for c in self.rows.columns if c not in (self.at, name)]
        return found.select(*(F.col(f"`{c}`") for c in names), name, *([F.col("__total").alias(total)] if total else []))


def has_neighbour(rows: DataFrame, by: Sequence[str], at: str, limit: int) -> DataFrame:
    """The rows that have another row of the same ``by`` at most ``limit`` away in the integer ``at``; null ``at`` has none.

    Buckets are as wide as the limit, so two rows of one bucket are neighbours. A lone row is compared with what the
    buckets beside its own send over their edges: the last value of the one before, the first of the one after.
    """
    dated = rows.filter(F.col(at).isNotNull()).withColumn("__b", F.floor(F.col(at) / max(1, limit)))
    own = dated.groupBy(*by, "__b").agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    none = F.lit(None).cast("long")
    sent = F.explode(
        F.array(
            F.struct(F.col("__b").alias("b"), F.col("n").alias("n"), none.alias("before"), none.alias("after")),
            F.struct((F.col("__b") + 1).alias("b"), F.lit(0).cast("long").alias("n"), F.col("hi").cast("long").alias("before"), none.alias("after")),
            F.struct((F.col("__b") - 1).alias("b"), F.lit(0).cast("long").alias("n"), none.alias("before"), F.col("lo").cast("long").alias("after")),
        )
    )
    edges = own.select(*by, sent.alias("x")).groupBy(*by, F.col("x.b").alias("__b")).agg(F.sum("x.n").alias("__n"), F.max("x.before").alias("__before"), F.min("x.after").alias("__after"))
    edges = edges.filter("__n > 0").withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(by)}).withColumnRenamed("__b", "__e")
    same = F.col("__b") == F.col("__e")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__c{i}"))
    near = (F.col("__n") > 1) | (F.col(at) - F.col("__before") <= limit) | (F.col("__after") - F.col(at) <= limit)
    return dated.join(edges, same).filter(near).select(*(F.col(f"`{c}`") for c in rows.columns))
