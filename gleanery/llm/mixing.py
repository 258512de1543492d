"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Sources, by code point with null last, have weights that repeat; targets share all words by weight,
each capped at ``most`` times its source, the excess dealt out again by weight (water filling). A source's rate
r = target / size gives every document floor(r) whole copies for certain. For the fraction f that is left, documents are
ranked by (u / (1 - u)) / (p / (1 - p)), the random odds of a document over its inclusion odds, where u is a hash and
p its inclusion probability, proportional to ``weight_col`` (alike without one) times its size to the power of
``size_power``. A document whose p would reach 1 is certain and comes first; the p of the others grow so that the expected
words stay the source's, until no more become certain. The lowest ranks are taken until the source's words are reached.
Documents longer than the words that are still missing are set aside and the cut is made again
among the rest, round by round, until none fits; then one closing document, the one whose size is nearest to what is
missing, is added if that lessens the gap. Documents are taken whole.

The ranks of one source are summed in two steps, over buckets of the rank and inside a bucket, so that a source with a
third of all rows is spread over many tasks. What is dealt out at the end is one row per source: its cuts, one for each
round, and a closing key.

Edge cases: null or blank text has size 0 and takes 0; null source is a source, last; rows with equal doc_id and equal
text are taken together, as are null ids with equal texts; a null or negative weight is 0, and such rows are taken last; if
all weights of a source are 0 they count as equal; an empty table gives an empty result; other columns pass through
untouched, but for columns that have the names of the five made ones, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.columns import packed, quoted, unpacked
from gleanery.storage import Tables

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 2000
OUT = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, tables: Tables | None = None) -> DataFrame:
    """Per source: source, source_size, n, target. ``sizes(source, size)`` has a row per document.

    A round caps the sources whose share passes the cap; two numbers go through the driver each round.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1  # a row per source
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    per = (tables or Tables(sizes.sparkSession, "sources")).write(per)
    whole = per.agg(F.sum("source_size")).first()[0] or 0
    cap, level = F.col("source_size") * most, 0.0
    while True:
        free = F.col("weight") * F.lit(level) <= cap
        capped, open_weight = per.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        now = (whole - (capped or 0)) / open_weight if open_weight else level
        if now <= level:
            break
        level = now
    return per.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))).drop("weight")


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; below 0 for certain documents."""
    return F.when(p >= 1, u - 1).otherwise(_odds(u) / _odds(F.greatest(p, F.lit(1e-12))))


def inclusion_rates(sizes: DataFrame, wanted: DataFrame, tables: Tables) -> DataFrame:
    """(s, rate) per source: p = rate * wish, certain from 1 on, so that p * size sums up to the source's ``missing`` words.

    ``sizes(source, size, wish)`` has a row per document, ``wanted(src, missing)`` one per source. A round is one sum per source.
    """
    rates = tables.write(wanted.select(F.col("src").alias("s"), "missing", F.lit(0.0).alias("rate")))
    while True:
        sure = F.col("rate") * F.col("wish") >= 1
        sums = sizes.join(rates.select("s", F.col("rate")), F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(F.when(sure, F.col("size")).otherwise(F.lit(0))).alias("sure"), F.sum(F.when(~sure, F.col("wish") * F.col("size")).otherwise(F.lit(0.0))).alias("open"),
        ).withColumnRenamed("s", "t")
        grown = F.when(F.col("open") > 0, (F.col("missing") - F.col("sure")) / F.col("open"))
        now = tables.write(rates.join(sums, F.col("s").eqNullSafe(F.col("t")), "left").select("s", "missing", F.greatest("rate", F.coalesce(grown, F.lit(0.0))).alias("rate"), (grown > F.col("rate") * (1 + 1e-9)).alias("more")))
        tables.drop(rates)
        rates = now.drop("more")
        rates._gleanery_path = now._gleanery_path
        if now.filter("more").isEmpty():
            return rates


def _cuts(ranked: DataFrame) -> DataFrame:
    """(s, start, cut, limit, got) per source: the last key up to which all words are at most ``limit``, and those words."""
    sums = ranked.groupBy("s", "bucket").agg(F.sum("words").alias("sum"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("s").alias("t"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    ranked = ranked.join(sums, F.col("s").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("b")))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("s", "bucket").orderBy("order"))
    fits = ranked.withColumn("upto", upto).filter("upto <= limit")
    return fits.groupBy("s").agg(F.first("start").alias("start"), F.max("order").alias("cut"), F.first("limit").alias("limit"), F.max("upto").alias("got"))


def _taken(rounds: Column, order: Column, size: Column) -> Column:
    """Whether some round took the document: its key is in the round's range and its size within the round's limit."""
    return F.coalesce(F.exists(rounds, lambda r: (order >= r["start"]) & (order <= r["cut"]) & (size <= r["limit"])), F.lit(False))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, weight_col: str | None = None, size_power: float = 0.0) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_copies and mix_taken, which replace columns of these names."""
    tables = Tables(docs.sparkSession, "mix")
    columns = [c for c in docs.columns if c.lower() not in OUT]
    chance = quoted(weight_col).cast("double") if weight_col else F.lit(1.0)
    docs = docs.select(packed(docs), "doc_id", "text", "source", chance.alias("chance"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") + 0.5) / float(2**53)
    wish = F.greatest(F.coalesce("chance", F.lit(0.0)), F.lit(0.0))
    size = F.col("__size")
    marked = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__u", u).withColumn("__wish", wish * (F.pow(size.cast("double"), F.lit(size_power)) if size_power else F.lit(1.0)))
    sizes = tables.write(marked.select("doc_id", "source", F.col("__size").alias("size"), F.col("__u").alias("u"), F.col("__wish").alias("wish")))
    per = source_targets(sizes.select("source", "size"), weights, most, tables).withColumnRenamed("source", "src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-12).cast("long")
    per = per.withColumn("whole", whole).withColumn("part", F.greatest(rate - whole, F.lit(0.0)))
    per = per.withColumn("missing", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # Where no document of a source has a weight, all have the same.
    some = sizes.groupBy("source").agg((F.max("wish") > 0).alias("some"))
    per = tables.write(per.join(some, F.col("src").eqNullSafe(F.col("source")), "left").drop("source"))
    flat = per.filter("not some").select(F.col("src").alias("s"))
    if not flat.isEmpty():
        sizes = tables.write(sizes.join(flat.withColumn("flat", F.lit(True)), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("wish", F.when(F.col("flat"), F.lit(1.0)).otherwise(F.col("wish"))).drop("s", "flat"))
    rates = inclusion_rates(sizes, per.select("src", "missing"), tables)
    per = tables.write(per.join(rates.select("s", "rate"), F.col("src").eqNullSafe(F.col("s"))).drop("s"))

    p = F.col("rate") * F.col("wish")
    ranked = sizes.join(per, F.col("src").eqNullSafe(F.col("source"))).filter("part > 0 and size > 0").drop("source").withColumn("p", p).withColumn("rank", _rank(F.col("u"), F.col("p")))
    level = F.col("rank") * _odds(F.least(F.greatest("part", F.lit(1e-12)), F.lit(1 - 1e-12)))  # near the odds of u, so nearly even buckets
    count = F.ceil(F.col("n") / BUCKET_ROWS)
    bucket = F.when(F.col("p") >= 1, F.floor(F.col("rank") * count)).otherwise(F.floor(level / (1 + level) * count))
    ranked = ranked.withColumn("bucket", bucket).select("src", "doc_id", "size", "rank", "bucket")
    order = F.struct("rank", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id")).alias("order")
    # Rows with equal keys are peers and go together: size is a row's, words are all peers'.
    ranked = tables.write(ranked.groupBy("src", order, "bucket").agg(F.max("size").alias("size"), F.sum("size").alias("words")))
    rounds, wanted = [], per.filter("part > 0").select(F.col("src").alias("s"), F.col("missing").alias("limit"), F.lit(None).cast(ranked.schema["order"].dataType).alias("cut"))
    same = F.col("src").eqNullSafe(F.col("s"))
    while True:
        later = ranked.join(wanted, same).filter("(cut is null or order > cut) and words <= limit")
        starts = tables.write(later.groupBy("s").agg(F.min("order").alias("start"), F.first("limit").alias("limit")))
        if starts.isEmpty():
            break
        now = tables.write(_cuts(ranked.join(starts, same).filter("order >= start and size <= limit")))
        rounds.append(now)
        wanted = now.select("s", (F.col("limit") - F.col("got")).alias("limit"), "cut")
    every = per.select("src", "missing").withColumn("rounds", F.array().cast("array<struct<start:struct<rank:double,doc_id:bigint>,cut:struct<rank:double,doc_id:bigint>,limit:double>>")).withColumn("got", F.lit(0))
    if rounds:
        made = reduce(DataFrame.union, rounds).groupBy("s").agg(F.collect_list(F.struct("start", "cut", "limit")).alias("rounds"), F.sum("got").alias("got"))
        every = per.select("src", "missing").join(made, same, "left").drop("s")
    every = tables.write(every.select(F.col("src").alias("s"), "rounds", (F.col("missing") - F.coalesce("got", F.lit(0))).alias("gap")))
    off = F.abs(F.col("gap") - F.col("words"))
    closing = ranked.join(every, same).filter(~_taken(F.col("rounds"), F.col("order"), F.col("size"))).filter(off < F.col("gap")).groupBy("src").agg(F.min(F.struct(off.alias("off"), "order")).alias("last"))
    every = every.join(closing, same, "left").select("s", "rounds", F.col("last.order").alias("closing"))
    plan = tables.write(per.join(every, same, "left").select("src", "source_size", "target", "whole", "part", "some", "rate", "rounds", "closing"))
    tables.drop_but(plan)
    return _apply(marked, plan, unpacked(columns))


def _apply(marked: DataFrame, plan: DataFrame, columns: list[Column]) -> DataFrame:
    c = lambda name: F.col("__plan_" + name)
    plan = plan.select([F.col(x).alias(f"__plan_{x}") for x in plan.columns])
    out = marked.join(plan, c("src").eqNullSafe(F.col("source")))
    p = c("rate") * F.when(c("some"), F.col("__wish")).otherwise(F.lit(1.0))
    order = F.struct(_rank(F.col("__u"), p).alias("rank"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))
    extra = (c("part") > 0) & (F.col("__size") > 0) & (_taken(c("rounds"), order, F.col("__size")) | F.coalesce(order == c("closing"), F.lit(False)))
    copies = F.when(F.col("__size") > 0, c("whole") + F.when(extra, 1).otherwise(0)).otherwise(F.lit(0))
    made = (F.col("__size"), c("source_size"), c("target"), copies.cast("long"), (copies * F.col("__size")).cast("long"))
    return out.select("row", *[x.alias(n) for x, n in zip(made, OUT, strict=True)]).select(*columns, *OUT)


def mixture(docs: DataFrame, weight_col: str | None = None, **how) -> DataFrame:
    """The mix itself: each row as many times as ``mix`` takes it, with the columns of ``docs``, whatever their names."""
    chance = quoted(weight_col) if weight_col else F.lit(None)
    mixed = mix(docs.select("doc_id", "text", "source", chance.alias("chance"), packed(docs, "whole_row")), weight_col="chance" if weight_col else None, **how)
    copies = mixed.filter("mix_copies > 0").select("whole_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.select(unpacked(docs.columns, "whole_row"))
