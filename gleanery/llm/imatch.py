"""I-Match fingerprints with randomised lexicons, with DataFrame functions only.

The base lexicon holds all terms whose inverse document frequency, as a share of the greatest possible ln N, is in a band:
terms of nearly every document say nothing, rare ones break on any edit. A term is a run of letters and digits in lower
case, known by 63 bits of its hash. Its random subsets are the randomised lexicons: for s up to 5 the 2**s classes of equal
first s bits of the hash, and below each of the 32 classes of s = 5 those with 1, 2, 3 and 4 zeros in the last bits, that is
rates from 1/2 to 1/512. A document's part for a lexicon is the hash of its sorted distinct terms of that
lexicon, and none if it has no such term. Small lexicons of long documents and large ones of short documents hold few
terms, so that a part can outlive an edit.

The fingerprint joins all parts. Likeness of two fingerprints is the share of equal parts among those that either has.
A text without terms of the base lexicon has one part of 64 bits, the hash of the whole text, and is like its equals only.

Frequencies are counted over all documents. The band's upper end bounds the base lexicon: a term of it is in more than
N**(1 - upper) documents, so there are fewer than N**upper times the mean number of terms of a document. Catalyst broadcasts
it while it is small and joins it by shuffle beyond. The next document is found by range buckets of the ids: a bucket gets
a copy of the first row of the bucket after it, so one shuffle of the texts serves and no window spans the table.

Edge cases: a null text is an empty one; null ids come first, equal ids are ordered by text; repeated rows follow each
other; the last document is followed by the first, a single one by itself; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.ordering import range_bucket
from gleanery.storage import Tables

#: Band of ln(N / df) / ln N.
BAND = (0.1, 0.45)
#: First bits that make classes, and last bits that narrow them.
CLASS_BITS, NARROW = 5, 4


def terms(text: Column, tag: int = 0) -> Column:
    """Distinct terms of a text, as hashes with ``tag`` in the lowest bit."""
    term = lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(tag))
    return F.array_remove(F.array_distinct(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), term)), term(F.lit("")))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, key, next_key, doc_id, text, next_text): each row with the row after it in doc_id order, the last with the first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("bucket", range_bucket(docs, "doc_id", 1000))
    first = docs.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    every = Window.orderBy("bucket")  # a row per bucket, bounded in number
    places = docs.select("bucket").distinct().withColumn("to", F.lag("bucket").over(every))
    places = places.withColumn("to", F.coalesce("to", F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    copies = first.join(places, "bucket").select("f.doc_id", "f.text", F.col("to").alias("bucket"), F.col("bucket").alias("home"))
    rows = docs.withColumn("home", F.lit(None).cast("int")).unionByName(copies)
    w = Window.partitionBy("bucket").orderBy(F.col("home").isNotNull(), F.col("doc_id").asc_nulls_first(), "text")
    key = lambda b, n: F.shiftleft(b.cast("long"), 40) + n
    place = F.row_number().over(w)
    after = F.lead("home").over(w)
    rows = rows.withColumn("key", key(F.col("bucket"), place)).withColumn("next_text", F.lead("text").over(w))
    rows = rows.withColumn("next_key", F.when(after.isNull(), F.col("key") + 1).otherwise(key(after, F.lit(1))))
    return rows.filter("home is null").select("bucket", "key", "next_key", "doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(other, half))


def with_parts(rows: DataFrame, tag: int, out: str) -> DataFrame:
    """``rows`` with ``out``, a part (15 bits) per lexicon, null where the terms of columns ``tag``_0, ``tag``_1, ... have none of it.

    The columns are the classes of the longest beginning, each sorted; the hash of several columns is that of their concatenation.
    """
    one = lambda cs: F.when(F.greatest(*map(F.size, cs), F.lit(0)) > 0, F.xxhash64(*cs).bitwiseAND(F.lit(0x7FFF)).cast("short"))
    inside = [f"{tag}_{k}" for k in range(1 << CLASS_BITS)]
    wide = [inside[k : k + n] for n in (len(inside) >> s for s in range(CLASS_BITS + 1)) for k in range(0, len(inside), n)]
    rows, names = rows.withColumn(f"__{out}", F.array(*map(one, wide))), [f"__{out}"]
    for bit in range(1, NARROW + 1):
        # A projection of its own for each bit, so that a lexicon is filtered once and not once for every narrower one.
        mask = F.lit(1 << bit)
        rows = rows.withColumns({c: F.filter(c, lambda h: h.bitwiseAND(mask) == 0) for c in inside})  # noqa: B023
        rows, names = rows.withColumn(f"__{out}_{bit}", F.array(*(one([c]) for c in inside))), [*names, f"__{out}_{bit}"]
    return rows.withColumn(out, F.concat(*names)).drop(*names, *inside)


def fingerprint(p: Column, whole: Column) -> Column:
    said = F.array_join(F.transform(p, lambda x: F.when(x.isNull(), F.lit("-" * 4)).otherwise(F.lpad(F.hex(x), 4, "0"))), "")
    return F.when(whole.isNull(), said).otherwise(F.lpad(F.hex(whole), 16, "0"))


def likeness(a: Column, whole_a: Column, b: Column, whole_b: Column) -> Column:
    """0 if one has terms and the other has not."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)).cast("int")))
    said = F.filter(pairs, lambda x: x.isNotNull())
    share = F.aggregate(said, F.lit(0), lambda n, x: n + x) / F.greatest(F.size(said), F.lit(1))
    return F.when(whole_a.isNull() & whole_b.isNull(), share).otherwise(F.coalesce((whole_a == whole_b).cast("double"), F.lit(0.0)))


def lexicon(docs: DataFrame, n: int, band: tuple[float, float] = BAND) -> DataFrame:
    """(h): terms of ``docs(text)`` with an inverse document frequency in the band, of ``n`` documents."""
    counts = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    share = F.log(F.lit(float(n)) / F.col("df")) / F.log(F.lit(float(max(n, 2))))
    return counts.filter(share.between(*band)).select("h")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the columns of the query, for its text, its edited text and the next row's."""
    tables = Tables(docs.sparkSession, "imatch")
    base = tables.write(lexicon(docs, docs.count(), band).withColumn("inside", F.lit(True)))
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    about = F.struct("next_key", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("ha"), F.xxhash64("edited").alias("he"))
    # The first element of each row, 0, carries what is known of the row; the others are terms of the text (even) and the edited text (odd).
    rows = rows.select("bucket", "key", about.alias("about"), F.concat(F.array(F.lit(0).cast("long")), terms(F.col("text")), terms(F.col("edited"), 1)).alias("all"))
    each = rows.select("bucket", "key", "about", F.posexplode("all").alias("pos", "v"))
    each = each.select("bucket", "key", F.when(F.col("pos") == 0, F.col("about")).alias("about"), "pos", "v", F.col("v").bitwiseAND(F.lit(-2)).alias("h"))
    kept = each.join(base, "h", "left").filter("pos = 0 or inside")
    kind = F.shiftrightunsigned("h", 64 - CLASS_BITS).bitwiseOR(F.shiftleft(F.col("v").bitwiseAND(F.lit(1)), CLASS_BITS)).cast("int")
    kept = kept.select("bucket", "key", "about", "h", F.when(F.col("pos") > 0, kind).alias("kind"))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("h")))).alias(f"{k >> CLASS_BITS}_{k & (1 << CLASS_BITS) - 1}")
    found = kept.groupBy("bucket", "key").agg(F.first("about", ignorenulls=True).alias("about"), *map(of, range(2 << CLASS_BITS)))
    made = with_parts(with_parts(found, 0, "pa"), 1, "pe")
    none = lambda p, h: F.when(F.col(p)[0].isNull(), F.col(f"about.{h}"))
    made = tables.write(made.select("key", "about.next_key", "about.doc_id", "about.n_chars", "about.edited_sha256", "pa", "pe", none("pa", "ha").alias("wa"), none("pe", "he").alias("we")))
    tables.drop(base)
    other = made.select(F.col("key").alias("next_key"), F.col("pa").alias("pn"), F.col("wa").alias("wn"))
    c = F.col
    return made.join(other, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(c("pa"), c("wa")).alias("fingerprint"), fingerprint(c("pe"), c("we")).alias("edited_fingerprint"),
        likeness(c("pa"), c("wa"), c("pe"), c("we")).alias("near_edited"), likeness(c("pa"), c("wa"), c("pn"), c("wn")).alias("near_next"),
    )
