"""Chat formatting of reply trees, with DataFrame functions only.

``paths`` enumerates root-to-leaf paths by iterative self-joins: jump pointers double each round, so a tree of depth d
takes about log2(d) rounds. ``rank_paths`` keeps each tree's best branches by mean score. ``format_paths`` writes a kept
path as one conversation and its loss mask (spans of assistant text). ``read_back`` parses the output alone.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``, a newline in a role ``<\\n``; so no control string can be spelled by a text, and all is restored.

Edge cases: null text and role are empty strings; rows with the same turn are ordered by role, then text; all rows of a
null conv_id are one conversation; an empty table gives no rows; extra columns are not read. A conversation becomes one
row, so its length bounds a row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.storage import Tables

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: node = place in turn order, parent = the node before."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return nodes.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"),
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
    )


def paths(spark: SparkSession, nodes: DataFrame, tables: Tables) -> DataFrame:
    """(tree, leaf, node, up): every node on the path from each leaf to its root; ``up`` steps above the leaf.

    Only ids take part. A parent that is not in the tree ends the path; a cycle has no leaf and gives none.
    """
    ids = nodes.select("tree", "node", "parent")
    inner = ids.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    found = ids.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    known = ids.select("tree", F.col("node").alias("parent"))
    jump = ids.filter("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to"))
    step, found, jump = 1, tables.write(found), tables.write(jump)
    while not jump.isEmpty():
        more = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        wider = tables.write(found.union(more))
        if wider.filter(F.col("up") >= step).isEmpty():  # only cycles are left
            return wider
        far = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        longer = tables.write(jump.join(far, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")))
        tables.drop(found, jump)
        found, jump, step = wider, longer, step * 2
    return found


def rank_paths(nodes: DataFrame, found: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best branches of each tree: highest mean score, then smallest leaf."""
    scores = found.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    w = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def format_paths(nodes: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree, leaf, conv_id, formatted, loss_starts, loss_sizes): offsets are code points of ``formatted``."""
    turns = found.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(nodes, ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("whole", F.concat("head", "body", F.lit(f"{END}\n")))
    w = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("whole")).over(w), F.lit(0)) + F.length("head"))
    told = F.col("role") == "assistant"
    sort = lambda c: F.transform(F.array_sort(c), lambda x: x["v"])
    order = (-F.col("up")).alias("k")
    return turns.groupBy("tree", "leaf").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_join(sort(F.collect_list(F.struct(order, F.col("whole").alias("v")))), "").alias("formatted"),
        sort(F.collect_list(F.when(told, F.struct(order, F.col("start").alias("v"))))).alias("loss_starts"),
        sort(F.collect_list(F.when(told, F.struct(order, F.length("body").alias("v"))))).alias("loss_sizes"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text, parsed from the formatted string and the mask: the digest columns of the query."""
    parts = F.split("formatted", r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)
    body = lambda p: F.left(p, F.length(p) - F.lit(len(END) + 1))
    role = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform(parts, lambda p: F.concat(unescape_role(role(p)), F.lit("\n"), unescape(body(F.substr(p, F.length(role(p)) + 2))), F.lit("\n")))
    spans = F.zip_with("loss_starts", "loss_sizes", lambda a, n: unescape(F.substr(F.col("formatted"), (a + 1).cast("int"), n.cast("int"))))
    out = formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(spans, "").alias("loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_conversations(conversations: DataFrame, keep: int = 1) -> DataFrame:
    """Each tree's best branches as formatted conversations."""
    spark = conversations.sparkSession
    tables = Tables(spark, "trees")
    nodes = tables.write(chain(conversations))
    found = paths(spark, nodes, tables)
    return format_paths(nodes, found, rank_paths(nodes, found, keep))
