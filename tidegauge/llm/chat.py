"""Chat formatting of reply trees.

Messages form trees (a parent id each). Iterative self-joins double the stretch of ancestors that every message
knows until each reaches its root; the messages nobody replies to are the leaves, and a leaf's stretch is a
root-to-leaf path. Its messages are enumerated for chosen leaves alone, by the same stretches in turn. Paths of a tree are ranked by score, the best ``branches`` are chosen, and each is formatted as
one conversation: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.

Inside roles and texts a backslash is written twice and ``<|`` as ``<\\|``; inside roles a line end is written
``\\n``. So control strings stand only where the template puts them, and reading gives back every character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm._shared import checkpointed, written

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """The inverse of both: doubled backslashes part the text, what is between holds single escapes."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """``tree_id, node, parent, role, text, score`` of ``conversations(conv_id, turn, role, text)``: each row replies to the
    row before it, by turn, then role, then text. Null roles and texts are empty, a null turn comes first."""
    rows = conversations.select(
        F.col("conv_id").alias("tree_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    node = F.row_number().over(Window.partitionBy("tree_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree_id", node.alias("node"), "role", "text", F.lit(0.0).alias("score")).select(
        "tree_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", "score"
    )


def _stretches(messages: DataFrame) -> list[DataFrame]:
    """``tree_id, node, top, depth, score`` for stretches of 1, 2, 4 ... messages: the ancestor above the stretch that ends
    in a node (null once it holds the root), how many messages it has and the sum of their scores.

    A stretch is four numbers however long it is. A round joins each stretch with the one above it, so trees of depth d
    take log2(d) + 1 rounds; a message below a loop of ancestors never gets a null top.
    """
    nodes = messages.select("tree_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    real = nodes.select(F.col("tree_id").alias("t"), F.col("node").alias("n"))
    up = nodes.join(real, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    stretch = checkpointed(up.select("tree_id", "node", F.col("n").alias("top"), F.lit(1).cast("long").alias("depth"), "score"))
    levels, open_rows = [stretch], stretch.where("top is not null").count()
    while open_rows:
        above = stretch.select(F.col("tree_id").alias("t"), F.col("node").alias("n"), F.col("top").alias("next"), F.col("depth").alias("deep"), F.col("score").alias("more"))
        # only stretches that have not reached their root are joined; every top exists, so none is lost
        grown = stretch.where("top is not null").join(above, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("top") == F.col("n")))
        stretch = checkpointed(
            stretch.where("top is null").union(
                grown.select("tree_id", "node", F.col("next").alias("top"), (F.col("depth") + F.col("deep")).alias("depth"), (F.col("score") + F.col("more")).alias("score"))
            )
        )
        levels.append(stretch)
        still = stretch.where("top is not null").count()
        if still == open_rows:  # only loops are left: every other stretch has grown towards its root
            break
        open_rows = still
    return levels


def _leaves(levels: list[DataFrame]) -> DataFrame:
    """``tree_id, leaf, depth, score`` of every root-to-leaf path."""
    replied = levels[0].where("top is not null").select(F.col("tree_id").alias("t"), F.col("top").alias("n")).distinct()
    whole = levels[-1].where("top is null").select("tree_id", F.col("node").alias("leaf"), "depth", "score")
    return whole.join(replied, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n")), "left_anti")


def _steps(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``chosen`` (tree_id, leaf, depth and more) with a row per message of its path: ``node`` and ``at``, 0 at the root.

    Each level's stretches, longest first, add to every node found the ancestor above its stretch: a path of d messages
    is d rows, and never a list.
    """
    found = chosen.withColumn("node", F.col("leaf")).withColumn("at", F.col("depth") - 1)
    kept = [c for c in found.columns if c not in ("node", "at")]
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].where("top is not null").select(F.col("tree_id").alias("t"), F.col("node").alias("n"), "top")
        both = F.array(F.struct("node", "at"), F.when(F.col("top").isNotNull(), F.struct(F.col("top").alias("node"), (F.col("at") - 2**k).alias("at"))))
        found = (
            found.join(jump, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left")
            .select(*kept, F.explode(both).alias("step"))
            .where("step is not null")
            .select(*kept, "step.node", "step.at")
        )
    return found


def tree_paths(messages: DataFrame) -> DataFrame:
    """``tree_id, leaf, path, score``: every root-to-leaf path (array of nodes) and the sum of its scores.

    A parent that does not exist makes its message a root; a message whose ancestors form a loop has no root and no
    path. Only ids and scores travel, not texts; paths are lists in this result alone.
    """
    levels = _stretches(messages)
    steps = _steps(_leaves(levels), levels)
    listed = steps.groupBy("tree_id", "leaf", "score").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("path"))
    return listed.select("tree_id", "leaf", F.col("path.node").alias("path"), "score")


def format_trees(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """``tree_id, branch, score, formatted, spans`` for the ``branches`` best paths of each tree: the formatted
    conversation and the loss spans (start, end; code points of ``formatted``) of the texts of role ``learn``.

    Equal scores: the longer path, then the smaller leaf. Node ids must be unique in a tree.
    """
    levels = _stretches(messages)
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col("score").desc(), F.col("depth").desc(), "leaf"))
    chosen = _leaves(levels).withColumn("branch", rank).where(F.col("branch") <= branches)
    steps = _steps(chosen, levels).select(F.col("tree_id").alias("t"), "branch", F.col("score").alias("total"), "at", F.col("node").alias("n"))
    turns = steps.join(
        messages.select("tree_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")),
        F.col("t").eqNullSafe(F.col("tree_id")) & (F.col("n") == F.col("node")),
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = turns.select("tree_id", "branch", "total", "at", (F.col("role") == learn).alias("learnt"), head.alias("head"), escape(F.col("text")).alias("body"))
    listed = parts.groupBy("tree_id", "branch", "total").agg(F.array_sort(F.collect_list(F.struct("at", "learnt", "head", "body"))).alias("turns"))
    # running offsets: where each turn's body starts and ends
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["n"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).cast("long").alias("n"),
            F.when(
                t["learnt"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["n"] + F.length(t["head"])).cast("long").alias("start"),
                            (a["n"] + F.length(t["head"]) + F.length(t["body"])).cast("long").alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return listed.select("tree_id", "branch", F.col("total").alias("score"), text.alias("formatted"), ends.alias("spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>")
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END) - 1)
            ).alias("text"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from ``formatted`` and ``spans``."""
    learnt = F.array_join(
        F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        formatted.select(F.col("tree_id").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), learnt.alias("learnt"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(joined, 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``format_trees`` of linear conversations; the messages are stored once, their texts join the chosen paths."""
    return format_trees(written(linear_messages(conversations), "messages"))
