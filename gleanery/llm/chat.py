"""Chat formatting of reply trees, in DataFrame operations only.

Iterative self-joins double the jump of every message to its ancestors, which
gives each root-to-leaf path its depth and score in a number of joins that grows
with the logarithm of the longest path. The best-scored leaves of a tree are
chosen, the joins are walked back to list the messages of the chosen paths, and
each path is formatted as one conversation with a loss mask over the assistant's
texts.

Cases: a message whose parent isn't there is a root; messages in a circle have
none and are left out; of repeated message ids the smallest row stays. Null
texts and roles are empty. An empty table gives an empty result. A conversation
is one row of the result, so its messages meet there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

START, STOP = "<|im_start|>", "<|im_end|>\n"
# Control strings of common templates; texts must not hold one unescaped.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """Every backslash doubled, and one put behind the first sign of a control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def _role(role: Column) -> Column:
    """A role on one line, reversibly."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, id and nth of the messages on each tree's ``best`` paths.

    ``messages``: tree, id, parent, score. A path's score is its mean, ties go
    to the smaller leaf.
    """
    nodes = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("x")).select("tree", "id", "x.*")
    there = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    now = nodes.join(there, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("jump"), F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    now = stored(now, "jumps")
    levels, most = [now], max(1, now.count())
    while len(levels) <= math.ceil(math.log2(most)) + 1 and now.where("jump is not null").limit(1).count():
        on = now.select("tree", F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("depth").alias("more"), F.col("total").alias("extra"))
        moved = now.where("jump is not null").join(on, ["tree", "jump"]).select("tree", "id", F.col("far").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("extra")).alias("total"))
        now = stored(now.where("jump is null").unionByName(moved), "jumps")
        levels.append(now)
    rooted = now.where("jump is null")
    leaves = rooted.join(nodes.select("tree", F.col("parent").alias("id")).where("id is not null").distinct(), ["tree", "id"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "id")
    path = leaves.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best).select("tree", F.col("id").alias("leaf"), "id", F.col("depth").alias("nth"))
    for k in reversed(range(len(levels) - 1)):
        up = levels[k].where("jump is not null").select("tree", "id", "jump")
        path = stored(path.unionByName(path.join(up, ["tree", "id"]).select("tree", "leaf", F.col("jump").alias("id"), (F.col("nth") - (1 << k)).alias("nth"))), "path")
    return path


def formatted(turns: DataFrame) -> DataFrame:
    """tree, leaf, formatted and mask from tree, leaf, nth, role and text.

    ``mask`` has an entry (turn, start, end) for each turn, places in code points
    of ``formatted``: of the turn, and of what the loss counts (empty unless the
    role is assistant).
    """
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    row = F.struct(F.col("nth"), _role(role).alias("role"), text.alias("text"), (role == "assistant").alias("loss"))
    grouped = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    piece = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(STOP))
    sizes = F.transform("turns", lambda t: F.struct((F.char_length(t["role"]) + len(START) + 1).alias("head"), F.char_length(t["text"]).alias("body"), t["loss"].alias("loss")))
    empty = F.expr("struct(0L as at, cast(array() as array<struct<turn:bigint,start:bigint,end:bigint>>) as out)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["head"]
        end = start + x["body"]
        own = F.struct(acc["at"].alias("turn"), start.alias("start"), F.when(x["loss"], end).otherwise(start).alias("end"))
        return F.struct((end + len(STOP)).cast("long").alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    return grouped.select("tree", "leaf", F.array_join(F.transform("turns", piece), "").alias("formatted"), F.aggregate(sizes, empty, step, lambda a: a["out"]).alias("mask"))


def read_back(output: DataFrame) -> DataFrame:
    """``output`` with ``turns`` (role, text) and ``loss`` (texts under the mask)."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), p.alias("piece")))
    turns = F.transform(body, lambda x: F.struct(_unrole(x["role"]).alias("role"), unescaped(F.substring(x["piece"], F.char_length(x["role"]) + 2, F.char_length(x["piece"]) - F.char_length(x["role"]) - 1 - len(STOP))).alias("text")))
    under = F.transform(F.arrays_zip(pieces.alias("piece"), F.col("mask").alias("m")), lambda x: unescaped(F.substring(x["piece"], (x["m"]["start"] - x["m"]["turn"] - len(START) + 1).cast("int"), (x["m"]["end"] - x["m"]["start"]).cast("int"))))
    return output.withColumn("turns", turns).withColumn("loss", F.array_join(under, ""))


def reply_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """One formatted conversation for each chosen path.

    ``messages``: tree, id, parent, score, role, text.
    """
    rows = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", "score", "role", "text")).alias("x")).select("tree", "id", "x.role", "x.text")
    path = chosen_paths(messages.select("tree", "id", "parent", "score"), best)
    return formatted(path.join(rows, ["tree", "id"]))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as trees of one branch, each turn answering the last.

    Rows are ordered by turn, nulls first, then role and text. A null conv_id is
    one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("id"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return rows.select(tree.alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
