"""Chat formatting of reply trees, with DataFrame functions only.

Messages name the message they answer.  Pointer doubling finds all root-to-leaf paths: in
round k every message is joined with the message 2**k above it, which adds up depths and
scores, so a thread of n turns takes log2(n) self-joins.  The leaves of a conversation
(its branches) are ranked by the mean score of their path, then by leaf.  The pointers of
the rounds then mark the messages on the chosen paths, and each path becomes one text:

    <s><|role|>\\ntext</s>\\n<|role|>\\ntext</s>\\n ...

Control strings inside roles and texts are broken with a backslash code, and backslashes
are doubled, so the output can be read back exactly.

Defined results: null roles and texts are empty; turns of a linear conversation go by turn
(null last), then role, then text, and repeated rows are turns of their own; a parent that
is missing makes its reply a root; messages on a cycle of replies have no root and are left
out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BEGIN, ROLE, ROLE_END, TURN_END = "<s>", "<|", "|>\n", "</s>\n"
#: Strings that steer a reader of the template (or of kindred ones), and how
#: each is written inside a text.
CONTROL = {
    "<s>": "\\ls>",
    "</s>": "\\l/s>",
    "<|": "\\l|",
    "|>": "\\p>",
    "[INST]": "\\bINST]",
    "[/INST]": "\\b/INST]",
}
CODES = {"\\l": "<", "\\p": "|", "\\b": "["}


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for plain, coded in CONTROL.items():
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    """Doubled backslashes come first: between them every backslash begins a code."""

    def decode(piece: Column) -> Column:
        for code, plain in CODES.items():
            piece = F.replace(piece, F.lit(code), F.lit(plain))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), decode), "\\")


def linear(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as messages, each an answer to the one before."""
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    node = F.row_number().over(order).cast("long")
    return plain.select("conv", node.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv, leaf, branch (rank from 1), node, depth of every message on a chosen path.

    ``messages`` has conv, node, parent, score; a null conv is a conversation too.
    """
    nodes = messages.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("c"), F.col("conv").isNull().alias("cn"), "node", "parent", "score")
    nodes = materialize(nodes)
    known = nodes.select("c", "cn", F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    state = materialize(
        nodes.join(known, ["c", "cn", "parent"], "left").select("c", "cn", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("hops"), F.col("score").cast("double").alias("total"))
    )
    # Messages whose pointer has passed the root are done and only serve the others.
    active, done = state.where("up is not null"), state.where("up is null")
    rounds: list[DataFrame] = []
    for _ in range(max(1, math.ceil(math.log2(nodes.count() + 1)) + 1)):
        if active.isEmpty():
            break
        rounds.append(active)
        above = done.unionByName(active).select("c", "cn", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("total").alias("total2"))
        state = materialize(
            active.join(above, ["c", "cn", "up"]).select("c", "cn", "node", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("total") + F.col("total2")).alias("total"))
        )
        active, done = state.where("up is not null"), done.unionByName(state.where("up is null"))
    answered = nodes.where("parent is not null").select("c", "cn", F.col("parent").alias("node")).distinct()
    leaves = done.join(answered, ["c", "cn", "node"], "left_anti")
    best = Window.partitionBy("c", "cn").orderBy((F.col("total") / F.col("hops")).desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top)
    marked = chosen.select("c", "cn", F.col("node").alias("leaf"), "branch", "node", (F.col("hops") - 1).alias("depth"))
    for k, pointers in enumerate(rounds):
        jump = pointers.select("c", "cn", "node", "up")
        above = marked.join(jump, ["c", "cn", "node"]).select("c", "cn", "leaf", "branch", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        marked = materialize(marked.unionByName(above))
    return marked


def format_paths(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """A row per chosen path: conv, branch, formatted, loss_spans (start from 1, length, of escaped text)."""
    keyed = messages.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("c"), F.col("conv").isNull().alias("cn"), "conv", "node", "role", "text")
    turns = paths(messages, top).join(keyed, ["c", "cn", "node"])
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(ROLE_END))
    turns = turns.select("c", "cn", "conv", "branch", "depth", (F.col("role") == loss_role).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    so_far = Window.partitionBy("c", "cn", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(TURN_END)
    turns = turns.withColumn("start", F.coalesce(F.sum(length).over(so_far), F.lit(0)) + len(BEGIN) + F.length("head") + 1)
    parts = F.sort_array(F.collect_list(F.struct("depth", "head", "body", "start", "loss")))
    out = turns.groupBy("c", "cn", "branch").agg(F.first("conv").alias("conv"), parts.alias("parts"))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), ""))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))
    return out.select("conv", "branch", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column, loss_role: str = "assistant") -> Column:
    """array<struct<role, text, loss>> of a formatted text."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), TURN_END)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, ROLE_END)
        role = unescape(F.substring(piece, F.lit(len(ROLE) + 1), at - len(ROLE) - 1))
        body = unescape(F.substring(piece, at + len(ROLE_END), F.lit(2**31 - 1)))
        return F.struct(role.alias("role"), body.alias("text"), (role == loss_role).alias("loss"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
