"""Reply trees as conversations: iterative self-joins enumerate root-to-leaf paths, branches are ranked by score, and each chosen
path is formatted with a template whose control strings cannot occur inside a text.

The joins double their reach: table ``k`` maps each message to its ancestor ``2**k`` steps up, and paths are then spread out from
the leaves by the binary digits of the distance. A tree of depth ``d`` takes ``log2(d)`` joins each way, and rows stay in
proportion to the messages and to the paths' total length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.llm.common import materialise

#: The template: "### role: text</turn>\n" for each turn; a backslash escapes.
HEAD, STOP, END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans ``start, end`` in code points that a loss is taken over: the escaped texts of
    the roles in ``learn``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role, _ROLE_CONTROL) + STOP, escape(text)
        if role in learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises on a text that the template cannot have made."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _key(*columns: Column) -> Column:
    """Equal for equal values, nulls included."""
    return F.to_json(F.struct(*(c.cast("string").alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"})


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """All root-to-leaf paths, or the ``best`` of each tree: ``tree, leaf, branch_rank, branch_score, distance, node, role, text``,
    one row per message and path; ``distance`` counts from the leaf.

    ``messages``: ``tree, node, parent, role, text, score``. A parent that is null or missing makes a root. Of rows that repeat a
    node one stays (lowest parent, role, text, score; nulls first). Branches are ranked by the mean of their scores (null: 0), then
    length, longest first, then leaf. Messages on a cycle are on no path from a root. An empty table gives an empty one.
    """
    order = F.struct("parent", "role", "text", "score")
    nodes = messages.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.groupBy("tree", "node").agg(F.min(order).alias("m")).select("tree", "node", "m.*")
    nodes = materialise(nodes.withColumn("id", _key(F.col("tree"), F.col("node"))).withColumn("up", F.when(F.col("parent").isNotNull(), _key(F.col("tree"), F.col("parent")))), "messages")
    known = nodes.select(F.col("id").alias("up"))
    jump = materialise(nodes.select("id", "up").where("up IS NOT NULL").join(known, "up", "left_semi").select("id", "up"), "jump")
    total, jumps = nodes.count(), []
    while not jump.isEmpty() and 1 << len(jumps) <= total:
        jumps.append(jump)
        further = jump.select(F.col("id").alias("up"), F.col("up").alias("over"))
        jump = materialise(jump.join(further, "up").select("id", F.col("over").alias("up")), "jump")
    leaves = nodes.join(nodes.select(F.col("up").alias("id")), "id", "left_anti")
    spread = leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(jumps))):
        more = spread.join(jumps[k], "id").select("leaf", F.col("up").alias("id"), (F.col("distance") + (1 << k)).alias("distance"))
        spread = materialise(spread.unionByName(more), "paths")
    told = spread.join(nodes.select("id", "tree", "node", "role", "text", "score"), "id")
    branch = told.groupBy("leaf").agg(F.avg("score").alias("branch_score"), F.count("*").alias("n"), F.first("tree").alias("tree"), F.max(F.when(F.col("distance") == 0, F.col("node"))).alias("leaf_node"))
    if best is not None:
        branch = branch.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("n"), "leaf_node", "leaf"))).where(F.col("branch_rank") <= best)
    else:
        branch = branch.withColumn("branch_rank", F.lit(None).cast("int"))
    return told.join(branch.select("leaf", "branch_rank", "branch_score", "leaf_node"), "leaf").select("tree", F.col("leaf_node").alias("leaf"), "branch_rank", "branch_score", "distance", "node", "role", "text", F.col("leaf").alias("path"))


def conversations(messages: DataFrame, best: int | None = 1, learn: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """Each chosen path as one formatted conversation: ``tree, leaf, branch_rank, branch_score, formatted, loss_spans``.

    Null roles and texts are written as empty. A conversation is one row, so it has to fit in memory; see ``paths`` for the rest.
    """
    turn = F.struct((-F.col("distance")).alias("d"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = paths(messages, best).groupBy("path", "tree", "leaf", "branch_rank", "branch_score").agg(F.sort_array(F.collect_list(turn)).alias("turns")).drop("path")
    kinds = [f.simpleString().replace(":", " ", 1) for f in whole.schema.fields[:-1]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [format_turns([(t["role"], t["text"]) for t in turns], learn) for turns in frame.pop("turns")]
            yield frame.assign(formatted=[x for x, _ in made], loss_spans=[[{"start": a, "end": b} for a, b in s] for _, s in made])

    return whole.mapInPandas(run, ", ".join([*kinds, "formatted string", "loss_spans array<struct<start: long, end: long>>"]))


def linear_trees(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations of numbered turns as reply trees of one branch. Rows go by turn (nulls first), then role and text; repeated rows all stay."""
    order = Window.partitionBy(conv_id).orderBy(turn, role, text)
    place = F.row_number().over(order).cast("long")
    rows = table.select(F.col(conv_id).alias("tree"), place.alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
