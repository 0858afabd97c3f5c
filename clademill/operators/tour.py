"""Positions, depths and lowest common ancestors of all trees at once, without an array or a task for each tree.

An Euler tour goes down and up every branch. Its order is found by list ranking: each arc knows the next one, and doubling the reach of these
pointers tells every arc's place after as many joins as the tour's length has binary digits. Depths and root distances come the same way
from parent pointers, whatever the shape of a tree. Between two neighbouring leaves, the shallowest node tells where their lowest common
ancestor is; minima over 1, 2, 4... neighbouring gaps answer every pair by two lookups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.operators.metrics import running_totals
from clademill.plans.storage import written

#: Doublings that are tried; trees of more levels than 2 to this power have a loop.
MOST_DOUBLINGS = 48
#: Leaves each way of a square of pairs, and pairs that a task makes, more or less.
SIDE, TASK_PAIRS = 1024, 1 << 22


def _length() -> Column:
    return F.when(F.col("parent_id").isNull(), 0.0).otherwise(F.coalesce(F.nanvl("branch_length", F.lit(0.0)), F.lit(0.0)))


def _step(now: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    far = now.select("tree_id", F.col("at").alias("next"), F.col("next").alias("__next"), *(F.col(s).alias(f"__{s}") for s in sums))
    moved = now.where("next IS NOT NULL").join(far, ["tree_id", "next"])
    moved = moved.select("tree_id", "at", F.col("__next").alias("next"), *((F.col(s) + F.col(f"__{s}")).alias(s) for s in sums))
    return now.where("next IS NULL").unionByName(moved)


def _doubled(now: DataFrame, *sums: str) -> DataFrame:
    """``now``: ``tree_id, at, next`` and sums from ``at`` to before ``next``. Follows ``next`` until it is null everywhere, in doubling strides,
    two of which go between tables that are written."""
    now = written(now, "pointers")
    for _ in range(MOST_DOUBLINGS // 2):
        if not now.where("next IS NOT NULL").take(1):
            return now
        now = written(_step(_step(now, sums), sums), "pointers")
    raise ValueError("a tree's parents lead round in a loop")


def rooted(nodes: DataFrame) -> DataFrame:
    """Adds ``depth`` and ``root_dist`` to ``tree_id, node_id, parent_id, branch_length, ...``. The root's own length doesn't count and a null or
    undefined one counts as 0. A node whose parent isn't in the table is left out."""
    start = nodes.select("tree_id", F.col("node_id").alias("at"), F.col("parent_id").alias("next"), F.col("parent_id").isNotNull().cast("int").alias("depth"), _length().alias("root_dist"))
    found = _doubled(start, "depth", "root_dist").select("tree_id", F.col("at").alias("node_id"), "depth", "root_dist")
    return nodes.join(found, ["tree_id", "node_id"])


def positioned(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """Adds ``pos``: a node's place in preorder, 0 for the root; children go by ``order``. Node ids are whole numbers."""
    row = written(nodes.select("tree_id", "node_id", "parent_id", F.col(order).alias("o")), "order")
    kids = row.where("parent_id IS NOT NULL")
    first = kids.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", F.struct("o", "node_id")).alias("first"))
    beside = kids.withColumn("sibling", F.lead("node_id").over(Window.partitionBy("tree_id", "parent_id").orderBy("o", "node_id")))
    down, up = (lambda x: F.col(x).cast("long") * 2), (lambda x: F.col(x).cast("long") * 2 + 1)
    roots = row.where("parent_id IS NULL").select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("top"))
    arcs = beside.join(first, ["tree_id", "node_id"], "left").join(roots, ["tree_id", "parent_id"], "left")
    after_up = F.coalesce(down("sibling"), F.when(F.col("top").isNull(), up("parent_id")))
    both = F.array(
        F.struct(down("node_id").alias("at"), F.coalesce(down("first"), up("node_id")).alias("next"), F.lit(1).cast("long").alias("n")),
        F.struct(up("node_id").alias("at"), after_up.alias("next"), F.lit(0).cast("long").alias("n")),
    )
    told = _doubled(arcs.select("tree_id", F.explode(both).alias("a")).select("tree_id", "a.*"), "n")
    size = row.groupBy("tree_id").agg(F.count("*").alias("size"))
    place = told.where("at % 2 = 0").join(size, "tree_id").select("tree_id", F.expr("at div 2").alias("node_id"), (F.col("size") - F.col("n")).alias("pos"))
    place = place.unionByName(roots.select("tree_id", F.col("parent_id").cast("long").alias("node_id"), F.lit(0).cast("long").alias("pos")))
    return nodes.join(place.withColumn("node_id", F.col("node_id").cast(nodes.schema["node_id"].dataType)), ["tree_id", "node_id"])


def toured(nodes: DataFrame, preorder: bool = False) -> DataFrame:
    """``nodes`` with ``depth``, ``root_dist`` and ``pos``, as far as they lack them; ``preorder``: ids already are places, as parsed trees' are."""
    out = nodes if {"depth", "root_dist"} <= set(nodes.columns) else rooted(nodes)
    if "pos" in out.columns:
        return out
    return out.withColumn("pos", F.col("node_id").cast("long")) if preorder else positioned(out)


def gaps(nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted nodes with their ``rank`` over all trees, and ``tree_id, rank, low``: of the gap before each rank the depth and root distance of the
    lowest common ancestor on either side."""
    above = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("root_dist").alias("above"))
    marks = wanted.select("tree_id", "node_id").distinct().withColumn("w", F.lit(1.0))
    rows = nodes.select("tree_id", "node_id", "parent_id", "depth", "root_dist", "pos").join(above, ["tree_id", "parent_id"], "left").join(marks, ["tree_id", "node_id"], "left").fillna(0.0, ["w"])
    placed = running_totals(rows.withColumn("place", F.struct("tree_id", "pos")), "place", "w", descending=False)
    placed = placed.withColumn("rank", F.col("before_w").cast("long"))
    ranked = placed.where("w = 1").select("tree_id", "node_id", "rank", "root_dist")
    low = placed.where("parent_id IS NOT NULL").groupBy("tree_id", "rank").agg(F.min(F.struct((F.col("depth") - 1).alias("depth"), F.col("above").alias("dist"))).alias("low"))
    return written(ranked, "ranks"), written(low, "gaps")


def _minima(low: DataFrame, widest: int) -> DataFrame:
    """``tree_id, k, rank, low``: minima over the 2 to the power of ``k`` gaps from ``rank`` on, up to ``widest`` gaps."""
    levels = [low.withColumn("k", F.lit(0))]
    while 2 << (len(levels) - 1) <= widest:
        k, before = len(levels), levels[-1]
        right = before.select("tree_id", (F.col("rank") - (1 << (k - 1))).alias("rank"), F.col("low").alias("other"))
        one = before.join(right, ["tree_id", "rank"]).select("tree_id", "rank", F.least("low", "other").alias("low"), F.lit(k).alias("k"))
        levels.append(written(one, "minima") if k % 2 else one)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out


def ancestors_of_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (``tree_id, node_a, node_b``, different nodes neither of which is above the other, and any others) with ``lca_depth`` and ``dist``,
    the length of the way between them. ``nodes`` are toured."""
    wanted = pairs.select("tree_id", F.col("node_a").alias("node_id")).unionByName(pairs.select("tree_id", F.col("node_b").alias("node_id")))
    return looked_up(pairs, *gaps(nodes, wanted))


def _lowest(rows: DataFrame, minima: DataFrame, begin: Column, end: Column) -> DataFrame:
    """``rows`` with ``__low``, the lowest of the gaps from ``begin`` to ``end``, by two lookups; null where ``end`` is before ``begin`` or a gap isn't there."""
    rows = rows.withColumn("__k", F.when(end >= begin, F.length(F.bin(end - begin + 1)) - 1)).withColumn("__l", begin).withColumn("__r", end + 1 - F.expr("shiftleft(1L, __k)"))
    for x in ("l", "r"):
        rows = rows.join(minima.select("tree_id", F.col("k").alias("__k"), F.col("rank").alias(f"__{x}"), F.col("low").alias(f"__low{x}")), ["tree_id", "__k", f"__{x}"], "left")
    return rows.withColumn("__low", F.least("__lowl", "__lowr")).drop("__k", "__l", "__r", "__lowl", "__lowr")


def looked_up(pairs: DataFrame, ranked: DataFrame, low: DataFrame) -> DataFrame:
    most = ranked.groupBy("tree_id").agg((F.max("rank") - F.min("rank")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    side = lambda x: ranked.select("tree_id", F.col("node_id").alias(f"node_{x}"), F.col("rank").alias(f"__{x}"), F.col("root_dist").alias(f"__d{x}"))
    rows = pairs.join(side("a"), ["tree_id", "node_a"]).join(side("b"), ["tree_id", "node_b"])
    rows = _lowest(rows, _minima(low, most), F.least("__a", "__b") + 1, F.greatest("__a", "__b")).where("__low IS NOT NULL")
    return rows.select(*pairs.columns, F.col("__low.depth").cast("int").alias("lca_depth"), (F.col("__da") + F.col("__db") - 2 * F.col("__low.dist")).alias("dist"))


def every_pair(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``tree_id, a, b, lca_depth, dist`` for each pair of ``wanted`` nodes (``tree_id, node_id, leaf_idx, name``) of a tree, ``a`` before ``b`` by ``leaf_idx``.

    Nothing is looked up by pair. The highest bit in which two ranks within a tree differ tells the block whose halves they lie in, and what is lowest
    between them is the lower of two values that each has by itself: from the left one to its half's end and from the other half's start to the right
    one. So a leaf has a row for each bit, and halves meet in a join, in squares of at most ``SIDE`` leaves each way."""
    ranked, low = gaps(nodes, wanted)
    size = ranked.groupBy("tree_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    most, total = size.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_PAIRS))
    rows = wanted.select("tree_id", "node_id", "leaf_idx", "name").join(ranked, ["tree_id", "node_id"]).join(size, "tree_id").where("n > 1")
    rows = rows.withColumn("r", F.col("rank") - F.col("first")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("n") - 1)) - 1)))
    rows = rows.withColumn("own", F.expr("shiftright(r, bit)")).withColumn("start", F.expr("shiftleft(own, bit)")).withColumn("left", F.col("own") % 2 == 0)
    wide = F.expr("shiftleft(1L, bit)")
    rows = rows.where(~F.col("left") | (F.col("start") + wide < F.col("n")))  # a half without a right neighbour meets nothing
    begin = F.col("first") + F.when(F.col("left"), F.col("r") + 1).otherwise(F.col("start"))
    end = F.col("first") + F.when(F.col("left"), F.col("start") + wide - 1).otherwise(F.col("r"))
    rows = _lowest(rows, _minima(low, most), begin, end)
    # the squares that a leaf's half is cut into, and those of the half that it meets
    other = F.when(F.col("left"), F.least(wide, F.col("n") - F.col("start") - wide)).otherwise(wide)
    beside = F.sequence(F.lit(0).cast("long"), F.floor((other - 1) / SIDE))
    rows = rows.select(
        "tree_id", "bit", F.expr("shiftright(own, 1)").alias("block"), "left", F.floor((F.col("r") - F.col("start")) / SIDE).alias("mine"), F.explode(beside).alias("theirs"), "leaf_idx", "name", "root_dist",
        F.coalesce(F.col("__low.depth").cast("int"), F.lit(2**31 - 1)).alias("depth"), F.coalesce("__low.dist", F.lit(0.0)).alias("dist"),
    )
    rows = written(rows, "halves")
    keys = ["tree_id", "bit", "block", "__i", "__j"]
    one = lambda x, where, i, j: rows.where(where).select("tree_id", "bit", "block", F.col(i).alias("__i"), F.col(j).alias("__j"), *(F.col(c).alias(f"{c}_{x}") for c in ("leaf_idx", "name", "root_dist", "depth", "dist"))).repartition(parts, *keys)
    met = one("a", "left", "mine", "theirs").join(one("b", "NOT left", "theirs", "mine"), keys).where("leaf_idx_a <> leaf_idx_b")
    ahead = F.col("leaf_idx_a") < F.col("leaf_idx_b")
    first, second = (F.when(ahead, F.col(f"name_{x}")).otherwise(F.col(f"name_{y}")) for x, y in ("ab", "ba"))
    lowest = F.when(F.col("depth_a") <= F.col("depth_b"), F.col("dist_a")).otherwise(F.col("dist_b"))
    return met.select("tree_id", first.alias("a"), second.alias("b"), F.least("depth_a", "depth_b").alias("lca_depth"), (F.col("root_dist_a") + F.col("root_dist_b") - 2 * lowest).alias("dist"))
