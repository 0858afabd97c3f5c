"""Passes up and down all trees at once, one level of depth after another, as joins and aggregation by parent.

A level of every tree, and every site of a tree, is one step, whose result is written to the shared folder; so a huge tree is spread over many tasks,
and there are as many steps as the deepest tree has levels. ``nodes`` need a ``depth`` (see ``tour.rooted``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.functions.codon import branch_weight, normal_name, translate_codon
from clademill.operators import tour
from clademill.operators.sites import explode_sites
from clademill.plans.storage import written

NODE = ["tree_id", "node_id"]
SITE = ["tree_id", "site", "node_id"]


def _deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _with_depth(nodes: DataFrame, *columns: str) -> DataFrame:
    return written((nodes if "depth" in nodes.columns else tour.rooted(nodes)).select("tree_id", "node_id", "parent_id", "depth", *columns), "levels")


def parsimony_sets(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """``tree_id, site, node_id, states, state, changed``: bottom-up state sets by parsimony and a top-down choice, for highlighting branches.

    ``states``: ``tree_id, site, name, state`` of leaves, one for each site and name. A node keeps the states that most children have, which for two
    children is the intersection or else the union; the choice keeps the parent's state where it can and else the first in order. A leaf
    without a state, or with null, has no say. A node's children are counted by state before they shuffle.
    """
    tree = _with_depth(nodes, "name", "is_leaf")
    tips = tree.where("is_leaf").select("tree_id", "node_id", "parent_id", "depth", "name")
    tips = written(tips.join(states.where("state IS NOT NULL"), ["tree_id", "name"]).select(*SITE, "parent_id", "depth", F.array("state").alias("states")), "tips")
    inner = tree.where("NOT is_leaf").select(*NODE, F.col("parent_id").alias("up"))
    levels: dict[int, DataFrame] = {}
    for depth in range(_deepest(tree), -1, -1):
        own = tips.where(F.col("depth") == depth).drop("depth")
        if depth + 1 in levels:
            votes = levels[depth + 1].select("tree_id", "site", F.col("parent_id").alias("node_id"), F.explode("states").alias("s")).groupBy(*SITE, "s").agg(F.count("*").alias("n"))
            top = votes.groupBy(*SITE).agg(F.max("n").alias("most"), F.collect_list(F.struct("s", "n")).alias("c"))
            kept = F.sort_array(F.transform(F.filter("c", lambda x: x.n == F.col("most")), lambda x: x.s))
            own = own.unionByName(top.select(*SITE, kept.alias("states")).join(inner, NODE).select(*SITE, F.col("up").alias("parent_id"), "states"))
        levels[depth] = written(own, "sets")
    every = states.select("tree_id", "site").distinct()
    chosen: list[DataFrame] = []
    for depth in sorted(levels):
        here = tree.where(F.col("depth") == depth).select(*NODE, "parent_id")
        if chosen:
            above = chosen[-1].select("tree_id", "site", F.col("node_id").alias("parent_id"), F.col("state").alias("above"))
            here = here.join(above, ["tree_id", "parent_id"])
        else:
            here = here.join(every, "tree_id").withColumn("above", F.lit(None).cast("string"))
        own = F.coalesce("states", F.array().cast("array<string>"))
        here = here.select(*SITE, "above").join(levels[depth].select(*SITE, "states"), SITE, "left").withColumn("states", own)
        state = F.when(F.array_contains("states", F.col("above")) | (F.size("states") == 0), F.col("above")).otherwise(F.get("states", F.lit(0)))
        here = here.withColumn("state", state).withColumn("changed", F.coalesce((F.size("states") > 0) & (F.col("state") != F.col("above")), F.lit(False)))
        chosen.append(written(here.select(*SITE, "states", "state", "changed"), "states"))
    if not chosen:
        return every.select("tree_id", "site", *(F.lit(None).cast(k).alias(n) for n, k in (("node_id", "int"), ("states", "array<string>"), ("state", "string"), ("changed", "boolean")))).where("false")
    return _all(chosen)


def site_states(nodes: DataFrame, sequences: DataFrame, variable: DataFrame) -> DataFrame:
    """``tree_id, site, name, codon, aa`` of the leaves that a sequence matches by normalised name, at ``variable`` sites (``aln_id, site``). Of
    labels alike the last sequence counts. A codon that can't be translated has a null ``aa``, a gap or a broken one is null too."""
    last = sequences.groupBy(F.col("aln_id").alias("tree_id"), normal_name(F.col("label")).alias("key")).agg(F.max_by("seq", "seq_idx").alias("seq"))
    tips = nodes.where("is_leaf AND name IS NOT NULL").select("tree_id", "name", normal_name(F.col("name")).alias("key")).distinct().join(last, ["tree_id", "key"]).drop("key")
    codons = explode_sites(tips).join(variable.select(F.col("aln_id").alias("tree_id"), "site"), ["tree_id", "site"], "left_semi")
    aa = F.nullif(translate_codon(F.col("codon")), F.lit("?"))
    return codons.select("tree_id", "site", "name", F.when(aa.isNotNull(), F.upper("codon")).alias("codon"), aa.alias("aa"))


def changed_branches(nodes: DataFrame, sequences: DataFrame, variable: DataFrame, by: str = "aa") -> DataFrame:
    """``tree_id, site, node_id, parent_id, before, after, name, codon, aa``: the branches of each variable site's tree on which the state changes by
    parsimony, over amino acids or codons (``by``), with the labels of those that lead to a leaf."""
    told = written(site_states(nodes, sequences, variable), "site-states")
    found = parsimony_sets(nodes, told.select("tree_id", "site", "name", F.col(by).alias("state")))
    changed = found.where("changed").select(*SITE, F.col("state").alias("after")).join(nodes.select(*NODE, "parent_id", "name"), NODE)
    before = found.select("tree_id", "site", F.col("node_id").alias("parent_id"), F.col("state").alias("before"))
    return changed.join(before, ["tree_id", "site", "parent_id"]).join(told, ["tree_id", "site", "name"], "left").select(*SITE, "parent_id", "before", "after", "name", "codon", "aa")


def greedy_gains(nodes: DataFrame, candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """``aln_id, place, label, gain``: what each candidate adds when species are taken greedily by branch weight not yet covered.

    The greedy order is that of the longest paths: from the leaves up, a node passes on the candidate with most weight so far (of equals the
    first by ``place``), and the others' paths end there. The reference's path, or the root where the reference has no leaf, is covered from the start. So
    gains sum up from the leaf upward. Weights (``weight`` of ``nodes``) aren't negative.

    ``candidates``: ``aln_id, place, label, key`` with the normalised name, without the reference; of candidates alike the first has the leaf's weight, and
    those without a leaf and the rest have 0.
    """
    tree = _with_depth(nodes, "weight", "is_leaf", "name", "leaf_idx")
    named = tree.where("is_leaf AND name IS NOT NULL AND name <> ''").groupBy("tree_id", normal_name(F.col("name")).alias("key")).agg(F.min_by("node_id", "leaf_idx").alias("node_id"))
    first = candidates.groupBy(F.col("aln_id").alias("tree_id"), "key").agg(F.min_by(F.struct("place", "label"), "place").alias("c"))
    ref = reference.select(F.col("aln_id").alias("tree_id"), normal_name(F.col("reference")).alias("key"), F.lit(True).alias("ref"))
    tip = named.join(first, ["tree_id", "key"], "left").join(ref, ["tree_id", "key"], "left")
    rows = tree.join(tip.select(*NODE, "c", "ref").where("c IS NOT NULL OR ref"), NODE, "left")
    rows = written(rows.select(*NODE, "parent_id", "depth", F.coalesce("weight", F.lit(0.0)).alias("weight"), "c.place", "c.label", F.coalesce("ref", F.lit(False)).alias("ref")), "tips")
    ends: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in range(_deepest(rows), -1, -1):
        here = rows.where(F.col("depth") == depth).withColumn("gain", F.when(F.col("place").isNotNull(), 0.0)).drop("depth")
        if below is not None:
            best = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min(F.when(F.col("place").isNotNull(), F.struct((-F.col("gain")).alias("less"), "place", "label"))).alias("b"), F.max("ref").alias("r"))
            best = written(best, "best")
            here = here.join(best, NODE, "left").withColumn("ref", F.col("ref") | F.coalesce("r", F.lit(False)))
            for name in ("place", "label"):
                here = here.withColumn(name, F.coalesce(f"b.{name}", name))
            here = here.withColumn("gain", F.coalesce(-F.col("b.less"), F.col("gain"))).drop("b", "r")
            # a path ends where another is passed on, and below whatever is covered
            up = here.select("tree_id", F.col("node_id").alias("parent_id"), F.col("place").alias("on"), (F.col("ref") | F.col("parent_id").isNull()).alias("covered"))
            ends.append(below.where("place IS NOT NULL").join(up, ["tree_id", "parent_id"]).where("covered OR place <> on").select("tree_id", "place", "label", "gain"))
        gone = F.col("ref") | F.col("parent_id").isNull()
        if depth == 0:  # a tree of one node
            ends.append(here.where("parent_id IS NULL AND place IS NOT NULL AND gain = 0").select("tree_id", "place", "label", "gain"))
        here = here.withColumn("gain", F.col("gain") + F.col("weight"))
        for name in ("place", "label", "gain"):
            here = here.withColumn(name, F.when(~gone, F.col(name)))
        below = written(here, "paths")
    listed = candidates.select("aln_id", "place", "label")
    if not ends:
        return listed.withColumn("gain", F.lit(0.0))
    known = _all(ends).groupBy(F.col("tree_id").alias("aln_id"), "place").agg(F.max("gain").alias("gain"))
    return listed.join(known, ["aln_id", "place"], "left").select("aln_id", "place", "label", F.coalesce("gain", F.lit(0.0)).alias("gain"))
