"""Tree operators on node tables (see ``sources.newick.NODE_SCHEMA``): paths, leaves, patristic distances, species matching and
selection, pruning, ordination, branch-length estimation. Work is dealt out by tree or alignment, whose size one task can hold."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clademill.functions.codon import branch_weight, normal_name
from clademill.operators.levels import greedy_gains
from clademill.operators.tour import every_pair
from clademill.plans.storage import written

MOST_LEVELS = 10_000
#: Points whose products are summed up at once.
PIECE = 4096


def with_paths(nodes: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """Adds ``depth, root_dist, path, path_dist`` to an adjacency table ``tree_id, node_id, parent_id, branch_length, ...``
    by a recursive query. The root's own length doesn't count and a null length counts as 0. (Parsed trees have these columns.)
    A query over more than ``spark.sql.cteRecursionRowLimit`` nodes fails, so raise that setting for larger tables."""
    spark: SparkSession = nodes.sparkSession
    view = f"nodes_{id(nodes)}"
    nodes.createOrReplaceTempView(view)
    walked = spark.sql(f"""
        WITH RECURSIVE walk(tree_id, node_id, depth, root_dist, path, path_dist) MAX RECURSION LEVEL {most_levels} AS (
            SELECT tree_id, node_id, 0, CAST(0 AS DOUBLE), array(node_id), array(CAST(0 AS DOUBLE)) FROM {view} WHERE parent_id IS NULL
            UNION ALL
            SELECT n.tree_id, n.node_id, w.depth + 1, w.root_dist + coalesce(nanvl(n.branch_length, 0D), 0D), array_append(w.path, n.node_id),
                   array_append(w.path_dist, w.root_dist + coalesce(nanvl(n.branch_length, 0D), 0D))
            FROM walk w JOIN {view} n ON n.tree_id = w.tree_id AND n.parent_id = w.node_id
        )
        SELECT * FROM walk
    """)
    return nodes.join(walked, ["tree_id", "node_id"])


def leaves(nodes: DataFrame) -> DataFrame:
    """Leaves that have a name."""
    return nodes.where(F.col("is_leaf") & F.col("name").isNotNull() & (F.col("name") != ""))


def has_lengths(nodes: DataFrame) -> DataFrame:
    """``tree_id, has_lengths``: whether any node but the root has a positive branch length."""
    return nodes.groupBy("tree_id").agg(F.coalesce(F.bool_or((F.col("branch_length") > 0) & F.col("parent_id").isNotNull()), F.lit(False)).alias("has_lengths"))


def patristic_pairs(nodes: DataFrame, leaf_rows: DataFrame | None = None) -> DataFrame:
    """``tree_id, a, b, lca_depth, dist`` for each pair of ``leaf_rows`` (all leaves by default) of a tree, ``a`` before ``b`` by ``leaf_idx``. ``nodes`` are
    whole trees as ``tour.toured`` gives them. Select the wanted leaves first: pairs grow with their square."""
    wanted = leaves(nodes) if leaf_rows is None else leaf_rows
    return every_pair(nodes, wanted)


def patristic_matrix(pairs: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """``tree_id, a, b, dist``: both directions and the zero diagonal."""
    one = pairs.select("tree_id", "a", "b", "dist")
    diagonal = leaf_rows.select("tree_id", F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0.0).alias("dist"))
    return one.unionByName(one.select("tree_id", F.col("b").alias("a"), F.col("a").alias("b"), "dist")).unionByName(diagonal)


def match_species(leaf_rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """``aln_id, label, leaf_idx, name``: alignment labels that a leaf matches by normalised name, to be read in ``leaf_idx`` order.
    Of labels alike the last counts; leaves alike give a row each."""
    by_name = sequences.groupBy("aln_id", normal_name(F.col("label")).alias("key")).agg(F.max_by("label", "seq_idx").alias("label"))
    leaf = leaf_rows.select(F.col("tree_id").alias("aln_id"), normal_name(F.col("name")).alias("key"), "leaf_idx", "name")
    return leaf.join(by_name, ["aln_id", "key"]).select("aln_id", "label", "leaf_idx", "name")


def matched_or_all(sequences: DataFrame, matched: DataFrame) -> DataFrame:
    """``aln_id, label, position, has_tree``: matched labels in leaf order, or, without any match, all labels in alignment order."""
    some = matched.select("aln_id").distinct()
    rest = sequences.join(some, "aln_id", "left_anti").select("aln_id", "label", F.col("seq_idx").alias("position"), F.lit(False).alias("has_tree"))
    return matched.select("aln_id", "label", F.col("leaf_idx").alias("position"), F.lit(True).alias("has_tree")).unionByName(rest)


REFERENCE_NAMES = ("hg", "hg38", "human")


def choose_reference(sequences: DataFrame, reference: str | None = None) -> DataFrame:
    """``aln_id, reference``: the named label, which has to be in every alignment, else the first of the usual names, else the first label."""
    if reference is not None:
        missing = sequences.groupBy("aln_id").agg(F.bool_or(F.col("label") == reference).alias("has")).where(~F.col("has")).select("aln_id").take(1)
        if missing:
            raise ValueError(f"{missing[0][0]}: no sequence {reference}")
        return sequences.select("aln_id").distinct().withColumn("reference", F.lit(reference))
    rank = F.coalesce(*(F.when(F.col("label") == x, F.lit(i)) for i, x in enumerate(REFERENCE_NAMES)), F.lit(len(REFERENCE_NAMES)))
    return sequences.groupBy("aln_id").agg(F.min_by("label", F.struct(rank, "seq_idx")).alias("reference"))


def greedy_diversity(paths: dict[str, list[tuple[int, float]]], matched: list[str], reference: str, most: int) -> list[tuple[str, float]]:
    """Species in order of selection with their gains, the reference first.

    ``paths``: leaf name to ``(node, weight)`` from the leaf up to the root, in leaf order. Each step takes the candidate that adds most
    branch weight not yet covered, the first of equals. A candidate's gain shrinks only when a chosen path covers part of it, so
    gains are kept and only those of candidates below a newly covered node are summed up anew, always from the leaf upward: equal
    paths then have equal sums, which differences would not.
    """
    clean = lambda x: x.replace("'", "").replace('"', "").strip()
    by_name: dict[str, list[tuple[int, float]]] = {}
    for name, path in paths.items():
        by_name.setdefault(clean(name), path)
    covered: set[int] = set()
    if clean(reference) in by_name:
        covered.update(n for n, _ in by_name[clean(reference)])
    else:
        covered.update(path[-1][0] for path in by_name.values())
    candidates = [name for name in matched if clean(name) != clean(reference)]
    own = [by_name.get(clean(name), []) for name in candidates]
    below: dict[int, list[int]] = {}

    def open_weight(i: int) -> float:
        total = 0.0
        for node, weight in own[i]:
            if node in covered:
                break
            total += weight
        return total

    for i, path in enumerate(own):
        for node, _ in path:
            if node in covered:
                break
            below.setdefault(node, []).append(i)
    gain = np.array([open_weight(i) for i in range(len(candidates))])
    chosen = [(reference, 0.0)]
    while len(chosen) < min(most, len(matched)) and len(candidates):
        best = int(gain.argmax())
        if gain[best] <= -1.0:
            break
        chosen.append((candidates[best], float(gain[best])))
        fresh = [node for node, _ in own[best] if node not in covered]
        covered.update(fresh)
        for i in {i for node in fresh for i in below[node]}:
            if gain[i] > -np.inf:
                gain[i] = open_weight(i)
        gain[best] = -np.inf
    return chosen


def _select_in_loops(weights: DataFrame, matched: DataFrame, reference: DataFrame, most: int) -> DataFrame:
    """``select_species`` by ``greedy_diversity``, a task a tree."""
    tree = weights.groupBy(F.col("tree_id").alias("aln_id")).agg(F.collect_list(F.struct("node_id", "parent_id", "name", "weight", "is_leaf", "leaf_idx")).alias("nodes"))
    wanted = matched.groupBy("aln_id").agg(F.sort_array(F.collect_list(F.struct("leaf_idx", "label"))).alias("labels"))
    rows = tree.join(wanted, "aln_id").join(reference, "aln_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for aln, all_nodes, labels, ref in zip(frame["aln_id"], frame["nodes"], frame["labels"], frame["reference"], strict=True):
                node = {n["node_id"]: n for n in all_nodes}
                paths = {}
                for leaf in sorted((n for n in all_nodes if n["is_leaf"] and n["name"]), key=lambda n: n["leaf_idx"]):
                    path, at = [], leaf
                    while at is not None:
                        path.append((at["node_id"], at["weight"]))
                        at = None if at["parent_id"] is None or pd.isna(at["parent_id"]) else node[at["parent_id"]]
                    paths[leaf["name"]] = path
                chosen = greedy_diversity(paths, [x["label"] for x in labels], ref, most)
                out += [(aln, i, name, gain) for i, (name, gain) in enumerate(chosen)]
            yield pd.DataFrame(out, columns=["aln_id", "species_idx", "label", "gain"])

    return rows.mapInPandas(run, "aln_id string, species_idx int, label string, gain double")


def select_species(nodes: DataFrame, matched: DataFrame, reference: DataFrame, most: int = 256) -> DataFrame:
    """``aln_id, species_idx, label, gain``: the species of greatest phylogenetic diversity of each alignment that has a tree.

    Longest paths, found level by level over all trees at once, are what the greedy choice takes in order of their weight (``levels.greedy_gains``).
    Where a tree has a negative length that doesn't hold, so such trees are gone through step by step, a task each."""
    weights = written(nodes.join(has_lengths(nodes), "tree_id").withColumn("weight", branch_weight(F.col("branch_length"), F.col("has_lengths"))), "weights")
    every = Window.partitionBy("aln_id")
    listed = matched.select("aln_id", "label", "leaf_idx").join(reference, "aln_id").withColumn("place", F.row_number().over(every.orderBy("leaf_idx", "label")))
    listed = written(listed.withColumn("n", F.count("*").over(every)).withColumn("key", normal_name(F.col("label"))), "listed")
    odd = weights.where("weight < 0").select("tree_id").distinct()
    out = None
    if odd.take(1):
        names = odd.withColumnRenamed("tree_id", "aln_id")
        out = _select_in_loops(weights.join(odd, "tree_id", "left_semi"), matched.join(names, "aln_id", "left_semi"), reference, most)
        weights, listed = weights.join(odd, "tree_id", "left_anti"), listed.join(names, "aln_id", "left_anti")
    known = listed.groupBy("aln_id", "reference").agg(F.max("n").alias("n"))
    others = listed.where(F.col("key") != normal_name(F.col("reference"))).select("aln_id", "place", "label", "key")
    gains = greedy_gains(weights, others, reference)
    rank = F.row_number().over(every.orderBy(F.desc("gain"), "place")).alias("species_idx")
    chosen = gains.select("aln_id", rank, "label", "gain").join(known.select("aln_id", "n"), "aln_id").where(F.col("species_idx") < F.least(F.lit(most), "n")).drop("n")
    chosen = known.select("aln_id", F.lit(0).alias("species_idx"), F.col("reference").alias("label"), F.lit(0.0).alias("gain")).unionByName(chosen)
    return chosen if out is None else chosen.unionByName(out)


def evenly_spaced(candidates: DataFrame, reference: DataFrame, most: int = 256) -> DataFrame:
    """``aln_id, species_idx, label``: the reference, then ``most - 1`` of the others at even steps of their order, or all if they fit.

    ``candidates``: ``aln_id, label, position``. With room for one species besides the reference and more than one candidate the steps
    are undefined, which raises ValueError; without room only the reference is returned.
    """
    room = most - 1
    others = candidates.join(reference, "aln_id").where(normal_name(F.col("label")) != normal_name(F.col("reference")))
    by_place = Window.partitionBy("aln_id").orderBy("position")
    others = others.select("aln_id", "label", (F.row_number().over(by_place) - 1).alias("i"), F.count("*").over(Window.partitionBy("aln_id")).alias("n"))
    if room == 1 and others.where("n > 1").take(1):
        raise ValueError("evenly spaced selection needs room for none, or for two or more species besides the reference")
    steps = reference.crossJoin(reference.sparkSession.range(max(0, room)).select(F.col("id").alias("k")))  # one row a slot: room bounds it
    picked = others.where(F.col("n") > room).join(steps, "aln_id").where(F.col("i") == F.floor(F.col("k") * (F.col("n") - 1) / F.lit(max(1, room - 1))))
    whole = others.where(F.col("n") <= room).select("aln_id", "label", F.col("i").alias("k"))
    chosen = picked.select("aln_id", "label", "k").unionByName(whole).select("aln_id", (F.col("k") + 1).cast("int").alias("species_idx"), "label")
    return reference.select("aln_id", F.lit(0).alias("species_idx"), F.col("reference").alias("label")).unionByName(chosen)


def prune(leaf_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Leaves that aren't selected, by raw name."""
    return leaf_rows.join(selected.select(F.col("aln_id").alias("tree_id"), F.col("label").alias("name")), ["tree_id", "name"], "left_anti")


def selected_distances(selected: DataFrame, distances: DataFrame) -> DataFrame:
    """``aln_id, i, j, dist`` over all selected species of an alignment by normalised name, 0 where there is no distance."""
    side = lambda x: selected.select("aln_id", F.col("species_idx").alias(x), normal_name(F.col("label")).alias(f"n{x}"))
    known = distances.select(F.col("tree_id").alias("aln_id"), F.col("a").alias("ni"), F.col("b").alias("nj"), "dist")
    known = known.groupBy("aln_id", "ni", "nj").agg(F.max("dist").alias("dist"))
    return side("i").join(side("j"), "aln_id").join(known, ["aln_id", "ni", "nj"], "left").select("aln_id", "i", "j", F.coalesce("dist", F.lit(0.0)).alias("dist"))


def dense_matrix(i: np.ndarray, j: np.ndarray, dist: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size), np.float32)
    out[i, j] = dist
    return out


def classical_mds(dist: np.ndarray, components: int = 4) -> np.ndarray:
    """Coordinates from double centring; zeros for no more points than components. Each axis has its largest entry positive."""
    n = len(dist)
    out = np.zeros((n, components), np.float32)
    if n <= components:
        return out
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ dist.astype(np.float64) ** 2 @ centre)
    for k, at in enumerate(np.argsort(values)[::-1][:components]):
        if values[at] > 0:
            axis = vectors[:, at]
            out[:, k] = np.copysign(1.0, axis[np.abs(axis).argmax()]) * axis * np.sqrt(values[at])
    return out


def mds(distances: DataFrame, components: int = 4, pad_to: int | None = 256) -> DataFrame:
    """``aln_id, species_idx, coords`` from ``aln_id, i, j, dist``. The matrix is padded with zeros to ``pad_to`` species first, which
    changes the coordinates; None takes the selected block alone."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["i"].max()) + 1
        dense = dense_matrix(frame["i"].to_numpy(), frame["j"].to_numpy(), frame["dist"].to_numpy(), max(n, pad_to or 0))
        coords = classical_mds(dense, components)[:n]
        return pd.DataFrame({"aln_id": frame["aln_id"].iloc[0], "species_idx": np.arange(n, dtype=np.int32), "coords": [c.tolist() for c in coords]})

    return distances.groupBy("aln_id").applyInPandas(run, "aln_id string, species_idx int, coords array<float>")


def _of_group(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """``rows`` with what their group has, null where it has nothing; a null is a group too."""
    return rows.join(groups.withColumnRenamed(by, "__group"), F.col(by).eqNullSafe(F.col("__group")), "left").drop("__group")


def _moments(points: DataFrame, by: str, vector: str) -> DataFrame:
    """``by, n, mean`` of the groups of ``points``."""
    cells = points.select(by, F.posexplode(F.col(vector)).alias("at", "x")).groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))
    means = cells.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda c: c.mean).alias("mean"))
    return _of_group(points.groupBy(by).agg(F.count("*").alias("n")), means, by).withColumn("mean", F.coalesce("mean", F.array().cast("array<double>")))


def points_mds(points: DataFrame, by: str, key: str, vector: str, components: int = 4) -> DataFrame:
    """``by, key, coords`` of points given as vectors: what ``classical_mds`` finds on the matrix of a group's Euclidean distances, without that matrix.

    The doubly centred matrix of squared distances is that of the centred points' products, so its positive eigenvalues are those of the vectors' own
    scatter matrix, and a point's coordinates are its products with that one's axes. The scatter is summed up over pieces of some ``PIECE`` points."""
    groups = written(_moments(points, by, vector), "moments")
    placed = _of_group(points.select(by, key, F.col(vector).alias("__x")), groups, by)
    piece = F.pmod(F.xxhash64(key), F.ceil(F.col("n") / PIECE)).alias("__piece")

    def scatter(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["__x"].to_numpy()).astype(np.float64) - frame["mean"].iloc[0]
        return pd.DataFrame({by: frame[by].iloc[:1], "sums": [(x.T @ x).ravel()]})

    def axes(frame: pd.DataFrame) -> pd.DataFrame:
        size = math.isqrt(len(frame["sums"].iloc[0]))
        values, vectors = np.linalg.eigh(np.asarray(frame["sums"].iloc[0]).reshape(size, size))
        top = [vectors[:, i] for i in np.argsort(values)[::-1][:components] if values[i] > 0]
        return pd.DataFrame({by: frame[by].iloc[:1], "axes": [np.concatenate(top) if top else np.zeros(0)]})

    kind = points.schema[by].dataType.simpleString()
    big = placed.where(F.col("n") > components)
    sums = big.select(by, piece, "__x", "mean").groupBy(by, "__piece").applyInPandas(scatter, f"{by} {kind}, sums array<double>")
    sums = sums.select(by, F.posexplode("sums").alias("at", "s")).groupBy(by, "at").agg(F.sum("s").alias("s"))
    sums = sums.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda c: c.s).alias("sums"))
    found = written(sums.groupBy(by).applyInPandas(axes, f"{by} {kind}, axes array<double>"), "axes")
    centred = F.transform(F.arrays_zip("__x", "mean"), lambda c: c["__x"].cast("double") - c["mean"])
    product = lambda k: F.aggregate(F.zip_with("__c", F.slice("axes", F.size("__c") * k + 1, F.size("__c")), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    coords = F.array(*(F.when(F.size("axes") > F.size("__c") * k, product(k)).otherwise(0.0) for k in range(components)))
    raw = _of_group(placed, found, by).withColumn("__c", centred).select(by, key, F.coalesce(F.when(F.col("axes").isNotNull(), coords), F.array_repeat(F.lit(0.0), components)).alias("coords"))
    raw = written(raw, "coordinates")
    sign = raw.groupBy(by).agg(*(F.signum(F.max_by(F.element_at("coords", k + 1), F.abs(F.element_at("coords", k + 1)))).alias(f"__s{k}") for k in range(components)))
    return _of_group(raw, sign, by).select(by, key, F.array(*(F.element_at("coords", k + 1) * F.col(f"__s{k}") for k in range(components))).alias("coords"))


def hky_lengths(parent: list[int], tips: dict[int, np.ndarray], rounds: int = 3, kappa: float = 2.0) -> np.ndarray:
    """Maximum-likelihood branch lengths of a fixed topology under HKY85 with empirical base frequencies.

    ``parent``: of each node in preorder, -1 for the root. ``tips``: rows of base indices (T, C, A, G; 4 unknown) of leaves. Partial
    likelihoods go up and down the tree once a round; each branch then takes the best of a grid that is refined round by round.
    """
    n, width = len(parent), len(next(iter(tips.values())))
    seen = np.concatenate(list(tips.values()))
    freq = np.bincount(seen[seen < 4], minlength=4) + 1.0
    freq /= freq.sum()
    rate = np.tile(freq, (4, 1))
    for a, b in ((0, 1), (1, 0), (2, 3), (3, 2)):
        rate[a, b] *= kappa
    np.fill_diagonal(rate, 0)
    np.fill_diagonal(rate, -rate.sum(axis=1))
    rate /= -(freq * np.diag(rate)).sum()
    root = np.sqrt(freq)
    values, vectors = np.linalg.eigh(root[:, None] * rate / root[None, :])
    left, right = vectors / root[:, None], vectors.T * root[None, :]
    change = lambda t: np.maximum(left * np.exp(values * t) @ right, 0)
    states = np.vstack([np.eye(4), np.ones(4)])
    length = np.full(n, 0.1)
    length[0] = 0.0
    for r in range(rounds):
        down = [states[tips[i]] if i in tips else np.ones((width, 4)) for i in range(n)]
        message = [None] * n
        for i in range(n - 1, 0, -1):
            message[i] = down[i] @ change(length[i]).T
            down[parent[i]] = down[parent[i]] * message[i]
            down[parent[i]] /= down[parent[i]].max(axis=1, keepdims=True)
        up = [np.tile(freq, (width, 1))] + [None] * (n - 1)
        kids: dict[int, list[int]] = {}
        for i in range(1, n):
            kids.setdefault(parent[i], []).append(i)
        for i in range(1, n):
            above = up[parent[i]]
            for k in kids[parent[i]]:
                if k != i:
                    above = above * message[k]
            above = above / above.max(axis=1, keepdims=True)
            grid = np.geomspace(1e-6, 5, 40) if r == 0 else length[i] * np.geomspace(0.6, 1.7, 15)
            scores = [np.log(np.maximum((above * (down[i] @ change(t).T)).sum(axis=1), 1e-300)).sum() for t in grid]
            length[i] = grid[int(np.argmax(scores))]
            up[i] = above @ change(length[i])
            message[i] = down[i] @ change(length[i]).T
    return length


def estimate_lengths(nodes: DataFrame, sequences: DataFrame, estimator: Callable[[list[int], dict[int, np.ndarray]], np.ndarray] = hky_lengths) -> DataFrame:
    """``tree_id, node_id, branch_length`` for trees without a positive length; a failure leaves the lengths null (which count as 0).

    ``estimator`` gets parents in preorder and the leaves' bases, so that another program can take the built-in one's place.
    """
    bare = nodes.join(has_lengths(nodes).where(~F.col("has_lengths")).select("tree_id"), "tree_id", "left_semi")
    seqs = sequences.select(F.col("aln_id").alias("tree_id"), normal_name(F.col("label")).alias("key"), "seq")
    rows = bare.select("tree_id", "node_id", "parent_id", normal_name(F.when(F.col("is_leaf"), F.col("name"))).alias("key")).join(seqs, ["tree_id", "key"], "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node_id")
        try:
            place = {n: i for i, n in enumerate(frame["node_id"])}
            tips = {place[n]: np.array(["TCAG".find(c) % 5 for c in s.upper().replace("U", "T")]) for n, s in zip(frame["node_id"], frame["seq"], strict=True) if isinstance(s, str)}
            found = estimator([-1 if pd.isna(p) else place[p] for p in frame["parent_id"]], tips)
        except Exception:  # any failure of an estimator leaves the tree as it is
            found = np.full(len(frame), np.nan)
        return pd.DataFrame({"tree_id": frame["tree_id"], "node_id": frame["node_id"], "branch_length": found})

    return rows.groupBy("tree_id").applyInPandas(run, "tree_id string, node_id int, branch_length double")


def distance_column(dist: Column) -> Column:
    """Flat distances: 0 where a tree gave none."""
    return F.coalesce(dist, F.lit(0.0))
