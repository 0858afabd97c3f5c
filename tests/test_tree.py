import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clademill.operators import levels, tour, tree
from clademill.sources import nexus
from clademill.sources.newick import parse_newick

QUARTET = "((A:1,B:2):0.5,(C:3,D:4):1.5);"


def nodes_of(spark, text):
    return nexus.parse_trees(spark.createDataFrame([("t", text)], "tree_id string, newick string")).drop("error")


def path_table(text):
    nodes = parse_newick(text)
    positive = any((n.branch_length or 0) > 0 for n in nodes[1:])
    out = {}
    for leaf in (n for n in nodes if n.is_leaf):
        at, out[leaf.name] = leaf, []
        while at is not None:
            out[leaf.name].append((at.node_id, (at.branch_length or 0.0) if positive else 1.0))
            at = None if at.parent_id is None else nodes[at.parent_id]
    return out


def test_patristic(spark):
    nodes = tour.toured(nodes_of(spark, QUARTET), preorder=True)
    leaf = tree.leaves(nodes)
    pairs = tree.patristic_pairs(nodes)
    got = {r.a + r.b: r.dist for r in pairs.collect()}
    assert got == {"AB": 3, "AC": 6, "AD": 7, "BC": 7, "BD": 8, "CD": 7}
    whole = {(r.a, r.b): r.dist for r in tree.patristic_matrix(pairs, leaf).collect()}
    assert len(whole) == 16 and whole["C", "A"] == 6 and whole["B", "B"] == 0
    walked = tree.with_paths(nodes_of(spark, QUARTET).drop("depth", "root_dist"))
    assert {(r.name, r.root_dist, r.depth) for r in walked.where("is_leaf").collect()} == {("A", 1.5, 2), ("B", 2.5, 2), ("C", 4.5, 2), ("D", 5.5, 2)}


def test_greedy_diversity():
    species = ["A", "B", "C", "D"]
    assert tree.greedy_diversity(path_table(QUARTET), species, "A", 4) == [("A", 0.0), ("D", 5.5), ("C", 3.0), ("B", 2.0)]
    assert tree.greedy_diversity(path_table("((A,B),(C,D));"), species, "A", 4) == [("A", 0.0), ("C", 2.0), ("B", 1.0), ("D", 1.0)]
    assert tree.greedy_diversity(path_table(QUARTET), species, "Z", 4) == [("Z", 0.0), ("D", 5.5), ("C", 3.0), ("B", 2.5)]
    assert tree.greedy_diversity(path_table(QUARTET), species, "A", 2) == [("A", 0.0), ("D", 5.5)]


def fresh_greedy(paths, species, reference, most):
    """Each step sums every candidate's open branches anew, from the leaf upward."""
    covered = {n for n, _ in paths[reference]}
    chosen, left = [(reference, 0.0)], [s for s in species if s != reference]
    while left and len(chosen) < most:
        best = None
        for s in left:
            total = 0.0
            for node, weight in paths[s]:
                if node in covered:
                    break
                total += weight
            if best is None or total > best[1]:
                best = (s, total)
        chosen.append(best)
        left.remove(best[0])
        covered |= {n for n, _ in paths[best[0]]}
    return chosen


def test_greedy_diversity_breaks_ties_by_order():
    rng = np.random.default_rng(8)
    for lengths in ((0.1, 0.2, 0.3), (0.1,), (0.25, 0.5), (0.7, 1.1, 0.4, 0.0)):
        for _ in range(60):
            parts = [f"L{i}:{rng.choice(lengths)}" for i in range(14)]
            while len(parts) > 1:
                a, b = (parts.pop(int(rng.integers(len(parts)))) for _ in range(2))
                parts.append(f"({a},{b}):{rng.choice(lengths)}")
            paths = path_table(parts[0] + ";")
            species = list(paths)
            assert tree.greedy_diversity(paths, species, species[0], 7) == fresh_greedy(paths, species, species[0], 7)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 8), min_size=8, max_size=8))
def test_gains_never_grow(lengths):
    a, b, c, d, e, f, g, h = lengths
    text = f"(((A:{a},B:{b}):{c},C:{d}):{e},(D:{f},E:{g}):{h});"
    gains = [x for _, x in tree.greedy_diversity(path_table(text), list("ABCDE"), "A", 5)][1:]
    assert all(x >= y for x, y in zip(gains, gains[1:], strict=False))


def test_select_species(spark):
    nodes = nodes_of(spark, QUARTET)
    seqs = spark.createDataFrame([("t", i, x, "ATG") for i, x in enumerate(["'A'", "B", "C", "D", "E"])], "aln_id string, seq_idx int, label string, seq string")
    matched = tree.match_species(tree.leaves(nodes), seqs)
    assert [r.label for r in matched.orderBy("leaf_idx").collect()] == ["'A'", "B", "C", "D"]
    reference = tree.choose_reference(seqs)
    assert reference.first().reference == "'A'"
    chosen = tree.select_species(nodes, matched, reference, 3).orderBy("species_idx").collect()
    assert [r.label for r in chosen] == ["'A'", "D", "C"]
    with pytest.raises(ValueError):
        tree.choose_reference(seqs, "nobody")
    assert tree.prune(tree.leaves(nodes), tree.select_species(nodes, matched, reference, 3)).count() == 2  # 'A' keeps its quotes, so its leaf is pruned
    every = tree.matched_or_all(seqs, matched.limit(0))
    assert every.count() == 5 and every.where("has_tree").count() == 0


def test_evenly_spaced(spark):
    labels = spark.createDataFrame([("t", f"s{i}", i) for i in range(11)], "aln_id string, label string, position int")
    reference = spark.createDataFrame([("t", "s0")], "aln_id string, reference string")
    pick = lambda most: [r.label for r in tree.evenly_spaced(labels, reference, most).orderBy("species_idx").collect()]
    assert pick(5) == ["s0", "s1", "s4", "s7", "s10"]
    assert pick(20) == [f"s{i}" for i in range(11)] and pick(1) == ["s0"]
    with pytest.raises(ValueError):
        pick(2)


def test_mds(spark):
    x = np.array([0, 1, 2, 3, 10.0])
    coords = tree.classical_mds(np.abs(x[:, None] - x[None]))
    assert np.allclose(coords[:, 0], x - x.mean(), atol=1e-5) and np.allclose(coords[:, 1:], 0, atol=1e-3)
    assert not tree.classical_mds(np.ones((4, 4))).any()
    rows = [("t", i, j, float(abs(x[i] - x[j]))) for i in range(5) for j in range(5)]
    got = tree.mds(spark.createDataFrame(rows, "aln_id string, i int, j int, dist double"), pad_to=None).orderBy("species_idx").collect()
    assert [round(r.coords[0], 3) for r in got] == [-3.2, -2.2, -1.2, -0.2, 6.8]
    padded = tree.mds(spark.createDataFrame(rows, "aln_id string, i int, j int, dist double"), pad_to=8).orderBy("species_idx").collect()
    assert round(padded[0].coords[0], 3) != -3.2


def test_mds_of_points(spark, monkeypatch):
    """Pieces of ten points, a group of three, one without a label and one far from the origin, against the matrix of distances."""
    monkeypatch.setattr(tree, "PIECE", 10)
    rng = np.random.default_rng(3)
    x = {g: rng.normal(size=(n, 7)) * np.arange(7, 0, -1) + at for g, n, at in ((1, 60, 0.0), (2, 3, 0.0), (None, 25, 0.0), (3, 40, 1e6))}
    rows = [(g, i, p.tolist()) for g, part in x.items() for i, p in enumerate(part)]
    got = {(r.g, r.id): r.coords for r in tree.points_mds(spark.createDataFrame(rows, "g int, id long, v array<double>"), "g", "id", "v").collect()}
    for g, part in x.items():
        want = tree.classical_mds(np.sqrt(((part[:, None] - part[None]) ** 2).sum(-1)))
        assert np.allclose([got[g, i] for i in range(len(part))], want, atol=1e-4)


def test_mds_needs_no_matrix_of_distances(spark):
    """20,000 points of one group, whose differences alone would take 205 GB."""
    points = spark.range(20_000).selectExpr("0 AS g", "id", "transform(sequence(1, 64), k -> sin(id * k)) AS v")
    assert tree.points_mds(points, "g", "id", "v").agg(F.sum(F.col("coords")[0])).first()[0] == pytest.approx(0, abs=1e-6)


def test_branch_lengths(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 4, 600)
    change = lambda s, p: np.where(rng.random(len(s)) < p, rng.integers(0, 4, len(s)), s)
    left, right = change(base, 0.05), change(base, 0.05)
    tips = {2: change(left, 0.02), 3: change(left, 0.3), 5: change(right, 0.02), 6: change(right, 0.02)}
    found = tree.hky_lengths([-1, 0, 1, 1, 0, 4, 4], tips)
    assert found[3] > 4 * found[2] and found[0] == 0 and (found[1:] > 0).all()
    nodes = nodes_of(spark, "((A,B),(C,D));")
    seqs = spark.createDataFrame([("t", i, n, "".join("TCAG"[k] for k in tips[t])) for i, (n, t) in enumerate(zip("ABCD", (2, 3, 5, 6), strict=True))], "aln_id string, seq_idx int, label string, seq string")
    lengths = {r.node_id: r.branch_length for r in tree.estimate_lengths(nodes, seqs).collect()}
    assert len(lengths) == 7 and lengths[3] > lengths[2]
    assert tree.estimate_lengths(nodes_of(spark, QUARTET), seqs).count() == 0

    def fails(parent, tips):
        raise RuntimeError

    assert tree.estimate_lengths(nodes, seqs, fails).where("branch_length IS NULL OR isnan(branch_length)").count() == 7


def test_parsimony(spark):
    nodes = nodes_of(spark, "((A,B),(C,D));")
    states = spark.createDataFrame([("t", 1, n, s) for n, s in zip("ABCD", "SSST", strict=True)], "tree_id string, site int, name string, state string")
    got = {r.node_id: (r.states, r.state, r.changed) for r in levels.parsimony_sets(nodes, states).collect()}
    assert got[0] == (["S"], "S", False) and got[4] == (["S", "T"], "S", False) and got[6] == (["T"], "T", True)
    assert tree.has_lengths(nodes).first().has_lengths is False and tree.distance_column(F.lit(None)) is not None


def random_parents(rng, n, deep):
    """Parents by id in no particular order of ids, and a length for each node."""
    ids = [int(x) for x in rng.permutation(3 * n)[:n]]
    parents = [None] + [ids[i - 1 if deep and rng.random() < 0.9 else int(rng.integers(i))] for i in range(1, n)]
    return [(i, p, float(rng.integers(0, 9)) / 8) for i, p in zip(ids, parents, strict=True)]


def test_tour_of_random_trees(spark):
    rng = np.random.default_rng(4)
    rows, want, places = [], {}, {}
    for t in range(12):
        nodes = random_parents(rng, int(rng.integers(1, 60)), t % 2)
        up, length = {i: p for i, p, _ in nodes}, {i: x for i, _, x in nodes}
        kids = {}
        for i, p, _ in nodes:
            kids.setdefault(p, []).append(i)
        stack, at = [kids[None][0]], 0
        while stack:
            i = stack.pop()
            places[f"t{t}", i] = at
            at += 1
            stack.extend(sorted(kids.get(i, []), reverse=True))

        def line(i, up=up):
            out = [i]
            while up[out[-1]] is not None:
                out.append(up[out[-1]])
            return out

        tips = sorted(i for i in up if i not in kids)
        for a in tips:
            for b in tips:
                if a < b:
                    x, y = line(a), line(b)
                    met = next(i for i in x if i in y)
                    want[f"t{t}", str(a), str(b)] = (len(line(met)) - 1, sum(length[i] for i in x[: x.index(met)]) + sum(length[i] for i in y[: y.index(met)]))
        rows += [(f"t{t}", i, p, x, i not in kids, str(i), i) for i, p, x in nodes]
    table = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, branch_length double, is_leaf boolean, name string, leaf_idx long")
    nodes = tour.toured(table)
    assert {(r.tree_id, r.node_id): r.pos for r in nodes.collect()} == places
    assert {(r.tree_id, r.a, r.b): (r.lca_depth, r.dist) for r in tree.patristic_pairs(nodes).collect()} == want


def test_tour_of_a_caterpillar(spark):
    levels = 10_000
    # inner nodes 0 to levels - 1, each with a tip of its own and the next one below it
    table = spark.range(levels).selectExpr("id AS node_id", "IF(id = 0, NULL, id - 1) AS parent_id", "0.5D AS branch_length", "false AS is_leaf", "NULL AS name")
    tips = spark.range(levels).selectExpr("id + 1000000 AS node_id", "id AS parent_id", "0.25D AS branch_length", "true AS is_leaf", "string(id) AS name")
    nodes = table.unionByName(tips).withColumn("tree_id", F.lit("t")).withColumn("leaf_idx", F.col("node_id"))
    found = tour.toured(nodes)
    assert found.agg(F.max("depth"), F.max("pos")).first() == (levels, 2 * levels - 1)
    some = tree.leaves(found).where("node_id % 997 = 3")
    got = tree.patristic_pairs(found, some).collect()
    assert len(got) == 45 and all(r.lca_depth == min(int(r.a), int(r.b)) and r.dist == 0.5 + 0.5 * abs(int(r.a) - int(r.b)) for r in got)


def test_pairs_are_made_in_squares_by_one_join(spark, monkeypatch):
    """Three trees whose leaves' order isn't the tour's, in squares of two leaves; nothing is looked up by pair."""
    monkeypatch.setattr(tour, "SIDE", 2)
    rng, rows, want = np.random.default_rng(5), [], {}
    for t, n in enumerate((2, 13, 47)):
        up = {0: None} | {i: int(rng.integers(max(0, i - 6), i)) for i in range(1, n)}
        tips = [i for i in up if i not in up.values()]
        place = dict(zip(tips, rng.permutation(len(tips)).tolist(), strict=True))
        length = {i: float(rng.integers(0, 9)) / 4 for i in up}
        line = lambda i, up=up: [i, *(line(up[i], up) if up[i] is not None else [])]
        for a in tips:
            for b in (x for x in tips if place[a] < place[x]):
                x, y = line(a, up), line(b, up)
                met = next(i for i in x if i in y)
                want[f"t{t}", f"s{a}", f"s{b}"] = (len(line(met, up)) - 1, sum(length[i] for i in (*x[: x.index(met)], *y[: y.index(met)])))
        rows += [(f"t{t}", i, p, length[i], i in place, f"s{i}", place.get(i)) for i, p in up.items()]
    table = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, branch_length double, is_leaf boolean, name string, leaf_idx int")
    pairs = tree.patristic_pairs(tour.toured(table))
    assert {(r.tree_id, r.a, r.b): (r.lca_depth, r.dist) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_loops_are_refused(spark, monkeypatch):
    monkeypatch.setattr(tour, "MOST_DOUBLINGS", 6)
    loop = spark.createDataFrame([("t", 1, 2, 1.0), ("t", 2, 1, 1.0)], "tree_id string, node_id long, parent_id long, branch_length double")
    with pytest.raises(ValueError):
        tour.rooted(loop)


def test_longest_paths_are_the_greedy_choice(spark):
    """500 random trees at once, with ties, zero lengths, unnamed and repeated leaves, and references in and outside the tree."""
    rng = np.random.default_rng(12)
    nodes, matched, reference, want = [], [], [], {}
    for t in range(500):
        unit = (1.0, 0.0, 1.0, 0.5, 2.0)[: 1 + t % 5]
        made = [(i, p, float(rng.choice(unit)) if t % 7 else None) for i, p, _ in random_parents(rng, int(rng.integers(2, 24)), t % 3 == 0)]
        if t % 50 == 49:
            made[-1] = (*made[-1][:2], -0.5)
        up, inner = {i: p for i, p, _ in made}, {p for _, p, _ in made}
        positive = any((x or 0) > 0 for _, p, x in made if p is not None)
        weight = {i: ((x or 0.0) if positive else 1.0) for i, _, x in made}
        tips = sorted(i for i in up if i not in inner)
        name = {i: f"s{i if t % 4 else i // 2}" for i in tips}
        nodes += [(f"t{t}", i, p, x, i not in inner, name.get(i), i) for i, p, x in made]
        labels = [(i, name[i]) for i in tips if rng.random() < 0.8] or [(tips[0], name[tips[0]])]
        matched += [(f"t{t}", label, i, label) for i, label in labels]
        ref = name[tips[int(rng.integers(len(tips)))]] if t % 6 else "'elsewhere'"
        reference.append((f"t{t}", ref))
        paths = {}
        for i in tips:
            at, path = i, []
            while at is not None:
                path.append((at, weight[at]))
                at = up[at]
            paths.setdefault(name[i], path)
        for most in (5,):
            want[f"t{t}"] = tree.greedy_diversity(paths, [label for _, label in sorted(labels)], ref, most)
    nodes = spark.createDataFrame(nodes, "tree_id string, node_id int, parent_id int, branch_length double, is_leaf boolean, name string, leaf_idx int")
    matched = spark.createDataFrame(matched, "aln_id string, label string, leaf_idx int, name string")
    got = {}
    for r in tree.select_species(nodes, matched, spark.createDataFrame(reference, "aln_id string, reference string"), 5).orderBy("aln_id", "species_idx").collect():
        got.setdefault(r.aln_id, []).append((r.label, r.gain))
    assert got == want


def test_parsimony_on_random_trees(spark):
    rng = np.random.default_rng(7)
    nodes, states, want = [], [], {}
    for t in range(25):
        made = random_parents(rng, int(rng.integers(1, 30)), t % 2)
        kids = {}
        for i, p, _ in made:
            kids.setdefault(p, []).append(i)
        nodes += [(f"t{t}", i, p, 1.0, i not in kids, str(i)) for i, p, _ in made]
        for site in (1, 2):
            tip = {i: rng.choice([None, "A", "C", "G"]) for i, _, _ in made if i not in kids}
            states += [(f"t{t}", site, str(i), s) for i, s in tip.items()]
            sets = {}
            for i, _, _ in reversed(made):
                votes = [s for k in kids.get(i, []) for s in sets[k]]
                sets[i] = [tip[i]] * (tip[i] is not None) if i in tip else sorted(s for s in set(votes) if votes.count(s) == max(map(votes.count, votes)))
            chosen = {None: None}
            for i, p, _ in made:
                chosen[i] = chosen[p] if chosen[p] in sets[i] or not sets[i] else sets[i][0]
                want[f"t{t}", site, i] = (sets[i], chosen[i], bool(sets[i]) and chosen[p] is not None and chosen[i] != chosen[p])
    nodes = spark.createDataFrame(nodes, "tree_id string, node_id long, parent_id long, branch_length double, is_leaf boolean, name string")
    states = spark.createDataFrame(states, "tree_id string, site int, name string, state string")
    found = levels.parsimony_sets(nodes, states)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert {(r.tree_id, r.site, r.node_id): (r.states, r.state, r.changed) for r in found.collect()} == want
    assert levels.parsimony_sets(nodes.limit(0), states).count() == 0
