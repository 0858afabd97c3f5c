import math
import re

import numpy as np
import pytest
from test_sources import NEXUS

from clademill.operators import model
from clademill.operators.onnx import score_onnx
from clademill.plans.pipeline import ScanOptions, scan
from clademill.sources.newick import parse_newick
from clademill.streaming.watch import watch

SMALL = model.ModelSpec(16, 4, 2, 1, 8, True)
TINY = model.ModelSpec(8, 2, 1, 3, 4, False)


def test_parameter_counts():
    count = lambda spec: sum(math.prod(s) for s in model.shapes(spec).values())
    assert count(model.REGRESSOR) == 884_449 and count(model.CLASSIFIER) == 125_961


def loop_row_attention(w, spec, x, dist, mask, i):
    """One site, species by species and head by head."""
    n, e, d = len(x), spec.embed, spec.embed // spec.heads
    q, k, v = (x @ w[f"row{i}.{c}.weight"].T + w[f"row{i}.{c}.bias"] for c in "qkv")
    out = np.zeros((n, e))
    for h in range(spec.heads):
        part = slice(h * d, (h + 1) * d)
        for a in range(n):
            s = np.array([-1e9 if mask[b] else q[a, part] @ k[b, part] / math.sqrt(d) - math.exp(w[f"row{i}.scale"][h, 0, 0]) * dist[a, b] for b in range(n)])
            p = np.exp(s - s.max())
            p /= p.sum()
            out[a, part] = sum(p[b] * math.log1p(1 / (dist[a, b] + 0.05)) * v[b, part] for b in range(n))
    return out @ w[f"row{i}.out.weight"].T + w[f"row{i}.out.bias"]


def loop_forward(w, spec, codons, aas, dist, coords, mask):
    norm = lambda x, k: (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * w[f"{k}.weight"] + w[f"{k}.bias"]
    lin = lambda x, k: x @ w[f"{k}.weight"].T + w[f"{k}.bias"]
    e, d = spec.embed, spec.embed // spec.heads
    x = np.concatenate([w["codon"][codons[:, 0]], w["aa"][aas[:, 0]]], -1) + w["position"][0, 0] + lin(coords, "mds")
    for i in range(spec.layers):
        value = lin(x, f"column{i}.qkv")[:, 2 * e :]  # a window of one attends to itself alone
        x = norm(x + lin(value, f"column{i}.out"), f"column{i}.norm1")
        x = norm(x + lin(np.maximum(lin(x, f"column{i}.wide"), 0), f"column{i}.narrow"), f"column{i}.norm2")
        x = norm(x + loop_row_attention(w, spec, x, dist, mask, i), f"row{i}.norm")
    q = w["pool"][0, 0] @ w["pool.qkv.weight"][:e].T + w["pool.qkv.bias"][:e]
    k, v = (x @ w["pool.qkv.weight"][a : a + e].T + w["pool.qkv.bias"][a : a + e] for a in (e, 2 * e))
    out = np.zeros(e)
    for h in range(spec.heads):
        part = slice(h * d, (h + 1) * d)
        s = np.where(mask, -1e9, k[:, part] @ q[part] / math.sqrt(d))
        p = np.exp(s - s.max())
        out[part] = (p / p.sum()) @ v[:, part]
    y = lin(lin(out, "pool.out"), "mlp1")
    y = 0.5 * y * (1 + np.array([math.erf(t / math.sqrt(2)) for t in y]))
    return float(lin(y, "mlp2")[0])


def inputs(seed=0, sites=5):
    rng = np.random.default_rng(seed)
    codons, aas = rng.integers(0, 66, (sites, 8, 1)), rng.integers(0, 23, (sites, 8, 1))
    d = rng.random((8, 8))
    return codons, aas, (d + d.T) * (1 - np.eye(8)), rng.normal(size=(8, 4)), np.arange(8) >= 6


def test_forward_matches_loops():
    w = {k: v + np.random.default_rng(3).normal(0, 0.1, v.shape) for k, v in model.seeded_weights(SMALL).items()}
    codons, aas, dist, coords, mask = inputs()
    got = model.predict(w, SMALL, codons, aas, dist, coords, mask, chunk=2)
    want = [loop_forward(w, SMALL, codons[i], aas[i], dist, coords, mask) for i in range(5)]
    assert np.allclose(got, want, atol=1e-10)
    other = codons.copy()
    other[:, 6:] = 0  # padded species change nothing but their own rows
    assert np.allclose(model.predict(w, SMALL, other, aas, dist, coords, mask), got, atol=1e-9)


def test_gradients():
    rng = np.random.default_rng(1)
    w = {k: v + rng.normal(0, 0.2, v.shape) for k, v in model.seeded_weights(TINY).items()}
    tokens, dist, y = rng.integers(0, 66, (3, 4, 3)), rng.random((3, 4, 4)), np.array([1.0, 0.0, 1.0])
    loss, grads = model.loss_and_gradient(w, TINY, tokens, dist, y, 2.5)
    for name in ("codon", "row0.scale", "row0.q.weight", "column0.qkv.weight", "pool", "pool.qkv.bias", "mlp1.weight", "row0.norm.weight", "position"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        up = {k: v.copy() for k, v in w.items()}
        up[name][at] += 1e-5
        assert (model.loss_and_gradient(up, TINY, tokens, dist, y, 2.5)[0] - loss) / 1e-5 == pytest.approx(grads[name][at], rel=1e-3)


def test_weights_file(tmp_path):
    w = model.seeded_weights(TINY)
    model.save_weights(str(tmp_path / "w.npz"), w)
    assert np.array_equal(model.load_weights(str(tmp_path / "w.npz"), TINY)["codon"], w["codon"])
    with pytest.raises(ValueError):
        model.load_weights(str(tmp_path / "w.npz"), SMALL)


def test_training_learns(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(96):
        y = i % 2
        tokens = rng.integers(0, 20, (4, 3)) + 30 * y
        rows.append((i, tokens.ravel().tolist(), [0.5] * 16, y))
    table = spark.createDataFrame(rows, "id long, tokens array<int>, dists array<double>, label int")
    best, found = model.train_classifier(table, table, TINY, epochs=2, batch_size=32, rate=0.02)
    last = found.orderBy("epoch").collect()[-1]
    assert best is not None and last.roc_auc > 0.9 and last.loss < 1


def test_attention_in_blocks():
    """Blocks of three queries and keys, in two sets of keys, against the whole matrix; scores of up to some thousands."""
    rng = np.random.default_rng(4)
    x, place = rng.normal(size=(11, 4)) * 40, rng.permutation(11) * 3.0
    far, values = np.abs(place[:, None] - place[None]), rng.normal(size=(11, 2))
    one = model.Value(x[None, None])
    want = model.row_attention(one, one, model.Value(values[None, None]), far[None], model.Value(np.ones((1, 1, 1, 1)))).data[0, 0]
    parts = [model.attention_sums(x, x[a:b], values[a:b], lambda i, j, m, n, a=a, b=b: far[i:j, a:b][:, m:n], step=3) for a, b in ((0, 7), (7, 11))]
    top = np.maximum(parts[0][0], parts[1][0])
    total, out = (sum(p[c] * np.exp(p[0] - top).reshape(-1, *[1] * (c - 1)) for p in parts) for c in (1, 2))
    assert np.allclose(out / total[:, None], want, atol=1e-12)


def test_a_labels_embeddings_meet_in_blocks(spark, monkeypatch):
    """Blocks of seven embeddings give what one block gives."""
    from clademill.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    whole = sorted(tuple(r) for r in Q.q27_attention_head(spark, sf).collect())
    monkeypatch.setattr(Q, "HEAD_ROWS", 7)
    assert np.allclose(sorted(tuple(r) for r in Q.q27_attention_head(spark, sf).collect()), whole, rtol=0, atol=1.1e-5)


def test_scores_in_small_arrays(spark, monkeypatch):
    """A row of scores at a time, distances made from places, with and without padding, against the whole forward pass; no alignment is broadcast."""
    rng = np.random.default_rng(6)
    w, places = model.seeded_weights(SMALL), rng.random(7) * 4
    values = {k: model.Value(v) for k, v in w.items()}
    for size in (7, 9):
        codons, aas, mask = rng.integers(0, 66, (5, size, 1)), rng.integers(0, 23, (5, size, 1)), np.arange(size) >= 7
        far, coords = np.zeros((size, size)), rng.random((size, 4))
        far[:7, :7] = np.abs(places[:, None] - places[None])
        want = model.forward(values, SMALL, codons, aas, far, coords, mask).data
        monkeypatch.setattr(model, "MOST_SCORES", 3)
        for dist in (far, model.Line(places, size)):
            assert np.allclose(model.predict(w, SMALL, codons, aas, dist, coords, mask), want, atol=1e-12)
        monkeypatch.undo()
    assert model.Value.remembers
    sites = spark.createDataFrame([("a", 1, [1, 2], [1, 2])], "aln_id string, site int, codon_toks array<int>, aa_toks array<int>")
    shapes = spark.createDataFrame([("a", 2, [0.0, 1.0], [0.1] * 8)], "aln_id string, n_species int, places array<double>, coords array<double>")
    scored = model.score_sites(sites, shapes, w, SMALL)
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()


def test_no_site_carries_a_matrix(spark):
    sites = spark.createDataFrame([("a", i, [1, 2], [1, 2]) for i in range(1, 5)], "aln_id string, site int, codon_toks array<int>, aa_toks array<int>")
    shapes = spark.createDataFrame([("a", 2, [0.0, 1.0, 1.0, 0.0], [0.1] * 8)], "aln_id string, n_species int, dists array<double>, coords array<double>")
    scored = model.score_sites(sites, shapes, model.seeded_weights(SMALL), SMALL)
    plan = scored._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        plan = plan.children().apply(0)
    sides = [{plan.children().apply(i).output().apply(k).name() for k in range(plan.children().apply(i).output().size())} for i in range(2)]
    assert "codon_toks" in sides[0] and "dists" not in sides[0] and "dists" in sides[1] and scored.count() == 4


def test_scan(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g1.nex").write_text(NEXUS)
    (tmp_path / "in" / "g2.nex").write_text(NEXUS.replace("BEGIN TREES", "BEGIN NOTHING"))
    options = ScanOptions(most_species=8, model=SMALL)
    w = model.seeded_weights(SMALL)
    options = ScanOptions(most_species=8, model=SMALL, branches_out=str(tmp_path / "branches"))
    found = scan(spark, str(tmp_path / "in"), w, options=options)
    assert "Format: Text" not in found._jdf.queryExecution().toString()  # alignments and trees are parsed once, before
    rows = sorted(tuple(r) for r in found.collect())
    branches = {(r.site, r.before, r.after, r.name, r.codon, r.aa) for r in spark.read.parquet(str(tmp_path / "branches")).where("tree_id = 'g1'").collect()}
    assert branches == {(3, "*", "W", "B", "TGG", "W")}
    assert len(rows) == 8 and [r[4] for r in rows] == [0, 1, 1, 0] * 2
    assert [(r[1], r[2], r[3]) for r in rows[:4]] == [(1, "ATG", "M"), (2, "TCA", "S"), (3, "TAA", "*"), (4, "AAA", "K")]
    assert all(r[5] == 0 and r[9] == "Neutral" for r in rows if not r[4])
    assert rows[1][5] != rows[5][5]  # the tree matters
    monkeypatch.setattr(model, "SITES", 2)  # blocks of sites change nothing
    blocks = scan(spark, str(tmp_path / "in"), w, options=options)
    assert sorted(tuple(r) for r in blocks.collect()) == rows
    again = scan(spark, str(tmp_path / "in"), w, options=ScanOptions(most_species=8, model=SMALL, estimate_lengths=True, trees_out=str(tmp_path / "trees")))
    assert again.count() == 8 and not spark.read.text(str(tmp_path / "trees")).count()  # the tree has lengths
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "g3.nex").write_text(re.sub(r":[0-9.]+", "", NEXUS))
    scan(spark, str(tmp_path / "bare"), w, options=ScanOptions(most_species=8, model=SMALL, estimate_lengths=True, trees_out=str(tmp_path / "trees")))
    name, text = spark.read.text(str(tmp_path / "trees")).first()[0].split("\t")
    plain = parse_newick(re.sub(r":[0-9.e-]+", "", text))
    assert name == "g3" and [n.name for n in plain if n.is_leaf] == [n.name for n in parse_newick(text) if n.is_leaf]
    assert all(n.branch_length > 0 for n in parse_newick(text)[1:])
    query = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), w, options)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def field(number, value):
    """One field of a protocol buffer message; numbers below 128 and contents of up to 16,383 bytes."""
    if isinstance(value, int):
        return bytes([number << 3, value])
    value = value.encode() if isinstance(value, str) else value
    size = bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 127 | 128, len(value) >> 7])
    return bytes([number << 3 | 2]) + size + value


def small_onnx(w):
    """A model with one step: y = product of x (n, 3, 2) with ``w`` (2, 4)."""
    dims = lambda *d: b"".join(field(1, field(2, x) if isinstance(x, str) else field(1, x)) for x in d)
    info = lambda name, *d: field(1, name) + field(2, field(1, field(1, 1) + field(2, dims(*d))))
    node = field(1, "x") + field(1, "w") + field(2, "y") + field(4, "MatMul")
    tensor = field(1, w.shape[0]) + field(1, w.shape[1]) + field(2, 1) + field(8, "w") + field(9, w.astype("<f4").tobytes())
    graph = field(1, node) + field(2, "g") + field(5, tensor) + field(11, info("x", "n", 3, 2)) + field(12, info("y", "n", 3, 4))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_onnx(spark):
    pytest.importorskip("onnxruntime")
    w = np.arange(8).reshape(2, 4)
    x = np.random.default_rng(3).random((20, 6))
    rows = [(i, "k", r.tolist()) for i, r in enumerate(x)] + [(20, None, None), (21, "k", [1.0])]
    table = spark.createDataFrame(rows, "id int, scores string, x array<double>")
    found = {r[0]: r for r in score_onnx(table, small_onnx(w), {"x": ("x", (3, 2))}, "id", "x", chunk=7).collect()}
    assert len(found) == 22 and found[20].scores is None and found[21].scores is None
    for i in range(20):
        assert np.allclose(found[i].scores, (x[i].astype(np.float32).reshape(3, 2) @ w).ravel(), rtol=1e-5)
    assert score_onnx(table.limit(0), small_onnx(w), {"x": ("x", (3, 2))}, "id").count() == 0
