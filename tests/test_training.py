import collections
import io
import pickle
import zipfile

import numpy as np
import pytest
from test_model_pipeline import SMALL, TINY

from clademill.operators import model, training
from clademill.sources import checkpoint

TREE = "((b:1,a:2):1,x:4);"
GENE = f"#NEXUS\nBEGIN TAXA;\nTAXLABELS 'a' 'b' 'c';\nEND;\nBEGIN CHARACTERS;\nMATRIX\nTTTTTC\nTTA---TCAT\nGGGGGG\n;\nEND;\nBEGIN TREES;\nTREE t = {TREE}\nEND;\n"
LABELS = "gene_name string, site_index int, id long, label int"


def made(spark, path, labels, window=3, most=4):
    sequences, nodes = training.read_training(spark, path)
    species = training.training_species(sequences, nodes, most)
    rows = training.training_tokens(spark.createDataFrame(labels, LABELS), sequences, species, window, most)
    return training.with_distances(rows, training.training_distances(species, nodes, most), most)


def test_training_rows(spark, tmp_path):
    (tmp_path / "g1.nex").write_text(GENE)
    (tmp_path / "g2.nex").write_text(GENE.replace(TREE, "((a"))
    labels = [("g1", 1, 1, 1), ("g1", 3, 2, 0), ("g1", 3, 3, 0), ("g2", 2, 4, 1), ("none", 1, 5, 1), ("g1", 9, 6, 0)]
    got = {r.id: r for r in made(spark, str(tmp_path), labels).collect()}
    assert got.keys() == set(range(1, 7))
    assert got[1].tokens == [65, 2, 64, 65, 0, 1, 65, 65, 65, 65, 65, 65]  # leaves in the tree's order; x has no sequence; padding
    assert got[2].tokens == got[3].tokens == [64, 6, 65, 1, 65, 65, 65, 65, 65, 65, 65, 65]
    assert got[4].tokens == [0, 1, 65, 2, 64, 6, 63, 63, 65, 65, 65, 65] and set(got[4].dists) == {0.0}  # no tree: the sequences' order
    assert set(got[5].tokens) == {0} and set(got[5].dists) == {0.0} and set(got[6].tokens) == {65}
    assert np.array_equal(np.reshape(got[1].dists, (4, 4)), [[0, 3, 6, 0], [3, 0, 7, 0], [6, 7, 0, 0], [0, 0, 0, 0]])
    few = {r.id: r for r in made(spark, str(tmp_path), labels, most=1).collect()}
    assert few[1].tokens == [65, 2, 64] and few[4].tokens == [0, 1, 65] and few[1].dists == [0.0]


def test_training_empty(spark, tmp_path):
    (tmp_path / "g1.nex").write_text(GENE)
    assert made(spark, str(tmp_path), []).count() == 0


def test_training_checkpoint_and_progress(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model, "LOG_EVERY", 2)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(0, 20, 12) + 30 * (i % 2)).tolist(), [0.5] * 16, i % 2) for i in range(64)]
    table = spark.createDataFrame(rows, "id long, tokens array<int>, dists array<float>, label int")
    best, epochs = model.train_classifier(table, table, TINY, epochs=2, batch_size=16, rate=0.02, checkpoint=str(tmp_path / "c"), progress=str(tmp_path / "p"))
    weights, state = checkpoint.load_checkpoint(spark, str(tmp_path / "c"))
    moments, _ = checkpoint.load_checkpoint(spark, str(tmp_path / "c"), "second")
    assert weights.keys() == best.keys() == moments.keys() and all(np.array_equal(weights[k], best[k]) for k in best)
    top = max(epochs.collect(), key=lambda r: (r.pr_auc, -r.epoch))
    row = state.first()
    assert (row.epoch, row.metric, row.step) == (top.epoch, top.pr_auc, 4 * top.epoch)
    log = spark.read.parquet(str(tmp_path / "p")).orderBy("epoch", "batch").collect()
    assert [(r.epoch, r.batch, len(r.scales)) for r in log] == [(1, 2, 2), (1, 4, 2), (2, 2, 2), (2, 4, 2)]


def published(path, state, monkeypatch, **others):
    """A zip checkpoint as tensor libraries write it."""
    import sys
    import types

    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    torch.FloatStorage = type("FloatStorage", (), {"__module__": "torch"})
    utils._rebuild_tensor_v2 = eval("lambda *a: a")
    utils._rebuild_tensor_v2.__module__, utils._rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    torch._utils = utils
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    blobs = {}

    class Tensor:
        def __init__(self, a):
            self.a = a

        def __reduce__(self):
            key = str(len(blobs))
            blobs[key] = self.a.astype("<f4")
            stride = tuple(s // 4 for s in np.zeros(self.a.shape, "<f4").strides)
            return utils._rebuild_tensor_v2, (Storage(key, self.a.size), 0, self.a.shape, stride, False, collections.OrderedDict())

    class Storage:
        def __init__(self, key, n):
            self.pid = ("storage", torch.FloatStorage, key, "cpu", n)

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            return getattr(x, "pid", None)

    out = io.BytesIO()
    Pickler(out, 2).dump({"epoch": 3, "model_state_dict": collections.OrderedDict((k, Tensor(v)) for k, v in state.items()), **others})
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("best/data.pkl", out.getvalue())
        for k, v in blobs.items():
            z.writestr(f"best/data/{k}", v.tobytes())


class Harm:
    def __reduce__(self):
        return (exec, ("open('/tmp/clademill-harm', 'w').write('x')",))


def test_published_checkpoint(tmp_path, monkeypatch):
    import os

    want = model.seeded_weights(SMALL)
    theirs = {}
    for name, value in want.items():
        found = next(k for i in range(SMALL.layers) for general in checkpoint._NAMES for end in ("", ".weight", ".bias")
                     if general != "embedding.weight" and checkpoint._own_name(k := (general + end).replace("#", str(i))) == name)
        theirs[found] = value
    assert "col_layers.0.self_attn.in_proj_weight" in theirs and "row_norms.0.weight" in theirs and "mlp.3.bias" in theirs
    published(tmp_path / "m.pt", theirs, monkeypatch, optimizer_state_dict=Harm())
    got = checkpoint.import_weights(str(tmp_path / "m.pt"), SMALL)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert not os.path.exists("/tmp/clademill-harm")
    with pytest.raises(ValueError):
        checkpoint.import_weights(str(tmp_path / "m.pt"), TINY)
