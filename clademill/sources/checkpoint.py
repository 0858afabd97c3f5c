"""Model checkpoints: tables of arrays that any shared file system holds, and weights out of published zip checkpoints."""

from __future__ import annotations

import pickle
import re
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from clademill.operators.model import ModelSpec, Weights, shapes

# Element types of stored tensors, and the published parameter names (with ``#`` for a layer) beside those used here.
_TYPES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4"}
_NAMES = {
    "codon_embedding.weight": "codon",
    "embedding.weight": "codon",
    "aa_embedding.weight": "aa",
    "pos_embedding": "position",
    "mds_proj": "mds",
    "col_layers.#.self_attn.in_proj_weight": "column#.qkv.weight",
    "col_layers.#.self_attn.in_proj_bias": "column#.qkv.bias",
    "col_layers.#.self_attn.out_proj": "column#.out",
    "col_layers.#.linear1": "column#.wide",
    "col_layers.#.linear2": "column#.narrow",
    "col_layers.#.norm1": "column#.norm1",
    "col_layers.#.norm2": "column#.norm2",
    "row_layers.#.q_proj": "row#.q",
    "row_layers.#.k_proj": "row#.k",
    "row_layers.#.v_proj": "row#.v",
    "row_layers.#.out_proj": "row#.out",
    "row_layers.#.phylo_scale": "row#.scale",
    "row_norms.#": "row#.norm",
    "pool_query": "pool",
    "pool_attn.in_proj_weight": "pool.qkv.weight",
    "pool_attn.in_proj_bias": "pool.qkv.bias",
    "pool_attn.out_proj": "pool.out",
    "mlp.0": "mlp1",
    "mlp.3": "mlp2",
}


class _Inert:
    """Stands for every object of a checkpoint that isn't a tensor; does nothing."""

    def __init__(self, *_: object, **__: object):
        pass

    def __setstate__(self, _: object) -> None:
        pass

    def __setitem__(self, *_: object) -> None:
        pass

    def append(self, _: object) -> None:
        pass

    def extend(self, _: object) -> None:
        pass


class _Tensors(pickle.Unpickler):
    """Reads the list of tensors and imports nothing: no name in the file is ever looked up."""

    def __init__(self, archive: zipfile.ZipFile, root: str):
        super().__init__(archive.open(f"{root}data.pkl"))
        self.archive, self.root = archive, root

    def find_class(self, module: str, name: str) -> object:
        if (module, name) == ("collections", "OrderedDict"):
            return dict
        if module == "torch" and name in _TYPES:
            return np.dtype(_TYPES[name])
        if module == "torch._utils" and name == "_rebuild_tensor_v2":
            return self._tensor
        if module == "torch._utils" and name == "_rebuild_parameter":
            return lambda data, *_: data
        return _Inert

    def persistent_load(self, pid: tuple) -> np.ndarray | _Inert:
        _, kind, key, *_ = pid
        return np.frombuffer(self.archive.read(f"{self.root}data/{key}"), kind) if isinstance(kind, np.dtype) else _Inert()

    @staticmethod
    def _tensor(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_: object) -> np.ndarray | _Inert:
        if not isinstance(storage, np.ndarray):
            return _Inert()
        if offset < 0 or any(n < 0 for n in (*size, *stride)) or (all(size) and offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) >= len(storage)):
            raise ValueError("a tensor reaches beyond its storage")
        return np.lib.stride_tricks.as_strided(storage[offset:], size, [s * storage.itemsize for s in stride]).copy()


def _own_name(name: str) -> str | None:
    layer = re.search(r"\.(\d+)(?=\.|$)", name) if name.startswith(("col_layers", "row_layers", "row_norms")) else None
    general = name[: layer.start(1)] + "#" + name[layer.end(1) :] if layer else name
    for theirs, ours in _NAMES.items():
        for end in ("", ".weight", ".bias"):
            if general == theirs + end:
                return (ours + end).replace("#", layer[1] if layer else "#")
    return None


def import_weights(path: str, spec: ModelSpec) -> Weights:
    """Weights from a published zip checkpoint (``model_state_dict``, or the bare state). Nothing in the file is executed; names and
    shapes have to be the specification's."""
    with zipfile.ZipFile(path) as archive:
        found = [n for n in archive.namelist() if n.endswith("data.pkl")]
        if not found:
            raise ValueError(f"{path}: no tensors")
        state = _Tensors(archive, found[0].removesuffix("data.pkl")).load()
    state = state.get("model_state_dict", state) if isinstance(state, dict) else {}
    weights = {_own_name(k) or k: np.asarray(v, np.float64) for k, v in state.items() if isinstance(v, np.ndarray)}
    wanted = shapes(spec)
    wrong = {k for k, s in wanted.items() if k not in weights or weights[k].shape != s} | (weights.keys() - wanted.keys())
    if wrong:
        raise ValueError(f"weights do not fit the model: {sorted(wrong)[:5]}")
    return weights


def save_checkpoint(spark: SparkSession, path: str, weights: Weights, epoch: int, metric: float, step: int = 0, first: Weights | None = None, second: Weights | None = None) -> None:
    """One Parquet row an array: ``part`` (weights, or the optimizer's first and second moments), ``name, shape, data, epoch, metric, step``."""
    parts = {"weights": weights, "first": first or {}, "second": second or {}}
    rows = [(part, k, list(v.shape), np.ascontiguousarray(v, "<f8").tobytes(), epoch, float(metric), step) for part, group in parts.items() for k, v in group.items()]
    table = spark.createDataFrame(rows, "part string, name string, shape array<int>, data binary, epoch int, metric double, step int")
    table.coalesce(1).write.mode("overwrite").parquet(path)  # a few megabytes, fixed by the specification


def load_checkpoint(spark: SparkSession, path: str, part: str = "weights") -> tuple[Weights, DataFrame]:
    """The arrays of a part, and one row ``epoch, metric, step``."""
    table = spark.read.parquet(path)
    arrays = {r["name"]: np.frombuffer(r["data"], "<f8").reshape(r["shape"]).copy() for r in table.where(table["part"] == part).collect()}
    return arrays, table.select("epoch", "metric", "step").limit(1)
