"""The axial-attention site models in numpy: scoring in Arrow-fed tasks and synchronous data-parallel training.

Two specifications share one forward pass: the regressor (codon and amino-acid embeddings, ordination coordinates, padding mask,
distance-weighted values) and the classifier (codon embedding only, no mask, no weighting).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.functions.codon import sigmoid
from clademill.operators.metrics import average_precision, batches, best_epoch, class_balance, roc_auc
from clademill.plans.storage import new_path


@dataclass(frozen=True)
class ModelSpec:
    embed: int
    heads: int
    layers: int
    window: int
    most_species: int
    regressor: bool


#: Sites of an alignment that are scored together.
SITES = 512
#: Batches between two rows of the progress table.
LOG_EVERY = 50
REGRESSOR = ModelSpec(128, 8, 4, 1, 256, True)
CLASSIFIER = ModelSpec(64, 4, 2, 5, 100, False)


class Value:
    """An array that remembers how it was made, for gradients."""

    __slots__ = ("data", "grad", "_back", "_from")
    #: Off while only results are wanted: then nothing that a value was made from is held.
    remembers = True

    def __init__(self, data: np.ndarray, made_from: tuple[Value, ...] = (), back: Callable[[np.ndarray], None] | None = None):
        self.data, self.grad = data, None
        self._from, self._back = (made_from, back) if Value.remembers else ((), None)

    def take(self, g: np.ndarray) -> None:
        while g.ndim > self.data.ndim:
            g = g.sum(axis=0)
        for i, n in enumerate(self.data.shape):
            if n == 1 and g.shape[i] != 1:
                g = g.sum(axis=i, keepdims=True)
        self.grad = g if self.grad is None else self.grad + g

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack.extend((x, False) for x in v._from)
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v._back and v.grad is not None:
                v._back(v.grad)

    def __add__(self, other: Value) -> Value:
        return Value(self.data + other.data, (self, other), lambda g: (self.take(g), other.take(g)))

    def __mul__(self, other: Value) -> Value:
        return Value(self.data * other.data, (self, other), lambda g: (self.take(g * other.data), other.take(g * self.data)))

    def __matmul__(self, other: Value) -> Value:
        return Value(self.data @ other.data, (self, other), lambda g: (self.take(g @ np.swapaxes(other.data, -1, -2)), other.take(np.swapaxes(self.data, -1, -2) @ g)))

    def reshape(self, *shape: int) -> Value:
        return Value(self.data.reshape(shape), (self,), lambda g: self.take(g.reshape(self.data.shape)))

    def transpose(self, *axes: int) -> Value:
        return Value(self.data.transpose(axes), (self,), lambda g: self.take(g.transpose(np.argsort(axes))))

    def at(self, index: tuple) -> Value:
        def back(g: np.ndarray) -> None:
            whole = np.zeros_like(self.data)
            np.add.at(whole, index, g)
            self.take(whole)

        return Value(self.data[index], (self,), back)

    def relu(self) -> Value:
        return Value(np.maximum(self.data, 0), (self,), lambda g: self.take(g * (self.data > 0)))

    def exp(self) -> Value:
        out = np.exp(self.data)
        return Value(out, (self,), lambda g: self.take(g * out))

    def gelu(self) -> Value:
        half = 0.5 * (1 + _erf(self.data / math.sqrt(2)))
        density = np.exp(-0.5 * self.data**2) / math.sqrt(2 * math.pi)
        return Value(self.data * half, (self,), lambda g: self.take(g * (half + self.data * density)))

    def softmax(self) -> Value:
        e = np.exp(self.data - self.data.max(axis=-1, keepdims=True))
        p = e / e.sum(axis=-1, keepdims=True)
        return Value(p, (self,), lambda g: self.take(p * (g - (g * p).sum(axis=-1, keepdims=True))))

    def normalise(self, eps: float = 1e-5) -> Value:
        centred = self.data - self.data.mean(axis=-1, keepdims=True)
        scale = 1 / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + eps)
        y = centred * scale
        return Value(y, (self,), lambda g: self.take(scale * (g - g.mean(axis=-1, keepdims=True) - y * (g * y).mean(axis=-1, keepdims=True))))


_erf = np.vectorize(math.erf, otypes=[np.float64])
Weights = dict[str, np.ndarray]


def shapes(spec: ModelSpec) -> dict[str, tuple[int, ...]]:
    """Every parameter's shape."""
    e, out = spec.embed, {}

    def linear(name: str, a: int, b: int) -> None:
        out[f"{name}.weight"], out[f"{name}.bias"] = (b, a), (b,)

    def norm(name: str) -> None:
        out[f"{name}.weight"], out[f"{name}.bias"] = (e,), (e,)

    if spec.regressor:
        out["codon"], out["aa"] = (66, e // 2), (23, e // 2)
        linear("mds", 4, e)
    else:
        out["codon"] = (66, e)
    out["position"] = (1, spec.window, e)
    for i in range(spec.layers):
        linear(f"column{i}.qkv", e, 3 * e)
        linear(f"column{i}.out", e, e)
        linear(f"column{i}.wide", e, 2 * e)
        linear(f"column{i}.narrow", 2 * e, e)
        norm(f"column{i}.norm1")
        norm(f"column{i}.norm2")
        for x in "qkv":
            linear(f"row{i}.{x}", e, e)
        linear(f"row{i}.out", e, e)
        out[f"row{i}.scale"] = (spec.heads, 1, 1)
        norm(f"row{i}.norm")
    out["pool"] = (1, 1, e)
    linear("pool.qkv", e, 3 * e)
    linear("pool.out", e, e)
    linear("mlp1", e, e)
    linear("mlp2", e, 1)
    return out


def seeded_weights(spec: ModelSpec, seed: int = 42) -> Weights:
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes(spec).items():
        if name.endswith("bias") or name.endswith("scale"):
            out[name] = np.zeros(shape)
        elif "norm" in name:
            out[name] = np.ones(shape)
        else:
            out[name] = rng.normal(0, 1 / math.sqrt(shape[-1]), shape)
    return out


def save_weights(path: str, weights: Weights) -> None:
    np.savez(path, **weights)


def load_weights(path: str, spec: ModelSpec) -> Weights:
    """From an ``.npz`` file without pickled objects; names and shapes have to be the specification's."""
    with np.load(path, allow_pickle=False) as found:
        weights = {k: found[k] for k in found.files}
    wrong = {k for k, s in shapes(spec).items() if k not in weights or weights[k].shape != s} | (weights.keys() - shapes(spec).keys())
    if wrong:
        raise ValueError(f"weights do not fit the model: {sorted(wrong)[:5]}")
    return weights


def row_attention(q: Value, k: Value, v: Value, far: np.ndarray, scale: Value, mask: np.ndarray | None = None, weighted: bool = True) -> Value:
    """Attention among species, by batch and head, that distance holds back: ``scale`` times the distances ``far`` (batch x species x
    species) is taken from the scores, padding (``mask``) gets no attention, and ``weighted`` attention counts near species more."""
    if not Value.remembers:
        return Value(_attended(q.data, k.data, v.data, far, scale.data, mask, weighted))
    s = q @ k.transpose(0, 1, 3, 2) * Value(np.array(1 / math.sqrt(q.data.shape[-1]))) + scale * Value(-far[:, None])
    if mask is not None:
        at = mask[None, None, None, :]
        s = Value(np.where(at, -1e9, s.data), (s,), lambda g, s=s: s.take(np.where(at, 0.0, g)))
    a = s.softmax()
    return (a * Value(np.log1p(1 / (far[:, None] + 0.05))) if weighted else a) @ v


def _scores(q: np.ndarray, k: np.ndarray, far: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return q @ np.swapaxes(k, -1, -2) * (1 / math.sqrt(q.shape[-1])) - scale * far


class Line:
    """Distances of species with places on a line, made for some rows at a time; padding up to ``size`` species is at no distance from any."""

    ndim = 2

    def __init__(self, places: np.ndarray, size: int):
        self.places, self.shape = places, (size, size)

    def __getitem__(self, at: tuple[slice, slice]) -> np.ndarray:
        """``line[:, i:j]``: a batch of one, as of a matrix."""
        rows, n = range(self.shape[0])[at[1]], len(self.places)
        out = np.zeros((1, len(rows), self.shape[1]))
        mine = self.places[rows.start : rows.stop]
        out[0, : len(mine), :n] = np.abs(mine[:, None] - self.places[None])
        return out


#: Numbers in an array of scores.
MOST_SCORES = 1 << 21


def _attended(q: np.ndarray, k: np.ndarray, v: np.ndarray, far: np.ndarray | Line, scale: np.ndarray, mask: np.ndarray | None, weighted: bool) -> np.ndarray:
    """``row_attention`` for some queries at a time, so that no array has the square of the number of species."""
    batch, heads, n, _ = q.shape
    out, step = np.empty(v.shape), max(1, MOST_SCORES // (batch * heads * n))
    for i in range(0, n, step):
        there = far[:, i : i + step][:, None]
        s = _scores(q[:, :, i : i + step], k, there, scale)
        if mask is not None:
            s[..., mask] = -1e9
        s -= s.max(axis=-1, keepdims=True)
        np.exp(s, out=s)
        total = s.sum(axis=-1, keepdims=True)
        if weighted:
            s *= np.log1p(1 / (there + 0.05))
        out[:, :, i : i + step] = s @ v / total
    return out


def attention_sums(q: np.ndarray, k: np.ndarray, v: np.ndarray, far: Callable[[int, int, int, int], np.ndarray], scale: float = 1.0, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What some keys add to ``row_attention`` of one head, weighted, by query: the greatest score, the sum of ``exp(score - greatest)`` and the weighted
    sum of values under it. Sums over other keys are joined to these by ``exp`` of the differences of their greatest scores. ``far``: distances
    from the queries ``i`` to ``j`` to the keys ``m`` to ``n``. Scores are held for ``step`` queries and keys at a time."""
    top, total, out = np.full(len(q), -np.inf), np.zeros(len(q)), np.zeros((len(q), v.shape[1]))
    for i in range(0, len(q), step):
        at = slice(i, i + step)
        for m in range(0, len(k), step):
            there = far(i, i + step, m, m + step)
            s = _scores(q[at], k[m : m + step], there, np.array(scale))
            high = np.maximum(top[at], s.max(axis=1))
            kept = np.exp(top[at] - high)
            e = np.exp(s - high[:, None])
            total[at] = total[at] * kept + e.sum(axis=1)
            out[at] = out[at] * kept[:, None] + (e * np.log1p(1 / (there + 0.05))) @ v[m : m + step]
            top[at] = high
    return top, total, out


def forward(w: dict[str, Value], spec: ModelSpec, codons: np.ndarray, aas: np.ndarray | None, dist: np.ndarray | Line, coords: np.ndarray | None = None, mask: np.ndarray | None = None) -> Value:
    """One number per site. ``codons, aas``: sites x species x window; ``dist``: species x species (or one each site); ``coords``:
    species x 4; ``mask``: species, true for padding."""
    sites, species, width = codons.shape
    e, h = spec.embed, spec.heads
    d = e // h
    const = Value

    def linear(x: Value, name: str) -> Value:
        return x @ w[f"{name}.weight"].transpose(1, 0) + w[f"{name}.bias"]

    def norm(x: Value, name: str) -> Value:
        return x.normalise() * w[f"{name}.weight"] + w[f"{name}.bias"]

    def heads(x: Value) -> Value:
        n, length, _ = x.data.shape
        return x.reshape(n, length, h, d).transpose(0, 2, 1, 3)

    def joined(x: Value) -> Value:
        n, _, length, _ = x.data.shape
        return x.transpose(0, 2, 1, 3).reshape(n, length, e)

    hidden = const(np.where(mask, -1e9, 0.0)[None, None, None, :]) if mask is not None else None

    def scores(q: Value, k: Value, masked: bool) -> Value:
        s = q @ k.transpose(0, 1, 3, 2) * const(np.array(1 / math.sqrt(d)))
        return s + hidden if masked and hidden is not None else s

    def self_attention(name: str, query: Value, x: Value, masked: bool) -> Value:
        weight, bias = w[f"{name}.qkv.weight"], w[f"{name}.qkv.bias"]
        part = lambda i, y: heads(y @ weight.at((slice(i * e, (i + 1) * e),)).transpose(1, 0) + bias.at((slice(i * e, (i + 1) * e),)))
        return linear(joined(scores(part(0, query), part(1, x), masked).softmax() @ part(2, x)), f"{name}.out")

    if spec.regressor:
        codon, aa = w["codon"].at((codons,)), w["aa"].at((aas,))
        joint = Value(np.concatenate([codon.data, aa.data], axis=-1), (codon, aa), lambda g: (codon.take(g[..., : e // 2]), aa.take(g[..., e // 2 :])))
        x = joint + w["position"].reshape(1, 1, width, e)
        x = x + linear(const(coords[None]), "mds").reshape(1, species, 1, e)
    else:
        x = w["codon"].at((codons,)) + w["position"].reshape(1, 1, width, e)
    far = dist if isinstance(dist, Line) else dist[None] if dist.ndim == 2 else np.repeat(dist, width, axis=0)
    for i in range(spec.layers):
        c = x.reshape(sites * species, width, e)
        c = norm(c + self_attention(f"column{i}", c, c, False), f"column{i}.norm1")
        c = norm(c + linear(linear(c, f"column{i}.wide").relu(), f"column{i}.narrow"), f"column{i}.norm2")
        r = c.reshape(sites, species, width, e).transpose(0, 2, 1, 3).reshape(sites * width, species, e)
        q, k, v = (heads(linear(r, f"row{i}.{n}")) for n in "qkv")
        a = row_attention(q, k, v, far, w[f"row{i}.scale"].exp().reshape(1, h, 1, 1), mask if spec.regressor else None, spec.regressor)
        r = norm(r + linear(joined(a), f"row{i}.out"), f"row{i}.norm")
        x = r.reshape(sites, width, species, e).transpose(0, 2, 1, 3)
    centre = x.at((slice(None), slice(None), width // 2))
    query = w["pool"] * const(np.ones((sites, 1, 1)))
    pooled = self_attention("pool", query, centre, spec.regressor).reshape(sites, e)
    return linear(linear(pooled, "mlp1").gelu(), "mlp2").reshape(sites)


def predict(weights: Weights, spec: ModelSpec, codons: np.ndarray, aas: np.ndarray | None, dist: np.ndarray | Line, coords: np.ndarray | None = None, mask: np.ndarray | None = None, chunk: int = 64) -> np.ndarray:
    """Scores in chunks of sites, fewer where there are many species, and attention for some species at a time, which bounds the arrays."""
    values = {k: Value(v) for k, v in weights.items()}
    chunk = min(chunk, max(1, MOST_SCORES // max(1, math.prod(codons.shape[1:]) * spec.embed)))
    before, Value.remembers = Value.remembers, False
    try:
        parts = [forward(values, spec, codons[i : i + chunk], None if aas is None else aas[i : i + chunk], dist if dist.ndim == 2 else dist[i : i + chunk], coords, mask).data for i in range(0, len(codons), chunk)]
    finally:
        Value.remembers = before
    return np.concatenate(parts) if parts else np.zeros(0)


def score_sites(sites: DataFrame, alignments: DataFrame, weights: Weights, spec: ModelSpec = REGRESSOR, pad: bool = True) -> DataFrame:
    """``aln_id, site, score`` of the given sites. Filter variable sites first: the model is opaque to the optimiser and sites don't depend on each other.

    ``sites``: ``aln_id, site, codon_toks, aa_toks`` (arrays of species times window). ``alignments``: ``aln_id, n_species, dists``
    (flat matrix) and ``coords`` (flat, 4 a species); in place of ``dists``, ``places`` on a line, whose differences are the distances, so that alignments
    of many species need no matrix. Sites are dealt out by blocks of ``SITES`` of an alignment, and a block meets one copy of the
    matrix; no site's row carries it. ``pad`` fills up to the specification's number of species.
    """
    shared = sites.sparkSession.sparkContext.broadcast(weights)  # a few megabytes, fixed by the specification
    rows = sites.select("aln_id", "site", "codon_toks", "aa_toks", F.floor(F.col("site") / SITES).cast("int").alias("block"))
    blocks = rows.select(F.col("aln_id").alias("aln"), F.col("block").alias("part")).distinct()
    far = "places" if "places" in alignments.columns else "dists"
    # a matrix made in a projection counts as a few bytes where Spark looks for what to broadcast, which would send all of them through the driver
    shapes_ = alignments.select(F.col("aln_id").alias("aln"), "n_species", far, "coords").hint("merge").join(blocks, "aln")

    def run(part: pd.DataFrame, shape: pd.DataFrame) -> pd.DataFrame:
        if part.empty or shape.empty:
            return pd.DataFrame({"aln_id": [], "site": [], "score": []})
        n = int(shape["n_species"].iloc[0])
        size = max(n, spec.most_species) if pad else n
        coords = np.zeros((size, 4))
        if far == "places":
            dist = Line(np.asarray(shape["places"].iloc[0]), size)
        else:
            dist = np.zeros((size, size))
            dist[:n, :n] = np.asarray(shape["dists"].iloc[0]).reshape(n, n)
        coords[:n] = np.asarray(shape["coords"].iloc[0]).reshape(n, 4)
        codons, aas = np.full((len(part), size, spec.window), 65), np.full((len(part), size, spec.window), 22)
        codons[:, :n] = np.stack(part["codon_toks"].to_numpy()).reshape(len(part), n, spec.window)
        aas[:, :n] = np.stack(part["aa_toks"].to_numpy()).reshape(len(part), n, spec.window)
        mask = np.arange(size) >= n
        scores = predict(shared.value, spec, codons, aas, dist, coords, mask if spec.regressor else None)
        return pd.DataFrame({"aln_id": part["aln_id"], "site": part["site"], "score": scores})

    dealt = rows.groupBy("aln_id", "block").cogroup(shapes_.groupBy("aln", "part"))
    return dealt.applyInPandas(run, "aln_id string, site int, score double")


class AdamW:
    def __init__(self, weights: Weights, rate: float = 1e-3, decay: float = 1e-2):
        self.rate, self.decay, self.step = rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))

    def update(self, weights: Weights, grads: Weights) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g**2
            weights[k] = weights[k] * (1 - self.rate * self.decay) - self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)


def loss_and_gradient(weights: Weights, spec: ModelSpec, tokens: np.ndarray, dist: np.ndarray, label: np.ndarray, pos_weight: float) -> tuple[float, Weights]:
    """Sums over sites of the weighted cross-entropy with logits, and its gradients."""
    values = {k: Value(v) for k, v in weights.items()}
    logit = forward(values, spec, tokens, None, dist)
    z, y = logit.data, label
    weight = np.where(y > 0, pos_weight, 1.0)
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    root = Value(np.array([loss]), (logit,), lambda g: logit.take(weight * (1 / (1 + np.exp(-z)) - y)))
    root.backward()
    return loss, {k: v.grad if v.grad is not None else np.zeros_like(v.data) for k, v in values.items()}


def _arrays(frame: pd.DataFrame, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.stack(frame["tokens"].to_numpy()).reshape(len(frame), -1, spec.window)
    return tokens, np.stack(frame["dists"].to_numpy()).reshape(len(frame), tokens.shape[1], tokens.shape[1])


def train_classifier(train: DataFrame, validation: DataFrame, spec: ModelSpec = CLASSIFIER, epochs: int = 5, batch_size: int = 128, rate: float = 1e-3, seed: int = 42, key: str = "id", checkpoint: str | None = None, progress: str | None = None) -> tuple[Weights | None, DataFrame]:
    """The weights of the best epoch by average precision (None if no epoch is above 0), and the metrics table ``epoch, loss, roc_auc,
    pr_auc``. Rows: a unique key, ``tokens`` and ``dists`` (flat), ``label``.

    Each batch is one job: tasks compute gradients of their rows, of which one set a task is gathered, and the driver takes the step.
    Rows are written in the order of their batches once an epoch, so that a step reads the files of its own batch only. The positive class is weighted by the training rows' balance.
    ``checkpoint``: a path for the best epoch's arrays (``sources.checkpoint``). ``progress``: a path for a table ``epoch, batch, loss, scales``
    (the first layer's distance scales by head), every ``LOG_EVERY`` batches.
    """
    from clademill.sources.checkpoint import save_checkpoint

    spark = train.sparkSession
    weights, found, best, top = seeded_weights(spec, seed), [], None, 0.0
    pos_weight = class_balance(train).first()["pos_weight"]
    optimizer = AdamW(weights, rate)
    for epoch in range(1, epochs + 1):
        path = new_path(spark, "batches")
        dealt = batches(train, key, batch_size, epoch).select("batch", "tokens", "dists", "label")
        dealt.repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(path)
        dealt = spark.read.schema(dealt.schema).parquet(path)
        last, losses, log = dealt.agg(F.max("batch")).first()[0], [], []
        for number in range(0 if last is None else last + 1):
            shared = spark.sparkContext.broadcast(weights)

            def gradient(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                n, total, sums = 0, 0.0, None
                for frame in frames:
                    for i in range(0, len(frame), 32):
                        part = frame.iloc[i : i + 32]
                        loss, grads = loss_and_gradient(shared.value, spec, *_arrays(part, spec), part["label"].to_numpy(float), pos_weight)
                        n, total = n + len(part), total + loss
                        sums = grads if sums is None else {k: sums[k] + g for k, g in grads.items()}
                if n:
                    yield pd.DataFrame({"n": [n], "loss": [total], "grads": [np.concatenate([sums[k].ravel() for k in shapes(spec)]).tobytes()]})

            rows = dealt.where(F.col("batch") == number).select("tokens", "dists", "label").mapInPandas(gradient, "n long, loss double, grads binary").collect()
            n, flat = sum(r["n"] for r in rows), sum(np.frombuffer(r["grads"]) for r in rows)
            grads, at = {}, 0
            for name, shape in shapes(spec).items():
                size = math.prod(shape)
                grads[name] = flat[at : at + size].reshape(shape) / n
                at += size
            optimizer.update(weights, grads)
            losses.append(sum(r["loss"] for r in rows) / n)
            shared.destroy()
            if (number + 1) % LOG_EVERY == 0:
                log.append((epoch, number + 1, losses[-1], np.exp(weights["row0.scale"]).ravel().tolist()))
        if progress and log:
            spark.createDataFrame(log, "epoch int, batch int, loss double, scales array<double>").coalesce(1).write.mode("overwrite" if epoch == 1 else "append").parquet(progress)
        scored = score_classifier(validation, weights, spec)
        roc, pr = roc_auc(scored).first()[0], average_precision(scored).first()[0]
        found.append((epoch, float(np.mean(losses)) if losses else 0.0, roc, pr))
        if pr > top:
            best, top = dict(weights), pr
            if checkpoint:
                save_checkpoint(spark, checkpoint, best, epoch, pr, optimizer.step, optimizer.m, optimizer.v)
    return best, spark.createDataFrame(found, "epoch int, loss double, roc_auc double, pr_auc double")


def score_classifier(rows: DataFrame, weights: Weights, spec: ModelSpec = CLASSIFIER) -> DataFrame:
    """``label, score``: the probability of a positive label."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(weights))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                tokens, dist = _arrays(frame, spec)
                yield pd.DataFrame({"label": frame["label"].astype("int32"), "logit": predict(shared.value, spec, tokens, None, dist)})

    logits = rows.select("tokens", "dists", "label").mapInPandas(run, "label int, logit double")
    return logits.select("label", sigmoid(F.col("logit")).alias("score"))


__all__ = ["CLASSIFIER", "REGRESSOR", "ModelSpec", "best_epoch", "forward", "load_weights", "predict", "save_weights", "score_sites", "seeded_weights", "shapes", "train_classifier"]
