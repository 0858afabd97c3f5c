"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths slide over one-hot bytes; each filter's maximum over a window goes into a softmax. Texts are read whole,
as batched fixed-length windows that overlap by the widest filter less one, so no n-gram is lost at an edge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import materialise, split_of

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 12, 256
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
#: Windows at a time.
BLOCK = 4096
#: Bound of the training sample: rows of each language, read whole.
ROWS_EACH = 400
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: bytes) -> np.ndarray:
    """All windows of a text as rows of bytes, zero-padded; A-Z count as a-z."""
    data = np.frombuffer(text.lower(), np.uint8)
    n = max(1, -(-(len(data) - WINDOW + STRIDE) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class ByteConvNet:
    """``taps[j]``: what byte ``j`` of an n-gram adds to each filter; narrower filters have zeros in the later taps."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, total = list(classes), FILTERS * len(WIDTHS)
        self.width = np.repeat(WIDTHS, FILTERS)
        self.taps = rng.normal(0, 0.3, (max(WIDTHS), 256, total)).astype(np.float32)
        for j in range(max(WIDTHS)):
            self.taps[j][:, self.width <= j] = 0
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, len(classes))).astype(np.float32)
        self.base = np.zeros(len(classes), np.float32)
        self._pairs = None

    def _maxima(self, w: np.ndarray) -> np.ndarray:
        """Each filter's maximum over each window. Taps are looked up two bytes at a time."""
        if self._pairs is None:
            self._pairs = [(self.taps[j][:, None, :] + self.taps[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(self.taps), 2)]
        two = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
        n = STRIDE
        y = self._pairs[0][two[:, :n]]
        y[:, :, FILTERS:] += self._pairs[1][:, FILTERS:][two[:, 2 : n + 2]]
        return y.max(axis=1) + self.bias

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        h = np.concatenate([np.maximum(self._maxima(w[i : i + 128]), 0) for i in range(0, len(w), 128)])
        z = h @ self.out + self.base
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, w: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
        """Adam on cross-entropy; the gradient of a maximum reaches only the n-gram it is at."""
        rng = np.random.default_rng(seed)
        names = ("taps", "bias", "out", "base")
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(w))
            for i in range(0, len(order), batch):
                x, y = w[order[i : i + batch]], labels[order[i : i + batch]]
                self._pairs = None
                raw, at = self._maxima_at(x)
                h = np.maximum(raw, 0)
                z = h @ self.out + self.base
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                d = (p @ self.out.T) * (raw > 0)
                grad = {"out": h.T @ p, "base": p.sum(axis=0), "bias": d.sum(axis=0), "taps": np.zeros_like(self.taps)}
                rows, filters = np.arange(len(x))[:, None], np.arange(d.shape[1])[None, :]
                for j in range(len(self.taps)):
                    np.add.at(grad["taps"][j], (x[rows, at + j], filters), d * (self.width > j))
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    change = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - change).astype(np.float32))
        self._pairs = None
        return self

    def _maxima_at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = sum(self.taps[j][x[:, j : j + STRIDE]] for j in range(len(self.taps)))
        at = y.argmax(axis=1)
        return np.take_along_axis(y, at[:, None, :], 1)[:, 0] + self.bias, at

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """The language of each text and its probability, averaged over all its windows by their bytes, ``BLOCK`` windows at a time."""
        out: list[tuple[str, float]] = []
        group: list[tuple[int, np.ndarray, np.ndarray]] = []
        rows = 0
        sums: dict[int, np.ndarray] = {}

        def finish() -> None:
            nonlocal group, rows
            if group:
                p = self.probabilities(np.concatenate([x for _, x, _ in group]))
                at = 0
                for i, x, weight in group:
                    sums[i] = sums.get(i, 0) + weight @ p[at : at + len(x)].astype(np.float64)
                    at += len(x)
            group, rows = [], 0

        for i, text in enumerate(texts):
            out.append((UNKNOWN, 0.0))
            if not self.classes or not _LETTER.search(text.decode("utf-8", "replace")):
                continue
            x = windows(text)
            weight = np.full(len(x), STRIDE, np.float64)
            weight[-1] = max(1, len(text) - STRIDE * (len(x) - 1))
            weight /= weight.sum()
            for at in range(0, len(x), BLOCK):
                group.append((i, x[at : at + BLOCK], weight[at : at + BLOCK]))
                rows += len(group[-1][1])
                if rows >= 512:
                    finish()
        finish()
        for i, mean in sums.items():
            best = int(mean.argmax())
            out[i] = (self.classes[best], float(min(1.0, mean[best])))
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, langs, found = [], [], []
        for key, lang, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for window in windows(data):
                keys.append(key)
                langs.append(lang)
                found.append(window.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["key", "lang", "window"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ByteConvNet:
    """Learns from rows that are not held out and have a language and a letter: all windows of about ``ROWS_EACH`` rows of each language,
    those with the lowest hashes. Every language that such a row has is a class. No such row: every text is ``und``."""
    rows = docs.where(~held_out(F.col(doc_id))).where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("data"))
    counts = materialise(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.pmod("key", F.lit(1 << 20))).alias("least")), "languages")
    classes = sorted(r[0] for r in counts.select("lang").collect())
    if not classes:
        return ByteConvNet([])
    # a language always has the row with its lowest hash
    most = F.greatest(F.lit(ROWS_EACH) / F.col("n") * (1 << 20), F.col("least") + 1)
    sample = rows.join(counts, "lang").where(F.pmod("key", F.lit(1 << 20)) < most).select("key", "lang", F.col("data").cast("binary").alias("data"))
    got = sorted(tuple(r) for r in sample.mapInArrow(_examples, "key long, lang string, window binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, WINDOW)
    return ByteConvNet(classes).fit(x, np.array([classes.index(r[1]) for r in got]))


def _scored(net: ByteConvNet, at: int):
    net._pairs = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = net.predict([x or b"" for x in part.column(at).to_pylist()])
                columns = [*part.columns[:at], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:at], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteConvNet, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) of every row.

    A text that is null, empty or without a letter is ``und`` with score 0. Very long texts are read whole, in blocks. Repeated
    rows and null ids are scored like any other; other columns are ignored; an empty table gives an empty one.
    """
    (data,) = split_of(docs, "data")
    source = docs.select(*keep, F.col(text).cast("binary").alias(data))
    schema = source.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return source.mapInArrow(_scored(net, len(keep)), schema)


def keep_identified(docs: DataFrame, net: ByteConvNet, text: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``least``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = net.predict([(x or "").encode("utf-8", "replace") for x in part.column(at).to_pylist()])
                yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
