"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of lexicon hits (a fixed list, and stems learned from labelled texts), how near hits stand to the second
person, and rates of capitals, punctuation and obfuscated spelling. Trees and calibration are fitted in numpy.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import materialise, split_of

#: Bound of the training sample, in labelled rows; those with the lowest hashes are taken.
MOST_ROWS = 20_000
#: A learned stem occurs in so many toxic texts.
LEAST_TEXTS = 4
STEM = 5
FOLDS = 4

#: Insults by language.
INSULTS = frozenset(
    """idiot idiots stupid dumb moron morons loser losers clown clowns scum trash garbage pathetic worthless disgusting fool fools jerk
    imbecile crap damn bastard bitch shit fuck fucking asshole kill die hate ugly
    idiote imbécile crétin débile connard salaud ordure merde nul pourri abruti
    dumm idiotisch trottel arschloch scheiße abschaum müll widerlich wertlos verlierer
    idiota estúpido imbécil basura asqueroso perdedor mierda cabrón inútil payaso""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre du dich dir dein deine ihr euch tú ti usted vosotros".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"\S+")
_ODD = re.compile(r"[^\W\d_][\d@$!*.\-_]+[^\W\d_]")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
NAMES = (
    "words", "chars_a_word", "fixed", "fixed_hits", "strong", "strong_hits", "weak", "weak_hits", "weight", "weight_sum", "most", "distinct",
    "second_person", "near_second_person", "capitals", "capital_words", "exclaim", "question", "punctuation", "odd_spelling", "repeats", "hidden",
)


def stems(word: str) -> tuple[str, str]:
    """The whole word and its beginning, which are looked up apart."""
    return "=" + word, word[:STEM]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Dense features of a whole text; an empty one has all zeros. ``lexicon``: log-odds of learned stems."""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    get = lexicon.get
    fixed = second = near = strong = weak = 0
    total = most = 0.0
    last_hit = last_you = -99
    found = set()
    for i, word in enumerate(words):
        weight = max(get("=" + word, 0.0), get(word[:STEM], 0.0))
        insult = word in INSULTS
        if weight:
            total += weight
            most = max(most, weight)
            found.add(word)
            if weight >= 2.5:
                strong += 1
            else:
                weak += 1
        fixed += insult
        hit = insult or weight >= 2.5
        if hit:
            last_hit = i
            near += i - last_you <= 4
        if word in SECOND_PERSON:
            second += 1
            last_you = i
            near += i - last_hit <= 4
    chars = len(text)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    shout = sum(1 for w in _WORD.findall(text) if len(w) > 2 and w.isupper()) if upper > n // 50 else 0
    odd = _ODD.findall(low)
    hidden = 0
    if odd:
        for run in _RUN.findall(low):
            if _ODD.search(run):
                plain = re.sub(r"[^\w]|_|\d", "", run.translate(_LEET))
                hidden += plain in INSULTS or get("=" + plain, 0.0) >= 2.5
    marks = sum(1 for c in text if not c.isalnum() and not c.isspace())
    return [
        math.log1p(n), chars / n, fixed / n, fixed, strong / n, strong, weak / n, weak, total / n, total, most, len(found),
        second / n, near / n, upper / chars, shout / n, text.count("!") / n, text.count("?") / n, marks / chars, len(odd) / n, len(_REPEAT.findall(low)) / n, hidden / n,
    ]


class BoostedTrees:
    """Gradient boosting for logistic loss over binned features; each tree is an array of (feature, threshold, left, right, value)."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 5, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1) if len(x) else x
        score = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            tree: list[list[float]] = []
            self._grow(tree, binned, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    def _grow(self, tree: list, binned: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        at, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
        tree.append([-1, 0.0, -1, -1, self.rate * total_g / (total_h + self.ridge)])
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * self.least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                n, sg, sh = (np.bincount(b, w, len(c) + 1)[:-1].cumsum() for w in (None, g[rows], h[rows]))
                gain = sg**2 / (sh + self.ridge) + (total_g - sg) ** 2 / (total_h - sh + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] >= 0:
            left = binned[rows, best[1]] <= best[2]
            a = self._grow(tree, binned, cuts, g, h, rows[left], depth - 1)
            b = self._grow(tree, binned, cuts, g, h, rows[~left], depth - 1)
            tree[at][:4] = [best[1], float(cuts[best[1]][best[2]]), a, b]
        return at

    @staticmethod
    def _tree(tree: list, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
        feature, left, right = feature.astype(int), left.astype(int), right.astype(int)
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(len(tree)):
            inner = feature[node] >= 0
            if not inner.any():
                break
            go = x[rows, np.maximum(feature[node], 0)] <= cut[node]
            node = np.where(inner, np.where(go, left[node], right[node]), node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the steps' scores and their means, each smoothed a little towards the overall rate."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], high]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    at = np.array([(b[2] + b[3]) / 2 for b in blocks])
    mean = np.array([(b[0] + rate) / (b[1] + 1) for b in blocks])
    return at, np.maximum.accumulate(mean)


class Scorer:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, at: np.ndarray, mean: np.ndarray):
        self.lexicon, self.trees, self.at, self.mean = lexicon, trees, at, mean

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        raw = self.trees.predict(x)
        # the calibrated step decides; the raw score orders texts within it
        return np.clip(0.98 * np.interp(raw, self.at, self.mean) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fold, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = {s for w in set(_WORD.findall(text.lower())) for s in stems(w)}
            n = len(found)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([fold] * n, pa.int32()), pa.array([toxic] * n, pa.int32()), pa.array(list(found))], names=["fold", "toxic", "stem"])


def _lexicon(counts: list[tuple[str, list[int], list[int]]], rows: list[tuple[int, int]], folds: list[int], least: int) -> dict[str, float]:
    """Log-odds of the stems that mark toxic texts in ``folds``. ``counts``: by fold, toxic and other texts with each stem."""
    toxic, other = (sum(rows[f][i] for f in folds) for i in (0, 1))
    out = {}
    for stem, t, o in counts:
        a, b = sum(t[f] for f in folds), sum(o[f] for f in folds)
        if a < least:
            continue
        odds = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (other - b + 0.5))
        if odds - 1.6 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > 0.5:
            out[stem] = odds
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> Scorer:
    """Learns from at most about ``MOST_ROWS`` labelled rows that are not held out, those with the lowest hashes.

    Stems for the features of each fold are learned on the other folds, so trees see them as they will be on new texts; the scorer
    then uses stems of all. Calibration uses scores of trees fitted on the other folds. Without labels of both kinds every score is
    the share of toxic rows, or 0.5. Of labels repeated for one id a positive one counts; other columns, whatever their names, are ignored.
    """
    usable = labels.where(~held_out(F.col(doc_id)) & F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    usable = usable.groupBy(F.col(doc_id).alias("id")).agg((F.max(toxic) > 0).cast("int").alias("toxic"))
    total = usable.count()
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(min(1.0, MOST_ROWS / max(1, total)) * (1 << 20)))
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = source.join(F.broadcast(chosen), "id")  # about MOST_ROWS different ids bound the broadcast
    rows = materialise(rows.select("toxic", "text", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    sizes = [[0, 0] for _ in range(FOLDS)]
    for fold, is_toxic, n in rows.groupBy("fold", "toxic").count().collect():
        sizes[fold][1 - is_toxic] = n
    if not sum(s[0] for s in sizes) or not sum(s[1] for s in sizes):
        share = sum(s[0] for s in sizes) / max(1, sum(map(sum, sizes))) if sum(map(sum, sizes)) else 0.5
        return Scorer({}, BoostedTrees(), np.array([0.0]), np.array([share]))
    stem = rows.select("fold", "toxic", "text").mapInArrow(_stem_rows, "fold int, toxic int, stem string").groupBy("stem")
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"n{f}_{t}") for t in (1, 0) for f in range(FOLDS)]
    marked = sum(F.col(f"n{f}_1") for f in range(FOLDS))
    share = sum(s[0] for s in sizes) / sum(map(sum, sizes))
    plain = sum(F.col(f"n{f}_0") for f in range(FOLDS))
    found = stem.agg(*sums).where((marked >= LEAST_TEXTS) & (marked > (marked + plain) * share * 1.4)).collect()  # stems of a bounded sample
    counts = [(r[0], list(r[1 : 1 + FOLDS]), list(r[1 + FOLDS :])) for r in found]
    lexicons = [_lexicon(counts, sizes, [g for g in range(FOLDS) if g != f], LEAST_TEXTS - 1) for f in range(FOLDS)]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, is_toxic, texts = (c.to_pylist() for c in batch.columns)
            x = [features(t, lexicons[f]) for f, t in zip(fold, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["fold", "toxic", "x"])

    got = sorted((r[0], r[1], list(r[2])) for r in rows.select("fold", "toxic", "text").mapInArrow(told, "fold int, toxic int, x array<double>").collect())
    fold, y, x = np.array([r[0] for r in got]), np.array([float(r[1]) for r in got]), np.array([r[2] for r in got])
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        raw[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).predict(x[fold == f])
    at, mean = isotonic(raw, y)
    return Scorer(_lexicon(counts, sizes, list(range(FOLDS)), LEAST_TEXTS), BoostedTrees().fit(x, y), at, mean)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every row; a null or empty text has the score of a text without any sign.

    Whole texts are read, however long. Repeated rows and null ids are scored like any other; other columns are ignored; an empty
    table gives an empty one.
    """
    (data,) = split_of(docs, "data")
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(data))
    schema = source.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = scorer.score(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, pa.float64())], names=[*keep, "score"])

    return source.mapInArrow(run, schema)
