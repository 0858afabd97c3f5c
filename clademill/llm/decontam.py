"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the positions of a run of tokens and ignore the others, so a run that differs from a benchmark item by
substitutions at ignored positions still has the same hash. Hashes of training texts are joined with those of benchmark items; around
each hit the tokens of both are compared, and what counts there is measured on the whole texts.

The masks are complete: an overlap that counts has a hit, wherever its substitutions are (a test goes through all cases). Both sides
may be of any size; a bitmap of bounded size keeps most hashes that no item has from the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import discard, in_bitmap, key_bitmap, materialise, split_of
from clademill.llm.exact_dedup import may_be_in
from clademill.llm.minhash import mixed

#: Fixed values by the number of tokens of an item: 1 marks a position that counts.
MASKS = {5: ("1111", "11011", "11101", "10111"), 7: ("1111", "11101"), 16: ("1111011", "10101111", "1110100011")}
#: An overlap counts from so many equal tokens (or this share of a shorter item) and this share of equal tokens.
LEAST_TOKENS, LEAST_SHARE = 13, 0.8
#: Items of fewer tokens match only whole texts.
SHORTEST = 5
#: Any overlap of over 31 tokens that counts splits into parts of 16 to 31, one of which counts. So these tokens from a hit's start on suffice.
BEFORE, AFTER = 28, 36
CACHED, SLICE = 200_000, 200
_WORD = re.compile(r"[^\W_]+")
_RANDOM = np.random.default_rng(31)
_FACTORS = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = dict(zip(sorted({m for ms in MASKS.values() for m in ms}), _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64), strict=False))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1  # never zero, which stands for no token
        return found


def tokens(text: str | None, known: _Words) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits; ``known``: those that the task has met before."""
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def masks_of(length: int) -> tuple[str, ...]:
    return MASKS[max(n for n in MASKS if n <= length)] if length >= SHORTEST else ()


def needed(length: int) -> int:
    """Equal tokens that an overlap with an item of ``length`` tokens needs."""
    return min(LEAST_TOKENS, -(-4 * length // 5))


def seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """The signed hash of the selected tokens at each place."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, _SALTS[mask])
    for i, x in enumerate(mask):
        if x == "1":
            out += ids[i : i + n] * _FACTORS[i]
    return mixed(out).view(np.int64)


def whole(ids: np.ndarray) -> int:
    """The signed hash of a whole short text."""
    return int(mixed((ids * _FACTORS[: len(ids)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(ids))).view(np.int64)[0])


def widest(same: np.ndarray) -> tuple[int, int, int]:
    """``start, length, equal`` of the stretch with most equal tokens among those with a share of at least ``LEAST_SHARE``; it starts and ends on equal ones."""
    # that share means that equal - 4 * different, summed up, isn't negative
    total = np.append(0, np.cumsum(np.where(same, 1, -4)))
    reach = np.maximum.accumulate(total[::-1])[::-1]
    stops = len(total) - np.searchsorted(reach[::-1], total, "left") - 1
    count = np.append(0, np.cumsum(same))
    start = int((count[stops] - count).argmax())
    hits = np.flatnonzero(same[start : stops[start]])
    return (start + int(hits[0]), int(hits[-1] - hits[0]) + 1, len(hits)) if len(hits) else (0, 0, 0)


def _benchmark(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``item, item_id, tokens`` (a row for each item with tokens) and ``seed, item, place``."""
    source = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            ids = [tokens(x.as_py(), known).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary())], names=["item", "item_id", "tokens"])

    def sown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(data.as_py(), np.uint64)
                found = [seeds(ids, m) for m in masks_of(len(ids))] or [np.array([whole(ids)])]
                places = np.concatenate([np.arange(len(x)) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.full(len(places), item)), pa.array(places)], names=["seed", "item", "place"])

    kind = source.schema["item_id"].dataType.simpleString()
    items = materialise(source.mapInArrow(tokenised, f"item long, item_id {kind}, tokens binary").where("octet_length(tokens) > 0"), "items")
    return items, materialise(items.select("item", "tokens").mapInArrow(sown, "seed long, item long, place long"), "seeds")


def _sighted(bitmap, used: tuple[str, ...]):
    """Hits of texts: ``t1, t2, seed, at, window``; the window holds 32 bits of each token from ``BEFORE`` the hit on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                docs = [tokens(x.as_py(), known) for x in part.column(2)]
                sizes = np.fromiter(map(len, docs), np.int64, len(docs))
                ids, ends = np.concatenate([*docs, np.zeros(0, np.uint64)]), np.cumsum(sizes)
                rows, places, found = [], [], []
                short = [n for n, x in enumerate(docs) if 0 < len(x) < SHORTEST]
                if short:
                    hashes = np.array([whole(docs[n]) for n in short])
                    ok = in_bitmap(bitmap.value, hashes)
                    rows.append(np.array(short)[ok])
                    places.append((ends - sizes)[short][ok])
                    found.append(hashes[ok])
                for mask in used:
                    hashes = seeds(ids, mask)
                    at = np.flatnonzero(in_bitmap(bitmap.value, hashes))
                    row = np.searchsorted(ends, at, "right")
                    inside = at + len(mask) <= ends[row]
                    rows.append(row[inside])
                    places.append(at[inside])
                    found.append(hashes[at[inside]])
                row, place, hashes = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (rows, places, found))
                if len(row):
                    wide = np.concatenate([np.zeros(BEFORE, np.uint32), ids.astype(np.uint32), np.zeros(AFTER, np.uint32)])
                    index = place[:, None] + np.arange(BEFORE + AFTER)
                    window = wide[index]
                    begin, end = (ends - sizes)[row][:, None], ends[row][:, None]
                    window[(index - BEFORE < begin) | (index - BEFORE >= end)] = 0
                    columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(hashes), pa.array(place - begin[:, 0]), pa.array([x.tobytes() for x in window], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "seed", "at", "window"])

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``t1, t2, item, place, at, window, tokens`` those with an overlap that counts within the window, as ``t1, t2, item, diagonal``."""
    for batch in batches:
        items = batch.column(6).dictionary_encode()
        texts = [np.frombuffer(x, np.uint64).astype(np.uint32) for x in items.dictionary.to_pylist()]
        wide = [np.concatenate([np.zeros(BEFORE, np.uint32), x, np.zeros(AFTER, np.uint32)]) for x in texts]
        of, places = items.indices.to_pylist(), batch.column(3).to_pylist()
        keep = []
        for window, n, q in zip(batch.column(5), of, places, strict=True):
            mine = np.frombuffer(window.as_py(), np.uint32)
            theirs = wide[n][q : q + BEFORE + AFTER]
            same = (mine == theirs) & (mine != 0)
            need = needed(len(texts[n]))
            if len(texts[n]) < SHORTEST:
                keep.append(bool((mine == theirs).all()))
            else:
                keep.append(int(same.sum()) >= need and widest(same)[2] >= need)
        some = batch.filter(pa.array(keep, pa.bool_()))
        diagonal = some.column(4).to_numpy() - some.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(diagonal)], names=["t1", "t2", "item", "diagonal"])


def _keys(text: str) -> tuple[Column, Column]:
    """128 bits of a text in two columns."""
    return F.xxhash64(F.col(text)), F.xxhash64(F.lit(7), F.col(text))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    one, two = _keys(text)
    return docs.where(F.col(text).isNotNull()).select(one.alias("t1"), two.alias("t2"), F.col(text).alias("text"))


def suspects(docs: DataFrame, items: DataFrame, sown: DataFrame, text: str = "text") -> DataFrame:
    """``t1, t2, item, diagonal``: the texts (by two hashes), the items they overlap, and the shift between both. A written table."""
    lengths = [r[0] for r in items.select(F.least(F.floor(F.octet_length("tokens") / 8), F.lit(max(MASKS))).alias("n")).distinct().collect()]  # 16 at most
    used = tuple(sorted({m for n in lengths for m in masks_of(n)}))
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(sown, "seed"))
    hits = _texts(docs, text).mapInArrow(_sighted(bitmap, used), "t1 long, t2 long, seed long, at long, window binary")
    # written, so that no task has two Python workers: Spark keeps those of earlier stages, whose memory adds up
    met = materialise(hits.join(sown, "seed").select("t1", "t2", "item", "place", "at", "window"), "hits")
    both = met.join(items.select("item", "tokens"), "item").select("t1", "t2", "item", "place", "at", "window", "tokens")
    out = materialise(both.mapInArrow(_judged, "t1 long, t2 long, item long, diagonal long").distinct(), "suspects")
    discard(met)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap with most equal tokens of a text and an item among the given diagonals."""
    known = _Words()
    for batch in batches:
        rows = []
        for data, item, diagonals in zip(batch.column(3), batch.column(4), batch.column(5).to_pylist(), strict=True):
            doc, bench = tokens(data.as_py(), known), np.frombuffer(item.as_py(), np.uint64)
            best = (0, 0, 0, 0)
            for shift in sorted(diagonals):
                p, q = max(0, shift), max(0, -shift)
                n = min(len(doc) - p, len(bench) - q)
                start, length, equal = widest(doc[p : p + n] == bench[q : q + n])
                if equal > best[3]:
                    best = (p + start, q + start, length, equal)
            rows.append(best)
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((),) * 4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["t1", "t2", "item", "doc_start", "item_start", "overlap", "equal"])


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that overlap: ``doc_id, item_id, doc_start, item_start, overlap, equal``
    (places and lengths in tokens; ``equal`` of the ``overlap`` tokens agree: the stretch without shifts that has most of them).

    An overlap counts if at least ``LEAST_SHARE`` of its tokens are equal and at least ``LEAST_TOKENS`` are, or that share of a shorter item.
    Tokens are lower-cased runs of letters and digits, over whole texts. Items of fewer than ``SHORTEST`` tokens match only texts
    equal to them, those without tokens match nothing. Null and empty texts have no overlap. Repeated documents or items give a
    row each; null ids are kept; other columns, whatever their names, are ignored; an empty table on either side gives an empty one.
    """
    items, sown = _benchmark(benchmark, item_id, item_text)
    found = suspects(docs, items, sown, text).groupBy("t1", "t2", "item").agg(F.collect_set("diagonal").alias("diagonals"))
    found = materialise(found, "pairs")
    some = may_be_in(_texts(docs, text), "t1", found, "t1").join(found.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
    some = some.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    both = found.join(some, ["t1", "t2"]).join(items.select("item", "tokens"), "item").select("t1", "t2", "item", "text", "tokens", "diagonals")
    measured = materialise(both.mapInArrow(_measured, "t1 long, t2 long, item long, doc_start long, item_start long, overlap long, equal long"), "overlaps")
    one, two = _keys(text)
    rows = may_be_in(docs.select(F.col(doc_id).alias("doc_id"), one.alias("t1"), two.alias("t2")), "t1", measured, "t1")
    out = rows.join(measured, ["t1", "t2"]).join(items.select("item", "item_id"), "item")
    return out.select("doc_id", "item_id", "doc_start", "item_start", "overlap", "equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, by the rule of ``overlaps``. Only rows that may overlap one are shuffled."""
    found = suspects(docs, *_benchmark(benchmark, item_id, item_text), text).select("t1", "t2").distinct()
    t1, t2, maybe = split_of(docs, "t1", "t2", "maybe")
    bitmap = materialise(found.select(F.col("t1").alias(t1), F.col("t2").alias(t2)), "contaminated")
    one, two = _keys(text)
    flagged = may_be_in(docs.withColumn(t1, F.when(F.col(text).isNotNull(), one)).withColumn(t2, two), t1, bitmap, t1, maybe)
    clean = flagged.where(~F.col(maybe)).select(*docs.columns)
    return clean.unionByName(flagged.where(F.col(maybe)).join(bitmap, [t1, t2], "left_anti").select(*docs.columns))
