"""Fuzzy line dedup by MinHash.

Every line is signed from all its character shingles. Lines that share a band of minima are compared (see ``minhash``) by exact
Jaccard similarity of their sets of shingles, and distributed union-find joins what links.

Signing and verification run in Arrow batches: with DataFrame functions alone, splitting, normalising and hashing lines and shingles
takes all the CPU time the check tool grants, before any minimum is taken (figures in the README).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm import minhash
from clademill.llm.common import discard, in_bitmap, key_bitmap, materialise, split_of
from clademill.llm.exact_dedup import may_be_in

SHINGLE, LEAST = 8, 0.8
#: Documents at a time, code points hashed at a time, and keys that a task remembers so as to sign a repeated line once.
SLICE, BLOCK, REMEMBERED = 200, 1 << 18, 1 << 19
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal_lines(text: str | None) -> list[str]:
    """A text's lines in lower case, trimmed, with single spaces; a null text has none."""
    return [] if text is None else [" ".join(x.split()) for x in text.lower().split("\n")]


def line_key(line: str) -> int:
    """A signed 64-bit hash of a normalised line."""
    key = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return key - (1 << 64) if key >> 63 else key


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the shingles of many lines, repeats included, in blocks: ``hashes, starts, numbers``, where a run of hashes begins at each
    of ``starts`` and is of the line of that number. A long line has several runs. A line shorter than ``size`` is its own only shingle."""
    block: list[str] = []
    numbers: list[int] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # lines hold no line feed, so the padding tells a short line's shingle from others
        points = np.frombuffer(("".join(x + "\n" * size for x in block)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        runs = np.maximum(1, lengths - size + 1)
        offsets = np.cumsum(lengths + size) - lengths - size
        h = np.zeros(len(points) - size + 1, np.uint64)
        for i in range(size):
            h += points[i : len(points) - size + 1 + i] * _MULTIPLIERS[i]
        starts = np.cumsum(runs) - runs
        at = np.arange(int(runs.sum())) + np.repeat(offsets - starts, runs)
        return minhash.mixed(h[at]), starts, np.array(numbers)

    for n, line in enumerate(lines):
        for at in range(0, max(1, len(line) - size + 1), BLOCK):
            block.append(line[at : at + BLOCK + size - 1])
            numbers.append(n)
            held += len(block[-1]) + size
            if held >= BLOCK:
                yield flush()
                block, numbers, held = [], [], 0
    if block:
        yield flush()


def signatures(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """The minima of each line's shingles."""
    out = np.full((len(lines), minhash.BANDS * minhash.ROWS), np.iinfo(np.uint32).max, np.uint32)
    for hashes, starts, numbers in shingle_hashes(lines, size):
        low = minhash.minima(hashes, starts)
        np.minimum.at(out, numbers, low)
    return out


def shingle_sets(lines: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Each line's different shingle hashes in order."""
    parts: list[list[np.ndarray]] = [[] for _ in lines]
    for hashes, starts, numbers in shingle_hashes(lines, size):
        ends = np.append(starts[1:], len(hashes)).tolist()
        for n, a, b in zip(numbers.tolist(), starts.tolist(), ends, strict=True):
            parts[n].append(hashes[a:b])
    return [_different(x[0] if len(x) == 1 else np.concatenate(x)) for x in parts]


def _different(x: np.ndarray) -> np.ndarray:
    """``np.unique`` with less to do for a short array."""
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.append(True, new)]


def signed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """``doc_id, line_no, id, bands`` of each line that isn't blank. ``id`` is the line's key; ``bands`` is null where the task has signed an equal line before."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                docs_at, places, keys, fresh, fresh_at = [], [], [], [], []
                for d, found in enumerate(part.column(1)):
                    for n, line in enumerate(normal_lines(found.as_py())):
                        if line:
                            key = line_key(line)
                            if key not in seen:
                                seen.add(key)
                                fresh.append(line)
                                fresh_at.append(len(keys))
                            docs_at.append(d)
                            places.append(n)
                            keys.append(key)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not keys:
                    continue
                low = signatures(fresh, size)
                at = np.full(len(keys), -1, np.int64)
                at[fresh_at] = np.arange(len(fresh))
                index = pa.array(at, mask=at < 0)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(minhash.band_keys(low).ravel()), minhash.BANDS).cast(pa.list_(pa.int64()))
                columns = [part.column(0).take(pa.array(docs_at)), pa.array(places, pa.int32()), pa.array(keys, pa.int64()), bands.take(index)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line_no", "id", "bands"])

    return source.mapInArrow(run, f"doc_id {kind}, line_no int, id long, bands array<long>")


def lines_of(docs: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """``id, data``: the normalised lines whose keys are among the different ``keys.id``, once each. A bitmap of bounded size keeps most others from the shuffle."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(keys, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                lines = [x for t in batch.slice(i, SLICE).column(0) for x in normal_lines(t.as_py()) if x]
                keys = np.fromiter(map(line_key, lines), np.int64, len(lines))
                maybe = np.flatnonzero(in_bitmap(bitmap.value, keys))
                chosen = [n for n, k in zip(maybe.tolist(), keys[maybe].tolist(), strict=True) if k not in seen and not seen.add(k)]
                if len(seen) > REMEMBERED:
                    seen.clear()
                if chosen:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[chosen]), pa.array([lines[n] for n in chosen], pa.string())], names=["id", "line"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "id long, line string")
    return materialise(found.join(keys, "id", "left_semi").groupBy("id").agg(F.first("line").alias("data")), "lines")


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row per line that isn't blank: ``doc_id, line_no, class_doc_id, class_line_no, class_size, kept``.

    A class holds equal lines (by a 64-bit hash of their form in lower case with single spaces) and those linked by similar pairs;
    its first line by document id (nulls first) and place names it and is kept. Blank lines belong to no class. Rows repeated with the
    same id share their lines' places, and both rows of the first stay. Very long lines are read whole. Other columns, whatever their
    names, are ignored. Empty tables give an empty result.
    """
    signed = materialise(signed_lines(docs, text, doc_id, size), "signed")
    roots = minhash.linked(signed.select("id", "bands"), lambda ids: lines_of(docs, ids, text), partial(shingle_sets, size=size), least)
    rows = may_be_in(signed.select("doc_id", "line_no", F.col("id").alias("root")), "root", roots, "node", "linked")
    joined = rows.where("linked").join(roots.select(F.col("node").alias("root"), F.col("root").alias("newer")), "root", "left")
    joined = joined.select("doc_id", "line_no", F.coalesce("newer", "root").alias("root"))
    rows = materialise(rows.where("NOT linked").select("doc_id", "line_no", "root").union(joined), "rooted")
    discard(signed)
    heads = rows.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("head"), F.count("*").alias("class_size"))
    heads = materialise(heads.where("class_size > 1"), "classes")
    rows = may_be_in(rows, "root", heads, "root", "several")
    alone = rows.where("NOT several").select("doc_id", "line_no", F.struct("doc_id", "line_no").alias("head"), F.lit(1).cast("long").alias("class_size"))
    several = rows.where("several").join(heads, "root", "left").select("doc_id", "line_no", F.coalesce("head", F.struct("doc_id", "line_no")).alias("head"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no"))
    return alone.union(several).select("doc_id", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), "class_size", kept.alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with only the kept and the blank lines of each text; the other columns stay as they are, whatever their names. Ids should be unique."""
    own, nos = split_of(docs, "own", "nos")
    gone = classify(docs, text, doc_id, **options).where("not kept").groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(nos))
    joined = docs.join(gone, docs[doc_id].eqNullSafe(gone[own]), "left")
    rest = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.coalesce(F.array_contains(nos, i), F.lit(False)))
    return joined.select(*(F.array_join(rest, "\n").alias(c) if c == text else F.col(c) for c in docs.columns))
