"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints within ``k`` bits agree on some ``agree`` of ``k + agree`` blocks of bits, so they are dealt out once for each choice
of blocks, and those that agree on a choice meet. There they are sorted by Gray rank, which puts similar codes side by side, and
indexed: a node stands for a run of neighbours and keeps the bits they all share, less those its parent has factored out. A search
adds up differences from the root down and drops a whole group once they exceed ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm import minhash
from clademill.llm.common import components, materialise, split_of
from clademill.llm.exact_dedup import may_be_in

FAN_OUT = 8
BLOCK_ROWS = 1 << 20
FRONTIER = 1 << 20


def shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the ``size``-word shingles of UTF-8 text, in pieces of bounded length; A-Z count as a-z."""
    words = data.lower().split()
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
        return
    step = 1 << 15
    for at in range(0, len(words) - size + 1, step):
        part = words[at : at + step + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        stops = ends[size - 1 :].tolist()
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64)


def fingerprint(data: bytes, size: int) -> int:
    """A bit is 1 if set in over half the shingle hashes, repeats included; text without words gives 0."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(data, size):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 3) -> DataFrame:
    """``keep`` columns and ``print``, the fingerprint as a signed 64-bit integer. A null text counts as empty."""
    (data,) = split_of(docs, "data")
    source = docs.select(*keep, F.col(text).cast("binary").alias(data))
    schema = source.select(*keep, F.lit(0).cast("long").alias("print")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py() or b"", size) for x in batch.column(len(keep))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints.view(np.int64))], names=[*keep, "print"])

    return source.mapInArrow(run, schema)


def word_prints(data: bytes, lanes: int) -> list[int]:
    """``lanes`` independent fingerprints of a text's set of words. Few edits change few words, so near copies differ in few bits."""
    words = set(data.lower().split())
    ones, total = np.zeros((lanes, 64), dtype=np.int64), len(words)
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)
    for lane in range(lanes if total else 0):
        for at in range(0, total, 1 << 15):
            bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[lane] += bits.sum(axis=0, dtype=np.int64)
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(31)
    packed = np.packbits(2 * ones > total, axis=1)
    return [int.from_bytes(row.tobytes(), "big") if total else 0 for row in packed]


def _lanes(lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([word_prints(x.as_py() or b"", lanes) for x in batch.column(1)], dtype=np.uint64).reshape(-1, lanes)
            rids = np.repeat(batch.column(0).to_numpy(), lanes)
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(np.tile(np.arange(lanes, dtype=np.int32), batch.num_rows)), pa.array(prints.ravel().view(np.int64))], names=["rid", "lane", "print"])

    return run


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """The different hashes of a text's ``size``-word shingles in order; text without words has one of its own."""
    pieces = list(shingle_hashes(data, size)) or [np.zeros(1, np.uint64)]
    return np.unique(np.concatenate(pieces))


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 100) for x in batches for i in range(0, x.num_rows, 100)):
            sets = [shingle_set(data.as_py(), size) for data in batch.column(1)]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            low = minhash.minima(minhash.mixed(np.concatenate(sets)), np.cumsum(sizes) - sizes)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(minhash.band_keys(low).ravel()), minhash.BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), bands], names=["id", "bands"])

    return run


def gray_rank(code: Column) -> Column:
    """The position of ``code`` in the reflected Gray sequence (an exclusive-or over all higher bits)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def masks(k: int, agree: int) -> list[int]:
    """Masks of all choices of ``agree`` among ``k + agree`` blocks; codes within ``k`` bits are equal under at least one."""
    n = k + agree
    edges = [round(i * 64 / n) for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, agree)]


class GrayIndex:
    """The hierarchical index of many groups at once; codes are sorted by group, then Gray rank. Searches stay within a group."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        """``first``: where each group starts in ``codes``."""
        self.codes = codes
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        bounds = np.append(first, len(codes))
        one, zero = codes, ~codes  # bits that are one, or zero, in all below
        levels = []
        while True:
            sizes = np.diff(bounds)
            per = -(-sizes // FAN_OUT)
            at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            starts = np.repeat(bounds[:-1], per) + at * FAN_OUT
            one, zero = np.bitwise_and.reduceat(one, starts), np.bitwise_and.reduceat(zero, starts)
            levels.append([starts, np.append(starts[1:], bounds[-1]), one, one | zero])
            bounds = np.append(0, np.cumsum(per))
            if (per <= 1).all():
                break
        self.levels = levels[::-1]
        for upper, lower in zip(self.levels, self.levels[1:], strict=False):
            lower.append(lower[3] & ~np.repeat(upper[3], upper[1] - upper[0]))
        self.levels[0].append(self.levels[0][3])
        self.rest = full & ~np.repeat(self.levels[-1][3], self.levels[-1][1] - self.levels[-1][0])

    def pairs(self, group: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions ``i > j`` of codes of one group that differ in at most ``k`` bits; ``group``: the group of each code."""
        n = len(self.codes)
        for at in range(0, n, FRONTIER // 8):
            query = np.arange(at, min(n, at + FRONTIER // 8))
            node = group[query]
            stack = [(0, query, node, np.zeros(len(query), np.uint8))]
            while stack:
                level, query, node, sums = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(level, query[:half], node[:half], sums[:half]), (level, query[half:], node[half:], sums[half:])]
                    continue
                if level == len(self.levels):
                    sums = sums + np.bitwise_count((self.codes[query] ^ self.codes[node]) & self.rest[node])
                    hit = (sums <= k) & (node < query)
                    if hit.any():
                        yield query[hit], node[hit]
                    continue
                starts, ends, value, _, own = self.levels[level]
                sums = sums + np.bitwise_count((self.codes[query] ^ value[node]) & own[node])
                live = sums <= k
                query, node, sums = query[live], node[live], sums[live]
                count = ends[node] - starts[node]
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                stack.append((level + 1, np.repeat(query, count), np.repeat(starts[node], count) + offset, np.repeat(sums, count)))


def _forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked position to the first of its local component: as many as positions, whatever the number of links."""
    label = np.arange(n)
    for i, j in found:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _nearest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each position, its links to the first and to the last of its earlier partners."""
    low, high = np.full(n, n), np.full(n, -1)
    for i, j in found:
        np.minimum.at(low, i, j)
        np.maximum.at(high, i, j)
    some = np.flatnonzero(high >= 0)
    more = some[high[some] != low[some]]
    return np.concatenate([some, more]), np.concatenate([low[some], high[more]])


def _meet(k: int, choose):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def search(part: np.ndarray, key: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            group = np.cumsum(new) - 1
            alone = np.bincount(group)[group] == 1
            part, key, code = part[~alone], key[~alone], code[~alone]
            if not len(code):
                return
            new = np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            index = GrayIndex(code.view(np.uint64), np.flatnonzero(new))
            i, j = choose(len(code), index.pairs(np.cumsum(new) - 1, k))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(part[i]), pa.array(code[i]), pa.array(code[j])], names=["part", "a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                part, key, code = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.flatnonzero((part != part[-1]) | (key != key[-1]))
                cut = last[-1] + 1 if len(last) else 0
                held, rows = [(part[cut:], key[cut:], code[cut:])], len(part) - cut
                if cut:
                    yield from search(part[:cut], key[:cut], code[:cut])
        if rows:
            yield from search(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _signed_mask(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def _finer(mask: int, pieces: int) -> list[int]:
    """``mask`` with one of ``pieces`` runs of its clear bits added."""
    clear = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(i * len(clear) / pieces) for i in range(pieces + 1)]
    return [mask | sum(1 << i for i in clear[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def linked_prints(prints: DataFrame, k: int = 2, agree: int = 1, whole: bool = True, most: int = BLOCK_ROWS // 2) -> DataFrame:
    """Edges ``lane, a, b`` among the distinct values of ``print`` of each ``lane`` that differ in at most ``k`` bits.

    ``whole``: a spanning forest of all links that meet under each mask, so that components are exact. Otherwise links of each
    value under each mask to the first and the last in Gray order of its earlier partners, as candidates that are still to be verified.
    A group of more than ``most`` values that agree under a mask is dealt out again by ``k + 1`` runs of the other bits, on one of which
    any two within ``k`` bits agree; so no link is lost.
    """
    choices = masks(k, agree)
    finer = [_finer(m, k + 1) for m in choices]
    step = k + 2
    dealt = prints.select("lane", F.col("print").alias("code")).where("code is not null").distinct()
    parts = (F.struct(((F.col("lane") * len(choices) + i) * step).cast("int").alias("part"), F.col("code").bitwiseAND(_signed_mask(m)).alias("key"), "code") for i, m in enumerate(choices))
    dealt = dealt.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    large = materialise(dealt.groupBy("part", "key").count().where(F.col("count") > most).select("part", "key"), "large")
    if large.take(1):
        choice = (F.col("part") / step).cast("int") % len(choices)
        again = [F.array(*(F.struct((F.col("part") + 1 + j).cast("int").alias("part"), F.col("code").bitwiseAND(_signed_mask(m)).alias("key"), "code") for j, m in enumerate(ms))) for ms in finer]
        split = dealt.join(large, ["part", "key"], "left_semi").withColumn("at", choice)
        split = split.select(F.explode(F.element_at(F.array(*again), F.col("at") + 1)).alias("x")).select("x.*")
        dealt = dealt.join(large, ["part", "key"], "left_anti").unionByName(split)
    dealt = dealt.repartition("part", "key").sortWithinPartitions("part", "key", gray_rank(F.col("code")))
    found = dealt.mapInArrow(_meet(k, _forest if whole else _nearest), "part int, a long, b long")
    return found.select((F.col("part") / (len(choices) * step)).cast("int").alias("lane"), "a", "b")


def cluster(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, k: int = 2) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable by links.

    A null or empty text has the fingerprint zero and is linked like any other; very long texts are read whole; repeated rows and
    null ids are kept (a null id never names a component that has others). Other columns are ignored; an empty table gives none.
    """
    prints = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ("doc_id",), size), "prints")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = components(linked_prints(prints.withColumn("lane", F.lit(0)), k))
    linked = firsts.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "root").select("print", "component_id")
    out = prints.join(named, "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def near_deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, k: int = 6, agree: int = 2, least: float = 0.8, lanes: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group linked by pairs whose ``size``-word shingle sets have a Jaccard
    similarity of at least ``least``, the row with the smallest ``doc_id`` stays (nulls last; then the smallest hash of its text).

    Rows at most ``k`` bits apart in one of ``lanes`` fingerprints of their word sets are candidates, and so are rows that share a band of
    minima of shingles (see ``minhash``), which finds the copies whose fingerprints differ more. All are verified on whole texts. A null
    text counts as empty, and texts without words equal each other. Of wholly repeated rows one stays. All columns are returned as they
    are, whatever their names; an empty table gives an empty one.
    """
    (rid,) = split_of(docs, "rid")
    kept = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    texts = kept.select(F.col(rid).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    prints = materialise(texts.mapInArrow(_lanes(lanes), "rid long, lane int, print long"), "prints")
    firsts = prints.groupBy("lane", "print").agg(F.min("rid").alias("first"))
    edges = linked_prints(prints, k, agree, whole=False).distinct()
    across = edges.join(firsts.select("lane", F.col("print").alias("a"), F.col("first").alias("x")), ["lane", "a"])
    across = across.join(firsts.select("lane", F.col("print").alias("b"), F.col("first").alias("y")), ["lane", "b"]).select("x", "y")
    within = prints.join(firsts, ["lane", "print"]).where("rid <> first").select(F.col("first").alias("x"), F.col("rid").alias("y"))
    close = across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")
    signed = materialise(texts.mapInArrow(_signed(size), "id long, bands array<long>"), "signed")

    def some(ids: DataFrame) -> DataFrame:
        return materialise(may_be_in(texts, "id", ids, "id").join(ids, "id", "left_semi"), "texts")

    roots = materialise(minhash.linked(signed, some, lambda data: [shingle_set(x, size) for x in data], least, close), "roots")
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text), F.col(rid))
    ranked = kept.select(F.col(rid).alias("node"), order.alias("order")).join(members, "node")
    heads = ranked.groupBy("root").agg(F.min_by("node", "order").alias("node"))
    gone = members.join(heads.select("node"), "node", "left_anti")
    return kept.join(gone.select(F.col("node").alias(rid)), rid, "left_anti").select(*docs.columns)
