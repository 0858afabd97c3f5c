"""MinHash signatures, bands and links, shared by the near-duplicate operators on lines and on documents.

A signature holds the minima of a set's shingle hashes under ``BANDS * ROWS`` permutations. Two sets agree on a minimum with a
probability that is their Jaccard similarity, so they share one of the bands of ``ROWS`` minima with probability
``1 - (1 - s ** ROWS) ** BANDS``: 0.996 at a similarity of 0.8. The rows of a band meet its first row. Those that are in different groups
afterwards (a crowd) are joined by prefix filtering: members of sets are ordered by how many sets of the crowd have them, the rarest first, and two
sets of the wanted similarity share one of their first few. Members of one set alone are not even shuffled, so lines that differ in their numbers
meet hardly any other, though they share bands with all. Pairs are held against sizes, places and sketches, whose bound is exact for all but
large sets, and verified exactly. At first each set links only to the nearest it meets, round by round, so a dense group joins up
without all its pairs; what is still apart then meets in full. What many sets share although it is among the rarest of each is dealt out by pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import components, discard, materialise
from clademill.llm.exact_dedup import may_be_in

BANDS, ROWS = 14, 5
#: Rows of a token are compared in blocks of so many; more are dealt out by pairs of blocks.
BLOCK = 512
#: Hashes are counted in so many cells (bits), whose counts order them; and so many sets are made at a time.
CELL_BITS, SLICE = 20, 200
#: Bytes of a crowd's sketches.
SKETCH = 128
_RANDOM = np.random.default_rng(20)
_FLIPS = _RANDOM.integers(0, 1 << 32, 256, dtype=np.uint32)
_FACTORS = _RANDOM.integers(0, 1 << 31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WIDE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes whose bits all depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minima(hashes: np.ndarray, starts: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """``len(starts) x count`` minima of the runs of ``hashes`` (mixed, 64 bits) that begin at ``starts``; no run is empty."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((count, len(starts)), np.uint32)
    for j in range(count):
        np.minimum.reduceat((short ^ _FLIPS[j]) * _FACTORS[j], starts, out=out[j])
    return out.T


def band_keys(low: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``n x bands`` signed keys of the bands of ``n x (bands * rows)`` minima."""
    parts = low.reshape(len(low), bands, rows).astype(np.uint64)
    return mixed((parts * _WIDE[:rows]).sum(axis=2, dtype=np.uint64) + _WIDE[100 : 100 + bands]).view(np.int64)


def sketches(low: np.ndarray) -> list[bytes]:
    """The low byte of each minimum."""
    return [x.tobytes() for x in low.astype(np.uint8)]


def least_agreeing(count: int, similarity: float) -> int:
    """Agreeing minima that a pair of that similarity has but for a chance of about 0.00003 (four deviations below the mean)."""
    return int(count * similarity - 4 * (count * similarity * (1 - similarity)) ** 0.5)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sets in order."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    n = shared(a, b)
    return n >= least * (len(a) + len(b) - n)


def crowd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """``SKETCH`` bytes a set. One of at most ``8 * SKETCH`` members has the parities of how many of them are in each cell: two sets differ in at
    least as many members as parities, as common ones cancel out. A larger one has the low bytes of minima."""
    cells, sizes = 8 * SKETCH, np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), SKETCH), np.uint8)
    small, large = np.flatnonzero(sizes <= cells), np.flatnonzero(sizes > cells)
    if len(small):
        cell = (np.concatenate([sets[n] for n in small]) & np.uint64(cells - 1)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(len(small)) * cells, sizes[small]) + cell, minlength=len(small) * cells) & 1
        out[small] = np.packbits(odd.astype(np.uint8).reshape(-1, cells), axis=1)
    if len(large):
        out[large] = minima(mixed(np.concatenate([sets[n] for n in large])), np.cumsum(sizes[large]) - sizes[large], SKETCH).astype(np.uint8)
    return out


def distances(marks: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How far apart the sets ``x`` and ``y`` seem by their sketches, from 0 to 1, and whether these allow the similarity. A small set and a large one are not told apart."""
    large = size > 8 * SKETCH
    both, one = large[x] & large[y], large[x] ^ large[y]
    odd = np.bitwise_count(marks.view(np.uint64)[x] ^ marks.view(np.uint64)[y]).sum(axis=1, dtype=np.int64)
    far, allowed = odd / (size[x] + size[y]), odd <= (1 - least) / (1 + least) * (size[x] + size[y]) + 1e-6
    equal = (marks[x[both]] == marks[y[both]]).sum(axis=1)
    far[both], allowed[both] = 1 - equal / SKETCH, equal >= least_agreeing(SKETCH, least)
    far[one], allowed[one] = 0.5, True
    return far, allowed


Sets = Callable[[list], list[np.ndarray]]


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _counted(sets: Sets):
    """``cell, n``: how many of the sets of ``data`` have a hash in each cell, added up by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for found in sets(batch.column(0).slice(at, SLICE).to_pylist()):
                    np.add.at(total, _cells(found), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["cell", "n"])

    return run


def cell_counts(data: DataFrame, sets: Sets) -> np.ndarray:
    """How often hashes fall in each of a fixed number of cells (four megabytes)."""
    found = data.select("data").mapInArrow(_counted(sets), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # Arrow batches; rows would cost the driver's Python a few hundred megabytes
    out = np.zeros(1 << CELL_BITS, np.uint32)
    out[found.column("cell").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.uint32).max)
    return out


def prefix(hashes: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a set's prefix and their places in it: its rarest members, as many as two sets of that similarity can't all differ in.
    Members that only this set has, as their cell tells, take a place but are left out."""
    rare = counts[_cells(hashes)]
    order = np.lexsort((hashes, rare))[: len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1]
    places = np.flatnonzero(rare[order] > 1)
    return hashes[order[places]], places


def _prefixes(sets: Sets, least: float, counts):
    """``token, id, root, size, place``: a row for each member of the prefixes of the sets of ``id, root, data``; and one a set that has such, with its ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = sets(part.column(2).to_pylist())
                heads = [prefix(x, counts.value, least) for x in found]
                some = [n for n, (x, _) in enumerate(heads) if len(x)]
                if not some:
                    continue
                sizes = pa.array([len(x) for x in found], pa.int32())
                row = pa.array(np.concatenate([some, np.repeat(np.arange(len(found)), [len(x) for x, _ in heads])]))
                marks = [x.tobytes() for x in crowd_sketches([found[n] for n in some])] + [None] * (len(row) - len(some))
                tokens, places = (np.concatenate([np.zeros(len(some), kind), *(x[k].view(kind) for x in heads)]) for k, kind in ((0, np.int64), (1, np.int64)))
                columns = [pa.array(tokens), *(part.column(k).take(row) for k in (0, 1)), sizes.take(row), pa.array(places, pa.int64()).cast(pa.int32()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "id", "root", "size", "place", "sketch"])

    return run


def _met(least: float, nearest: bool):
    """Pairs ``a < b`` of different roots, within a block or between two blocks of a token's rows, whose sizes, places and sketches allow the similarity;
    with ``nearest`` one for each row at most, with the nearest of those behind it. Rows come sorted by ``token, i, j``."""

    def pairs(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, ids, roots, size, place, i, j = (table.column(c).to_numpy() for c in ("own", "id", "root", "size", "place", "i", "j"))
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        partners = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1  # the rows behind each in its group
        ends = np.cumsum(partners)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), "right")))
            n = partners[at:to]
            x = np.repeat(np.arange(at, to), n)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            at = to
            apart = (roots[x] != roots[y]) & (ids[x] != ids[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
            x, y = x[apart], y[apart]
            need = least / (1 + least) * (size[x] + size[y]) - 1e-6
            apart = np.minimum(size[x] - place[x], size[y] - place[y]) >= need
            x, y = x[apart], y[apart]
            far, apart = distances(marks, size, x, y, least)
            x, y, far = x[apart], y[apart], far[apart]
            if nearest and len(x):
                order = np.lexsort((far, x))
                order = order[np.append(True, np.diff(x[order]) != 0)]
                x, y = x[order], y[order]
            x, y = ids[x], ids[y]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            held += [batch] if batch is not None else []
            table = pa.Table.from_batches(held) if held else None
            if table is None or not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in ("token", "i", "j")]
            group = np.concatenate([[0], np.cumsum(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))])
            stop = table.num_rows if batch is None else int(np.searchsorted(group, group[-1]))  # the last group may go on
            if stop:
                yield from pairs(table.slice(0, stop), group[:stop])
            held = table.slice(stop).to_batches()

    return run


def prefixes(crowd: DataFrame, sets: Sets, least: float) -> DataFrame:
    """The prefixes and sketches (see ``_prefixes``) of the written ``id, root, data``. A written table."""
    counts = crowd.sparkSession.sparkContext.broadcast(cell_counts(crowd, sets))
    return materialise(crowd.select("id", "root", "data").mapInArrow(_prefixes(sets, least, counts), "token long, id long, root long, size int, place int, sketch binary"), "prefixes")


def met_pairs(found: DataFrame, least: float, nearest: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """Candidate pairs ``a, b`` of different roots among ``found`` (see ``prefixes``): those that share a member of both prefixes, no pair of that similarity
    missed but by large sets' sketches and their chance (``least_agreeing``). With ``nearest`` a row of a token has one pair at most, with the nearest it meets in its
    own block. ``roots`` (``id, root``) are newer ones. A written table."""
    rows = found.where("sketch IS NULL").drop("sketch")
    if roots is not None:
        rows = materialise(rows.drop("root").join(roots, "id"), "rooted")
    tokens = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    tokens = materialise(tokens.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")), "tokens")
    own = F.pmod(F.xxhash64("id"), F.col("g")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    dealt = rows.join(tokens, "token").withColumn("own", own).join(found.where("sketch IS NOT NULL").select("id", "sketch"), "id")
    dealt = dealt.withColumn("cell", F.struct(F.col("own").alias("i"), F.col("own").alias("j")) if nearest else F.explode(cells))
    dealt = dealt.select("token", "cell.i", "cell.j", "own", "id", "root", "size", "place", "sketch").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    out = materialise(dealt.mapInArrow(_met(least, nearest), "a long, b long").distinct(), "candidates")
    for done in (tokens, *([rows] if roots is not None else [])):
        discard(done)
    return out


def crowd_pairs(crowd: DataFrame, sets: Sets, least: float) -> DataFrame:
    """All candidate pairs (see ``met_pairs``) among the written ``id, root, data``."""
    found = prefixes(crowd, sets, least)
    out = met_pairs(found, least)
    discard(found)
    return out


def crowd_links(crowd: DataFrame, data: DataFrame, sets: Sets, least: float) -> DataFrame:
    """Links ``a, b`` that join all groups of the written ``id, root, data`` of a crowd which links join. Each row is tried with the nearest it meets for as long as
    that more than halves the groups; then all pairs of groups still apart."""
    found, now, rooted, links = prefixes(crowd, sets, least), crowd.select("id", "root"), None, []
    left = now.select("root").distinct().count()
    while True:
        more = met_pairs(found, least, True, rooted)
        links.append(verified(more, data, sets, least))
        discard(more)
        ends = links[-1].join(now.select(F.col("id").alias("a"), F.col("root").alias("x")), "a").join(now.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
        newer = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("newer"))
        now = rooted = materialise(now.join(newer, "root", "left").select("id", F.coalesce("newer", "root").alias("root")), "roots")
        before, left = left, now.select("root").distinct().count()
        if 2 * left >= before:
            break
    more = met_pairs(found, least, False, rooted)
    links.append(verified(more, data, sets, least))
    for done in (more, found):
        discard(done)
    return reduce(DataFrame.union, links)


def _verified(sets: Sets, least: float):
    """The pairs ``a, b`` of batches ``a, b, left, right`` whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                left, right = (part.column(i).dictionary_encode() for i in (2, 3))
                first, second = (sets(x.dictionary.to_pylist()) for x in (left, right))
                keep = [similar(first[i], second[j], least) for i, j in zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, sets: Sets, least: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose ``data`` in ``texts`` (``id, data``) have sets with a Jaccard similarity of at least ``least``. A written table."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("data").alias("right")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("data").alias("left")), "a").select("a", "b", "left", "right")
    return materialise(both.mapInArrow(_verified(sets, least), "a long, b long"), "verified")


def meetings(signed: DataFrame) -> DataFrame:
    """``band, id, low``: each id of a band but the first, with the first (``low``). Bands of one id are left out. A written table."""
    dealt = signed.where("bands IS NOT NULL").select("id", F.explode("bands").alias("band"))
    ends = dealt.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    ends = materialise(ends.select("band", "low"), "ends")  # written, so that the join deals both sides out and Spark can split a hot band
    met = materialise(may_be_in(dealt, "band", ends, "band").join(ends, "band").where("id <> low").select("band", "id", "low").distinct(), "meetings")
    discard(ends)
    return met


def linked(signed: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Sets, least: float = 0.8, extra: DataFrame | None = None) -> DataFrame:
    """``node, root`` of the groups that links join, as ``common.components`` gives them.

    ``signed``: a written table ``id long, bands array<long>``; an id may come more than once, and its bands are null but in one row at
    least. ``texts`` gets a table of ids and returns ``id, data`` of these. ``sets`` turns data into sorted hashes of
    their shingles. ``extra``: further candidate pairs ``a, b``.
    """
    met = meetings(signed)
    pairs = met.select(F.col("low").alias("a"), F.col("id").alias("b"))
    if extra is not None:
        pairs = pairs.union(extra.select("a", "b"))
    pairs = materialise(pairs.distinct(), "pairs")
    data = texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sure = verified(pairs, data, sets, least)
    roots = components(sure)
    others = met.select("band", "id").join(roots, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    crowds = materialise(others.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band"), "crowds")
    some = materialise(others.join(crowds, "band", "left_semi").select("id", "root").distinct(), "some")
    crowd = materialise(some.join(data, "id").select("id", "root", "data"), "crowd")
    out = components(sure.union(crowd_links(crowd, data, sets, least)))
    for done in (pairs, crowds, some, crowd, met):
        discard(done)
    return out
