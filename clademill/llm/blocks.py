"""Counts of keys for each row, in blocks that have a vocabulary of their own.

A task goes through its rows and closes a block after ``ENTRIES`` counts. A table of blocks has a line for each row, with its counts by place in
the block's vocabulary, and one for each key of the vocabulary, with a total over the block. So sums over all rows are taken from
vocabulary lines, combined per task before they shuffle, and what is known of a key goes back to each block once, not to each row that
holds it; a key of every row has no more lines than there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is closed at so many counts; a row with more has a block to itself.
ENTRIES = 1 << 21


def pack(at: np.ndarray, times: np.ndarray) -> bytes:
    """Places and counts as bytes: unsigned 32-bit numbers, byte by byte in planes, which compress well."""
    both = np.concatenate([at, times]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


class Builder:
    """Lines of one task's blocks. ``columns`` are the names and types of a row's own columns, ``key`` the type of a key."""

    def __init__(self, task: int, columns: list[tuple[str, pa.DataType]], key: pa.DataType):
        self.block, self.columns, self.key = task << 32, columns, key
        self.rows: list[tuple] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, row: tuple, at: np.ndarray, times: np.ndarray) -> None:
        self.rows.append(row)
        self.counts.append((at, times))
        self.held += len(at)

    def full(self) -> bool:
        return self.held >= ENTRIES or len(self.rows) >= ENTRIES

    def close(self, keys: pa.Array, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The block's lines; ``keys`` and ``totals`` are by place. Frequent keys come first, so that places pack well."""
        n, rank = len(totals), np.empty(len(totals), np.int64)
        first = np.argsort(-totals, kind="stable")
        rank[first] = np.arange(n)
        names = ["block", *(name for name, _ in self.columns), "entries", "place", "key", "total"]
        kinds = [pa.int64(), *(kind for _, kind in self.columns), pa.binary(), pa.int32(), self.key, pa.int64()]
        own = [pa.array(c, kind) for c, (_, kind) in zip(zip(*self.rows, strict=True), self.columns, strict=True)]
        rows = len(self.rows)
        entries = pa.array([pack(rank[at], times) for at, times in self.counts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, self.block)), *own, entries, *(pa.nulls(rows, k) for k in kinds[-3:])], names=names)
        if n:
            blank = [pa.nulls(n, k) for k in kinds[1:-3]]
            words = [pa.array(np.arange(n), pa.int32()), keys.take(pa.array(first)), pa.array(totals[first], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.block)), *blank, *words], names=names)
        self.block, self.rows, self.counts, self.held = self.block + 1, [], [], 0


def schema(columns: str, key: str) -> str:
    return f"block long, {columns}, entries binary, place int, key {key}, total long"


def totals(table: DataFrame) -> DataFrame:
    """``key, total`` over all blocks."""
    return table.where("key IS NOT NULL").groupBy("key").agg(F.sum("total").alias("total"))


def weighted_sums(table: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each row, and for each long column of ``values`` besides its ``key`` the sum of that value over the row's counts.

    Every key has to be in ``values`` once. One block is a group's whole size, whatever key is frequent."""
    kept, names = table.where("key IS NULL").select("block", *columns, "entries"), [c for c in values.columns if c != "key"]
    known = table.where("key IS NOT NULL").select("block", "place", "key").join(values, "key").select(F.col("block").alias("of"), "place", *names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in columns)

    def fold(rows: pa.Table, words: pa.Table) -> pa.Table:
        entries = [unpack(x) for x in rows["entries"].to_pylist()]
        ends = np.cumsum([len(at) for at, _ in entries], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        at = np.concatenate([x for x, _ in entries])
        times = np.concatenate([x for _, x in entries])
        out = rows.select(columns)
        for name in names:
            value = np.zeros(words.num_rows, np.int64)
            value[words["place"].to_numpy()] = words[name].to_numpy()
            running = np.concatenate([[0], np.cumsum(times * value[at])])
            out = out.append_column(name, pa.array(running[ends] - running[starts]))
        return out

    return kept.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(fold, f"{kinds}, " + ", ".join(f"`{n}` long" for n in names))
