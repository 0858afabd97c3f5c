"""Packing of tokenised documents into fixed-length sequences by best-fit decreasing.

Each task tokenises its own part of the input and packs it block by block, so no token is shuffled. Documents of more than one
window are first cut into full windows; the remainders are placed in decreasing order, each into the open window with the least
room that still holds it, found in a segment tree indexed by remaining capacity. Windows left with more than ``slack`` room are
taken up again with the next block; at the end of a task they are cut anew into full windows, and the last of them into powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS, CACHED_BYTES = 500_000, 64
#: ASCII punctuation but the apostrophe, which starts tokens such as "'s".
PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Longest stretch of tokens of a window that is carried over, as a share of a block.
CARRIED = 0.25


class Words(dict):
    """Token ids (little-endian unsigned 32-bit) of words, from a tokenizer that lower-cases and never joins tokens across white space
    or between a letter and punctuation after it. So words are looked up in lower case without their closing punctuation."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if core and len(core) < len(word) and core.decode("utf-8", "replace").lower()[-1].isalpha():
            out = self[core] + self[word[len(core) :]]
        else:
            out = self.encode(word)
        self._keep(word, out)
        return out

    def _keep(self, word: bytes, out: bytes) -> None:
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out

    def learn(self, words: list[bytes]) -> None:
        """Looks up new words of letters alone together: each is one piece, whose last token is one that ends a word."""
        new = {c for w in set(words) if (c := w.rstrip(PUNCTUATION)) and c not in self and len(c) <= CACHED_BYTES}
        plain = [w for w in new if w.decode("utf-8", "replace").lower().isalpha()]
        if not plain:
            return
        ids = np.frombuffer(self.encode(b" ".join(plain)), dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(plain):
            at = 0
            for word, stop in zip(plain, (4 * stops).tolist(), strict=True):
                self._keep(word, ids.data.cast("B")[at:stop].tobytes())
                at = stop

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text:  # may start a special token, which is told by its case
            return self.encode(text)
        words = text.lower().split()
        parts = list(map(self.get, words))
        if None in parts:
            missing = [i for i, x in enumerate(parts) if x is None]
            self.learn([words[i] for i in missing])
            for i in missing:
                parts[i] = self[words[i]]
        return b"".join(parts)


_SHARED: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One cache for each worker process and tokenizer, which outlives a task."""
    if path not in _SHARED:
        _SHARED[path] = Words(path)
    return _SHARED[path]


class RoomTree:
    """A segment tree over remaining capacities 0..size; each leaf counts the open windows with that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least ``need`` that an open window has, or -1."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of positions in ``lengths``, none of which exceeds ``size``; ties go by position."""
    tree, windows = RoomTree(size), []
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.tightest(need)
        if room < 0:
            windows.append([i])
            at, room = len(windows) - 1, size
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
            windows[at].append(i)
        if room > need:
            tree.add(room - need, 1)
            by_room.setdefault(room - need, []).append(at)
    return windows


Piece = tuple  # doc_id, start, ids, doc_tokens


def _recut(pieces: list[Piece], sizes: Iterator[int]) -> Iterator[list[Piece]]:
    """Sequences of exactly the given sizes, cut from the pieces in order."""
    rest = list(reversed(pieces))
    for size in sizes:
        out = []
        while size:
            doc, start, ids, total = rest.pop()
            if len(ids) > 4 * size:
                rest.append((doc, start + size, ids[4 * size :], total))
                ids = ids[: 4 * size]
            out.append((doc, start, ids, total))
            size -= len(ids) // 4
        yield out


def _sizes(total: int, size: int) -> Iterator[int]:
    for _ in range(total // size):
        yield size
    for power in range(total.bit_length(), -1, -1):
        if (total % size) >> power & 1:
            yield 1 << power


def pack_stream(docs: Iterator[tuple[object, bytes]], encode, size: int, end: bytes, block: int, slack: int) -> Iterator[list[Piece]]:
    """Sequences of pieces of one task's documents; holds about ``block`` tokens at a time, besides one document."""
    held: list[Piece] = []
    tokens = 0

    def place(last: bool) -> Iterator[list[Piece]]:
        nonlocal held, tokens
        windows = [[held[i] for i in w] for w in best_fit_decreasing([len(p[2]) // 4 for p in held], size)]
        fill = [sum(len(p[2]) for p in w) // 4 for w in windows]
        open_ = sorted((n for n in range(len(windows)) if size - fill[n] > slack), key=lambda n: fill[n])
        left = set(open_)
        yield from (w for n, w in enumerate(windows) if n not in left)
        held, tokens = [], 0
        for n in open_:
            held += windows[n]
            tokens += fill[n]
        if last or tokens > CARRIED * block:
            total = tokens if last else tokens - tokens % size
            done = list(_recut(held, _sizes(total, size)))
            yield from done
            used = total
            while held and used:
                doc, start, ids, n = held[0]
                if len(ids) <= 4 * used:
                    used -= len(ids) // 4
                    held.pop(0)
                else:
                    held[0] = (doc, start + used, ids[4 * used :], n)
                    used = 0
            tokens -= total

    for doc, text in docs:
        ids = encode(text) + end
        total, at = len(ids) // 4, 0
        while total - at >= size:
            yield [(doc, at, ids[4 * at : 4 * (at + size)], total)]
            at += size
        if total > at:
            held.append((doc, at, ids[4 * at :], total))
            tokens += total - at
        if tokens >= block:
            yield from place(False)
    if held:
        yield from place(True)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, size: int = 4096, end_id: int = 2, block: int = 1 << 21, slack: int = 32) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit; each id of a document, ``end_id`` last, lies in exactly one piece, and the pieces
    of a sequence follow each other from offset 0 without gaps. ``tokenizer``: a tokenizers JSON file whose tokens never span
    white space, ``public_tokenizers.path("word_bpe_49k.json")`` by default. A null or empty text has just the end id; repeated
    rows and null ids are packed like any other; other columns are ignored; an empty table gives an empty one.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("data"))
    kind = source.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words = words_of(path)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        sequence = TaskContext.get().partitionId() << 36
        types: list = [None]

        def texts() -> Iterator[tuple[object, bytes]]:
            for batch in batches:
                types[0] = batch.schema.field(0).type
                for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, data.as_py() or b""

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            kinds = [types[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        rows: list[tuple] = []
        held = 0
        for pieces in pack_stream(texts(), words.ids, size, end, block, slack):
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1
            held += offset
            if held >= 1 << 18:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return source.mapInArrow(run, schema)
