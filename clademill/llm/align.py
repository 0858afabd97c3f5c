"""Alignment of two tokenizers' tokens by an event sweep over where they end.

Each text is encoded by both. The end events of its A and B tokens are united in one table, a run of consecutive events a row (the byte offset at which the
run begins, and token ids, whose bytes tell the further ends). Rows are dealt out by document and sorted by offset within a partition,
and a machine goes through them that holds the events since the last offset at which both end: each such offset closes a group, and all A-B pairs
of a group are links. Links are counted by document in blocks (``blocks``), so a pair's number of documents is added up over all of
them and comes back to the documents' own links without a row for each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.llm import blocks
from clademill.llm.common import materialise

#: Events of a row, and of a sweep; they bound a task's state, besides its longest group.
RUN, SWEEP = 1 << 14, 1 << 18
#: Links that are laid out at a time.
LINKS = 1 << 22
SPACE = "▁"
_LONG_WORD = re.compile(r"\S{1000}")


class Both:
    """Ids (little-endian unsigned 16-bit) of both tokenizers, and the bytes of each."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a_bytes = _byte_level(self.a)
        self.quick = None
        if a_path == public_tokenizers.path("byte_bpe_50k.json"):  # the same vocabulary in a faster library
            ranks = {token: i for i, token in self.a_bytes.items() if token != b"<|endoftext|>"}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
        self.a_len, self.b_len = (_lengths(x) for x in (self.a_bytes, self.b_bytes))

    def ids(self, text: bytes) -> tuple[bytes, bytes] | None:
        """Ids of space and ``text`` under both; None where they don't give its bytes back or it isn't UTF-8."""
        try:
            told = " " + text.decode()
        except UnicodeDecodeError:
            return None
        quick = self.quick and not _LONG_WORD.search(told)  # whose time grows with the square of a word's length
        a = self.quick.encode_ordinary(told) if quick else self.a.encode(told, add_special_tokens=False).ids
        b, data = self.b.encode(told[1:]), b" " + text
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()


def _byte_level(tokenizer) -> dict[int, bytes]:
    """Bytes of each entry: printable bytes stand for themselves, the others, in order, for characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}
    return {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in tokenizer.get_vocab(with_added_tokens=True).items()}


def _lengths(table: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(table) + 1, np.int64)
    for i, token in table.items():
        out[i] = len(token)
    return out


_SHARED: dict[tuple[str, str], Both] = {}


def both_of(a_path: str | None, b_path: str | None) -> Both:
    """One for each worker process and pair of files, which outlives a task."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    if (a_path, b_path) not in _SHARED:
        _SHARED[a_path, b_path] = Both(a_path, b_path)
    return _SHARED[a_path, b_path]


def end_events(docs: DataFrame, text: str, doc_id: str, a_path: str | None, b_path: str | None) -> DataFrame:
    """``rid, doc_id, side, at, ids``: the A (side 0) and B (side 1) tokens of each row of ``docs`` in runs, ``at`` being the byte at which
    a run begins. A text without tokens has an empty run of each."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("data"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = both_of(a_path, b_path)
        rid = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int64(), pa.binary()]

            def flush(rows: list[tuple], kinds=kinds) -> pa.RecordBatch:
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, names=["rid", "doc_id", "side", "at", "ids"])

            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                found = (both.ids(data) if data else None) or (b"", b"")
                for side, (ids, lengths) in enumerate(zip(found, (both.a_len, both.b_len), strict=True)):
                    at = 0
                    for begin in range(0, max(1, len(ids)), 2 * RUN):
                        part = ids[begin : begin + 2 * RUN]
                        rows.append((rid, doc, side, at, part))
                        if len(ids) > 2 * RUN:
                            at += int(lengths[np.frombuffer(part, "<u2")].sum())
                    held += len(ids)
                rid += 1
                if held >= 1 << 21 or len(rows) >= 1 << 14:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)
                rows, held = [], 0

    return source.mapInArrow(run, f"rid long, doc_id {kind}, side int, at long, ids binary")


class Machine:
    """Goes through one partition's events in order. It holds events since the last offset at which both sides end, or up to ``SWEEP`` of them before
    it sweeps, and the totals of documents that aren't done."""

    #: What a token's id is told after: in a group, before the first B, before the first A of a group.
    SIGNS = (b",", b"|", b";")

    def __init__(self, a_len: np.ndarray, b_len: np.ndarray):
        self.lengths = (a_len, b_len)
        self.told = [sign + str(i).encode() for sign in self.SIGNS for i in range(1 << 16)]
        self.pending: tuple[list, list] = ([], [])  # (ids, ends) of each side, ends counted on over documents
        self.base = self.reach = self.held = 0
        self.docs: list[list] = []  # [name, last offset or None, n_a, n_b, n_groups, n_links, digest or None, pairs]

    def begin(self, name: object) -> None:
        self.end_doc()
        self.docs.append([name, None, 0, 0, 0, 0, None, []])

    def end_doc(self) -> None:
        if self.docs and self.docs[-1][1] is None:
            self.docs[-1][1] = self.base = self.reach

    def feed(self, side: int, at: int, ids: bytes) -> None:
        if ids:
            tokens = np.frombuffer(ids, "<u2").astype(np.int64)
            ends = self.base + at + np.cumsum(self.lengths[side][tokens])
            self.pending[side].append((tokens, ends))
            self.reach = max(self.reach, int(ends[-1]))
            self.held += len(tokens)

    def sweep(self) -> Iterator[tuple]:
        """Closes all groups that can be closed; gives back documents that are done: ``(name, n_a, n_b, n_groups, n_links, digest), pairs, times``."""
        (a, a_end), (b, b_end) = (
            (np.concatenate([x for x, _ in p]), np.concatenate([x for _, x in p])) if p else (np.zeros(0, np.int64),) * 2 for p in self.pending
        )
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        if len(cuts):
            na, nb = (int(np.searchsorted(x, cuts[-1], "right")) for x in (a_end, b_end))
            self.pending = ([(a[na:], a_end[na:])] if na < len(a) else [], [(b[nb:], b_end[nb:])] if nb < len(b) else [])
            self.held = len(a) - na + len(b) - nb
            self._groups(a[:na], a_end[:na], b[:nb], b_end[:nb], cuts)
        done = [d for d in self.docs if d[1] is not None]
        self.docs = self.docs[len(done) :]
        for name, _, n_a, n_b, n_groups, n_links, digest, pairs in done:
            keys, times = _added(pairs)
            yield (name, n_a, n_b, n_groups, n_links, digest.hexdigest() if digest else ""), keys, times

    def _groups(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, cuts: np.ndarray) -> None:
        ga, gb = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        in_a, in_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        first_a, first_b = upto_a - in_a, upto_b - in_b
        # tokens in the order in which they are told: a group's A tokens, then its B tokens
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b[ga]] = a
        codes[np.arange(len(b)) + upto_a[gb]] = b
        codes[first_a + first_b] += 2 << 16
        codes[upto_a + first_b] += 1 << 16
        last = [len(cuts) if d[1] is None else int(np.searchsorted(cuts, d[1], "right")) for d in self.docs]
        begin = 0
        for d, end in zip(self.docs, last, strict=True):
            if end == begin:
                continue
            tokens = slice(int(first_a[begin] + first_b[begin]), int(upto_a[end - 1] + upto_b[end - 1]))
            text = b"".join(map(self.told.__getitem__, codes[tokens].tolist()))
            if d[6] is None:
                d[6], text = hashlib.sha256(), text[1:]
            d[6].update(text)
            d[2] += int(in_a[begin:end].sum())
            d[3] += int(in_b[begin:end].sum())
            d[4] += end - begin
            d[5] += int((in_a[begin:end] * in_b[begin:end]).sum())
            begin = end
        self._links(a, ga, b, in_b, first_b, np.array(last))

    def _links(self, a: np.ndarray, ga: np.ndarray, b: np.ndarray, in_b: np.ndarray, first_b: np.ndarray, last: np.ndarray) -> None:
        """Adds each document's distinct pairs and their numbers, a bounded number of links at a time."""
        doc = np.searchsorted(last, ga, "right")
        reps = in_b[ga]
        upto = np.cumsum(reps)
        begin = 0
        while begin < len(a):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - reps[begin] + LINKS, "right")))
            part = slice(begin, end)
            r = reps[part]
            total = int(r.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(r) - r, r)
            other = b[np.repeat(first_b[ga[part]], r) + inside]
            keys = np.repeat(doc[part] << 32 | a[part] << 16, r) | other
            keys, times = np.unique(keys, return_counts=True)
            edges = np.searchsorted(keys >> 32, np.arange(len(last) + 1))
            for d in np.flatnonzero(np.diff(edges)):
                own = slice(edges[d], edges[d + 1])
                pairs = self.docs[d][7]
                pairs.append((keys[own] & 0xFFFFFFFF, times[own]))
                if len(pairs) > 16:
                    pairs[:] = [_added(pairs)]
            begin = end


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(pairs) == 1:
        return pairs[0]
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([t for _, t in pairs])).astype(np.int64)


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def linked(events: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    """Blocks (written) of the distinct linked id pairs (``key``: A id times 65536, plus B id) of each document, with its totals."""
    kind = events.schema["doc_id"].dataType.simpleString()
    dealt = events.repartition("rid").sortWithinPartitions("rid", "at", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = both_of(a_path, b_path)
        machine, made, now = Machine(both.a_len, both.b_len), None, None

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in made.counts])
            vocabulary, places, holders = np.unique(keys, return_inverse=True, return_counts=True)
            edges = np.cumsum([0, *(len(k) for k, _ in made.counts)])
            made.counts = [(places[edges[i] : edges[i + 1]], t) for i, (_, t) in enumerate(made.counts)]
            yield from made.close(pa.array(vocabulary, pa.int64()), holders.astype(np.int64))

        def swept() -> Iterator[pa.RecordBatch]:
            for row, keys, times in machine.sweep():
                made.add(row, keys, times)
                if made.full():
                    yield from close()

        for batch in batches:
            if made is None:
                own = [batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.string()]
                made = blocks.Builder(TaskContext.get().partitionId(), list(zip(_COLUMNS, own, strict=True)), pa.int64())
            for rid, doc, side, at, ids in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "side", "at", "ids")), strict=True):
                if machine.held >= SWEEP or len(machine.docs) >= SWEEP:
                    yield from swept()
                if rid != now:
                    now = rid
                    machine.begin(doc)
                machine.feed(side, at, ids)
        if made is not None:
            machine.end_doc()
            yield from swept()
            if made.rows:
                yield from close()

    columns = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return materialise(dealt.mapInArrow(run, blocks.schema(columns, "long")), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """``key, count, best``: how many documents hold a pair linked, and 1 if no pair of its A id is held by more (else 0). Written; an A id has
    as many pairs as the other vocabulary has ids at most."""
    count = materialise(blocks.totals(links).withColumnRenamed("total", "count"), "pairs")
    most = count.groupBy(F.shiftright("key", 16).alias("a_id")).agg(F.max("count").alias("most"))
    paired = count.withColumn("a_id", F.shiftright("key", 16)).join(F.broadcast(most), "a_id")  # one row an id of the vocabulary, of which 65,536 are allowed
    return paired.select("key", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a_path`` is a byte-level tokenizers JSON file, ``b_path`` a sentencepiece model that puts a space first, both of at most 65,536 ids; by
    default ``byte_bpe_50k.json`` and ``piece_bpe_32k.model``. A null or empty text, or one that either tokenizer doesn't give back byte by byte, has
    zeros and an empty digest. Repeated rows and null ids are documents like any other; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    links = linked(end_events(docs, text, doc_id, a_path, b_path), a_path, b_path)
    out = blocks.weighted_sums(links, pair_counts(links).withColumnsRenamed({"best": "n_best", "count": "count_sum"}), _COLUMNS)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
