"""WARC archives, chat formatting and packing: exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clademill.llm import chat, packing, warc

PAGES = "page_id long, url string, html string, sha string, digest string"


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(3)
    long = "<p>" + "long " * 200_000
    rows = [(i, f"http://h{i % 3}/{i}", f"<html>{rng.random()} {'shared words ' * 30}\n</html>", "x", "y") for i in range(60)]
    rows += [(100 + i, "http://copy/", "<b>\n\ncopy é</b>", None, None) for i in range(30)]
    rows += [(200, None, None, None, None), (201, "bad\r\nurl", "", None, None), (202, "u", long, None, None), (None, "u", "nul\x00l", None, None), (203, "u", "twice", None, None), (203, "u", "twice", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    path = str(tmp_path / "a")
    warc.write_archives(pages, path, archive_bytes=1 << 20)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert by[129].record_type == "response" and by[129].refers_to is None and by[129].payload == "<b>\n\ncopy é</b>".encode()
    assert all(by[100 + i].record_type == "revisit" and by[100 + i].refers_to == 129 and by[100 + i].payload is None for i in range(29))
    assert by[200].refers_to == 201 and by[202].payload == long.encode() and "\r" not in by[201].target_uri
    assert [r.record_type for r in got if r.page_id == 203] == ["response"] * 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    assert len(files) > 1 and all(bytes(f.content[:4]) == b"\x5d\x2a\x4d\x18" for f in files)
    small = str(tmp_path / "b")
    warc.write_archives(pages, small, least_bytes=100)
    assert warc.read_archives(spark, small, payloads=False).where("record_type = 'revisit'").count() == 0
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_archive_is_a_zstandard_stream():
    import zstandard

    records = [warc.make_record(i, f"http://x/{i}", f"<p>page {i} {'text ' * 50}".encode(), "D" * 32, True, None, "2020-01-01T00:00:00Z") for i in range(80)]
    data = b"".join(r + b"\n" for r in warc.archive_rows(records, 4096, 3))
    assert [r for _, r in warc.read_records(data)] == records
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    offset, first = next(warc.read_records(data))
    assert size > 0 and zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[offset:][: len(first)], max_output_size=len(first)) == first


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:\\#</turn> \n", max_size=12), st.text(alphabet="ab\\#</turn> \nA:é", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    turns = [("assistant" if i % 2 else role, text) for i, (role, text) in enumerate(turns)]
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


MESSAGES = "tree string, node int, parent int, role string, text string, score double"


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", None), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 4, None, "c", 4.0)]
    rows += [("u", 7, 99, "user", "orphan", 0.0), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0), ("t", 2, 1, "assistant", "a", 1.0), (None, 1, None, "user", "null tree", 0.0)]
    table = spark.createDataFrame(rows, MESSAGES)
    every = chat.paths(table).collect()
    assert {(r.tree, r.leaf) for r in every} == {("t", 2), ("t", 5), ("u", 7), (None, 1)}
    assert [r.node for r in sorted((r for r in every if r.leaf == 5), key=lambda r: -r.distance)] == [1, 3, 4, 5]
    ranked = {(r.tree, r.leaf): r.branch_rank for r in chat.paths(table, 2).collect()}
    assert ranked["t", 5] == 1 and ranked["t", 2] == 2
    one = {r.tree: r for r in chat.conversations(table).collect()}
    assert chat.parse_turns(one["t"].formatted) == [("user", "q"), ("assistant", "b"), ("user", ""), ("", "c")]
    assert chat.conversations(table.limit(0)).count() == 0


def test_long_chain_and_linear(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"x{i}") for i in range(300)]
    turns = spark.createDataFrame(rows + [(2, None, None, None), (2, None, None, None)], "conv_id int, turn int, role string, text string").withColumn("node", F.lit("clash"))
    got = {r.tree: chat.parse_turns(r.formatted) for r in chat.conversations(chat.linear_trees(turns)).collect()}
    assert [t for _, t in got[1]] == [f"x{i}" for i in range(300)] and got[2] == [("", ""), ("", "")]


@pytest.fixture(scope="module")
def words():
    return packing.Words(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet="aAéİßΣσ’'.,!%&<|>_0 \t\n\x0b\x85　中K", max_size=20)))
def test_cached_tokens_are_the_tokenizers(words, text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 40))]
        got = packing.best_fit_decreasing(lengths, 64)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        windows: list[list[int]] = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [(64 - sum(lengths[k] for k in w), w) for w in windows if 64 - sum(lengths[k] for k in w) >= lengths[i]]
            min(fits, key=lambda x: x[0])[1].append(i) if fits else windows.append([i])
        assert sorted(sum(lengths[i] for i in w) for w in got) == sorted(sum(lengths[i] for i in w) for w in windows)


def test_pack(spark, words):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "it's", "Gamma,"]) for _ in range(rng.randint(0, 900))) for _ in range(60)] + [None, "", "word " * 9000]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "no id", "x", 0), (0, texts[0], "x", 0)], "doc_id long, text string, ids string, length int")
    rows = packing.pack(docs.repartition(3), size=256, block=4000, slack=8).collect()
    whole: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        whole.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        want = words.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        got = [x for r in whole[i] for x in np.frombuffer(r.ids, "<u4").tolist()]
        if i:
            assert got == want and [r.start for r in whole[i]] == np.cumsum([0] + [r.length for r in whole[i]])[:-1].tolist()
        else:
            assert len(got) == 2 * len(want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and (at >= 248 or at & (at - 1) == 0)
    assert packing.pack(docs.limit(0)).count() == 0
