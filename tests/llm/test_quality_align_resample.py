"""Quality rules, token alignment and importance resampling against brute force, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from clademill.llm import align, blocks, quality, resample

HARD = [
    None, "", " ", "\n", "word", "one two three one two three", "a b c d a b c", "x " * 5000, "Zwölf Boxkämpfer jagen Viktor\nZwölf Boxkämpfer jagen Viktor\n\n \nEnde",
    "<|endoftext|> is text here <s> </s> <0x0A>", "tabs\tand\x0bother\x0cwhite\r\nspace  twice   thrice ", "日本語のテキスト と emoji 🙂🙂 ok", "no break   spaces \n\nhere", "▁ underline ▁▁ here", "#tag *star* $5 % & | <b>",
    "- one\n- two\n* three\n• four", "wait...\nand so on…\nend", "ALL CAPS HERE " * 30, "a" * 3000, "the same line\n" * 40, "".join(chr(c) for c in range(1, 128)), "é combining ​ zero",
]


def rows_of(n=60, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "Benz", "élan", "und", "x1", "don't", "w-w", "ing", "zu", "!!", "..."]
    made = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    texts = HARD + made + made[:3]
    ids = [*range(len(texts) - 2), None, 7]
    return list(zip(ids, texts, ["k"] * len(texts), range(len(texts)), strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), "doc_id long, text string, key string, Block int").repartition(3).cache()


EMPTY = "doc_id long, text string, place int"


def quality_by_hand(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    places = defaultdict(list)
    for k in range(len(w) - 2):
        places[tuple(w[k : k + 3])].append(k)
    covered = {p + j for ps in places.values() if len(ps) > 1 for p in ps for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    letters, capitals = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
    failed = n < 50 or 100 * len(covered) > 50 * n
    bad = 10 * symbols > n or not 2 * n <= chars <= 15 * n or 2 * dup > len(lines) or 10 * letters < 6 * chars or 2 * capitals > letters
    bad |= 10 * sum(bool(re.match(" *[-*•]", x)) for x in lines) > 9 * len(lines) or 10 * sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) > 3 * len(lines)
    return n, chars, symbols, dup, len(covered), failed, not failed and not bad


def test_quality_by_hand(spark, docs):
    got = quality.classify(docs)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted((str(i), *quality_by_hand(t)) for i, t, *_ in rows_of())
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert any(x[-1] for x in want)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in want if x[-1])


def test_quality_is_native_and_takes_empty_tables(spark, docs):
    plan = quality.classify(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("== Physical Plan ==")[1])
    assert quality.classify(spark.createDataFrame([], EMPTY)).count() == 0
    assert quality.keep_good(spark.createDataFrame([], EMPTY)).count() == 0


def test_rules_go_by_rejection_per_cost_of_what_is_left():
    cost = {"dear": 10.0, "cheap": 1.0, "same": 1.5, "idle": 0.1}
    outcomes = {(True, False, False, False): 30, (True, True, True, False): 40, (False, False, True, False): 1, (False, False, False, False): 29}
    # after "cheap" the rule "same" rejects one row alone, "dear" thirty
    assert quality.rank_rules(cost, outcomes) == ["cheap", "dear", "same", "idle"]


def align_by_hand(texts):
    both = align.both_of(None, None)
    count, docs = Counter(), []
    for t in texts:
        told = " " + (t or "")
        a = both.a.encode(told, add_special_tokens=False).ids if t else []
        b = both.b.encode(t) if t else []
        x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if b"".join(x) != told.encode() or b"".join(y) != told.encode():
            docs.append(([], [], [], Counter()))
            continue
        ends = [list(accumulate(map(len, part))) for part in (x, y)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        count.update(links.keys())
        docs.append((a, b, groups, links))
    best = Counter()
    for (p, _), c in count.items():
        best[p] = max(best[p], c)
    told = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [
        (len(a), len(b), len(g), sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in links.items()), hashlib.sha256(told(g).encode()).hexdigest() if g else "")
        for a, b, g, links in docs
    ]


def test_alignment_by_hand(spark, docs):
    rows = rows_of()
    want = sorted((str(i), *x) for (i, *_), x in zip(rows, align_by_hand([t for _, t, *_ in rows]), strict=True))
    got = align.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert sum(x[1] == 0 for x in want) >= 3  # null, empty, and texts with the space sign


def test_machine_in_small_sweeps(monkeypatch):
    both = align.both_of(None, None)
    monkeypatch.setattr(align, "LINKS", 3)
    texts = [t for _, t, *_ in rows_of() if t and both.ids(t.encode())]

    def run(run_length, sweep):
        machine, out = align.Machine(both.a_len, both.b_len), []
        for t in texts:
            a, b = both.ids(t.encode())
            events = []
            for side, (ids, lengths) in enumerate(((a, both.a_len), (b, both.b_len))):
                at = 0
                for i in range(0, len(ids), 2 * run_length):
                    part = ids[i : i + 2 * run_length]
                    events.append((at, side, part))
                    at += int(lengths[align.np.frombuffer(part, "<u2")].sum())
            machine.begin(t)
            for at, side, part in sorted(events):
                if machine.held >= sweep:
                    out += machine.sweep()
                machine.feed(side, at, part)
        machine.end_doc()
        return [(row, keys.tolist(), times.tolist()) for row, keys, times in [*out, *machine.sweep()]]

    assert run(3, 7) == run(1 << 14, 1 << 18) and len(run(3, 7)) == len(texts)


def test_quick_ids_are_the_tokenizers_own():
    rng = random.Random(3)
    both = align.both_of(None, None)
    signs = ["a", "b ", " ", "\n", "\t", "é", "ing", "The", " the", "'s", "12", "日", "🙂", "\r\n", "<s>", "<|endoftext|>", "\x1c", "--", "\x0b"]
    found = 0
    for n in range(2000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) + "x" * (1200 * (n % 500 == 0))
        ids = both.ids(t.encode())
        found += ids is not None
        assert ids is None or list(align.np.frombuffer(ids[0], "<u2")) == both.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
    assert found > 1000 and both.ids(b"\xff\xfe") is None


def test_alignment_of_empty_table(spark):
    assert align.align(spark.createDataFrame([], EMPTY)).count() == 0


def resampled_by_hand(rows, target, longest, buckets, share, least, seed=2024):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    made = [(i, *features(text)) for i, text in rows]
    for _, _, f in made:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in range(buckets)]
    out = []
    for i, n, f in made:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = [(x, k + 1) for k, x in enumerate(able[: share * len(able) // 100])]
    rest = list(out)
    for x, _ in drawn:
        rest.remove(x)
    return sorted([(*map(str, x), str(k)) for x, k in drawn] + [(*map(str, x), "None") for x in rest])


@pytest.mark.parametrize(("longest", "share"), [(1, 10), (2, 60), (3, 100)])
def test_resampling_by_hand(spark, docs, longest, share):
    target = [(1, "the élan of Benz und zu"), (2, None), (3, ""), (4, "words of the target, the end")]
    goal = spark.createDataFrame(target, "doc_id int, text string")
    got = resample.resample(docs, goal, longest=longest, buckets=97, share=share)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = resampled_by_hand([(i, t) for i, t, *_ in rows_of()], [t for _, t in target], longest, 97, share, 20)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want


def test_resampling_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], EMPTY)
    assert resample.resample(none, docs).count() == 0
    assert resample.resample(docs, none).where("rank IS NOT NULL").count() == 10 * resample.resample(docs, none).where("n_words >= 20").count() // 100
    assert resample.resample(docs, docs, least_words=10**9).where("rank IS NOT NULL").count() == 0


def test_counts_pack_and_unpack():
    import numpy as np

    for n in (0, 1, 1000):
        at, times = np.arange(n) * 70_000, np.arange(n) + 1
        back = blocks.unpack(blocks.pack(at, times))
        assert (back[0] == at).all() and (back[1] == times).all() and len(back[0]) == n
