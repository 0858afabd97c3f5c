"""Exact, near and line dedup, decontamination: against brute force, and edge cases."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clademill.llm import common, decontam, exact_dedup, fuzzy_lines, minhash, simhash

DOCS = "doc_id long, text string, sha string, maybe int"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(40)] + [(600, 600)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 5), "s", 1) for i in range(40)]
    rows += [(50, "a b\tc", None, None), (51, "abc", None, None), (52, " a\x0bb\x0cc\n", None, None), (53, None, None, None), (54, "", None, None), (55, " \r\n", None, None), (None, "abc ", None, None), (60, "dup", None, None), (60, "dup", None, None), (70, "long " * 100_000, None, None), (71, "a bc", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for bits in (None, 64):  # a full bitmap sends more rows the exact way, with the same result
        got = exact_dedup.classify(docs, bits=bits).collect()
        by = {r.doc_id: r for r in got}
        assert len(got) == len(rows) and (by[50].keep_id, by[51].keep_id, by[52].keep_id, by[None].keep_id) == (52, 52, 52, 52) and by[52].group_size == 4
        assert (by[53].keep_id, by[54].keep_id, by[55].kept) == (55, 55, True) and by[71].group_size == 1
        assert sum(r.kept for r in got if r.doc_id == 60) == 1
        kept = exact_dedup.deduplicate(docs, bits=bits)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert exact_dedup.classify(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)] + [None, "", " \n", "one", "one two", "Ünï ÀB c d e"]
    for t in [prose(rng, 400) for _ in range(10)]:
        words = t.split()
        texts += [t, t.upper()] + [" ".join(words[:k] + ["new"] + words[k + 1 :]) for k in rng.sample(range(400), 6)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "one", "x", 0)], "doc_id long, text string, print string, component_id int")
    got = simhash.cluster(docs).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    roots = components_of(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}
    assert len(set(roots.values())) < len(roots) and simhash.cluster(docs.limit(0)).count() == 0


def test_long_text_is_hashed_whole():
    rng = random.Random(9)
    text = prose(rng, 70_000)
    assert simhash.fingerprint(text.encode(), 3) == brute_print(text)


@pytest.mark.parametrize("k, agree", [(2, 1), (6, 2)])
def test_gray_index_finds_all(k, agree):
    rng = np.random.default_rng(k)
    codes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, *(codes ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4))]))
    want = {(int(a), int(b)) for i, b in enumerate(codes) for a in codes[:i] if int(a ^ b).bit_count() <= k}
    got = set()
    for mask in simhash.masks(k, agree):
        key = codes & np.uint64(mask)
        rank = codes.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        order = np.lexsort((rank, key))
        new = np.append(True, key[order][1:] != key[order][:-1])
        index = simhash.GrayIndex(codes[order], np.flatnonzero(new))
        for i, j in index.pairs(np.cumsum(new) - 1, k):
            got |= {tuple(sorted((int(codes[order][a]), int(codes[order][b])))) for a, b in zip(i, j, strict=True)}
    assert got == want and want


def test_near_dedup(spark):
    rng = random.Random(5)
    texts = [prose(rng, 300) for _ in range(30)]
    near = [" ".join(t.split()[:-3]) for t in texts[:10]]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts + near)] + [(None, None, "x", 0), (None, "", "x", 0)], "doc_id long, text string, rid string, code int")
    kept = simhash.near_deduplicate(docs.coalesce(1))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == list(range(30)) and ids.count(None) == 1
    assert simhash.near_deduplicate(docs.limit(0)).count() == 0


def test_near_dedup_finds_block_edits(spark):
    rng = random.Random(11)
    many = [f"v{i}" for i in range(5000)]
    texts = [[rng.choice(many) for _ in range(rng.randint(80, 400))] for _ in range(160)]
    fresh = lambda n: [rng.choice(many) for _ in range(n)]
    near = []
    for i, words in enumerate(texts):
        n, at = len(words), len(words) // 3
        near.append((words[: int(n * 0.84)], words + fresh(int(n * 0.18)), words[:at] + fresh(int(n * 0.05)) + words[at + int(n * 0.05) :], words[int(n * 0.1) :])[i % 4])
    sets = [[set(zip(*(w[j:] for j in range(5)), strict=False)) for w in pair] for pair in zip(texts, near, strict=True)]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in sets)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts + near)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in simhash.near_deduplicate(docs).collect()} == set(range(160))


def test_near_dedup_in_a_crowd(spark):
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(200)]
    slots = range(2, 160, 10)

    def varied():
        return [f"{w}-{rng.randrange(4)}" if k in slots else w for k, w in enumerate(base)]

    texts = [varied() for _ in range(400)]
    near = [w[:-34] for w in texts[100:180]]
    rows = texts[:180] + near + texts[180:]
    sets = [set(zip(*(w[j:] for j in range(5)), strict=False)) for w in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(components_of(range(len(rows)), links).values())
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in simhash.near_deduplicate(docs).collect()} == want and len(want) >= 300


def test_near_dedup_of_clashing_null_and_repeated_rows(spark):
    rng = random.Random(21)
    text = prose(rng, 80)
    rows = [(7, text, 1, "a"), (3, text + " end", 2, "b"), (3, text + " end", 2, "b"), (None, text, 3, "c"), (9, None, 4, "d"), (8, "", 5, "e"), (8, " ", 6, "f"), (5, "one", 7, "g"), (4, prose(rng, 30_000), 8, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, node string").withColumn("root", F.lit(1)).withColumn("rid", F.lit(2))
    kept = simhash.near_deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert sorted(simhash.near_deduplicate(docs.repartition(3, "id")).select("doc_id").collect()) == sorted(kept.select("doc_id").collect())


def test_large_groups_of_prints_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    base = np.int64(rng.integers(0, 1 << 62))
    codes = {int(base)} | {int(base ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 43, (400, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    table = spark.createDataFrame([(0, c) for c in codes], "lane int, print long")
    want = components_of(codes, [(a, b) for a, b in combinations(codes, 2) if (a ^ b).bit_count() <= 2])
    for most in (10, 1 << 20):
        got = {r.node: r.root for r in common.components(simhash.linked_prints(table, 2, most=most)).collect()}
        assert got == {n: r for n, r in want.items() if n != r}


def test_a_crowd_meets_by_prefixes(spark, monkeypatch):
    """All links within a crowd are found, and no pair twice, also where tokens are shared by more rows than a block has, and where cells hold many hashes."""
    rng = np.random.default_rng(13)
    texts = [set(rng.integers(0, 60, rng.integers(30, 50)).tolist()) for _ in range(700)]
    texts += [x - {min(x)} for x in texts[:200]] + [{1000 + k} for k in range(9)] + [set(range(5)), set(range(4)), set(range(6))]
    links = {(a, b) for a, b in combinations(range(len(texts)), 2) if a // 2 != b // 2 and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])}
    assert len(links) > 100
    for spread in (1, 0x9E3779B97F4A7C15):
        sets = [np.sort(np.array(sorted(x), np.uint64) * np.uint64(spread)) for x in texts]
        marks = [minhash.sketches(minhash.minima(minhash.mixed(x), np.zeros(1, np.int64)))[0] for x in sets]
        rows = [(n, n // 2, marks[n], str(n)) for n in range(len(texts))]
        crowd = spark.createDataFrame(rows, "id long, root long, sketch binary, data string").repartition(3)
        pairs = [(r.a, r.b) for r in minhash.crowd_pairs(crowd, lambda data: [sets[int(x)] for x in data], 0.8).collect()]
        assert len(pairs) == len(set(pairs)) and links <= set(pairs) and all(a // 2 != b // 2 for a, b in pairs)


def test_a_dense_crowd_makes_few_pairs(spark, monkeypatch):
    """Groups of near copies, one whose pairs nearly all link and one whose pairs are all just too different: candidates grow with the rows, not with their pairs."""
    rng = random.Random(31)
    mixed = lambda x: np.sort(minhash.mixed(np.array(sorted(x), np.uint64)))

    def group(n, at, changed):
        return [set(range(at, at + 200)) - set(rng.sample(range(at, at + 200), changed)) | set(rng.sample(range(at + 500, at + 550), changed)) for _ in range(n)]

    texts = group(300, 0, 11) + group(500, 10_000, 20) + group(40, 20_000, 16)
    sets = [mixed(x) for x in texts]
    low = [minhash.minima(x, np.zeros(1, np.int64)) for x in sets]
    rows = [(n, minhash.band_keys(x)[0].tolist(), minhash.sketches(x)[0]) for n, x in enumerate(low)]
    signed = common.materialise(spark.createDataFrame(rows, "id long, bands array<long>, sketch binary"), "signed")
    texts_of = spark.createDataFrame([(n, str(n)) for n in range(len(sets))], "id long, data string")
    made = []

    def counted(pairs, *rest, real=minhash.verified):
        made.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", counted)
    got = {r.node: r.root for r in minhash.linked(signed, lambda ids: texts_of, lambda data: [sets[int(x)] for x in data]).collect()}
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])]
    want = components_of(range(len(texts)), links)
    assert sum(got.get(n, n) != want[n] for n in want) <= 2 and len(links) > 10_000
    assert sum(made[1:]) <= 5 * len(texts)


def test_sketches_keep_all_that_is_similar():
    """The bound of a crowd's sketches is exact up to as many members as parities, and tells what is less similar apart."""
    rng = random.Random(32)
    for size, changed in [(3, 0), (20, 2), (100, 11), (1000, 110), (6000, 660)]:
        base = rng.sample(range(1 << 40), size)
        sets = [np.sort(np.array(base[: size - changed] + rng.sample(range(1 << 41, 1 << 42), changed), np.uint64)) for _ in range(30)]
        sets += [np.sort(np.array(base[: size // 2] + rng.sample(range(1 << 41, 1 << 42), size - size // 2), np.uint64)) for _ in range(30)]
        sets = [np.sort(minhash.mixed(x)) for x in sets]
        x, y = np.triu_indices(len(sets), 1)
        near = np.array([minhash.similar(sets[a], sets[b], 0.8) for a, b in zip(x, y, strict=True)])
        far, allowed = minhash.distances(minhash.crowd_sketches(sets), np.array([len(s) for s in sets], np.int32), x, y, 0.8)
        assert near.any() and allowed[near].all() and (size < 20 or far[near].max() < far[~near & (x >= 30)].min() and not allowed[x >= 30].any())


def test_prefixes_are_short_where_members_are_rare():
    counts = np.zeros(1 << minhash.CELL_BITS, np.uint32)
    hashes = np.arange(1, 101, dtype=np.uint64) << np.uint64(44)
    counts[1:101] = np.where(np.arange(100) < 25, 1, 9)
    assert len(minhash.prefix(hashes, counts, 0.8)[0]) == 0  # 21 of them decide, all of which only this set has
    counts[1:101] = np.arange(100, 0, -1) + 1
    found, places = minhash.prefix(hashes, counts, 0.8)
    assert (found >> np.uint64(44)).tolist() == list(range(100, 79, -1)) and places.tolist() == list(range(21))


def test_numbered_lines(spark):
    """Lines that share bands with all others but link to few: 6,000 of a text that differ in their numbers."""
    rng = random.Random(21)
    lines = [f"line {n} with some words number {n % 7}" for n in range(6000)]
    lines += [f"measured at station {rng.randrange(10**6)} on the day a value of {rng.randrange(10**4)} and no more" for _ in range(600)]
    lines += [x.replace("no more", "no mores") for x in lines[-100:]]
    got = {r.line_no: r.class_line_no for r in fuzzy_lines.classify(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()}
    assert len(got) == len(lines) and all(got[6600 + k] == got[6500 + k] for k in range(100))
    tail = [(n, x) for n, x in enumerate(lines)][5400:]
    want = brute_lines([(0, "\n".join(x for _, x in tail))])
    apart = {k[1] + 5400: v[1] + 5400 for k, v in want.items() if k[1] >= 600}
    assert sum(got[k] != v for k, v in apart.items()) <= 2


def brute_lines(docs, least=0.8, size=8):
    first = {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            line = re.sub(r"\s+", " ", line).strip().lower()
            if line:
                first.setdefault(line, []).append((i, n))
    sets = {x: {x} if len(x) <= size else {x[i : i + size] for i in range(len(x) - size + 1)} for x in first}
    near = [(min(first[a]), min(first[b])) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    roots = components_of({min(v) for v in first.values()}, near)
    return {place: roots[min(places)] for places in first.values() for place in places}


def test_fuzzy_lines(spark):
    rng = random.Random(6)
    base = [prose(rng, rng.randint(3, 60)) for _ in range(60)]
    near = [x.replace(x.split()[1], "zzz", 1) for x in base]
    lines = base + near + base[:10] + ["", "  ", "tiny", "Tiny", "x" * 5000, "x" * 5001, "字" * 60, "字" * 61]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 7 : i * 7 + 7]), "c", 0) for i in range(len(lines) // 7 + 1)] + [(900, None, "c", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, line string, key int")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in fuzzy_lines.classify(table).collect()}
    want = brute_lines([(i, t) for i, t, *_ in docs])
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    clean = {r.doc_id: r.text for r in fuzzy_lines.deduplicate(table).collect()}
    assert clean[900] is None and sum(len([x for x in t.split("\n") if x.strip()]) for t in clean.values() if t) == len(set(got.values()))
    assert fuzzy_lines.classify(table.limit(0)).count() == 0


def test_fuzzy_lines_in_a_crowd(spark, monkeypatch):
    rng = random.Random(14)
    base = prose(rng, 60).split()
    varied = lambda: " ".join(f"{w}x{rng.choice('abcd') * 6}" if k % 6 == 2 else w for k, w in enumerate(base))
    rows = [varied() for _ in range(300)]
    rows += [" ".join(x.split()[:-7]) for x in rows[:60]]
    docs = [(i, x) for i, x in enumerate(rows)]
    monkeypatch.setattr(minhash, "BLOCK", 64)  # bands are dealt out by pairs of blocks
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in fuzzy_lines.classify(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_lines(docs)
    wrong = sum(got[k] != want[k] for k in want)
    assert len(set(want.values())) > 100 and wrong <= 1


def test_any_small_edit_shares_bands():
    rng = random.Random(15)
    letters = "abcdefgh0123/"
    for size in (3, 6, 12, 19, 200):
        lines = [" ".join("".join(rng.choice(letters) for _ in range(size)) for _ in range(max(2, 160 // size))) for _ in range(100)]
        edited = [x[:40] + "qq" + x[40:] for x in lines]
        one, two = (minhash.band_keys(fuzzy_lines.signatures(x)) for x in (lines, edited))
        assert (one == two).any(axis=1).mean() >= 0.98


def test_shingles_of_lines_of_any_length():
    rng = random.Random(16)
    lines = ["a", "ab", "ab" + "c" * 7, "字" * 60, "x" * 300_000, "", *("".join(rng.choice("abcd ") for _ in range(rng.choice((5, 8, 9, 600_000)))) for _ in range(12)), "ab"]
    sets = fuzzy_lines.shingle_sets(lines)
    for x, found in zip(lines, sets, strict=True):
        assert len(found) == len({x[i : i + 8] for i in range(max(1, len(x) - 7))})
    assert np.array_equal(sets[1], sets[-1]) and minhash.shared(sets[2], sets[2]) == len(sets[2])
    assert (fuzzy_lines.signatures(lines)[1] == fuzzy_lines.signatures(["ab"])[0]).all()


def test_fuzzy_lines_that_repeat_themselves_and_clash(spark):
    rows = [(1, "-" * 10), (2, "-" * 40), (3, "say it again " * 5), (4, "say it again " * 20), (5, None), (None, "-" * 10), (6, ""), (7, "Say  it\tAGAIN " * 9), (7, "only one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("own", "nos", "key", "line_no", "head", "__id", "__gone", "band", "id"):
        docs = docs.withColumn(c, F.lit("x"))
    got = {(r.doc_id, r.line_no): r.class_doc_id for r in fuzzy_lines.classify(docs).collect()}
    assert (got[1, 0], got[2, 0], got[None, 0]) == (None, None, None) and (got[3, 0], got[4, 0]) == (3, 3) and (5, 0) not in got and (6, 0) not in got
    kept = fuzzy_lines.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect() if r.doc_id in (2, 3, 4, 5, 6)} == {2: "", 3: rows[2][1], 4: "", 5: None, 6: ""}
    assert fuzzy_lines.deduplicate(docs.limit(0)).count() == 0


def test_fuzzy_lines_recall_on_the_sample(spark):
    """All links among the lines of sf0.1, by an exact search over the rarest fifth of each line's shingles."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in fuzzy_lines.classify(table).collect()}
    first = {}
    for r in table.collect():
        for n, line in enumerate(fuzzy_lines.normal_lines(r.text)):
            if line:
                first[line] = min(first.get(line, (r.doc_id, n)), (r.doc_id, n))
    lines = list(first)
    sets = fuzzy_lines.shingle_sets(lines)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((flat, count[inverse], owner))
    flat, owner, often = flat[order], owner[order], count[inverse][order]
    place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]
    use = (place <= sizes[owner] - np.ceil(0.8 * sizes[owner])) & (often > 1)
    flat, owner = flat[use], owner[use]
    order = np.argsort(flat, kind="stable")
    links = set()
    for group in np.split(owner[order], np.flatnonzero(np.diff(flat[order])) + 1):
        x, y = np.triu_indices(len(group), 1)
        x, y = group[x], group[y]
        near = np.minimum(sizes[x], sizes[y]) >= 0.8 * np.maximum(sizes[x], sizes[y])
        links.update(zip(np.minimum(x, y)[near].tolist(), np.maximum(x, y)[near].tolist()))
    links = [(a, b) for a, b in links if minhash.similar(sets[a], sets[b], 0.8)]
    joined = sum(got[first[lines[a]]] == got[first[lines[b]]] for a, b in links)
    want = components_of(range(len(lines)), links)
    heads = {}
    for k, line in enumerate(lines):
        heads[want[k]] = min(heads.get(want[k], first[line]), first[line])
    wrong = sum(got[first[line]] != heads[want[k]] for k, line in enumerate(lines))
    assert len(links) > 2000 and joined >= 0.995 * len(links) and wrong <= 10


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, 40)) for i in range(20)] + [(30, "short one here"), (31, None), (32, "..."), (33, "one two three four five six")]
    def put(passage):
        return f"{prose(rng, 100)} {passage} {prose(rng, 100)}"
    docs = [(i, put(t)) for i, t in items[:20]]
    for i, t in items[:20]:
        words = t.upper().split()
        for k in rng.sample(range(40), 4):
            words[k] = "changed"
        docs.append((100 + i, put(", ".join(words))))
        docs.append((200 + i, put(" ".join(t.split()[5:25]))))
    docs += [(300 + i, prose(rng, 300)) for i in range(50)] + [(400, None), (401, ""), (402, "short ONE here!"), (403, "a short one here and more"), (404, "ab one two three four five six cd"), (405, "x " * 200_000 + items[3][1])]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(table, bench).collect()}
    want = {(b + i, i) for i in range(20) for b in (0, 100, 200)} | {(402, 30), (404, 33), (405, 3)}
    assert got == want
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.overlaps(table, bench.limit(0)).count() == 0 and decontam.overlaps(table.limit(0), bench).count() == 0
    clash = table.withColumn("t1", F.lit(1)).withColumn("maybe", F.lit(2)).withColumn("sha", F.lit(3)).unionByName(spark.createDataFrame([(None, items[4][1], "x", 0, 0, 0), (None, None, "x", 0, 0, 0)], "doc_id long, text string, item_id string, t1 int, maybe int, sha int"))
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(clash, bench.union(bench.where("item_id = 3"))).collect()} == want | {(None, 4)}
    assert decontam.drop_contaminated(clash, bench).columns == clash.columns and decontam.drop_contaminated(clash, bench).where("doc_id IS NULL").count() == 1


def test_masks_are_complete():
    """Every way to place as many substitutions as an overlap may have leaves a hit."""
    for n in range(5, 30):
        changed = n // 5
        shapes = [[i for i, x in enumerate(m) if x == "1"] for m in decontam.masks_of(n)]
        placed = [sum(1 << (at + i) for i in s) for s in shapes for at in range(n - s[-1])]
        shorter = (n - 1) // 5 == changed and decontam.masks_of(n - 1) == decontam.masks_of(n)
        for where in combinations(range(n), changed):
            if not (shorter and where[0]):  # without its first token that is a case of the length before
                gone = sum(1 << i for i in where)
                assert any(not p & gone for p in placed), (n, where)


def brute_overlap(doc, item):
    """Whether any stretch of any diagonal counts."""
    need = min(13, -(-4 * len(item) // 5))
    for shift in range(-len(item) + 1, len(doc)):
        pairs = [doc[shift + q] == item[q] for q in range(len(item)) if 0 <= shift + q < len(doc)]
        for i in range(len(pairs)):
            equal = 0
            for j in range(i, len(pairs)):
                equal += pairs[j]
                if equal >= need and equal >= 0.8 * (j - i + 1):
                    return True
    return False


def test_decontamination_against_brute_force(spark):
    rng = random.Random(17)
    items = [(i, [f"i{i}w{k}" for k in range(n)]) for i, n in enumerate(list(range(5, 41)) * 3)]
    docs = []
    for i, words in items:
        for share in (0, 0.1, 0.15, 0.2, 0.25, 0.3):
            new = list(words)
            for k in rng.sample(range(len(new)), round(share * len(new))):
                new[k] = "changed"
            docs.append((len(docs), i, prose(rng, rng.randint(0, 30)).split() + new + prose(rng, rng.randint(0, 30)).split()))
    want = {(d, i) for d, i, words in docs if brute_overlap(words, items[i][1])}
    table = spark.createDataFrame([(d, " ".join(w)) for d, _, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = decontam.overlaps(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and 300 < len(want) < len(docs)
    texts = {d: w for d, _, w in docs}
    for r in rows:
        equal = sum(a == b for a, b in zip(texts[r.doc_id][r.doc_start : r.doc_start + r.overlap], items[r.item_id][1][r.item_start : r.item_start + r.overlap], strict=True))
        assert equal == r.equal >= 0.8 * r.overlap
