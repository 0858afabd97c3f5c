"""Learned operators by held-out accuracy, HTML extraction on fixtures, and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clademill.llm import common, html_extract, langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = queries.op10_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    net = langid.train(docs)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (4, "x" * 3_000_000, "a"), (None, "the house and the", "a")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify(odd, net).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and len(got) == 5
    assert {r.doc_id for r in langid.keep_identified(odd, net, least=0.0).collect()} == {4, None}
    assert langid.identify(odd.limit(0), net).count() == 0
    nothing = langid.train(docs.limit(0))
    assert langid.identify(odd, nothing).where("lang_pred <> 'und'").count() == 0
    text = docs.first().text.encode() * 3
    whole = net.predict([text])[0]
    old, langid.BLOCK = langid.BLOCK, 3
    try:
        assert net.predict([text])[0] == (whole[0], pytest.approx(whole[1], abs=1e-6))
    finally:
        langid.BLOCK = old


def test_every_language_is_a_class(spark):
    docs = spark.createDataFrame([(i, f"word{i % 230} text", f"l{i % 230:03d}", 1) for i in range(1000)], "doc_id long, text string, lang string, n int").withColumn("key", F.lit(1))
    assert len(langid.train(docs).classes) == 230


def test_windows_cover_every_ngram():
    for n in (0, 1, 255, 256, 257, 509, 510, 2000):
        data = bytes((i * 7) % 251 + 1 for i in range(n))
        joined = langid.windows(data)
        found = {row[i : i + 4].tobytes() for row in joined for i in range(langid.WINDOW - 3)}
        assert {data.lower()[i : i + 4] for i in range(n - 3)} <= found


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, SF).collect()}
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    bad, good = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert np.mean(bad[:, None] > good[None]) + np.mean(bad[:, None] == good[None]) / 2 > 0.9
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 100_000), (None, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (9, 1), (None, 1), (3, None), (1, 1), (1, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    docs = docs.withColumn("toxic", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("id", F.lit(3)).withColumn("score", F.lit("a")).withColumn("data", F.lit("b"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0
    low = dict(zip(toxicity.NAMES, toxicity.features("You are an 1d1ot, an IDIOT!! and so are you", {}), strict=True))
    assert low["fixed_hits"] == 1 and low["hidden"] > 0 and low["near_second_person"] > 0 and low["exclaim"] > 0


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    raw = toxicity.BoostedTrees().fit(x, y).predict(x)
    assert np.mean((raw > 0) == (y > 0)) > 0.95
    at, mean = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(mean) >= 0).all()


PAGE = """<html><head><title>no</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">notice</div><article><h1>Head &amp; more</h1><p>One <b>bold</b>
 text<br>next<p>Two &lt;x&gt;&nbsp;y<div class="ad">advert</div><ul><li>a<li>b</ul><form><input><p>form</form><div id="comments"><p>said</div></article><aside>side</aside><footer>foot"""


def test_extract():
    assert html_extract.extract(PAGE) == "Head & more\nOne bold text next\nTwo <x> y\na\nb"
    assert html_extract.extract("") == "" and html_extract.extract("<nav>x</nav>") == "" and html_extract.extract("plain &eacute;") == "plain é"
    assert html_extract.extract("<p>a < b<p>c") == "a < b\nc"
    assert html_extract.extract("<article>" + "<p>x</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert html_extract.extract("<article><!-- no --><style>p{}</style><p title='>'>yes</p></article>") == "yes"


def wrapper_of(pages):
    parts = [html_extract.Wrapper.of(html_extract.parse(x)) for x in pages]
    whole = parts[0]
    for one in parts[1:]:
        whole = whole.merge(one)
    return whole


def test_wrapper_generalises():
    page = lambda n, extra="": f"<html><body><ul><li>Home</li></ul><div id=c>{extra}" + "".join(f"<p>text {n} {i} of some length</p>" for i in range(n)) + "</div></body></html>"
    whole = wrapper_of([page(n, "<table><tr><td>opt</td></tr></table>" if n == 3 else "") for n in range(1, 8)])
    assert any(isinstance(x.key, tuple) for x in whole.nodes) and any(x.optional for x in whole.nodes)
    assert whole.container() == "html/body/div#c"
    again = html_extract.Wrapper.from_json(whole.to_json())
    assert again.to_json() == whole.to_json() and [x.key for x in again.nodes] == [x.key for x in whole.nodes]


def test_wrapper_decides_inside_an_article():
    """Text that the host repeats at one place is left out there and nowhere else, and names alone leave out no text of an article."""
    def page(n):
        story = "Read the imprint." if n == 3 else f"Story {n} goes on."
        return f"<body><div class=x>Site</div><article id=post-{n}><h1>Title {n}</h1><div>Read the imprint.</div><p class=notice>Notice {n}</p><div class=related>See {n}</div><p><label>Label {n}</label></p><p>{story}</p></article></body>"

    whole = wrapper_of(map(page, range(8)))
    assert html_extract.extract(page(3), whole) == "Title 3\nNotice 3\nSee 3\nLabel 3\nRead the imprint."
    assert html_extract.extract(page(3)) == "Title 3\nRead the imprint.\nNotice 3\nSee 3\nLabel 3\nRead the imprint."
    few = wrapper_of(map(page, range(3)))
    assert "Read the imprint." in html_extract.extract(page(1), few)  # too few pages to tell
    same = wrapper_of([page(1).replace("<body>", f"<body><i>{n}</i>") for n in range(9)])
    assert html_extract.extract(page(1), same) == html_extract.extract(page(1))  # copies of one page tell nothing about template


def test_wrapper_tells_constants_inside_a_repeat():
    """A paragraph that all pages have at one place among differing ones is left out there, counted from the repeat's start or its end, and nowhere else."""
    def page(n, more=0):
        extra = "".join(f"<p>Further words {n} {k}.</p>" for k in range(more))
        return f"<body><article><h1>Title {n}</h1><p>Story {n} begins.</p><p>Share this story.</p>{extra}<p>Story {n} ends.</p></article></body>"

    def late(n):
        return page(n).replace("<p>Share", "".join(f"<p>More {n} {k}.</p>" for k in range(n)) + "<p>Share")

    for make in (page, lambda n: page(n, n % 3), late):
        whole = wrapper_of(map(make, range(8)))
        again = html_extract.Wrapper.from_json(whole.to_json())
        for n in (0, 3, 7):
            want = html_extract.extract(make(n)).replace("Share this story.\n", "")
            assert html_extract.extract(make(n), whole) == html_extract.extract(make(n), again) == want
    whole = wrapper_of(map(page, range(8)))
    moved = page(3).replace("<p>Story 3 begins.</p>", "").replace("<p>Story 3 ends.</p>", "<p>Story 3 ends.</p><p>a</p><p>b</p>")
    assert "Share this story." in html_extract.extract(moved, whole)
    few = wrapper_of(map(page, range(3)))
    assert "Share this story." in html_extract.extract(page(1), few)


def test_wrapper_decides_without_an_article():
    def page(n):
        body = "".join(f"<p>Paragraph {i} of page {n} with <a href=x>a link</a> in it.</p>" for i in range(n % 4 + 1))
        return f"<body><div id=top><a href=/>Start</a> <span>Our motto stands here</span></div><div id=left><span>Number {n}</span></div><div id=story><h2>Head {n}</h2><span>All rights reserved</span>{body}</div><div id=end>Made by us, {2000 + n}</div></body>"

    whole = wrapper_of(map(page, range(12)))
    for n in (2, 5):
        want = [f"Head {n}", *(f"Paragraph {i} of page {n} with a link in it." for i in range(n % 4 + 1))]
        assert html_extract.extract(page(n), whole) == "\n".join(want) != html_extract.extract(page(n))
    assert html_extract.extract("<body><section><p>Quite another page.</p></section></body>", whole) == "Quite another page."


def test_wrappers_stay_bounded():
    pages = ["<body>" + "".join(f"<div class=k{chr(97 + n)}{chr(97 + i % 26)}x{chr(97 + i // 26)}><p>{n} {i}</p></div>" for i in range(120)) + "<article><p>story</p></article></body>" for n in range(12)]
    whole = wrapper_of(pages)
    assert len(whole.nodes) <= html_extract.MOST_NODES and "article" in [x.key for x in whole.nodes]


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}/x", PAGE, 1) for i in range(20)] + [(30, None, None, 1), (31, "", "", 1), (None, "http://h1/", "<p>x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = html_extract.main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[3].startswith("Head & more") and by[30] == "" and by[31] == "" and by[None] == "x"
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, common.materialise(stage(spark, at, SF), name)
        if name != "packing":
            assert at.columns == columns
            counts.append(at.count())
            assert at.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert counts[0] >= counts[1] > counts[2] > counts[3] > counts[4]
    assert at.select("doc_id").distinct().count() == counts[-1]


@pytest.mark.parametrize("name", ["op6_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(found.fetchall()) == sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect())
