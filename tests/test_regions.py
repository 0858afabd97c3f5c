import random

import pytest
from pyspark.sql import functions as F

from clademill.functions import codon as C
from clademill.functions import sql
from clademill.operators import calls, regions


def test_sites_in_regions(spark):
    rng = random.Random(2)
    sites = [("ab"[rng.randrange(2)], rng.randrange(2000)) for _ in range(400)] + [("a", 10**12), ("b", 0), (None, 5), ("a", None)]
    made = []
    for n in range(120):
        start = rng.randrange(2000)
        made.append(("ab"[n % 2], n, start, start + rng.choice([0, 1, 5, 40, 900, 10**6, 10**13])))
    made += [("a", 200, 50, 40), ("a", 201, None, 9), (None, 202, 0, 10), ("a", 203, -70, 3)]
    table = spark.createDataFrame(sites, "aln_id string, codon_site long")
    areas = spark.createDataFrame(made, "aln_id string, region int, start long, end long")
    got = sorted((r.aln_id, r.codon_site, r.region) for r in regions.in_regions(table, areas).collect())
    want = sorted((a, s, n) for a, s in sites for b, n, lo, hi in made if None not in (a, s, lo, hi) and a == b and lo <= s <= hi)
    assert got == want and len(want) > 1000
    assert regions.in_regions(table, areas.limit(0)).count() == 0 and regions.in_regions(table.limit(0), areas).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_runs_over_range_edges(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.randrange(600)) for k in ("a", "b", None) for _ in range(150)] + [("a", i) for i in range(900, 1400)] + [("a", None)]
    got = sorted((str(r.aln_id), r.first, r["last"], r.n) for r in regions.runs(spark.createDataFrame(rows, "aln_id string, codon_site long"), 3, parts=parts).collect())
    want = []
    for k in ("a", "b", None):
        at = sorted(s for x, s in rows if x == k and s is not None)
        groups = [[at[0]]]
        for s in at[1:]:
            if s - groups[-1][-1] > 3:
                groups.append([])
            groups[-1].append(s)
        want += [(str(k), g[0], g[-1], len(g)) for g in groups]
    assert got == sorted(want)


def test_runs_of_nothing(spark):
    assert regions.runs(spark.createDataFrame([], "aln_id string, codon_site long"), 3).count() == 0


def test_functions_in_sql_are_those_of_columns(spark):
    sql.register(spark)
    codons = [a + b + c for a in "TCAGN-" for b in "TCAGa?" for c in "TCAGR-"] + ["", "AT", "ATGA", "atg", "---", None]
    table = spark.createDataFrame([(c,) for c in codons], "codon string")
    table.createOrReplaceTempView("some_codons")
    told = spark.sql("SELECT codon, codon_token(codon) AS a, translate_codon(codon) AS b, aa_token(codon) AS c, is_valid_codon(codon) AS d, codon_count(codon) AS e, codon_at(codon, 1) AS f FROM some_codons")
    c = F.col("codon")
    want = table.select(c, C.codon_token(c), C.translate_codon(c), C.aa_token(c), C.is_valid_codon(c), C.codon_count(c), C.codon_at(c, F.lit(1)))
    assert sorted(map(repr, map(tuple, told.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "Python" not in told._jdf.queryExecution().toString()
    names = spark.sql("SELECT normal_name(\" 'a\\\"b' \") AS n, round(distance_weight(0.95D), 9) AS w").first()
    assert names.n == "ab" and names.w == pytest.approx(0.693147181)
    nodes = spark.sql("SELECT t, name, depth, root_dist FROM VALUES ('x', '((A:1,B:2):0.5,C);'), ('y', NULL), ('z', '((A'), ('w', ' ;') AS v(t, newick), LATERAL newick_nodes(newick) WHERE is_leaf")
    assert sorted(tuple(r) for r in nodes.collect()) == [("x", "A", 2, 1.5), ("x", "B", 2, 2.5), ("x", "C", 1, 0.0)]


def test_levels_and_sketches(spark):
    sites = spark.range(4000).select((F.col("id") % 3).cast("string").alias("aln_id"), F.col("id").alias("codon_site"), F.lit(1).alias("is_variable"), (F.col("id") / 1000.0).alias("score"))
    found = calls.call_sites(sites)
    levels = {(r.level, r.aln_id, r.selection_call): r.n for r in calls.summarise_levels(found).collect()}
    assert levels[3, None, None] == 4000 and levels[1, "0", None] == 1334 and sum(n for (level, *_), n in levels.items() if level == 0) == 4000
    parts = [calls.lrt_sketches(found.where(F.col("codon_site") % 4 == i)) for i in range(4)]
    told = calls.sketch_quantiles(calls.merged_sketches(parts[0].union(parts[1]).union(parts[2]).union(parts[3])), 0.1, 0.5, 0.9).first()
    values = sorted(r[0] for r in found.select("predicted_lrt").collect())
    assert told.n == 4000 and all(values[int(4000 * s) - 60] <= v <= values[int(4000 * s) + 60] for s, v in zip((0.1, 0.5, 0.9), told["values"], strict=True))
    assert calls.sketch_quantiles(calls.lrt_sketches(found.withColumn("is_variable", F.lit(0))), 0.5).first()["values"] is None
