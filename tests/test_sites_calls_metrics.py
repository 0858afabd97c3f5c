import numpy as np
import pytest
from pyspark.sql import functions as F

from clademill.operators import calls, metrics, sites

ROWS = [("hg38", "ATGTCATAAAAA"), ("B", "ATGAGCTGG---"), ("C", "ATGTCATAANNN"), ("D", "ATGAGCTAAAAR")]


def alignment(spark):
    return spark.createDataFrame([("t", i, label, seq) for i, (label, seq) in enumerate(ROWS)], "aln_id string, seq_idx int, label string, seq string")


def test_profile(spark):
    codons = sites.explode_sites(alignment(spark))
    assert codons.count() == 16
    got = {r.site: r for r in sites.site_profile(codons, "aln_id", "site").collect()}
    assert [got[i].is_variable for i in (1, 2, 3, 4)] == [0, 1, 1, 0]
    assert got[2].codon_entropy == 1.0 and got[2].aa_entropy == 0.0 and got[4].n_codons == 2 and got[4].n_aas == 1
    assert got[3].aa_entropy == pytest.approx(0.811278, abs=1e-6)


def test_explode_edges(spark):
    odd = spark.createDataFrame([("t", ""), ("t", None), ("t", "AT"), ("t", "ATGA")], "aln_id string, seq string")
    assert [r.codon for r in sites.explode_sites(odd).collect()] == ["ATG"]
    longer = odd.withColumn("total", F.lit(2))
    assert sorted(r.codon for r in sites.explode_sites(longer, "total").collect()) == ["", "", "", "", "", "A", "AT", "ATG"]


def test_windows(spark):
    one = spark.createDataFrame([("ATGTCATAA",)], "seq string")
    got = {}
    for r in sites.windows(one, 5).collect():
        got.setdefault(r.site, {})[r.w_idx] = r.codon_tok
    assert [got[1][i] for i in range(5)] == [65, 65, 35, 6, 10] and [got[3][i] for i in range(5)] == [35, 6, 10, 65, 65]
    even = {(r.site, r.w_idx): r.codon_tok for r in sites.windows(one, 4).collect()}
    assert [even[3, i] for i in range(4)] == [35, 6, 10, 65] and even[1, 2] == 35


def test_percentiles_and_z(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 3.0)] + [("b", 2.0)] * 3, "g string, x double")
    scaled = calls.with_z_score(calls.with_percentile(rows, "x", "g"), "x", "g")
    found = scaled.select("g", "x", "percentile", F.round("z", 4)).collect()
    got = sorted((g, x, round(p, 9), z) for g, x, p, z in found)
    assert got == [("a", 1.0, 25.0, -1.4142), ("a", 2.0, 62.5, 0.0), ("a", 2.0, 62.5, 0.0), ("a", 3.0, 100.0, 1.4142)] + [("b", 2.0, round(200 / 3, 9), 0.0)] * 3


@pytest.mark.parametrize(
    "percentile, z, lrt, tiers, call",
    [
        (50.0, 0.0, 5.0, calls.Tiers(), calls.TIER_1),
        (97.5, 0.0, 1.0, calls.Tiers(), calls.TIER_2),
        (50.0, 0.0, 3.0, calls.Tiers(), calls.TIER_2),
        (50.0, 0.0, 3.0, calls.Tiers(gate_2=-1), calls.NEUTRAL),
        (99.0, 2.1, 0.0, calls.Tiers(use_z=True), calls.TIER_2),
    ],
)
def test_tiers(spark, percentile, z, lrt, tiers, call):
    column = lambda ok: calls.tier_call(F.lit(ok), F.lit(percentile), F.lit(z), F.lit(lrt), tiers)
    assert tuple(spark.range(1).select(column(True), column(False)).first()) == (call, calls.NEUTRAL)


def test_calls(spark):
    flat = spark.createDataFrame([("t", i, 0, 3.0) for i in range(5)], "aln_id string, codon_site int, is_variable int, score double")
    out = calls.call_sites(flat).collect()
    assert all((r.predicted_log_lrt, r.predicted_lrt, r.local_z_score, r.local_percentile, r.selection_call) == (0, 0, 0, 0, calls.NEUTRAL) for r in out)
    some = calls.call_sites(spark.createDataFrame([("t", i, 1, i / 50) for i in range(100)], "aln_id string, codon_site int, is_variable int, score double"))
    total = calls.summarise(some).first()
    assert (total.n_sites, total.n_tier_1 + total.n_tier_2) == (100, calls.called_sites(some).count())
    top = calls.called_sites(some).first()
    assert top.codon_site == 99 and top.local_percentile == 100.0


def test_ranking_metrics(spark):
    table = lambda s, y: spark.createDataFrame(list(zip(s, y, strict=True)), "score double, label int")
    scored = table([0.9, 0.8, 0.7, 0.7, 0.1], [1, 0, 1, 0, 0])
    assert metrics.roc_auc(scored).first()[0] == pytest.approx(0.75) and metrics.average_precision(scored).first()[0] == pytest.approx(0.75)
    alone = table([0.9, 0.1], [1, 1])
    assert metrics.roc_auc(alone).first()[0] == 0.5 and metrics.average_precision(alone).first()[0] == 0.0
    assert metrics.roc_auc(scored.limit(0)).first()[0] == 0.5
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 40, 500) / 40, rng.integers(0, 2, 500)
    wins = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    many = table(s.tolist(), y.tolist())
    assert metrics.roc_auc(many).first()[0] == pytest.approx(wins)
    precision = sum(y[s == v].sum() * y[s >= v].mean() for v in set(s.tolist())) / y.sum()
    assert metrics.average_precision(many).first()[0] == pytest.approx(precision)


def test_balance_splits_and_batches(spark):
    labels = lambda *y: spark.createDataFrame([(x,) for x in y], "label int")
    assert metrics.class_balance(labels(1, 0, 0, 0)).first().pos_weight == 3.0 and metrics.class_balance(labels(0, 0)).first().pos_weight == 2.0
    rows = spark.range(200).withColumn("gene", F.col("id") % 10)
    split = metrics.grouped_split(rows, "gene")
    assert split.select("gene", "split").distinct().count() == 10 and split.where("split = 'train'").select("gene").distinct().count() == 8
    assert metrics.subsample(rows, "id", 30).count() == 30 and metrics.subsample(rows, "id", 900).count() == 200
    dealt = metrics.batches(rows, "id", 32)
    assert dealt.count() == 192 and {r["count"] for r in dealt.groupBy("batch").count().collect()} == {32}
    assert metrics.batches(rows, "id", 500).count() == 200
    epochs = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "epoch int, pr_auc double")
    assert metrics.best_epoch(epochs(0.2, 0.5, 0.5)).first().best_epoch == 2 and metrics.best_epoch(epochs(0.0, 0.0)).count() == 0


def test_padding_and_missing(spark):
    tokens = spark.createDataFrame([([1, 2],)], "t array<int>")
    assert sites.pad_tokens(tokens, "t", 4, 65).first().t == [1, 2, 65, 65]
    labels = spark.createDataFrame([("g", 1, 1), ("x", 1, 0)], "gene_name string, site_index int, label int")
    features = spark.createDataFrame([("g", 1, [5, 5])], "gene_name string, site_index int, tokens array<int>")
    got = {r.gene_name: r.tokens for r in sites.label_sites(labels, features, 2).collect()}
    assert got == {"g": [5, 5], "x": [0, 0]}
    assert sites.first_species(alignment(spark), 2).count() == 2


def test_percentiles_against_windows(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 > 0, F.xxhash64("id") % 40).alias("x"))
    by = Window.partitionBy("g")
    rank = (F.rank().over(by.orderBy("x")) + (F.count("*").over(Window.partitionBy("g", "x")) - 1) / 2) / F.count("*").over(by) * 100
    want = rows.withColumn("p", rank).withColumn("z", F.coalesce((F.col("x") - F.avg("x").over(by)) / F.stddev_pop("x").over(by), F.lit(0.0)))
    clean = lambda table, p: sorted((r.id, round(r[p], 9), round(r.z, 9)) for r in table.collect())
    assert clean(calls.with_z_score(calls.with_percentile(rows, "x", "g"), "x", "g"), "percentile") == clean(want, "p")
    assert calls.with_percentile(rows.limit(0), "x", "g").count() == 0


def test_subsample_by_selection(spark):
    import hashlib

    rows = spark.range(5000).withColumn("x", F.col("id") * 2)
    order = sorted(range(5000), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    for limit in (0, 1, 700, 4999, 5000, 9000):
        found = metrics.subsample(rows, "id", limit)
        assert found.columns == ["id", "x"] and sorted(r.id for r in found.collect()) == sorted(order[:limit])
    plan = metrics.subsample(rows, "id", 700)._jdf.queryExecution().toString()
    assert "GlobalLimit" not in plan and "TakeOrdered" not in plan


def test_residues_are_counted_without_a_row_a_codon(spark, monkeypatch):
    """Against rows of codons, with tables that are handed on early, odd characters and short sequences."""
    from clademill.functions import codon as C

    monkeypatch.setattr(sites, "MOST_CELLS", 50)
    seqs = ["ATGTCATAA", "atgAGCTGGAC", "é☃GTTTTCN-", "", None, "AC", "---TTTTTTGGG", "TTT" * 9, "😀TTTTT", "UUUTTT"]
    table = spark.createDataFrame([("ab"[i % 2], x) for i, x in enumerate(seqs * 3)], "aln_id string, seq string")
    rows = sites.explode_sites(table).select("aln_id", "site", C.translate_codon(F.col("codon")).alias("aa")).where("aa NOT IN ('?', '*')")
    want = {(r.aln_id, r.site, r.aa): r["count"] for r in rows.groupBy("aln_id", "site", "aa").count().collect()}
    counts = sites.residue_counts(table)
    assert {(r.aln_id, r.site, x): r[f"n_{x}"] for r in counts.collect() for x in sites.RESIDUES if r[f"n_{x}"]} == want
    pairs = {}
    for (aln, site, a), n in want.items():
        for b in (x for x in sites.RESIDUES if x >= a):
            pairs[aln, a, b] = pairs.get((aln, a, b), 0) + n * want.get((aln, site, b), 0)
    assert {(r.aln_id, r.aa1, r.aa2): r.pairs for r in sites.residue_pairs(counts).collect()} == {k: n for k, n in pairs.items() if n}
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
