import math

import pytest
from pyspark.sql import functions as F

from clademill.functions import codon as C
from clademill.functions.matrices import RESIDUES, grantham, parse_matrix, scoring_matrix


def values(spark, items, expression):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_codon_tokens(spark):
    assert values(spark, ["TTT", "ATG", "TAA", "TCA", "AGC", "GGG", "atg"], C.codon_token) == [0, 35, 10, 6, 45, 63, 35]
    assert values(spark, ["A-N", "ANA", "A?A", "ATR", "AUG", "AT", "", None], C.codon_token) == [64, 65, 65, 65, 65, 65, 65, 65]


def test_translation(spark):
    assert values(spark, ["atg", "TAA", "---", "ATR", ""], C.translate_codon) == ["M", "*", "?", "?", "?"]
    assert values(spark, ["ATG", "TCA", "TAA", "---", "NNN"], C.aa_token) == [10, 15, 20, 21, 22]
    assert values(spark, ["ATG", "A-G", "ANG", "ATR", "AT", None], C.is_valid_codon) == [True, False, False, True, False, False]


def test_names_and_newick(spark):
    assert values(spark, [" 'a b\" ", "x"], C.normal_name) == ["a b", "x"]
    assert values(spark, ["(a:1[x],b{2}:2);;", "(a,b)"], C.clean_newick) == ["(a:1,b:2);", "(a,b);"]
    assert values(spark, ["(a:1e-3,b:2.5)c:1;"], C.strip_branch_lengths) == ["(a,b)c;"]


def test_back_transform_and_weights(spark):
    rows = spark.createDataFrame([(-0.5, True), (1.0, True), (3.0, False)], "x double, v boolean")
    assert [round(r[0], 5) for r in rows.select(C.back_transform(F.col("x"), F.col("v"))).collect()] == [0.0, 1.71828, 0.0]
    lengths = spark.createDataFrame([(1.5, True), (None, True), (float("nan"), True), (9.0, False)], "b double, h boolean")
    assert [r[0] for r in lengths.select(C.branch_weight(F.col("b"), F.col("h"))).collect()] == [1.5, 0.0, 0.0, 1.0]
    assert spark.range(1).select(C.distance_weight(F.lit(0.0))).first()[0] == pytest.approx(math.log(21))
    assert [r[0] for r in spark.createDataFrame([(0.125,), (1.005,)], "x double").select(C.round_even(F.col("x"), 2)).collect()] == [0.12, 1.0]


def test_matrices(spark):
    assert (grantham("A", "R"), grantham("S", "R"), grantham("L", "I"), grantham("W", "C")) == (112, 110, 10, 190)
    assert parse_matrix("   A R\nA 4 -1\nR -1 5") == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}
    table = scoring_matrix(spark, "  A R\nA 4 -1\nR -1 5")
    assert table.count() == 400 and table.where("score IS NOT NULL").count() == 4
    whole = {(r.aa1, r.aa2): (r.score, r.grantham) for r in scoring_matrix(spark).collect()}
    assert all(whole[a, b] == whole[b, a] for a, b in whole) and all(whole[a, a][1] == 0 for a in RESIDUES)
    assert [whole[a, b][0] for a, b in ("RE", "ER", "RL", "LR", "RK", "WW")] == [-2, -2, -3, -3, 2, 11]
    assert [sum(whole[a, b][0] for b in RESIDUES) for a in "AWC"] == [-16, -32, -31]
    assert [sum(whole[a, b][1] for b in RESIDUES) for a in "ACW"] == [sum(map(int, x.split())) for x in ("112 111 126 44 91 107 60 86 94 96 106 84 95 27 35 58 148 112 64", "44 102 139 154 116 126 117 118 117 121 112 118 135 74 80 101 190 154 109", "148 101 174 181 190 130 122 184 115 103 113 110 115 40 153 177 178 37 88")]
