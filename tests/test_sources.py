import gzip

import pytest
from pyspark.sql import functions as F

from clademill.sources import nexus
from clademill.sources.newick import parse_newick, to_newick

NEXUS = """#NEXUS
BEGIN TAXA;
 DIMENSIONS NTAX=4;
 TAXLABELS 'hg38' B C D;
END;
BEGIN CHARACTERS;
 FORMAT DATATYPE=DNA;
 MATRIX
 hg38 ATGTCATAAAAA
 B    ATGAGCTGG---
 C    ATGTCATAANNN
 D    ATGAGCTAAAAR
 ;
END;
BEGIN TREES;
 TREE t = [&R] ((hg38:1,B:2):0.5,(C:3,D:4):1.5);
END;
"""


def test_nexus():
    one = nexus.parse_nexus(NEXUS)
    assert one.labels == ["hg38", "B", "C", "D"]
    assert dict(one.rows)["B"] == "ATGAGCTGG---" and len(one.rows) == 4
    assert one.tree == "((hg38:1,B:2):0.5,(C:3,D:4):1.5);"


def test_nexus_variants():
    last = nexus.parse_nexus(NEXUS.replace(" D    ATGAGCTAAAAR\n ;", " D    ATGAGCTAAAAR;").lower().replace("atg", "ATG"))
    assert len(last.rows) == 4
    twice = nexus.parse_nexus(NEXUS.replace(" ;\nEND;\nBEGIN TREES", " hg38 GGG\n B CCC\n C AAA\n D TTT\n ;\nEND;\nBEGIN TREES"))
    assert dict(twice.sequences())["hg38"] == "GGG" and [x for x, _ in twice.sequences()] == ["hg38", "B", "C", "D"]
    assert nexus.parse_nexus(NEXUS.replace("END;\n", "END;\n", 1).replace(" TREE t", " TREE u = (x,y);\n TREE t")).tree.startswith("((hg38")
    bare = nexus.parse_nexus("BEGIN TAXA;\nTAXLABELS a\nb;\nEND;\nMATRIX\nAC GT\nTTTT;\n", training=True)
    assert bare.rows == [("a", "ACGT"), ("b", "TTTT")]
    assert nexus.parse_nexus("no alignment").rows == []
    tabs = nexus.parse_nexus("TAXLABELS A B;\nMATRIX\nB\tACG TAC\nA\t GGG CCC\n;\nBEGIN TREE;\nTREE x = (A,B);\nEND;")
    assert tabs.rows == [("B", "ACGTAC"), ("A", "GGGCCC")] and tabs.tree == "(A,B);"
    placed = nexus.parse_nexus("TAXLABELS a b;\nMATRIX\nACG\nTTT ;\n")
    assert placed.rows == [("a", "ACG"), ("b", "TTT")]


def test_other_formats():
    assert nexus.parse_alignment(">a x\nAC\nGT\n>b\nTTTT\n").rows == [("a", "ACGT"), ("b", "TTTT")]
    assert nexus.parse_alignment("2 4\na ACGT\nb TT TT\n").rows == [("a", "ACGT"), ("b", "TTTT")]
    assert nexus.find_tree(NEXUS) == "((hg38:1,B:2):0.5,(C:3,D:4):1.5)" and nexus.find_tree("x (a,b); y") == "(a,b)" and nexus.find_tree("none") is None


def test_newick():
    nodes = parse_newick("((A:1,B:2):0.5,(C:3,D:4)x y:1.5)root:9;")
    leaf = {n.name: n for n in nodes if n.is_leaf}
    assert list(leaf) == ["A", "B", "C", "D"] and leaf["D"].root_dist == 5.5 and leaf["A"].depth == 2 and nodes[0].root_dist == 0
    assert parse_newick(to_newick(nodes)) == nodes
    deep = "(" * 3000 + "a" + ",b)" * 3000 + ";"
    assert max(n.depth for n in parse_newick(deep)) == 3000
    for bad in ("((a,b);", "(a,b));", "(a:x,b);"):
        with pytest.raises(ValueError):
            parse_newick(bad)


def test_read(spark, tmp_path):
    (tmp_path / "g1.nex").write_text(NEXUS)
    with gzip.open(tmp_path / "g2.nex.gz", "wt") as f:
        f.write(NEXUS.replace("hg38", "human"))
    rows = nexus.read_alignments(spark, str(tmp_path)).collect()
    assert sorted({r.aln_id for r in rows}) == ["g1", "g2"] and len(rows) == 8
    trees = nexus.parse_trees(spark.createDataFrame([("t", "(a:1,b:2);"), ("bad", "((a"), ("none", None)], "tree_id string, newick string"))
    got = {(r.tree_id, r.name, r.error is not None) for r in trees.collect()}
    assert ("t", "b", False) in got and ("bad", None, True) in got and ("none", None, True) in got
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.nex").write_text("nothing")
    with pytest.raises(Exception, match="no sequence"):
        nexus.read_alignments(spark, str(tmp_path / "empty")).collect()
    assert nexus.read_alignments(spark, str(tmp_path / "empty"), training=True).count() == 0


def test_labels_and_sinks(spark, tmp_path):
    labels = spark.createDataFrame([("g", 1, 1), ("g", 2, None)], "gene_name string, site_index int, is_significant int")
    labels.write.parquet(str(tmp_path / "l.parquet"))
    assert nexus.read_site_labels(spark, str(tmp_path / "l.parquet")).count() == 1
    nexus.write_predictions(labels, str(tmp_path / "out"), one_file=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert nexus.default_output("a/x.nex.gz") == "a/x_regression_predictions.csv"
    nexus.write_trees(spark.createDataFrame([("(a,b);",)], "newick string"), str(tmp_path / "trees"))
    assert spark.read.text(str(tmp_path / "trees")).first()[0] == "(a,b);"
    assert spark.read.text(str(tmp_path / "trees")).select(F.lit(1)).count() == 1


def test_labels_by_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path / 'db'};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    labels = spark.createDataFrame([("g", 1, 1, "x"), ("g", 2, None, "y"), ("h", 3, 0, "z")], "gene_name string, site_index int, is_significant int, other string")
    named = labels.toDF(*(c.upper() for c in labels.columns))
    named.write.option("driver", driver).option("createTableColumnTypes", "GENE_NAME VARCHAR(64), OTHER VARCHAR(64)").jdbc(url, "site_results")
    found = nexus.read_site_labels(spark, url, "site_results", driver)
    assert sorted(tuple(r) for r in found.collect()) == [("g", 1, 1), ("h", 3, 0)]
    parted = nexus.read_site_labels(spark, url, "site_results", driver, ["g", "h"])
    assert sorted(tuple(r) for r in parted.collect()) == [("g", 1, 1), ("h", 3, 0)] and parted.rdd.getNumPartitions() == 4
    assert "PushedFilters: [*IsNotNull(IS_SIGNIFICANT)]" in parted._jdf.queryExecution().toString()


def test_alignments_in_lines(spark):
    """What whole texts give, from lines: quotes, comments, labels over lines, rows by place, repeated and missing labels, ends of all kinds."""
    texts = {
        "plain": NEXUS,
        "lower": NEXUS.replace(" D    ATGAGCTAAAAR\n ;", " D    ATGAGCTAAAAR;").lower(),
        "twice": NEXUS.replace(" ;\nEND;\nBEGIN TREES", " hg38 GGG\n B CCC\n C AAA\n D TTT\n ;\nEND;\nBEGIN TREES"),
        "placed": "TAXLABELS a b;\nMATRIX\nACG\nTTT ;\n",
        "tabs": "TAXLABELS A B;\nMATRIX\nB\tACG TAC\nA\t GGG CCC\n;\nBEGIN TREE;\nTREE x = (A,B);\nEND;",
        "quoted": "#NEXUS\nTAXLABELS 'a' \"b\"\n c [x] ;\n[y]\nMATRIX [z]\n'a' A[1]CG T\n\n\"b\" GG\nx CC\nd TT\n",
        "open": "TAXLABELS a b\nMATRIX\n;\nMATRIX\na AA\nMATRIX CC\n;;\n",
    }
    rows = [(k, i, line) for k, x in texts.items() for i, line in enumerate(x.splitlines())]
    got = nexus.parse_alignment_lines(spark.createDataFrame(rows, "aln_id string, at long, line string").repartition(3))
    want = {(k, i, *x) for k, text in texts.items() for i, x in enumerate(nexus.parse_alignment(text).sequences())}
    assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(ValueError):
        nexus.parse_alignment_lines(spark.createDataFrame([("none", 0, "no alignment")], "aln_id string, at long, line string"))
