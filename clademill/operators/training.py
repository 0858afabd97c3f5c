"""Training inputs of the classifier from labelled sites, alignments and trees.

A gene's distances stay in a table of their own, one row a gene; ``with_distances`` joins them to the rows that are to be trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clademill.functions import codon as C
from clademill.operators import sites, tour, tree
from clademill.plans.storage import written
from clademill.sources import nexus


def read_training(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sequences and tree nodes of training alignments, whose names are the genes'. A tree that can't be parsed counts as none, and
    an alignment without a sequence counts as missing."""
    sequences = written(nexus.read_alignments(spark, path, training=True), "alignments")
    trees = sequences.groupBy(F.col("aln_id").alias("tree_id")).agg(F.first("tree").alias("newick"))
    nodes = nexus.parse_trees(trees).where(F.col("node_id").isNotNull()).drop("error")
    return sequences.drop("tree"), written(tour.toured(nodes, preorder=True), "nodes")


def training_species(sequences: DataFrame, nodes: DataFrame | None = None, most: int = 100) -> DataFrame:
    """``aln_id, species_idx, label, node_id``: the first ``most`` leaves of a gene's tree, or without one its first sequences."""
    place = lambda x: (F.row_number().over(Window.partitionBy("aln_id").orderBy(x)) - 1).alias("species_idx")
    every = sequences
    if nodes is not None:
        leaf = tree.leaves(nodes).withColumnRenamed("tree_id", "aln_id")
        every = sequences.join(leaf.select("aln_id").distinct(), "aln_id", "left_anti")
        leaf = leaf.select("aln_id", place("leaf_idx"), F.col("name").alias("label"), F.col("node_id").cast("long").alias("node_id"))
    out = every.select("aln_id", place("seq_idx"), "label", F.lit(None).cast("long").alias("node_id"))
    return (out if nodes is None else out.unionByName(leaf)).where(F.col("species_idx") < most)


def training_tokens(labels: DataFrame, sequences: DataFrame, species: DataFrame, window: int = 5, most: int = 100) -> DataFrame:
    """``labels`` (``gene_name, site_index`` and any others) with ``tokens``: flat, species times window, centred on the site.

    Positions outside a sequence, species without one and padding are unknown codons; a gene without an alignment has zeros (which
    stand for TTT). A gene's tokens shuffle as one row, which meets the gene's sites in the join and goes no further; sites of a hot gene
    aren't gathered, so that the join can split them.
    """
    count = C.codon_count(F.coalesce(F.col("seq"), F.lit("")))
    toks = F.transform(F.slice(sites.codon_array(F.col("seq")), F.lit(1), count), C.codon_token)
    known = sequences.select("aln_id", "label", toks.alias("toks"))
    rows = species.select("aln_id", "species_idx", "label").join(known, ["aln_id", "label"], "left")
    genes = rows.groupBy(F.col("aln_id").alias("gene_name")).agg(F.sort_array(F.collect_list(F.struct("species_idx", "toks"))).alias("species"))

    def at(site: Column) -> Column:
        offsets = F.sequence(F.lit(-(window // 2)), F.lit(window - 1 - window // 2))
        # `get` is null below 0, beyond the end and in an array that is null
        cells = F.flatten(F.transform("species", lambda s: F.transform(offsets, lambda w: F.coalesce(F.get(s.toks, site - 1 + w), F.lit(C.UNKNOWN_CODON)))))
        padded = F.concat(cells, F.array_repeat(F.lit(C.UNKNOWN_CODON), most * window - F.size(cells)))
        return F.when(F.col("species").isNull(), F.array_repeat(F.lit(0), most * window)).otherwise(padded)

    return labels.join(genes, "gene_name", "left").select(*labels.columns, at(F.col("site_index")).alias("tokens"))


def training_distances(species: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """``gene_name, dists``: each gene's flat distance matrix, zeros for padding and without a tree. ``nodes`` are toured."""
    leaf = species.where(F.col("node_id").isNotNull()).select(F.col("aln_id").alias("tree_id"), F.col("species_idx").alias("leaf_idx"), F.col("species_idx").cast("string").alias("name"), "node_id")
    full = tree.patristic_matrix(tree.patristic_pairs(nodes.withColumn("node_id", F.col("node_id").cast("long")), leaf), leaf).select("tree_id", F.col("a").cast("int").alias("i"), F.col("b").cast("int").alias("j"), F.col("dist").cast("float").alias("dist"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("j", "dist"))), lambda x: x.dist)
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    lines = full.groupBy("tree_id", "i").agg(line.alias("line")).withColumn("line", F.concat("line", zeros(F.lit(most) - F.size("line"))))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x.line))
    found = lines.groupBy(F.col("tree_id").alias("gene_name")).agg(flat.alias("flat"))
    found = found.select("gene_name", F.concat("flat", zeros(F.lit(most * most) - F.size("flat"))).alias("dists"))
    bare = species.where(F.col("node_id").isNull()).select(F.col("aln_id").alias("gene_name")).distinct()
    return found.unionByName(bare.select("gene_name", zeros(F.lit(most * most)).alias("dists")))


def with_distances(rows: DataFrame, distances: DataFrame, most: int = 100) -> DataFrame:
    """Rows for ``model.train_classifier``; a gene without distances has zeros. Forty kilobytes a row, so join what is trained on only."""
    none = F.array_repeat(F.lit(0.0).cast("float"), most * most)
    return rows.join(distances, "gene_name", "left").withColumn("dists", F.coalesce("dists", none))
