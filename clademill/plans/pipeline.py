"""The scan: alignments and trees in, calls per codon site out, many alignments in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions import codon as C
from clademill.operators import calls, levels, sites, tour, tree
from clademill.operators.model import REGRESSOR, ModelSpec, Weights, score_sites
from clademill.plans.storage import written
from clademill.sources import nexus


@dataclass(frozen=True)
class ScanOptions:
    reference: str | None = None
    most_species: int = 256
    estimate_lengths: bool = False
    #: Where trees with estimated lengths are written, one a line.
    trees_out: str | None = None
    #: Where the branches on which a variable site's amino acid changes are written, as Parquet.
    branches_out: str | None = None
    pad: bool = True
    tiers: calls.Tiers = field(default_factory=calls.Tiers)
    model: ModelSpec = REGRESSOR


def scan(spark: SparkSession, path: str, weights: Weights, tree_path: str | None = None, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``aln_id`` and the nine prediction columns for every codon site of every alignment under ``path``.

    Trees come from ``tree_path`` (files named like the alignments) or from inside the alignments; without one all distances are 0. Scores mean nothing
    without trained ``weights``; seeded ones have to be asked for (``model.seeded_weights``).
    """
    sequences = written(nexus.read_alignments(spark, path), "alignments")
    if tree_path:
        trees = nexus.read_trees(spark, tree_path).select(F.regexp_replace("tree_id", r"\.[^.]*$", "").alias("tree_id"), "newick")
    else:
        trees = sequences.groupBy(F.col("aln_id").alias("tree_id")).agg(F.first("tree").alias("newick"))
    return _scan(sequences.drop("tree"), _node_table(nexus.parse_trees(trees)), weights, options)


def _node_table(nodes: DataFrame) -> DataFrame:
    """Parsed nodes, written, as all that follows reads them many times and would parse every text anew each time."""
    return written(tour.toured(nodes.where(F.col("node_id").isNotNull()).drop("error"), preorder=True), "nodes")


def scan_frames(sequences: DataFrame, nodes: DataFrame, weights: Weights, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``scan`` on tables: ``aln_id, seq_idx, label, seq`` and node rows."""
    return _scan(written(sequences, "sequences"), _node_table(nodes), weights, options)


def _scan(sequences: DataFrame, nodes: DataFrame, weights: Weights, options: ScanOptions) -> DataFrame:
    leaf_rows = tree.leaves(nodes)
    reference = tree.choose_reference(sequences, options.reference)
    matched = tree.match_species(leaf_rows, sequences)
    chosen = tree.select_species(nodes, matched, reference, options.most_species).drop("gain")
    spaced = tree.evenly_spaced(tree.matched_or_all(sequences, matched).where(~F.col("has_tree")), reference, options.most_species)
    spaced = spaced.join(chosen.select("aln_id").distinct(), "aln_id", "left_anti")
    selected = chosen.unionByName(spaced)
    selected = written(selected, "species")  # an executor that is lost takes none of it along
    if options.estimate_lengths:
        lengths = written(tree.estimate_lengths(nodes, sequences).withColumnRenamed("branch_length", "__length"), "lengths")
        nodes = nodes.join(lengths, ["tree_id", "node_id"], "left").withColumn("branch_length", F.coalesce("branch_length", F.nanvl("__length", F.lit(None)))).drop("__length", "depth", "root_dist", "pos")
        if options.trees_out:
            estimated = nodes.join(lengths.select("tree_id").distinct(), "tree_id", "left_semi")
            nexus.write_trees(nexus.tree_texts(estimated), options.trees_out)
        nodes = written(tour.toured(nodes, preorder=True), "tour")
        leaf_rows = tree.leaves(nodes)
    names = selected.select(F.col("aln_id").alias("tree_id"), C.normal_name(F.col("label")).alias("__key"))
    wanted = leaf_rows.withColumn("__key", C.normal_name(F.col("name"))).join(names, ["tree_id", "__key"], "left_semi").drop("__key")
    distances = tree.selected_distances(selected, tree.patristic_matrix(tree.patristic_pairs(nodes, wanted), wanted))
    coords = tree.mds(distances, pad_to=options.most_species if options.pad else None)
    flat = distances.groupBy("aln_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "dist"))), lambda x: x.dist).alias("dists"))
    flat = flat.join(coords.groupBy("aln_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("species_idx", "coords"))), lambda x: x.coords)).alias("coords"), F.count("*").cast("int").alias("n_species")), "aln_id")
    totals = sites.reference_totals(sequences, reference)
    rows = selected.join(sequences, ["aln_id", "label"], "left").join(totals.select("aln_id", "total"), "aln_id")
    rows = rows.select("aln_id", "species_idx", "total", F.coalesce("seq", F.lit("")).alias("seq"))
    codons = sites.explode_sites(rows, "total").select("aln_id", "site", "species_idx", "codon")
    profile = sites.site_profile(codons, "aln_id", "site").select("aln_id", "site", "is_variable")
    tokens = sites.windows(rows, options.model.window, "total")
    variable = profile.where("is_variable = 1").select("aln_id", "site")
    if options.branches_out:
        variable = written(variable, "variable")
        levels.changed_branches(nodes, sequences, variable).write.mode("overwrite").parquet(options.branches_out)
    ordered = F.sort_array(F.collect_list(F.struct("species_idx", "w_idx", "codon_tok", "aa_tok")))
    arrays = tokens.join(variable, ["aln_id", "site"], "left_semi").groupBy("aln_id", "site").agg(ordered.alias("x"))
    arrays = arrays.select("aln_id", "site", F.transform("x", lambda x: x.codon_tok).alias("codon_toks"), F.transform("x", lambda x: x.aa_tok).alias("aa_toks"))
    scores = score_sites(arrays, flat, weights, options.model, options.pad)
    every = sites.reference_sites(totals).join(profile.withColumnRenamed("site", "codon_site"), ["aln_id", "codon_site"], "left")
    every = every.join(scores.withColumnRenamed("site", "codon_site"), ["aln_id", "codon_site"], "left")
    every = every.select("aln_id", "codon_site", "ref_codon", "ref_aa", F.coalesce("is_variable", F.lit(0)).alias("is_variable"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return calls.call_sites(every, "aln_id", options.tiers)
