"""``python -m clademill ALIGNMENTS``: scans alignments and writes predictions, with a summary on the console."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace
from pickle import UnpicklingError
from zipfile import BadZipFile

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from clademill.operators.calls import Tiers, called_sites, summarise
from clademill.operators.model import REGRESSOR, load_weights
from clademill.plans.pipeline import ScanOptions, scan
from clademill.sources.checkpoint import import_weights
from clademill.sources.nexus import default_output, write_predictions


def options(argv: list[str]) -> argparse.Namespace:
    usual, tiers = ScanOptions(), Tiers()
    p = argparse.ArgumentParser(prog="clademill", description=__doc__)
    p.add_argument("alignments", help="a file, folder or glob of alignments; .gz files are decompressed")
    p.add_argument("--tree", help="tree files named like the alignments")
    p.add_argument("--weights", required=True, help="model weights: an .npz file or a published .pt checkpoint")
    p.add_argument("--window-size", type=int, default=usual.model.window, help="codons around a site, as the weights were trained with")
    p.add_argument("--reference", help="label of the reference sequence")
    p.add_argument("--output", help="CSV folder for predictions")
    p.add_argument("--max-species", type=int, default=usual.most_species)
    p.add_argument("--estimate-lengths", action="store_true", help="estimate branch lengths of trees that have none, and write these trees beside the predictions")
    p.add_argument("--branches", help="Parquet folder for the branches on which a variable site's amino acid changes")
    p.add_argument("--use-zscore", action="store_true", help="call by z-score in place of percentile")
    for name in ("percentile_1", "percentile_2", "z_1", "z_2", "gate_1", "gate_2"):
        p.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(tiers, name))
    return p.parse_args(argv)


def main(argv: list[str]) -> int:
    a = options(argv)
    if not os.path.exists(a.weights):
        print(f"no weights at {a.weights}", file=sys.stderr)
        return 1
    model = replace(REGRESSOR, window=a.window_size)
    try:
        weights = (import_weights if a.weights.endswith((".pt", ".pth")) else load_weights)(a.weights, model)
    except (ValueError, BadZipFile, UnpicklingError) as why:
        print(why, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("clademill").getOrCreate()
    tiers = Tiers(a.percentile_1, a.percentile_2, a.z_1, a.z_2, a.use_zscore, a.gate_1, a.gate_2)
    out = a.output or default_output(a.alignments)
    trees_out = f"{out.removesuffix('.csv')}_estimated_trees" if a.estimate_lengths else None
    try:
        found = scan(spark, a.alignments, weights, a.tree, ScanOptions(a.reference, a.max_species, a.estimate_lengths, trees_out, a.branches, True, tiers, model))
        write_predictions(found, out)
    except (AnalysisException, ValueError) as why:  # a path that isn't there, a reference that isn't in an alignment
        print(why, file=sys.stderr)
        return 1
    written = spark.read.csv(out, header=True, schema=found.schema)
    summarise(written).show(truncate=False)
    called_sites(written).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
