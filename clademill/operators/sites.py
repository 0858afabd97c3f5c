"""Codon sites of alignments: explosion into sites and windows, variability, entropy, and the reference's columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.functions import codon as C


def codon_array(seq: Column) -> Column:
    """All codons of a sequence in one pass; the last may be incomplete."""
    return F.regexp_extract_all(F.coalesce(seq, F.lit("")), F.lit("(?s).{1,3}"), F.lit(0))


def _fitted(codons: Column, count: Column) -> Column:
    """Exactly ``count`` codons, empty ones beyond the end."""
    missing = F.greatest(F.lit(0), count - F.size(codons))
    return F.slice(F.concat(codons, F.array_repeat(F.lit(""), missing)), F.lit(1), count)


def explode_sites(sequences: DataFrame, total: str | None = None) -> DataFrame:
    """One row per sequence and 1-based site: the input's columns without ``seq``, ``site`` and ``codon``.

    ``total``: a column with the number of sites (the reference's); by default each sequence's own. Sequences without a whole codon
    give no row, and sites beyond a short sequence's end have an incomplete or empty codon.
    """
    count = C.codon_count(F.coalesce(F.col("seq"), F.lit(""))) if total is None else F.col(total)
    rest = [c for c in sequences.columns if c != "seq"]
    rows = sequences.where(count > 0).select(*rest, F.posexplode(_fitted(codon_array(F.col("seq")), count)).alias("__at", "codon"))
    return rows.select(*rest, (F.col("__at") + 1).alias("site"), "codon")


def reference_totals(sequences: DataFrame, reference: DataFrame) -> DataFrame:
    """``aln_id, reference, ref_seq, total``: the reference's sequence and its number of codons."""
    ref = sequences.select("aln_id", "label", F.col("seq").alias("ref_seq")).join(reference, "aln_id").where(F.col("label") == F.col("reference"))
    return ref.select("aln_id", "reference", "ref_seq", C.codon_count(F.col("ref_seq")).alias("total"))


def reference_sites(totals: DataFrame) -> DataFrame:
    """``aln_id, codon_site, ref_codon, ref_aa`` over the reference's codons."""
    rows = explode_sites(totals.select("aln_id", "total", F.col("ref_seq").alias("seq")), "total")
    codon = F.upper("codon")
    return rows.select("aln_id", F.col("site").alias("codon_site"), codon.alias("ref_codon"), C.translate_codon(codon).alias("ref_aa"))


RESIDUES = C.AMINO_ACIDS[:20]
#: Sites times residues that a task counts before it hands them on.
MOST_CELLS = 1 << 22

_BASE = np.full(256, 64, np.int16)
for _i, _x in enumerate(C.BASES):
    _BASE[ord(_x)] = _BASE[ord(_x.lower())] = _i
_RESIDUE = np.array([RESIDUES.find(x) % 21 for x in C.GENETIC_CODE] + [20])  # stops and anything else last


def residue_counts(sequences: DataFrame) -> DataFrame:
    """``aln_id, site`` and a column ``n_<residue>`` for each of the twenty amino acids, of ``aln_id, seq``: how many sequences have it there. Sites
    without any are left out. Codons become numbers a sequence at a time and are counted in a table for each alignment; no codon has a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for aln, table in tables.items():
                at = table[:, :20].any(axis=1).nonzero()[0]
                for i in range(0, len(at), 10_000):
                    some = at[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([aln] * len(some), pa.string()), pa.array(some + 1, pa.int32()), *(pa.array(table[some, k], pa.int64()) for k in range(20))], names=names)
            tables.clear()

        for batch in batches:
            for aln, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(seq or "") // 3
                if not n:
                    continue
                table = tables.get(aln)
                if table is None or len(table) < n:
                    grown = np.zeros((n if table is None else max(n, 2 * len(table)), 21), np.int64)
                    if table is not None:
                        grown[: len(table)] = table
                    tables[aln] = table = grown
                base = _BASE[np.frombuffer(seq[: 3 * n].encode("latin-1", "replace"), np.uint8)]
                table[np.arange(n), _RESIDUE[np.minimum(16 * base[::3] + 4 * base[1::3] + base[2::3], 64)]] += 1
            if sum(x.size for x in tables.values()) > MOST_CELLS:
                yield from told()
        yield from told()

    columns = [f"n_{x}" for x in RESIDUES]
    names = ["aln_id", "site", *columns]
    counted = sequences.select("aln_id", "seq").mapInArrow(run, "aln_id string, site int, " + ", ".join(f"{c} long" for c in columns))
    return counted.groupBy("aln_id", "site").agg(*(F.sum(c).alias(c) for c in columns))


def residue_pairs(counts: DataFrame) -> DataFrame:
    """``aln_id, aa1, aa2, pairs``, ``aa1`` not after ``aa2``: the products of two residues' ``residue_counts``, added up over the sites; none where no
    site has both."""
    columns = [f"n_{x}" for x in RESIDUES]
    first, second = np.triu_indices(20)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for aln, rows in frame.groupby("aln_id", dropna=False):
                n = rows[columns].to_numpy(np.int64)
                sums = (n.T @ n)[first, second]
                yield pd.DataFrame({"aln_id": aln, "aa1": [RESIDUES[i] for i in first], "aa2": [RESIDUES[i] for i in second], "pairs": sums})[sums > 0]

    return counts.select("aln_id", *columns).mapInPandas(run, "aln_id string, aa1 string, aa2 string, pairs long").groupBy("aln_id", "aa1", "aa2").agg(F.sum("pairs").alias("pairs"))


def site_profile(codons: DataFrame, *by: str) -> DataFrame:
    """Per site: ``n_codons`` valid ones, ``n_aas`` distinct amino acids, ``is_variable``, and codon and amino-acid entropy in bits.

    Variable: more than one amino acid (a stop counts), or serine from both of its codon families. Gaps, N, ? count for nothing, and
    a codon with an ambiguous base counts as a codon without an amino acid. Combined per task before the shuffle: a site has at
    most a few dozen different codons, whatever the number of sequences.
    """
    known = codons.where(C.is_valid_codon(F.col("codon"))).withColumn("codon", F.upper("codon"))
    counts = known.groupBy(*by, "codon").agg(F.count("*").alias("n"))
    counts = counts.withColumn("aa", F.nullif(C.translate_codon(F.col("codon")), F.lit("?")))
    by_aa = counts.groupBy(*by, "aa").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.bool_or(F.col("codon").isin(*C.SERINE_TCN)).alias("tcn"), F.bool_or(F.col("codon").isin(*C.SERINE_AGY)).alias("agy"))
    aa_n = F.when(F.col("aa").isNotNull(), F.col("n"))
    sites = by_aa.groupBy(*by).agg(
        F.sum("n").alias("n_codons"), F.sum("s").alias("s"), F.count("aa").alias("n_aas"), F.sum(aa_n).alias("m"), F.sum(aa_n * F.log2(aa_n)).alias("t"),
        F.bool_or(F.col("tcn")).alias("tcn"), F.bool_or(F.col("agy")).alias("agy"), F.max("aa").alias("one"),
    )
    serine = (F.col("n_aas") == 1) & (F.col("one") == "S") & F.col("tcn") & F.col("agy")
    bits = lambda n, s: F.greatest(F.coalesce(F.log2(n) - F.col(s) / F.col(n), F.lit(0.0)), F.lit(0.0))
    return sites.select(*by, "n_codons", "n_aas", ((F.col("n_aas") > 1) | serine).cast("int").alias("is_variable"), bits("n_codons", "s").alias("codon_entropy"), bits("m", "t").alias("aa_entropy"))


def windows(sequences: DataFrame, size: int, total: str | None = None) -> DataFrame:
    """Centred windows: the input's columns without ``seq``, ``site``, ``w_idx`` (0 to ``size - 1``), ``codon_tok`` and ``aa_tok``.

    Position ``site - size // 2 + w_idx``; outside 1..total the tokens are those of an unknown codon. An even size reaches one
    further to the left, and the centre is always at ``size // 2``.
    """
    count = C.codon_count(F.coalesce(F.col("seq"), F.lit(""))) if total is None else F.col(total)
    rest = [c for c in sequences.columns if c != "seq"]
    before = size // 2
    # tokens are made once a codon, then each codon is dealt to the windows that it is in
    codons = explode_sites(sequences.withColumn("__n", count), "__n")
    tokens = codons.select(*rest, "__n", F.col("site").alias("__at"), C.codon_token(F.col("codon")).alias("codon_tok"), C.aa_token(F.col("codon")).alias("aa_tok"))
    dealt = tokens.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("w_idx")).withColumn("site", F.col("__at") + before - F.col("w_idx"))
    inside = dealt.where((F.col("site") >= 1) & (F.col("site") <= F.col("__n"))).select(*rest, "site", "w_idx", "codon_tok", "aa_tok")
    edge = sequences.where(count > 0).select(*rest, count.alias("__n"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("w_idx"))
    edge = edge.withColumn("__off", F.col("w_idx") - before).where("__off <> 0")
    first = F.when(F.col("__off") < 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.col("__n") - F.col("__off") + 1))
    last = F.when(F.col("__off") < 0, F.least(F.col("__n"), -F.col("__off"))).otherwise(F.col("__n"))
    outside = edge.select(*rest, F.explode(F.sequence(first, last)).alias("site"), "w_idx", F.lit(C.UNKNOWN_CODON).alias("codon_tok"), F.lit(C.UNKNOWN_AA).alias("aa_tok"))
    return inside.unionByName(outside)


def pad_tokens(tokens: DataFrame, column: str, size: int, fill: int) -> DataFrame:
    """The array in ``column`` filled up to ``size`` entries, for a model's input."""
    short = F.greatest(F.lit(0), F.lit(size) - F.size(column))
    return tokens.withColumn(column, F.concat(F.col(column), F.array_repeat(F.lit(fill), short)))


def label_sites(labels: DataFrame, features: DataFrame, size: int, dummies: bool = True) -> DataFrame:
    """Labelled sites with their features; a gene without an alignment keeps its label with ``size`` zero tokens (which stand for
    TTT) if ``dummies``, or null."""
    joined = labels.join(features, ["gene_name", "site_index"], "left")
    return joined.withColumn("tokens", F.coalesce("tokens", F.array_repeat(F.lit(0), size))) if dummies else joined


def first_species(sequences: DataFrame, most: int = 100) -> DataFrame:
    """The first sequences of each alignment by place."""
    return sequences.where(F.col("seq_idx") < most)
