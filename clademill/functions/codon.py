"""Codon, amino-acid and name expressions, all built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base order, the standard genetic code in that order, amino-acid token order, special tokens.
BASES = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY*-?"
GAP_CODON, UNKNOWN_CODON = 64, 65
GAP_AA, UNKNOWN_AA = 21, 22
SERINE_TCN = ("TCA", "TCC", "TCG", "TCT")
SERINE_AGY = ("AGC", "AGT")


def codon_at(seq: Column, site: Column) -> Column:
    """The codon at a 1-based site; shorter at a cut end, empty beyond it."""
    return F.substring(seq, (site - 1) * 3 + 1, F.lit(3))


def codon_count(seq: Column) -> Column:
    """Whole codons, gaps included."""
    return F.floor(F.length(seq) / 3).cast("int")


def _base(codon: Column, i: int) -> Column:
    return F.instr(F.lit(BASES), F.substring(codon, i, 1)) - 1


def _has(codon: Column, what: str) -> Column:
    return F.contains(codon, F.lit(what))


def codon_token(codon: Column) -> Column:
    """0..63 in TCAG order; 64 for any gap (checked first); 65 for anything else. Null gives 65."""
    c = F.upper(codon)
    bases = [_base(c, i) for i in (1, 2, 3)]
    known = (F.length(c) == 3) & (bases[0] >= 0) & (bases[1] >= 0) & (bases[2] >= 0)
    token = F.when(_has(c, "-"), GAP_CODON).when(known, 16 * bases[0] + 4 * bases[1] + bases[2])
    return token.otherwise(UNKNOWN_CODON).cast("int")


def translate_codon(codon: Column) -> Column:
    """The amino acid's letter, ``*`` for a stop, ``?`` for anything that isn't three known bases."""
    token = codon_token(codon)
    return F.when(token < 64, F.substring(F.lit(GENETIC_CODE), token + 1, F.lit(1))).otherwise("?")


def aa_token(codon: Column) -> Column:
    """Index in ``AMINO_ACIDS``: 20 for a stop, 21 for a gap, 22 for unknown."""
    aa = F.instr(F.lit(AMINO_ACIDS), translate_codon(codon)) - 1
    return F.when(_has(codon, "-"), GAP_AA).otherwise(aa).cast("int")


def is_valid_codon(codon: Column) -> Column:
    """Three characters without gap, N or ?; an ambiguous base passes here although it has no amino acid."""
    c = F.upper(codon)
    return F.coalesce((F.length(c) == 3) & ~c.rlike("[-N?]"), F.lit(False))


def normal_name(name: Column) -> Column:
    """Without quotes and outer spaces."""
    return F.trim(F.translate(name, "'\"", ""))


def clean_newick(text: Column) -> Column:
    """Without ``{...}`` and ``[...]`` annotations, ended by exactly one semicolon."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\[[^\]]*\]", "")
    return F.concat(F.regexp_replace(F.trim(plain), r";+$", ""), F.lit(";"))


def strip_branch_lengths(text: Column) -> Column:
    return F.regexp_replace(text, ":[0-9.eE-]+", "")


def branch_weight(length: Column, tree_has_lengths: Column) -> Column:
    """1 where the tree has no positive length at all; otherwise the length, with null or NaN as 0."""
    return F.when(~tree_has_lengths, F.lit(1.0)).otherwise(F.coalesce(F.nanvl(length, F.lit(0.0)), F.lit(0.0)))


def back_transform(log_lrt: Column, is_variable: Column) -> Column:
    """exp(x) - 1, at least 0; 0 for an invariant site. An overflow gives infinity."""
    return F.when(is_variable, F.greatest(F.lit(0.0), F.exp(log_lrt) - 1)).otherwise(F.lit(0.0))


def round_even(x: Column, digits: int) -> Column:
    """Rounds the scaled double half to even."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def distance_weight(dist: Column) -> Column:
    return F.log1p(1 / (dist + 0.05))
