"""The same functions for queries in SQL: codon functions that the optimiser inlines, and a table function that reads trees."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from clademill.functions import codon as C
from clademill.sources.newick import NODE_SCHEMA, parse_newick

_BASES = [f"(instr('{C.BASES}', substring(upper(codon), {i}, 1)) - 1)" for i in (1, 2, 3)]

#: Name, arguments, result, and body; a body may call those before it.
FUNCTIONS = [
    ("codon_at", "seq STRING, site INT", "STRING", "substring(seq, (site - 1) * 3 + 1, 3)"),
    ("codon_count", "seq STRING", "INT", "CAST(floor(length(seq) / 3) AS INT)"),
    (
        "codon_token", "codon STRING", "INT",
        f"CAST(CASE WHEN contains(codon, '-') THEN {C.GAP_CODON} WHEN length(codon) = 3 AND least({', '.join(_BASES)}) >= 0 THEN 16 * {_BASES[0]} + 4 * {_BASES[1]} + {_BASES[2]} ELSE {C.UNKNOWN_CODON} END AS INT)",
    ),
    ("token_aa", "token INT", "STRING", f"CASE WHEN token < 64 THEN substring('{C.GENETIC_CODE}', token + 1, 1) ELSE '?' END"),
    ("translate_codon", "codon STRING", "STRING", "token_aa(codon_token(codon))"),
    ("aa_token", "codon STRING", "INT", f"CAST(CASE WHEN contains(codon, '-') THEN {C.GAP_AA} ELSE instr('{C.AMINO_ACIDS}', translate_codon(codon)) - 1 END AS INT)"),
    ("is_valid_codon", "codon STRING", "BOOLEAN", "coalesce(length(codon) = 3 AND NOT upper(codon) RLIKE '[-N?]', false)"),
    ("normal_name", "name STRING", "STRING", "trim(translate(name, '\\'\"', ''))"),
    ("distance_weight", "dist DOUBLE", "DOUBLE", "log1p(1 / (dist + 0.05D))"),
]


class NewickNodes:
    """A tree's nodes in preorder; a text that is null, empty or can't be read gives none."""

    def eval(self, newick: str) -> Iterator[tuple]:
        try:
            yield from parse_newick(newick) if newick and newick.strip(" \n;") else ()
        except ValueError:
            return


def register(spark: SparkSession) -> None:
    """Adds the functions to a session: ``SELECT codon_token(codon) ...``, ``FROM trees, LATERAL newick_nodes(newick)``."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("newick_nodes", udtf(NewickNodes, returnType=NODE_SCHEMA.removeprefix("tree_id string, ")))
