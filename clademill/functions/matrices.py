"""Amino-acid scoring matrices as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESIDUES = "ARNDCQEGHILKMFPSTWYV"

# BLOSUM62 after Henikoff and Henikoff (1992) as scans of this kind use it (R-E is -2 and R-L -3 there, the paper's are 0 and -2), lower
# triangle with the diagonal, residues in the order of RESIDUES.
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1 -2  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -3 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""

# Residue distances after Grantham (1974) as scans of this kind use them (A-C is 44 there, not the paper's 195), lower
# triangle without the diagonal, which is zero; residues in the order of RESIDUES.
GRANTHAM = """
A
R 112
N 111  86
D 126 138  23
C  44 102 139 154
Q  91  43  46  61 116
E 107  97  42  45 126  29
G  60 125  80  94 117  87  98
H  86  29  68  81 118  24  40  98
I  94  97 149 168 117  93 103 135  99
L  96 102 143 162 121  99 107 127 105  10
K 106  26  94 101 112  53  56 127  32  97 107
M  84  91 142 160 118  81  87 127  87  10  15  95
F  95  97 158 177 135  93 102 153  92  21  22 102  28
P  27 103  91 108  74  76  93  42  77  95  95 103  87 110
S  35 110  46  54  80  68  80  56  83 142 145 121 135 155  56
T  58  71  65  85 101  47  65  59  47 124 130  78 121 140  74  58
W 148 101 174 181 190 130 122 184 115 103 113 110 115  40 153 177 178
Y 112  77 143 162 154  84  86 147  83  83  92  85  95  22 110 144 134  37
V  64  96 133 152 109  96  96 109  98  29  32  97  21  50  76 124 103  88  90
"""


def parse_triangle(text: str) -> dict[tuple[str, str], float]:
    """A symmetric matrix from its lower triangle; a diagonal that isn't given is zero."""
    out: dict[tuple[str, str], float] = {}
    for line in text.strip().splitlines():
        a, *values = line.split()
        for b, x in zip(RESIDUES, [*values, 0.0][: RESIDUES.index(a) + 1], strict=False):
            out[a, b] = out[b, a] = float(x)
    return out


def parse_matrix(grid: str) -> dict[tuple[str, str], float]:
    """A text grid with residues along the top and down the left."""
    head, *rows = (line.split() for line in grid.strip().splitlines() if line.strip() and not line.lstrip().startswith("#"))
    return {(row[0], b): float(x) for row in rows for b, x in zip(head, row[1:], strict=True)}


def grantham(a: str, b: str) -> float:
    return parse_triangle(GRANTHAM)[a, b]


def scoring_matrix(spark: SparkSession, grid: str | None = None) -> DataFrame:
    """``aa1, aa2, score, grantham`` over the 400 pairs; ``score`` is BLOSUM62's or that of another ``grid``, null where it has none."""
    scores, far = parse_matrix(grid) if grid else parse_triangle(BLOSUM62), parse_triangle(GRANTHAM)
    rows = [(a, b, scores.get((a, b)), far[a, b]) for a in RESIDUES for b in RESIDUES]
    return spark.createDataFrame(rows, "aa1 string, aa2 string, score double, grantham double")
