import pytest

import __spark_entry__ as entry
from clademill.plans.queries import ORACLE_SQL, QUERIES


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    rows = entry.entry(spark)
    assert rows.columns[:3] == ["aln_id", "codon_site", "ref_codon"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"q01_codon_tokens", "q02_amino_acids", "q05_windows"}))
def test_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()), key=repr)
    clean = lambda rows: sorted(repr([round(x, 7) if isinstance(x, float) else x for x in r]) for r in rows)
    assert clean(got) == clean(want)


def test_species_of_the_supplier_tree(spark):
    from test_tree import fresh_greedy

    from clademill.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    nodes = {r.node_id: r for r in Q.supplier_tree(spark, sf).collect()}
    paths = {}
    for n in sorted((x for x in nodes.values() if x.is_leaf), key=lambda x: x.leaf_idx):
        at, path = n, []
        while at is not None:
            path.append((at.node_id, at.branch_length or 0.0))
            at = nodes.get(at.parent_id)
        paths[n.name] = path
    species = list(paths)
    got = sorted(tuple(r) for r in QUERIES["q25_greedy_diversity"](spark, sf).collect())
    assert [x[1:] for x in got] == fresh_greedy(paths, species, species[0], min(64, len(species)))


def test_ordination_spread(spark):
    import numpy as np
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    want = {}
    for label, part in table.groupby("label"):
        x = np.stack(part["embedding"]).astype(float)
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:4]
        want[label] = (len(x), (s**2).sum() if len(x) > 4 else 0.0)
    got = {r.label: (r.n, r.spread) for r in QUERIES["q26_mds"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-4, abs=2e-3) for k in want)


def test_axial_forward_against_loops(spark):
    import numpy as np
    import pandas as pd
    from test_model_pipeline import SMALL, loop_forward

    from clademill.functions import codon as C
    from clademill.operators import model

    sf = "/root/testdata/sf0.001"
    parts = pd.read_parquet(f"{sf}/part.parquet").dropna(subset=["p_name"]).sort_values("p_partkey")
    w, want = model.seeded_weights(SMALL), {}
    to_base = {c: "TCAG"[i % 4] for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    for (brand, size), group in parts.groupby(["p_brand", "p_size"]):
        seqs = ["".join(to_base.get(c, "-") for c in name.lower()) for name in group["p_name"]]
        total, n = max(len(s) // 3 for s in seqs), len(seqs)
        codons = [[s[3 * i : 3 * i + 3] for i in range(total)] for s in seqs]
        token = lambda c: "TCAG".index(c[0]) * 16 + "TCAG".index(c[1]) * 4 + "TCAG".index(c[2]) if len(c) == 3 and "-" not in c else 64 if c == "---" else 65
        amino = lambda t: C.AMINO_ACIDS.index(C.GENETIC_CODE[t]) if t < 64 else t - 43
        dist = np.abs(np.arange(n)[:, None] - np.arange(n)[None]) / 8.0
        for site in range(total):
            toks = np.array([[token(c[site])] for c in codons])
            known = {C.GENETIC_CODE[t] for t in toks[:, 0] if t < 64}
            serine = {c[site] in C.SERINE_TCN for c in codons if c[site] in (*C.SERINE_TCN, *C.SERINE_AGY)}
            if len(known) > 1 or (known == {"S"} and len(serine) == 2):
                aas = np.array([[amino(t)] for t in toks[:, 0]])
                want[f"{brand}/{size}", site + 1] = loop_forward(w, SMALL, toks, aas, dist, np.full((n, 4), 0.25), np.zeros(n, bool))
    got = {(r.aln_id, r.site): r.score for r in QUERIES["q32_axial_forward"](spark, sf).collect()}
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_command_line():
    from clademill.__main__ import main, options

    a = options(["x.nex", "--weights", "w.npz", "--reference", "hg38", "--use-zscore", "--z-1", "3"])
    with pytest.raises(SystemExit):
        options(["x.nex"])
    assert main(["x.nex", "--weights", "/nowhere.npz"]) == 1
    assert (a.alignments, a.reference, a.use_zscore, a.z_1, a.percentile_2, a.max_species) == ("x.nex", "hg38", True, 3.0, 97.0, 256)
