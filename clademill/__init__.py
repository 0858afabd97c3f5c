"""clademill: site-level evolutionary-selection scans over codon alignments and phylogenetic trees, on PySpark."""
