"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass one counts the filter's cells: two hash functions send each text to two of ``bits`` cells, cells are combined per task before they
shuffle, and those hit at least twice are set in a second bitmap. Pass two probes that bitmap: a text with a clear cell is
certainly unique and passes straight through without a shuffle; only the rest is grouped by its digest. The bitmap holds at most
``MAX_BITS`` bits (one million 64-bit words), so its broadcast is bounded whatever the input; beyond that it saturates and more
rows take the exact path, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import materialise, split_of

WHITE_SPACE = " \t\n\x0b\x0c\r"
MIN_BITS, MAX_BITS = 1 << 17, 1 << 26


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


PROBES = 2


def _cell(sha: str, bits: int, probe: int) -> str:
    return f"pmod(xxhash64(`{sha}`, {probe}), {bits}L)"


def repeated_cells(digests: DataFrame, sha: str = "sha", bits: int | None = None) -> tuple[DataFrame, int]:
    """The second-pass bitmap as rows ``word, ones`` (64 cells each; absent words are empty), and its number of bits.

    ``digests`` is read twice, so it should be a written table. An empty input gives an empty bitmap.
    """
    if bits is None:
        bits = MIN_BITS
        rows = digests.count()
        while bits < MAX_BITS and bits < 16 * rows:
            bits *= 2
    if bits > MAX_BITS:
        raise ValueError(f"bits must be at most {MAX_BITS}: the bitmap is broadcast")
    both = ", ".join(_cell(sha, bits, i) for i in range(PROBES))
    # a text whose two cells are one hits it once
    cells = digests.selectExpr(f"explode(array_distinct(array({both}))) AS cell").groupBy("cell").count().where("count > 1")
    words = cells.select(F.expr("cell div 64").alias("word"), F.expr("shiftleft(1L, int(cell % 64))").alias("one"))
    return words.groupBy("word").agg(F.bit_or("one").alias("ones")), bits


def flag_repeats(df: DataFrame, sha: str, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with a boolean column ``flag``: false for a digest that occurs once for certain."""
    word, ones, hit = split_of(df, "word", "ones", "hit")
    small = bitmap.select(F.col("word").alias(word), F.col("ones").alias(ones))
    out = df.withColumn(hit, F.lit(True))
    for i in range(PROBES):
        probe = out.withColumn(word, F.expr(f"{_cell(sha, bits, i)} div 64")).join(F.broadcast(small), word, "left")
        bit = F.expr(f"shiftrightunsigned(`{ones}`, int({_cell(sha, bits, i)} % 64)) & 1L")
        out = probe.withColumn(hit, F.col(hit) & (F.coalesce(bit, F.lit(0)) == 1)).drop(word, ones)
    return out.withColumnRenamed(hit, flag)


def may_be_in(df: DataFrame, column: str, keys: DataFrame, key: str, flag: str | None = None) -> DataFrame:
    """The rows of ``df`` whose long ``column`` is among ``keys``, and perhaps a few others, without a shuffle: the keys' cells are
    broadcast as a bitmap of bounded size. A join that follows then shuffles little. With ``flag`` all rows, with a column that tells."""
    sha, maybe = split_of(df, "sha", "maybe")
    marks = materialise(keys.select(F.unhex(F.hex(key)).alias("sha")).where("sha IS NOT NULL").distinct(), "keys")
    bitmap, bits = repeated_cells(marks.union(marks), "sha")  # each key twice, so that every one's cell is set
    flagged = flag_repeats(df.withColumn(sha, F.unhex(F.hex(column))), sha, bitmap, bits, flag or maybe)
    return flagged.drop(sha) if flag else flagged.where(F.col(maybe)).select(*df.columns)


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII white space; a null text counts as empty and very long texts are hashed
    whole. Of equal texts the one with the most code points in its original form stays, then the smallest ``doc_id`` (null ids
    last). Of wholly repeated rows exactly one is kept. Other columns are ignored. An empty table gives an empty result.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(digest(F.col(text))).alias("sha"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        F.monotonically_increasing_id().alias("rid"),
    )
    narrow = materialise(narrow, "digests")
    bitmap, bits = repeated_cells(narrow, "sha", bits)
    flagged = flag_repeats(narrow, "sha", bitmap, bits, "maybe")
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    some = flagged.where("maybe")
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    # written, so that the join deals both sides out anew and Spark can split a hot digest's rows
    best = materialise(some.groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    grouped = some.join(best, "sha").select("doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.r")).alias("kept"), "sha")
    return alone.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the rule is that of ``classify``.

    Only possibly repeated rows shuffle, combined per task to one row for each digest first. Rows equal in length and id are
    settled by a hash of the text here, as their order in the files can't be told by their contents. Columns whose names clash with internal ones are safe.
    """
    sha, maybe, row = split_of(docs, "sha", "maybe", "row")
    hashed = docs.withColumn(sha, F.unhex(digest(F.col(text))))
    bitmap, bits = repeated_cells(materialise(hashed.select(F.col(sha).alias("sha")), "digests"), "sha", bits)
    flagged = flag_repeats(hashed, sha, bitmap, bits, maybe)
    alone = flagged.where(~F.col(maybe)).select(*docs.columns)
    original = F.coalesce(F.col(text), F.lit(""))
    order = F.struct(-F.length(original), F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(original), F.col(text).isNull())
    best = flagged.where(F.col(maybe)).groupBy(sha).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return alone.unionByName(best.select(*(F.col(row)[c].alias(c) for c in docs.columns)))
