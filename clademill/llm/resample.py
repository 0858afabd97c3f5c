"""Importance resampling toward a target distribution, over a dictionary of distinct features.

Features are runs of words. Each task counts them by document in blocks (``blocks``); the dictionary adds the blocks' vocabularies up over all
documents, hashes each distinct string once into a bucket and sums up buckets. A bucket's gain compares its share in the target with its share in
the source. Gains are joined to the dictionary, from there to each block's vocabulary and so to the documents' counts. A document's score is its
mean gain plus Gumbel noise from a hash of its id, and those of highest score are drawn.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.llm import blocks
from clademill.llm.common import materialise

#: A word is a run of bytes of ASCII letters (lower-cased), digits and whatever is not ASCII; all else becomes a space.
_WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def counted(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id", longest: int = 1) -> DataFrame:
    """Blocks (written) of the counts of runs of 1 to ``longest`` words, with ``doc_id`` (None: null), ``n_words`` and ``n_features`` of each document."""
    name = F.lit(None).cast("long") if doc_id is None else F.col(doc_id)
    source = docs.select(name.alias("doc_id"), F.col(text).cast("binary").alias("data"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: blocks.Builder | None = None
        places: dict[bytes, int] = {}

        def close() -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(places), np.int64)
            for at, times in made.counts:
                sums[at] += times  # a document has each place once
            yield from made.close(pa.array(list(places), pa.binary()), sums)
            places.clear()

        for batch in batches:
            if made is None:
                columns = [("doc_id", batch.schema.field(0).type), ("n_words", pa.int64()), ("n_features", pa.int64())]
                made = blocks.Builder(TaskContext.get().partitionId(), columns, pa.binary())
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(data.as_py() or b"")
                features = Counter(found)
                for n in range(2, longest + 1):
                    features.update(map(b" ".join, zip(*(found[i:] for i in range(n)), strict=False)))
                at = np.array([places.setdefault(f, len(places)) for f in features], np.int64)
                times = np.array(list(features.values()), np.int64)
                made.add((doc, len(found), int(times.sum())), at, times)
                if made.full():
                    yield from close()
        if made is not None and made.rows:
            yield from close()

    return materialise(source.mapInArrow(run, blocks.schema(f"doc_id {kind}, n_words long, n_features long", "binary")), "features")


def dictionary(table: DataFrame, buckets: int) -> DataFrame:
    """``key, total, bucket`` (written): each distinct feature of all blocks once."""
    return materialise(blocks.totals(table).withColumn("bucket", F.expr(f"crc32(key) % {int(buckets)}L")), "dictionary")


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` for every bucket: floor of 1000 times the log of its smoothed share in the target over that in the source.
    Written; it has ``buckets`` rows, so its broadcast is bounded whatever the input."""
    spark = source.sparkSession

    def sums(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("bucket").agg(F.sum("total").alias(name))

    each = spark.range(buckets).withColumnRenamed("id", "bucket")
    each = each.join(sums(source, "s"), "bucket", "left").join(sums(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = materialise(each, "buckets")
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).first()
    share = ((F.col("t") + 1) * F.lit(float(whole["all_s"] + buckets))) / ((F.col("s") + 1) * F.lit(float(whole["all_t"] + buckets)))
    return materialise(both.select("bucket", F.floor(1000 * F.log(share)).alias("gain")), "gains")


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate from 32 bits of a hash of seed and id (a null id counts as empty), rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document; weight is the mean gain over its features, rounded down (none: 0)."""
    table = counted(docs, text, doc_id, longest)
    goal = dictionary(counted(target, target_text, None, longest), buckets)
    known = dictionary(table, buckets)
    gain = known.join(F.broadcast(gains(known, goal, buckets)), "bucket").select("key", "gain")
    summed = blocks.weighted_sums(table, gain, ["doc_id", "n_words", "n_features"])
    n = F.col("n_features")
    weight = F.when(n == 0, 0).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    return summed.select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight"))


#: Scores below and above this count as one cell each when the cut is looked for; it only decides how many rows are sorted.
WIDEST = 100_000


def drawn(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``scored`` (``doc_id, n_words, score``, written) with ``rank``: 1, 2, 3... by score, then id, for the first ``share`` percent of
    the documents of at least ``least_words`` words, null for all others.

    The cut is found in a histogram of scores of bounded size; only rows from it on are dealt out by ranges of score and id,
    numbered within each range and moved on by the sizes of those before. Null ids come last among ties; repeated rows are
    numbered in any order."""
    able = scored.where(F.col("n_words") >= least_words)
    cell = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("score")))
    cells = sorted((r["cell"], r["n"]) for r in able.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect())
    wanted, cut, above = share * sum(n for _, n in cells) // 100, None, 0
    while cells and above < wanted:
        cut, n = cells.pop()
        above += n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    in_reach = (F.col("n_words") >= least_words) & (F.lit(cut == -WIDEST) | (F.col("score") >= cut))
    parts = max(1, min(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), above // 10_000 + 1))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # written, so that numbers and sizes come from the same dealing-out
    ranged = materialise(scored.where(in_reach).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    moved = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))[F.col("part").cast("long")]
    ranked = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) + moved)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).drop("part")
    return ranked.unionByName(scored.where(~in_reach).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", longest: int = 1, buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank``; ``rank`` is null for those that aren't drawn.

    A null or empty text has no features and weight 0. An empty target or table of documents is allowed: shares are smoothed by
    one count a bucket. Repeated rows are documents of their own; other columns are ignored, whatever their names.
    """
    weighed = weigh(docs, target, text, doc_id, target_text, longest, buckets)
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    return drawn(scored, share, least_words)
