"""Scans alignments as their files arrive in a folder, once each, and counts the calls delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clademill.operators.model import Weights
from clademill.plans.pipeline import ScanOptions, scan_frames
from clademill.plans.storage import written
from clademill.sources import nexus


def deliveries(spark: SparkSession, path: str, within: str = "7 days") -> DataFrame:
    """The stream of alignment files under ``path``: ``aln_id, text, digest, modified, delivered``.

    A file that comes again with the same content ``within`` that time, under another folder or packed, is left out; the state holds names and
    digests alone, and those that are older are forgotten. ``delivered`` is the time of arrival, not the file's own, so nothing is ever late.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.readStream.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.regexp_replace(name, r"(?i)(\.nex|\.nexus)?(\.gz)?$", "").alias("aln_id"),
        F.col("value").alias("text"),
        F.sha2("value", 256).alias("digest"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.current_timestamp().alias("delivered"),
    )
    return files.withWatermark("delivered", within).dropDuplicatesWithinWatermark(["aln_id", "digest"])


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, weights: Weights, options: ScanOptions = ScanOptions(), once: bool = True, within: str = "7 days") -> StreamingQuery:
    """Writes the predictions of each new alignment, and ``delivered``, to Parquet at ``out``. A batch that is run again replaces its own folder.

    Of several contents that one alignment has in a batch the file modified last counts; content that changes later gives rows in a later
    batch (``current`` takes the last).
    """

    def batch(frame: DataFrame, number: int) -> None:
        # written first: each action on a batch would run the stream's state again
        rows = written(frame, "delivered")
        last = rows.groupBy("aln_id").agg(F.max_by(F.struct("text", "delivered"), F.struct("modified", "digest")).alias("x")).select("aln_id", "x.*")
        sequences = written(nexus.parse_alignment_texts(last), "sequences")
        trees = sequences.groupBy(F.col("aln_id").alias("tree_id")).agg(F.first("tree").alias("newick"))
        found = scan_frames(sequences.drop("tree"), nexus.parse_trees(trees), weights, options)
        found.join(last.select("aln_id", "delivered"), "aln_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = deliveries(spark, path, within).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tier_counts(spark: SparkSession, predictions: str, out: str, checkpoint: str, once: bool = True, within: str = "7 days") -> StreamingQuery:
    """Running counts ``day, selection_call, n, n_alignments`` of the predictions that ``watch`` writes, by the day of delivery.

    The state holds one row a site until ``within`` has passed, so a site that is read again (its batch was run again) counts once, and one row a
    day and call. Each batch writes the totals so far of what it changed to its own folder of ``out``, which it replaces if it is run again; ``current`` takes
    the last of each.
    """
    schema = spark.read.parquet(predictions).schema
    rows = spark.readStream.schema(schema).parquet(predictions).withColumn("delivered", F.col("delivered").cast("timestamp")).withWatermark("delivered", within)
    rows = rows.dropDuplicatesWithinWatermark(["batch", "aln_id", "codon_site"])
    counts = rows.groupBy(F.window("delivered", "1 day").alias("day"), "selection_call").agg(F.count("*").alias("n"), F.approx_count_distinct("aln_id").alias("n_alignments"))

    def batch(frame: DataFrame, number: int) -> None:
        frame.select(F.col("day.start").alias("day"), "selection_call", "n", "n_alignments").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str, *by: str) -> DataFrame:
    """The rows of each key's last batch: predictions by ``aln_id``, counts by ``day, selection_call``."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(*by).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*by, "batch"])
