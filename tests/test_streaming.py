"""Streams: files delivered again count once, totals survive a restart."""

import gzip
import shutil
from datetime import datetime

from pyspark.sql import functions as F

from clademill.streaming.watch import current, deliveries, tier_counts


def drain(stream, out, checkpoint):
    def batch(frame, number):
        frame.select("aln_id", "text").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def seen(spark, out):
    return sorted((r.aln_id, r.text) for r in spark.read.parquet(str(out)).collect())


def test_files_delivered_again(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    (folder / "monday").mkdir(parents=True)
    (folder / "monday" / "a.nex").write_text("one")
    (folder / "monday" / "b.nex").write_text("one")  # the same content under another name is another alignment
    drain(deliveries(spark, str(folder)), str(out), state)
    assert seen(spark, out) == [("a", "one"), ("b", "one")]
    (folder / "tuesday").mkdir()
    (folder / "tuesday" / "a.nex").write_text("one")  # again
    with gzip.open(folder / "tuesday" / "b.nex.gz", "wt") as f:
        f.write("one")  # again, packed
    (folder / "tuesday" / "c.nex").write_text("three")
    (folder / "monday" / "a.nexus").write_text("two")  # changed
    drain(deliveries(spark, str(folder)), str(out), state)
    expected = [("a", "one"), ("a", "two"), ("b", "one"), ("c", "three")]
    assert seen(spark, out) == expected
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver had been lost after writing its last batch
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    drain(deliveries(spark, str(folder)), str(out), state)
    assert seen(spark, out) == expected


def predictions(spark, path, batch, alignment, calls, day):
    rows = [(alignment, i + 1, call, datetime(2024, 5, day, 12)) for i, call in enumerate(calls)]
    spark.createDataFrame(rows, "aln_id string, codon_site int, selection_call string, delivered timestamp").write.mode("append").parquet(f"{path}/batch={batch}")


def test_running_counts(spark, tmp_path):
    given, out, state = str(tmp_path / "predictions"), str(tmp_path / "counts"), str(tmp_path / "state")
    found = lambda: sorted((r.day.day, r.selection_call, r.n, r.n_alignments) for r in current(spark, out, "day", "selection_call").collect())
    predictions(spark, given, 0, "a", ["T1", "N", "N"], 1)
    predictions(spark, given, 0, "b", ["N"], 1)
    tier_counts(spark, given, out, state).awaitTermination()
    assert found() == [(1, "N", 3, 2), (1, "T1", 1, 1)]
    predictions(spark, given, 1, "c", ["T1", "T2"], 2)
    tier_counts(spark, given, out, state).awaitTermination()
    assert found() == [(1, "N", 3, 2), (1, "T1", 1, 1), (2, "T1", 1, 1), (2, "T2", 1, 1)]
    # batch 1 of the scan is run again: other files, the same sites
    for part in (tmp_path / "predictions" / "batch=1").glob("*.parquet"):
        shutil.copy(part, part.with_name("again-" + part.name))
    predictions(spark, given, 2, "d", ["T2"], 2)
    tier_counts(spark, given, out, state).awaitTermination()
    assert found() == [(1, "N", 3, 2), (1, "T1", 1, 1), (2, "T1", 1, 1), (2, "T2", 2, 2)]
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    tier_counts(spark, given, out, state).awaitTermination()
    assert found() == [(1, "N", 3, 2), (1, "T1", 1, 1), (2, "T1", 1, 1), (2, "T2", 2, 2)]
    assert current(spark, out, "day", "selection_call").agg(F.sum("n")).first()[0] == 7
