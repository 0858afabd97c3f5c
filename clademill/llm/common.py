"""Shared helpers: tables in the cluster's shared folder, and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset on a local master (tests), a temporary one is made once per
    application. On a cluster it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="clademill-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, which cuts its lineage; lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``materialise`` that is no longer read."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A bitmap of keys has so many bits at most (8 MB).
MAX_BITS = 1 << 26


def key_bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of two probes (64-bit words) over the hashed 64-bit ``keys``. It fills up beyond about ``MAX_BITS`` keys, so whoever it
    lets pass has to be checked by a join."""
    bits = 1 << 17
    rows = keys.count()
    while bits < MAX_BITS and bits < 32 * rows:
        bits *= 2
    probes = F.array(F.col(key).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1)))
    cells = keys.select(F.explode(probes).alias("cell"))
    words = cells.select(F.shiftright("cell", 6).alias("word"), F.expr("shiftleft(1L, int(cell & 63L))").alias("one")).groupBy("word").agg(F.bit_or("one").alias("ones"))
    out = np.zeros(bits // 64, np.uint64)
    found = words.toArrow()  # one row a word, of which there are a million at most
    out[found.column("word").to_numpy()] = found.column("ones").to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit ``keys`` may be among those of ``key_bitmap``."""
    keys, top = keys.view(np.uint64), np.uint64(64 * len(words) - 1)
    first, second = keys & top, (keys >> np.uint64(32)) & top
    some = np.flatnonzero(words[first >> np.uint64(6)] >> (first & np.uint64(63)) & np.uint64(1))
    cell = second[some]
    out = np.zeros(len(keys), bool)
    out[some] = (words[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def split_of(df: DataFrame, *names: str) -> list[str]:
    """``names``, each extended with underscores until no column of ``df`` (compared without case) has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find by alternating large-star and small-star steps.

    ``edges`` has two orderable columns ``a`` and ``b``. Returns ``node, root``: each node that isn't the smallest of its component,
    with that one. Self-loops and rows with a null are ignored; an empty input gives an empty result.
    Every step is aggregation by key (combined before the shuffle) and an equi-join, and is written to the shared folder.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined back, so that both sides are dealt out anew and Spark can split a hub's edges
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large-star")
        discard(low)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after = materialise(small, "small-star")
        for done in (now, large, low):
            discard(done)
        now = after
        # done when each node has one edge, and that to a node that has none
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out")).union(now.select(F.col("v").alias("x"), F.lit(0).alias("out")).distinct())
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.count("*").alias("n")).where("out > 1 OR out = 1 AND n > 1").take(1):
            break
    else:
        raise RuntimeError("connected components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
