"""Ranking metrics, class balance, splits and samples, exact and free of driver-side loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.plans.storage import new_path


def class_balance(labels: DataFrame, label: str = "label") -> DataFrame:
    """``n, positives, negatives, pos_weight, base_rate``; an empty table has weight 0 and no rate."""
    sums = labels.agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("positives"))
    sums = sums.withColumn("negatives", F.col("n") - F.col("positives"))
    return sums.withColumn("pos_weight", F.col("negatives") / F.greatest(F.lit(1.0), F.col("positives").cast("double"))).withColumn("base_rate", F.col("positives") / F.nullif(F.col("n"), F.lit(0)))


def _by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives at each score, so that ties are one step. Combined before the shuffle."""
    return scored.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))


def running_totals(table: DataFrame, key: str, *columns: str, descending: bool = True, parts: int | None = None) -> DataFrame:
    """``table`` with ``before_<column>``: sums over rows of earlier keys. Keys are dealt out by range, each range is summed up by
    itself, and only one total for each range meets in one task."""
    spark = table.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).desc() if descending else F.col(key).asc()
    ranged = table.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id())
    path = new_path(spark, "ranges")  # written, so that parts and totals come from the same dealing-out
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    total = ranged.groupBy("__part").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    base = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__part", *(F.coalesce(F.sum(f"__{c}").over(base), F.lit(0.0)).alias(f"__{c}") for c in columns))
    own = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(total), "__part")  # one row a range
    return out.select(*table.columns, *((F.coalesce(F.sum(c).over(own), F.lit(0.0)) + F.col(f"__{c}")).alias(f"before_{c}") for c in columns))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``roc_auc`` by the rank-sum statistic with ties counted half; 0.5 if there is only one class."""
    steps = running_totals(_by_score(scored, score, label), "s", "q", descending=False)
    sums = steps.agg(F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(F.coalesce(F.col("u") / F.nullif(F.col("p") * F.col("q"), F.lit(0.0)), F.lit(0.5)).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``average_precision``: precision at each distinct score times the gain in recall; 0 if there is only one class."""
    steps = running_totals(_by_score(scored, score, label), "s", "p", "q")
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_p") + F.col("p") + F.col("before_q") + F.col("q"))
    sums = steps.agg(F.sum(F.col("p") * precision).alias("a"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(F.coalesce(F.when(both, F.col("a") / F.col("p")), F.lit(0.0)).alias("average_precision"))


def grouped_split(rows: DataFrame, group: str, share: float = 0.8, order: Column | None = None) -> DataFrame:
    """``rows`` with ``split`` train or validation, whole groups at a time: the first ``int(share * groups)`` by hash are train."""
    groups = rows.select(group).distinct().withColumn("__order", F.struct(F.md5(F.col(group).cast("string")) if order is None else order, F.col(group)))
    ranked = running_totals(groups.withColumn("__one", F.lit(1.0)), "__order", "__one", descending=False)
    cut = int(share * groups.count())
    split = ranked.select(group, F.when(F.col("before___one") < cut, "train").otherwise("validation").alias("split"))
    return rows.join(split, group)


def subsample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Exactly ``limit`` rows (or all), those with the lowest hashes of a unique key; ties go by the key.

    Rows are counted by the first 16 bits of their hash. Those below the cell in which the limit falls are taken by a filter, and only that cell's
    rows, one in 65,536, are dealt out by range and counted through; nothing is sorted as a whole."""
    digest = F.md5(F.col(key).cast("string"))
    cell = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    marked = rows.withColumn("__cell", F.coalesce(cell, F.lit(-1)))  # a null key comes first
    left, cut = limit, None
    for c, n in sorted((r["__cell"], r["n"]) for r in marked.groupBy("__cell").agg(F.count("*").alias("n")).collect()):  # 65,537 rows at most
        if n > left:
            cut = c
            break
        left -= n
    if cut is None:
        return rows
    below = marked.where(F.col("__cell") < cut).drop("__cell")
    edge = marked.where(F.col("__cell") == cut).drop("__cell").withColumn("__order", F.struct(digest, F.col(key))).withColumn("__one", F.lit(1.0))
    counted = running_totals(edge, "__order", "__one", descending=False)
    return below.unionByName(counted.where(F.col("before___one") < left).drop("__order", "__one", "before___one"))


def batches(rows: DataFrame, key: str, size: int, epoch: int = 0) -> DataFrame:
    """``rows`` with ``batch``, shuffled anew for each epoch; a short last batch is dropped if there is a full one."""
    n = rows.count()
    marked = rows.withColumn("__hash", F.xxhash64(F.lit(epoch), F.col(key))).withColumn("__one", F.lit(1.0))
    placed = running_totals(marked, "__hash", "__one", descending=False)
    out = placed.withColumn("batch", F.floor(F.col("before___one") / size)).drop("__hash", "__one", "before___one")
    return out.where(F.col("batch") < n // size) if n >= size else out


def best_epoch(epochs: DataFrame, metric: str = "pr_auc", epoch: str = "epoch", by: tuple[str, ...] = ()) -> DataFrame:
    """The epoch of the first maximum above 0, of each run (``by``); no row if there is none."""
    top = epochs.where(F.col(metric) > 0).groupBy(*by).agg(F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"), F.max(metric).alias("best_metric"))
    return top.where(F.col("best_epoch").isNotNull())
