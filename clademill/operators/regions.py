"""Sites and stretches of an alignment: which annotated regions a site lies in, and runs of neighbouring sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.plans.storage import written

#: Cells of the finest level have 2 to this power of sites; each level above is eight times as wide.
FINEST, STEP, COARSEST = 4, 3, 61


def _cell(site: Column, level: Column) -> Column:
    return F.call_function("shiftright", site.cast("long"), level)


def in_regions(sites: DataFrame, regions: DataFrame, by: str = "aln_id", site: str = "codon_site", start: str = "start", end: str = "end") -> DataFrame:
    """``sites`` with the columns of each of ``regions`` (but ``by``) that they lie in, both ends included; columns have to differ in name.

    A region goes to the finest level of cells of which it meets two at most, so a long one makes no more rows than a short one; a site is looked up once for each level
    that occurs. Cells are an equi-join, which can be split where one is hot, and ends are compared exactly. Rows with a null and regions that end before they start meet nothing.
    """
    own = regions.where(F.col(start) <= F.col(end))
    steps = F.sequence(F.lit(FINEST), F.lit(COARSEST), F.lit(STEP))
    fits = F.filter(steps, lambda x: _cell(F.col(end), x) - _cell(F.col(start), x) <= 1)
    own = own.withColumn("__level", F.get(fits, F.lit(0)))
    cells = F.array_distinct(F.array(_cell(F.col(start), F.col("__level")), _cell(F.col(end), F.col("__level"))))
    own = written(own.withColumn("__cell", F.explode(cells)), "regions")
    levels = [r[0] for r in own.select("__level").distinct().collect()]  # twenty at most
    if not levels:
        levels = [FINEST]
    probes = sites.withColumn("__level", F.explode(F.array(*(F.lit(x) for x in sorted(levels))))).withColumn("__cell", _cell(F.col(site), F.col("__level")))
    met = probes.join(own, [by, "__level", "__cell"]).where(F.col(site).between(F.col(start), F.col(end)))
    return met.select(*sites.columns, *(c for c in regions.columns if c != by))


def runs(sites: DataFrame, distance: int, by: str = "aln_id", site: str = "codon_site", parts: int | None = None) -> DataFrame:
    """``by, first, last, n`` of each run: sites of which none is more than ``distance`` beyond the one before it. ``n`` counts rows; repeated sites are one
    place. A null site is in no run.

    Sites are dealt out by range and looked at in order within each; what a range's first site follows, and how many runs begin before a range, is one row a
    range. So a run may go on over any number of ranges, and no task holds a whole alignment.
    """
    spark = sites.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = sites.where(F.col(site).isNotNull()).select(F.col(by).alias("k"), F.col(site).cast("long").alias("at"))
    placed = written(placed.repartitionByRange(parts, "k", "at").withColumn("part", F.spark_partition_id()), "placed")
    own, over = Window.partitionBy("part").orderBy("k", "at"), Window.orderBy("part")
    ends = placed.groupBy("part").agg(F.max(F.struct(F.col("k").isNotNull().alias("some"), "k", "at")).alias("end"))
    before = ends.select("part", F.lag("end").over(over).alias("before"))
    here = F.struct(F.col("k").isNotNull().alias("some"), "k", "at")
    seen = placed.withColumn("previous", F.lag(here).over(own)).join(F.broadcast(before), "part")  # one row a range
    last = F.coalesce("previous", "before")
    opens = (last.isNull() | ~last["k"].eqNullSafe(F.col("k")) | (F.col("at") - last["at"] > distance)).cast("long")
    flagged = written(seen.select("part", "k", "at", opens.alias("opens")), "flagged")
    sums = flagged.groupBy("part").agg(F.sum("opens").alias("opens"))
    base = sums.select("part", F.coalesce(F.sum("opens").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    told = flagged.join(F.broadcast(base), "part").select("k", "at", number.alias("run"))
    return told.groupBy("k", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).select(F.col("k").alias(by), "first", "last", "n")
