"""From scores to calls: back-transform, z-scores, percentiles, tiers and summaries, per alignment."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.functions.codon import back_transform, round_even
from clademill.operators.metrics import running_totals

NEUTRAL, TIER_1, TIER_2 = "Neutral", "Tier 1 (High)", "Tier 2 (Medium)"


@dataclass(frozen=True)
class Tiers:
    """Thresholds of calls. The gates widen a call: a site passes by its percentile (or z-score) or by its LRT; a negative gate is off."""

    percentile_1: float = 98.0
    percentile_2: float = 97.0
    z_1: float = 2.5
    z_2: float = 2.0
    use_z: bool = False
    gate_1: float = 5.0
    gate_2: float = 3.0


def _joined(rows: DataFrame, known: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` with what is ``known`` for their ``names``, in which nulls are equal."""
    other = known.withColumnsRenamed({n: f"__of_{n}" for n in names})
    same = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names), F.lit(True))
    return rows.join(other, same).drop(*(f"__of_{n}" for n in names))


def with_percentile(rows: DataFrame, value: str, *by: str, out: str = "percentile") -> DataFrame:
    """Adds the mean rank of ties over the count, in percent, among rows alike in ``by``.

    Ties are counted before they shuffle, and ranks are running totals over ranges of (``by``, value) less the key's beginning, so a key that
    holds all rows is spread over as many tasks as there are ranges. What is known of a tie meets its rows in a join that can be split."""
    ties = rows.groupBy(*by, value).agg(F.count("*").cast("double").alias("__n"))
    ranked = running_totals(ties.withColumn("__place", F.struct(*by, value)), "__place", "__n", descending=False).drop("__place")
    keys = ranked.groupBy(*by).agg(F.min("before___n").alias("__start"), F.sum("__n").alias("__total"))
    ranked = _joined(ranked, keys, by)
    share = (F.col("before___n") - F.col("__start") + (F.col("__n") + 1) / 2.0) / F.col("__total") * 100.0
    return _joined(rows, ranked.select(*by, value, share.alias(out)), (*by, value))


def with_z_score(rows: DataFrame, value: str, *by: str, out: str = "z") -> DataFrame:
    """Adds the z-score among rows alike in ``by``, by the population's deviation; 0 where that is 0. Means are combined before they shuffle, one
    row a key comes back."""
    keys = rows.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__deviation"))
    score = F.coalesce((F.col(value) - F.col("__mean")) / F.nullif(F.col("__deviation"), F.lit(0.0)), F.lit(0.0))
    return _joined(rows, keys, by).withColumn(out, score).drop("__mean", "__deviation")


def tier_call(variable: Column, percentile: Column, z: Column, lrt: Column, tiers: Tiers = Tiers()) -> Column:
    first, second = (z >= tiers.z_1, z >= tiers.z_2) if tiers.use_z else (percentile >= tiers.percentile_1, percentile >= tiers.percentile_2)
    if tiers.gate_1 >= 0:
        first = first | (lrt >= tiers.gate_1)
    if tiers.gate_2 >= 0:
        second = second | (lrt >= tiers.gate_2)
    return F.when(variable & first, TIER_1).when(variable & second, TIER_2).otherwise(NEUTRAL)


def call_sites(sites: DataFrame, aln_id: str = "aln_id", tiers: Tiers = Tiers()) -> DataFrame:
    """Adds ``predicted_log_lrt, predicted_lrt, local_z_score, local_percentile, selection_call`` to sites with ``is_variable`` and
    ``score``. Z-scores and percentiles are taken over the alignment's variable sites, from rounded values, and are 0 elsewhere."""
    variable = F.col("is_variable") == 1
    out = sites.withColumn("predicted_log_lrt", round_even(F.when(variable, F.col("score")).otherwise(F.lit(0.0)), 5))
    out = out.withColumn("predicted_lrt", round_even(back_transform(F.when(variable, F.col("score")), variable), 5)).drop("score")
    by = (aln_id, "is_variable")
    out = with_z_score(out, "predicted_lrt", *by, out="local_z_score")
    out = out.withColumn("local_z_score", F.when(variable, round_even(F.col("local_z_score"), 4)).otherwise(F.lit(0.0)))
    out = with_percentile(out, "predicted_lrt", *by, out="local_percentile")
    out = out.withColumn("local_percentile", F.when(variable, round_even(F.col("local_percentile"), 2)).otherwise(F.lit(0.0)))
    columns = [*(c for c in out.columns if c not in ("local_z_score", "local_percentile")), "local_z_score", "local_percentile"]
    return out.select(*columns).withColumn("selection_call", tier_call(variable, F.col("local_percentile"), F.col("local_z_score"), F.col("predicted_lrt"), tiers))


def summarise(predictions: DataFrame, aln_id: str = "aln_id") -> DataFrame:
    """Counts, means, maximum and tier counts over all sites of each alignment, invariant ones included."""
    return predictions.groupBy(aln_id).agg(
        F.count("*").alias("n_sites"),
        F.avg("predicted_log_lrt").alias("mean_log_lrt"),
        F.avg("predicted_lrt").alias("mean_lrt"),
        F.max("predicted_lrt").alias("max_lrt"),
        F.count_if(F.col("selection_call") == TIER_1).alias("n_tier_1"),
        F.count_if(F.col("selection_call") == TIER_2).alias("n_tier_2"),
    )


def called_sites(predictions: DataFrame, aln_id: str = "aln_id", site: str = "codon_site") -> DataFrame:
    """Sites that aren't neutral, highest percentile first."""
    return predictions.where(F.col("selection_call") != NEUTRAL).orderBy(aln_id, F.desc("local_percentile"), site)


def summarise_levels(predictions: DataFrame, aln_id: str = "aln_id") -> DataFrame:
    """``level, <aln_id>, selection_call`` and ``n, n_variable, mean_lrt, max_lrt``: by alignment and call, by alignment, by call, and in total, in one pass.

    ``level`` tells them apart (the grouping id: 0 both, 1 alignment, 2 call, 3 total), as a null may also be a value."""
    sets = predictions.groupingSets([[aln_id, "selection_call"], [aln_id], ["selection_call"], []], aln_id, "selection_call")
    found = sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(F.col("is_variable") == 1).alias("n_variable"), F.avg("predicted_lrt").alias("mean_lrt"), F.max("predicted_lrt").alias("max_lrt"))
    return found.select("level", aln_id, "selection_call", "n", "n_variable", "mean_lrt", "max_lrt")


#: Size parameter of quantile sketches; ranks are off by less than 1 % in nearly all cases at this size, whatever the number of rows.
SKETCH_K = 400


def lrt_sketches(predictions: DataFrame, aln_id: str = "aln_id") -> DataFrame:
    """``<aln_id>, n, quantiles``: a sketch of the variable sites' LRT of each alignment, to be stored and merged with those of other runs."""
    lrt = F.when(F.col("is_variable") == 1, F.col("predicted_lrt"))
    return predictions.groupBy(aln_id).agg(F.count(lrt).alias("n"), F.kll_sketch_agg_double(lrt, F.lit(SKETCH_K)).alias("quantiles"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of several runs or alignments as one for each ``by``; alike for any order of merging, within the error bound."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles", F.lit(SKETCH_K)).alias("quantiles"))


def sketch_quantiles(sketches: DataFrame, *shares: float) -> DataFrame:
    """``sketches`` with ``values``: the approximate LRT at each of ``shares``; null for a sketch without a row."""
    found = F.kll_sketch_get_quantile_double("quantiles", F.array(*(F.lit(float(s)) for s in shares)))
    return sketches.withColumn("values", F.when(F.col("n") > 0, found)).drop("quantiles")
