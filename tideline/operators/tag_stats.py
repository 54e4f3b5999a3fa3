"""Tag statistics that merge: quantile sketches per group and tag, added to batch by batch, so that nothing is read again.

A sketch stands for all values of a group's tag; its ranks are off by RANK_ERROR of its count at most, in 99 of 100 cases.
Median and median absolute deviation come from it with the bounds that this error leaves. Whether tags are due to be written
anew is decided by counts, exactly, or by drift of the statistics, where the answer may be that the bounds don't tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.tags import FLOOR

#: Pictures that statistics need, and the share of growth from which they are stale.
MIN_N, STALE = 40, 0.10
#: Size of a sketch, the error of its ranks, and the steps in which deviations are read off it.
K, RANK_ERROR, STEPS = 400, 2.296 / 400**0.9021, 400


def sketched(raw: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, sketch) of a batch; null values count nowhere."""
    rows = raw.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("sketch"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, sketch) of several batches' rows together, in any order and grouping."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))


def _at(rank: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, rank))))


def stats_of(sketches: DataFrame) -> DataFrame:
    """Adds median with its bounds, and scale (1.4826 times the median absolute deviation, FLOOR at least) with its own.

    Deviations are those of STEPS even ranks. A bound is the statistic at ranks moved by the error; a median that lies off
    by some moves deviations by as much.
    """
    ranks = F.array(*(F.lit((i + 0.5) / STEPS) for i in range(STEPS)))
    rows = sketches.withColumns({"median": _at(0.5), "median_low": _at(0.5 - RANK_ERROR), "median_high": _at(0.5 + RANK_ERROR), "_q": F.kll_sketch_get_quantile_double("sketch", ranks)})
    rows = rows.withColumn("_d", F.array_sort(F.transform("_q", lambda x: F.abs(x - F.col("median")))))

    def mad(rank: float) -> Column:
        return F.get("_d", F.lit(min(STEPS - 1, max(0, int(rank * STEPS)))))

    off = F.greatest(F.col("median_high") - F.col("median"), F.col("median") - F.col("median_low"))
    error = 2 * RANK_ERROR + 1 / STEPS
    scale = {"scale": mad(0.5), "scale_low": mad(0.5 - error) - off, "scale_high": mad(0.5 + error) + off}
    return rows.withColumns({n: F.greatest(1.4826 * c, F.lit(FLOOR)) for n, c in scale.items()}).drop("_q", "_d")


def retag_due(now: DataFrame, before: DataFrame, keys: list[str], min_n: int = MIN_N, stale: float = STALE) -> DataFrame:
    """(keys, n, due): groups of enough pictures that have no statistics yet, or whose number has changed by more than a
    tenth since these were made. Exact: counts are kept beside the sketches."""
    both = now.select(*keys, "n").join(before.select(*keys, F.col("n").alias("_was")), keys, "left")
    changed = F.col("_was").isNull() | (F.abs(F.col("n") - F.col("_was")) > stale * F.col("_was"))
    return both.select(*keys, "n", ((F.col("n") >= min_n) & changed).alias("due"))


def drifted(now: DataFrame, before: DataFrame, keys: list[str], times: float = 1.0) -> DataFrame:
    """(keys, drift): whether a median has moved by more than `times` the scale it had; null where the bounds don't tell.

    now, before: results of stats_of.
    """
    names = ("median", "median_low", "median_high", "scale_low", "scale_high")
    a = now.select(*keys, *(F.col(n).alias(f"_{n}") for n in names))
    both = a.join(before.select(*keys, *names), keys)
    least = F.greatest(F.lit(0.0), F.col("_median_low") - F.col("median_high"), F.col("median_low") - F.col("_median_high"))
    most = F.greatest(F.abs(F.col("_median_high") - F.col("median_low")), F.abs(F.col("median_high") - F.col("_median_low")))
    return both.select(*keys, F.when(least > times * F.col("scale_high"), True).when(most <= times * F.col("scale_low"), False).alias("drift"))
