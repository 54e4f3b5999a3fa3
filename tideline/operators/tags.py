"""Calibrated tag statistics: votes over an event, robust scores per tag, dominant tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import sigmoid

#: A tag is present from PRESENT on; floor of the robust scale; midpoint and slope of the score.
PRESENT, FLOOR, MID, SLOPE = 0.6, 0.008, 2.25, 1.6


def tag_votes(tagged: DataFrame, event: str, asset: str, tag: str, score: str, position: str, assets: DataFrame, n_assets: str) -> DataFrame:
    """(event, tag, hits, coverage, mean_score): share of the event's assets that show the tag.

    Of several present entries of a tag on an asset the first counts. `assets` has (event, n_assets).
    """
    first = tagged.where(F.col(score) >= PRESENT).groupBy(event, asset, tag).agg(F.min_by(score, position).alias("_s"))
    votes = first.groupBy(event, tag).agg(F.count("*").alias("hits"), F.avg("_s").alias("mean_score"))
    return votes.join(assets, event).withColumn("coverage", F.col("hits") / F.col(n_assets)).drop(n_assets)


def dominant_tag(votes: DataFrame, event: str, tag: str, rank: Column, least: float) -> DataFrame:
    """Per event the tag of the best-ranked category, then of the highest coverage and mean score; coverage >= least."""
    key = F.struct(rank.alias("r"), (-F.col("coverage")).alias("c"), (-F.col("mean_score")).alias("m"), F.col(tag).alias("t"))
    return votes.where(F.col("coverage") >= least).groupBy(event).agg(F.min(key).alias("_k")).select(event, F.col("_k.t").alias(tag))


def robust_stats(raw: DataFrame, tag: str, value: str) -> DataFrame:
    """(tag, median, scale, n): scale is 1.4826 times the median absolute deviation, FLOOR at least."""
    centre = raw.groupBy(tag).agg(F.median(value).alias("median"))
    spread = raw.join(centre, tag).groupBy(tag).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("_mad"), F.count("*").alias("n"))
    return spread.withColumn("scale", F.greatest(1.4826 * F.col("_mad"), F.lit(FLOOR))).drop("_mad")


def calibrated(raw: DataFrame, stats: DataFrame, tag: str, value: str) -> DataFrame:
    """Adds z and score from a tag's statistics."""
    z = (F.col(value) - F.col("median")) / F.col("scale")
    return raw.join(stats, tag).withColumn("z", z).withColumn("score", sigmoid(SLOPE * (F.col("z") - MID)))


def tag_result(scored: DataFrame, asset: str, tag: str, category: str, top: int = 8, most: int = 16) -> DataFrame:
    """An asset's tags: its `top` best and any that is present, `most` in all; categories named quality are left out."""
    rank = F.row_number().over(Window.partitionBy(asset).orderBy(F.desc("score"), tag))
    rows = scored.where(F.col(category) != "quality").withColumn("rank", rank)
    return rows.where(((F.col("rank") <= top) | (F.col("score") >= PRESENT)) & (F.col("rank") <= most))
