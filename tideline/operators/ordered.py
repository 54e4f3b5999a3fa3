"""Ordered analytics without one task per group: rows are numbered in two levels, then windows run over bounded blocks.

A plain window over a group sorts the whole group in one task. Here each group is cut into time buckets; row numbers
come from ranks within buckets plus running bucket counts, and running sums from block sums. A frame of a few rows
needs its block and a halo of neighbouring rows only, so the largest task holds a block, whatever share of all rows
its group has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_US = 6 * 3600 * 1_000_000
#: Rows of a block of running sums, and of one of frames: smaller, for more even tasks; its halo is below a hundredth.
BLOCK, FRAME_BLOCK = 20_000, 2_000


def with_row_index(items: DataFrame, group: str, us: str, tie: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """Adds `ix`: 0, 1, 2, ... within each group, by (us, tie)."""
    items = items.withColumn("_bucket", F.floor(F.col(us) / bucket_us))
    counts = items.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(us, tie))
    return items.withColumn("_rank", rank).join(counts, [group, "_bucket"]).withColumn("ix", F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_rank", "_before")


def with_halo(items: DataFrame, group: str, before: int, after: int, size: int = FRAME_BLOCK) -> DataFrame:
    """Adds `block` and `own`: each row in its own block, and copies where a neighbouring block's frames reach it."""
    own, at = F.floor(F.col("ix") / size), F.col("ix") % size
    blocks = F.array(own, F.when(at < after, own - 1), F.when(at >= size - before, own + 1))
    out = items.withColumn("_own", own).withColumn("block", F.explode(F.filter(blocks, lambda b: b.isNotNull() & (b >= 0))))
    # A number of its own keeps adaptive execution from merging these few bytes, but much work, into one task.
    out = out.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "block")
    return out.withColumn("own", F.col("block") == F.col("_own")).drop("_own")


def running_sum(items: DataFrame, group: str, value: str, out: str, size: int = BLOCK) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group up to this one; needs `ix`."""
    items = items.withColumn("_block", F.floor(F.col("ix") / size))
    sums = items.groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(group, "_block").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    out_col = F.col("_before") + F.sum(value).over(inside)
    return items.join(sums, [group, "_block"]).withColumn(out, out_col).drop("_block", "_before")


def carried(items: DataFrame, group: str, value: str, size: int = BLOCK) -> DataFrame:
    """Adds `before` and `after`: the value of the row itself, or else the last one before and the next one after it that
    isn't null; needs `ix`."""
    items = items.withColumn("_block", F.floor(F.col("ix") / size))
    known = F.when(F.col(value).isNotNull(), F.col("ix"))
    ends = items.groupBy(group, "_block").agg(F.max_by(value, known).alias("_end"), F.min_by(value, known).alias("_start"))
    others = (Window.unboundedPreceding, -1)
    prev = F.last("_end", ignorenulls=True).over(Window.partitionBy(group).orderBy("_block").rowsBetween(*others))
    nxt = F.last("_start", ignorenulls=True).over(Window.partitionBy(group).orderBy(F.desc("_block")).rowsBetween(*others))
    ends = ends.select(group, "_block", prev.alias("_prev"), nxt.alias("_next"))
    rows = items.join(ends, [group, "_block"])
    upto = (Window.unboundedPreceding, 0)
    inside = [F.last(value, ignorenulls=True).over(Window.partitionBy(group, "_block").orderBy(o).rowsBetween(*upto)) for o in (F.asc("ix"), F.desc("ix"))]
    return rows.withColumns({"before": F.coalesce(inside[0], "_prev"), "after": F.coalesce(inside[1], "_next")}).drop("_block", "_prev", "_next")
