"""Derived arrays kept up to date by signed changes: a change touches the counts of what it changes, and nothing else.

A change is a row with `sign`: +1 for one that comes, -1 for one that goes; an update is both. A view is a table of
counts (keys, value, n): how many rows give a value to a key. Counts add up, so a batch of changes is one small
aggregation; a value leaves its array when its count reaches zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The signed rows that turn the bag `before` into the bag `after`."""
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    net = both.groupBy(*before.columns).agg(F.sum("sign").cast("int").alias("sign"))
    return net.where("sign <> 0")


def joined_changes(left: DataFrame, left_changes: DataFrame, right: DataFrame, right_changes: DataFrame, on: list[str]) -> DataFrame:
    """The signed changes of a join: changes of the left meet the right before, the left after meets changes of the right.

    `left` is the side after its changes, `right` that before its own; both sides are read for the changed keys only.
    """
    a = left_changes.withColumnRenamed("sign", "_s").join(right.join(left_changes.select(*on).distinct(), on, "left_semi"), on).withColumnRenamed("_s", "sign")
    near = left.join(right_changes.select(*on).distinct(), on, "left_semi")
    b = near.join(right_changes, on)
    return a.unionByName(b.select(a.columns))


def counted_changes(signed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, d): by how much each count changes; rows without a value count nowhere."""
    return signed.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum("sign").cast("long").alias("d")).where("d <> 0")


def touched_counts(counts: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n) of the counts that `delta` touches, zeros included, for an upsert; others are not read into it."""
    on = [*keys, value]
    old = counts.join(delta.select(*on), on, "left_semi").select(*on, "n")
    both = old.unionByName(delta.select(*on, F.col("d").alias("n")))
    return both.groupBy(*on).agg(F.sum("n").alias("n"))


def arrays_of(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the values that count at least once, in order."""
    return counts.where("n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def with_fallback(counts: DataFrame, keys: list[str], value: str, levels: list[str], name: str) -> DataFrame:
    """(keys, name, level): the values of the first level, in this order, that has any; `counts` has a column `level`."""
    sets = counts.where("n > 0").groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(F.col("level") == x, F.col(value)))).alias(f"_{i}") for i, x in enumerate(levels)))
    chosen = level = None
    for i, x in enumerate(levels):
        some = F.size(f"_{i}") > 0
        chosen = F.when(some, F.col(f"_{i}")) if chosen is None else chosen.when(some, F.col(f"_{i}"))
        level = F.when(some, x) if level is None else level.when(some, x)
    return sets.select(*keys, chosen.alias(name), level.alias("level"))


class CountedView:
    """Counts in a committed table, to which numbered batches of signed rows are added once each."""

    def __init__(self, store, keys: list[str], value: str):
        self.store, self.keys, self.value = store, keys, value

    def add(self, signed: DataFrame, batch: int) -> bool:
        """Adds a batch; False if it was added before. Only buckets of touched counts are read and written."""
        if self.store.is_committed(batch):
            return False
        delta = counted_changes(signed, self.keys, self.value)
        now = touched_counts(self.store.read(), delta, self.keys, self.value).persist()
        try:
            if now.where("n < 0").limit(1).count():
                raise ValueError("a count below zero: changes take away what was never there")
            return self.store.upsert(now.where("n > 0"), batch, deleted=now.where("n = 0"))
        finally:
            now.unpersist()

    def arrays(self, name: str) -> DataFrame:
        return arrays_of(self.store.read(), self.keys, self.value, name)
