"""Edits as an ordered log, folded to the state at any position.

An edit has a position, unique and ascending, the id that it changes, and a kind: `set` gives a field a value (null takes
it back), `delete` ends an id, `merge` ends it in favour of `target`. What comes after an id's end changes nothing, nor does
a merge into an id that has ended before. So each id has one end, the first edit that could end it, and each field's value
is the last one set before; both are aggregates of the log, in any order of rows. Only ends that hang on other ends take
rounds: as many as merges into merged ids stand one upon another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.graph import cut, stored

SCHEMA = "pos long, id long, kind string, field string, value string, target long"


def ends(edits: DataFrame) -> DataFrame:
    """(id, end, into): where an id ends, and the id that it was merged into, or null for a deleted one."""
    deletes = edits.where("kind = 'delete'").select("id", "pos", F.lit(None).cast("long").alias("into"))
    merges = cut(edits.where("kind = 'merge' AND target IS NOT NULL AND id <> target").select("id", "pos", F.col("target").alias("into")))
    deletes = cut(deletes.groupBy("id").agg(F.min("pos").alias("pos")).withColumn("into", F.lit(None).cast("long")).select("id", "pos", "into"))

    def settled(valid: DataFrame) -> DataFrame:
        first = deletes.unionByName(valid).groupBy("id").agg(F.min(F.struct("pos", "into")).alias("_f"))
        return stored(first.select("id", F.col("_f.pos").alias("end"), F.col("_f.into").alias("into")))

    now = settled(merges)
    while True:
        alive = now.select(F.col("id").alias("into"), F.col("end").alias("_end"))
        new = settled(merges.join(alive, "into", "left").where("_end IS NULL OR pos < _end").select("id", "pos", "into"))
        if now.exceptAll(new).isEmpty() and new.exceptAll(now).isEmpty():
            return new
        now = new


def survivors(ended: DataFrame) -> DataFrame:
    """(id, survivor): the id that a merged one lives on in, at the end of its chain of merges; null if that was deleted."""
    links = stored(ended.where("into IS NOT NULL").select("id", "into"))
    deleted = ended.where("into IS NULL").select(F.col("id").alias("into"), F.lit(True).alias("_gone"))
    while True:
        further = links.select(F.col("id").alias("into"), F.col("into").alias("_far"))
        new = stored(links.join(further, "into", "left").select("id", F.coalesce("_far", "into").alias("into"), F.col("_far").isNotNull().alias("_moved")))
        links = new.select("id", "into")
        if new.where("_moved").isEmpty():
            return links.join(deleted, "into", "left").select("id", F.when(F.col("_gone").isNull(), F.col("into")).alias("survivor"))


def folded(edits: DataFrame, upto: int | None = None) -> DataFrame:
    """(id, fields map, merged_into, deleted, last): the state of every id of the log after the edit at `upto`, or after all.

    `fields` leaves out what was taken back; `last` is the position of the last edit that changed the id. `merged_into` is
    the id that lives on, null where there is none.
    """
    log = edits if upto is None else edits.where(F.col("pos") <= upto)
    log = cut(log.select("pos", "id", "kind", "field", "value", "target"))
    ended = ends(log)
    live = log.where("kind = 'set' AND field IS NOT NULL").join(ended.select("id", "end"), "id", "left").where("end IS NULL OR pos < end")
    last = live.groupBy("id", "field").agg(F.max(F.struct("pos", "value")).alias("_v")).select("id", "field", F.col("_v.pos").alias("pos"), F.col("_v.value").alias("value"))
    kept = F.filter(F.collect_list(F.struct("field", "value")), lambda e: e["value"].isNotNull())
    fields = last.groupBy("id").agg(F.map_from_entries(F.array_sort(kept)).alias("fields"), F.max("pos").alias("_last"))
    rows = log.select("id").distinct().join(fields, "id", "left").join(ended, "id", "left").join(survivors(ended), "id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select(
        "id", F.coalesce("fields", none).alias("fields"), F.col("survivor").alias("merged_into"),
        (F.col("end").isNotNull() & F.col("into").isNull()).alias("deleted"), F.greatest("_last", "end").alias("last"),
    )


def redirected(rows: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """Rows with ids of merged entities pointed at those they live on in; rows of deleted ones go."""
    known = state.select(F.col("id").alias(column), "merged_into", "deleted", F.col("last").isNotNull().alias("_known"))
    both = rows.join(known, column, "left").where("NOT coalesce(deleted, false)")
    return both.withColumn(column, F.coalesce("merged_into", column)).select(rows.columns)
