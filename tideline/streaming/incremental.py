"""Structured Streaming forms: exactly-once arrivals, coalesced jobs, sessions, and re-segmentation of what late data touches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.graph import cut

PAD_HOURS = 6
#: Spans of time that are sent to all tasks, so that history isn't shuffled to meet them.
SPANS = 200_000


def arrivals_once(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first arrival of each (device, local id), as long as repeats come within `late`."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str = "20 minutes", late: str = "1 hour", contributor: str = "user_id") -> DataFrame:
    """Gap-separated sessions with their size and contributors, emitted once the watermark has passed them.

    This is the gap-only approximation of segments. Contributors are counted exactly; a session's state holds their set.
    """
    window = F.session_window(ts, gap)
    out = stream.withWatermark(ts, late).groupBy(*keys, window).agg(F.count("*").alias("n_items"), F.size(F.collect_set(contributor)).cast("long").alias("n_contributors"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_items", "n_contributors")


_STATE = "from_us long, to_us long, priority long, person long, mixed boolean, n long"
_JOB = "dedupe_key string, from_us long, to_us long, priority long, person long, n_requests long"


def coalesced(stream: DataFrame, debounce_ms: int = 60_000) -> DataFrame:
    """Jobs of a stream of (dedupe_key, us, person, priority) requests: one per key after it has been quiet.

    Each key holds one small state row: widest range, highest priority, and the person while all requests agree.
    """

    def fold(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            low, high, priority, person, mixed, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], low, high, priority, None if mixed else person, n)], columns=["dedupe_key", "from_us", "to_us", "priority", "person", "n_requests"])
            return
        low, high, priority, person, mixed, n = state.get if state.exists else (None, None, None, None, False, 0)
        for rows in batches:
            us, people = rows["us"], rows["person"]
            low = int(us.min()) if low is None else min(low, int(us.min()))
            high = int(us.max()) if high is None else max(high, int(us.max()))
            priority = int(rows["priority"].max()) if priority is None else max(priority, int(rows["priority"].max()))
            own = {None if pd.isna(p) else int(p) for p in people} | ({person} if n else set())
            mixed = mixed or len(own) > 1
            person = own.pop() if len(own) == 1 else None
            n += len(rows)
        state.update((low, high, priority, person, mixed, n))
        state.setTimeoutDuration(debounce_ms)

    return stream.groupBy("dedupe_key").applyInPandasWithState(fold, _JOB, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _islands(spans: DataFrame, group: str, kept: str | None = None) -> DataFrame:
    """(group, lo, hi) spans with those that touch joined; with a flag only those that hold a flagged one."""
    order = Window.partitionBy(group).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") <= reach, 0).otherwise(1)
    numbered = spans.withColumn("_new", new).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    if kept is None:
        return numbered.groupBy(group, "_no").agg(*ends).drop("_no")
    return numbered.groupBy(group, "_no").agg(*ends, F.max(kept).alias(kept)).where(kept).drop("_no", kept)


def widened_spans(arrived: DataFrame, events: DataFrame | None, group: str, us: str, pad_hours: int = PAD_HOURS) -> DataFrame:
    """(group, lo, hi): the time within `pad_hours` of new rows, widened to whole events until nothing grows.

    events: (group, start_us, end_us) as they stand. The spans of up to SPANS new rows meet events by buckets of the pad's
    width, then by overlap, round by round. Of more new rows, spans and events are joined to islands in one pass, so that
    events are sent on once, and not in each round to all of their buckets.
    """
    width = pad_hours * 3_600_000_000
    opened = arrived.select(group, (F.col(us) - width).alias("lo"), (F.col(us) + width).alias("hi"))
    if events is not None and arrived.limit(SPANS + 1).count() > SPANS:
        whole = events.where(F.col(group).isNotNull() & (F.col("start_us") <= F.col("end_us")))
        spans = opened.withColumn("_kept", F.lit(True)).unionByName(whole.select(group, F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), F.lit(False).alias("_kept")))
        return _islands(spans, group, "_kept")
    spans = cut(_islands(opened, group))
    if events is None:
        return spans
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    reach = events.select(group, "start_us", "end_us").withColumn("_b", buckets("start_us", "end_us"))
    while True:
        near = spans.withColumn("_b", buckets("lo", "hi")).join(reach, [group, "_b"]).where("start_us <= hi AND end_us >= lo")
        grown = near.groupBy(group, "lo", "hi").agg(F.min("start_us").alias("_s"), F.max("end_us").alias("_e")).where("_s < lo OR _e > hi")
        grown = cut(grown.select(group, F.least("lo", "_s").alias("lo"), F.greatest("hi", "_e").alias("hi")))
        if grown.isEmpty():
            return spans
        spans = cut(_islands(spans.unionByName(grown), group))


def affected_items(history: DataFrame, arrived: DataFrame, group: str, us: str, pad_hours: int = PAD_HOURS, events: DataFrame | None = None) -> DataFrame:
    """Rows of history that new rows of their group may regroup: those within `pad_hours`, and within all events that
    these or each other's spans cut (see widened_spans), so that no event is judged from its middle."""
    width = pad_hours * 3_600_000_000
    spans = widened_spans(arrived, events, group, us, pad_hours)
    near = cut(spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))))
    if near.limit(SPANS + 1).count() <= SPANS:  # then history is filtered where it lies; else it meets them by a shuffle
        near = F.broadcast(near)
    rows = history.withColumn("_b", F.floor(F.col(us) / width))
    return rows.join(near, [group, "_b"]).where(F.col(us).between(F.col("lo"), F.col("hi"))).select(history.columns)


def resegment_on_arrival(
    stream: DataFrame, history: Callable[[], DataFrame], segmenter: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], group: str, us: str,
    events: Callable[[], DataFrame] | None = None, key: str = "id",
):
    """A writer that recomputes the segments that each micro-batch touches and hands them to `write` with the batch's number.

    history() gives the rows before the batch, best from a table partitioned or sorted by group and time, and events()
    the (group, start_us, end_us) of their events. `write` replaces the rows of these items; as it gets the batch's
    number, a repeated batch can be told apart. Of history only what lies in the touched spans is read on; rows that arrive
    again, by `key`, replace those there, so that a batch may come twice. Rows of history that are equal stay apart.
    """

    def batch(arrived: DataFrame, number: int) -> None:
        arrived = arrived.persist()
        try:
            if not arrived.isEmpty():
                near = affected_items(history(), arrived, group, us, events=events() if events else None)
                new = arrived.dropDuplicates([key])
                write(segmenter(near.join(new.select(key), key, "left_anti").select(arrived.columns).unionByName(new)), number)
        finally:
            arrived.unpersist()

    return stream.writeStream.foreachBatch(batch)


def refreshed_views(changed: DataFrame, rows: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Derived rows of the changed keys only: the batch form of statement triggers."""
    return build(rows.join(changed.select(key).distinct(), key, "left_semi"))
