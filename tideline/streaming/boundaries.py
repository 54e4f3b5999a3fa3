"""Boundary scoring in the stream: cuts as the batch form scores them, with a bounded state per group.

A row is final once the watermark has passed it. A boundary between two final rows is decided when its whole right window
is final, too; then no later row can change it. The state of a group holds rows that aren't final yet, and of the final
ones those that the windows of undecided boundaries reach: 2 * WINDOW rows, whatever has gone by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.timeline import CUT, HARD_GAP, TAU_MAX, TAU_MIN, TAU_TIMES, WEIGHTS, WINDOW

_NAMES = ["left_id", "right_id", "left_us", "right_us", "minutes", "tau", "gap", "contrib", "score", "cut"]
_DDL = "left_id long, right_id long, left_us long, right_us long, minutes double, tau double, gap double, contrib double, score double, cut boolean"
_ROW = "us long, id long, who long"


def decided(rows: list[tuple[int, int, int]], at: int) -> tuple:
    """The boundary after row `at` of ordered rows (us, id, contributor): its terms, score and cut."""
    gaps = [(b[0] - a[0]) / 60e6 for a, b in zip(rows, rows[1:])]
    near = sorted(g for g in gaps[max(0, at - WINDOW + 1) : at + WINDOW] if g > 0)
    median = (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2 if near else TAU_MIN
    tau = min(TAU_MAX, max(TAU_MIN, TAU_TIMES * median))
    minutes = gaps[at]
    gap = 1.0 if minutes > HARD_GAP else 1.0 / (1.0 + math.exp(-(minutes - tau) / (tau / 2)))
    left = {r[2] for r in rows[max(0, at - WINDOW + 1) : at + 1]} - {None}
    right = {r[2] for r in rows[at + 1 : at + 1 + WINDOW]} - {None}
    contrib = 1 - (len(left & right) / len(left | right) if left | right else 1.0)
    terms, score = {"gap": gap, "contrib": contrib}, 0.0
    for name, weight in WEIGHTS.items():  # in the order of the batch form, so that sums at the threshold come out alike
        score += weight * terms.get(name, 0.5)
    (us, left_id, _), (right_us, right_id, _) = rows[at], rows[at + 1]
    return left_id, right_id, us, right_us, minutes, tau, gap, contrib, score, score >= CUT


class _Boundaries(StatefulProcessor):
    """State: `waiting` rows the watermark hasn't passed, `window` final rows, and how many of these are decided."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.window = handle.getListState("window", _ROW)
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            held = [(int(u), int(i), None if pd.isna(w) else int(w)) for u, i, w in zip(batch["us"], batch["id"], batch["who"], strict=True)]
            if held:
                self.waiting.appendList(held)
                low = min(r[0] for r in held)
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame({n: [] for n in ["grp", *_NAMES]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1_000
        rows = [(r[0], r[1], r[2]) for r in self.waiting.get()] if self.waiting.exists() else []
        final = sorted((r for r in rows if r[0] < until), key=lambda r: r[:2])
        later = [r for r in rows if r[0] >= until]
        if later:
            self.waiting.put(later)
            self._wake(min(r[0] for r in later), until // 1_000)
        else:
            self.waiting.clear()
        window = [(r[0], r[1], r[2]) for r in self.window.get()] if self.window.exists() else []
        at = self.next.get()[0] if self.next.exists() else 0
        window += final
        out = []
        while at + WINDOW < len(window):
            out.append((key[0], *decided(window, at)))
            at += 1
        drop = max(0, at - WINDOW + 1)  # the left window of the next boundary, and the gaps within it
        window, at = window[drop:], at - drop
        if window:
            self.window.put(window)
        self.next.update((at,))
        yield pd.DataFrame(out, columns=["grp", *_NAMES])

    def _wake(self, us: int, gone: int = -1) -> None:
        """Wakes when the watermark has passed this row. Of alarms after `gone`, which go off now, the earliest is enough."""
        at = us // 1_000 + 1
        for old in list(self.handle.listTimers()):
            if gone < old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def streamed_boundaries(stream: DataFrame, group: str, ts: str, key: str, contributor: str, late: str = "1 hour") -> DataFrame:
    """(group, left_id, right_id, times, terms, score, cut) of each boundary, once, as soon as no later row can change it.

    `group`, `key` and `contributor` are long. Terms that the stream doesn't carry (distance, people, pictures) count as
    absent. Rows later than `late` are dropped, as everywhere in the stream. Needs the RocksDB state store.
    """
    rows = stream.withWatermark(ts, late).select(F.col(group).cast("long").alias("grp"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(key).cast("long").alias("id"), F.col(contributor).cast("long").alias("who"))
    out = rows.groupBy("grp").transformWithStateInPandas(_Boundaries(), f"grp long, {_DDL}", "Append", "EventTime")
    return out.withColumnRenamed("grp", group)
