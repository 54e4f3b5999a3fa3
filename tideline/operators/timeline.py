"""Timeline boundaries and segments: gaps, adaptive tolerances, window terms, islands, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StructField, StructType

from tideline.functions.columns import centroid, clamp, dot, haversine_m, sigmoid
from tideline.operators.graph import FEW, cut, few
from tideline.operators.ordered import running_sum, with_halo, with_row_index

#: Rows of the left and right window, minutes and weights of the boundary score.
WINDOW = 8
TAU_MIN, TAU_MAX, TAU_TIMES, HARD_GAP = 20.0, 120.0, 4.0, 240.0
WEIGHTS = {"gap": 0.45, "dist": 0.20, "people": 0.15, "visual": 0.10, "contrib": 0.10}
CUT = 0.5
DIST_SCALE_M, TRAVEL_MINUTES, TRAVEL_KMH = 800.0, 30.0, 90.0
#: Weights of membership; metres within which a place counts wholly and beyond which it doesn't count.
MEMBER_WEIGHTS = {"interior": 0.35, "geo": 0.25, "people": 0.20, "visual": 0.10, "support": 0.10}
NEAR_M, FAR_M = 300.0, 2000.0


def with_segments(items: DataFrame, group: str, us: str, tie: str, gap_us: int) -> DataFrame:
    """Adds `segment`: a counter per group that steps up where the gap to the row before exceeds `gap_us`."""
    rows = with_halo(with_row_index(items, group, us, tie), group, before=1, after=0)
    gap = F.col(us) - F.lag(us).over(Window.partitionBy(group, "block").orderBy("ix"))
    rows = rows.withColumn("_cut", F.when(gap > gap_us, 1).otherwise(0)).where("own").drop("own", "block")
    return running_sum(rows, group, "_cut", "segment").drop("_cut", "ix")


def gap_segments(items: DataFrame, group: str, us: str, tie: str, contributor: str, gap_us: int) -> DataFrame:
    """One row per gap-separated segment with its size, contributors and extent."""
    return (
        with_segments(items, group, us, tie, gap_us)
        .groupBy(group, "segment")
        .agg(
            F.count("*").alias("n_items"),
            F.count_distinct(contributor).alias("n_contributors"),
            F.min(us).alias("start_us"),
            F.max(us).alias("end_us"),
        )
    )


def _shared(at: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Of each row: the distinct keys of its left window, of its right one, and of both.

    `key` occurs in row `at` and in one block only, which goes from row `low` to `high`. A key counts for the left window
    from its last occurrence there, for the right one from its first: each is a stretch of rows, summed by its two ends.
    """
    n, order = len(low), np.lexsort((at, key))
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    first, last = low[at], high[at]
    prev, follow = first - 1, last + 1
    prev[1:][same], follow[:-1][same] = at[:-1][same], at[1:][same]
    a, b = at[:-1][same], at[1:][same]
    left = at, np.minimum(np.minimum(at + WINDOW - 1, follow - 1), last)
    right = np.maximum(np.maximum(at - WINDOW, prev), first), at - 1
    both = np.maximum(a, b - WINDOW), np.minimum(b - 1, a + WINDOW - 1)
    out = []
    for start, end in (left, right, both):
        start, end = start[start <= end], end[start <= end]
        out.append(np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end + 1, minlength=n + 1))[:n])
    return out


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers of a column's values, null being one of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _frames(table: pa.Table, new: np.ndarray, us: str, names: list[str], gaps: bool, people: bool, placed: bool) -> pa.Table:
    """What the boundary after each of the blocks' own rows reads of both windows; `new` tells where a block starts."""
    n = table.num_rows
    block = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    low, high = starts[block], np.append(starts[1:], n)[block] - 1
    row = np.arange(n)
    time = table.column(us).to_numpy()
    nxt = np.minimum(row + 1, high)
    out = {"right_us": time[nxt], "_gap": (time[nxt] - time) / 60e6}
    if gaps:  # the median of the positive ones of both windows
        around = row[:, None] + np.arange(1 - WINDOW, WINDOW)
        gap = out["_gap"][np.clip(around, 0, n - 1)]
        gap = np.sort(np.where((around >= low[:, None]) & (around < high[:, None]) & (gap > 0), gap, np.inf), axis=1)
        k = np.isfinite(gap).sum(axis=1)
        middle = (gap[row, np.maximum(k - 1, 0) // 2] + gap[row, np.minimum(k // 2, gap.shape[1] - 1)]) / 2
        out["_median"] = pa.array(middle, mask=k == 0)
    known = np.asarray(table.column("_who").is_valid())
    one, two, both = _shared(row[known], (_codes(table.column("_who")) * len(starts) + block)[known], low, high)
    either = one + two - both
    out["_same"] = np.where(either == 0, 1.0, both / np.maximum(either, 1))
    if people:
        lists = table.column("_people").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        at = row[lists.is_valid().to_numpy(zero_copy_only=False)].repeat(np.asarray(lists.drop_null().value_lengths()))
        one, two, both = _shared(at, _codes(lists.flatten()) * len(starts) + block[at], low, high)
        none = (one == 0) | (two == 0)
        out["_met"] = pa.array(np.where(none, 0.0, both / np.maximum(one + two - both, 1)), mask=none)
    if placed:
        has = np.asarray(table.column("_x").is_valid())
        for side, steps in (("left", range(1 - WINDOW, 1)), ("right", range(1, WINDOW + 1))):
            sums, count = {v: np.zeros(n) for v in "xyz"}, np.zeros(n, np.int64)
            value = {v: table.column(f"_{v}").fill_null(0.0).to_numpy() for v in "xyz"}
            for k in steps:  # in the order of the rows, as a sum over the frame
                j = np.clip(row + k, 0, n - 1)
                inside = (row + k >= low) & (row + k <= high) & has[j]
                count += inside
                for v in "xyz":
                    sums[v] += np.where(inside, value[v][j], 0.0)
            out |= {f"_{side}_{v}": sums[v] / np.maximum(count, 1) for v in "xyz"} | {f"_{side}_n": count}
    own = np.asarray(table.column("own")) & (row < high)
    out = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()}
    told = table.select(names)
    tie = told.column(1).take(pa.array(nxt))
    for k, v in [("right_id", tie), *out.items()]:
        told = told.append_column(k, v)
    return told.filter(pa.array(own))


def _with_frames(rows: DataFrame, group: str, us: str, tie: str, contributor: str, people: str | None, more: list[str], gaps: bool) -> DataFrame:
    """Own rows of blocks that have a next one, with it and the windows' gaps, sets and mean positions (`_x`, `_y`, `_z`).

    Blocks come one after the other in a task; what a batch leaves of its last block waits for the next batch.
    """

    def flat(c: str) -> Column:
        whole = isinstance(rows.schema[c].dataType, (ArrayType, MapType, StructType))
        return F.when(F.col(c).isNotNull(), F.to_json(F.struct(c))) if whole else F.col(c)

    placed = "_x" in rows.columns
    names = [group, tie, us, "ix", *more]
    held = [flat(group).alias("_of"), flat(contributor).alias("_who"), *([F.col(people).alias("_people")] if people else []), *([F.col(f"_{v}") for v in "xyz"] if placed else [])]
    sorted_ = rows.sortWithinPartitions(group, "block", "ix").select(*names, "block", "own", *held)
    numbers = ["_gap", *(["_median"] if gaps else []), "_same", *(["_met"] if people else [])]
    sides = [(f"_{s}_{v}", LongType() if v == "n" else DoubleType()) for s in ("left", "right") for v in "xyzn"] if placed else []
    fields = [("right_id", rows.schema[tie].dataType), ("right_us", LongType()), *((c, DoubleType()) for c in numbers), *sides]
    shape = StructType([rows.schema[c] for c in names] + [StructField(c, t) for c, t in fields])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            of, block = _codes(table.column("_of")), table.column("block").to_numpy()
            new = np.r_[True, (of[1:] != of[:-1]) | (block[1:] != block[:-1])]
            end = int(np.flatnonzero(new)[-1])
            rest = table.slice(end)
            if end:
                yield from _frames(table.slice(0, end), new[:end], us, names, gaps, people is not None, placed).to_batches()
        if rest is not None and rest.num_rows:
            yield from _frames(rest, np.arange(rest.num_rows) == 0, us, names, gaps, people is not None, placed).to_batches()

    return sorted_.mapInArrow(run, shape)


def gap_term(minutes: Column, tau: Column) -> Column:
    """Beyond HARD_GAP the term is 1, which alone doesn't reach the threshold of a cut."""
    return F.when(minutes > HARD_GAP, 1.0).otherwise(sigmoid((minutes - tau) / (tau / 2)))


def boundaries(
    items: DataFrame, group: str, us: str, tie: str, contributor: str, people: str | None = None, lat: str | None = None, lon: str | None = None, emb: str | None = None, fixed_tau: float | None = None, scale_m: float = DIST_SCALE_M,
) -> DataFrame:
    """A row per pair of consecutive items of a group: terms, score and cut of the boundary between them.

    Each side is a window of WINDOW items at most. The tolerance tau follows the median positive gap of both windows.
    A term without evidence is 0.5: fewer than two positions, no people, no embeddings on a side. Columns of evidence
    that aren't given count as absent. Items that bear `ix` keep these numbers. Columns: group, left and right tie and time, ix, minutes, tau, terms, score, cut.
    """
    numbers = items if "ix" in items.columns else with_row_index(items, group, us, tie)
    rows = with_halo(numbers, group, before=WINDOW, after=WINDOW)
    order = Window.partitionBy(group, "block").orderBy("ix")
    left, right = order.rowsBetween(-(WINDOW - 1), 0), order.rowsBetween(1, WINDOW)
    if emb:
        a, b = (F.collect_list(emb).over(w) for w in (left, right))
        cross, within = _mean_dot(a, b), [_within(v) for v in (a, b)]
        mean = (F.coalesce(within[0], F.lit(0.0)) + F.coalesce(within[1], F.lit(0.0))) / F.nullif(
            within[0].isNotNull().cast("int") + within[1].isNotNull().cast("int"), F.lit(0)
        )
        rows = rows.withColumn("_visual", F.coalesce(clamp(0.5 + (mean - cross) * 2), F.lit(0.5)))
    if lat and lon:
        la, lo = F.radians(lat), F.radians(lon)
        rows = rows.withColumns({"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.when(F.col(lon).isNotNull(), F.sin(la))})
    rows = _with_frames(rows, group, us, tie, contributor, people, ["_visual"] if emb else [], fixed_tau is None)
    rows = rows.withColumn("tau", F.lit(fixed_tau) if fixed_tau else clamp(TAU_TIMES * F.coalesce("_median", F.lit(TAU_MIN)), TAU_MIN, TAU_MAX))
    minutes = F.col("_gap")
    terms = {"gap": gap_term(minutes, F.col("tau")), "contrib": 1 - F.col("_same")}
    if people:
        terms["people"] = F.coalesce(1 - F.col("_met"), F.lit(0.5))
    if lat and lon:
        sides = []
        for side in ("left", "right"):
            mx, my, mz, n = (F.col(f"_{side}_{v}") for v in "xyzn")
            sides.append((n, F.degrees(F.atan2(mz, F.sqrt(mx * mx + my * my))), F.degrees(F.atan2(my, mx))))
        (n1, lat1, lon1), (n2, lat2, lon2) = sides
        rows = rows.withColumn("_d", F.when((n1 >= 2) & (n2 >= 2), haversine_m(lat1, lon1, lat2, lon2)))
        d = F.col("_d")
        dist = 1 - F.exp(-d / scale_m)
        slow = (minutes > 0) & (minutes < TRAVEL_MINUTES) & ((d / 1000) / (minutes / 60) < TRAVEL_KMH)
        terms["dist"] = F.when(d.isNull(), 0.5).when(slow, dist * 0.5).otherwise(dist)
    if emb:
        terms["visual"] = F.col("_visual")
    for name in WEIGHTS:  # in this order, so that sums at the threshold come out alike
        rows = rows.withColumn(name, terms.get(name, F.lit(0.5)))
    score = sum((w * F.col(n) for n, w in WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("score", score)
    return rows.select(group, F.col(tie).alias("left_id"), "right_id", F.col(us).alias("left_us"), "right_us", "ix", minutes.alias("minutes"), "tau", *WEIGHTS, "score", (F.col("score") >= CUT).alias("cut"))


def _sum_vectors(vectors: Column) -> Column:
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double") * 0)
    return F.aggregate(vectors, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _mean_dot(a: Column, b: Column) -> Column:
    """Mean of all products of a vector of a with one of b, from the sums of both."""
    n = F.size(a) * F.size(b)
    return F.when(n > 0, _dot(_sum_vectors(a), _sum_vectors(b)) / n)


def _within(a: Column) -> Column:
    n = F.size(a)
    own = F.aggregate(a, F.lit(0.0), lambda s, v: s + F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.when(n >= 2, (_dot(_sum_vectors(a), _sum_vectors(a)) - own) / (n * (n - 1)))


def cut_segments(items: DataFrame, bounds: DataFrame, group: str, us: str, tie: str) -> DataFrame:
    """Adds `segment` from the boundaries' cuts."""
    cuts = bounds.where("cut").select(group, (F.col("ix") + 1).alias("ix"), F.lit(1).alias("_cut"))
    numbers = items if "ix" in items.columns else with_row_index(items, group, us, tie)
    rows = numbers.join(cuts, [group, "ix"], "left").fillna(0, ["_cut"])
    return running_sum(rows, group, "_cut", "segment").drop("_cut")


def neighbours(items: DataFrame, keys: list[str], us: str, reach_us: int) -> DataFrame:
    """Adds `n_before`, `n_after`: rows within reach on each side, those at the same instant excluded.

    Rows are counted per instant; windows run over buckets of the reach's length with a bucket's halo on each side.
    """
    counts = items.groupBy(*keys, us).agg(F.count("*").alias("_n")).withColumn("_own", F.floor(F.col(us) / reach_us))
    near = counts.withColumn("_bucket", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)))
    order = Window.partitionBy(*keys, "_bucket").orderBy(us)
    before, after = (F.sum("_n").over(order.rangeBetween(*r)) - F.col("_n") for r in ((-reach_us, 0), (0, reach_us)))
    near = near.withColumns({"n_before": before, "n_after": after}).where("_bucket = _own").select(*keys, us, "n_before", "n_after")
    return items.join(near, [*keys, us])


def participants(items: DataFrame, event: str, tie: str, people: str) -> DataFrame:
    """(event, person) of people in two items of the event, or in one if it has three items at most."""
    need = items.groupBy(event).agg(F.when(F.count("*") <= 3, 1).otherwise(2).alias("_need"))
    seen = items.select(event, tie, F.explode(F.array_distinct(people)).alias("person")).where("person IS NOT NULL").groupBy(event, "person").agg(F.count("*").alias("_n"))
    return seen.join(need, event).where("_n >= _need").select(event, "person")


def mean_vectors(items: DataFrame, event: str, emb: str) -> DataFrame:
    """(event, mean): the mean embedding of each event that has any, of length one."""
    parts = items.select(event, F.posexplode(emb).alias("_at", "_x")).groupBy(event, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    means = parts.groupBy(event).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda v: v["_x"]).alias("_m"))
    norm = F.greatest(F.sqrt(dot("_m", "_m")), F.lit(1e-9))
    return means.select(event, F.transform("_m", lambda x: x / norm).alias("mean"))


def membership(
    items: DataFrame, event: str, us: str, tie: str, contributor: str, people: str | None = None, lat: str | None = None, lon: str | None = None, emb: str | None = None, faces: str | None = None, voter: str | None = None,
) -> DataFrame:
    """Membership confidence of each item of an event: adds the five terms and their weighted sum, `confidence`, with
    positions the distance from the event's centre, `centre_m`, and with `voter` the contributor's items in the event for
    which it holds, `n_voters`.

    interior: 0, 0.5 or 1 for three neighbours within half an hour on no, one or both sides, 0 at the event's ends;
    geo: 1 within NEAR_M of the event's centre, falling to 0 at FAR_M; people: 1 with a participant of the event, 0 with
    others only; visual: likeness to the mean embedding, from 0.5 to 0.9 on a scale of 0 to 1; support: 1, 0.5 or 0 for
    five, two or fewer items of the contributor. geo, people and visual are 0.5 for items without position, recognised
    people (or with no face, where `faces` counts them) or embedding, and so where these columns aren't given.
    """
    rows = neighbours(items, [event], us, 1800 * 1_000_000)
    at = F.struct(us, tie)
    centre = []
    if lat and lon:
        placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
        centre = [c.alias(n) for c, n in zip(centroid(F.when(placed, F.col(lat)), F.when(placed, F.col(lon))), ("_clat", "_clon"), strict=True)]
    rows = rows.join(few(items.groupBy(event).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), *centre)), event)
    edge = (at == F.col("_first")) | (at == F.col("_last"))
    sides = (F.col("n_before") >= 3).cast("int") + (F.col("n_after") >= 3).cast("int")
    who = F.to_json(F.struct(contributor))  # never null, so that joins keep all rows
    voters = [F.count_if(F.coalesce(F.col(voter), F.lit(False))).alias("n_voters")] if voter else []
    own = items.groupBy(event, who.alias("_who")).agg(F.count("*").alias("_n_own"), *voters)
    rows = rows.withColumn("_who", who).join(own, [event, "_who"])
    n = F.col("_n_own")
    rows = rows.withColumn("interior", F.when(edge, 0.0).otherwise(sides / 2)).withColumn("support", F.when(n >= 5, 1.0).when(n >= 2, 0.5).otherwise(0.0))
    geo = seen = visual = F.lit(0.5)
    if lat and lon:
        d = haversine_m(lat, lon, "_clat", "_clon")
        unplaced = F.col(lat).isNull() | F.col(lon).isNull()  # least() in the distance skips nulls
        rows = rows.withColumn("centre_m", F.when(~unplaced, d))
        geo = F.when(unplaced, 0.5).when(d <= NEAR_M, 1.0).when(d > FAR_M, 0.0).otherwise(1 - (d - NEAR_M) / (FAR_M - NEAR_M))
    if people:
        known = cut(participants(items, event, tie, people))
        if known.limit(FEW + 1).count() <= FEW:
            known = F.broadcast(known.groupBy(event).agg(F.collect_list("person").alias("_known")))
            rows = rows.join(known, event, "left").withColumn("_part", F.arrays_overlap(people, "_known")).drop("_known")
        else:
            own = items.select(event, tie, F.explode(people).alias("person")).join(known, [event, "person"])
            rows = rows.join(own.select(event, tie, F.lit(True).alias("_part")).distinct(), [event, tie], "left")
        unknown = F.coalesce(F.size(people), F.lit(0)) <= 0
        if faces:
            unknown = unknown | (F.coalesce(F.col(faces), F.lit(0)) == 0)
        seen = F.when(F.col("_part"), 1.0).when(unknown, 0.5).otherwise(0.0)
    if emb:
        rows = rows.join(mean_vectors(items, event, emb).withColumnRenamed("mean", "_mean"), event, "left")
        visual = F.coalesce(clamp((dot(emb, "_mean") - 0.5) / 0.4), F.lit(0.5))
    rows = rows.withColumns({"geo": geo, "people_term": seen, "visual": visual}).drop("_clat", "_clon", "_part", "_mean", "_first", "_last", "_who", "_n_own")
    terms = {"interior": "interior", "geo": "geo", "people": "people_term", "visual": "visual", "support": "support"}
    return rows.withColumn("confidence", sum((x * F.col(terms[k]) for k, x in MEMBER_WEIGHTS.items()), F.lit(0.0)))
