"""Events from timelines: cuts, splits, sizes, merges and leftovers.

The boundary scores are windows (tideline.operators.timeline). Over-long segments are cut on slabs of time before
anything is grouped by segment, so what follows looks at hours of a group at a time. Only what a window can't state
runs in Arrow functions: ranks of boundaries in a slab, splits of one segment, merges and leftovers on rows of segments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import centroid, haversine_m, tier
from tideline.operators.graph import cut, few
from tideline.operators.joins import mutual_best, set_matches
from tideline.operators.ordered import running_sum, with_halo, with_row_index
from tideline.operators.splits import CONTRIB_SPLIT_M, SPLIT_EPS_M, SPLIT_MIN_GPS, SPLIT_ROWS, SPLIT_SPAN_MINUTES, split_by_cells, split_one
from tideline.operators.timeline import CUT, boundaries, cut_segments, membership, participants

#: Hours of an event at most; items and minutes below which it is loose; the
#: band of scores, minutes and overlap of people within which neighbours merge.
MAX_HOURS, MIN_ITEMS, MIN_MINUTES = 18.0, 3, 10.0
MERGE_LOW, MERGE_HIGH, MERGE_MINUTES, SAME_PLACE_M = 0.5, 0.6, 90.0, 300.0
#: Anchors of items whose time can't be trusted; least overlap for an id to go on; confidence of the two upper tiers;
#: moments: minutes, metres, threshold, weights, and the score and share of items that a label's tag needs.
ANCHOR_US, ANCHOR_M, SAME_ID, CONFIRMED, PROBABLE = 7200 * 1_000_000, 2000.0, 0.5, 0.85, 0.6
MOMENT_TAU, MOMENT_M, MOMENT_CUT, MOMENT_WEIGHTS, TAG_SCORE, TAG_SHARE = 20.0, 150.0, 0.5, {"gap": 0.45, "dist": 0.20, "visual": 0.10}, 0.6, 0.4
DAY_US = 86_400_000_000


@dataclass
class Constraints:
    """What users have set, by the group, item and time columns' own names; these are few rows per group.

    pins (group, us): a cut at that time; together (group, set_id, item): no cut between the first and last of a set;
    frozen (group, start_us, end_us): events cut at their ends only; include, exclude (event_id, item): items that are,
    or aren't, of an event, by its lasting id.
    """

    pins: DataFrame | None = None
    together: DataFrame | None = None
    frozen: DataFrame | None = None
    include: DataFrame | None = None
    exclude: DataFrame | None = None


def constrained(bounds: DataFrame, voters: DataFrame, c: Constraints, group: str, us: str, tie: str) -> DataFrame:
    """The boundaries with `cut` as the constraints have it, and `reason`: score, kept_together, frozen or pinned.

    A group's constraints are one row; adaptive execution sends them along where they are small and splits uneven groups.
    """
    a, b = F.col("left_us"), F.col("right_us")
    kept = edge = pinned = F.lit(False)

    def any_of(name: str, test):
        return F.coalesce(F.exists(name, test), F.lit(False))

    if c.pins is not None:
        bounds = bounds.join(c.pins.groupBy(group).agg(F.collect_list(us).alias("_pins")), group, "left")
        pinned = any_of("_pins", lambda p: (a < p) & (p <= b))
    if c.together is not None:
        spans = c.together.join(voters.select(group, tie, us), [group, tie]).groupBy(group, "set_id").agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
        bounds = bounds.join(spans.groupBy(group).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans")), group, "left")
        kept = any_of("_spans", lambda s: (s["lo"] <= a) & (b <= s["hi"]))
    if c.frozen is not None:
        bounds = bounds.join(c.frozen.groupBy(group).agg(F.collect_list(F.struct("start_us", "end_us")).alias("_frozen")), group, "left")
        kept = kept | any_of("_frozen", lambda e: (e["start_us"] <= a) & (b <= e["end_us"]))
        edge = any_of("_frozen", lambda e: ((a < e["start_us"]) & (e["start_us"] <= b)) | ((a <= e["end_us"]) & (e["end_us"] < b)))
    reason = F.when(pinned, "pinned").when(edge, "frozen").when(kept, "kept_together").otherwise("score")
    cuts = F.when(pinned | edge, True).when(kept, False).otherwise(F.col("score") >= CUT)
    return bounds.withColumns({"reason": reason, "cut": cuts}).drop("_pins", "_spans", "_frozen")


def _overlong(table: pa.Table, group: str) -> pa.Table:
    """Adds the cuts that a slab's own boundaries need; the others' are there to look at."""
    table = table.sort_by("ix")
    left, right = (table.column(c).to_numpy().tolist() for c in ("left_us", "right_us"))
    cut_ = np.asarray(table.column("cut"))
    score = np.nan_to_num(table.column("score").to_numpy(zero_copy_only=False).astype(float), nan=-1.0)
    kept = np.asarray(pc.fill_null(pc.equal(table.column("reason"), "kept_together"), False))
    rank = np.where(cut_, np.inf, np.where(kept, -np.inf, score)).tolist()
    n, stack = len(rank), []
    low, high = left[:1] * n, right[-1:] * n  # of the stretch in which a boundary ranks first
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] < r:
            high[stack.pop()] = left[i]
        if stack:
            low[i] = right[stack[-1]]
        stack.append(i)
    more = ~cut_ & ~kept & (score >= 0) & (np.array(high) - np.array(low) > MAX_HOURS * 3600e6)
    reason = pc.if_else(pa.array(more), "overlong", table.column("reason"))
    out = table.select([group, "ix", "left_us", "right_us", "score"]).append_column("cut", pa.array(cut_ | more)).append_column("reason", reason)
    return out.filter(table.column("own"))


def without_overlong(bounds: DataFrame, group: str) -> DataFrame:
    """Boundaries with the further cuts that bring segments down to MAX_HOURS: of a longer one always the best inner
    boundary that isn't kept together, of equal scores the first.

    The order of these cuts is a tree in which a boundary cuts the stretch where it ranks first; all stretches around
    are longer. So a boundary is cut if and only if its own stretch is over-long, and to know this the boundaries within
    MAX_HOURS on each side suffice: slabs of time with such a halo, no whole segment, however long.
    """
    hours = int(MAX_HOURS * 3_600_000_000)
    width = 4 * hours
    slabs = F.sequence(F.floor((F.col("left_us") - hours) / width), F.floor((F.col("right_us") + hours) / width))
    near = bounds.select(group, "ix", "left_us", "right_us", "score", "cut", "reason", F.explode(slabs).alias("_slab"))
    near = near.withColumn("own", F.col("_slab") == F.floor(F.col("right_us") / width))
    kind = bounds.schema[group].dataType.simpleString()
    shape = f"{group} {kind}, ix long, left_us long, right_us long, score double, cut boolean, reason string"
    return near.groupBy(group, "_slab").applyInArrow(lambda t: _overlong(t, group), shape)


def segment(
    items: DataFrame, group: str, us: str, tie: str, contributor: str, people: str | None = None, lat: str | None = None, lon: str | None = None, emb: str | None = None,
    trusted: str | None = None, constraints: Constraints | None = None, existing: DataFrame | None = None, zone_us: int = 3_600_000_000,
) -> DataFrame:
    """(group, id, us, contributor, segment_id, kind, confidence, tier, source) of every item.

    Boundaries between trusted items are scored and cut as the constraints allow; segments over MAX_HOURS are cut again
    at their best boundary; places that run concurrently, and contributors far apart, become events of their own; what is
    both small and short is loose, per contributor, local day and place; neighbouring events merge where a weak cut parts
    one place and the same people. Other items join the nearest segment if their contributor, place or people tie them to
    it, and are loose otherwise. segment_id is that of the row of `existing` (group, event_id, item) events that overlaps
    by half, or a digest of group and first item, so reruns give the same ids. Items that `exclude` takes from their event
    get no row; nor do those that `include` gives to an event that isn't found.
    """
    c = constraints or Constraints()
    voters = items.where(F.coalesce(F.col(trusted), F.lit(False))) if trusted else items
    # Each of these is read several times; written once, they don't repeat the windows beneath.
    read = [n for n in (group, tie, us, contributor, people, lat, lon, emb) if n]
    numbers = cut(with_row_index(voters.select(*dict.fromkeys(read)), group, us, tie))
    scored = boundaries(numbers, group, us, tie, contributor, people, lat, lon, emb).select(group, "ix", "left_us", "right_us", "score")
    bounds = constrained(scored, voters, c, group, us, tie).select(group, "ix", "left_us", "right_us", "score", "cut", "reason")
    bounds = cut(without_overlong(bounds, group).select(group, "ix", "score", "cut", "reason"))
    before = bounds.select(group, (F.col("ix") + 1).alias("ix"), F.col("cut").cast("int").alias("_cut"), F.col("score").alias("score_before"), F.col("reason").alias("reason_before"))
    # Cuts are summed up over the boundaries alone, so that only then the items are met, once.
    rows = numbers.join(running_sum(before, group, "_cut", "segment").drop("_cut"), [group, "ix"], "left").fillna(0, ["segment"])

    def plain_names(df: DataFrame, *more: str) -> DataFrame:
        return df.select(
            F.col(group).alias("grp"), F.col(tie).alias("id"), F.col(us).alias("us"), F.col(contributor).alias("contrib"), *more,
            (F.col(lat) if lat else F.lit(None)).cast("double").alias("lat"), (F.col(lon) if lon else F.lit(None)).cast("double").alias("lon"),
            (F.col(people) if people else F.array()).cast("array<long>").alias("people"),
        )

    rows = cut(plain_names(rows, "segment", "score_before", "reason_before"))
    # Most segments need none of the splits. No two positions are further apart than the degrees between the outermost
    # ones come to at the equator: within one cluster's reach no places are apart, within the contributors' none are far.
    placed = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("us", "lat", "lon"))
    outer = [F.max(placed[n]) - F.min(placed[n]) for n in ("us", "lat", "lon")]
    wide = 6_371_000.0 * F.hypot(F.radians(outer[1]), F.radians(outer[2]))
    distant = (F.min("contrib") != F.max("contrib")) & (wide > CONTRIB_SPLIT_M)
    apart = (F.count(placed) >= SPLIT_MIN_GPS) & (wide > SPLIT_EPS_M) & (outer[0] >= SPLIT_SPAN_MINUTES * 60e6)
    way = F.when(F.coalesce(distant | apart, F.lit(False)), F.when(F.count("*") > SPLIT_ROWS, 2).otherwise(1)).otherwise(0)
    sizes = few(rows.groupBy("grp", "segment").agg(way.alias("_split"), F.avg(F.when(placed.isNotNull(), F.radians("lat"))).alias("_lat")))
    flagged = rows.join(sizes, ["grp", "segment"])
    plain = flagged.where("_split = 0").drop("_split", "_lat").withColumns({"part": F.lit(0).cast("long"), "contiguous": F.lit(True), "untied": F.lit(False)})
    order = plain.columns
    split = flagged.where("_split = 1").select(order[:-3])
    split = split.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "segment").groupBy("grp", "segment").applyInArrow(lambda t: split_one(t).select(order), _ddl(plain))
    if not sizes.where("_split = 2").isEmpty():
        split = split.unionByName(split_by_cells(flagged.where("_split = 2").select(*order[:-3], "_lat"), "_lat"))
    rows = cut(_loose(cut(_merged(cut(plain.unionByName(split)))), zone_us))
    if trusted:
        rest = plain_names(items.where(~F.coalesce(F.col(trusted), F.lit(False))))
        rows = cut(rows.withColumn("voter", F.lit(True)).unionByName(_anchored(rows, rest, zone_us)))
    else:
        rows = rows.withColumn("voter", F.lit(True))
    first = rows.groupBy("grp", "key").agg(F.min_by("id", F.struct("us", "id")).alias("first_id"), F.first("kind").alias("_kind"))
    named = F.substring(F.sha2(F.concat_ws("|", F.col("grp").cast("string"), "_kind", F.col("first_id").cast("string")), 256), 1, 16)
    rows = rows.join(few(first.select("grp", "key", named.alias("segment_id"))), ["grp", "key"]).drop("key")
    if existing is not None:
        old = existing.select(F.struct(F.col(group).alias("grp"), F.col("event_id").cast("string").alias("e")).alias("old"), F.struct(F.col(group).alias("grp"), F.col(tie).alias("id")).alias("item"))
        new = rows.select(F.struct("grp", "segment_id").alias("new"), F.struct("grp", "id").alias("item"))
        pairs = mutual_best(set_matches(new, old, "new", "old", "item", SAME_ID), "new", "old", "jaccard")
        known = pairs.select(F.col("new.grp").alias("grp"), F.col("new.segment_id").alias("segment_id"), F.col("old.e").alias("_known"))
        rows = rows.join(known, ["grp", "segment_id"], "left").withColumn("segment_id", F.coalesce("_known", "segment_id")).drop("_known")
    if c.exclude is not None:
        rows = rows.join(c.exclude.select(F.col("event_id").cast("string").alias("segment_id"), F.col(tie).alias("id")), ["segment_id", "id"], "left_anti")
    if emb:
        rows = rows.join(items.select(F.col(group).alias("grp"), F.col(tie).alias("id"), F.col(emb).alias("emb")), ["grp", "id"])
    rows = _confident(cut(rows.withColumn("ev", F.struct("grp", "segment_id"))), "emb" if emb else None).withColumn("source", F.lit("auto"))
    if c.include is not None:
        rows = _included(rows, c.include.select(F.col("event_id").cast("string").alias("_to"), F.col(tie).alias("id")))
    return rows.select(F.col("grp").alias(group), F.col("id").alias(tie), F.col("us").alias(us), F.col("contrib").alias(contributor), "segment_id", "kind", "confidence", tier("confidence").alias("tier"), "source")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _sums() -> list:
    """Aggregates: the sum of the unit vectors of the items with a position, and their number."""
    la, lo = F.radians("lat"), F.radians("lon")
    x, y, z = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.when(F.col("lon").isNotNull(), F.sin(la))
    return [F.coalesce(F.sum(v), F.lit(0.0)).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))] + [F.count(x).alias("n_gps")]


def _metres(a: list, b: list) -> float:
    """Between the directions of two sums of unit vectors."""
    a, b = (np.array(v[:3]) / max(1e-300, math.hypot(*v[:3])) for v in (a, b))
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.hypot(*(a - b)) / 2))


def _fold_merges(table: pa.Table) -> pa.Table:
    """`event` of a run of segments that may merge: the number of the first that each one merges into."""
    rows = table.sort_by("ix").to_pylist()
    event, held, met = [], None, set()
    for r in rows:
        own, seen = [r["x"], r["y"], r["z"], r["n_gps"]], set(r["people"])
        joins = held is not None and ((_metres(held, own) <= SAME_PLACE_M) if held[3] and own[3] else held[3] == own[3])
        joins = joins and (not (met | seen) or 2 * len(met & seen) >= len(met | seen))
        event.append(event[-1] if joins else r["ix"])
        held, met = ([p + q for p, q in zip(held, own, strict=True)], met | seen) if joins else (own, seen)
    return pa.table({c: pa.array([r[c] for r in rows], table.schema.field(c).type) for c in ("grp", "segment", "part")} | {"event": pa.array(event, pa.int64())})


def _merged(rows: DataFrame) -> DataFrame:
    """Adds `event`, the number of the first of a run of segments that merge with their predecessor, and `kind`.

    A merge needs two whole neighbours that are not loose, a weak cut by score between them, under MERGE_MINUTES, one
    place (or no position on either side) and people who overlap by half (or none). Place and people are those of all
    that has merged before; what doesn't depend on this parts the runs that are folded.
    """
    s = rows.groupBy("grp", "segment", "part").agg(
        F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("n"), F.first("contiguous").alias("contiguous"), *_sums(),
        F.array_distinct(F.flatten(F.collect_list("people"))).alias("people"), F.min_by("score_before", F.struct("us", "id")).alias("score"), F.min_by("reason_before", F.struct("us", "id")).alias("reason"),
    )
    small = (F.col("n") < MIN_ITEMS) & (F.col("end") - F.col("start") < MIN_MINUTES * 60e6)
    s = s.withColumns({"kind": F.when(small, "loose").otherwise("event"), "seq": F.struct("segment", "part")})
    s = cut(with_row_index(s, "grp", "start", "seq"))
    near = with_halo(s, "grp", before=1, after=0)
    order = Window.partitionBy("grp", "block").orderBy("ix")
    able = F.col("contiguous") & (F.col("kind") == "event")
    weak = (F.col("reason") == "score") & (F.col("score") >= MERGE_LOW) & (F.col("score") < MERGE_HIGH) & (F.col("start") - F.lag("end").over(order) < MERGE_MINUTES * 60e6)
    near = near.withColumn("_new", F.when(able & F.lag(able).over(order) & weak, 0).otherwise(1)).where("own").drop("own", "block")
    runs = cut(running_sum(near, "grp", "_new", "run"))
    long = runs.groupBy("grp", "run").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields if f.name in ("grp", "segment", "part"))
    names = [f.split()[0] for f in shape.split(", ")] + ["event"]
    folded = runs.join(long, ["grp", "run"]).select("grp", "run", "segment", "part", "ix", "x", "y", "z", "n_gps", "people").groupBy("grp", "run").applyInArrow(lambda t: _fold_merges(t).select(names), shape + ", event long")
    single = runs.join(long, ["grp", "run"], "left_anti").select(*names[:-1], F.col("ix").cast("long").alias("event"))
    return rows.join(few(single.unionByName(folded).join(s.select("grp", "segment", "part", "kind"), ["grp", "segment", "part"])), ["grp", "segment", "part"])


def _fold_loose(table: pa.Table) -> pa.Table:
    """`no` of each leftover of a contributor: the first group that ends on its day and isn't too far away takes it."""
    rows = table.sort_by([("start", "ascending"), ("event", "ascending")]).to_pylist()
    groups, no = [], []
    for r in rows:
        own = [r["x"], r["y"], r["z"], r["n_gps"]]
        at = next((i for i, (day, held) in enumerate(groups) if day == r["first_day"] and not (held[3] and own[3] and _metres(held, own) > CONTRIB_SPLIT_M)), len(groups))
        if at == len(groups):
            groups.append((r["last_day"], own))
        else:
            day, held = groups[at]
            groups[at] = max(day, r["last_day"]), [p + q for p, q in zip(held, own, strict=True)]
        no.append(at)
    return pa.table({c: table.sort_by([("start", "ascending"), ("event", "ascending")]).column(c) for c in ("grp", "who", "event", "day")} | {"no": pa.array(no, pa.int64())})


def _loose(rows: DataFrame, zone_us: int) -> DataFrame:
    """Adds `key`: of an event, or of the leftovers of a contributor on a local day that lie within CONTRIB_SPLIT_M.

    Days that a leftover joins by running over midnight are folded together.
    """
    rows = rows.withColumn("who", F.to_json(F.struct("contrib")))  # never null, so that joins keep all rows
    units = rows.where("kind = 'loose'").groupBy("grp", "who", "event").agg(F.min("us").alias("start"), F.max("us").alias("end"), *_sums())
    first, last = (F.floor((F.col(c) + zone_us) / DAY_US).cast("long") for c in ("start", "end"))
    units = cut(units.withColumns({"first_day": first, "last_day": last}))
    over = units.where("first_day < last_day").select("grp", "who", F.col("last_day").alias("first_day")).distinct()  # few
    island = F.col("first_day") - F.row_number().over(Window.partitionBy("grp", "who").orderBy("first_day"))
    over = over.withColumn("_run", island)
    starts = over.groupBy("grp", "who", "_run").agg((F.min("first_day") - 1).alias("day"))
    over = over.join(starts, ["grp", "who", "_run"]).drop("_run")
    units = units.join(over, ["grp", "who", "first_day"], "left").withColumn("day", F.coalesce("day", "first_day"))
    chains = units.groupBy("grp", "who", "day").agg(((F.count("*") > 1) & ((F.max("n_gps") > 0) | F.max(F.col("first_day") < F.col("last_day")))).alias("_fold"))
    units = cut(units.join(chains, ["grp", "who", "day"]))
    plain = units.where("NOT _fold").select("grp", "who", "event", "day", F.lit(0).cast("long").alias("no"))
    folded = units.where("_fold").groupBy("grp", "who", "day").applyInArrow(_fold_loose, _ddl(plain))
    numbers = plain.unionByName(folded)
    key = F.when(F.col("kind") == "event", F.concat_ws("|", F.lit("event"), F.col("event").cast("string")))
    key = key.otherwise(F.concat_ws("|", F.lit("loose"), F.col("contrib").cast("string"), F.col("day").cast("string"), F.col("no").cast("string")))
    events = rows.where("kind = 'event'").withColumns({"day": F.lit(None).cast("long"), "no": F.lit(None).cast("long")})
    loose = rows.where("kind = 'loose'").join(numbers, ["grp", "who", "event"])
    return events.unionByName(loose).select("grp", "id", "us", "contrib", "lat", "lon", "people", "untied", "kind", key.alias("key"))


def _anchored(rows: DataFrame, rest: DataFrame, zone_us: int) -> DataFrame:
    """`rest` with the key and kind of the nearest segment within ANCHOR_US (of equally near ones the first), if it has
    the item's contributor, a centre within ANCHOR_M or one of the people as a participant; else loose by local day."""
    lat, lon = centroid("lat", "lon")
    segments = rows.groupBy("grp", "key").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.first("kind").alias("kind"))
    placed = rows.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("grp", "key").agg(lat.alias("clat"), lon.alias("clon"))
    buckets = F.sequence(F.floor((F.col("start") - ANCHOR_US) / ANCHOR_US), F.floor((F.col("end") + ANCHOR_US) / ANCHOR_US))
    reach = segments.withColumn("_b", F.explode(buckets))
    probes = rest.select("grp", "id", "us", F.floor(F.col("us") / ANCHOR_US).alias("_b"))
    d = F.greatest(F.col("start") - F.col("us"), F.col("us") - F.col("end"), F.lit(0))
    near = probes.join(reach, ["grp", "_b"]).where(d <= ANCHOR_US).groupBy("grp", "id").agg(F.min_by(F.struct("key", "kind"), F.struct(d, "start", "key")).alias("at"))
    near = rest.join(near.select("grp", "id", "at.key", "at.kind"), ["grp", "id"]).join(placed, ["grp", "key"], "left")
    near = near.join(rows.select("grp", "key", "contrib").distinct().withColumn("_own", F.lit(True)), ["grp", "key", "contrib"], "left")
    seen = participants(rows.withColumn("ev", F.struct("grp", "key")), "ev", "id", "people").select("ev.grp", "ev.key", "person")
    met = near.select("grp", "key", "id", F.explode("people").alias("person")).join(seen, ["grp", "key", "person"]).select("grp", "id", F.lit(True).alias("_met")).distinct()
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("clat").isNotNull()
    tied = F.col("_own").isNotNull() | F.col("_met").isNotNull() | (known & (haversine_m("lat", "lon", "clat", "clon") <= ANCHOR_M))
    near = near.join(met, ["grp", "id"], "left").where(tied).select("grp", "id", "key", "kind")
    day = F.floor((F.col("us") + zone_us) / DAY_US)
    alone = F.concat_ws("|", F.lit("own"), F.col("contrib").cast("string"), day.cast("string"))
    out = rest.join(near, ["grp", "id"], "left").withColumns({"key": F.coalesce("key", alone), "kind": F.coalesce("kind", F.lit("loose"))})
    return out.select("grp", "id", "us", "contrib", "lat", "lon", "people", F.lit(True).alias("untied"), "kind", "key", F.lit(False).alias("voter"))


def _confident(rows: DataFrame, emb: str | None) -> DataFrame:
    """Adds `confidence`: that of membership in an event, 0.5 in loose groups. Items that nothing ties to their event stay
    under PROBABLE; trusted ones with a second item of their contributor, near the centre or with a participant reach it,
    unless they are far away."""
    events = membership(rows.where("kind = 'event'"), "ev", "us", "id", "contrib", "people", "lat", "lon", emb, voter="voter")
    own = F.when(F.col("contrib").isNotNull(), F.col("n_voters"))
    d = F.col("centre_m")
    backed = (F.coalesce(own, F.lit(0)) >= 2) | F.coalesce(d <= ANCHOR_M, F.lit(False)) | (F.col("people_term") == 1)
    far = F.coalesce(d > CONTRIB_SPLIT_M, F.lit(False))
    floor = F.when(F.col("voter") & backed & ~far, F.greatest("confidence", F.lit(PROBABLE))).otherwise(F.col("confidence"))
    low = F.lit(PROBABLE - 0.01)
    events = events.withColumn("confidence", F.when(F.col("untied"), F.least("confidence", low)).otherwise(floor))
    names = ["grp", "id", "us", "contrib", "segment_id", "kind", "confidence"]
    return events.select(names).unionByName(rows.where("kind = 'loose'").withColumn("confidence", F.lit(0.5)).select(names))


def _included(rows: DataFrame, include: DataFrame) -> DataFrame:
    kinds = rows.groupBy("segment_id").agg(F.first("kind").alias("_to_kind"))
    moved = rows.join(include, "id").join(kinds.withColumnRenamed("segment_id", "_to"), "_to")
    own = F.when(F.col("segment_id") == F.col("_to"), F.col("confidence")).otherwise(0.0)
    moved = moved.withColumns({"confidence": F.greatest(own, F.lit(CONFIRMED)), "segment_id": F.col("_to"), "kind": F.col("_to_kind"), "source": F.lit("manual")})
    return rows.join(include.select("id").distinct(), "id", "left_anti").unionByName(moved.select(rows.columns))


def moments(
    items: DataFrame, event: str, us: str, tie: str, contributor: str, lat: str | None = None, lon: str | None = None, emb: str | None = None, tags: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The items with their `moment` of the event, and (event, moment, label) of moments with a label.

    Boundaries are scored within events, by gap, distance and looks, on a finer scale. The label is the tag (of
    array<struct<tag, score>>) that most items bear, if TAG_SHARE of them do; of equal tags the first by name.
    """
    items = cut(with_row_index(items, event, us, tie))  # read twice
    b = boundaries(items, event, us, tie, contributor, None, lat, lon, emb, fixed_tau=MOMENT_TAU, scale_m=MOMENT_M)
    score = sum((w * F.col(n) for n, w in MOMENT_WEIGHTS.items()), F.lit(0.0)) / sum(MOMENT_WEIGHTS.values())
    rows = cut_segments(items, b.withColumn("cut", score >= MOMENT_CUT), event, us, tie).withColumnRenamed("segment", "moment").drop("ix")
    if not tags:
        return rows, rows.select(event, "moment", F.lit(None).cast("string").alias("label")).limit(0)
    sizes = rows.groupBy(event, "moment").agg(F.count("*").alias("_n"))
    seen = rows.select(event, "moment", tie, F.explode(tags).alias("_t")).where(F.col("_t.score") >= TAG_SCORE).select(event, "moment", tie, F.col("_t.tag").alias("tag")).distinct()
    counts = seen.groupBy(event, "moment", "tag").agg(F.count("*").alias("_k")).join(sizes, [event, "moment"])
    best = counts.groupBy(event, "moment").agg(F.min_by(F.struct("tag", "_k", "_n"), F.struct(-F.col("_k"), "tag")).alias("_b")).where(F.col("_b._k") >= TAG_SHARE * F.col("_b._n"))
    bare = F.regexp_replace("_b.tag", "^(a photo of a |a photo of |an |a )", "")
    return rows, best.select(event, "moment", F.concat(F.upper(F.substring(bare, 1, 1)), F.expr("substring(regexp_replace(_b.tag, '^(a photo of a |a photo of |an |a )', ''), 2)")).alias("label"))
