"""Timeline queries over `events`: an event is an item, its user the contributor, `user_id % 16` the group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.columns import tier
from tideline.operators import timeline
from tideline.operators.graph import cut
from tideline.operators.segment import moments, segment
from tideline.operators.streams import coalesce_jobs
from tideline.plans.registry import query
from tideline.tables import table

_T = "t AS (SELECT user_id % 16 AS group_id, event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def _items(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("group_id"), "event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("us"), k.alias("k"))


_SEGMENTS = f"""{_T},
    g AS (SELECT *, us - lag(us) OVER (PARTITION BY group_id ORDER BY us, event_id) AS gap FROM t),
    s AS (SELECT *, CAST(sum(CASE WHEN gap > 1200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY us, event_id
          ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g)"""


@query("gap_segments", f"WITH {_SEGMENTS} SELECT group_id, segment, count(*) AS n_items, count(DISTINCT user_id) AS n_contributors, min(us) AS start_us, max(us) AS end_us FROM s GROUP BY group_id, segment")
def _gap_segments(spark, sf_dir):
    return timeline.gap_segments(_items(spark, sf_dir), "group_id", "us", "event_id", "user_id", gap_us=1_200_000_000)


_BOUNDS = f"""WITH {_T},
    r AS (SELECT *, row_number() OVER w - 1 AS ix, (lead(us) OVER w - us) / 60e6 AS minutes, lead(event_id) OVER w AS right_id FROM t
          WINDOW w AS (PARTITION BY group_id ORDER BY us, event_id)),
    b AS (SELECT *, greatest(20.0, least(120.0, 4 * coalesce(median(CASE WHEN minutes > 0 THEN minutes END) OVER (PARTITION BY group_id ORDER BY ix ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 20.0))) AS tau,
          list_distinct(list(user_id) OVER (PARTITION BY group_id ORDER BY ix ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS cl,
          list_distinct(list(user_id) OVER (PARTITION BY group_id ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)) AS cr,
          list_distinct(list(k) OVER (PARTITION BY group_id ORDER BY ix ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS pl,
          list_distinct(list(k) OVER (PARTITION BY group_id ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)) AS pr FROM r),
    x AS (SELECT *, CASE WHEN minutes > 240 THEN 1.0 ELSE 1 / (1 + exp(-(minutes - tau) / (tau / 2))) END AS gap,
          1 - len(list_intersect(cl, cr)) / len(list_distinct(list_concat(cl, cr))) AS contrib,
          CASE WHEN len(pl) = 0 OR len(pr) = 0 THEN 0.5 ELSE 1 - len(list_intersect(pl, pr)) / len(list_distinct(list_concat(pl, pr))) END AS people
          FROM b WHERE right_id IS NOT NULL)"""


@query("adaptive_tau_boundaries", _BOUNDS + " SELECT group_id, event_id AS left_id, right_id, round(minutes, 8) AS minutes, round(tau, 7) AS tau, round(gap, 6) AS gap FROM x")
def _adaptive_tau(spark, sf_dir):
    b = timeline.boundaries(_items(spark, sf_dir), "group_id", "us", "event_id", "user_id")
    return b.select("group_id", "left_id", "right_id", *(F.round(c, n).alias(c) for c, n in (("minutes", 8), ("tau", 7), ("gap", 6))))


@query(
    "boundary_people_contrib",
    _BOUNDS + " SELECT group_id, event_id AS left_id, round(people, 4) AS people, round(contrib, 4) AS contrib, round(0.45 * gap + 0.2 * 0.5 + 0.15 * people + 0.1 * 0.5 + 0.1 * contrib, 4) AS score FROM x",
)
def _boundary_people(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("people", F.array_compact(F.array("k")))
    b = timeline.boundaries(items, "group_id", "us", "event_id", "user_id", people="people")
    return b.select("group_id", "left_id", *(F.round(c, 4).alias(c) for c in ("people", "contrib", "score")))


@query(
    "membership_confidence",
    f"""WITH {_SEGMENTS},
    n AS (SELECT *, count(*) OVER (PARTITION BY group_id, segment ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY group_id, segment, us) AS n_before,
          count(*) OVER (PARTITION BY group_id, segment ORDER BY us RANGE BETWEEN CURRENT ROW AND 1800000000 FOLLOWING) - count(*) OVER (PARTITION BY group_id, segment, us) AS n_after,
          row_number() OVER (PARTITION BY group_id, segment ORDER BY us, event_id) AS f, row_number() OVER (PARTITION BY group_id, segment ORDER BY us DESC, event_id DESC) AS l,
          count(*) OVER (PARTITION BY group_id, segment, user_id) AS c FROM s),
    m AS (SELECT *, 0.35 * CASE WHEN f = 1 OR l = 1 THEN 0 ELSE (CAST(n_before >= 3 AS INT) + CAST(n_after >= 3 AS INT)) / 2 END + 0.275
          + 0.1 * CASE WHEN c >= 5 THEN 1 WHEN c >= 2 THEN 0.5 ELSE 0 END AS x FROM n)
    SELECT event_id, n_before, n_after, round(x, 4) AS confidence, CASE WHEN x >= 0.85 THEN 'confirmed' WHEN x >= 0.6 THEN 'probable' ELSE 'uncertain' END AS tier FROM m""",
)
def _membership(spark, sf_dir):
    rows = timeline.with_segments(_items(spark, sf_dir), "group_id", "us", "event_id", 1_200_000_000)
    rows = cut(rows.withColumn("event", F.struct("group_id", "segment")))  # read several times
    m = timeline.membership(rows, "event", "us", "event_id", "user_id")
    return m.select("event_id", "n_before", "n_after", F.round("confidence", 4).alias("confidence"), tier("confidence").alias("tier"))


@query(
    "month_histogram",
    """WITH m AS (SELECT date_trunc('month', ts) AS month, count(*) AS n FROM events GROUP BY 1),
    r AS (SELECT unnest(range((SELECT min(month) FROM m)::TIMESTAMP, (SELECT max(month) FROM m)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS month),
    j AS (SELECT r.month, coalesce(n, 0) AS n FROM r LEFT JOIN m ON r.month = m.month)
    SELECT strftime(month, '%Y-%m') AS month, n, round(CASE WHEN n = 0 THEN 0 ELSE 0.15 + 0.85 * sqrt(n / (SELECT max(n) FROM m)) END, 6) AS height FROM j""",
)
def _month_histogram(spark, sf_dir):
    months = table(spark, sf_dir, "events").groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"))
    ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b"), F.max("n").alias("peak"))
    every = ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"), "peak")  # one row per month
    n = F.coalesce("n", F.lit(0))
    height = F.when(n == 0, 0.0).otherwise(0.15 + 0.85 * F.sqrt(n / F.col("peak")))
    return every.join(months, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), n.alias("n"), F.round(height, 6).alias("height"))


@query(
    "loose_runs",
    f"""WITH {_SEGMENTS}, e AS (SELECT group_id, segment, count(*) AS n, min(us) AS start_us FROM s GROUP BY group_id, segment),
    l AS (SELECT *, n < 3 AS loose, segment - row_number() OVER (PARTITION BY group_id, n < 3 ORDER BY segment) AS island FROM e)
    SELECT group_id, loose, CAST(min(segment) AS BIGINT) AS first_segment, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_items,
           count(DISTINCT start_us // 86400000000) AS n_days FROM l GROUP BY group_id, loose, island""",
)
def _loose_runs(spark, sf_dir):
    seg = timeline.gap_segments(_items(spark, sf_dir), "group_id", "us", "event_id", "user_id", 1_200_000_000).withColumn("loose", F.col("n_items") < 3)
    # Segments are few beside items; the islands' windows run over these aggregates.
    island = F.col("segment") - F.row_number().over(Window.partitionBy("group_id", "loose").orderBy("segment"))
    return seg.withColumn("island", island).groupBy("group_id", "loose", "island").agg(
        F.min("segment").alias("first_segment"), F.count("*").alias("n_segments"), F.sum("n_items").alias("n_items"),
        F.count_distinct(F.floor(F.col("start_us") / 86_400_000_000)).alias("n_days"),
    ).drop("island")


@query(
    "coalesced_jobs",
    """WITH j AS (SELECT event_type || ':' || CAST(user_id % 100 AS VARCHAR) AS dedupe_key, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS person, event_id % 7 AS priority FROM events)
    SELECT dedupe_key, max(us) + 60000000 AS run_after_us, min(us) - 21600000000 AS from_us, max(us) + 21600000000 AS to_us, max(priority) AS priority,
           CASE WHEN count(DISTINCT person) = 1 AND count(person) = count(*) THEN max(person) END AS person, count(*) AS n_requests FROM j GROUP BY dedupe_key""",
)
def _coalesced(spark, sf_dir):
    key = F.concat_ws(":", "event_type", (F.col("user_id") % 100).cast("string"))
    jobs = table(spark, sf_dir, "events").select(key.alias("dedupe_key"), F.unix_micros("ts").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("person"), (F.col("event_id") % 7).alias("priority"))
    return coalesce_jobs(jobs, "dedupe_key", "us", "person", "priority")


@query(
    "week_last_year",
    """SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events, (SELECT max(ts) AS now FROM events)
    WHERE year(ts) = year(now) - 1 AND abs(dayofyear(ts) - dayofyear(now)) <= 3 OR year(ts) = year(now) AND abs(dayofyear(ts) - dayofyear(now)) <= 3 GROUP BY event_type""",
)
def _week_last_year(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").alias("now"))  # one row
    near = F.abs(F.dayofyear("ts") - F.dayofyear("now")) <= 3
    return rows.join(F.broadcast(now), (F.year("ts").isin(F.year("now"), F.year("now") - 1)) & near).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("wbs_segment")
def _wbs(spark, sf_dir):
    """Segmentation with confidence of membership and moments; positions and people derive from each event's user and props.

    The table has no untrusted items, constraints or earlier events, so the query gives none.
    """
    k = F.col("k")
    items = _items(spark, sf_dir).withColumn("people", F.array_compact(F.array((k % 5).cast("long"))))
    items = items.withColumns({"lat": 59.9 + (F.col("user_id") % 3) * 0.002 + k * 1e-6, "lon": 10.7 + (F.col("user_id") % 2) * 0.2 + k * 1e-6})
    got = cut(segment(items, "group_id", "us", "event_id", "user_id", "people", "lat", "lon"))
    events = got.where("kind = 'event'").join(items.select("event_id", "lat", "lon"), "event_id")
    within, _ = moments(events, "segment_id", "us", "event_id", "user_id", "lat", "lon")
    loose = got.where("kind <> 'event'").withColumn("moment", F.lit(None).cast("long"))
    return within.select("event_id", *(c for c in got.columns if c != "event_id"), "moment").unionByName(loose)
