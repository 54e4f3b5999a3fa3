"""Visibility, view and identity queries: an order is an event, a line item an asset in it, suppliers are contributors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.columns import interest_raw, list_names, routine, time_of_day, trigram_similarity
from tideline.functions import provenance
from tideline.operators import identity, joins, streams, tags
from tideline.operators import visibility as vis
from tideline.operators.graph import linked_groups
from tideline.plans.registry import query
from tideline.tables import table

_EVENTS = """l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS contributors, list_sort(list_distinct(list(l_partkey % 100))) AS persons FROM lineitem GROUP BY l_orderkey),
    e AS (SELECT o_orderkey, o_custkey % 10 AS group_id, contributors, persons, o_orderpriority = '1-URGENT' AS public, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders JOIN l ON o_orderkey = l_orderkey)"""
_VIEWER = vis.Viewer(group=3, user=7, person=11)


def _events(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_suppkey")).alias("contributors"), F.array_sort(F.collect_set(F.col("l_partkey") % 100)).alias("persons")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 10).alias("group_id"), (F.col("o_orderpriority") == "1-URGENT").alias("public"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"),
    )
    return orders.join(sets, orders.o_orderkey == sets.l_orderkey).drop("l_orderkey")


def _text(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


_SEEN = "group_id = 3 AND deleted_at IS NULL AND (list_contains(contributors, 7) OR list_contains(persons, 11) OR public)"


@query("visible_events", f"WITH {_EVENTS} SELECT o_orderkey, array_to_string(contributors, ',') AS contributors FROM e WHERE {_SEEN}")
def _visible_events(spark, sf_dir):
    seen = vis.event_visible(_VIEWER, "group_id", "contributors", "persons", "public", "deleted_at")
    return _events(spark, sf_dir).where(seen).select("o_orderkey", _text("contributors").alias("contributors"))


@query(
    "visible_assets",
    f"""WITH {_EVENTS}, a AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS asset_id, l_suppkey FROM lineitem)
    SELECT asset_id, l_suppkey FROM a WHERE l_suppkey = 7 OR asset_id IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem JOIN e ON l_orderkey = o_orderkey WHERE {_SEEN})""",
)
def _visible_assets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset_id"), "l_suppkey", F.col("l_orderkey").alias("o_orderkey"))
    seen = _events(spark, sf_dir).where(vis.event_visible(_VIEWER, "group_id", "contributors", "persons", "public", "deleted_at"))
    return vis.visible_assets(lines.select("asset_id", "l_suppkey").distinct(), lines.select("asset_id", "o_orderkey"), seen, _VIEWER, "asset_id", "l_suppkey", "o_orderkey")


@query(
    "visibility_reasons",
    f"""WITH {_EVENTS}, m AS (SELECT s_suppkey % 10 AS group_id, s_suppkey AS member FROM supplier),
    r AS (SELECT o_orderkey, m.member, 'contributor' AS reason FROM e JOIN m USING (group_id) WHERE list_contains(contributors, m.member)
          UNION SELECT o_orderkey, m.member, 'face' FROM e JOIN m USING (group_id) WHERE list_contains(persons, m.member)
          UNION SELECT o_orderkey, m.member, 'opened' FROM e JOIN m USING (group_id) WHERE public)
    SELECT o_orderkey, member, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY ALL""",
)
def _visibility_reasons(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("group_id"), F.col("s_suppkey").alias("member"))
    out = vis.visibility_reasons(_events(spark, sf_dir), "o_orderkey", "group_id", {"contributor": "contributors", "face": "persons"}, "public", asked, "member", separator=",")
    return out.select("o_orderkey", "member", "reasons")


@query(
    "event_list_page",
    """SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS start_us FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1998-06-30' AND o_orderdate + INTERVAL 7 DAY >= TIMESTAMP '1997-01-01'
    AND o_custkey % 5 IN (1, 2) AND (o_orderdate, o_orderkey) < (TIMESTAMP '1998-05-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""",
)
def _event_list_page(spark, sf_dir):
    start = F.col("o_orderdate")
    overlap = (start <= F.lit("1998-06-30").cast("timestamp")) & (start + F.expr("INTERVAL 7 DAYS") >= F.lit("1997-01-01").cast("timestamp"))
    page = F.struct(start, "o_orderkey") < F.struct(F.lit("1998-05-01").cast("timestamp").alias("o_orderdate"), F.lit(5000).cast("long").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & overlap & (F.col("o_custkey") % 5).isin(1, 2) & page)
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(51).select("o_orderkey", "o_custkey", F.unix_micros("o_orderdate").alias("start_us"))


@query(
    "timeline_day",
    """SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate + INTERVAL 2 DAY >= timezone('UTC', timezone('Europe/Oslo', TIMESTAMP '1997-03-10')) AND o_orderdate < timezone('UTC', timezone('Europe/Oslo', TIMESTAMP '1997-03-11'))
    AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')""",
)
def _timeline_day(spark, sf_dir):
    day = [F.to_utc_timestamp(F.lit(x).cast("timestamp"), "Europe/Oslo") for x in ("1997-03-10", "1997-03-11")]
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS") >= day[0]) & (F.col("o_orderdate") < day[1]))
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(returned, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "contributors_fallback",
    """WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'N' AND l_discount <= 0.05) AS strong, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') AS trusted, list(DISTINCT l_suppkey) AS anyone
               FROM lineitem WHERE l_tax < 0.08 GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_sort(coalesce(strong, trusted, anyone)), ',') AS contributors, CASE WHEN strong IS NOT NULL THEN 'strong' WHEN trusted IS NOT NULL THEN 'trusted' ELSE 'anyone' END AS level FROM s""",
)
def _contributors_fallback(spark, sf_dir):
    out = vis.contributors_with_fallback(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_returnflag") == "N", F.col("l_discount") <= 0.05, F.col("l_tax") < 0.08)
    return out.withColumn("contributors", _text("contributors"))


@query(
    "derived_person_ids",
    """WITH p AS (SELECT l_orderkey, l_partkey % 97 AS person FROM lineitem WHERE l_discount >= 0.03 UNION SELECT l_orderkey, l_suppkey % 97 FROM lineitem WHERE l_linenumber = 1)
    SELECT l_orderkey, array_to_string(list_sort(list(person)), ',') AS person_ids FROM p GROUP BY l_orderkey""",
)
def _derived_persons(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    faces = lines.where("l_discount >= 0.03").select("l_orderkey", (F.col("l_partkey") % 97).alias("person"))
    tagged = lines.where("l_linenumber = 1").select("l_orderkey", (F.col("l_suppkey") % 97).alias("person"))
    return faces.unionByName(tagged).groupBy("l_orderkey").agg(_text(F.array_sort(F.collect_set("person"))).alias("person_ids"))


@query(
    "co_appearance",
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
    c AS (SELECT a.l_suppkey AS person, b.l_suppkey AS other, count(*) AS n FROM m a JOIN m b USING (l_orderkey) WHERE a.l_suppkey % 50 = 0 AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)
    SELECT person, other, n FROM c QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, other) <= 20""",
)
def _co_appearance(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    asked = members.where("l_suppkey % 50 = 0").withColumnRenamed("l_suppkey", "person")
    n = asked.join(members, "l_orderkey").where("person <> l_suppkey").groupBy("person", F.col("l_suppkey").alias("other")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("n"), "other"))
    return n.withColumn("r", rank).where("r <= 20").drop("r")


@query(
    "person_counts",
    """SELECT s_suppkey, coalesce(n_assets, 0) AS n_assets, coalesce(n_events, 0) AS n_events FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n_assets, count(DISTINCT l_orderkey) AS n_events FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'F' GROUP BY l_suppkey) ON s_suppkey = l_suppkey""",
)
def _person_counts(spark, sf_dir):
    live = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    n = table(spark, sf_dir, "lineitem").join(live, "l_orderkey", "left_semi").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_assets"), F.count_distinct("l_orderkey").alias("n_events"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(n, "s_suppkey", "left").fillna(0)


@query("best_event_per_asset", "SELECT l_partkey, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) AS best_order, max(l_extendedprice) AS price FROM lineitem GROUP BY l_partkey")
def _best_event(spark, sf_dir):
    best = F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(best.alias("best_order"), F.max("l_extendedprice").alias("price"))


@query("queue_depths", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS ready, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS parked FROM orders GROUP BY o_orderpriority")
def _queue_depths(spark, sf_dir):
    return streams.queue_depths(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    "group_status",
    """WITH o AS (SELECT o_custkey % 10 AS group_id, count(*) AS n_events, count(DISTINCT o_custkey) AS n_members, count(*) FILTER (o_orderstatus = 'F') AS n_deleted FROM orders GROUP BY 1),
    l AS (SELECT o_custkey % 10 AS group_id, count(*) AS n_assets, count(DISTINCT l_partkey) AS n_blobs, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT * FROM o JOIN l USING (group_id)""",
)
def _group_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("group_id", F.col("o_custkey") % 10)
    a = orders.groupBy("group_id").agg(F.count("*").alias("n_events"), F.count_distinct("o_custkey").alias("n_members"), F.count_if(F.col("o_orderstatus") == "F").alias("n_deleted"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "group_id"), "l_orderkey")
    b = lines.groupBy("group_id").agg(F.count("*").alias("n_assets"), F.count_distinct("l_partkey").alias("n_blobs"), F.sum("l_quantity").cast("long").alias("bytes"))
    return a.join(b, "group_id")


_PER_ORDER = """p AS (SELECT o_orderkey, o_custkey % 200 AS place, o_orderstatus, count(DISTINCT l_suppkey) AS contributors, count(DISTINCT l_partkey % 5) - 1 AS others, count(*) AS n_assets, count(*) FILTER (l_returnflag = 'R') AS n_videos,
    count(*) FILTER (l_discount >= 0.05) AS faces, max(CASE WHEN l_linenumber = 1 THEN l_tax * 10 END) AS spec FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
    s AS (SELECT place, count(*) AS n_events, avg(others) AS avg_others, avg(CASE WHEN contributors >= 3 THEN 0.0 ELSE 1.0 END) AS multi, count(*) FILTER (o_orderstatus = 'F') AS demoted, count(*) FILTER (o_orderstatus = 'P') AS promoted FROM p GROUP BY place),
    r AS (SELECT *, floor(greatest(0, least(1, greatest(0, least(1, (n_events - 2) / 8)) * (1 - greatest(0, least(1, avg_others / 1.5))) * (1 - greatest(0, least(1, multi * 2))) + 0.5 * (demoted - promoted) / n_events)) * 1000 + 0.5) / 1000 AS routine FROM s)"""


def _per_order(spark, sf_dir):
    """Lines are summed up by order before they meet it; an order that the table holds n times counts each line n times."""
    orders = table(spark, sf_dir, "orders").groupBy("o_orderkey", (F.col("o_custkey") % 200).alias("place"), "o_orderstatus").agg(F.count("*").alias("_n"))
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("_s"), (F.col("l_partkey") % 5).cast("tinyint").alias("_p"),
        F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("_r"), F.coalesce(F.col("l_discount") >= 0.05, F.lit(False)).alias("_d"), F.when(F.col("l_linenumber") == 1, F.col("l_tax") * 10).alias("_t"),
    )
    lines = line.repartition("o_orderkey").groupBy("o_orderkey").agg(
        F.size(F.collect_set("_s")).cast("long").alias("contributors"), (F.size(F.collect_set("_p")).cast("long") - 1).alias("others"), F.count("*").alias("n_assets"),
        F.count_if("_r").alias("n_videos"), F.count_if("_d").alias("faces"), F.max("_t").alias("spec"),
    )
    sums = {c: F.col(c) * F.col("_n") for c in ("n_assets", "n_videos", "faces")}
    return orders.join(lines, "o_orderkey").withColumns(sums).drop("_n")


def _places(per_order):
    s = per_order.groupBy("place").agg(
        F.count("*").alias("n_events"), F.avg("others").alias("avg_others"), F.avg(F.when(F.col("contributors") >= 3, 0.0).otherwise(1.0)).alias("multi"),
        F.count_if(F.col("o_orderstatus") == "F").alias("demoted"), F.count_if(F.col("o_orderstatus") == "P").alias("promoted"),
    )
    return s.withColumn("routine", routine("n_events", "avg_others", "multi", "demoted", "promoted"))


@query("place_stats_routine", f"WITH {_PER_ORDER} SELECT place, n_events, round(avg_others, 6) AS avg_others, round(multi, 6) AS multi, demoted, promoted, routine FROM r")
def _place_stats(spark, sf_dir):
    return _places(_per_order(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_others", "multi")})


@query(
    "interest_scores",
    f"""WITH {_PER_ORDER}, i AS (SELECT p.*, routine, 0.10 + 0.30 * greatest(0, least(1, others / 3)) + 0.15 * greatest(0, least(1, faces / n_assets / 2)) + CASE WHEN contributors >= 2 THEN 0.10 ELSE 0 END + 0.15 * greatest(0, least(1, coalesce(spec, 0)))
      + 0.10 * greatest(0, least(1, n_assets / 24)) + 0.05 * greatest(0, least(1, n_assets / 4)) + CASE WHEN place % 3 = 0 THEN 0.05 ELSE 0 END - 0.35 * greatest(0, least(1, routine)) - CASE WHEN n_videos >= n_assets THEN 0.10 ELSE 0 END AS s FROM p JOIN r USING (place))
    SELECT o_orderkey, round(greatest(0, least(1, CASE WHEN o_orderstatus = 'P' THEN greatest(s, 0.9) ELSE s END)), 9) AS interest FROM i""",
)
def _interest(spark, sf_dir):
    p = _per_order(spark, sf_dir)
    places = F.broadcast(_places(p).select("place", "routine"))  # 200 of them
    rows = p.join(places, "place").withColumn("specific", F.coalesce("spec", F.lit(0.0)))
    args = ("others", F.col("faces") / F.col("n_assets"), "contributors", "specific", "n_assets", "n_assets", F.col("place") % 3 == 0, "routine", F.lit(0.0), "n_videos")
    return rows.select("o_orderkey", F.round(interest_raw(*args, F.when(F.col("o_orderstatus") == "P", 1)), 9).alias("interest"))


_VOTES = """a AS (SELECT user_id, count(*) AS n_assets FROM (SELECT DISTINCT user_id, event_id // 4 AS asset FROM events) GROUP BY user_id),
    f AS (SELECT user_id, event_id // 4 AS asset, event_type, arg_min(value / 100, event_id) AS s FROM events WHERE value / 100 >= 0.6 GROUP BY ALL),
    v AS (SELECT user_id, event_type, count(*) AS hits, avg(s) AS mean_score, count(*) / any_value(n_assets) AS coverage FROM f JOIN a USING (user_id) GROUP BY user_id, event_type)"""


def _votes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 4).alias("asset"), "event_type", (F.col("value") / 100).alias("score"), "event_id")
    n = e.groupBy("user_id").agg(F.count_distinct("asset").alias("n_assets"))
    return tags.tag_votes(e, "user_id", "asset", "event_type", "score", "event_id", n, "n_assets")


@query("tag_vote", f"WITH {_VOTES} SELECT user_id, event_type, hits, round(mean_score, 9) AS mean_score, round(coverage, 9) AS coverage FROM v")
def _tag_vote(spark, sf_dir):
    return _votes(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("mean_score", "coverage")})


@query(
    "dominant_tag",
    f"WITH {_VOTES} SELECT user_id, arg_min(event_type, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, -coverage, -mean_score, event_type)) AS event_type FROM v WHERE coverage >= 0.04 GROUP BY user_id",
)
def _dominant(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return tags.dominant_tag(_votes(spark, sf_dir), "user_id", "event_type", rank, 0.04)


_STATS = """m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type),
    s AS (SELECT event_type, any_value(med) AS med, greatest(1.4826 * median(abs(value - med)), 0.008) AS scale, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY event_type)"""


@query("robust_tag_stats", f"WITH {_STATS} SELECT event_type, round(med, 6) AS median, round(scale, 6) AS scale, n FROM s")
def _robust(spark, sf_dir):
    return tags.robust_stats(table(spark, sf_dir, "events"), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("median", "scale")})


@query("zscore_tags", f"WITH {_STATS} SELECT event_id, round((value - med) / scale, 5) AS z, round(1 / (1 + exp(-1.6 * ((value - med) / scale - 2.25))), 5) AS score FROM events JOIN s USING (event_type)")
def _zscore(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return tags.calibrated(e, tags.robust_stats(e, "event_type", "value"), "event_type", "value").select("event_id", F.round("z", 5).alias("z"), F.round("score", 5).alias("score"))


@query(
    "knn_similar",
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
    SELECT query_id, vec_id, round(s, 5) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM c) WHERE rank <= 12""",
)
def _knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return identity.similar_assets(e.where("vec_id % 50 = 0").select("vec_id", "embedding"), e, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 5)).withColumn("rank", F.col("rank").cast("long"))


_PROTO = """u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM u GROUP BY label, d),
    p AS (SELECT label, list(x ORDER BY d) AS v FROM m GROUP BY label), n AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM p)"""


@query("prototypes_mean", f"WITH {_PROTO} SELECT label, round(v[1], 6) AS first, round(v[64], 6) AS last, len(v) AS dims FROM n")
def _prototypes(spark, sf_dir):
    p = identity.mean_prototypes(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return p.select("label", F.round(F.element_at("proto", 1), 6).alias("first"), F.round(F.element_at("proto", -1), 6).alias("last"), F.size("proto").alias("dims"))


@query(
    "face_match",
    f"""WITH {_PROTO}, s AS (SELECT vec_id, n.label, list_inner_product(embedding::DOUBLE[], v) AS s FROM embeddings, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) AS r FROM s),
    b AS (SELECT a.vec_id, a.label AS person, a.s AS best, a.s - b.s AS margin FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2)
    SELECT vec_id, CAST(person AS BIGINT) AS person, round(best, 5) AS best, round(margin, 5) AS margin,
           CASE WHEN best >= 0.62 AND margin >= 0.10 THEN 'high' WHEN best >= 0.50 AND margin >= 0.06 THEN 'probable' WHEN best >= 0.42 THEN 'low' END AS tier FROM b""",
)
def _face_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = identity.match_faces(e, identity.mean_prototypes(e, "label", "embedding"), "vec_id", "embedding", "label")
    return out.select("vec_id", F.col("label").alias("person"), F.round("best", 5).alias("best"), F.round("margin", 5).alias("margin"), "tier")


@query(
    "burst_pairs",
    "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000",
)
def _burst_pairs(spark, sf_dir):
    return _bursts(spark, sf_dir)


def _bursts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    a, b = (e.withColumnsRenamed({"event_id": f"{x}_id", "us": f"{x}_us"}) for x in "ab")
    return joins.band_join(a, b, ["user_id"], "a_us", "b_us", 60_000_000).where("a_id < b_id").select("a_id", "b_id")


@query(
    "burst_groups",
    """WITH g AS (SELECT user_id, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 60000000 THEN 0 ELSE 1 END AS c, ts FROM events),
    s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
    SELECT event_id, min(event_id) OVER (PARTITION BY user_id, run) AS group_id FROM s QUALIFY count(*) OVER (PARTITION BY user_id, run) > 1""",
)
def _burst_groups(spark, sf_dir):
    return linked_groups(_bursts(spark, sf_dir), "a_id", "b_id").select(F.col("node").alias("event_id"), "group_id")


@query(
    "nearest_segment",
    """WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'), r AS (SELECT user_id, event_id AS anchor_id, epoch_us(ts) AS a FROM events WHERE event_type = 'purchase'),
    n AS (SELECT l.user_id, l.event_id, arg_min((abs(us - a), anchor_id), (abs(us - a), anchor_id)) AS b FROM l JOIN r ON l.user_id = r.user_id AND abs(us - a) <= 7200000000 GROUP BY ALL)
    SELECT l.event_id, b[1] AS gap, b[2] AS anchor_id FROM l LEFT JOIN n ON l.event_id = n.event_id""",
)
def _nearest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor_id"), F.unix_micros("ts").alias("a"))
    return joins.nearest(left, right, ["user_id"], "event_id", "us", "a", "anchor_id", 7_200_000_000).select("event_id", "gap", "anchor_id")


@query("exact_duplicates", "SELECT md5(text) AS content, length(text) AS n, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY md5(text), length(text) HAVING count(*) > 1")
def _exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content"), F.length("text").cast("long").alias("n"))
    return d.groupBy("content", "n").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies")).where("copies > 1")


_NAMES = """CASE event_id % 8 WHEN 0 THEN 'IMG_20240101_12' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.jpg' WHEN 1 THEN 'Screenshot_' || CAST(event_id AS VARCHAR) || '.png' WHEN 2 THEN 'IMG-20240101-WA' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '.jpg'
    WHEN 3 THEN 'Snapseed ' || CAST(event_id AS VARCHAR) || '.jpg' WHEN 4 THEN lpad(CAST(event_id AS VARCHAR), 16, 'a') || '.jpg' WHEN 5 THEN 'sunset' || CAST(event_id AS VARCHAR) || '.webp' ELSE 'holiday ' || CAST(event_id AS VARCHAR) || '.jpg' END"""


def _sql_any(patterns):
    return " OR ".join(f"regexp_matches(name, '{p}')" for p in patterns)


@query(
    "provenance_class",
    f"""WITH n AS (SELECT event_id, {_NAMES} AS name, CASE event_type WHEN 'signup' THEN 'Camera' WHEN 'error' THEN 'WhatsApp Images' ELSE '' END AS album, event_id % 3 = 0 AS gps FROM events)
    SELECT event_id, name, CASE WHEN regexp_matches(name, '{provenance.SCREENSHOT_NAME}') OR regexp_matches(album, '{provenance.SCREENSHOT_ALBUM}') THEN 'screenshot'
      WHEN regexp_matches(album, '{provenance.RECEIVED_ALBUM}') OR {_sql_any(provenance.RECEIVED_NAMES)} THEN 'received'
      WHEN regexp_matches(album, '{provenance.EDITED_ALBUM}') OR regexp_matches(name, '{provenance.EDITED_NAME}') THEN 'edited'
      WHEN regexp_matches(album, '{provenance.CAMERA_ALBUM}') OR gps OR {_sql_any(provenance.CAMERA_NAMES)} THEN 'camera' ELSE 'unknown' END AS origin FROM n""",
)
def _provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", _NAMES.replace("VARCHAR", "STRING") + " AS name", "array(CASE event_type WHEN 'signup' THEN 'Camera' WHEN 'error' THEN 'WhatsApp Images' ELSE '' END) AS albums", "event_id % 3 = 0 AS gps")
    none = F.lit(None)
    origin = provenance.classify_origin(F.col("name"), F.col("albums"), none.cast("string"), F.lit("image/jpeg"), F.col("gps"), none.cast("boolean"), none.cast("boolean"), none.cast("string"))
    return rows.select("event_id", "name", origin.alias("origin"))


@query(
    "trigram_title_match",
    """WITH g AS (SELECT p_partkey, p_name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: len(w) > 0), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS a,
      list_distinct(flatten(list_transform(['small', 'rings'], lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS b FROM part)
    SELECT p_partkey, p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.35""",
)
def _trigram(spark, sf_dir):
    s = trigram_similarity("p_name", F.lit("small rings"))
    return table(spark, sf_dir, "part").withColumn("similarity", s).where("similarity >= 0.35").select("p_partkey", "p_name", F.round("similarity", 6).alias("similarity"))


@query(
    "jaccard_id_match",
    """WITH a AS (SELECT DISTINCT l_orderkey AS new_id, l_partkey FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS old_id, CASE WHEN l_linenumber <= 4 THEN l_partkey ELSE -l_partkey END AS l_partkey FROM lineitem),
    n AS (SELECT new_id, old_id, count(*) AS n FROM a JOIN b USING (l_partkey) GROUP BY ALL), j AS (SELECT new_id, old_id, n / (na + nb - n) AS j FROM n JOIN (SELECT new_id, count(*) AS na FROM a GROUP BY 1) USING (new_id) JOIN (SELECT old_id, count(*) AS nb FROM b GROUP BY 1) USING (old_id))
    SELECT new_id, old_id, round(j, 6) AS jaccard FROM j WHERE j >= 0.5""",
)
def _jaccard_match(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select(F.col("l_orderkey").alias("new_id"), "l_partkey")
    b = lines.select(F.col("l_orderkey").alias("old_id"), F.when(F.col("l_linenumber") <= 4, F.col("l_partkey")).otherwise(-F.col("l_partkey")).alias("l_partkey"))
    return joins.set_matches(a, b, "new_id", "old_id", "l_partkey", 0.5).select("new_id", "old_id", F.round("jaccard", 6).alias("jaccard"))


@query(
    "grid_clusters",
    "SELECT user_id % 40 AS cell_x, CAST(floor(value / 64) AS BIGINT) AS cell_y, count(*) AS n, round(avg(value), 9) AS mean_y, arg_max(event_id, (value, -event_id)) AS representative FROM events GROUP BY ALL",
)
def _grid(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 40).alias("cell_x"), F.floor(F.col("value") / 64).alias("cell_y"))
    return e.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean_y"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("representative"))


@query(
    "export_nested",
    """SELECT o_orderkey, CAST(to_json({'id': o_orderkey, 'faces': coalesce(list({'n': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'R'), []),
        'events': coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_suppkey IS NOT NULL)), [])}) AS VARCHAR) AS record FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def _export(spark, sf_dir):
    """One record per asset with its nested faces and events; an asset without any has empty arrays."""
    face = F.when(F.col("l_returnflag") == "R", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(face)).alias("faces"), F.array_sort(F.collect_set("l_suppkey")).alias("events"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    nested = [F.coalesce(c, F.array().cast(items.schema[c].dataType)).alias(c) for c in ("faces", "events")]
    return rows.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), *nested)).alias("record"))


@query("audit_page", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey < 9000 AND o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 51")
def _audit(spark, sf_dir):
    page = table(spark, sf_dir, "orders").where("o_orderkey < 9000 AND o_orderstatus = 'O'").orderBy(F.desc("o_orderkey")).limit(51)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return page.join(names, "o_custkey", "left").select("o_orderkey", "o_custkey", "c_name")


@query(
    "manifest_upsert",
    """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(l_partkey) AS content FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1), o AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(l_partkey) AS content FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
    c AS (SELECT DISTINCT content FROM o)
    SELECT coalesce(i.k, o.k) AS k, CASE WHEN i.k IS NULL THEN 'absent' WHEN o.k IS NOT NULL AND o.content = i.content THEN 'skip' WHEN o.k IS NOT NULL THEN 'regrade' WHEN c.content IS NOT NULL THEN 'reuse' ELSE 'upload' END AS action
    FROM i FULL JOIN o ON i.k = o.k LEFT JOIN c ON i.content = c.content""",
)
def _manifest(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    incoming = lines.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")).groupBy("k").agg(F.min("l_partkey").alias("content"))
    known = lines.where("l_returnflag = 'N'").groupBy("k").agg(F.min("l_partkey").alias("old"))
    held = known.select(F.col("old").alias("content"), F.lit(True).alias("held")).distinct()
    rows = incoming.join(known, "k", "full").join(held, "content", "left")
    action = F.when(F.col("content").isNull(), "absent").when(F.col("old") == F.col("content"), "skip").when(F.col("old").isNotNull(), "regrade").when(F.col("held"), "reuse").otherwise("upload")
    return rows.select("k", action.alias("action"))


@query(
    "auto_titles",
    """WITH n AS (SELECT l_orderkey, list_sort(list_distinct(list('P' || CAST(l_suppkey AS VARCHAR)))) AS names FROM lineitem GROUP BY l_orderkey),
    h AS (SELECT o_orderkey, names, len(names) AS n, (o_orderkey * 7) % 24 AS h FROM orders JOIN n ON o_orderkey = l_orderkey)
    SELECT o_orderkey, CASE WHEN h >= 5 AND h < 11 THEN 'morning' WHEN h >= 11 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 22 THEN 'evening' ELSE 'night' END || ' with ' ||
      CASE WHEN n = 1 THEN names[1] WHEN n <= 3 THEN array_to_string(names[1:n - 1], ', ') || ' and ' || names[n] ELSE array_to_string(names[1:3], ', ') || ' and ' || CAST(n - 3 AS VARCHAR) || CASE WHEN n = 4 THEN ' other' ELSE ' others' END END AS title FROM h""",
)
def _titles(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")))).alias("names"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(names, "o_orderkey")
    return rows.select("o_orderkey", F.concat(time_of_day(F.col("o_orderkey") * 7 % 24), F.lit(" with "), list_names("names")).alias("title"))


@query(
    "city_chapters",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority AS city FROM orders), c AS (SELECT o_custkey, city, count(*) AS n FROM o GROUP BY ALL), h AS (SELECT o_custkey, arg_min(city, (-n, city)) AS home FROM c GROUP BY o_custkey),
    s AS (SELECT *, CASE WHEN city = lag(city) OVER w THEN 0 ELSE 1 END AS turn FROM o JOIN h USING (o_custkey) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT o_custkey, any_value(city) AS city, min(o_orderkey) AS first_key, count(*) AS n FROM r WHERE city <> home GROUP BY o_custkey, run HAVING count(*) >= 2""",
)
def _chapters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("city"))
    n = o.groupBy("o_custkey", "city").agg(F.count("*").alias("n"))
    home = n.groupBy("o_custkey").agg(F.min_by("city", F.struct(-F.col("n"), "city")).alias("home"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = o.join(home, "o_custkey").withColumn("turn", F.when(F.col("city") == F.lag("city").over(w), 0).otherwise(1))
    s = s.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("city <> home")
    return s.groupBy("o_custkey", "run").agg(F.first("city").alias("city"), F.min("o_orderkey").alias("first_key"), F.count("*").alias("n")).where("n >= 2").drop("run")
