"""Search, upkeep, edits and client views over the fixture tables, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.columns import centroid
from tideline.operators import joins, state, tags
from tideline.operators import visibility as vis
from tideline.operators.ordered import with_row_index
from tideline.operators.places import assign_places
from tideline.plans.media_queries import _EVENTS, _SEEN, _VIEWER, _events, _text
from tideline.plans.registry import query
from tideline.tables import table

_DAY = 86_400_000_000


def _items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", F.unix_micros("ts")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query(
    "other_angles",
    """WITH t AS (SELECT event_id, user_id, user_id % 16 AS g, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN value END AS place FROM events),
    p AS (SELECT a.event_id, b.event_id AS other_id, abs(a.us - b.us) AS apart FROM t a JOIN t b ON a.g = b.g AND a.user_id <> b.user_id AND abs(a.us - b.us) <= 60000000 AND coalesce(abs(a.place - b.place) <= 50, true))
    SELECT event_id, other_id, apart FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY apart, other_id) <= 8""",
)
def _other_angles(spark, sf_dir):
    t = _items(spark, sf_dir).select("event_id", "user_id", (F.col("user_id") % 16).alias("g"), "us", F.when(F.col("event_type") != "error", F.col("value")).alias("place"))
    other = t.withColumnsRenamed({"event_id": "other_id", "user_id": "other_user", "us": "other_us", "place": "other_place"})
    near = F.coalesce(F.abs(F.col("place") - F.col("other_place")) <= 50, F.lit(True))
    met = joins.band_join(t, other, ["g"], "us", "other_us", 60_000_000).where((F.col("user_id") != F.col("other_user")) & near)
    met = met.select("event_id", "other_id", F.abs(F.col("us") - F.col("other_us")).alias("apart"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("apart", "other_id"))
    return met.withColumn("r", rank).where("r <= 8").drop("r")


@query(
    "timeline_overview",
    f"""SELECT o_custkey % 10 AS group_id, count(*) AS n, arg_min(epoch_us(o_orderdate), (o_orderdate, o_orderkey)) AS span_from, arg_max(epoch_us(o_orderdate) + o_orderkey % 5 * {_DAY}, (o_orderdate, o_orderkey)) AS span_to
    FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""",
)
def _overview(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").withColumn("us", F.unix_micros("o_orderdate"))
    ends = F.max_by(F.col("us") + F.col("o_orderkey") % 5 * _DAY, at)
    return o.groupBy((F.col("o_custkey") % 10).alias("group_id")).agg(F.count("*").alias("n"), F.min_by("us", at).alias("span_from"), ends.alias("span_to"))


@query(
    "map_pins",
    """SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE 10 + value / 1000 BETWEEN 10.01 AND 10.06 AND 59 + CAST(user_id % 50 AS DOUBLE) / 100 BETWEEN 59.1 AND 59.3
    AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 2000""",
)
def _map_pins(spark, sf_dir):
    lon, lat = F.lit(10) + F.col("value") / 1000, F.lit(59) + (F.col("user_id") % 50).cast("double") / 100
    inside = lon.between(10.01, 10.06) & lat.between(59.1, 59.3) & F.col("ts").between(F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-25").cast("timestamp"))
    return table(spark, sf_dir, "events").where(inside).orderBy(F.desc("ts"), "event_id").limit(2000).select("event_id", "user_id", F.unix_micros("ts").alias("us"))


@query(
    "search_events",
    """SELECT l_orderkey, count(*) AS photos, epoch_us(any_value(o_orderdate)) AS start_us FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 20 IN (3, 7)
    GROUP BY l_orderkey HAVING count(DISTINCT l_partkey % 20) = 2 ORDER BY photos DESC, start_us DESC, l_orderkey LIMIT 50""",
)
def _search_events(spark, sf_dir):
    hits = _with_all(table(spark, sf_dir, "lineitem"))
    when = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_micros("o_orderdate").alias("start_us"))
    return hits.join(when, "l_orderkey").orderBy(F.desc("photos"), F.desc("start_us"), "l_orderkey").limit(50)


def _with_all(lines):
    person = F.col("l_partkey") % 20
    asked = lines.where(person.isin(3, 7)).groupBy("l_orderkey").agg(F.count("*").alias("photos"), F.count_distinct(person).alias("n"))
    return asked.where("n = 2").drop("n")


@query(
    "search_media",
    """WITH f AS (SELECT l_orderkey FROM lineitem WHERE l_partkey % 20 IN (3, 7) GROUP BY l_orderkey HAVING count(DISTINCT l_partkey % 20) = 2)
    SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) AS us FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
    AND (l_partkey % 20 = 3 AND l_suppkey % 20 = 7 OR l_partkey % 20 = 7 AND l_suppkey % 20 = 3 OR l_orderkey IN (SELECT l_orderkey FROM f)) ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 60""",
)
def _search_media(spark, sf_dir):
    """Everyone asked for on the asset, or everyone in one event of it."""
    lines = table(spark, sf_dir, "lineitem")
    ship = F.col("l_shipdate")
    asked = lines.where((ship >= F.lit("1996-01-01").cast("timestamp")) & (ship < F.lit("1999-01-01").cast("timestamp")))
    both = F.sort_array(F.array(F.col("l_partkey") % 20, F.col("l_suppkey") % 20)) == F.array(F.lit(3).cast("long"), F.lit(7).cast("long"))
    rows = asked.where(both).unionByName(asked.where(~both).join(_with_all(lines), "l_orderkey", "left_semi"))
    top = rows.orderBy(F.desc_nulls_last("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey").limit(60)
    return top.select("l_orderkey", "l_linenumber", "l_partkey", F.unix_micros("l_shipdate").alias("us"))


@query(
    "context_persons",
    """WITH p AS (SELECT DISTINCT user_id AS ev, event_id // 2 AS blob, CAST(json_extract(props, '$.k') AS BIGINT) % 30 AS person FROM events), n AS (SELECT ev, person, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT DISTINCT ev, blob FROM p)
    SELECT b.ev, b.blob, count(*) FILTER (n.n - CASE WHEN p.person IS NULL THEN 0 ELSE 1 END >= 3) AS persons FROM b JOIN n ON b.ev = n.ev LEFT JOIN p ON p.ev = b.ev AND p.blob = b.blob AND p.person = n.person GROUP BY ALL""",
)
def _context_persons(spark, sf_dir):
    """Persons on three other blobs of the event, counted without forming (blob, person) pairs: a blob loses those on it that have just three."""
    p = _items(spark, sf_dir).select(F.col("user_id").alias("ev"), F.floor(F.col("event_id") / 2).alias("blob"), (F.col("k") % 30).alias("person")).distinct()
    n = p.groupBy("ev", "person").agg(F.count("*").alias("n"))
    known = n.groupBy("ev").agg(F.count_if(F.col("n") >= 3).alias("known"))
    lost = p.join(n, ["ev", "person"]).groupBy("ev", "blob").agg(F.count_if(F.col("n") == 3).alias("lost"))
    return lost.join(known, "ev").select("ev", "blob", (F.col("known") - F.col("lost")).alias("persons"))


@query(
    "eligible_persons",
    """SELECT c_custkey FROM customer LEFT JOIN supplier ON c_custkey % 200 = s_suppkey AND c_custkey % 3 <> 0 WHERE c_acctbal >= 0 AND (c_custkey % 3 = 0 OR coalesce(s_acctbal > 3000, false))""",
)
def _eligible(spark, sf_dir):
    """Persons to match: shown, and either no user or a user who consents."""
    persons = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 200).alias("s_suppkey"))
    consents = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 3000).alias("consents"))
    return persons.join(consents, "s_suppkey", "left").where(F.col("s_suppkey").isNull() | F.coalesce("consents", F.lit(False))).select("c_custkey")


@query(
    "local_upsert",
    """WITH a AS (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'excluded' ELSE 'done' END AS state, CASE WHEN p_size % 2 = 0 THEN p_size END AS exif FROM part),
    b AS (SELECT s_suppkey * 3 AS k, 'again' AS state, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END AS exif FROM supplier)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL OR a.state NOT IN ('new', 'excluded') THEN a.state ELSE b.state END AS state, coalesce(b.exif, a.exif) AS exif FROM a FULL JOIN b ON a.k = b.k""",
)
def _local_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CASE p_size % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'excluded' ELSE 'done' END AS state", "CASE WHEN p_size % 2 = 0 THEN p_size END AS exif")
    new = table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 3 AS k", "'again' AS state", "CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END AS exif")
    return state.upsert(old, new, ["k"], {"state": ~F.col("old_state").isin("new", "excluded"), "exif": F.col("exif").isNull()})


@query(
    "hard_delete_left",
    """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_returnflag <> 'N' AND l_shipdate + INTERVAL 7 DAY <= TIMESTAMP '1998-01-01'))""",
)
def _hard_delete(spark, sf_dir):
    assets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("deleted_at"))
    blobs = table(spark, sf_dir, "orders").select("o_orderkey")
    return state.hard_deleted(assets, blobs, "o_orderkey", "deleted_at", F.lit("1998-01-01").cast("timestamp"))[1]


@query("merged_copies", "SELECT doc_id AS asset, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS blob FROM documents")
def _merged_copies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob"), F.sha2("text", 256).alias("content"), F.length("text").alias("n"))
    return state.merge_exact_copies(d, d.select(F.col("blob").alias("asset"), "blob"), "blob", ["content", "n"], "blob")[1]


@query("gone_locally", "SELECT o_orderkey, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') AS deleted FROM orders")
def _gone(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(False).alias("deleted"))
    present = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.deleted_except(known, present, "o_orderkey", "deleted")


@query(
    "staging_actions",
    """WITH a AS (SELECT l_orderkey + 3 * (l_linenumber % 2) AS l_orderkey, bool_or(l_linestatus = 'O') AS completed, bool_or(l_returnflag = 'A') AS derived FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN derived THEN 'delete' WHEN completed AND o_orderpriority <> '1-URGENT' THEN 'enqueue' WHEN l_orderkey IS NULL AND o_orderdate < TIMESTAMP '1997-12-25' THEN 'delete' ELSE 'keep' END AS action FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""",
)
def _staging(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    assets = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 3 * (F.col("l_linenumber") % 2)).alias("o_orderkey"))
    assets = assets.agg(F.max(F.col("l_linestatus") == "O").alias("completed"), F.max(F.col("l_returnflag") == "A").alias("derived"))
    jobs = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return state.staging_actions(orders.select("o_orderkey", "o_orderdate"), assets, jobs, "o_orderkey", "o_orderdate", F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "action")


@query(
    "trust_refresh",
    """SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'N' AND l_tax < 0.02) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount > 0.09) AS trusted FROM part""",
)
def _trust(spark, sf_dir):
    camera, screen = (F.col("l_returnflag") == "N") & (F.col("l_tax") < 0.02), (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09)
    flags = table(spark, sf_dir, "lineitem").where(camera | screen).groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max(camera) & ~F.max(screen)).alias("trusted"))
    return table(spark, sf_dir, "part").select("p_partkey").join(flags, "p_partkey", "left").select("p_partkey", F.coalesce("trusted", F.lit(False)).alias("trusted"))


@query(
    "participants",
    """WITH c AS (SELECT l_orderkey, l_partkey % 5 AS person, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, sum(n) AS total FROM c GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_sort(list(person)), ',') AS persons FROM c JOIN t USING (l_orderkey) WHERE n >= CASE WHEN total <= 3 THEN 1 ELSE 2 END GROUP BY l_orderkey""",
)
def _participants(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 5).alias("person")).agg(F.count("*").alias("n"))
    sets = n.groupBy("l_orderkey").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("person", "n"))).alias("seen"))
    enough = F.filter("seen", lambda s: s["n"] >= F.when(F.col("total") <= 3, 1).otherwise(2))
    return sets.where(F.size(enough) > 0).select("l_orderkey", _text(F.transform(enough, lambda s: s["person"])).alias("persons"))


@query(
    "event_covers",
    """WITH r AS (SELECT user_id, event_id, value, event_type = 'purchase' AS faces, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, coalesce(arg_max(event_id, (value, -event_id)) FILTER (faces AND value < 40), min(event_id) FILTER (ix = n // 2)) AS cover FROM r GROUP BY user_id""",
)
def _covers(spark, sf_dir):
    """The sharpest item with faces, else the middle one by time."""
    items = with_row_index(_items(spark, sf_dir).select("user_id", "event_id", "value", "event_type", "us"), "user_id", "us", "event_id")
    rows = items.join(items.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    sharp = F.when((F.col("event_type") == "purchase") & (F.col("value") < 40), F.struct("value", (-F.col("event_id")).alias("e")))
    middle = F.min(F.when(F.col("ix") == F.floor(F.col("n") / 2), F.col("event_id")))
    return rows.groupBy("user_id").agg(F.coalesce(-F.max(sharp)["e"], middle).alias("cover"))


@query(
    "best_origin",
    "SELECT l_partkey, ['camera', 'edited', 'unknown', 'received', 'screenshot'][CAST(1 + min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 3 END + l_linenumber % 2) AS INTEGER)] AS origin FROM lineitem GROUP BY l_partkey",
)
def _best_origin(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("camera", "edited", "unknown", "received", "screenshot")))
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(3) + F.col("l_linenumber") % 2
    best = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(rank).alias("rank"))
    return best.select("l_partkey", F.get(names, F.col("rank").cast("int")).alias("origin"))


@query(
    "kept_tags",
    """WITH s AS (SELECT event_id // 25 AS asset, event_id, value / 100 AS score, row_number() OVER (PARTITION BY event_id // 25 ORDER BY value / 100 DESC, event_id) AS rank FROM events WHERE event_type <> 'error')
    SELECT asset, event_id FROM s WHERE (rank <= 8 OR score >= 0.6) AND rank <= 16""",
)
def _kept_tags(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 25).alias("asset"), "event_id", (F.col("value") / 100).alias("score"), F.when(F.col("event_type") == "error", "quality").otherwise("scene").alias("category"))
    return tags.tag_result(s, "asset", "event_id", "category").select("asset", "event_id")


@query(
    "month_rows",
    f"""SELECT epoch_us(date_trunc('month', o_orderdate)) AS month, epoch_us(date_trunc('day', o_orderdate)) AS day, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_orderkey END AS row_key, count(*) AS n FROM orders GROUP BY ALL""",
)
def _month_rows(spark, sf_dir):
    """One row per event, but loose ones summed per day."""
    key = F.when(F.col("o_orderstatus") == "P", F.lit(-1).cast("long")).otherwise(F.col("o_orderkey")).alias("row_key")
    month, day = (F.unix_micros(F.date_trunc(p, "o_orderdate")).alias(p) for p in ("month", "day"))
    return table(spark, sf_dir, "orders").groupBy(month, day, key).agg(F.count("*").alias("n"))


@query("state_counts", "SELECT s AS state, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def _state_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(s,) for s in "FOPX"], "state string").join(n, "state", "left").fillna(0)


@query("strand_lanes", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey = 7 DESC, n DESC, l_suppkey LIMIT 8")
def _lanes(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n"))
    return n.orderBy((F.col("l_suppkey") == 7).desc(), F.desc("n"), "l_suppkey").limit(8)


@query(
    "month_hits",
    f"WITH {_EVENTS} SELECT epoch_us(date_trunc('month', o_orderdate)) AS month, count(*) AS n, count(*) FILTER (list_has_all(list_transform(contributors, lambda c: c % 10), [1, 2])) AS hits FROM e JOIN orders USING (o_orderkey) GROUP BY 1",
)
def _month_hits(spark, sf_dir):
    """Events per month, and those with all selected strands."""
    all_in = F.size(F.array_except(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.transform("contributors", lambda c: c % 10))) == 0
    when = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.date_trunc("month", "o_orderdate")).alias("month"))
    return _events(spark, sf_dir).join(when, "o_orderkey").groupBy("month").agg(F.count("*").alias("n"), F.count_if(all_in).alias("hits"))


@query(
    "timeline_gaps",
    """WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_custkey, o_orderkey, round(least(110, 26 * log2(1 + (epoch_us(o_orderdate) - epoch_us(before)) / 3600e6 / 12)), 6) AS px, epoch_us(o_orderdate) - epoch_us(before) > 1209600000000 AS dashed, year(o_orderdate) <> year(before) AS new_year FROM g WHERE before IS NOT NULL""",
)
def _gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    o = o.withColumn("before", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("before IS NOT NULL")
    us = F.unix_micros("o_orderdate") - F.unix_micros("before")
    px = F.round(F.least(F.lit(110.0), 26 * F.log2(1 + us / 3600e6 / 12)), 6)
    return o.select("o_custkey", "o_orderkey", px.alias("px"), (us > 14 * _DAY).alias("dashed"), (F.year("o_orderdate") != F.year("before")).alias("new_year"))


@query(
    "labelled_faces",
    """WITH f AS (SELECT event_id AS face, user_id % 10 AS person FROM events), l AS (SELECT DISTINCT event_id // 2 AS face, CAST(value AS BIGINT) % 10 AS person, value > 20 AS yes FROM events WHERE event_type = 'purchase')
    SELECT face, coalesce((SELECT min(l.person) FROM l WHERE yes AND l.face = f.face), CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE NOT yes AND l.face = f.face AND l.person = f.person) THEN person END) AS person FROM f""",
)
def _labelled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    faces = e.select(F.col("event_id").alias("face"), (F.col("user_id") % 10).alias("person"), F.lit("high").alias("tier"))
    labels = e.where("event_type = 'purchase'").select(F.floor(F.col("event_id") / 2).alias("face"), (F.rint("value").cast("long") % 10).alias("person"), F.when(F.col("value") > 20, "confirm").otherwise("reject").alias("verdict"))
    return state.labelled_faces(faces, labels, "face", "person").select("face", "person")


@query("enrolled_faces", "SELECT l_orderkey, arg_max(l_partkey, (l_quantity * l_linenumber, -l_partkey)) AS face FROM lineitem GROUP BY l_orderkey")
def _enrolled(spark, sf_dir):
    """The largest face of each photo."""
    size = F.struct((F.col("l_quantity") * F.col("l_linenumber")).alias("area"), (-F.col("l_partkey")).alias("p"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", size).alias("face"))


@query(
    "edited_members",
    """WITH m AS (SELECT DISTINCT l_orderkey AS event, l_partkey AS asset FROM lineitem), x AS (SELECT DISTINCT l_orderkey AS event, l_partkey AS asset FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05),
    i AS (SELECT p_partkey % 50 AS event, p_partkey AS asset FROM part WHERE p_size = 7)
    SELECT event, asset, 'auto' AS source FROM m WHERE (event, asset) NOT IN (SELECT event, asset FROM x) AND asset NOT IN (SELECT asset FROM i) UNION ALL SELECT event, asset, 'manual' FROM i""",
)
def _edited(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "event", "l_partkey": "asset"})
    members = lines.select("event", "asset", F.lit(0.7).alias("confidence"), F.lit("probable").alias("tier"), F.lit("auto").alias("source")).dropDuplicates(["event", "asset"])
    includes = table(spark, sf_dir, "part").where("p_size = 7").select((F.col("p_partkey") % 50).alias("event"), F.col("p_partkey").alias("asset"))
    out = state.apply_constraints(members, includes, lines.where("l_returnflag = 'R' AND l_discount > 0.05"), "event", "asset")
    return out.select("event", "asset", "source")


@query(
    "merge_preview",
    f"""WITH {_EVENTS} SELECT a.o_orderkey, CAST(len(list_distinct(list_concat(a.contributors, b.contributors))) AS BIGINT) AS n_contributors, CAST(len(list_distinct(list_concat(a.persons, b.persons))) AS BIGINT) AS n_persons,
    len(list_distinct(list_concat(a.contributors, b.contributors))) > len(a.contributors) OR len(list_distinct(list_concat(a.persons, b.persons))) > len(a.persons) OR (b.public AND NOT a.public) AS widens FROM e a JOIN e b ON b.o_orderkey = a.o_orderkey + 1""",
)
def _merge_preview(spark, sf_dir):
    """What merging an event with its successor gives, and whether more people would see it."""
    a = _events(spark, sf_dir).select("o_orderkey", "contributors", "persons", "public")
    b = a.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("contributors").alias("c2"), F.col("persons").alias("p2"), F.col("public").alias("open2"))
    c, p = F.size(F.array_union("contributors", "c2")), F.size(F.array_union("persons", "p2"))
    widens = (c > F.size("contributors")) | (p > F.size("persons")) | (F.col("open2") & ~F.col("public"))
    return a.join(b, "o_orderkey").select("o_orderkey", c.cast("long").alias("n_contributors"), p.cast("long").alias("n_persons"), widens.alias("widens"))


@query(
    "visible_blobs",
    f"WITH {_EVENTS} SELECT DISTINCT l_partkey FROM lineitem LEFT JOIN e ON l_orderkey = o_orderkey WHERE l_suppkey = 7 OR coalesce({_SEEN}, false)",
)
def _visible_blobs(spark, sf_dir):
    """Blobs of which some asset is the viewer's own or in an event that the viewer sees: semi joins in a chain."""
    lines = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("asset"), "l_suppkey", "l_partkey", F.col("l_orderkey").alias("o_orderkey"))
    seen = _events(spark, sf_dir).where(vis.event_visible(_VIEWER, "group_id", "contributors", "persons", "public", "deleted_at"))
    shown = vis.visible_assets(lines, lines.select("asset", "o_orderkey"), seen, _VIEWER, "asset", "l_suppkey", "o_orderkey")
    return shown.select("l_partkey").distinct()


@query(
    "user_centroids",
    """WITH p AS (SELECT user_id, radians(59 + CAST(user_id % 50 AS DOUBLE) / 100 + value / 100000) AS la, radians(10 + CAST(event_id % 100 AS DOUBLE) / 50000) AS lo FROM events),
    c AS (SELECT user_id, avg(cos(la) * cos(lo)) AS x, avg(cos(la) * sin(lo)) AS y, avg(sin(la)) AS z FROM p GROUP BY user_id) SELECT user_id, round(degrees(atan2(z, sqrt(x * x + y * y))), 8) AS lat, round(degrees(atan2(y, x)), 8) AS lon FROM c""",
)
def _centroids(spark, sf_dir):
    lat, lon = centroid("lat", "lon")
    return _positions(spark, sf_dir).groupBy("user_id").agg(F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


def _positions(spark, sf_dir):
    lat = F.lit(59) + (F.col("user_id") % 50).cast("double") / 100 + F.col("value") / 100000
    return _items(spark, sf_dir).select("event_id", "user_id", "us", (F.col("user_id") % 4).alias("group_id"), lat.alias("lat"), (F.lit(10) + (F.col("event_id") % 100).cast("double") / 50000).alias("lon"))


@query(
    "common_city",
    """WITH c AS (SELECT user_id, event_type AS city, count(*) AS n, min((ts, event_id)) AS first FROM events GROUP BY ALL)
    SELECT user_id, city, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""",
)
def _common_city(spark, sf_dir):
    """The most common value; of equally common ones the first seen."""
    c = _items(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("city")).agg(F.count("*").alias("n"), F.min(F.struct("us", "event_id")).alias("first"))
    best = c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "city")).alias("b"))
    return best.select("user_id", F.col("b.city").alias("city"), (-F.col("b.n")).alias("n"))


@query("founded_places")
def _places(spark, sf_dir):
    return assign_places(_positions(spark, sf_dir), "group_id", "event_id", "us", "lat", "lon")
