"""File rules, capture times, labels, persistence, edits and pages over the fixture tables, each query beside its SQL.

An event row stands for a picture (size, names and times derive from its id), an order for a gathering, a line item for
a member of it, a supplier for a contributor, a part for a content, a customer for a person.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import media
from tideline.functions.columns import haversine_m, local_xy
from tideline.operators import curation as cu
from tideline.operators import state
from tideline.operators.joins import close_pairs
from tideline.plans.registry import query
from tideline.sources import files
from tideline.tables import table

_PICTURES = """p AS (SELECT event_id, user_id, epoch_us(ts) AS us, [720, 1080, 1170, 3000][event_id % 4 + 1] AS w, [1280, 2340, 1600, 2000][event_id // 4 % 4 + 1] AS h,
    CASE event_id % 3 WHEN 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime, CASE WHEN event_id % 5 < 2 THEN 'ACME' END AS make, CASE WHEN event_id % 7 = 0 THEN 'Screen Capture 2' END AS software,
    CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) END AS captured, CASE WHEN event_id % 11 = 0 THEN 5000 END AS duration,
    CASE event_id % 6 WHEN 0 THEN 'Screenshot_1.png' WHEN 1 THEN 'screen_recording.mp4' ELSE 'img' || event_id END AS name, event_type, value FROM events)"""


def _pictures(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("us"), pick((720, 1080, 1170, 3000), i % 4).alias("w"), pick((1280, 2340, 1600, 2000), F.floor(i / 4) % 4).alias("h"),
        F.when(i % 3 == 0, "image/png").otherwise("image/jpeg").alias("mime"), F.when(i % 5 < 2, "ACME").alias("make"), F.when(i % 7 == 0, "Screen Capture 2").alias("software"),
        F.when(F.col("event_type") != "error", F.unix_micros("ts")).alias("captured"), F.when(i % 11 == 0, 5000).alias("duration"),
        F.when(i % 6 == 0, "Screenshot_1.png").when(i % 6 == 1, "screen_recording.mp4").otherwise(F.concat(F.lit("img"), i.cast("string"))).alias("name"),
    )


_SHOT = f"""(make IS NULL AND (mime = 'image/png' OR w || 'x' || h IN ({", ".join(f"'{s}'" for s in media.SCREENS)}) OR h || 'x' || w IN ({", ".join(f"'{s}'" for s in media.SCREENS)})) OR coalesce(software ILIKE '%screen capture%', false)) AND duration IS NULL"""
_CLIENT = "(event_id % 13 = 0 OR name ILIKE 'screenshot%' OR name ILIKE 'screen_recording%' OR mime = 'image/png' AND greatest(w, h) / least(w, h) > 1.9 AND greatest(w, h) / least(w, h) < 2.35)"


@query("screenshot_rules", f"WITH {_PICTURES} SELECT event_id, {_SHOT} AS by_metadata, {_CLIENT} AS by_client, mime = 'image/jpeg' AND make IS NULL AND captured IS NULL AND (greatest(w, h) <= 1600 OR greatest(w, h) = 2048) AS reencoded FROM p")
def _screenshots(spark, sf_dir):
    p, none = _pictures(spark, sf_dir), F.lit(None).cast("string")
    c = F.col
    return p.select(
        "event_id", media.screenshot_by_metadata(c("mime"), c("make"), none, c("w"), c("h"), c("software"), c("duration")).alias("by_metadata"),
        media.screenshot_by_client(c("event_id") % 13 == 0, c("name"), c("mime"), c("w"), c("h")).alias("by_client"), media.reencoded(c("mime"), c("make"), none, c("captured"), c("w"), c("h")).alias("reencoded"),
    )


@query("library_rules", f"WITH {_PICTURES} SELECT event_id, CASE WHEN event_type = 'signup' THEN 'album' WHEN {_CLIENT} THEN 'screenshot' WHEN us < epoch_us(TIMESTAMP '2024-01-10') THEN 'before_since' END AS reason FROM p")
def _library_rules(spark, sf_dir):
    c = F.col
    shot = media.screenshot_by_client(c("event_id") % 13 == 0, c("name"), c("mime"), c("w"), c("h"))
    since = F.unix_micros(F.lit("2024-01-10").cast("timestamp"))
    return _pictures(spark, sf_dir).select("event_id", media.library_exclusion(F.array("event_type"), ["signup"], shot, c("us"), since).alias("reason"))


@query("manifest_items", """SELECT event_id, '{"id":' || event_id || CASE WHEN event_type <> 'error' THEN ',"captured":' || epoch_us(ts) ELSE '' END || CASE WHEN event_id % 5 < 2 THEN ',"make":"ACME"' ELSE '' END || '}' AS item FROM events""")
def _manifest(spark, sf_dir):
    """Local rows as manifest items, in which nulls are absent."""
    return _pictures(spark, sf_dir).select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), "captured", "make")).alias("item"))


_CAPTURE = """c AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch_us(ts) + (event_id % 9 - 4) * 3600000000 + event_id % 17 * 60000000 + (CASE WHEN event_id % 40 = 1 THEN 100 * 3600000000 ELSE 0 END) END AS exif,
    event_id % 4 = 0 AS has_offset, CASE WHEN event_id % 5 < 3 THEN epoch_us(ts) END AS os, epoch_us(ts) + 86400000000 AS up, CASE event_id % 2 WHEN 0 THEN 'camera' ELSE 'received' END AS origin FROM events),
    m AS (SELECT *, CAST(floor((exif - os) / 60e6 / 15 + 0.5) * 15 AS INTEGER) AS mins, exif IS NOT NULL AND has_offset AS own FROM c)"""


@query(
    "capture_times",
    f"""WITH {_CAPTURE} SELECT event_id, CASE WHEN own THEN exif ELSE coalesce(os, exif, up) END AS us,
    CASE WHEN own THEN '+02:00' WHEN os IS NOT NULL AND abs(mins) <= 840 THEN CASE WHEN mins < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(mins) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(mins) % 60 AS VARCHAR), 2, '0') END AS zone,
    CASE WHEN own THEN coalesce(abs(os - exif) > 86400000000, false) WHEN os IS NOT NULL THEN coalesce(abs(mins) > 840, false) OR origin <> 'camera' WHEN exif IS NOT NULL THEN origin <> 'camera' ELSE true END AS uncertain FROM m""",
)
def _capture(spark, sf_dir):
    i, us = F.col("event_id"), F.unix_micros("ts")
    hour = F.lit(3_600_000_000)
    exif = F.when(i % 3 < 2, us + (i % 9 - 4) * hour + i % 17 * F.lit(60_000_000) + F.when(i % 40 == 1, 100 * hour).otherwise(F.lit(0)))
    at, zone, unsure = media.capture_time(exif, i % 4 == 0, F.lit("+02:00"), F.when(i % 5 < 3, us), us + 24 * hour, F.when(i % 2 == 0, "camera").otherwise("received"))
    return table(spark, sf_dir, "events").select("event_id", at.alias("us"), zone.alias("zone"), unsure.alias("uncertain"))


_PLACED = "SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN value % 150 - 60 END AS lat, CASE WHEN event_type <> 'error' THEN (event_id * 7) % 360 - 180 END AS lon FROM events"
_ZONE = "CASE WHEN lat IS NULL OR lon IS NULL THEN 'Europe/Oslo' " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN '{z}'" for z, a, b, c, d in media.ZONES) + " WHEN round_even(lon / 15.0, 0) = 0 THEN 'UTC' ELSE 'Etc/GMT' || CASE WHEN round_even(lon / 15.0, 0) > 0 THEN '-' ELSE '+' END || CAST(CAST(abs(round_even(lon / 15.0, 0)) AS INTEGER) AS VARCHAR) END"


def _placed(spark, sf_dir):
    known = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.unix_micros("ts").alias("us"), F.when(known, F.col("value") % 150 - 60).alias("lat"), F.when(known, (F.col("event_id") * 7 % 360 - 180).cast("double")).alias("lon")
    )


@query("zones", f"WITH e AS ({_PLACED}) SELECT event_id, {_ZONE} AS zone FROM e")
def _zones(spark, sf_dir):
    return _placed(spark, sf_dir).select("event_id", media.zone_of(F.col("lat"), F.col("lon")).alias("zone"))


@query("median_zones", f"WITH e AS ({_PLACED}), m AS (SELECT user_id, median(lat) AS lat, median(lon) AS lon FROM e GROUP BY user_id) SELECT user_id, round(lat, 6) AS lat, lon, {_ZONE} AS zone FROM m")
def _median_zones(spark, sf_dir):
    m = _placed(spark, sf_dir).groupBy("user_id").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    return m.select("user_id", F.round("lat", 6).alias("lat"), "lon", media.zone_of(F.col("lat"), F.col("lon")).alias("zone"))


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))"


@query(
    "ways_between",
    f"""WITH e AS ({_PLACED}), k AS (SELECT event_id, user_id, lat AS lat2, lon AS lon2, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1 FROM e WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    d AS (SELECT *, CASE WHEN lat1 IS NOT NULL THEN {_HAV} END AS m FROM k) SELECT event_id, round(m, 2) AS metres, round(m * (6378168.0 / 6371000.0), 2) AS db_metres, round(CASE WHEN m >= 50 THEN m / 1000 END, 5) AS km,
    round(radians(lon2 - lon1) * cos(radians(lat1)) * 6371000.0, 2) AS x, round(radians(lat2 - lat1) * 6371000.0, 2) AS y FROM d""",
)
def _ways(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = _placed(spark, sf_dir).where("lat IS NOT NULL").withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w)})
    m = F.when(F.col("plat").isNotNull(), haversine_m("plat", "plon", "lat", "lon"))
    rows = rows.withColumn("m", m)
    x, y = local_xy("lat", "lon", "plat", "plon")
    far = F.when(F.col("plat").isNotNull(), media.earth_distance_m("plat", "plon", "lat", "lon"))
    return rows.select("event_id", F.round("m", 2).alias("metres"), F.round(far, 2).alias("db_metres"), F.round(media.shown_km(F.col("m")), 5).alias("km"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


_TAGS = {"beach": "strand", "dinner": "middag", "concert": "konsert", "dog": "hund", "receipt": "kvittering", "snow": "snø", "party": "fest", "cake": "kake"}
_TAG_SQL = "(CASE event_id % 3 WHEN 0 THEN 'a photo of ' WHEN 1 THEN 'a photo of a ' ELSE 'the ' END) || (['beach', 'dinner', 'concert', 'dog', 'receipt', 'boat', 'selfie', 'blurry thing'][event_id % 8 + 1])"


@query(
    "tag_labels",
    f"""WITH t AS (SELECT event_id, {_TAG_SQL} AS tag FROM events), k AS (SELECT event_id, tag, regexp_replace(regexp_replace(regexp_replace(tag, '^a photo of ', ''), '^an? ', ''), '^(the )', '') AS key FROM t),
    l AS (SELECT unnest({list(_TAGS)}) AS key, unnest({list(_TAGS.values())}) AS label)
    SELECT event_id, k.key, coalesce(label, k.key) AS label, CASE WHEN regexp_matches(tag, 'screenshot|document|receipt|meme|text message|map') THEN 'utility' WHEN regexp_matches(tag, 'selfie|group of people|portrait') THEN 'people'
      WHEN regexp_matches(tag, 'blurry|beautiful') THEN 'quality' WHEN regexp_matches(tag, 'beach|concert|party|hike|wedding|sunset|fireworks|birthday|mountain|forest|lake|snow|cabin|boat') THEN 'activity' ELSE 'object' END AS category,
      CASE WHEN label IS NOT NULL THEN k.key END AS typed FROM k LEFT JOIN l USING (key)""",
)
def _tag_labels(spark, sf_dir):
    i = F.col("event_id")
    words = F.array(*map(F.lit, ("beach", "dinner", "concert", "dog", "receipt", "boat", "selfie", "blurry thing")))
    tag = F.concat(F.when(i % 3 == 0, "a photo of ").when(i % 3 == 1, "a photo of a ").otherwise("the "), F.get(words, (i % 8).cast("int")))
    rows = table(spark, sf_dir, "events").select("event_id", tag.alias("tag"))
    label = media.tag_label(F.col("tag"), _TAGS)
    return rows.select("event_id", media.clean_tag(F.col("tag")).alias("key"), label.alias("label"), media.tag_category(F.col("tag")).alias("category"), media.tag_key(F.concat(F.lit(" "), F.upper(label)), _TAGS).alias("typed"))


@query(
    "face_quality",
    """WITH f AS (SELECT event_id, 20 + event_id % 40 AS w, 25 + event_id % 30 AS h, 0.5 + (event_id % 10) / 20 AS score, (event_id % 21 - 10) / 20 * 10 AS nose, value AS blur FROM events),
    y AS (SELECT *, greatest(-1.0, least(1.0, (5 + nose - 5) * 10 / 100 * 2.0)) * 90.0 AS yaw FROM f)
    SELECT event_id, round(yaw, 4) AS yaw, array_to_string(list_filter([CASE WHEN least(w, h) < 32 THEN 'too_small' END, CASE WHEN score < 0.6 THEN 'low_confidence' END, CASE WHEN abs(yaw) > 60 THEN 'profile' END, CASE WHEN blur < 60 THEN 'low_quality' END], lambda x: x IS NOT NULL), ',') AS flags FROM y""",
)
def _face_quality(spark, sf_dir):
    i, zero = F.col("event_id"), F.lit(0.0)
    yaw = media.face_yaw(zero, zero, F.lit(10.0), zero, 5 + (i % 21 - 10) / 20 * 10, zero)
    rows = table(spark, sf_dir, "events").withColumn("yaw", yaw)
    flags = media.face_flags(20 + i % 40, 25 + i % 30, 0.5 + i % 10 / 20, F.col("yaw"), F.col("value"))
    return rows.select("event_id", F.round("yaw", 4).alias("yaw"), F.array_join(flags, ",").alias("flags"))


@query(
    "exif_hints",
    """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'ACME' END AS make, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-05-06 07:08:09' WHEN 1 THEN TIMESTAMP '2023-01-02 03:04:05' END AS taken,
    CASE WHEN event_id % 4 <> 3 THEN '/DCIM/Camera/a b' || event_id || '.jpg' END AS path FROM events""",
)
def _exif_hints(spark, sf_dir):
    i = F.col("event_id")
    exif = F.when(i % 4 == 0, '{"Make":"ACME","DateTimeOriginal":"2024:05:06 07:08:09"}').when(i % 4 == 1, '{"{TIFF}":{"Make":"ACME"},"{Exif}":{"DateTimeOriginal":"1980:01:01 00:00:00","DateTimeDigitized":"2023:01:02T03:04:05"}}').otherwise('{"x":1}')
    uri = F.when(i % 4 == 3, "ph://x").otherwise(F.concat(F.lit("file:///DCIM/Camera/a%20b"), i.cast("string"), F.lit(".jpg")))
    rows = table(spark, sf_dir, "events").select("event_id", exif.alias("exif"), uri.alias("uri"))
    taken = media.exif_instant(*(media.exif_field(F.col("exif"), n) for n in ("DateTimeOriginal", "DateTimeDigitized", "DateTime")))
    return rows.select("event_id", media.exif_field(F.col("exif"), "Make").alias("make"), taken.alias("taken"), media.path_of_uri(F.col("uri")).alias("path"))


_PAIR = """h AS (SELECT event_id, user_id, epoch_us(ts) AS us, CAST(event_id * 37 % 512 AS BIGINT) AS bits, [1.5, 1.5, 0.75][event_id % 3 + 1] AS aspect, event_id % 4 > 0 AS dated FROM events),
    q AS (SELECT a.event_id, b.event_id AS other_id, a.us, b.us AS other_us, bit_count(xor(a.bits, b.bits)) AS d, abs(a.us - b.us) / 1e6 AS apart, abs(a.aspect - b.aspect) / greatest(a.aspect, b.aspect) <= 0.01 AS same, a.dated AND b.dated AS dated, a.user_id // 8 = b.user_id // 8 AS own
          FROM h a JOIN h b ON a.user_id % 4 = b.user_id % 4 AND a.event_id < b.event_id AND abs(a.us - b.us) <= 3600000000),
    z AS (SELECT *, CASE WHEN d <= 4 AND same AND (apart <= 86400 OR NOT dated) THEN 'reencoded' WHEN d <= 10 AND own AND apart <= 10 THEN 'burst' END AS class FROM q)"""


def _hashed(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.col("user_id") / 8).alias("owner"), (F.col("user_id") % 4).alias("g"), F.unix_micros("ts").alias("us"), (i * 37 % 512).alias("bits"),
        F.get(F.array(F.lit(1.5), F.lit(1.5), F.lit(0.75)), (i % 3).cast("int")).alias("aspect"), (i % 4 > 0).alias("dated"))


def _pairs(spark, sf_dir):
    met = close_pairs(_hashed(spark, sf_dir), ["g"], "us", "event_id", 3_600_000_000)
    c = F.col
    kind = media.pair_class(c("bits"), c("other_bits"), c("us"), c("other_us"), c("aspect"), c("other_aspect"), c("dated") & c("other_dated"), c("owner") == c("other_owner"))
    ids = F.least("event_id", "other_event_id"), F.greatest("event_id", "other_event_id")
    return met.select(ids[0].alias("event_id"), ids[1].alias("other_id"), kind.alias("class")).where("class IS NOT NULL")


@query("pair_classes", f"WITH {_PAIR} SELECT event_id, other_id, class FROM z WHERE class IS NOT NULL")
def _pair_classes(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    "variant_links",
    f"""WITH {_PAIR}, v AS (SELECT CASE WHEN (event_id % 1000, event_id) > (other_id % 1000, other_id) THEN other_id ELSE event_id END AS variant, CASE WHEN (event_id % 1000, event_id) > (other_id % 1000, other_id) THEN event_id ELSE other_id END AS keep FROM z WHERE class = 'reencoded')
    SELECT variant, arg_max(keep, (keep % 1000, keep)) AS keep FROM v GROUP BY variant""",
)
def _variants(spark, sf_dir):
    """Of two copies the one with more pixels, here the id's last digits, stays; then the larger."""
    rows = _hashed(spark, sf_dir).withColumn("pixels", F.col("event_id") % 1000)
    return cu.best_variants(rows, "g", "event_id", "us", "bits", "aspect", "dated", "pixels", 3_600_000_000)


@query("corrected_times", "SELECT event_id, epoch_us(ts) + coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 - 3 END, 0) * 1000000 AS us FROM events JOIN supplier ON user_id = s_suppkey WHERE event_type NOT IN ('error', 'view')")
def _corrected(spark, sf_dir):
    """Clusterable items - live, of the group, no screenshots, with a time - by the clocks of their devices."""
    devices = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 7 - 3).alias("offset_s"))
    items = table(spark, sf_dir, "events").where("event_type NOT IN ('error', 'view')").select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    return cu.clock_corrected(items, devices, "user_id", "us", "offset_s").select("event_id", "us")


@query("member_devices", "SELECT DISTINCT c_custkey, n_name, event_type AS device FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _member_devices(spark, sf_dir):
    used = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("device")).distinct()
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return used.join(people, "c_custkey").select("c_custkey", "n_name", "device")


@query(
    "persisted_events",
    """WITH m AS (SELECT l_orderkey + CASE WHEN l_suppkey % 3 = 0 THEN 100000000 ELSE 0 END AS id, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'),
    n AS (SELECT id, count(*) AS n, list(l_partkey ORDER BY l_linenumber, l_partkey)[count(*) // 2 + 1] AS middle FROM m GROUP BY id), o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS cover, o_custkey AS n FROM orders)
    SELECT id, CASE WHEN n.id IS NOT NULL THEN n.n ELSE o.n END AS n, CAST(coalesce(cover, middle) AS VARCHAR) AS cover, n.id IS NULL AS deleted, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM o FULL JOIN n USING (id)""",
)
def _persisted(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("cover"), F.col("o_custkey").alias("n"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").withColumn("id", F.col("l_orderkey") + F.when(F.col("l_suppkey") % 3 == 0, 100_000_000).otherwise(0))
    sorted_ = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    new = lines.groupBy("id").agg(F.count("*").alias("n"), sorted_.alias("_m")).select("id", "n", F.get("_m", F.floor(F.col("n") / 2).cast("int"))["l_partkey"].alias("middle"))
    return cu.persisted_events(old, new, "id", "cover", "middle").withColumn("cover", F.col("cover").cast("string"))


@query("fanned_out_members", "WITH m AS (SELECT DISTINCT o_custkey AS event, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1), a AS (SELECT l_orderkey * 10 + l_linenumber AS asset, l_partkey FROM lineitem) SELECT DISTINCT event, asset FROM m JOIN a USING (l_partkey)")
def _fan_out(spark, sf_dir):
    """An event has the first picture of each order; all copies of that content are members then."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("event"))
    members = lines.where("l_linenumber = 1").join(orders, "l_orderkey").select("event", "l_partkey").distinct()
    return cu.fanned_out(members, lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset"), "l_partkey"), "l_partkey").select("event", "asset").distinct()


@query("audit_trail", "SELECT o_orderkey AS target, o_custkey AS actor, 'event.view' AS action FROM orders UNION ALL SELECT c_custkey, c_custkey, 'member.join' FROM customer")
def _audit_trail(spark, sf_dir):
    """An audit log to which two batches are appended, each handed in twice and kept once."""
    import uuid

    from tideline.operators.graph import shared_folder
    from tideline.sources.committed import CommittedTable

    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").alias("actor"), F.lit("event.view").alias("action"))
    joined = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.col("c_custkey").alias("actor"), F.lit("member.join").alias("action"))
    log = CommittedTable(spark, f"{shared_folder(spark)}/{uuid.uuid4()}", seen.schema, ["target"], buckets=8)
    for batch, rows in (0, seen), (1, joined), (0, seen), (1, joined):
        log.append(rows, batch)
    return log.read()


@query("cursors", """SELECT o_orderkey, rtrim(replace(replace(to_base64(encode('{"t":"' || strftime(o_orderdate, '%Y-%m-%d') || '?","id":' || o_orderkey || '}')), '+', '-'), '/', '_'), '=') AS cursor, o_orderkey AS back FROM orders""")
def _cursors(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    rows = rows.withColumn("cursor", cu.encoded_cursor(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("?")).alias("t"), F.col("o_orderkey").alias("id")))
    return rows.select("o_orderkey", "cursor", cu.decoded_cursor(F.col("cursor"), "t string, id long")["id"].alias("back"))


@query(
    "row_policies",
    """WITH r AS (SELECT o_orderkey, o_custkey % 10 = 3 AS grp, o_custkey = 13 AS own, o_orderpriority = '1-URGENT' AS open, o_orderstatus = 'F' AS gone FROM orders)
    SELECT o_orderkey, grp AND NOT gone AND (own OR open) AS can_select, grp AND own AS can_update, false AS can_delete FROM r""",
)
def _policies(spark, sf_dir):
    member, own = F.col("o_custkey") % 10 == 3, F.col("o_custkey") == 13
    live = member & (F.col("o_orderstatus") != "F")
    policies = {"select": [live & own, live & (F.col("o_orderpriority") == "1-URGENT")], "update": [member & own], "delete": []}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(f"can_{name}") for name, c in cu.allowed(policies).items()))


@query("quiet_filter", "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END AS i FROM orders) SELECT o_orderkey, coalesce(i >= 0.3, true) AS shown, coalesce(i < 0.3, false) AS quiet FROM r")
def _quiet(spark, sf_dir):
    """Quiet events are those of known, low interest; hide leaves the others, only shows them."""
    quiet = cu.quiet(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500_000))
    return table(spark, sf_dir, "orders").select("o_orderkey", (~quiet).alias("shown"), quiet.alias("quiet"))


@query("event_media", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax < 0.02 AS uncertain FROM lineitem WHERE l_discount >= 0.05 AND (l_suppkey % 10 = 3 OR l_suppkey % 10 = 7) AND l_returnflag <> 'R'""")
def _event_media(spark, sf_dir):
    """Members of an event of a tier, with one of two persons, pictures only; and whether they are among the uncertain."""
    persons = F.array((F.col("l_suppkey") % 10).cast("int"))
    wanted = F.arrays_overlap(persons, F.array(F.lit(3), F.lit(7))) & (F.col("l_discount") >= 0.05) & (F.col("l_returnflag") != "R")
    return table(spark, sf_dir, "lineitem").where(wanted).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_tax") < 0.02).alias("uncertain"))


@query("media_page_asc", "SELECT l_orderkey * 10 + l_linenumber AS asset, l_partkey FROM lineitem WHERE (coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, TIMESTAMP '1970-01-01'), l_orderkey * 10 + l_linenumber, l_partkey) > (TIMESTAMP '1997-06-01', 500, 0) ORDER BY coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, TIMESTAMP '1970-01-01'), asset, l_partkey LIMIT 61")
def _media_page(spark, sf_dir):
    at = F.coalesce(F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")), F.lit("1970-01-01").cast("timestamp"))
    rows = table(spark, sf_dir, "lineitem").select(at.alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset"), "l_partkey")
    after = F.struct("at", "asset", "l_partkey") > F.struct(F.lit("1997-06-01").cast("timestamp").alias("at"), F.lit(500).cast("long").alias("asset"), F.lit(0).cast("long").alias("l_partkey"))
    return rows.where(after).orderBy("at", "asset", "l_partkey").limit(61).select("asset", "l_partkey")


@query("best_candidates", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS score FROM lineitem ORDER BY score DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("score"))
    return rows.orderBy(F.desc_nulls_last("score"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query("person_by_name", "WITH p AS (SELECT p_partkey AS id, lower(trim('  ' || p_name || ' ')) AS name, p_size % 5 = 0 AS member FROM part) SELECT name, arg_min(id, (NOT member, id)) AS id FROM p GROUP BY name")
def _person_by_name(spark, sf_dir):
    """The person that a name stands for: one linked with a member, then the lowest id."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("name"), (F.col("p_size") % 5 != 0).alias("stranger"))
    return rows.groupBy("name").agg(F.min_by("id", F.struct("stranger", "id")).alias("id"))


@query("unknown_faces", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND NOT list_has_any([CASE WHEN l_discount < 0.02 THEN 'too_small' ELSE '' END, CASE WHEN l_tax < 0.02 THEN 'low_confidence' ELSE '' END], ['too_small', 'low_confidence']) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0)")
def _unknown_faces(spark, sf_dir):
    """Faces without a person that are good enough to cluster, of owners who agree."""
    flags = F.array(F.when(F.col("l_discount") < 0.02, "too_small").otherwise(""), F.when(F.col("l_tax") < 0.02, "low_confidence").otherwise(""))
    against = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = cu.clusterable_faces(table(spark, sf_dir, "lineitem"), flags, F.col("l_returnflag") == "N", against, "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query("regraded", "WITH u AS (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 AND p_type IN ('ECONOMY', 'SMALL') THEN 'camera' ELSE 'unknown' END AS origin FROM part) SELECT p_partkey, origin, CASE WHEN origin = 'camera' THEN 1 ELSE 0 END AS version FROM u")
def _regraded(spark, sf_dir):
    """Candidates of the old version and of given states are graded anew, in one join of ids and origins."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", F.lit("unknown").alias("origin"), F.lit(0).alias("version"))
    todo = rows.where((F.col("version") < 1) & F.col("p_type").isin("ECONOMY", "SMALL") & (F.col("p_size") % 3 == 0)).select("p_partkey", F.lit("camera").alias("origin"), F.lit(1).alias("version"))
    return state.upsert(rows.select("p_partkey", "origin", "version"), todo, ["p_partkey"])


@query(
    "media_items",
    f"""WITH {_PICTURES} SELECT event_id, event_id % 3 > 0 AS has_original, make IS NOT NULL AS has_thumb, captured IS NOT NULL AS analyzed, coalesce(CASE WHEN event_id % 3 > 0 THEN 'o/' || event_id END, 'p/' || event_id) AS original_key,
    coalesce(CASE WHEN make IS NOT NULL THEN 't/' || event_id END, 'p/' || event_id) AS thumb_key FROM p""",
)
def _media_items(spark, sf_dir):
    i = F.col("event_id").cast("string")
    keys = {"o": F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("o/"), i)), "t": F.when(F.col("make").isNotNull(), F.concat(F.lit("t/"), i)), "p": F.concat(F.lit("p/"), i)}
    return _pictures(spark, sf_dir).select(
        "event_id", keys["o"].isNotNull().alias("has_original"), keys["t"].isNotNull().alias("has_thumb"), F.col("captured").isNotNull().alias("analyzed"),
        F.coalesce(keys["o"], keys["p"]).alias("original_key"), F.coalesce(keys["t"], keys["p"]).alias("thumb_key"),
    )


@query(
    "event_titles",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Mine' WHEN 1 THEN 'No ' || o_orderkey WHEN 2 THEN 'En ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') END AS title,
    CASE WHEN o_orderkey % 4 = 0 THEN 'maybe_two_events' WHEN o_totalprice / 400000 >= 0.75 THEN 'sure_one_event' ELSE 'maybe_more_events' END AS wording,
    CAST(floor(least(26.0, 13 + log2(greatest(1, o_custkey)) * 1.6) + 0.5) AS INTEGER) AS radius, CASE WHEN o_orderkey % 24 >= 18 OR o_orderkey % 24 < 5 THEN 'night' WHEN o_orderkey % 24 < 11 THEN 'morning' WHEN o_orderkey % 24 < 17 THEN 'afternoon' ELSE 'evening' END AS page_time,
    CASE o_orderkey % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'manifested' ELSE 'preview_uploaded' END AS state FROM orders""",
)
def _event_titles(spark, sf_dir):
    k = F.col("o_orderkey")
    auto = F.when(k % 5 == 1, F.to_json(F.struct(F.concat(F.lit("En "), k).alias("en"), F.concat(F.lit("No "), k).alias("nb")))).when(k % 5 == 2, F.to_json(F.struct(F.concat(F.lit("En "), k).alias("en"))))
    action = F.when(k % 3 == 0, "skip").when(k % 3 == 1, "want_preview").otherwise("want_original")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", media.resolved_title(F.when(k % 5 == 0, "Mine"), auto, "nb", F.col("o_orderdate")).alias("title"),
        media.confidence_wording(F.col("o_totalprice") / 400_000, F.when(k % 4 == 0, 1).otherwise(0)).alias("wording"), media.node_radius(F.col("o_custkey")).alias("radius"),
        media.page_time(k % 24).alias("page_time"), media.state_for(action).alias("state"),
    )


_TITLE_SQL = """WITH n AS (SELECT l_orderkey, list_sort(list_distinct(list('P' || CAST(l_suppkey AS VARCHAR)) FILTER (l_returnflag = 'R'))) AS names FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT o_orderkey, coalesce(names, []) AS names, o_orderdate + to_hours(o_orderkey * 7 % 24) AS moment_at, CASE WHEN o_orderkey % 29 = 0 THEN 'Lars' WHEN o_orderkey % 31 = 0 THEN 'Kari' END AS birthday, CASE WHEN o_orderkey % 3 = 0 THEN 'Dinner' END AS activity, o_orderkey % 2 = 0 AS scene,
          CASE WHEN o_orderkey % 5 = 0 THEN 'The hut' END AS place, CASE WHEN o_orderkey % 7 < 3 THEN 'Oslo' END AS city FROM orders LEFT JOIN n ON o_orderkey = l_orderkey),
    w AS (SELECT *, len(names) AS n, hour(moment_at) AS h, {days}[isodow(moment_at)] AS day FROM r),
    v AS (SELECT *, day || ' ' || CASE WHEN h >= 5 AND h < 11 THEN '{morning}' WHEN h >= 11 AND h < 17 THEN '{afternoon}' WHEN h >= 17 AND h < 22 THEN '{evening}' ELSE '{night}' END AS moment,
          CASE WHEN n = 1 THEN names[1] WHEN n <= 3 THEN array_to_string(names[1:n - 1], ', ') || ' {land} ' || names[n] ELSE array_to_string(names[1:3], ', ') || ' {land} ' || (n - 3) || CASE WHEN n = 4 THEN ' {other}' ELSE ' {others}' END END AS who FROM w),
    t AS (SELECT o_orderkey, CASE WHEN birthday IS NOT NULL THEN {birthday} WHEN activity IS NOT NULL AND n > 0 THEN activity || ' {with} ' || who WHEN place IS NOT NULL AND n > 0 THEN place || ' {with} ' || who
      WHEN activity IS NOT NULL AND city IS NOT NULL THEN CASE WHEN scene THEN activity || ' — ' || city ELSE activity || ' {in} ' || city END WHEN activity IS NOT NULL THEN activity WHEN place IS NOT NULL THEN place || ', ' || moment
      WHEN n > 0 THEN moment || ' {with} ' || who ELSE moment || coalesce(' — ' || city, '') END AS title FROM v) SELECT o_orderkey, upper(title[1]) || title[2:] AS title FROM t"""


def _titles(spark, sf_dir, locale):
    k = F.col("o_orderkey")
    named = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("P"), F.col("l_suppkey").cast("string")))
    names = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(named)).alias("names"))
    rows = table(spark, sf_dir, "orders").join(names, "o_orderkey", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    local = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k * 7 % 24).cast("int"))
    title = media.auto_title(
        F.col("names"), F.when(k % 29 == 0, "Lars").when(k % 31 == 0, "Kari"), F.when(k % 3 == 0, "Dinner"), k % 2 == 0, F.when(k % 5 == 0, "The hut"), F.when(k % 7 < 3, "Oslo"), local, locale
    )
    return rows.select("o_orderkey", title.alias("title"))


_EN = media.WORDS["en"] | {"days": media.WEEKDAYS["en"], "land": "and", "other": "other", "others": "others", "birthday": "birthday || '''s birthday'"}
_NB = media.WORDS["nb"] | {"days": media.WEEKDAYS["nb"], "land": "og", "other": "annen", "others": "andre", "birthday": "birthday || CASE WHEN regexp_matches(birthday, '(?i)[sxz]$') THEN ''' bursdag' ELSE 's bursdag' END"}


@query("title_rules_en", _TITLE_SQL.format(**_EN))
def _titles_en(spark, sf_dir):
    return _titles(spark, sf_dir, "en")


@query("title_rules_nb", _TITLE_SQL.format(**_NB))
def _titles_nb(spark, sf_dir):
    return _titles(spark, sf_dir, "nb")


@query("event_contributors", "WITH c AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_suppkey) AS rank FROM c")
def _event_contributors(spark, sf_dir):
    return cu.counted(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey").withColumn("rank", F.col("rank").cast("long"))


@query("place_counts", "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey) SELECT c_custkey, c_name, coalesce(n, 0) AS n FROM customer LEFT JOIN n ON c_custkey = o_custkey WHERE coalesce(n, 0) > 0 OR c_mktsegment = 'MACHINERY'")
def _place_counts(spark, sf_dir):
    """Places with the events there that the viewer sees; places without any only if they have a name."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return cu.place_counts(table(spark, sf_dir, "customer"), seen, "c_custkey", F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name", "n")


@query(
    "widened_windows",
    """WITH l AS (SELECT l_suppkey AS g, epoch_us(l_shipdate) AS us, l_returnflag = 'N' AS fresh, CAST(l_quantity AS BIGINT) * 3600000000 AS us_long FROM lineitem),
    b AS (SELECT g, CASE WHEN fresh THEN us - 21600000000 ELSE us END AS lo, CASE WHEN fresh THEN us + 21600000000 ELSE us + us_long END AS hi, fresh FROM l),
    a AS (SELECT g, lo, hi, bool_or(fresh) AS fresh FROM b GROUP BY g, lo, hi),
    s AS (SELECT *, lo <= max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS joins FROM a), n AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS no FROM s)
    SELECT g, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY g, no HAVING bool_or(fresh)""",
)
def _widened(spark, sf_dir):
    """The spans that new items open, padded, joined and widened to the events that stand: of all lines those not yet
    returned are new items, the others events of as many hours as their quantity."""
    from tideline.streaming.incremental import widened_spans

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.unix_micros("l_shipdate").alias("us"), "l_returnflag", "l_quantity")
    events = rows.where("l_returnflag <> 'N'").select("g", F.col("us").alias("start_us"), (F.col("us") + F.col("l_quantity").cast("long") * 3_600_000_000).alias("end_us"))
    return widened_spans(rows.where("l_returnflag = 'N'"), events, "g", "us")


@query(
    "event_confidence",
    """WITH m AS (SELECT l_orderkey, l_linenumber / 7 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS b FROM lineitem)
    SELECT l_orderkey, round(greatest(0.0, least(1.0, sum(c * CASE WHEN a <= 3 OR b <= 3 THEN 2 ELSE 1 END) / sum(CASE WHEN a <= 3 OR b <= 3 THEN 2 ELSE 1 END) - 0.1 * (l_orderkey % 2))), 4) AS confidence FROM m GROUP BY l_orderkey""",
)
def _event_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.struct("l_linenumber", "l_partkey").alias("tie"), (F.col("l_linenumber") / 7).alias("c"))
    return cu.event_confidence(rows, "l_orderkey", "l_shipdate", "tie", "c", F.col("l_orderkey") % 2)


@query(
    "best_title_match",
    """WITH g AS (SELECT p_partkey, p_name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: len(w) > 0), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS a,
      list_distinct(flatten(list_transform(['small', 'rings'], lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS b FROM part)
    SELECT p_partkey, p_name FROM g WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.35 ORDER BY len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) DESC, p_partkey LIMIT 1""",
)
def _best_title(spark, sf_dir):
    from tideline.functions.columns import trigram_similarity

    rows = table(spark, sf_dir, "part").withColumn("s", trigram_similarity("p_name", F.lit("small rings"))).where("s >= 0.35")
    return rows.orderBy(F.desc("s"), "p_partkey").limit(1).select("p_partkey", "p_name")


@query("decoded_vectors", "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: round(x, 3))), 2) AS total FROM embeddings")
def _vectors(spark, sf_dir):
    """Vectors that come as text, decoded to floats."""
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.format_string("%.3f", F.round(x.cast("double"), 3))), ", "), F.lit("]"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", files.vector_of(text).alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 2).alias("total"))


@query(
    "raw_tag_scores",
    """WITH v AS (SELECT label AS tag, embedding AS vec FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) SELECT vec_id, tag, round(list_sum(list_transform(list_zip(embedding, vec), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 5) AS score FROM embeddings, v""",
)
def _raw_scores(spark, sf_dir):
    """Products of each picture's vector with each tag's; the first vector of a label stands for its tag."""
    rows = table(spark, sf_dir, "embeddings")
    words = rows.groupBy(F.col("label").alias("tag")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    return cu.vocabulary_scores(rows, words, "vec_id", "embedding", "tag", "vec").select("vec_id", "tag", F.round("score", 5).alias("score"))


@query("faces_with_vectors", "SELECT l_orderkey, l_linenumber, l_partkey, label FROM lineitem JOIN embeddings ON l_partkey = vec_id")
def _faces_vectors(spark, sf_dir):
    faces = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return faces.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("l_partkey"), "label"), "l_partkey")


@query(
    "retag_due",
    """WITH s AS (SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 > 0) AS was, avg(embedding[1]) AS now_x, avg(embedding[1]) FILTER (vec_id % 3 > 0) AS was_x FROM embeddings WHERE embedding IS NOT NULL GROUP BY label)
    SELECT label, n, n >= 40 AND (was = 0 OR abs(n - was) > 0.1 * was) AS due, n >= 40 AND coalesce(abs(now_x - was_x) > 0.1 * abs(was_x), true) AS drifted FROM s""",
)
def _retag(spark, sf_dir):
    """Tags are rewritten where a group has enough analysed pictures and has grown by more than a tenth since its statistics;
    `drifted` says whether the statistics themselves, here the mean of a component, have moved by as much."""
    from tideline.operators.tag_stats import retag_due

    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    x = F.get("embedding", F.lit(0)).cast("double")
    now, before = (df.groupBy("label").agg(F.count("*").alias("n"), F.avg(x).alias("x")) for df in (rows, rows.where("vec_id % 3 > 0")))
    means = now.select(F.col("label").alias("_l"), F.col("x").alias("_now")).join(before.select(F.col("label").alias("_b"), F.col("x").alias("_was")), F.col("_l").eqNullSafe(F.col("_b")), "left")
    moved = F.coalesce(F.abs(F.col("_now") - F.col("_was")) > 0.1 * F.abs("_was"), F.lit(True))
    due = retag_due(now, before, ["label"])
    return due.join(means, F.col("label").eqNullSafe(F.col("_l"))).select("label", "n", "due", ((F.col("n") >= 40) & moved).alias("drifted"))


@query(
    "opened_events",
    """SELECT o_orderkey, CASE WHEN l IS NOT NULL AND o_orderstatus <> 'F' THEN true WHEN l IS NOT NULL THEN false ELSE o_orderpriority = '1-URGENT' END AS public FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem WHERE l_suppkey = 7) ON o_orderkey = l""",
)
def _opened(spark, sf_dir):
    """A contributor opens live events and closes the others; anyone else changes nothing."""
    own = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("own")).distinct()
    rows = table(spark, sf_dir, "orders").join(own, "o_orderkey", "left")
    return rows.select("o_orderkey", cu.opened(F.col("o_orderpriority") == "1-URGENT", F.col("own"), F.col("o_orderstatus") != "F").alias("public"))


@query(
    "manual_tags",
    """WITH t AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)),
    r AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_discount = 0) SELECT l_orderkey, l_suppkey FROM (SELECT * FROM t UNION SELECT * FROM a) EXCEPT SELECT * FROM r""",
)
def _manual_tags(spark, sf_dir):
    lines, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"]
    known = table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    return cu.tagged(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), lines.where("l_discount = 0"), known, keys, "l_suppkey")


@query(
    "split_pins",
    """WITH e AS (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1) SELECT DISTINCT l_orderkey, epoch_us(l_shipdate) AS at FROM lineitem JOIN e USING (l_orderkey) WHERE l_shipdate > s AND l_shipdate < e""",
)
def _split_pins(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", F.unix_micros("l_shipdate").alias("at"))
    return cu.split_pins(asked.groupBy("l_orderkey").agg(F.min("at").alias("s"), F.max("at").alias("e")), asked, "l_orderkey", "s", "e", "at")


@query(
    "assigned_clusters",
    """WITH c AS (SELECT s_suppkey AS cluster, s_nationkey AS person FROM supplier WHERE s_acctbal >= 0 AND s_nationkey > 4), f AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size END AS person FROM part),
    g AS (SELECT l_partkey, min(person) AS who FROM lineitem JOIN c ON l_suppkey = cluster GROUP BY l_partkey) SELECT p_partkey, coalesce(person, who) AS person FROM f LEFT JOIN g ON p_partkey = l_partkey""",
)
def _assigned(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set("l_partkey").alias("faces"))
    clusters = table(spark, sf_dir, "supplier").join(members, "s_suppkey").select(F.col("s_suppkey").alias("cluster"), F.when(F.col("s_nationkey") > 4, F.col("s_nationkey")).alias("person"), (F.col("s_acctbal") < 0).alias("dismissed"), "faces")
    faces = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.col("p_size")).alias("person"))
    return cu.assigned_clusters(faces, clusters, "cluster", "p_partkey", "person")


@query(
    "merged_persons",
    """WITH p AS (SELECT lower(p_name) AS name, min(p_partkey) AS keep FROM part GROUP BY 1) SELECT p_partkey AS source, keep AS target FROM part JOIN p ON lower(p_name) = name WHERE p_partkey <> keep""",
)
def _merged_persons(spark, sf_dir):
    """Persons of one name are merged, each into the one before it; chains end at the first."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    before = F.lag("p_partkey").over(Window.partitionBy("name").orderBy("p_partkey"))
    merges = rows.select(F.col("p_partkey").alias("source"), before.alias("target")).where("target IS NOT NULL")
    return cu.merged_persons(merges, "source", "target")


@query("renamed_places", "SELECT c_custkey, CASE WHEN c_nationkey = 3 AND c_custkey % 2 = 0 THEN 'Place ' || c_custkey ELSE c_name END AS name FROM customer")
def _renamed(spark, sf_dir):
    """New names hold for places of the user's own group only."""
    rows = table(spark, sf_dir, "customer")
    asked = rows.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("Place "), F.col("c_custkey").cast("string")).alias("c_name"))
    return cu.renamed(rows, asked, "c_custkey", "c_name", F.col("c_nationkey") == 3).select("c_custkey", F.col("c_name").alias("name"))


@query(
    "consent_purge",
    """WITH ok AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0), f AS (SELECT 'face' AS kind, l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_suppkey IN (SELECT * FROM ok) AS known FROM lineitem)
    SELECT kind, l_orderkey AS id, l_linenumber AS idx, CASE WHEN known THEN l_suppkey END AS person, CASE WHEN known THEN l_returnflag END AS tier FROM f
    UNION ALL SELECT DISTINCT 'label', l_partkey, 0, l_suppkey, NULL FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT * FROM ok)
    UNION ALL SELECT DISTINCT 'prototype', l_suppkey, l_linenumber, l_suppkey, NULL FROM lineitem WHERE l_suppkey IN (SELECT * FROM ok)""",
)
def _purge(spark, sf_dir):
    """All three results after persons withdrew their consent: faces without their names, and the labels and prototypes
    of those who still agree. Returned lines stand for labels given by hand, line numbers for prototypes."""
    lines = table(spark, sf_dir, "lineitem")
    person, none = F.col("l_suppkey").alias("person"), F.lit(None).cast("string").alias("tier")
    faces = lines.select(F.lit("face").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("idx"), person, F.col("l_returnflag").alias("tier"))
    labels = lines.where("l_returnflag = 'R'").select(F.lit("label").alias("kind"), F.col("l_partkey").alias("id"), F.lit(0).cast(faces.schema["idx"].dataType).alias("idx"), person, none).distinct()
    prototypes = lines.select(F.lit("prototype").alias("kind"), F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("idx"), person, none).distinct()
    eligible = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("person"))
    kept = [df.select(faces.columns) for df in cu.purged(faces, labels, prototypes, eligible, "person")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query(
    "participant_counts",
    "SELECT l_orderkey, l_suppkey % 100 AS person, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL",
)
def _participant_counts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.array(F.col("l_suppkey") % 100).alias("persons"))
    return cu.participant_counts(items, "l_orderkey", "l_partkey", "persons")


@query(
    "calendar_marks",
    """WITH o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, lag(strftime(o_orderdate, '%Y')) OVER w AS py, lag(strftime(o_orderdate, '%Y-%m')) OVER w AS pm FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))
    SELECT o_custkey, o_orderkey, CASE WHEN py IS NULL OR py <> y THEN 'year' ELSE 'month' END AS kind, CASE WHEN py IS NULL OR py <> y THEN y ELSE m END AS label FROM o WHERE py IS NULL OR py <> y OR pm <> m""",
)
def _marks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy").alias("y"), F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    rows = rows.withColumns({"py": F.lag("y").over(w), "pm": F.lag("m").over(w)})
    year = F.col("py").isNull() | (F.col("py") != F.col("y"))
    return rows.where(year | (F.col("pm") != F.col("m"))).select("o_custkey", "o_orderkey", F.when(year, "year").otherwise("month").alias("kind"), F.when(year, F.col("y")).otherwise(F.col("m")).alias("label"))


@query(
    "moment_ways",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 > 0 THEN 50 + l_partkey % 20 END AS lat, CASE WHEN l_partkey % 4 > 0 THEN 5 + l_partkey % 7 END AS lon FROM lineitem WHERE l_partkey % 9 > 0),
    m AS (SELECT l_orderkey, l_linenumber, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ',') AS items, arg_min(lat, l_partkey) FILTER (lat IS NOT NULL) AS lat2, arg_min(lon, l_partkey) FILTER (lat IS NOT NULL) AS lon2 FROM a GROUP BY 1, 2),
    p AS (SELECT *, last_value(lat2 IGNORE NULLS) OVER w AS lat1, last_value(lon2 IGNORE NULLS) OVER w AS lon1 FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, items, CASE WHEN lat1 IS NOT NULL AND lat2 IS NOT NULL THEN round({_HAV}, 1) END AS metres FROM p""",
)
def _moment_ways(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    moments = lines.groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    k = F.col("p_partkey")
    known = table(spark, sf_dir, "part").where("p_partkey % 9 > 0").select(k, F.when(k % 4 > 0, (50 + k % 20).cast("double")).alias("lat"), F.when(k % 4 > 0, (5 + k % 7).cast("double")).alias("lon"))
    out = cu.moment_rows(moments, known, "l_orderkey", "l_linenumber", "ids", "p_partkey")
    return out.select("l_orderkey", "l_linenumber", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.round("metres", 1).alias("metres"))


@query("away_chapters")
def _away(spark, sf_dir):
    """Stays away from the home city, with events without a city riding along; a fold in SQL, tested against one in order."""
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.unix_micros("o_orderdate").alias("start_us"), (F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 30) * 3_600_000_000).alias("end_us"),
        F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1)).alias("city"),
    )
    home = cu.counted(o.where("city IS NOT NULL"), ["o_custkey"], "city").where("rank = 1").select("o_custkey", F.col("city").alias("home"))
    return cu.chapters(o.join(home, "o_custkey"), "o_custkey", "start_us", "end_us", "o_orderkey", "city", "home")


@query("person_prototypes")
def _person_prototypes(spark, sf_dir):
    """Up to twelve prototypes per person by k means; tested against the same rounds in numpy."""
    rows = cu.kmeans_prototypes(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return rows.select("label", "idx", F.transform("proto", lambda x: F.round(x, 6)).alias("proto"))


@query(
    "cluster_reuse",
    """WITH a AS (SELECT DISTINCT l_suppkey AS new_id, l_partkey FROM lineitem), b AS (SELECT DISTINCT l_suppkey + 1000000 AS old_id, CASE WHEN l_linenumber < 7 THEN l_partkey ELSE -l_orderkey END AS l_partkey FROM lineitem),
    n AS (SELECT new_id, old_id, count(*) AS n FROM a JOIN b USING (l_partkey) GROUP BY ALL), j AS (SELECT new_id, old_id, n / (na + nb - n) AS j FROM n JOIN (SELECT new_id, count(*) AS na FROM a GROUP BY 1) USING (new_id) JOIN (SELECT old_id, count(*) AS nb FROM b GROUP BY 1) USING (old_id))
    SELECT new_id, arg_max(old_id, (j, -old_id)) AS old_id FROM j WHERE j >= 0.5 GROUP BY new_id""",
)
def _cluster_reuse(spark, sf_dir):
    """Clusters of faces after a new run go on under the id of the old one that they share half with, one to one."""
    lines = table(spark, sf_dir, "lineitem")
    new = lines.select(F.col("l_suppkey").alias("new_id"), "l_partkey")
    old = lines.select((F.col("l_suppkey") + 1_000_000).alias("old_id"), F.when(F.col("l_linenumber") < 7, F.col("l_partkey")).otherwise(-F.col("l_orderkey")).alias("l_partkey"))
    return cu.reused_clusters(new, old, "new_id", "old_id", "l_partkey").select("new_id", "old_id")
