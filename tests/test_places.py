"""Places against the pass in time order that they stand for; upkeep on rows without content."""

import math
import random

import pytest

from tideline.operators.places import assign_places
from tideline.operators.state import merge_exact_copies, staging_actions
from pyspark.sql import functions as F

ITEMS = "g int, id int, at long, lat double, lon double"
PLACES = "group int, place int, lat double, lon double, radius_m double"


def _metres(a, b):
    la, lo, lb, mo = (math.radians(x) for x in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


def _in_order(items, existing=()):
    places = {}
    for g, p, lat, lon, radius in existing:
        places.setdefault(g, []).append((p, (lat, lon), max(300.0, radius)))
    out = {}
    for g, i, _, lat, lon in sorted((x for x in items if x[3] is not None), key=lambda x: (x[2], x[1])):
        near = [(_metres((lat, lon), at), p) for p, at, reach in places.get(g, []) if _metres((lat, lon), at) <= reach]
        if not near:
            places.setdefault(g, []).append((i, (lat, lon), 300.0))
        out[i] = min(near)[1] if near else i
    return out


def _made(n, seed, lon=10.0):
    rng = random.Random(seed)
    return [(rng.randrange(2), i, rng.randrange(50), 59 + rng.random() / 100, lon + rng.random() / 50) for i in range(n)]


@pytest.mark.parametrize("items, existing", [
    (_made(150, 1), []),
    (_made(120, 2, lon=179.99), [(0, 1000, 59.005, 180.0, 800.0), (1, 1001, 59.005, -179.999, 10.0)]),
    ([(1, i, 7, 59.0, 10.0) for i in range(40)] + [(1, 99, 0, None, 10.0)], []),
    ([], []),
])
def test_places_equal_a_pass_in_order(spark, items, existing):
    held = spark.createDataFrame(existing, PLACES).withColumnRenamed("group", "g") if existing else None
    rows = assign_places(spark.createDataFrame(items, ITEMS), "g", "id", "at", "lat", "lon", held).collect()
    assert {r["id"]: r["place"] for r in rows} == _in_order(items, existing)
    assert all(r["is_new"] == (r["place"] < 1000) for r in rows)


def test_unknown_content_is_no_copy(spark):
    blobs = spark.createDataFrame([(1, "x", 3), (2, "x", 2), (3, None, 1), (4, None, 0)], "b int, content string, at int")
    kept, assets = merge_exact_copies(blobs, spark.createDataFrame([(10, 1), (11, 3), (12, 4)], "asset int, b int"), "b", ["content"], "at")
    assert sorted(r["b"] for r in kept.collect()) == [2, 3, 4]
    assert sorted(tuple(r) for r in assets.select("asset", "b").collect()) == [(10, 2), (11, 3), (12, 4)]


def test_staging_actions(spark):
    listing = spark.createDataFrame([(k, "2024-01-01" if k < 5 else "2024-03-01") for k in range(1, 7)], "k int, day string").withColumn("at", F.col("day").cast("timestamp"))
    assets = spark.createDataFrame([(1, True, True), (2, True, False), (3, True, False), (4, False, False)], "k int, completed boolean, derived boolean")
    jobs = spark.createDataFrame([(3,), (3,)], "k int")
    out = staging_actions(listing, assets, jobs, "k", "at", F.lit("2024-03-02").cast("timestamp"))
    assert {r["k"]: r["action"] for r in out.collect()} == {1: "delete", 2: "enqueue", 3: "keep", 4: "keep", 5: "keep", 6: "keep"}
    later = staging_actions(listing, assets, jobs, "k", "at", F.lit("2024-04-02").cast("timestamp"))
    assert {r["k"] for r in later.where("action = 'delete'").collect()} == {1, 5, 6}
