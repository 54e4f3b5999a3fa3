"""Scalar functions against plain Python."""

import math

from pyspark.sql import functions as F

from tideline.functions import columns as c
from tideline.functions.provenance import classify_origin


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_haversine_and_centroid(spark):
    got = one(spark, c.haversine_m(F.lit(59.9227), F.lit(10.7575), F.lit(61.1), F.lit(9.2)))
    la, lb, d = math.radians(59.9227), math.radians(61.1), math.radians(9.2 - 10.7575)
    a = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2
    assert abs(got - 2 * 6_371_000 * math.asin(math.sqrt(a))) < 1e-3
    lat, lon = c.centroid("lat", "lon")
    rows = spark.createDataFrame([(10.0, 179.0), (10.0, -179.0)], "lat double, lon double")
    assert abs(abs(rows.agg(lon.alias("x")).first()["x"]) - 180) < 1e-6 and abs(rows.agg(lat.alias("x")).first()["x"] - 10) < 0.01


def test_sets_and_trigrams(spark):
    empty = F.array().cast("array<int>")
    assert one(spark, c.jaccard(empty, empty)) == 1.0
    assert one(spark, c.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == 1 / 3
    assert abs(one(spark, c.trigram_similarity(F.lit("word"), F.lit("two words"))) - 0.363636) < 1e-6


def test_names_clamp_and_null(spark):
    names = F.array(*(F.lit(x) for x in ("A", "B", "C", "D")))
    assert one(spark, c.list_names(names)) == "A, B, C and 1 other"
    assert one(spark, c.list_names(F.slice(names, 1, 2))) == "A and B"
    assert one(spark, c.clamp(F.lit(None).cast("double"))) is None
    assert one(spark, c.round_half_up(F.lit(0.0625), 3)) == 0.063


def test_routine_and_interest(spark):
    assert one(spark, c.routine(F.lit(10), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0))) == 1.0
    assert one(spark, c.routine(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0))) == 0.0
    args = [F.lit(x) for x in (3, 2.0, 2, 1.0, 24, 4.0, True, 0.0, 0.0, 0)]
    assert one(spark, c.interest(*args, F.lit(None).cast("int"))) == 1.0
    assert one(spark, c.interest(*args, F.lit(-1))) == 0.1


def test_origin(spark):
    def origin(name, album=None, mime="image/jpeg", gps=False):
        null = F.lit(None)
        return one(spark, classify_origin(F.lit(name), F.array(F.lit(album)).cast("array<string>"), null.cast("string"), F.lit(mime), F.lit(gps), null.cast("boolean"), null.cast("boolean"), null.cast("string")))

    assert [origin("IMG_20240101_120000.jpg"), origin("IMG-20240101-WA0001.jpg"), origin("Screenshot_1.jpg"), origin("x.png", mime="image/png")] == ["camera", "received", "screenshot", "screenshot"]
    assert [origin("x.jpg", "Snapseed"), origin("x.jpg", "WhatsApp Images"), origin("x.jpg", gps=True), origin("x.jpg")] == ["edited", "received", "camera", "unknown"]
