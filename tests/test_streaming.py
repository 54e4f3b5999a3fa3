"""Structured Streaming forms and file sources, run to completion on small inputs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.sources import files
from tideline.streaming import incremental as inc

T0 = datetime(2026, 1, 1)
SCHEMA = "user_id long, id long, ts timestamp"


def _stream(spark, tmp_path, batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _run(writer, tmp_path):
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_sessions_and_arrivals(spark, tmp_path):
    rows = [(1, i, T0 + timedelta(minutes=m)) for i, m in enumerate((0, 5, 25, 60, 60, 600))]
    source = _stream(spark, tmp_path, [rows[:3], rows[3:], [(9, 99, T0 + timedelta(days=2))]])
    _run(inc.sessions(source, "ts", ["user_id"]).writeStream.format("memory").queryName("sessions"), tmp_path)
    got = sorted((r["user_id"], r["n_items"]) for r in spark.table("sessions").collect())
    assert got == [(1, 1), (1, 2), (1, 3)]
    _run(inc.arrivals_once(source.select("user_id", "ts"), "ts", ["user_id"]).writeStream.format("memory").queryName("once"), tmp_path / "b")
    assert spark.table("once").groupBy("user_id").count().where("user_id = 9 AND count = 1").count() == 1


def test_resegmentation_touches_what_is_near(spark, tmp_path):
    base = [(1, i, T0 + timedelta(hours=h)) for i, h in enumerate((0, 1, 40))]
    history = spark.createDataFrame(base, SCHEMA).withColumn("us", F.unix_micros("ts"))
    source = _stream(spark, tmp_path, [[(1, 7, T0 + timedelta(hours=3))]]).withColumn("us", F.unix_micros("ts"))
    seen = []
    writer = inc.resegment_on_arrival(source, lambda: history, lambda df: df, lambda df, n: seen.extend(r["id"] for r in df.collect()), "user_id", "us")
    _run(writer, tmp_path)
    assert sorted(seen) == [0, 1, 7]


def test_late_data_widens_to_whole_events(spark, tmp_path):
    """What arrives late regroups events as a full recomputation does: the same members, under the same ids."""
    from tideline.operators.timeline import with_segments

    gap = 20 * 60_000_000
    minutes = [*range(0, 1_200, 15), *range(1_900, 2_000, 15), *range(4_000, 4_100, 15)]  # the first event lasts 20 hours
    base = [(1, i, T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)] + [(2, 500, T0)]
    late = [(1, 900, T0 + timedelta(minutes=1_195)), (1, 901, T0 + timedelta(minutes=1_210)), (2, 902, T0 + timedelta(minutes=5))]

    def segmented(df):
        rows = with_segments(df, "user_id", "us", "id", gap)
        first = rows.groupBy("user_id", "segment").agg(F.min_by("id", F.struct("us", "id")).alias("event"))
        return rows.join(first, ["user_id", "segment"]).select("user_id", "id", "us", "event")

    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).select("user_id", "id", F.unix_micros("ts").alias("us"))
    state = {(r["user_id"], r["id"]): (r["us"], r["event"]) for r in segmented(frame(base)).collect()}
    touched = []

    def events():
        spans = {}
        for (user, _), (us, event) in state.items():
            low, high = spans.get((user, event), (us, us))
            spans[user, event] = min(low, us), max(high, us)
        return spark.createDataFrame([(u, a, b) for (u, _), (a, b) in spans.items()], "user_id long, start_us long, end_us long")

    def write(df, number):
        for r in df.collect():
            touched.append(r["id"])
            state[r["user_id"], r["id"]] = r["us"], r["event"]

    history = lambda: spark.createDataFrame([(u, i, us) for (u, i), (us, _) in state.items()], "user_id long, id long, us long")
    source = _stream(spark, tmp_path, [late]).select("user_id", "id", F.unix_micros("ts").alias("us"))
    _run(inc.resegment_on_arrival(source, history, segmented, write, "user_id", "us", events), tmp_path)
    want = {(r["user_id"], r["id"]): (r["us"], r["event"]) for r in segmented(frame(base + late)).collect()}
    assert state == want
    assert 0 in touched and max(i for i in touched if i < 500) < minutes.index(4_000)  # the whole event, but not all of history


def test_history_is_filtered_before_any_shuffle(spark, tmp_path):
    """Where history lies in files, a batch reads on what its spans touch, without an exchange; a batch may come twice."""
    base = [(1, i, T0 + timedelta(minutes=5 * i)) for i in range(2_000)]
    spark.createDataFrame(base, SCHEMA).select("user_id", "id", F.unix_micros("ts").alias("us")).write.parquet(str(tmp_path / "history"))
    history = spark.read.parquet(str(tmp_path / "history"))
    late = spark.createDataFrame([(1, 5_000, T0 + timedelta(hours=30))], SCHEMA).select("user_id", "id", F.unix_micros("ts").alias("us"))
    near = inc.affected_items(history, late, "user_id", "us")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    assert near.count() == 145  # six hours each way
    seen = []
    stream = _stream(spark, tmp_path, [[(1, 5_000, T0 + timedelta(hours=30))], [(1, 5_000, T0 + timedelta(hours=30)), (1, 360, T0 + timedelta(minutes=1_800))]])
    stream = stream.select("user_id", "id", F.unix_micros("ts").alias("us"))
    _run(inc.resegment_on_arrival(stream, lambda: history, lambda df: df, lambda df, n: seen.append(sorted(r["id"] for r in df.collect())), "user_id", "us"), tmp_path)
    assert [len(s) for s in seen] == [146, 146] and all(len(set(s)) == len(s) for s in seen)


def test_refreshed_views_and_marks(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k long, v long")
    got = inc.refreshed_views(spark.createDataFrame([(1,), (1,)], "k long"), rows, "k", lambda df: df.groupBy("k").agg(F.sum("v").alias("s")))
    assert [tuple(r) for r in got.collect()] == [(1, 11)]
    assert files.since(rows, "v", 6).count() == 1 and files.since(rows, "v", None).count() == 3
    assert spark.range(1).select(files.vector_of(F.lit("[0.5, -1]")).alias("x")).first()["x"] == [0.5, -1.0]


def test_folder_scan(spark, tmp_path):
    for name in ("trip/a.JPG", "b.mp4", "note.txt", ".hidden/c.jpg", "trip/deep/d.png"):
        path = tmp_path / "media" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    got = {r["relative"]: (r["album"], r["mime"], r["size"]) for r in files.scan_folder(spark, str(tmp_path / "media"), hashes=True).collect()}
    assert got == {"trip/a.JPG": ("trip", "image/jpeg", 10), "b.mp4": (None, "video/mp4", 5), "trip/deep/d.png": ("trip", "image/png", 15)}
    lat, lon = files.gps_of_iso6709(F.col("x"))
    rows = spark.createDataFrame([("+59.92+010.75/",), ("+00.0+000.0/",), ("bad",), (None,)], "x string").select(lat.alias("a"), lon.alias("b")).collect()
    assert [tuple(r) for r in rows] == [(59.92, 10.75), (None, None), (None, None), (None, None)]
    assert spark.range(1).select(files.frame_times(F.lit(2.5)).alias("x")).first()["x"] == [0.625, 1.875]


def test_spans_of_many_arrivals_are_widened_in_one_pass(spark, monkeypatch):
    """The pass gives what the rounds give: chains of events, touching ends, nulls and events that end before they start."""
    import random

    rng, hour = random.Random(4), 3_600_000_000
    arrived = spark.createDataFrame([(rng.randrange(4), rng.randrange(3_000) * hour) for _ in range(40)] + [(None, hour), (1, None)], "g long, us long")
    starts = [(rng.randrange(5), rng.randrange(3_000) * hour) for _ in range(400)]
    events = [(g, s, s + rng.randrange(1, 40) * hour) for g, s in starts] + [(None, 0, 9 * hour), (1, None, hour), (1, hour, None), (2, 2_000 * hour, 1_000 * hour)]
    events = spark.createDataFrame(events, "g long, start_us long, end_us long")
    want = inc.widened_spans(arrived, events, "g", "us").collect()
    monkeypatch.setattr(inc, "SPANS", 10)
    once = inc.widened_spans(arrived, events, "g", "us")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in want} and once.count() == len(want)
    assert "explode" not in once._jdf.queryExecution().optimizedPlan().toString() and "sequence" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in once._jdf.queryExecution().optimizedPlan().toString()  # not the result of rounds
