"""The resumable file source and boundary scoring in the stream, across stops and restarts."""

import os
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators.timeline import boundaries
from tideline.sources.enumeration import MediaFiles
from tideline.streaming.boundaries import streamed_boundaries

T0 = datetime(2026, 1, 1)


def _drain(writer, folder):
    query = writer.option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_enumeration_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(MediaFiles)
    root, now = tmp_path / "media", time.time() - 1_000

    def put(name, age):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
        os.utime(path, (now + age, now + age))

    def run():
        files = spark.readStream.format("media_files").option("path", str(root)).load()
        _drain(files.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
        return sorted(r["relative"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for name in ("b.jpg", "trip/a.JPG", "trip/deep/c.mp4", "note.txt", ".hidden/d.jpg"):
        put(name, 1)
    put("trip/same.png", 5)
    first = ["b.jpg", "trip/a.JPG", "trip/deep/c.mp4", "trip/same.png"]
    assert run() == first
    assert run() == first  # a restart without news repeats nothing
    put("trip/same2.png", 5)  # the very time of the mark, a later name
    put("other/z.jpg", 9)
    put("new.jpg", 5_000)  # not settled
    second = sorted([*first, "trip/same2.png", "other/z.jpg"])
    assert run() == second
    # A batch that was planned but not finished is listed again between the same marks.
    commits = tmp_path / "cp" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    assert run() == second
    row = spark.read.parquet(str(tmp_path / "out")).where("relative = 'trip/deep/c.mp4'").first()
    assert (row["album"], row["mime"], row["size"]) == ("trip", "video/mp4", 1)


def test_streamed_cuts_equal_batch_cuts(spark, tmp_path):
    """Rows out of order, within the lateness, over several batches and a restart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(9)
    rows, minute = [], {1: 0.0, 2: 0.0}
    for i in range(160):
        g = rng.choice([1, 1, 2])
        minute[g] += rng.choice([0, 1, 2, 5, 5, 30, 90, 300])
        rows.append((g, i, T0 + timedelta(minutes=minute[g]), rng.choice([7, 7, 8, None])))
    rows.sort(key=lambda r: r[2] + timedelta(minutes=rng.random() * 50))
    schema, source = "g long, id long, ts timestamp, who long", str(tmp_path / "in")
    end = [(9, 999, T0 + timedelta(days=400), 1)]
    try:
        for batch in (rows[:70], rows[70:120], rows[120:], end):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            out = streamed_boundaries(stream, "g", "ts", "id", "who")
            _drain(out.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
        got = {(r["g"], r["left_id"], r["right_id"]): (r["cut"], round(r["score"], 9), round(r["tau"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    items = spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("ts"))
    want = {}
    for g in (1, 2):
        of = boundaries(items.where(F.col("g") == g), "g", "us", "id", "who").orderBy("ix").collect()
        want |= {(g, r["left_id"], r["right_id"]): (r["cut"], round(r["score"], 9), round(r["tau"], 9)) for r in of[: len(of) - 7]}
    assert sorted(want.keys() - got.keys()) == [] and sorted(got.keys() - want.keys()) == []
    assert got == want and 0 < sum(c for c, _, _ in got.values()) < len(got)
