import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tideline.operators import splits

DDL = "grp long, segment long, id long, us long, contrib long, lat double, lon double, people array<long>"


def _segment(rng, segment: int, n: int, spread: float, minutes: float, contributors: int, unplaced: float = 0.2):
    """Items around a few centres, some close to the reach of each other, many at one spot, some far out."""
    centres = rng.uniform(-spread, spread, (4, 2))
    at = centres[rng.integers(0, 4, n)] + rng.normal(0, 300.0, (n, 2)) * rng.choice([0.0, 0.3, 1.0], (n, 1))
    us = np.sort(rng.integers(0, int(minutes * 60e6), n)) // 30_000_000 * 30_000_000  # ties
    rows = []
    for i in range(n):
        guest = rng.random() < 0.1  # one of those who have no position anywhere
        placed = rng.random() > unplaced and not guest
        lat, lon = float(60.0 + at[i, 0] / 111_195), float(10.0 + at[i, 1] / (111_195 * 0.5))
        people = None if rng.random() < 0.3 else [int(p) for p in rng.integers(0, 12, rng.integers(0, 4))]
        rows.append((segment % 2, segment, segment * 10_000_000 + int(rng.permutation(n)[0]) * 1000 + i, int(us[i]), int(rng.integers(0, contributors)) + 100 * guest, lat if placed else None, lon if placed else None, people))
    return rows


def _plain(rows):
    names = [f.split()[0] for f in DDL.split(", ")]
    out = {}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.list_(pa.int64())]
        table = pa.table({n: pa.array([r[k] for r in own], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})
        out |= {r["id"]: (r["part"], r["contiguous"], r["untied"]) for r in splits.split_one(table).to_pylist()}
    return out


def _by_cells(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    mean = df.groupBy("grp", "segment").agg(F.avg(F.when(placed, F.radians("lat"))).alias("_lat"))
    got = splits.split_by_cells(df.join(mean, ["grp", "segment"]), "_lat").collect()
    assert len(got) == len(rows)
    return {r["id"]: (r["part"], r["contiguous"], r["untied"]) for r in got}


def test_split_by_cells_equals_a_split_in_one_task(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, (n, spread, minutes, contributors) in enumerate([(300, 1500, 300, 5), (200, 800, 200, 3), (120, 20_000, 400, 9), (40, 1000, 20, 4), (250, 1200, 900, 2)]):
        rows += _segment(rng, k, n, spread, minutes, contributors)
    rows += _segment(rng, 5, 20, 100, 60, 3, unplaced=1.0)  # no position at all
    want = _plain(rows)
    assert len({v[0] for v in want.values()}) > 2 and any(v[2] for v in want.values())  # the case is not a trivial one
    assert _by_cells(spark, rows) == want


def test_cells_that_nearly_meet_are_told_apart_exactly(spark):
    """Rows of points whose distance is a hair below and above the reach, so that coarse boxes leave it open."""
    eps = splits.SPLIT_EPS_M
    rows = []
    for k, gap in enumerate([eps - 1e-3, eps + 1e-3, eps - 5.0, eps + 5.0]):
        for side, x0 in enumerate((0.0, gap)):
            for i in range(40):
                x = x0 + (-1 if side == 0 else 1) * (i % 8) * 11.0
                rows.append((0, k, k * 1000 + side * 100 + i, i * 60_000_000, x, (i // 8) * 150.0))
    df = spark.createDataFrame(rows, "grp long, segment long, id long, us long, x double, y double")
    got = {r["id"]: (r["label"]["us"], r["label"]["id"], r["n"]) for r in splits.placed_clusters(df).collect()}
    for k in range(4):
        own = [r for r in rows if r[1] == k]
        label = splits.density_clusters(np.array([r[4:6] for r in sorted(own, key=lambda r: (r[3], r[2]))]), eps, splits.SPLIT_CORE)
        ids = [r[2] for r in sorted(own, key=lambda r: (r[3], r[2]))]
        assert set(label) == ({0} if k in (0, 2) else {0, 1})
        first = {c: (next(r for r in own if r[2] == ids[list(label).index(c)])[3], ids[list(label).index(c)], int((label == c).sum())) for c in set(label)}
        assert {i: got[i] for i in ids} == {i: first[c] for i, c in zip(ids, label, strict=True)}


def test_segments_come_out_alike_on_both_ways(spark, monkeypatch):
    from tideline.operators import segment as module

    rng = np.random.default_rng(8)
    rows = [r for k in range(2) for r in _segment(rng, k, 150, 2500, 200, 4)]
    df = spark.createDataFrame(rows, DDL).drop("segment")
    run = lambda: {r["id"]: (r["segment_id"], r["kind"], r["tier"], round(r["confidence"], 9)) for r in module.segment(df, "grp", "us", "id", "contrib", "people", "lat", "lon").collect()}
    want = run()
    monkeypatch.setattr(module, "SPLIT_ROWS", 10)
    assert run() == want and len({v[0] for v in want.values()}) > 2
