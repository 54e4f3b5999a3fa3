"""Timeline, join and visibility operators on small hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import graph, identity, joins, ordered, timeline
from tideline.operators import visibility as vis

MIN = 60_000_000


def test_row_index_and_running_sum_ignore_block_size(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), int(t), i, int(v)) for i, (g, t, v) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 10**11, 300), rng.integers(0, 5, 300), strict=True))]
    df = spark.createDataFrame(rows, "g long, us long, id long, v long")
    got = ordered.running_sum(ordered.with_row_index(df, "g", "us", "id", bucket_us=10**9), "g", "v", "s", size=7).collect()
    for g in (0, 1):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        want = {r[2]: (n, sum(x[3] for x in own[: n + 1])) for n, r in enumerate(own)}
        assert {r["id"]: (r["ix"], r["s"]) for r in got if r["g"] == g} == want


def test_segments_cut_on_strictly_longer_gaps(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 20 * MIN, 1), (1, 40 * MIN + 1, 2), (2, 5, 3)], "g long, us long, id long")
    got = {r["id"]: r["segment"] for r in timeline.with_segments(df, "g", "us", "id", 20 * MIN).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}
    assert timeline.with_segments(df.limit(0), "g", "us", "id", 20 * MIN).count() == 0


def test_boundary_terms_match_numpy(spark):
    rng = np.random.default_rng(7)
    n, t = 40, 0
    rows = []
    for i in range(n):
        t += int(rng.integers(1, 30)) * MIN
        e = rng.normal(size=4)
        rows.append((1, t, i, int(rng.integers(0, 3)), [int(x) for x in rng.integers(0, 4, 2)], float(59.9 + rng.normal() * 0.01), float(10.7 + rng.normal() * 0.01), (e / np.linalg.norm(e)).tolist()))
    df = spark.createDataFrame(rows, "g long, us long, id long, c long, p array<int>, lat double, lon double, e array<float>")
    got = {r["left_id"]: r for r in timeline.boundaries(df, "g", "us", "id", "c", "p", "lat", "lon", "e").collect()}
    assert len(got) == n - 1
    for i in range(n - 1):
        left, right = rows[max(0, i - 7) : i + 1], rows[i + 1 : i + 9]
        gaps = np.diff([r[1] for r in left + right]) / MIN
        tau = float(np.clip(4 * np.median(gaps[gaps > 0]), 20, 120))
        dt = (right[0][1] - left[-1][1]) / MIN
        a, b = (np.array([r[7] for r in s]) for s in (left, right))
        within = [((x @ x.T).sum() - np.trace(x @ x.T)) / (len(x) * (len(x) - 1)) for x in (a, b) if len(x) > 1]
        visual = float(np.clip(0.5 + 2 * (np.mean(within) - (a @ b.T).mean()), 0, 1)) if within else 0.5
        people = [set(x for r in s for x in r[4]) for s in (left, right)]
        assert abs(got[i]["tau"] - tau) < 1e-9 and abs(got[i]["gap"] - 1 / (1 + np.exp(-(dt - tau) / (tau / 2)))) < 1e-9
        assert abs(got[i]["visual"] - visual) < 1e-5
        assert abs(got[i]["people"] - (1 - len(people[0] & people[1]) / len(people[0] | people[1]))) < 1e-9
        if min(len(left), len(right)) < 2:
            assert got[i]["dist"] == 0.5


def test_membership_from_all_evidence(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        e = rng.normal(size=4) + 2
        gps = rng.random() < 0.8
        rows.append((i % 2 if i < 57 else 2, int(rng.integers(0, 300)) * MIN, i, int(rng.integers(0, 9)), [int(x) for x in rng.integers(0, 30, rng.integers(0, 3))] if i % 10 else None,
                     float(59.9 + rng.normal() * 0.01) if gps else None, float(10.7 + rng.normal() * 0.01) if gps else None, (e / np.linalg.norm(e)).tolist() if i % 7 else None, int(i % 5 > 0)))
    df = spark.createDataFrame(rows, "ev long, us long, id long, c long, p array<long>, lat double, lon double, e array<double>, f long")
    got = {r["id"]: r for r in timeline.membership(df, "ev", "us", "id", "c", "p", "lat", "lon", "e", "f").collect()}
    bare = {r["id"]: r for r in timeline.membership(df, "ev", "us", "id", "c").collect()}
    assert len(got) == len(bare) == 60
    for ev in (0, 1, 2):
        own = sorted((r for r in rows if r[0] == ev), key=lambda r: (r[1], r[2]))
        x = np.radians([[r[5], r[6]] for r in own if r[5] is not None])
        m = np.stack([np.cos(x[:, 0]) * np.cos(x[:, 1]), np.cos(x[:, 0]) * np.sin(x[:, 1]), np.sin(x[:, 0])]).mean(axis=1)
        centre = np.arctan2(m[2], np.hypot(m[0], m[1])), np.arctan2(m[1], m[0])
        mean = np.mean([r[7] for r in own if r[7]], axis=0)
        mean /= np.linalg.norm(mean)
        counts = {}
        for r in own:
            for k in set(r[4] or ()):
                counts[k] = counts.get(k, 0) + 1
        part = {k for k, n in counts.items() if n >= (1 if len(own) <= 3 else 2)}
        for at, r in enumerate(own):
            before, after = (sum(0 < s * (q[1] - r[1]) <= 30 * MIN for q in own) >= 3 for s in (-1, 1))
            interior = 0.0 if at in (0, len(own) - 1) else (before + after) / 2
            geo = 0.5
            if r[5] is not None:
                la, lo = np.radians(r[5]), np.radians(r[6])
                h = np.sin((la - centre[0]) / 2) ** 2 + np.cos(la) * np.cos(centre[0]) * np.sin((lo - centre[1]) / 2) ** 2
                d = 2 * 6_371_000.0 * np.arcsin(np.sqrt(h))
                geo = 1.0 if d <= 300 else 0.0 if d > 2000 else 1 - (d - 300) / 1700
            people = 1.0 if set(r[4] or ()) & part else 0.5 if not r[8] or not r[4] else 0.0
            visual = 0.5 if not r[7] else float(np.clip((np.dot(r[7], mean) - 0.5) / 0.4, 0, 1))
            n = sum(q[3] == r[3] for q in own)
            support = 1.0 if n >= 5 else 0.5 if n >= 2 else 0.0
            assert abs(got[r[2]]["confidence"] - (0.35 * interior + 0.25 * geo + 0.2 * people + 0.1 * visual + 0.1 * support)) < 1e-6
            assert abs(bare[r[2]]["confidence"] - (0.35 * interior + 0.275 + 0.1 * support)) < 1e-9


def test_membership_windows_are_bounded_by_time(spark):
    import re

    df = spark.createDataFrame([(1, 10 * MIN * (i // 2), i, None if i % 3 else 5) for i in range(40)], "ev long, us long, id long, c long")
    got = timeline.membership(df, "ev", "us", "id", "c")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert windows and all("_bucket" in w for w in windows)  # none over a whole event
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == 40 and [rows[i]["n_before"] for i in (0, 2, 39)] == [0, 2, 6] and [rows[i]["n_after"] for i in (0, 37, 39)] == [6, 2, 0]
    assert [rows[i]["interior"] for i in (0, 1, 20, 38, 39)] == [0.0, 0.5, 1.0, 0.5, 0.0] and {r["support"] for r in rows.values()} == {1.0}


def test_band_join_and_nearest(spark):
    a = spark.createDataFrame([(1, 10, 100), (1, 11, -5), (2, 12, 100)], "k long, a_id long, a long")
    b = spark.createDataFrame([(1, 20, 109), (1, 21, 111), (1, 22, 91), (1, 23, -14)], "k long, b_id long, b long")
    got = {(r["a_id"], r["b_id"]) for r in joins.band_join(a, b, ["k"], "a", "b", 10).collect()}
    assert got == {(10, 20), (10, 22), (11, 23)}
    near = {r["a_id"]: (r["gap"], r["b_id"]) for r in joins.nearest(a, b, ["k"], "a_id", "a", "b", "b_id", 10).collect()}
    assert near == {10: (9, 20), 11: (9, 23), 12: (None, None)}


def test_greedy_matching(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.1), (3, 3, 0.5)], "a long, b long, s double")
    assert {(r["a"], r["b"]) for r in joins.mutual_best(pairs, "a", "b", "s").collect()} == {(1, 1), (2, 2), (3, 3)}


def test_linked_groups(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["group_id"] for r in graph.linked_groups(edges, "a", "b").collect()}
    assert got == dict.fromkeys(range(31), 0) | {100: 100, 101: 100}
    assert graph.linked_groups(edges.limit(0), "a", "b").count() == 0


def test_match_tiers(spark):
    rng = np.random.default_rng(1)
    base = [x / np.linalg.norm(x) for x in rng.normal(size=(2, 64))]

    def near(v, cos):
        other = rng.normal(size=64)
        other -= other @ v * v
        return cos * v + np.sqrt(1 - cos**2) * other / np.linalg.norm(other)

    faces = spark.createDataFrame([(i, near(base[0], c).tolist()) for i, c in enumerate((0.70, 0.55, 0.45, 0.30))], "f long, e array<double>")
    protos = spark.createDataFrame([(7, base[0].tolist())], "p long, proto array<double>")
    got = [r["tier"] for r in identity.match_faces(faces, protos, "f", "e", "p").orderBy("f").collect()]
    assert got == ["high", "probable", "low", None]
    tiers = spark.createDataFrame([("high", ["profile"]), ("high", ["too_small"]), ("low", ["profile"]), (None, ["too_small"])], "t string, f array<string>")
    assert [r[0] for r in tiers.select(identity.cap_tier(F.col("t"), F.col("f"))).collect()] == ["probable", "low", "low", None]


def test_visibility_without_viewer_person_and_null_sets(spark):
    rows = [(1, 1, [5], [9], False, None), (2, 1, None, [9], None, None), (3, 1, [6], [None, 8], True, None), (4, 2, [5], [], True, None), (5, 1, [5], [], False, "x")]
    df = spark.createDataFrame(rows, "id long, g long, c array<long>, p array<long>, o boolean, d string")
    seen = lambda v: [r["id"] for r in df.where(vis.event_visible(v, "g", "c", "p", "o", "d")).orderBy("id").collect()]
    assert seen(vis.Viewer(1, 5)) == [1, 3] and seen(vis.Viewer(1, 4, 9)) == [1, 2, 3] and seen(vis.Viewer(9, 5, 9)) == []


def test_density_clusters_match_brute_force():
    from tideline.operators.splits import density_clusters

    rng = np.random.default_rng(3)
    for n, core in ((0, 3), (1, 1), (200, 3), (200, 5)):
        xy = rng.uniform(0, 6000, (n, 2)) if n < 200 else np.concatenate([rng.normal(c, 250, (n // 4, 2)) for c in (0, 1500, 4000, 4700)])
        got = density_clusters(xy, 300.0, core)
        near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= 300.0**2 if n else np.zeros((0, 0), bool)
        dense = near.sum(axis=1) >= core
        for i in range(n):
            assert (got[i] >= 0) == bool(dense[i] or (near[i] & dense).any())
            for j in np.flatnonzero(near[i] & dense):
                assert not dense[i] or got[i] == got[j]
        assert len(set(got[dense])) == _parts(near & dense[:, None] & dense[None], dense)


def _parts(links, nodes):
    left, n = set(np.flatnonzero(nodes)), 0
    while left:
        front = {left.pop()}
        n += 1
        while front:
            front = {int(j) for i in front for j in np.flatnonzero(links[i])} & left
            left -= front
    return n


def _party(spark):
    """21:30 to 03:12 with four contributors, then breakfast from 10:40 elsewhere."""
    rows, t = [], 21 * 60 + 30
    for i in range(60):
        rows.append((1, t * MIN, i, i % 4, 59.9227, 10.7575))
        t += 5
    rows += [(1, (24 * 60 + 640 + 3 * i) * MIN, 100 + i, i % 2, 59.93, 10.79) for i in range(6)]
    rows += [(2, 5 * 60 * i * MIN, 200 + i, 7, None, None) for i in range(3)]
    return spark.createDataFrame(rows, "g long, us long, id long, c long, lat double, lon double")


def test_segment_scenarios(spark):
    from tideline.operators.segment import segment

    got = segment(_party(spark), "g", "us", "id", "c", lat="lat", lon="lon").collect()
    of = {r["id"]: (r["segment_id"], r["kind"]) for r in got}
    assert len(got) == 69
    assert len({of[i] for i in range(60)}) == 1 and of[0][1] == "event"
    assert len({of[i] for i in range(100, 106)}) == 1 and of[100][0] != of[0][0]
    assert {of[i][1] for i in (200, 201, 202)} == {"loose"} and len({of[i][0] for i in (200, 201, 202)}) == 1
    again = {r["id"]: r["segment_id"] for r in segment(_party(spark).repartition(3), "g", "us", "id", "c", lat="lat", lon="lon").collect()}
    assert again == {k: v[0] for k, v in of.items()}


def test_segments_split_when_long_or_concurrent(spark):
    from tideline.operators.segment import segment

    long = [(1, 20 * i * MIN, i, 1, None, None) for i in range(90)]
    both = [(2, 15 * i * MIN, 1000 + i, i % 2, 59.9 if i % 2 else 61.1, 10.7 if i % 2 else 9.2) for i in range(28)]
    got = segment(spark.createDataFrame(long + both, "g long, us long, id long, c long, lat double, lon double"), "g", "us", "id", "c", lat="lat", lon="lon").collect()
    spans = {}
    for r in got:
        spans.setdefault((r["g"], r["segment_id"]), []).append(r["us"])
    assert all(max(v) - min(v) <= 18 * 60 * MIN for (g, _), v in spans.items() if g == 1) and sum(g == 1 for g, _ in spans) >= 2
    assert sorted(len(v) for (g, _), v in spans.items() if g == 2) == [14, 14] and len(got) == 118


def test_segment_constraints_trust_ids_and_leftovers(spark):
    from tideline.operators.segment import Constraints, segment

    rows = []

    def add(g, first, minutes, c=1, at=None, p=(), ok=True):
        rows.extend((g, t * MIN, first + i, c, at and at[0], at and at[1], list(p), ok) for i, t in enumerate(minutes))

    oslo, far = (59.9, 10.7), (61.0, 10.7)
    add(1, 100, range(8))
    add(2, 200, [0, 1, 2, 600, 601, 602])
    add(3, 300, range(8))
    add(4, 400, [600, 900], at=oslo)
    add(4, 402, [1200], at=far)
    add(4, 403, [1410], at=oslo)  # 00:30 of the next day in local time
    for k in range(3):  # 250 m between neighbours, 375 m from the middle of the first two to the third
        add(5, 500 + 10 * k, range(90 * k, 90 * k + 8), at=(59.9 + k * 250 / 111_195, 10.7), p=[1])
    add(6, 600, range(4), at=oslo)
    add(6, 610, [60], ok=False)  # the contributor's own
    add(6, 611, [60], c=2, ok=False)  # nothing ties it
    add(6, 612, [30], c=2, at=oslo, ok=False)  # near the centre
    add(6, 613, [200], ok=False)  # more than two hours away
    add(7, 700, range(4))
    add(7, 710, [2000], c=None)
    df = spark.createDataFrame(rows, "g long, us long, id long, c long, lat double, lon double, p array<long>, ok boolean")
    held = Constraints(
        pins=spark.createDataFrame([(1, 4 * MIN)], "g long, us long"),
        together=spark.createDataFrame([(2, 1, 200), (2, 1, 205)], "g long, set_id long, id long"),
        frozen=spark.createDataFrame([(3, 3 * MIN, 5 * MIN)], "g long, start_us long, end_us long"),
        include=spark.createDataFrame([("old", 710)], "event_id string, id long"),
        exclude=spark.createDataFrame([("old", 703)], "event_id string, id long"),
    )
    old = spark.createDataFrame([(7, "old", 700), (7, "old", 701), (7, "old", 702), (6, "other", 600), (6, "other", 1)], "g long, event_id string, id long")
    got = {r["id"]: r for r in segment(df, "g", "us", "id", "c", "p", "lat", "lon", trusted="ok", constraints=held, existing=old).collect()}
    assert set(got) == {r[2] for r in rows} - {703}
    parts = {}
    for k, r in got.items():
        parts.setdefault(r["segment_id"], set()).add(k)
    found = sorted(sorted(v) for v in parts.values())
    want = [
        [100, 101, 102, 103], [104, 105, 106, 107], list(range(200, 206)), [300, 301, 302], [303, 304, 305], [306, 307], [400, 401], [402], [403],
        [*range(500, 508), *range(510, 518)], list(range(520, 528)), [600, 601, 602, 603, 610, 612], [611], [613], [700, 701, 702, 710],
    ]
    assert found == want
    assert got[306]["kind"] == got[611]["kind"] == got[400]["kind"] == "loose" and got[600]["kind"] == got[610]["kind"] == "event"
    assert got[700]["segment_id"] == "old" and (got[710]["tier"], got[710]["source"], got[710]["kind"]) == ("confirmed", "manual", "event")
    assert got[600]["confidence"] >= 0.6 and got[610]["confidence"] <= 0.59 and got[612]["confidence"] <= 0.59 and got[402]["confidence"] == 0.5


def test_moments(spark):
    from tideline.operators.segment import moments

    dog, cat = ("a photo of a dog", 0.7), ("a cat", 0.9)
    rows = [(1, t * MIN, t, 1, [dog] if t in (1, 2) else [cat] if t == 61 else []) for t in (0, 1, 2, 3, 60, 61, 62, 63)]
    df = spark.createDataFrame(rows, "e long, us long, id long, c long, tags array<struct<tag:string,score:double>>")
    found, labels = moments(df, "e", "us", "id", "c", tags="tags")
    assert {r["id"]: r["moment"] for r in found.collect()} == {t: int(t >= 60) for t in (0, 1, 2, 3, 60, 61, 62, 63)}
    assert [(r["e"], r["moment"], r["label"]) for r in labels.collect()] == [(1, 0, "Dog")]


def test_mutations(spark):
    from tideline.operators import state

    old = spark.createDataFrame([(1, "new", "a"), (2, "done", "b")], "id long, state string, exif string")
    new = spark.createDataFrame([(1, "seen", None), (2, "seen", "c"), (3, "seen", "d")], "id long, state string, exif string")
    got = {tuple(r) for r in state.upsert(old, new, ["id"], {"state": ~F.col("old_state").isin("new", "excluded"), "exif": F.col("exif").isNull()}).collect()}
    assert got == {(1, "seen", "a"), (2, "done", "c"), (3, "seen", "d")}
    blobs = spark.createDataFrame([(1, "x", 5), (2, "x", 4), (3, "y", 1)], "blob long, sha string, at long")
    assets = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "asset long, blob long")
    kept, pointed = state.merge_exact_copies(blobs, assets, "blob", ["sha"], "at")
    assert {r["blob"] for r in kept.collect()} == {2, 3} and {tuple(r) for r in pointed.collect()} == {(10, 2), (11, 2), (12, 3)}
    faces = spark.createDataFrame([(1, 5, "high"), (2, 5, "high"), (3, None, None)], "face long, person long, tier string")
    labels = spark.createDataFrame([(1, 5, "reject"), (2, 6, "reject"), (3, 9, "confirm"), (3, 8, "confirm")], "face long, person long, verdict string")
    assert {tuple(r) for r in state.labelled_faces(faces, labels, "face", "person").collect()} == {(1, None, None), (2, 5, "high"), (3, 8, "confirmed")}


def test_overlong_cuts_against_the_best_boundary_again_and_again(spark):
    """Slabs against the rule as stated: cut a longer segment at its best inner boundary until none is longer."""
    import random

    from tideline.operators import segment as sg

    rng = random.Random(5)
    rows, want = [], set()
    for grp in range(6):
        us = [0]
        for _ in range(400 if grp else 1500):
            us.append(us[-1] + int(rng.choice((1, 30, 200, 400 if grp % 2 else 5)) * 60e6))
        b = [(grp, i, us[i], us[i + 1], 0.3 if grp == 0 else round(rng.random() / 2, 1), rng.random() < 0.02, "kept_together" if rng.random() < 0.3 and grp % 2 else "score") for i in range(len(us) - 1)]
        b = [(*x[:5], x[5] and x[6] == "score", x[6]) for x in b]
        rows += b
        cuts = [x[1] for x in b if x[5]]
        pieces = [(s, e) for s, e in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(us)], strict=True)]
        want |= {(grp, c) for c in cuts}
        while pieces:
            s, e = pieces.pop()
            inner = [x for x in b[s : e - 1] if x[6] != "kept_together"]
            if us[e - 1] - us[s] > sg.MAX_HOURS * 3600e6 and inner:
                at = max(inner, key=lambda x: (x[4], -x[1]))[1]
                want.add((grp, at))
                pieces += [(s, at + 1), (at + 1, e)]
    bounds = spark.createDataFrame(rows, "grp long, ix long, left_us long, right_us long, score double, cut boolean, reason string").repartition(5)
    got = sg.without_overlong(bounds, "grp").collect()
    assert len(got) == len(rows) and {(r["grp"], r["ix"]) for r in got if r["cut"]} == want
    assert {(r["grp"], r["ix"]) for r in got if r["reason"] == "overlong"} == want - {(x[0], x[1]) for x in rows if x[5]}


def test_linked_groups_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(graph, "SENT", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(5, 9), (9, 7), (50, 50)], "a long, b long")
    got = {r["node"]: r["group_id"] for r in graph.linked_groups(edges, "a", "b").collect()}
    assert got == {i: 20 for i in range(20, 41)} | {5: 5, 9: 5, 7: 5, 50: 50}


def test_boundary_windows_are_read_in_one_pass_over_batches(spark):
    """Sets, gaps and positions of both windows against plain Python, with blocks that batches cut; no window per term."""
    import random

    rnd, rows, us = random.Random(5), [], 0
    for i in range(4500):
        us += rnd.choice([0, 0, 60, 600, 4000]) * 1_000_000
        people = None if rnd.random() < 0.1 else [rnd.choice([1, 2, 3, None]) for _ in range(rnd.randrange(3))]
        rows.append(("a" if i < 4400 else "b", i, us, None if rnd.random() < 0.1 else rnd.randrange(12), people, None if rnd.random() < 0.3 else 60 + rnd.random() / 50, 10.0))
    df = spark.createDataFrame(rows, "g string, id long, us long, c long, p array<long>, lat double, lon double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        bounds = timeline.boundaries(df, "g", "us", "id", "c", "p", "lat", "lon")
        got = {r["left_id"]: r for r in bounds.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "collect_set" not in bounds._jdf.queryExecution().toString()
    assert len(got) == 4498
    ends = {"a": (0, 4400), "b": (4400, 4500)}
    for i, (g, _, at, *_rest) in enumerate(rows):
        low, high = ends[g]
        if i + 1 == high:
            assert i not in got
            continue
        left, right = rows[max(low, i - 7) : i + 1], rows[i + 1 : min(high, i + 9)]
        cl, cr = ({r[3] for r in w if r[3] is not None} for w in (left, right))
        pl, pr = ({x for r in w for x in r[4] or ()} for w in (left, right))
        around = rows[max(low, i - 7) : min(high, i + 9)]
        gaps = sorted(b[2] - a[2] for a, b in zip(around, around[1:], strict=False) if b[2] > a[2])
        median = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2 / 60e6 if gaps else 20.0
        r = got[i]
        assert (r["right_id"], r["right_us"]) == (rows[i + 1][1], rows[i + 1][2])
        assert r["contrib"] == pytest.approx(1 - len(cl & cr) / len(cl | cr) if cl | cr else 0.0)
        assert r["people"] == pytest.approx(1 - len(pl & pr) / len(pl | pr) if pl and pr else 0.5)
        assert r["tau"] == pytest.approx(max(20.0, min(120.0, 4 * median)))
        (n, a), (m, b) = ((len(x), sum(x) / max(1, len(x))) for x in ([q[5] for q in w if q[5] is not None] for w in (left, right)))
        if n < 2 or m < 2:
            assert r["dist"] == 0.5
        else:
            d, minutes = math.radians(abs(a - b)) * 6_371_000, r["minutes"]
            want = 1 - math.exp(-d / 800)
            slow = 0 < minutes < 30 and d / 1000 / (minutes / 60) < 90
            assert r["dist"] == pytest.approx(want / 2 if slow else want, abs=1e-4)


def test_membership_of_many_participants_equals_that_of_few(spark, monkeypatch):
    rows = [(f"e{i % 5}", i, i * 60_000_000, i % 3, [i % 4, None] if i % 7 else None, 60.0, 10.0 + i * 1e-5) for i in range(60)]
    df = spark.createDataFrame(rows, "ev string, id long, us long, c long, p array<long>, lat double, lon double").withColumn("v", F.col("id") % 2 == 0)
    few = timeline.membership(df, "ev", "us", "id", "c", "p", "lat", "lon", voter="v")
    monkeypatch.setattr(timeline, "FEW", 0)
    many = timeline.membership(df, "ev", "us", "id", "c", "p", "lat", "lon", voter="v")
    of = lambda d: {r["id"]: (r["people_term"], r["n_voters"], round(r["confidence"], 9)) for r in d.collect()}
    assert of(few) == of(many) and len(of(few)) == 60
    assert of(few)[0][1] == sum(r[0] == "e0" and r[3] == 0 and r[1] % 2 == 0 for r in rows)


def test_close_pairs_come_once_and_only_within_reach(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), int(t)) for i, (g, t) in enumerate(zip(rng.integers(0, 2, 400), rng.integers(0, 5000, 400) // 7 * 7, strict=True))]
    got = joins.close_pairs(spark.createDataFrame(rows, "g long, id long, t long"), ["g"], "t", "id", 350).collect()
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and b[2] - a[2] <= 350}
    assert len(got) == len(want) and {(r["id"], r["other_id"]) for r in got} == want
    assert all(r["t"] <= r["other_t"] for r in got)
