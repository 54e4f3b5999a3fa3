"""Committed batches and views by signed changes, against plain Python state."""

import random

import pytest

from tideline.operators import views
from tideline.sources.committed import CommittedTable


def test_repeated_and_killed_batches_leave_one_result(spark, tmp_path, monkeypatch):
    table = CommittedTable(spark, str(tmp_path / "t"), "k long, g string, v long", ["k"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, g string, v long")
    state = lambda: {r["k"]: (r["g"], r["v"]) for r in table.read().collect()}
    assert state() == {}
    assert table.upsert(frame([(k, "a", k) for k in range(20)]), 0)
    assert table.upsert(frame([(3, "b", 33), (50, "b", 50)]), 1, deleted=frame([(7, None, None)]))
    want = {k: ("a", k) for k in range(20) if k != 7} | {3: ("b", 33), 50: ("b", 50)}
    assert state() == want and not table.upsert(frame([(3, "x", 0)]), 1) and state() == want

    def killed(*_):
        raise RuntimeError("killed between staging and commit")

    with monkeypatch.context() as m:
        m.setattr(CommittedTable, "_commit", killed)
        with pytest.raises(RuntimeError):
            table.upsert(frame([(3, "c", 1), (99, "c", 2)]), 2)
    again = CommittedTable(spark, str(tmp_path / "t"), "k long, g string, v long", ["k"], buckets=4)  # after a restart
    assert {r["k"]: (r["g"], r["v"]) for r in again.read().collect()} == want
    assert again.upsert(frame([(3, "c", 1), (99, "c", 2)]), 2) and again.commits() == [0, 1, 2]
    want |= {3: ("c", 1), 99: ("c", 2)}
    assert state() == want and table.vacuum() > 0 and state() == want


def test_appends_and_compaction(spark, tmp_path):
    log = CommittedTable(spark, str(tmp_path / "log"), "at long, what string", ["at"], buckets=2)
    for batch in range(3):
        assert log.append(spark.createDataFrame([(batch, "open"), (batch, "open")], "at long, what string"), batch)
        assert not log.append(spark.createDataFrame([(batch, "twice")], "at long, what string"), batch)
    log.compact()
    log.vacuum()
    assert sorted(r["at"] for r in log.read().collect()) == [0, 0, 1, 1, 2, 2] and log.is_committed(2)


def test_views_by_changes_equal_recomputation(spark, tmp_path):
    """Persons per event from members joined with faces, and contributors by levels, under random edits."""
    rng = random.Random(4)
    store = CommittedTable(spark, str(tmp_path / "v"), "event long, person long, n long", ["event", "person"], buckets=3)
    view = views.CountedView(store, ["event"], "person")
    members, faces = set(), set()
    m_frame = lambda rows: spark.createDataFrame(sorted(rows), "event long, asset long")
    f_frame = lambda rows: spark.createDataFrame(sorted(rows), "asset long, person long")
    for batch in range(5):
        new_members, new_faces = set(members), set(faces)
        for _ in range(25):
            (new_members.add if rng.random() < 0.7 else new_members.discard)((rng.randrange(6), rng.randrange(12)))
            (new_faces.add if rng.random() < 0.7 else new_faces.discard)((rng.randrange(12), rng.randrange(5)))
        dm, df = views.changes(m_frame(members), m_frame(new_members)), views.changes(f_frame(faces), f_frame(new_faces))
        signed = views.joined_changes(m_frame(new_members), dm, f_frame(faces), df, ["asset"])
        assert view.add(signed, batch) and not view.add(signed, batch)
        members, faces = new_members, new_faces
        want = {}
        for event, asset in members:
            for a, person in faces:
                if a == asset:
                    want.setdefault(event, set()).add(person)
        assert {r["event"]: r["persons"] for r in view.arrays("persons").collect()} == {e: sorted(p) for e, p in want.items()}
    with pytest.raises(ValueError, match="below zero"):
        view.add(spark.createDataFrame([(1, 77, -1)], "event long, person long, sign int"), 99)
    counts = spark.createDataFrame([(1, 5, "anyone", 2), (1, 6, "trusted", 1), (1, 7, "strong", 0), (2, 8, "strong", 1)], "event long, user long, level string, n long")
    got = views.with_fallback(counts, ["event"], "user", ["strong", "trusted", "anyone"], "users").collect()
    assert sorted((r["event"], r["users"], r["level"]) for r in got) == [(1, [6], "trusted"), (2, [8], "strong")]
    assert views.changes(counts, counts).count() == 0


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    from tideline.sources.committed import CommittedTable

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16KB")
    try:
        store = CommittedTable(spark, str(tmp_path / "t"), "id long, x long", ["id"], buckets=1)
        store.upsert(spark.range(0, 60_000, 1, 8).selectExpr("id", "xxhash64(id) AS x"), 0)
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "t" / "data").rglob("*.parquet"))) > 1
    assert store.read().distinct().count() == 60_000
