"""Every policy of the catalogue against a reading of it in plain Python: viewer by table by operation."""

import itertools
import random

import pytest

from tideline.operators import visibility as vis
from tideline.operators.policies import CATALOGUE, Secured
from tideline.operators.visibility import Viewer

DDL = {
    "groups": "id long, created_by long", "group_members": "group_id long, user_id long, role string", "group_invites": "group_id long, created_by long",
    "devices": "id long, user_id long", "blobs": "id long, group_id long", "assets": "id long, group_id long, owner_user_id long, blob_id long",
    "derivatives": "id long, blob_id long", "persons": "id long, group_id long, user_id long", "faces": "id long, blob_id long", "face_labels": "face_id long, by_user_id long",
    "unknown_clusters": "id long, group_id long, face_ids array<long>", "places": "id long, group_id long",
    "events": "id long, group_id long, contributor_ids array<long>, person_ids array<long>, is_public_to_group boolean, deleted_at long",
    "event_assets": "event_id long, asset_id long", "event_person_tags": "event_id long, by_user_id long", "moments": "id long, event_id long",
    "event_constraints": "id long, group_id long, by_user_id long", "audit_log": "id long, group_id long",
}


def library(seed):
    rng = random.Random(seed)
    g, u, one = (lambda: rng.choice([1, 1, 2, None])), (lambda: rng.choice([10, 11, 12])), lambda n: rng.randrange(n)
    some = lambda of: rng.sample(of, rng.randint(0, 2))
    rows = {
        "groups": [(1, 10), (2, 11), (3, 12)], "group_members": [(1, 10, "owner"), (1, 11, "member"), (2, 12, "owner"), (2, 10, "member")],
        "group_invites": [(x, u()) for x in (1, 2, 1)], "devices": [(i, rng.choice([10, 11, 12, 13])) for i in range(6)], "blobs": [(i, g()) for i in range(12)],
        "assets": [(i, g(), u(), one(12)) for i in range(14)], "derivatives": [(i, one(14)) for i in range(10)], "persons": [(i, g(), rng.choice([10, 11, None])) for i in range(8)],
        "faces": [(i, one(12)) for i in range(10)], "face_labels": [(one(12), u()) for _ in range(10)], "unknown_clusters": [(i, g(), some(list(range(12)))) for i in range(8)],
        "places": [(i, g()) for i in range(5)],
        "events": [(i, g(), some([10, 11, 12]), some([5, 6]), rng.random() < 0.2, rng.choice([None, None, 7])) for i in range(14)],
        "event_assets": sorted({(one(15), one(14)) for _ in range(20)}), "event_person_tags": sorted({(one(15), u()) for _ in range(12)}), "moments": [(i, one(15)) for i in range(8)],
        "event_constraints": [(i, g(), u()) for i in range(6)], "audit_log": [(i, g()) for i in range(6)],
    }
    return {n: [dict(zip((c.split()[0] for c in DDL[n].split(", ")), r, strict=True)) for r in rs] for n, rs in rows.items()}


def readings(data, group, user, person):
    """(table, operation) -> a test of a row, for this viewer."""
    roles = {(r["group_id"], r["user_id"]): r["role"] for r in data["group_members"]}
    member, owner = (lambda x: (x, user) in roles), lambda x: roles.get((x, user)) == "owner"
    mates = {u for (x, u) in roles if x == group and member(x)}
    here = lambda r: r["group_id"] == group
    shown = lambda r: here(r) and (user in r["contributor_ids"] or (person is not None and person in r["person_ids"]) or r["is_public_to_group"])
    events = {r["id"] for r in data["events"] if r["deleted_at"] is None and shown(r)}
    ea = lambda r: r["event_id"] in events
    in_events = {r["asset_id"] for r in data["event_assets"] if ea(r)}
    asset = lambda r: here(r) and (r["owner_user_id"] == user or r["id"] in in_events)
    used = {r["blob_id"] for r in data["assets"] if asset(r)}
    blob = lambda r: here(r) and r["id"] in used
    blobs = {r["id"] for r in data["blobs"] if blob(r)}
    of_blob = lambda r: r["blob_id"] in blobs
    faces = {r["id"] for r in data["faces"] if of_blob(r)}
    of_face, by_me = (lambda r: r["face_id"] in faces), lambda r: r["by_user_id"] == user
    self_or_owner = lambda r: r["user_id"] == user or owner(r["group_id"])
    mine, my_asset = (lambda r: r["user_id"] == user), lambda r: here(r) and r["owner_user_id"] == user
    return {
        "groups": {"select": lambda r: member(r["id"]), "insert": lambda r: r["created_by"] == user, "update": lambda r: owner(r["id"]), "delete": lambda r: owner(r["id"])},
        "group_members": {"select": lambda r: member(r["group_id"]), "insert": self_or_owner, "update": self_or_owner, "delete": self_or_owner},
        "group_invites": {o: (lambda r: owner(r["group_id"])) for o in ("select", "update", "delete")} | {"insert": lambda r: owner(r["group_id"]) and r["created_by"] == user},
        "devices": {"select": lambda r: mine(r) or r["user_id"] in mates, "insert": mine, "update": mine, "delete": mine},
        "blobs": {"select": blob, "insert": here, "update": blob},
        "assets": {"select": asset, "insert": my_asset, "update": my_asset, "delete": my_asset},
        "derivatives": {"select": of_blob},
        "persons": {"select": here, "insert": here, "update": here, "delete": lambda r: here(r) and (r["user_id"] == user or owner(r["group_id"]))},
        "faces": {"select": of_blob, "update": of_blob},
        "face_labels": {"select": of_face, "insert": lambda r: by_me(r) and of_face(r), "update": of_face, "delete": of_face},
        "unknown_clusters": {"select": lambda r: here(r) and bool(faces & set(r["face_ids"])), "update": here},
        "places": {"select": here, "update": here},
        "events": {"select": lambda r: r["deleted_at"] is None and shown(r), "update": shown},
        "event_assets": {"select": ea, "insert": ea, "delete": ea},
        "event_person_tags": {"select": ea, "insert": lambda r: by_me(r) and ea(r), "delete": ea},
        "moments": {"select": ea},
        "event_constraints": {"select": here, "insert": lambda r: here(r) and by_me(r), "delete": lambda r: here(r) and by_me(r)},
        "audit_log": {"insert": lambda r: r["group_id"] is None or here(r), "select": lambda r: owner(r["group_id"])},
    }


@pytest.mark.parametrize("viewer", [(1, 10, 5), (2, 10, None)])
def test_matrix_of_tables_and_operations(spark, viewer):
    data = library(sum(v or 0 for v in viewer))
    tables = {n: spark.createDataFrame([tuple(r.values()) for r in rows], DDL[n]).coalesce(1) for n, rows in data.items()}
    secured, want = Secured(tables, Viewer(*viewer)), readings(data, *viewer)
    key = lambda r: str(list(r.values()))
    names, parts = [], []
    for table, operation in itertools.product(DDL, ("select", "insert", "update", "delete")):
        if operation not in want[table]:
            with pytest.raises(PermissionError):
                secured.rows(table, operation)
            continue
        rows = secured.permitted(table, tables[table]) if operation == "insert" else secured.rows(table, operation)
        assert rows.columns == tables[table].columns
        names.append((table, operation))
        parts.append(sorted(str(list(r)) for r in rows.collect()) if (table, operation) in COLLECTED else None)
    for (table, operation), got in zip(names, parts, strict=True):
        if got is not None:
            assert got == sorted(key(r) for r in data[table] if want[table][operation](r)), (table, operation)
    checked = secured.permitted("events", tables["events"], "update").collect()  # the new row need only stay in the group
    assert sorted(r["id"] for r in checked) == sorted(r["id"] for r in data["events"] if r["group_id"] == viewer[0])
    with pytest.raises(PermissionError):
        secured.rows("sessions")


#: Those whose rows are compared; the others repeat a rule of these. All are compiled and checked for their columns.
COLLECTED = {
    *((t, "select") for t in DDL), ("groups", "insert"), ("groups", "update"), ("group_members", "delete"), ("group_invites", "insert"), ("devices", "update"), ("blobs", "insert"), ("assets", "delete"),
    ("persons", "delete"), ("face_labels", "insert"), ("unknown_clusters", "update"), ("events", "update"), ("event_person_tags", "insert"), ("event_constraints", "insert"), ("audit_log", "insert"),
}


def test_visibility_reasons_in_blocks_of_members(spark, monkeypatch):
    """Members in several blocks, sent or not; null sets, nulls in sets and members of other groups; no row is shuffled."""
    monkeypatch.setattr(vis, "MEMBERS", 2)
    rows = [(1, 0, [1, 9], [1, 2], False), (2, 0, None, [3], True), (3, 1, [7], [7, None], None), (4, 1, [1], None, True), (5, None, [1], [1], True)]
    events = spark.createDataFrame(rows, "e long, g long, c array<long>, p array<long>, o boolean")
    asked = spark.createDataFrame([(0, m) for m in (1, 2, 3, 4, 5)] * 2 + [(1, 7), (1, 8), (None, 1)], "g long, m long")
    want = {(1, 1, "contributor,face"), (1, 2, "face"), (3, 7, "contributor,face"), (4, 7, "opened"), (4, 8, "opened")} | {(2, m, "face,opened" if m == 3 else "opened") for m in (1, 2, 3, 4, 5)}
    for sent in (1_000, 3):
        monkeypatch.setattr(vis, "SENT", sent)
        out = vis.visibility_reasons(events, "e", "g", {"face": "p", "contributor": "c"}, "o", asked, "m")
        got = [(r["e"], r["m"], ",".join(r["reasons"])) for r in out.collect()]
        assert set(got) == want and len(got) == len(want)
    text = vis.visibility_reasons(events, "e", "g", {"face": "p", "contributor": "c"}, "o", asked, "m", separator="+")
    assert {tuple(r) for r in text.collect()} == {(e, m, r.replace(",", "+")) for e, m, r in want}


def test_visibility_reasons_come_in_runs_that_take_little_space(spark, tmp_path):
    """Rows are events times members: as columns they take far less than a byte each, and no set travels with a member."""
    events = spark.range(400).selectExpr("id * 7919 AS e", "id % 2 AS g", "array(id % 400) AS c", "array((id + 1) % 400) AS p", "true AS o")
    asked = spark.range(8_000).selectExpr("id % 2 AS g", "id AS m")
    out = vis.visibility_reasons(events, "e", "g", {"face": "p", "contributor": "c"}, "o", asked, "m", separator=",")
    out.write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    n = got.count()
    assert n == got.select("e", "m").distinct().count() == 400 * 4_000
    assert {tuple(r) for r in got.groupBy("reasons").count().collect()} == {("contributor,opened", 400), ("opened", n - 400)}
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.4 * n, size / n
