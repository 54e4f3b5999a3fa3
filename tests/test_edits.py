"""Folds of edit logs against a sequential replay, at several positions."""

import random

from tideline.operators import edits as ed


def replay(log):
    fields, into, last = {}, {}, {}
    for pos, i, kind, field, value, target in log:
        fields.setdefault(i, {})
        last.setdefault(i, None)
        if i in into:
            continue
        if kind == "set":
            fields[i][field] = value
            last[i] = pos
        elif kind == "delete":
            into[i], last[i] = None, pos
        elif target is not None and target != i and target not in into:
            into[i], last[i] = target, pos
    out = {}
    for i, own in fields.items():
        root = i
        while root in into and into[root] is not None:
            root = into[root]
        merged = None if i not in into or into[i] is None or root in into else root
        out[i] = ({f: v for f, v in own.items() if v is not None}, merged, i in into and into[i] is None, last[i])
    return out


def test_any_prefix_equals_a_replay(spark):
    rng = random.Random(12)
    log = []
    for pos in range(400):
        i, kind = rng.randrange(40), rng.choices(["set", "delete", "merge"], [8, 0.3, 1.2])[0]
        log.append((pos, i, kind, rng.choice(["title", "cover", "hidden"]) if kind == "set" else None, rng.choice(["a", "b", None]) if kind == "set" else None, rng.randrange(40) if kind == "merge" else None))
    edits = spark.createDataFrame(log, ed.SCHEMA).repartition(3)
    for upto in (60, None):
        got = {r["id"]: (r["fields"], r["merged_into"], r["deleted"], r["last"]) for r in ed.folded(edits, upto).collect()}
        assert got == replay(log[: 61 if upto else None])
    state = ed.folded(edits)
    now = replay(log)
    rows = spark.createDataFrame([(f, f % 45) for f in range(90)], "face long, person long")
    want = sorted((f, now[p][1] or p if p in now else p) for f, p in ((f, f % 45) for f in range(90)) if p not in now or not now[p][2])
    assert sorted((r["face"], r["person"]) for r in ed.redirected(rows, state, "person").collect()) == want
