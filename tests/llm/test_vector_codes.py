"""Product codes against k-means without any bounds."""

import hashlib
import math

import numpy as np
import pytest

from tideline.llm import vector_codes as vc
from tideline.llm.vector_codes import assigned, compress_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string, ids int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for again in range(rounds + 1):
        away = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        code = away.argmin(2)
        if again < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    error = away.min(2).sum(1)
    labels = {}
    for r, e in zip(kept, error.tolist(), strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{c:02x}" for c in k), e, labels[r[2]], digest) for r, k, e in zip(kept, code.tolist(), error.tolist(), strict=True)), key=str
    )


def found(spark, rows, columns=SCHEMA, **more):
    table = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], columns).repartition(3)
    return sorted((tuple(r) for r in compress_vectors(table, **more)[0].collect()), key=str)


@pytest.mark.parametrize("n", [5, 400])
def test_codes_equal_plain_k_means(spark, monkeypatch, n):
    monkeypatch.setattr(vc, "BLOCK", 1_000)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * rng.choice([0.0, 0.05, 0.6], (n, 1))).astype(np.float32)
    rows = [(int(i), x, int(rng.integers(0, 3)) if i % 5 else None) for i, x in zip(rng.permutation(n), v.tolist(), strict=True)]
    rows += [(n, None, 1), (-4, [math.nan] + [0.0] * 15, 1), (-3, [None] + [0.0] * 15, 1), (-2, [math.inf] + [0.0] * 15, 1)]
    rows += [(None, v[0].tolist(), 2), (None, v[1].tolist(), None)] + [rows[0]] * 2 + [(n + 9, v[2].tolist(), 1)] * 40
    assert found(spark, rows) == brute(rows)


def test_short_vectors_lack_components_and_zeros_fill_the_last_part(spark):
    rows = [(1, [0.5] * 9, 1), (2, [0.25] * 9, 1), (3, [0.5] * 8, 1), (4, [], 1)]
    padded = [(i, v + [0.0] * 7, label) for i, v, label in rows[:2]]
    assert found(spark, rows) == brute(padded)


def test_empty_table_and_large_components(spark):
    assert found(spark, []) == [] == found(spark, [(1, None, None)])
    with pytest.raises(Exception, match="don't fit"):
        found(spark, [(1, [2.0e5] * 8, 1)])


def test_bounds_never_change_an_assignment():
    """Entries that coincide, parts on the border and balls at rest, over many small rounds."""
    for seed in range(60):
        rng = np.random.default_rng(seed)
        x = rng.integers(-3, 4, (50, 2))
        old = x[rng.integers(0, 50, 6)]
        code, radius = assigned(x, old)
        for _ in range(5):
            new = old + rng.integers(-1, 2, old.shape) * (rng.random((6, 1)) < 0.4)
            code, radius = assigned(x, new, code, old, radius)
            away = ((x[:, None] - new[None]) ** 2).sum(-1)
            assert (code == away.argmin(1)).all()
            assert all(radius[e] >= away[code == e, e].max(initial=0) for e in range(6))
            old = new
