"""Suffix-array dedup against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from tideline.llm import suffix_dedup as sd
from tideline.llm.suffix_dedup import SuffixArray, suffix_dedup

SCHEMA = "doc_id long, text string, id string, row int, kept string"


def brute(texts):
    """(bytes, removed, spans, digest) per text; a window goes if it starts twice or more."""
    raw, seen = [(t or "").encode() for t in texts], {}
    for d, t in enumerate(raw):
        for i in range(len(t) - sd.WINDOW + 1):
            seen.setdefault(hash(t[i : i + sd.WINDOW]), []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        for d, i in places if len(places) > 1 else ():
            gone[d][i : i + sd.WINDOW] = True
    out = []
    for t, g in zip(raw, gone, strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        out.append((len(t), int(g.sum()), int((g & ~np.append(False, g[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh é", k=rng.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    shared = [prose(90), prose(400), prose(67), prose(150)]
    texts = [prose(rng.randint(0, 300)) for _ in range(60)]
    for _ in range(60):
        texts.append(prose(rng.randint(0, 60)) + rng.choice(shared) + prose(rng.randint(0, 80)))
    for k in (380, 399, 400, 401, 430, 700):  # just below and above the window
        texts += [prose(5) + shared[1][:k] + prose(5), prose(9) + shared[1][100 : 100 + k] + "!"]
    texts += [shared[1] + shared[1], "z" * 399, "q" * 401, "ab" * 700, "ab" * 300 + "c", "abc " * 250, None, "", "  ", "é" * 500]
    return texts + texts[:4] + [texts[2], None, ""]


@pytest.mark.parametrize(("block", "flush", "limit"), [(1_500_000, 1_000_000, None), (6_000, 7, None), (3_000, 50, 2)])
def test_removed_bytes_equal_a_table_of_windows(spark, monkeypatch, block, flush, limit):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "FLUSH", flush)
    if limit is not None:  # all keys that three passages share are dealt in finer classes
        pick = sd.shared_keys
        monkeypatch.setattr(sd, "shared_keys", lambda base, total: keys_above(base, limit) if total else pick(base, total))
    texts = corpus()
    docs = spark.createDataFrame([(i * 7, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs).collect()}
    assert got == {i * 7: w for i, w in enumerate(brute(texts))}


def keys_above(base, limit):
    hot = np.zeros(0, np.uint64)
    rows = [(r["row"], (r["text"] or "").encode()) for r in base.collect()]
    rows = [r for r in rows if len(r[1]) >= sd.WINDOW]
    for _ in range(2):
        p = sd.passages(np.array([r[0] for r in rows]), np.zeros(len(rows), np.int64), [r[1] for r in rows], hot)
        keys, n = np.unique(np.unique(np.column_stack([p.key, p.digest]), axis=0)[:, 0], return_counts=True)
        hot = np.union1d(hot, keys[n > limit])
    assert len(hot)
    return hot


def test_pieces_of_a_long_text(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(sd, "PIECE", 3_000)
    long = "".join(rng.choices("abcdef", k=40_000))
    texts = [long, long[5_000:9_500] + "x", "y" + long[2_700:3_400], "word " * 4_000]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_null_and_repeated_ids(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choices("abcdef", k=900)) for _ in range(2))
    rows = [(1, a), (1, b), (None, a), (None, "c" + b), (2, "short"), (None, None)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0), (0, 900, 900), (0, 901, 900), (1, 900, 900), (1, 900, 900), (2, 5, 0)]
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (5, 1, 300, 40)] + [b"ab" * 90, b"a" * 50]
    lengths = np.array([len(p) for p in parts])
    array = SuffixArray(np.frombuffer(b"".join(parts), np.uint8), lengths)
    begin = np.cumsum(lengths) - lengths
    suffixes = [(p[i:], int(s) + i) for p, s in zip(parts, begin, strict=True) for i in range(len(p))]
    assert array.order.tolist() == [place for _, place in sorted(suffixes)]
    assert (array.rank[array.order] == np.arange(len(array.order))).all()
