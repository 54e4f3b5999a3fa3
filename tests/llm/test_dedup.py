"""Exact, near and substring dedup and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import near_dup as nd
from tideline.llm import substring_dedup as sd
from tideline.llm.common import connected_components, spark_hash
from tideline.llm.decontaminate import decontaminate
from tideline.llm.exact_dedup import CountingQuotientFilter, exact_dedup

SCHEMA = "doc_id long, text string, fp string, id string, keep_id int"


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(60)]
    base = rng.choices(vocabulary, k=150)
    for _ in range(25):  # near copies of each other, some linked only through others
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        base = words
        texts.append(" ".join(words))
    passage = " ".join(rng.choices(vocabulary, k=45))
    texts += [f"{t} {passage} {u}" for t, u in zip(texts[:12], texts[12:24], strict=True)]
    texts += [texts[5]] * 3 + ["", None, "  \n ", "a a " * 90, "Üben " * 40, texts[0].upper(), texts[3].replace(" ", "\t\n")]
    return [(i * 3 + 1, t, "x", "y", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_exact(docs):
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs).collect()} == want


def test_exact_hot_group_and_nulls(spark):
    rows = [(i, "same") for i in range(150)] + [(1000 + i, f"t{i}") for i in range(10)] + [(None, "n"), (None, "n"), (7, "n")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 1 + 10 + 1
    assert {r["keep_id"] for r in got if r["group_size"] == 150} == {149}


def test_filter_round_trip_and_merge():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 20, n).astype(np.uint64) << np.uint64(30) for n in (0, 1, 500, 3000)]
    filters = [CountingQuotientFilter(*np.unique(p, return_counts=True), 56) for p in parts]
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.decode(f.encode()) for f in filters])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.values == values).all() and (merged.counts == counts).all()


def near_wanted():
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    return {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near(docs, monkeypatch):
    want = near_wanted()
    found = lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dup(docs).collect()}
    assert found() == want
    monkeypatch.setattr(nd, "BLOCK_DOCS", 6)  # the group of near copies is cut into blocks
    monkeypatch.setattr(nd, "RUN", 4)
    assert found() == want


def test_near_null_and_repeated_ids(spark):
    words = [f"v{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(["other", *words[1:]]), " ".join(f"z{i}" for i in range(30))
    rows = [(5, a), (5, c), (3, c + " "), (8, b), (None, b), (None, "solo text"), (None, "solo text"), (None, None), (6, "A b C d e f"), (6, "a B c d e f")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(5, 56, 5, True), (5, 26, 3, False), (3, 26, 3, True), (8, 56, 5, False), (None, 56, 5, False), (None, 1, None, True), (None, 1, None, False), (None, 0, None, True), (6, 2, 6, True), (6, 2, 6, True)]
    assert got == sorted(want, key=str)


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    minhash = nd.CirculantMinHash()
    x, y = (minhash.signatures(np.unique(s), np.array([0]))[0] for s in (a, np.concatenate((a[:600], b))))
    assert abs((x == y).mean() - 600 / 1200) < 0.12


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {90: 80, 80: 80}


def substring_wanted(rows):
    """(id, n_words, n_removed, kept_sha256) per row; a document is an id and a text, those without an id come last."""
    digest = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
    key = lambda i, t: (i is None, i or 0, digest(t) if repeats else 0)
    ids = [r[0] for r in rows]
    repeats = len(set(ids)) < len(ids) or None in ids
    seen, out = {}, []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), []).append((*key(i, t), k))
    first = {w: min(places) for w, places in seen.items()}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {p for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (*key(i, t), k) for p in range(k, k + 20)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


def substring_found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.substring_dedup(df).collect()), key=str)


@pytest.mark.parametrize("spread", [False, True])
def test_substring(docs, monkeypatch, spread):
    if spread:  # every anchor counts as shared: windows travel alone
        monkeypatch.setattr(sd, "shared_anchors", lambda base, total: np.unique(np.concatenate([sd.window_hashes(sd.WordHashes().of((t or "").encode().split()))[0] for _, t, *_ in corpus()])))
    assert substring_found(docs) == substring_wanted(corpus())


@pytest.mark.parametrize("flush", [2_000_000, 40])
def test_substring_null_and_repeated_ids(spark, monkeypatch, flush):
    """Every row keeps the words that no window covers, whatever its id; ids repeat within and across partitions."""
    monkeypatch.setattr(sd, "FLUSH", flush)
    rows = [(None if k % 5 == 0 else i if k % 3 else i % 40, t) for k, (i, t, *_) in enumerate(corpus())]
    alpha = "alpha " * 30
    rows += [(0, alpha), (None, "x y z"), (None, " ".join(f"q{i}" for i in range(40))), (1, rows[4][1]), (2, rows[4][1]), (2, alpha + "end"), (None, alpha), (None, alpha)] + rows[30:40]
    rows += [(9000 + i, rows[40][1]) for i in range(30)] + [(None, None), (None, "")]
    assert substring_found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == substring_wanted(rows)


def test_substring_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = sd.substring_dedup(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 30)]


def test_index_decides_on_equal_passages(docs, monkeypatch):
    """Where backward search finds nothing, nothing goes: no removal bypasses the index."""
    monkeypatch.setattr(sd.FmIndex, "search", lambda self, words, lengths: (np.zeros(len(words), np.int64), np.full(len(words), -1)))
    assert {n for _, _, n, _ in substring_found(docs)} == {0}


def test_index_matches_a_list_of_windows():
    rng = np.random.default_rng(8)
    lengths = rng.integers(20, 36, 60)
    words = rng.integers(1, 3, int(lengths.sum()))
    begin = np.cumsum(lengths) - lengths
    for at in range(0, 50, 2):  # windows that recur
        words[begin[at + 1] : begin[at + 1] + 20] = words[begin[at % 6] : begin[at % 6] + 20]
    count, first = sd.FmIndex(words, lengths).search(words, lengths)
    places = {}
    for p, (b, n) in enumerate(zip(begin, lengths, strict=True)):
        for k in range(n - 19):
            places.setdefault(tuple(words[b + k : b + k + 20]), []).append((b + k, b + k + p))
    for w in places.values():
        assert [count[a] for a, _ in w] == [len(w)] * len(w) and [first[a] for a, _ in w] == [w[0][1] if len(w) > 1 else -1] * len(w)


def test_substring_long_text_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr("tideline.llm.common.SLICE_BYTES", 200)
    long = " ".join(f"u{i}" for i in range(60_000))
    rows = [(1, long, "a", 0, 0), (2, long[: len(long) // 2], "b", 1, 0), (3, "z " * 70_000, "c", 2, 0), (4, "", "d", 3, 0)]
    got = sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, id string, bucket int, twin int"))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]
    assert substring_found(spark.createDataFrame(rows, "doc_id long, text string, id string, bucket int, twin int")) == substring_wanted(rows)


def test_spark_hash(spark):
    x = np.array([0, 1, -5, 2**40], np.int64)
    rows = spark.createDataFrame([(int(v),) for v in x], "x long").selectExpr("xxhash64(x)", "xxhash64(x, x + 1)").collect()
    assert [r[0] for r in rows] == spark_hash(x).tolist() and [r[1] for r in rows] == spark_hash(x + 1, spark_hash(x)).tolist()


def test_decontaminate(spark, docs, monkeypatch):
    from tideline.llm import decontaminate as dc

    texts = [t for _, t, *_ in corpus() if t]
    items = [("b2", " ".join(texts[70].split()[20:50])), ("b10", texts[1]), ("a", "W5, w6!"), ("one", "w9"), ("none", " .. "), ("null", None), ("no", "x " * 20)]
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or c.isalnum() else " " for c in t or "").split(" ")
    windows = {}
    for name, t in items:
        w = [x for x in words(t) if x]
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[k : k + m]), set()).add(name)
    want = {}
    for i, t, *_ in corpus():
        w = [x for x in words(t) if x]
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                names = windows.get(tuple(w[k : k + m]))
                if names:
                    found |= names
                    hit |= set(range(k, k + m))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = lambda: {r[0]: tuple(r)[1:] for r in decontaminate(docs, bench).collect()}
    assert got() == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)  # several blocks of the benchmark, in one worker
    monkeypatch.setattr(dc, "HELD_BYTES", 3_000)
    assert got() == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 10)
    plan = decontaminate(docs, bench)._jdf.queryExecution().toString().partition("Physical Plan")[2]
    assert plan.count("MapInArrow") == 1
    odd = docs.withColumn("a`b.c", F.lit(1))
    assert decontaminate(odd, bench, carry=True).select("row.*").columns == odd.columns
    assert decontaminate(docs, bench, carry=True).select("row.*").columns == docs.columns


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup(none).count() == nd.near_dup(none).count() == sd.substring_dedup(none).count() == decontaminate(none, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate(docs, bench).collect()} == {0}
