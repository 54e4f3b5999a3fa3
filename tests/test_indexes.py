"""Indexes against scans: recall and rows read of the vector index, equality of the title index."""

import random

import numpy as np
from pyspark.sql import functions as F

from tideline.functions.columns import trigram_similarity
from tideline.operators import title_index as ti
from tideline.operators import vector_index as vi


def exact(x, asked, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -np.inf
    return {q: set(np.argsort(-s)[:k].tolist()) for q, s in zip(asked, score, strict=True)}


def test_vector_index_recall_and_reach(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "SAMPLE", 1_500)  # of 4,000 rows
    monkeypatch.setattr(vi, "CHUNK", 1_000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 24))[rng.integers(0, 80, 4_000)] + rng.normal(size=(4_000, 24)) * 0.5
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(9_999, None)], "k long, v array<double>").repartition(3)
    path = str(tmp_path / "index")
    about = vi.build_index(rows, "k", "v", path)
    assert about["rows"] == 4_000 and about["probes"] < about["lists"] / 3
    queries = rows.where("k % 50 = 0")
    want = exact(x, list(range(0, 4_000, 50)), 12)
    got = {}
    for r in vi.search_index(spark, path, queries, "k", "v").collect():
        got.setdefault(r["query"], set()).add(r["row"])
    assert sum(len(got[q] & w) for q, w in want.items()) / (12 * len(want)) >= 0.9
    one = vi.search_index(spark, path, queries.where("k = 50"), "k", "v")
    assert 12 * one.count() == 144 and len(got[50] & want[50]) >= 9
    read = spark.read.parquet(f"{path}/rows").groupBy("list").count().orderBy(F.desc("count")).limit(about["probes"]).agg(F.sum("count")).first()[0]
    assert read < 4_000 / 2  # what the widest lists of one query hold
    whole = {}
    for r in vi.search_index(spark, path, queries, "k", "v", probes=about["lists"]).collect():
        whole.setdefault(r["query"], set()).add(r["row"])
    assert whole == want
    vi.build_index(rows.limit(0), "k", "v", str(tmp_path / "none"))


def test_title_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(500)] + ["", None, "!!", "Summer Trip", "summer  trip 2"]
    titles = spark.createDataFrame(list(enumerate(names)), "id long, title string").repartition(3)
    queries = titles.where("id % 10 = 0 OR id > 495").select(F.col("id").alias("q"), F.col("title").alias("text"))
    ti.build_title_index(titles, "id", "title", str(tmp_path / "t"), buckets=5)
    got = {(r["query"], r["key"]): round(r["similarity"], 9) for r in ti.search_titles(spark, str(tmp_path / "t"), queries, "q", "text", buckets=5).collect()}
    scan = queries.crossJoin(titles).withColumn("s", trigram_similarity("text", "title")).where("s >= 0.35")
    assert got == {(r["q"], r["id"]): round(r["s"], 9) for r in scan.collect()} and len(got) > 100


def test_titles_of_one_class_are_found_from_every_query(spark, tmp_path, monkeypatch):
    """Equal titles and queries are compared once, and all of them come out, ranked by key among equals."""
    names = ["red bolt", "Red  bolt", "bolt red", "red bolts", "hot ring", "--", None] * 6
    titles = spark.createDataFrame(list(enumerate(names)), "id long, title string")
    ti.build_title_index(titles, "id", "title", str(tmp_path / "t"), buckets=3)
    assert spark.read.parquet(str(tmp_path / "t" / "titles")).count() == 3
    scan = titles.select(F.col("id").alias("q"), F.col("title").alias("text")).crossJoin(titles).withColumn("s", F.round(trigram_similarity("text", "title"), 9)).where("s >= 0.35")
    rows = sorted((r["q"], -r["s"], r["id"]) for r in scan.collect())
    want, last = [], None
    for q, s, key in rows:
        last, n = q, (n + 1 if q == last else 1)
        want.append((q, key, -s, n))
    for sent in (1_000, 1):
        monkeypatch.setattr(ti, "SENT", sent)
        monkeypatch.setattr(ti, "QUERIES", 4)
        out = ti.search_titles(spark, str(tmp_path / "t"), titles.select(F.col("id").alias("q"), F.col("title").alias("text")), "q", "text", buckets=3)
        assert sorted((r["query"], r["key"], round(r["similarity"], 9), r["rank"]) for r in out.collect()) == sorted(want)
