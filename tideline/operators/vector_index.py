"""A vector index of inverted lists: rows are written by their nearest centroid, and searches read the lists they probe.

Centroids are fitted on a bounded sample; every row is indexed. The table is partitioned by list, so that a search prunes
to the folders of the lists that its queries probe. How many lists a query probes is set at build time by the sample: the
fewest that keep the wanted share of true neighbours there. Candidates are scored exactly, in products of matrices.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.graph import stored

#: Rows of the sample that centroids and probes are fitted on, and sample rows that probes are measured with.
SAMPLE, ASKED = 20_000, 300
#: Rows of a list that a task scores at a time; longer lists are dealt to several tasks.
CHUNK = 20_000
LISTS, ROUNDS, RECALL, NEIGHBOURS = 1_024, 8, 0.95, 12


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))


def fitted_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors; a list that no row chose keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        used = np.bincount(own, minlength=len(centres)) > 0
        centres[used] = sums[used] / np.maximum(1e-300, np.linalg.norm(sums[used], axis=1, keepdims=True))
    return centres


def needed_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, seed: int = 8) -> int:
    """The fewest lists whose rows hold this share of the k nearest of sample rows, themselves excluded."""
    asked = np.random.default_rng(seed).permutation(len(sample))[:ASKED]
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    own = (sample @ centres.T).argmax(1)
    order = np.argsort(-(sample[asked] @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], axis=1)
    at = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1))
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def build_index(rows: DataFrame, key: str, emb: str, path: str, lists: int | None = None, recall: float = RECALL, k: int = NEIGHBOURS) -> dict:
    """Writes the index of all rows with a vector below `path` and returns its parameters.

    lists: about the square root of the number of rows, LISTS at most, unless given. Every row goes into one list.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(key).cast("long").alias("key"), F.col(emb).cast("array<float>").alias("emb")).where(F.size("emb") > 0)
    n = held.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = held.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    taken = sample.select("emb").toArrow().column(0).combine_chunks()
    x = _unit(taken) if len(taken) else np.zeros((0, 1))
    centres = fitted_centroids(x, max(1, min(lists or int(np.sqrt(n)) or 1, LISTS, len(x) or 1))) if len(x) else np.zeros((1, 1))
    about = {"rows": n, "lists": len(centres), "probes": needed_probes(x, centres, k, recall) if len(x) > 1 else 1, "k": k}
    shared = spark.sparkContext.broadcast(centres)

    def dealt(batches):
        for batch in batches:
            own = (_unit(batch.column(1)) @ shared.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], names=["key", "emb", "list"])

    out = held.mapInArrow(dealt, "key long, emb array<float>, list int")
    # Long lists are written by several tasks, under the chunk that a search deals them by.
    chunks = max(1, -(-n // CHUNK))
    out = out.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    out.repartition("list", F.pmod("part", F.lit(64))).sortWithinPartitions("list", "part", "key").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    meta = [(i, c) for i, c in enumerate(centres.tolist())]
    spark.createDataFrame(meta, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame([(json.dumps(about | {"chunks": chunks}),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return about


def _best(k: int):
    """The best k rows of a chunk of a list for each query that probes it."""

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query": [], "row": [], "cosine": []}
        if asked.num_rows and held.num_rows:
            q = _unit(asked.column("emb").combine_chunks())
            ids, keys = asked.column("query").to_numpy(), held.column("key").to_numpy()
            score = q @ _unit(held.column("emb").combine_chunks()).T
            score[ids[:, None] == keys[None]] = -np.inf
            order = np.lexsort((np.broadcast_to(keys, score.shape), -score), axis=1)[:, :k]
            value = np.take_along_axis(score, order, axis=1)
            i, j = np.nonzero(np.isfinite(value))
            out = {"query": ids[i], "row": keys[order[i, j]], "cosine": value[i, j]}
        return pa.table({"query": pa.array(out["query"], pa.int64()), "row": pa.array(out["row"], pa.int64()), "cosine": pa.array(out["cosine"], pa.float64())})

    return work


def search_index(spark: SparkSession, path: str, queries: DataFrame, key: str, emb: str, k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
    """(query, row, cosine, rank): the k nearest rows of each query in the lists that it probes, scored exactly.

    `probes`: those found at build time, unless given; as many as there are lists make the search exact. A row isn't its own
    neighbour. Only the folders of probed lists are read; queries may be many.
    """
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    probes = min(about["lists"], probes or about["probes"])
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    shared = spark.sparkContext.broadcast(np.array([r["centre"] for r in rows]))

    def probing(batches):
        for batch in batches:
            score = _unit(batch.column(1)) @ shared.value.T
            near = np.argpartition(-score, probes - 1, axis=1)[:, :probes].astype(np.int32)
            at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.reshape(-1))], names=["query", "emb", "list"])

    held = queries.select(F.col(key).cast("long").alias("query"), F.col(emb).cast("array<float>").alias("emb")).where(F.size("emb") > 0)
    asked = stored(held.mapInArrow(probing, "query long, emb array<float>, list int"))
    lists = [r[0] for r in asked.select("list").distinct().collect()]  # no more than there are lists
    inverted = spark.read.schema("key long, emb array<float>, part int, list int").parquet(f"{path}/rows").where(F.col("list").isin(lists))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(about["chunks"] - 1))))
    found = asked.groupBy("list", "part").cogroup(inverted.groupBy("list", "part")).applyInArrow(_best(k), "query long, row long, cosine double")
    first = F.slice(F.sort_array(F.collect_list(F.struct("cosine", (-F.col("row")).alias("less"))), asc=False), 1, k)
    top = found.groupBy("query").agg(first.alias("top")).select("query", F.posexplode("top").alias("rank", "t"))
    return top.select("query", (-F.col("t.less")).alias("row"), F.col("t.cosine").alias("cosine"), (F.col("rank") + 1).cast("long").alias("rank"))
