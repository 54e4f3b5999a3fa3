"""What several operators share: bounded slices of Arrow batches, word hashes, lineage cuts, graph components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker tokenises at a time, and words whose hashes it remembers.
SLICE_BYTES, KNOWN_WORDS = 2_000_000, 150_000


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, at most about `limit` bytes of `column` at a time (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def texts(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def ids(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


class WordHashes(dict):
    """64-bit hash of a word, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of consecutive runs with these lengths."""
    ends = np.cumsum(counts, dtype=np.int64)
    return ends - counts, ends


def ranges(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of every run of equal keys in a sorted array."""
    values, starts = np.unique(keys, return_index=True)
    for k, s, e in zip(values.tolist(), starts, [*starts[1:], len(keys)][: len(starts)], strict=True):
        yield k, slice(s, e)


def spark_hash(x: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """F.xxhash64 of a column of longs; seed: the hash of the columns before it."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v: np.ndarray, by: int) -> np.ndarray:
        return v << np.uint64(by) | v >> np.uint64(64 - by)

    h = turned(x.view(np.uint64) * p2, 31) * p1 ^ p5 + np.uint64(8) + np.asarray(seed, np.int64).view(np.uint64)
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).view(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only on a local master."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its hosts share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` as a Parquet table in the shared folder, of which later steps read the columns they need; and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(docs: DataFrame, id_col: str, text_col: str, row: str, nulls_last: bool = True) -> DataFrame:
    """`docs` with a unique `row` in the order of the ids: the id itself where each row has its own.

    Where ids repeat or are absent, rows are numbered by id, then by a digest of the text, and written once, so that
    numbers stay. Only the ids are read to find out.
    """
    own = F.col(id_col).cast("long")
    several = docs.groupBy(own.alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if several.isEmpty():
        return docs.withColumn(row, own)
    order = [own.asc_nulls_last() if nulls_last else own.asc_nulls_first(), F.xxhash64(text_col)]
    return cut_lineage(docs.orderBy(*order).withColumn(row, F.monotonically_increasing_id()))


def share(spark: SparkSession, value):
    """Broadcasts a fitted model or table; the result, called in a task, gives it. Its classes travel along by value."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges`(a long, b long); component = smallest node reachable.

    Alternates large-star and small-star steps until the edges stay as they are, which takes about log^2 rounds, however
    long the chains; each round is one distributed job whose result is checkpointed. No edge list or component is gathered.
    """
    now = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The key is computed anew, so that the join reads plain shuffles of both sides and Spark can split a hub's.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumn("a", F.col("a").bitwiseXOR(F.lit(0)))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def union_find(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its component, for a bounded set of pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}
