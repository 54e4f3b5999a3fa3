"""Benchmark decontamination by Wu-Manber search over words.

The benchmark's windows (13 consecutive words; a shorter item is one window) are the patterns. Texts and patterns are
sequences of word numbers; a block is two adjacent words. Patterns of one length share a shift table, which says how
far a search may jump after it has seen a block, and buckets by the hash of their last block. A jump of zero leads to
the bucket, whose patterns are compared with the text word by word. Many stretches of text are searched side by side:
each step moves every stretch's position by its own shift.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import ids, share, slices, spans_of, texts

WINDOW = 13
#: Text of benchmark items that one search table is built from; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 2_000_000
#: Texts that wait together while several tables pass over them.
HELD_BYTES = 32_000_000
#: Words that one lane of the search covers.
LANE = 256
TABLE_BITS = 20

#: A-Z become a-z; bytes below 128 that are neither digits nor letters become spaces.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Patterns:
    """Patterns of one length m over word numbers: shift table, and buckets by last block."""

    def __init__(self, rows: np.ndarray, owner: np.ndarray):
        """rows: (n, m) word numbers from 1; owner: the item number of each. Equal rows become one pattern."""
        self.m = rows.shape[1]
        self.block = min(2, self.m)
        order = np.lexsort((owner, *rows.T))
        rows, owner = rows[order], owner[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        more = new | np.append(True, owner[1:] != owner[:-1])
        rows, owner, first = rows[new], owner[more], np.flatnonzero(new[more])
        last = np.append(first[1:], len(owner))
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.uint8)
        for end in range(self.block - 1, self.m):  # a later end leaves a smaller shift, which wins
            at = self.hashes(rows[:, end - 1] if self.block == 2 else None, rows[:, end])
            self.shift[at] = np.minimum(self.shift[at], self.m - 1 - end)
        keys = self.bucket(rows[:, 0], rows[:, max(0, self.m - 2)], rows[:, -1])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows, self.first, self.last, self.owner = keys[order], rows[order], first[order], last[order], owner

    def owners(self, pattern: int) -> list[int]:
        return self.owner[self.first[pattern] : self.last[pattern]].tolist()

    @staticmethod
    def hashes(a, b) -> np.ndarray:
        x = b.astype(np.uint64) if a is None else a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64)
        return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    @staticmethod
    def bucket(first, last_but_one, last) -> np.ndarray:
        """The last block with the first word, which tells apart windows that end alike."""
        x = first.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + last_but_one.astype(np.uint64)
        return x * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence in a sequence of word numbers, 0 being in no pattern."""
        m, n = self.m, len(text)
        ends = [np.zeros(0, np.int64)]
        lanes = np.arange(m - 1, n, LANE)
        stop = np.minimum(lanes + LANE, n)
        at = lanes
        while len(at):
            move = self.shift[self.hashes(text[at - 1] if self.block == 2 else None, text[at])]
            hit = move == 0
            ends.append(at[hit])
            at = at + np.maximum(move, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate(ends)
        key = self.bucket(text[ends - m + 1], text[ends - min(1, m - 1)], text[ends])
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        some = high > low
        ends, low, size = ends[some], low[some], (high - low)[some]
        pos = np.repeat(ends, size)
        which = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        same = np.ones(len(pos), bool)
        for j in range(m):
            same[same] = text[pos[same] - m + 1 + j] == self.rows[which[same], j]
        return pos[same], which[same]


def compile_items(items: list[tuple[object, str]]) -> tuple[dict[bytes, int], list[Patterns], list[str]]:
    """(word numbers, patterns by length, item names) of (item, text) rows."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({str(item) for item, _ in items})
    number = {name: i for i, name in enumerate(names)}
    rows: dict[int, list[np.ndarray]] = {}
    owner: dict[int, list[np.ndarray]] = {}
    for item, text in items:
        found = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode())], np.int32)
        m = min(WINDOW, len(found))
        if m:
            rows.setdefault(m, []).append(np.lib.stride_tricks.sliding_window_view(found, m))
            owner.setdefault(m, []).append(np.full(len(found) - m + 1, number[str(item)], np.int32))
    patterns = [Patterns(np.concatenate(rows[m]), np.concatenate(owner[m])) for m in sorted(rows)]
    return vocabulary, patterns, names


def search(vocabulary: dict[bytes, int], patterns: list[Patterns], docs: list[bytes]):
    """For each doc: (words, marks of hit words as a boolean array, numbers of the items that occur)."""
    split = [words_of(x) for x in docs]
    starts, ends = spans_of(np.array([len(x) + 1 for x in split], np.int64))
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)  # a 0 parts the documents
    for s, found in zip(starts, split, strict=True):
        text[s : s + len(found)] = np.fromiter((vocabulary.get(w, 0) for w in found), np.int64, len(found))
    cover = np.zeros(len(text) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for p in patterns:
        pos, which = p.find(text)
        np.add.at(cover, pos - p.m + 1, 1)
        np.add.at(cover, pos + 1, -1)
        doc = np.searchsorted(starts, pos, side="right") - 1
        for d, w in {*zip(doc.tolist(), which.tolist(), strict=True)}:
            items.setdefault(d, set()).update(p.owners(w))
    hit = np.cumsum(cover[:-1]) > 0
    for d, (s, found) in enumerate(zip(starts, split, strict=True)):
        yield len(found), hit[s : s + len(found)], items.get(d, set())


def _searcher(tables: list):
    """Rows (id, n_words, n_hit, n_items, items_sha256, ...) of rows (id, text, ...), searched by each table in turn.

    Up to HELD_BYTES of texts wait while the tables pass over them, one opened at a time; a single one stays open.
    """

    def run(batches):
        def opened(table):
            return pickle.loads(zstandard.ZstdDecompressor().decompress(table()))

        only = opened(tables[0]) if len(tables) == 1 else None
        for held in _held(batches, 1 if only else HELD_BYTES):
            found = [[(0, [], set()) for _ in range(batch.num_rows)] for batch in held]
            for table in tables:
                vocabulary, patterns, names = only or opened(table)
                for batch, own in zip(held, found, strict=True):
                    for i, (n, hit, items) in enumerate(search(vocabulary, patterns, texts(batch))):
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist() if hit.any() else []
                        own[i] = (n, own[i][1] + edges, own[i][2] | {names[k] for k in items})
            for batch, own in zip(held, found, strict=True):
                n_hit, digest = [], []
                for _, edges, items in own:
                    total, reach = 0, 0
                    for a, b in sorted(zip(edges[::2], edges[1::2], strict=True)):
                        total += max(0, b - max(a, reach))
                        reach = max(reach, b)
                    n_hit.append(total)
                    digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
                counts = [[n for n, _, _ in own], n_hit, [len(items) for _, _, items in own]]
                columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_hit", "n_items", "items_sha256", *batch.schema.names[2:]])

    return run


def _held(batches, limit: int):
    """Slices of rows, as many together as make up about `limit` bytes."""
    held, n = [], 0
    for batch in slices(batches):
        held.append(batch)
        n += batch.column(1).nbytes
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """Per row of `docs`: (id, n_words, n_hit, n_items, items_sha256, contaminated); with `carry` also `row`, the whole input row.

    A word is hit if it lies in an occurrence of a window of any item. A document is contaminated if it has hit words
    and they are a twentieth of its words at least. Null and empty texts have no words and are clean; items without
    words have no window. Rows that repeat an id are judged each by itself. An empty benchmark or an empty table gives
    no hits or no rows. Texts of any length are read whole; other columns of any name are ignored or carried. The
    benchmark is read in blocks of about BLOCK_BYTES of its text, each of which becomes one broadcast search table. One
    worker per task searches all of them in turn: it holds their packed forms, about four times the benchmark's text, and
    opens one at a time. No block grows with the documents.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    more = [F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    tables = []
    for k in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(blocks)) == k)
        table = cloudpickle.dumps(compile_items([(r["item"], r["text"]) for r in part.collect()]))
        tables.append(share(spark, zstandard.ZstdCompressor(level=3).compress(table)))
    shape = "id long, n_words long, n_hit long, n_items long, items_sha256 string"
    schema = T.StructType([*T.StructType.fromDDL(shape).fields, *rows.schema.fields[2:]])
    out = rows.mapInArrow(_searcher(tables), schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id_col)
