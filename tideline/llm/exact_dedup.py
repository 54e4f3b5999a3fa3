"""Exact dedup through counting quotient filters.

Every partition turns the 64-bit fingerprints of its texts into counting quotient filters, one per range of the
fingerprint's top bits. Filters of one range merge without loss, since each decodes to its fingerprints in order of
(quotient, remainder) with exact counts. Only fingerprints with a count above one lead to byte verification: their
texts, and no others, are grouped by their bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut_lineage, partitions

#: Fingerprints that a partition holds before it writes its filters.
FLUSH = 4_000_000
#: Expected fingerprints of one filter after merging.
FILTER_ROWS = 500_000
#: At most so many fingerprints count as hot, as each has over 1/HOT of all rows.
HOT = 1_000


class CountingQuotientFilter:
    """Fingerprints of one range as quotients (occupied and run-end bits) and remainders, with exact counts.

    A fingerprint of `bits` bits splits into its top q bits (the quotient, implied by the run that a slot is in) and
    the rest (the remainder, stored). Runs follow in order of quotients, remainders ascend within a run. Counts above
    one are kept in a side array that a bit per slot points into, rather than in slots of their own.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray, bits: int):
        """values: ascending, distinct, below 2^bits."""
        self.values, self.counts, self.bits = values, counts, bits

    def encode(self) -> bytes:
        n = len(self.values)
        q = min(self.bits, max(1, int(np.ceil(np.log2(max(1, n) / 0.75)))))
        r = self.bits - q
        quotients = (self.values >> np.uint64(r)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_end = np.append(quotients[1:] != quotients[:-1], True)[:n]
        width = max(1, -(-r // 8))
        remainders = (self.values & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        many = self.counts > 1
        bits = [np.packbits(x).tobytes() for x in (occupied, run_end, many)]
        return struct.pack("<QBBB", n, q, self.bits, width) + b"".join(bits) + remainders.tobytes() + self.counts[many].astype("<u8").tobytes()

    @classmethod
    def decode(cls, block: bytes) -> CountingQuotientFilter:
        n, q, bits, width = struct.unpack_from("<QBBB", block)
        at, r = struct.calcsize("<QBBB"), bits - q
        found = []
        for size in (1 << q, n, n):
            length = -(-size // 8)
            found.append(np.unpackbits(np.frombuffer(block, np.uint8, length, at), count=size).astype(bool))
            at += length
        occupied, run_end, many = found
        run = np.cumsum(run_end) - run_end
        quotients = np.flatnonzero(occupied).astype(np.uint64)[run]
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(block, np.uint8, n * width, at).reshape(n, width)
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(block, "<u8", -1, at + n * width).astype(np.int64)
        return cls(quotients << np.uint64(r) | raw.view("<u8").reshape(n).astype(np.uint64), counts, bits)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        values = np.concatenate([f.values for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(values, kind="stable")  # merges the ascending runs
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
        return cls(values[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits)


def _filters(prefix: int):
    """Rows (range, filter) for the fingerprints of a partition; `prefix` top bits name the range."""

    def write(values: np.ndarray):
        values, counts = np.unique(values, return_counts=True)
        ranges = (values >> np.uint64(64 - prefix)).astype(np.int64) if prefix else np.zeros(len(values), np.int64)
        keys, starts = np.unique(ranges, return_index=True)
        ends = np.append(starts[1:], len(values))
        low = values & np.uint64((1 << (64 - prefix)) - 1)
        blocks = [CountingQuotientFilter(low[s:e], counts[s:e], 64 - prefix).encode() for s, e in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(blocks, pa.binary())], names=["range", "filter"])

    def build(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= FLUSH:
                yield write(np.concatenate(held))
                held, n = [], 0
        if n:
            yield write(np.concatenate(held))

    return build


def _merged(prefix: int):
    def merge(table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.decode(x.as_py()) for x in table.column("filter")])
        many = whole.counts > 1
        top = np.uint64(table.column("range")[0].as_py() << (64 - prefix)) if prefix else np.uint64(0)
        return pa.table({"fp": (whole.values[many] | top).view(np.int64), "n": whole.counts[many]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the values of the long column `fp` that occur more than once."""
    ranges = max(rows / FILTER_ROWS, min(partitions(fingerprints.sparkSession), rows / 2_000))
    prefix = max(0, int(np.ceil(np.log2(max(1, ranges)))))
    built = fingerprints.mapInArrow(_filters(prefix), "range long, filter binary")
    return built.groupBy("range").applyInArrow(_merged(prefix), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows with identical texts: (id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts compare byte for byte, without normalisation; null counts as the empty text, so null and empty texts form
    one group. `keep_id` is the group's largest id (null ids count as smaller than any; a group of null ids alone has
    a null keep_id and keeps nothing). Rows that repeat an id and its text count each, and stay or go together. An
    empty table gives no rows. Texts of any length are read whole. Other columns of `docs`, whatever their names, are
    ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("fp", F.xxhash64("text"))
    light = cut_lineage(base.select("id", "fp", F.sha2("text", 256).alias("text_sha256")))  # hashes each text once
    rows = light.count()
    repeated = cut_lineage(repeated_fingerprints(light.select("fp"), rows))
    # Hot fingerprints: under HOT of them by arithmetic, so the list is bounded. Their copies meet in a map-side
    # combine, not in a join.
    hot = [r.fp for r in repeated.where(F.col("n") * HOT > rows).where("n > 100").select("fp").collect()]
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    rare = base.where(~is_hot).join(repeated.select("fp"), "fp", "left_semi")
    verified = None
    for part in [rare] + ([base.where(is_hot)] if hot else []):
        part = part.groupBy("fp", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        verified = part if verified is None else verified.unionByName(part)
    classes = verified.select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    joined = light.join(classes, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
    )
