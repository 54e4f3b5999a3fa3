"""Vector code compression: product codes whose codebooks come from ball k-means on whole numbers.

Vectors become whole numbers, packed in blocks of rows that are written once per round with their codes. A round is one
pass: each block's parts of one entry form a ball around it, with a radius. Only entries nearer to the ball's entry
than twice the radius are its neighbours. A part nearer to its own entry than half the way to the nearest neighbour lies
in the stable core and stays. Outside of it, rings bounded by half the ways to the neighbours say which of them can be
as near as the own entry, and only these are compared. A ball whose entry and neighbours stayed put since the last round
isn't looked at. All bounds compare whole squares, so that the result is that of comparing all entries.

Blocks also carry the sums of their balls, kept up to date by the parts that move. The sums of a block are of constant
size; a codebook is what the driver gathers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import removed, share, spans_of, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers from here on would let a squared distance leave 64 bits.
LARGEST = 1 << 29
#: Components of a block at most.
BLOCK = 2_000_000


def assigned(x, entries, was=None, old=None, radius=None):
    """(code, squared radius of each ball) of the parts `x` (n, width), exactly the nearest of `entries`, ties to the lower.

    `was`, `old` and `radius`: the codes of the last round, the entries that they are nearest to, and the radii then.
    """
    count = len(entries)
    if was is None:
        away = np.stack([((x - e) ** 2).sum(1) for e in entries])
        code = away.argmin(0).astype(np.uint8)
        radius = np.zeros(count, np.int64)
        np.maximum.at(radius, code, away.min(0))
        return code, radius
    gaps = ((entries[:, None] - entries[None]) ** 2).sum(-1)
    moved = (entries != old).any(1)
    code, reach = was.copy(), np.zeros(count, np.int64)
    members = np.argsort(was, kind="stable")
    starts = np.searchsorted(was[members], np.arange(count + 1))
    for own in range(count):
        ball = members[starts[own] : starts[own + 1]]
        if not len(ball):
            continue
        others = np.argsort(gaps[own], kind="stable")
        others = others[others != own]
        if not moved[own] and not moved[others[gaps[own][others] <= 4 * radius[own]]].any():
            reach[own] = max(reach[own], radius[own])
            continue
        least = ((x[ball] - entries[own]) ** 2).sum(1)
        ring = np.searchsorted(gaps[own][others], 4 * least, side="right")  # 0: in the stable core
        nearest = np.full(len(ball), own, np.uint8)
        for i, other in enumerate(others[: int(ring.max())]):
            rows = np.flatnonzero(ring > i)
            away = ((x[ball[rows]] - entries[other]) ** 2).sum(1)
            better = (away < least[rows]) | ((away == least[rows]) & (other < nearest[rows]))
            least[rows[better]], nearest[rows[better]] = away[better], other
        code[ball] = nearest
        np.maximum.at(reach, nearest, least)
    return code, reach


def _packed(parts: int, scale: int):
    """Blocks (width, ids, labels, bytes of a number, numbers) of the rows of each batch whose components are all there and finite."""

    def pack(batches):
        for batch in batches:
            vectors = batch.column(2)
            size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            begin, end = spans_of(np.maximum(size, 0))
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            fine = (size >= 0) & (bad[end] == bad[begin])
            for width in np.unique(size[fine]).tolist():
                rows = np.flatnonzero(fine & (size == width))
                padded = -(-width // parts) * parts
                step = max(1, BLOCK // max(1, padded))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    x = np.zeros((len(some), padded))
                    x[:, :width] = flat[begin[some][:, None] + np.arange(width)]
                    x = np.floor(x * scale)
                    top = np.abs(x).max(initial=0)
                    if top >= LARGEST:
                        raise ValueError(f"components of {LARGEST // scale} or more don't fit whole distances")
                    kind = np.int16 if top < 1 << 15 else np.int32
                    ids, labels = batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some))
                    one = [0, len(some)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32()), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()])],
                        names=["width", "ids", "labels", "size", "numbers"],
                    )

    return pack


def _numbers(block: dict, parts: int) -> np.ndarray:
    """(rows, parts, components of a part)"""
    flat = np.frombuffer(block["numbers"], np.int16 if block["size"] == 2 else np.int32)
    return flat.reshape(len(block["ids"]), parts, len(flat) // (len(block["ids"]) * parts)).astype(np.int64)


def _blocks(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            yield one, {name: one.column(i)[0].as_py() for i, name in enumerate(one.schema.names) if name not in ("ids", "labels")} | {"ids": one.column("ids")[0].values}


def _seeds(parts: int, entries: int):
    """(id, vector) of the rows of each block that may be among the `entries` smallest ids."""

    def list_them(batches):
        for _, block in _blocks(batches):
            ids = block["ids"]
            least = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            last = ids[least[min(entries, len(least)) - 1]]
            rows = np.arange(len(ids)) if not last.is_valid else np.flatnonzero(pc.fill_null(pc.less_equal(ids, last), False).to_numpy(zero_copy_only=False))
            x = _numbers(block, parts).reshape(len(ids), -1)[rows]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["id", "vector"])

    return list_them


def _round(books):
    """One round over blocks: codes, radii and sums under `books`() = (codebooks, those before or None)."""

    def work(batches):
        now, before = books()
        parts, count, width = now.shape
        for one, block in _blocks(batches):
            x = _numbers(block, parts)
            first = before is None
            codes = np.zeros(x.shape[:2], np.uint8) if first else np.frombuffer(block["codes"], np.uint8).reshape(x.shape[:2])
            radii = np.zeros((parts, count), np.int64) if first else np.frombuffer(block["radii"], np.int64).reshape(parts, count)
            sums = np.zeros((parts, count, width + 1), np.int64) if first else np.frombuffer(block["sums"], np.int64).reshape(parts, count, width + 1).copy()
            new, reach = codes.copy(), radii.copy()
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                if first:
                    new[:, p], reach[p] = assigned(part, now[p])
                else:
                    new[:, p], reach[p] = assigned(part, now[p], codes[:, p], before[p], radii[p])
                moved = np.arange(len(part)) if first else np.flatnonzero(new[:, p] != codes[:, p])
                counted = np.column_stack([part[moved], np.ones(len(moved), np.int64)])
                np.add.at(sums[p], new[moved, p], counted)
                if not first:
                    np.subtract.at(sums[p], codes[moved, p], counted)
            kept = [one.column(n) for n in ("width", "ids", "labels", "size", "numbers")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array([v.tobytes()]) for v in (new, reach, sums)], names=["width", "ids", "labels", "size", "numbers", "codes", "radii", "sums"])

    return work


def _summed(batches):
    """(place, value) of the sums over all blocks of a partition."""
    total = None
    for batch in batches:
        for sums in batch.column(0):
            one = np.frombuffer(sums.as_py(), np.int64)
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])


def _coded(books):
    """(id, label, code, error) of every row of the blocks."""

    def work(batches):
        now, _ = books()
        digits = np.array([f"{v:02x}" for v in range(256)])
        for one, block in _blocks(batches):
            x = _numbers(block, len(now))
            codes = np.frombuffer(block["codes"], np.uint8).reshape(x.shape[:2])
            error = sum(((x[:, p] - now[p][codes[:, p]]) ** 2).sum(1) for p in range(len(now)))
            text = ["".join(row) for row in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([block["ids"], one.column("labels")[0].values, pa.array(text), pa.array(error)], names=["id", "label", "code", "error"])

    return work


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, code, error, label_error, codebooks_sha256) per kept row, codebooks (parts, entries, components)).

    Component x counts as floor(scale * x). Codebooks start as the parts of the rows with the smallest ids (null ids come
    last, equal ids by vector); each round assigns all parts to the nearest entry, ties to the lower, and moves each used
    entry to the floored mean of its parts; in the end all parts are assigned again.

    Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors than the longest kept one
    lack components, which count as null: they are dropped, too. Where `parts` doesn't divide the length, zeros fill the
    last parts. With fewer rows than `entries` the codebooks are that much smaller. Rows that repeat an id, or have none,
    are coded each by itself. An empty table gives no rows. Components of 131072 or more (LARGEST / scale) raise an
    error, as squared distances would leave 64 bits. Other columns of any name are ignored. Vectors of any length are read
    in blocks of BLOCK components.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = {f.name: f.dataType for f in base.schema}
    fields = [("width", T.IntegerType()), ("ids", T.ArrayType(kind["id"])), ("labels", T.ArrayType(kind["label"])), ("size", T.IntegerType()), ("numbers", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    table, path = written(base.mapInArrow(_packed(parts, scale), schema))
    width = table.agg(F.max("width")).first()[0]
    rows = T.StructType([T.StructField("id", kind["id"]), T.StructField("label", kind["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if width is None:
        out = spark.createDataFrame([], rows)
        books = np.zeros((parts, 0, 0), np.int64)
    else:
        seeds = T.StructType([T.StructField("id", kind["id"]), T.StructField("vector", T.ArrayType(T.LongType()))])
        listed = table.where(F.col("width") == width).mapInArrow(_seeds(parts, entries), seeds)
        first = [r.vector for r in listed.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
        books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
        schema = T.StructType(schema.fields + [T.StructField(n, T.BinaryType()) for n in ("codes", "radii", "sums")])
        before, source = None, table.where(F.col("width") == width)
        for again in range(rounds + 1):
            table, new_path = written(source.mapInArrow(_round(share(spark, (books, before))), schema))
            removed(spark, path)
            path, source = new_path, table
            if again < rounds:
                sums = table.select("sums").mapInArrow(_summed, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
                totals = [int(r.value) for r in sums.orderBy("place").collect()]
                before, books = books, _means(books, totals)
        out, _ = written(table.mapInArrow(_coded(share(spark, (books, None))), rows))
        removed(spark, path)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    by_label = out.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    joined = out.join(by_label, F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def _means(books: np.ndarray, totals: list[int]) -> np.ndarray:
    """The floored means of the balls from their sums and counts; entries without parts stay."""
    parts, count, width = books.shape
    new = books.copy()
    for p in range(parts):
        for e in range(count):
            at = (p * count + e) * (width + 1)
            if n := totals[at + width]:
                new[p, e] = [v // n for v in totals[at : at + width]]
    return new
