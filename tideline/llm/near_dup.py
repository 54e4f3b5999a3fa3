"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

1. A text's shingles (five lower-cased words) are hashed. sigma scatters them over [0, D); pi permutes [0, D), and its
   k-th circular shift gives the k-th signature coordinate, so a shingle at s contributes pi[s], pi[s+1], ... - one
   contiguous stretch of one table.
2. Texts with equal shingle sets form a class; only its smallest id goes on.
3. Classes that share a band's key, and whose short signatures don't rule a link out, are joined into candidate
   groups. Within a key's run no list of pairs is made: a run adds fewer edges than it has members.
4. A group's texts meet in one task, which finds all links between them on full shingle sets by counting shared bits.
   A large group is cut into blocks, and each pair of blocks is a task of its own, so no task holds a whole hot group.
5. Links give components, by distributed star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WordHashes, connected_components, cut_lineage, mix, numbered, partitions, slices, spans_of, texts, union_find

SHINGLE = 5
THRESHOLD = 85
#: A link at the threshold shares no key of BANDS bands with probability (1 - 0.85^ROWS)^BANDS = 9e-7.
BANDS, ROWS = 36, 7
#: D is 2 to this power.
UNIVERSE = 22
#: One byte of each of the first SHORT coordinates; below SHORT_LEAST equal ones a link has a chance under 1e-7.
SHORT, SHORT_LEAST = 64, 38
#: Members of a run of one key that are compared by short signatures; a longer run is linked to its first member.
RUN = 768
#: Texts and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_500_000


class CirculantMinHash:
    def __init__(self, seed: int = 9):
        k, d = BANDS * ROWS, 1 << UNIVERSE
        pi = np.random.default_rng(seed).permutation(d).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[:k])), k)

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of coordinates for each of the non-empty sets that begin at `starts`."""
        at = (mix(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - UNIVERSE)).astype(np.int64)
        out = np.empty((len(starts), self.shifted.shape[1]), np.uint32)
        ends = np.append(starts[1:], len(at))
        i = 0
        while i < len(starts):  # some thousand shingles at a time
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + 20_000, side="right")))
            out[i:j] = self.least(at[starts[i] : ends[j - 1]], starts[i:j] - starts[i])
            i = j
        return out

    def least(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) > 1 or len(at) <= 40_000:
            return np.minimum.reduceat(self.shifted[at], starts, axis=0)
        return np.minimum.reduce([self.shifted[at[i : i + 20_000]].min(axis=0) for i in range(0, len(at), 20_000)])[None]


def shingle_sets(docs: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes; a shorter text's words are one shingle."""
    split = [x.lower().split() for x in docs]
    flat = hashes.of([w for words in split for w in words])
    if len(flat) >= SHINGLE:
        rolled = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[j : len(rolled) + j]
        rolled = mix(rolled)
    out, at = [], 0
    for words in split:
        n = len(words)
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            one = np.uint64(n)
            for h in flat[at : at + n]:
                one = np.uint64((int(one) * 0x9E3779B97F4A7C15 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([one])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _sketch(batches):
    """Rows (id, n_shingles, h1, h2, keys, short); h1 and h2 digest the set, null for an empty one."""
    hashes, minhash = WordHashes(), CirculantMinHash()
    for batch in slices(batches):
        sets = shingle_sets(texts(batch), hashes)
        sizes = np.array([len(x) for x in sets], np.int64)
        some = np.flatnonzero(sizes)
        h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        keys, short = [None] * len(sets), [None] * len(sets)
        if len(some):
            flat = np.concatenate([sets[i] for i in some])
            starts = spans_of(sizes[some])[0]
            h1[some] = np.add.reduceat(mix(flat ^ np.uint64(0x51)), starts)
            h2[some] = np.add.reduceat(mix(flat ^ np.uint64(0xE7)), starts)
            signature = minhash.signatures(flat, starts)
            band = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band + signature[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
            band = mix(band * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            low = (signature[:, :SHORT] & np.uint32(255)).astype(np.uint8)
            for i, k, s in zip(some.tolist(), band, low, strict=True):
                keys[i], short[i] = k.tobytes(), s.tobytes()
        empty = sizes == 0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(h1.view(np.int64), mask=empty), pa.array(h2.view(np.int64), mask=empty), pa.array(keys, pa.binary()), pa.array(short, pa.binary())],
            names=["id", "n_shingles", "h1", "h2", "keys", "short"],
        )


def _banded(batches):
    """Rows (key, id, size) for every band of every class."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        own = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own)], names=["key", "id"])


def _runs(batches):
    """The (key, id) rows, sorted by key, whose key has two rows or more."""
    key, own = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = False  # whether the row carried over has already met its key before
    for batch in batches:
        key = np.append(key, batch.column(0).to_numpy(zero_copy_only=False))
        own = np.append(own, batch.column(1).to_numpy(zero_copy_only=False))
        same = key[1:] == key[:-1]
        many = np.append(held, same) | np.append(same, False)
        last = many[-1:]  # undecided until the next batch, unless it is already known
        keep = many[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(own[:-1][keep])], names=["key", "id"])
        key, own, held = key[-1:], own[-1:], bool(last[0]) if len(last) else False
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], names=["key", "id"])


def _candidates(batches):
    """Edges (a, b) that join what may be linked, from (key, id, short) rows sorted by key."""

    def edges(own: np.ndarray, short: np.ndarray):
        label = np.arange(len(own))
        for i in range(len(own) - 1):
            alike = np.flatnonzero((short[i + 1 :] == short[i]).sum(axis=1) >= SHORT_LEAST) + i + 1
            for j in np.unique(label[alike]):
                if j != label[i]:
                    yield int(own[i]), int(own[j])
                    label[label == j] = label[i]

    def flush(pairs):
        found = [(x, r) for x, r in union_find(pairs).items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["a", "b"])

    key, own, short, pairs, first = None, [], [], [], None
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for k, i, s in zip(*columns, strict=True):
            if k != key:
                if first is None and len(own) > 1:
                    pairs.extend(edges(np.array(own), np.array(short)))
                key, own, short, first = k, [], [], None
                if len(pairs) > 500_000:
                    yield flush(pairs)
                    pairs = []
            if first is None and len(own) == RUN:
                first = own[0]
                pairs.extend((first, x) for x in own[1:])
            if first is None:
                own.append(i)
                short.append(np.frombuffer(s, np.uint8))
            else:
                pairs.append((first, i))
    if first is None and len(own) > 1:
        pairs.extend(edges(np.array(own), np.array(short)))
    yield flush(pairs)


def link_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of the pairs at or above the threshold, exactly."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = counts > 1  # others count in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((n, n), np.int32)
    step = 1 << 15
    for low in range(0, int(shared.sum()), step):
        s, e = np.searchsorted(column, (low, low + step))
        bits = np.zeros((n, step // 8), np.uint8)
        np.bitwise_or.at(bits, (row[s:e], (column[s:e] - low) >> 3), np.uint8(1) << ((column[s:e] - low) & 7).astype(np.uint8))
        words = bits.view(np.uint64)
        used = np.flatnonzero(words.any(axis=0))
        words = np.ascontiguousarray(words[:, used])
        for i in range(n):
            inter[i, i:] += np.bitwise_count(words[i:] & words[i]).sum(axis=1, dtype=np.int32)
    inter = np.triu(inter, 1)
    inter += inter.T.copy()
    size = size.astype(np.int32)  # a block's sizes times 100 stay below 2^31
    return (100 + THRESHOLD) * inter >= THRESHOLD * (size[:, None] + size[None, :])


def _verify(table: pa.Table) -> pa.Table:
    """Edges (a, root) of the link components in each candidate group, or pair of blocks, of a task."""
    hashes = WordHashes()
    own = table.column("id").to_numpy()
    part = list(zip(*(table.column(c).to_pylist() for c in ("gid", "i", "j")), strict=True))
    groups: dict[tuple, list[int]] = {}
    for at, p in enumerate(part):
        groups.setdefault(p, []).append(at)
    a, b = [], []
    column = table.column("text").cast(pa.binary())
    for rows in groups.values():
        rows = sorted({int(own[r]): r for r in rows}.values(), key=lambda r: own[r])
        sets = shingle_sets([column[r].as_py() or b"" for r in rows], hashes)
        if len(rows) < 2:
            continue
        linked = link_matrix(sets)
        left = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if not left[i]:
                continue
            left[i] = False
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & left)
                left[front] = False
                a.extend(int(own[rows[x]]) for x in front)
                b.extend([int(own[rows[i]])] * len(front))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of `docs`.

    Null texts and texts without words have empty sets: they link with nothing and are kept. Copies of a text are in
    one component. Rows that repeat an id are linked each by its own text; all rows that bear their component's id are
    kept. Rows without an id come after all others: they take the id of what they link with, and where no row of a
    component has one, component_id is null and one row is kept. Texts of any length are read whole. An empty table
    gives no rows; other columns of any name are ignored.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).alias("text"))
    named = numbered(named, "given", "text", "id")
    base = named.select("id", "text")
    sketch = cut_lineage(base.mapInArrow(_sketch, "id long, n_shingles long, h1 long, h2 long, keys binary, short binary"))
    # Written out, so that joins with it read plain shuffles, which Spark can split where many texts share a set.
    classes = cut_lineage(sketch.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    reps = cut_lineage(
        sketch.join(classes.withColumnRenamed("rep", "id"), ["h1", "h2", "id"], "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", "keys", "short")
    )
    banded = reps.select("id", "keys").mapInArrow(_banded, "key long, id long")
    runs = banded.repartition(partitions(spark), "key").sortWithinPartitions("key", "id").mapInArrow(_runs, "key long, id long")
    met = runs.join(reps.select("id", "short"), "id")
    met = met.repartition(partitions(spark), "key").sortWithinPartitions("key", "id").select("key", "id", "short")
    grouped = connected_components(met.mapInArrow(_candidates, "a long, b long"))
    grouped = cut_lineage(grouped.join(reps.select(F.col("id").alias("node"), "n_shingles"), "node").select(F.col("node").alias("id"), F.col("component").alias("gid"), "n_shingles"))
    sizes = grouped.groupBy("gid").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("gid", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    total = grouped.agg(F.sum("n_shingles").alias("s")).first()["s"] or 0
    bins = max(1, -(-total // 400_000))
    placed = grouped.join(sizes, "gid").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # A block of a large group meets every other, and a group of two blocks or more has no task for itself alone.
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine")))
    placed = placed.withColumn("other", F.explode(other)).select(
        "id", "gid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("gid"), F.lit(bins))).otherwise(F.xxhash64("gid", F.least("mine", "other"), F.greatest("mine", "other"))).alias("task"),
    )
    links = placed.join(base, "id").groupBy("task").applyInArrow(_verify, "a long, b long")
    component = connected_components(links).select(F.col("node").alias("rep"), F.col("component"))
    member = sketch.select("id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left").join(component, "rep", "left")
    member = member.select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("component"))
    if named.where("NOT id <=> given").isEmpty():
        return member.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    names = named.select("id", "given")
    member = member.join(names, "id").join(names.select(F.col("id").alias("component"), F.col("given").alias("component_id")), "component")
    kept = F.coalesce(F.col("given") == F.col("component_id"), F.col("id") == F.col("component"))
    return member.select(F.col("given").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
