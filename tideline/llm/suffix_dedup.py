"""Suffix-array dedup: bytes covered by a string of WINDOW bytes that also starts elsewhere go, all its places alike.

1. The anchor of a window is its least hashed run of GRAM bytes, so equal windows have equal anchors at one offset. The
   windows of one anchor whose offsets lie in one class of STEPS form a passage, and the bytes that they all share make
   its key: equal windows have equal keys, and keys of unrelated texts differ. Each partition lists its passages as (key,
   digest, place, windows). Passages of a partition that are equal are marked at once, and one of them goes on.
2. Lists meet by key. A key that occurs once ends there. Places of equal passages are marked whole; keys with several
   different passages, of which one occurs once, ask for the bytes of one place of each.
3. Passages asked for meet in shards of their keys. A shard is cut into blocks of BLOCK bytes. Each block gets a suffix
   array by Larsson and Sadakane's refinement, which doubles the sorted length and sorts only suffixes that still tie,
   and the common prefixes of neighbours by Kasai's scan, passages side by side. Where a key runs on from one block into
   the next, its windows are merged into the arrays before by binary search.
4. Marks go back to their documents, whose covered bytes are removed.

Keys that very many different passages share are found on a sample of all texts, and their windows are dealt in finer
classes, in the end one by one, where only equal windows share a key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut_lineage, ids, mix, numbered, partitions, ranges, share, slices, spans_of, spark_hash, texts

WINDOW, GRAM = 400, 32
#: Offsets of an anchor that share a key, from coarse to fine.
STEPS = (185, 23, 1)
#: Bytes hashed at a time; positions of a piece fit into 22 bits.
PIECE = 1_000_000
#: Passages that a partition holds before it lists them.
FLUSH = 1_000_000
#: Bytes of a block with a suffix array of its own.
BLOCK = 1_500_000
#: Bytes of the sample in which shared keys are looked for, and its least share of all; it steers the routing, no result.
SAMPLE_BYTES, SAMPLE_SHARE = 24_000_000, 1 / 1_000

_BASE = 0x9E3779B97F4A7C15 | 5
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))
_SALTS = mix(np.arange(7, 7 + len(STEPS), dtype=np.uint64))
_POWERS: list[np.ndarray] = []


def stretches(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of these stretches in turn."""
    return np.repeat(begin - spans_of(lengths)[0], lengths) + np.arange(int(lengths.sum()))


class RunHashes:
    """64-bit polynomial hashes of any run of bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if not _POWERS or len(_POWERS[0]) < n:
            with np.errstate(over="ignore"):
                _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(n, 2 * PIECE), p, np.uint64))) for p in (_BASE, pow(_BASE, -1, 1 << 64))]
        self.up = _POWERS[0]
        self.sums = np.append(np.uint64(0), np.cumsum(_SYMBOLS[data] * _POWERS[1][: len(data)]))

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.up[at])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.up[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, from running minima within blocks of that width in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


class Passages:
    """Columns of passages: key, digest, document, first window, windows, and whether it is known to repeat."""

    FIELDS = (("key", np.uint64), ("digest", np.uint64), ("doc", np.int64), ("start", np.int64), ("n", np.uint32), ("many", np.bool_))

    def __init__(self, *columns):
        for (name, kind), x in zip(self.FIELDS, columns, strict=True):
            setattr(self, name, np.asarray(x, kind))

    def __len__(self):
        return len(self.doc)

    def take(self, at) -> Passages:
        return Passages(*(getattr(self, name)[at] for name, _ in self.FIELDS))

    @classmethod
    def concat(cls, parts: list[Passages]) -> Passages:
        return cls(*(np.concatenate([getattr(p, name) for p in parts] or [np.zeros(0, kind)]) for name, kind in cls.FIELDS))

    def pack(self) -> bytes:
        raw = b"".join(getattr(self, name).tobytes() for name, _ in self.FIELDS)
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpack(cls, block: bytes) -> Passages:
        raw, at, columns = zstandard.ZstdDecompressor().decompress(block), 0, []
        n = len(raw) // sum(np.dtype(kind).itemsize for _, kind in cls.FIELDS)
        for _, kind in cls.FIELDS:
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*columns)

    def alike(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order by key, digest and place; number of the group of equal passages; group starts), in that order."""
        order = np.lexsort((self.start, self.doc, self.digest, self.key))
        key, digest = self.key[order], self.digest[order]
        new = np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]))[: len(order)]
        return order, np.cumsum(new) - 1, np.flatnonzero(new)


def passages(docs: np.ndarray, offsets: np.ndarray, pieces: list[bytes], hot: np.ndarray) -> Passages:
    """The passages of pieces of documents, each WINDOW bytes at least, that begin at these offsets of the documents."""
    blob = b"".join(pieces)
    data = np.frombuffer(blob, np.uint8)
    lengths = np.array([len(p) for p in pieces])
    begin = spans_of(lengths)[0]
    hashes = RunHashes(data)
    low = np.uint64((1 << 22) - 1)
    grams = hashes.all(GRAM) & ~low | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    least = sliding_least(grams, WINDOW - GRAM + 1)
    at = stretches(begin, lengths - WINDOW + 1)
    anchor = (least[at] & low).astype(np.int64)
    out = []
    for level, step in enumerate(STEPS):
        kind = (anchor - at) // step
        new = np.append(True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1]))[: len(at)]
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(at)))
        key = mix(hashes.of(anchor[head] - kind[head] * step, WINDOW + 1 - step) ^ _SALTS[level])
        finer = np.isin(key, hot) if len(hot) and level + 1 < len(STEPS) else np.zeros(len(head), bool)
        first, count = at[head[~finer]], n[~finer]
        digest = [xxhash.xxh3_64_intdigest(blob[s : s + c + WINDOW - 1]) for s, c in zip(first.tolist(), count.tolist(), strict=True)]
        own = np.searchsorted(begin, first, side="right") - 1
        out.append(Passages(key[~finer], np.array(digest, np.uint64), docs[own], first - begin[own] + offsets[own], count, np.zeros(len(first))))
        on = np.repeat(finer, n)
        at, anchor = at[on], anchor[on]
        if not len(at):
            break
    return Passages.concat(out)


def _pieces(batches):
    """(documents, offsets, pieces) of about PIECE bytes, without what is too short for a window."""
    docs, offsets, held, n = [], [], [], 0
    for batch in slices(batches, limit=PIECE):
        for doc, text in zip(ids(batch).tolist(), texts(batch), strict=True):
            for offset in range(0, len(text) - WINDOW + 1, PIECE):
                docs.append(doc)
                offsets.append(offset)
                held.append(text[offset : offset + PIECE + WINDOW - 1])
                n += len(held[-1])
                if n >= PIECE:
                    yield np.array(docs), np.array(offsets), held
                    docs, offsets, held, n = [], [], [], 0
    if held:
        yield np.array(docs), np.array(offsets), held


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return spark_hash(docs) % buckets


def _marks(p: Passages, buckets: int):
    """(bucket, block) of runs of windows to be removed."""
    p = p.take(np.lexsort((p.start, p.doc)))
    head = np.flatnonzero(np.append(True, (p.doc[1:] != p.doc[:-1]) | (p.start[1:] != p.start[:-1] + p.n[:-1]))[: len(p)])
    n = np.add.reduceat(p.n, head) if len(p) else p.n
    bucket = doc_bucket(p.doc[head], buckets)
    order = np.argsort(bucket, kind="stable")
    head, zero = head[order], np.zeros(len(head))
    p = Passages(zero, zero, p.doc[head], p.start[head], n[order], zero)
    for k, rows in ranges(bucket[order]):
        yield k, p.take(rows).pack()


MARK, ASK = 1, 0


def _listed(prefix: int, buckets: int, hot):
    """Rows (range, bucket, block): the passages of a partition by ranges of keys, and marks (bucket set) in passing."""

    def flush(parts):
        p = Passages.concat(parts)
        order, group, starts = p.alike()
        p = p.take(order)
        many = np.diff(np.append(starts, len(p))) > 1
        rows = [(k % (1 << prefix), k, block) for k, block in _marks(p.take(many[group]), buckets)]
        p = p.take(starts)
        p.many = many
        part = (p.key >> np.uint64(64 - prefix)).astype(np.int64) if prefix else np.zeros(len(p), np.int64)
        rows += [(k, None, p.take(at).pack()) for k, at in ranges(part)]
        columns = zip((pa.int64(), pa.int64(), pa.binary()), zip(*rows, strict=True), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for kind, x in columns], names=["range", "bucket", "block"])

    def build(batches):
        keys, held, n = hot(), [], 0
        for piece in _pieces(batches):
            held.append(passages(*piece, keys))
            n += len(held[-1])
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return build


def _met(buckets: int):
    """Rows (bucket, kind, bytes, block): marks, and passages whose bytes are asked for."""

    def run(table: pa.Table) -> pa.Table:
        rows, held = [], []
        for bucket, block in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), strict=True):
            if bucket is None:
                held.append(Passages.unpack(block))
            else:
                rows.append((bucket, MARK, 0, block))
        p = Passages.concat(held)
        order, group, starts = p.alike()
        p = p.take(order)
        size = np.diff(np.append(starts, len(p)))
        many = (size > 1) | (np.add.reduceat(p.many, starts) > 0 if len(p) else np.zeros(0, bool))
        rows += [(k, MARK, 0, block) for k, block in _marks(p.take(many[group]), buckets)]
        p = p.take(starts)
        p.many = many
        new = np.append(True, p.key[1:] != p.key[:-1])[: len(p)]
        of, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        different = np.diff(np.append(heads, len(p))) > 1
        open_ = np.add.reduceat(~many, heads) > 0 if len(p) else np.zeros(0, bool)
        p = p.take((different & open_)[of])
        bucket = doc_bucket(p.doc, buckets)
        order = np.argsort(bucket, kind="stable")
        p = p.take(order)
        for k, at in ranges(bucket[order]):
            some = p.take(at)
            rows.append((k, ASK, int(some.n.sum()) + len(some) * (WINDOW - 1), some.pack()))
        return _table(rows, bucket=pa.int64(), kind=pa.int32(), bytes=pa.int64(), block=pa.binary())

    return run


def _table(rows: list[tuple], **kinds) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})


def _cut(shards: int):
    """Rows (shard, block, bytes): the passages that were asked for, with their bytes."""

    def run(key, docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([], shard=pa.int64(), block=pa.binary(), bytes=pa.binary())
        p = Passages.concat([Passages.unpack(b.as_py()) for b in asked.column("block")])
        p = p.take(np.argsort(p.doc, kind="stable"))
        known, rows = dict(ranges(p.doc)), []
        for batch in slices(docs.combine_chunks().to_batches(), 2):
            found, cut = [], []
            for doc, text in zip(ids(batch, 1).tolist(), texts(batch, 2), strict=True):
                if doc in known:
                    own = p.take(known[doc])
                    found.append(own)
                    cut += [text[s : s + n + WINDOW - 1] for s, n in zip(own.start.tolist(), own.n.tolist(), strict=True)]
            own = Passages.concat(found)
            shard = (mix(own.key) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for k, at in ranges(shard[order]):
                rows.append((k, own.take(order[at]).pack(), zstandard.ZstdCompressor(level=1).compress(b"".join([cut[i] for i in order[at].tolist()]))))
        return _table(rows, shard=pa.int64(), block=pa.binary(), bytes=pa.binary())

    return run


class SuffixArray:
    """Suffixes of passages in order. `end` is where the passage of a byte ends; no suffix reaches beyond."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        n = len(data)
        self.data, self.begin = data, spans_of(lengths)[0]
        self.end = np.repeat(spans_of(lengths)[1], lengths)
        padded = np.append(data, np.zeros(8, np.uint8))
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").reshape(-1)
        left = self.end - np.arange(n)
        # The first order is by seven bytes, each with a bit that tells it from the end of its passage.
        symbol, first = np.append(data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)), np.zeros(n, np.uint64)
        for k in range(7):
            first = first << np.uint64(9) | np.where(left > k, symbol[k : k + n], np.uint64(0))
        order = np.argsort(first, kind="stable")
        self.order, self.rank = order, np.empty(n, np.int64)
        key, tied, sorted_by = first[order], np.arange(n), 7
        while len(tied):
            new = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(tied)))
            self.rank[order[tied]] = np.repeat(tied[start], size)  # a group's rank is its first place
            tied = tied[np.repeat(size > 1, size)]
            at = order[tied]
            further = at + sorted_by
            # Suffixes that end before differ from all others by their place.
            second = np.where(further < self.end[at], self.rank[np.minimum(further, n - 1)] + n, at)
            key = self.rank[at] * (2 * n) + second
            by = np.argsort(key, kind="stable")
            order[tied], key, sorted_by = at[by], key[by], 2 * sorted_by

    def common(self, at: np.ndarray, other: SuffixArray, there: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Common bytes, WINDOW at most, of suffixes here and there that are known to share some."""
        most = np.minimum(np.minimum(self.end[at] - at, other.end[there] - there), WINDOW)
        out = np.minimum(known, most)
        live = np.flatnonzero(out < most)
        while len(live):
            a, b = at[live] + out[live], there[live] + out[live]
            differ = self.words[a] ^ other.words[b]
            low = (differ & (~differ + np.uint64(1))).astype(np.float64)
            same = np.where(differ == 0, 8, (np.frexp(low)[1] - 1) >> 3)
            out[live] = np.minimum(out[live] + same, most[live])
            live = live[(same == 8) & (out[live] < most[live])]
        return out

    def repeated(self, windows: np.ndarray) -> np.ndarray:
        """Whether each byte starts a window that also starts elsewhere here; `windows` of each passage are asked for.

        Kasai's scan: one byte on, a suffix shares at most one byte less with its predecessor. Passages go side by side.
        """
        found = np.zeros(len(self.data), bool)
        by = np.argsort(-windows, kind="stable")
        windows, begin, shared = windows[by], self.begin[by], np.zeros(len(by), np.int64)
        for step in range(int(windows.max(initial=0))):
            k = int(np.searchsorted(-windows, -step))
            at = begin[:k] + step
            place = self.rank[at]
            before = self.order[np.maximum(place - 1, 0)]
            shared = np.where(place > 0, self.common(at, self, before, np.maximum(shared[:k] - 1, 0)), 0)
            hit = shared >= WINDOW
            found[at[hit]] = found[before[hit]] = True
        return found

    def places_of(self, other: SuffixArray, at: np.ndarray) -> np.ndarray:
        """A suffix here that begins with the window at each of these bytes of `other`, or -1, by binary search."""
        low, high = np.full(len(at), -1), np.full(len(at), len(self.order))
        low_shared, high_shared, out = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), -1)
        live = np.arange(len(at))
        while len(live):
            middle = (low[live] + high[live]) // 2
            here, there = self.order[middle], at[live]
            n = self.common(here, other, there, np.minimum(low_shared[live], high_shared[live]))
            same = n >= WINDOW
            out[live[same]] = here[same]
            ended = here + n >= self.end[here]
            less = ended | (self.data[np.minimum(here + n, len(self.data) - 1)] < other.data[np.minimum(there + n, len(other.data) - 1)])
            low[live], low_shared[live] = np.where(less, middle, low[live]), np.where(less, n, low_shared[live])
            high[live], high_shared[live] = np.where(less, high[live], middle), np.where(less, high_shared[live], n)
            live = live[~same & (high[live] - low[live] > 1)]
        return out


def repeated_windows(p: Passages, cut: list[bytes]) -> Passages:
    """Runs of windows of these passages that also start elsewhere among them, but for passages known to repeat."""
    order = np.argsort(p.key, kind="stable")
    p, cut = p.take(order), [cut[i] for i in order.tolist()]
    n = p.n.astype(np.int64)
    lengths = n + WINDOW - 1
    before: list[tuple[SuffixArray, np.ndarray]] = []  # the arrays that hold passages of the key before, and their marks
    marks, last = [], None
    for _, own in ranges(np.cumsum(lengths) // BLOCK):
        keys = p.key[own]
        array = SuffixArray(np.frombuffer(b"".join(cut[own]), np.uint8), lengths[own])
        found = array.repeated(n[own])
        if keys[0] == last:
            shared = np.flatnonzero(keys == last)
            at = stretches(array.begin[shared], n[own][shared])
            for earlier, marked in before:
                there = earlier.places_of(array, at)
                found[at[there >= 0]] = True
                marked[there[there >= 0]] = True
        if keys[0] != last or keys[-1] != last:
            before = []
        before.append((array, found))
        marks.append((own, array.begin, found))
        last = keys[-1]
    out = []
    for own, begin, found in marks:
        some = np.flatnonzero(~p.many[own])
        at, of = stretches(begin[some], n[own][some]), np.repeat(some, n[own][some])
        hit = found[at]
        at, of = at[hit], of[hit]
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))[: len(at)])
        run, by = np.diff(np.append(head, len(at))), own.start + of[head]
        zero = np.zeros(len(head))
        out.append(Passages(zero, zero, p.doc[by], p.start[by] + at[head] - begin[of[head]], run, zero))
    return Passages.concat(out)


def _searched(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        held, cut = [], []
        for block, packed in zip(table.column("block").to_pylist(), table.column("bytes").to_pylist(), strict=True):
            p, raw = Passages.unpack(block), zstandard.ZstdDecompressor().decompress(packed)
            begin, end = spans_of(p.n.astype(np.int64) + WINDOW - 1)
            held.append(p)
            cut += [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        found = repeated_windows(Passages.concat(held), cut)
        return _table(list(_marks(found, buckets)), bucket=pa.int64(), block=pa.binary())

    return run


def _removed(key, docs: pa.Table, marks: pa.Table) -> pa.Table:
    p = Passages.concat([Passages.unpack(b.as_py()) for b in marks.column("block")])
    p = p.take(np.argsort(p.doc, kind="stable"))
    known, rows = dict(ranges(p.doc)), []
    for batch in slices(docs.combine_chunks().to_batches(), 2):
        for doc, text in zip(ids(batch, 1).tolist(), texts(batch, 2), strict=True):
            spans = 0
            kept = text
            if doc in known:
                own = p.take(known[doc])
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, own.start, 1)
                np.add.at(cover, own.start + own.n.astype(np.int64) + WINDOW - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(text), len(text) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
    out = _table(rows, n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept=pa.binary(), kept_sha256=pa.string())
    return out.add_column(0, "id", docs.column("id"))


def shared_keys(base: DataFrame, total: int) -> np.ndarray:
    """Keys that, by a sample of the texts, hold so many different passages that they are dealt in finer classes."""
    expected = total / 100
    limit = max(100, min(20_000, expected / (20 * partitions(base.sparkSession))), expected / 2_000_000)
    share_of_all = min(1.0, max(SAMPLE_BYTES / max(1, total), SAMPLE_SHARE))
    sample = base.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < F.lit(int(share_of_all * 1_000_000) + 1)).select("row", "text")
    hot = np.zeros(0, np.uint64)
    for _ in STEPS[1:]:
        known = share(base.sparkSession, hot)

        def listed(batches, known=known):
            keys = known()
            for piece in _pieces(batches):
                p = passages(*piece, keys)
                pair = np.unique(np.column_stack([p.key, p.digest]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], names=["key", "digest"])

        pairs = sample.mapInArrow(listed, "key long, digest long").distinct()
        many = pairs.groupBy("key").count().where(F.col("count") > max(20, limit * share_of_all)).select("key").collect()
        if not many:
            break
        hot = np.union1d(hot, np.array([r.key for r in many], np.int64).view(np.uint64))
    return hot


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) per row of `docs`; `kept` are the bytes that stay.

    A byte goes if a string of WINDOW bytes that covers it also starts anywhere else, in its own text too; strings are
    judged on the input and never cross texts. Null and empty texts have no bytes. Every row is a text of its own, whether
    or not its id repeats or is null, so that repeated rows remove each other. Texts of any length are read whole, in
    pieces. An empty table gives no rows. Other columns of any name are ignored. Equal passages are told by two 64-bit
    hashes of their bytes, all others byte by byte.
    """
    spark = docs.sparkSession
    base = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", "row")
    state = base.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rows, total = state[0], state[1] or 0
    expected = total / 100
    prefix = max(0, int(np.ceil(np.log2(max(1, expected / 200_000, min(4 * partitions(spark), expected / 2_500))))))
    buckets = max(1, int(total / 1_000_000), min(4 * partitions(spark), rows // 50))
    hot = share(spark, shared_keys(base, total))
    listed = base.select("row", "text").mapInArrow(_listed(prefix, buckets, hot), "range long, bucket long, block binary")
    met = cut_lineage(listed.groupBy("range").applyInArrow(_met(buckets), "bucket long, kind int, bytes long, block binary"))
    asked = met.where(F.col("kind") == ASK)
    size = asked.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, int(size / 500_000), min(4 * partitions(spark), int(size / 50_000)))
    placed = base.select(F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"), "row", "text", "id")
    cut = placed.groupBy("bucket").cogroup(asked.select("bucket", "block").groupBy("bucket")).applyInArrow(_cut(shards), "shard long, block binary, bytes binary")
    found = cut.groupBy("shard").applyInArrow(_searched(buckets), "bucket long, block binary")
    marks = met.where(F.col("kind") == MARK).select("bucket", "block").unionByName(found)
    out = placed.groupBy("bucket").cogroup(marks.groupBy("bucket"))
    kind = base.schema["id"].dataType.simpleString()
    out = out.applyInArrow(_removed, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
