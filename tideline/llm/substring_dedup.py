"""Substring dedup: a compressed FM-index per shard, backward search over wavelet matrices, intervals above a threshold.

A window is WINDOW consecutive words. Its anchor is the least hash of the runs of ANCHOR words within it, so equal
windows have equal anchors wherever they stand. Consecutive windows with one anchor form a passage (at most PASSAGE
windows long). A place is a document - its id, and a digest of its text where ids repeat or are absent - and a start.

1. Each partition lists its passages as (anchor, digest, place, windows). Where passages of the partition are equal,
   their words go once into an index of the partition; what it confirms of all but the earliest is marked, and only
   the earliest goes on, so that a hot passage leaves a partition once.
2. Lists meet by anchor. An anchor that occurs once ends there: its windows are unique. Equal passages again shrink to
   the earliest one, and the others' places follow it to its shard.
3. Passages that repeat, share an anchor with others or may repeat within themselves send their words, once for each
   distinct passage, to the shard of the anchor. The shard's FM-index over them keeps the Burrows-Wheeler transform in
   a wavelet matrix of packed bits with popcount ranks, and the earliest suffix of each interval that repeats; neither
   text nor suffix order stay. Every passage is streamed through it by backward search from its last word, which keeps
   the interval of the longest match of up to WINDOW words. Where that matching statistic reaches WINDOW the interval
   holds all occurrences; the earliest of them decides for each place of the passage.
4. Windows that start earlier elsewhere go back to their documents, whose covered words are removed.

Anchors that very many passages share (a common line within different texts) are found on a sample beforehand; their
windows travel one by one under their own hash instead, which spreads them over all shards.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WordHashes, cut_lineage, ids, mix, partitions, ranges, slices, spark_hash, spans_of, texts

WINDOW = 20
ANCHOR = 6
#: Windows of a passage at most. Its first and last window then cover all its words.
PASSAGE = 16
#: Sample of texts (in bytes) in which shared anchors are looked for; it steers the routing and no result.
SAMPLE_BYTES = 24_000_000
#: An anchor is spread if the sample promises it this share of all passages.
HOT_SHARE = 1 / 20_000
#: Passages, and words of repeated ones, that a partition holds before it writes its lists.
FLUSH, FLUSH_WORDS = 2_000_000, 8_000_000
#: Groups of anchors per range of them; shards are unions of groups.
SUBS = 8

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _joined(left: np.ndarray, right: np.ndarray, shift: int, level: int) -> np.ndarray:
    """Hashes of stretches made of one stretch and another that begins `shift` further on."""
    n = max(0, len(right) - shift)
    return left[:n] * _MULTIPLIERS[level] + right[shift : shift + n]


def window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, hash) of the window that starts at each place of a sequence of word hashes."""
    two = _joined(words, words, 1, 0)
    four = _joined(two, two, 2, 1)
    run = mix(_joined(four, two, 4, 2))
    eight = _joined(four, four, 4, 2)
    sixteen = _joined(eight, eight, 8, 3)
    whole = mix(_joined(sixteen, four, 16, 4))
    low = run
    for step in (1, 2, 4):  # least of 2, 4, 8 runs, then of 15
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
    span = WINDOW - ANCHOR + 1
    low = np.minimum(low[: len(low) - (span - 8)], low[span - 8 :]) if len(low) > span - 8 else low[:0]
    return low[: len(whole)], whole


class Passages:
    """Columns of passages: key, place (document, twin, whether it lacks an id, start), windows, and `again` for those that
    may hold a window twice. `twin` tells apart the texts of one id, and of none."""

    FIELDS = (("anchor", np.uint64), ("digest", np.uint64), ("doc", np.int64), ("twin", np.uint64), ("none", np.uint8), ("start", np.uint32), ("n", np.uint8), ("again", np.uint8))

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

    @classmethod
    def marks(cls, doc, twin, none, start, n) -> Passages:
        """Runs of windows without a key."""
        zero = np.zeros(len(doc))
        return cls(zero, zero, doc, twin, none, start, n, zero)

    def pack(self) -> bytes:
        raw = b"".join(getattr(self, name).tobytes() for name, _ in self.FIELDS)
        return struct.pack("<Q", len(self)) + zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpack(cls, block: bytes) -> Passages:
        (n,) = struct.unpack_from("<Q", block)
        raw, at, columns = zstandard.ZstdDecompressor().decompress(block[8:]), 0, []
        for _, kind in cls.FIELDS:
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*columns)

    @classmethod
    def unpacked(cls, blocks) -> Passages:
        return cls.concat([cls.unpack(b) for b in blocks])

    def by_place(self, *first) -> np.ndarray:
        """An order by these keys, then by place; rows without an id come last."""
        keys = [self.start, *([self.twin] if self.twin.any() else []), self.doc, *([self.none] if self.none.any() else [])]
        return np.lexsort((*keys, *reversed(first)))

    def elsewhere(self, other: Passages) -> np.ndarray:
        """Whether the document or the start differ, row by row."""
        return (self.doc != other.doc) | (self.start != other.start) | (self.twin != other.twin) | (self.none != other.none)

    def earliest(self) -> tuple[Passages, Passages]:
        """(the earliest of each equal set, sorted by anchor and digest; the rest that starts later)."""
        p = self.take(self.by_place(self.anchor, self.digest))
        new = np.append(True, (p.anchor[1:] != p.anchor[:-1]) | (p.digest[1:] != p.digest[:-1]))[: len(p)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(p) else np.zeros(0, np.int64)
        return p.take(new), p.take(p.elsewhere(p.take(first)))

    def documents(self) -> dict[tuple[int, int, int], tuple[int, int]]:
        """(lacks an id, id, twin) -> (first row, end) of passages in order of their places."""
        new = np.append(True, (self.doc[1:] != self.doc[:-1]) | (self.twin[1:] != self.twin[:-1]) | (self.none[1:] != self.none[:-1]))[: len(self)]
        low = np.flatnonzero(new)
        keys = zip(self.none[low].tolist(), self.doc[low].tolist(), self.twin[low].tolist(), strict=True)
        return dict(zip(keys, zip(low.tolist(), [*low[1:].tolist(), len(self)][: len(low)], strict=True), strict=True))


class Documents:
    """Who the rows of a batch with columns (id, text, twin) are."""

    def __init__(self, batch: pa.RecordBatch, at: int = 0):
        self.none = batch.column(at).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        self.doc, self.twin = ids(batch, at), ids(batch, at + 2).view(np.uint64)

    def keys(self) -> list[tuple[int, int, int]]:
        return list(zip(self.none.tolist(), self.doc.tolist(), self.twin.tolist(), strict=True))


def passages(who: Documents, docs: list[bytes], hashes: WordHashes, hot: np.ndarray) -> tuple[Passages, np.ndarray, np.ndarray]:
    """(passages, the place of each in the words of all docs, these words as hashes)."""
    split = [x.split() for x in docs]
    counts = np.array([len(x) for x in split], np.int64)
    words = hashes.of([w for x in split for w in x])
    anchor, whole = window_hashes(words)
    doc = np.repeat(np.arange(len(docs)), counts)[: len(anchor)]
    begin, end = spans_of(counts)
    at = np.arange(len(anchor))
    valid = at + WINDOW <= end[doc]
    again = np.zeros(len(whole), bool)
    for d in range(1, min(PASSAGE, len(whole))):
        again[: len(whole) - d] |= whole[: len(whole) - d] == whole[d:]
    single = np.isin(anchor, hot) if len(hot) else np.zeros(len(anchor), bool)
    turn = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | ~valid[:-1])[: len(anchor)]
    since = at - np.maximum.accumulate(np.where(turn, at, 0)) if len(at) else at
    start = np.flatnonzero(valid & (turn | (since % PASSAGE == 0) | single))
    if not len(start):
        return Passages.concat([]), start, words
    number = np.cumsum(np.bincount(start, minlength=len(at))) - 1
    n = np.bincount(number[valid], minlength=len(start))
    digest = mix(mix(whole[start] + n.astype(np.uint64)) + whole[start + n - 1])
    key = np.where(single[start], mix(whole[start] ^ np.uint64(0x5BD1E995)), anchor[start])
    flag = np.maximum.reduceat(again[valid], np.searchsorted(np.flatnonzero(valid), start)) & ~single[start]
    own = doc[start]
    return Passages(key, digest, who.doc[own], who.twin[own], who.none[own], start - begin[own], n, flag), start, words


def stretches(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for length[0] numbers, then the same for the others."""
    return np.repeat(begin.astype(np.int64) - spans_of(length)[0], length) + np.arange(int(length.sum()))


class Seen:
    """The words of passages whose digest may have come before; a filter of bits lets few others through."""

    BITS = 27

    def __init__(self):
        self.bits, self.digest, self.length, self.words, self.size = np.zeros(1 << (self.BITS - 3), np.uint8), [], [], [], 0

    def add(self, p: Passages, at: np.ndarray, words: np.ndarray) -> None:
        place = (p.digest >> np.uint64(64 - self.BITS)).astype(np.int64)
        byte, bit = place >> 3, np.left_shift(1, place & 7).astype(np.uint8)
        again = (self.bits[byte] & bit) != 0
        np.bitwise_or.at(self.bits, byte, bit)
        inside = np.ones(len(p), bool)
        inside[np.unique(p.digest, return_index=True)[1]] = False
        again = np.flatnonzero(again | inside)
        length = p.n[again].astype(np.int64) + WINDOW - 1
        self.digest.append(p.digest[again])
        self.length.append(length)
        self.words.append(words[stretches(at[again], length)])
        self.size += int(length.sum())

    def words_of(self, p: Passages) -> np.ndarray:
        """The words of passages that came twice, one after another."""
        digest, length, words = (np.concatenate(x) for x in (self.digest, self.length, self.words))
        known, first = np.unique(digest, return_index=True)
        at = first[np.searchsorted(known, p.digest)]
        return words[stretches(spans_of(length)[0][at], length[at])]


def _listed(prefix: int, hot: np.ndarray):
    """Rows (range, kind, block): passages by range of anchors (kind 0), and marked windows anywhere (kind 1)."""

    def write(held: list[Passages], seen: Seen):
        first, later = Passages.concat(held).earliest()
        rows = [(k, 0, first.take(at).pack()) for k, at in ranges(range_of(first.anchor, prefix))]
        if len(later):
            copied = first.take(np.isin(first.digest, later.digest))
            later = repeated_windows(copied, seen.words_of(copied), later)
        for at in range(0, len(later), 8_192):  # marks only pass through, so they go anywhere
            part = later.take(slice(at, at + 8_192))
            where = mix(part.doc[:1].view(np.uint64) + part.start[-1:]) >> np.uint64(32)
            rows.append((int(where[0]) % (1 << prefix), 1, part.pack()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
            names=["range", "kind", "block"],
        )

    def run(batches):
        hashes, held, seen, size = WordHashes(), [], Seen(), 0
        for batch in slices(batches):
            found, at, words = passages(Documents(batch), texts(batch), hashes, hot)
            if len(found):
                held.append(found)
                seen.add(found, at, words)
                size += len(found)
            if size > FLUSH or seen.size > FLUSH_WORDS:
                yield write(held, seen)
                held, seen, size = [], Seen(), 0
        if held:
            yield write(held, seen)

    return run


def range_of(anchor: np.ndarray, prefix: int) -> np.ndarray:
    return (anchor >> np.uint64(64 - prefix)).astype(np.int64) if prefix else np.zeros(len(anchor), np.int64)


def group_of(anchor: np.ndarray, prefix: int) -> np.ndarray:
    """The group of anchors, SUBS in a range; a shard is what has one group number modulo the number of shards."""
    return range_of(anchor, prefix) * SUBS + (mix(anchor) % np.uint64(SUBS)).astype(np.int64)


def doc_bucket(p: Passages, buckets: int) -> np.ndarray:
    """As F.pmod(F.xxhash64("id", "twin"), buckets), which skips a null id."""
    seed = np.where(p.none > 0, np.int64(42), spark_hash(p.doc))
    return np.mod(spark_hash(p.twin.view(np.int64), seed), buckets)


def _grouped(p: Passages, where: np.ndarray, kind: int):
    """Rows (where, kind, words, block) by a number per passage."""
    order = np.argsort(where, kind="stable")
    p, where = p.take(order), where[order]
    for k, at in ranges(where):
        part = p.take(at)
        yield k, kind, int((part.n.astype(np.int64) + WINDOW - 1).sum()), part.pack()


def _met(buckets: int, prefix: int):
    """Rows (bucket, kind, words, block): passages that a shard must search (kind 0) and marked windows (kind 1), both by
    document, and the later places of passages of kind 0, by group of anchors (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blocks = table.column("kind").to_pylist(), table.column("block").to_pylist()
        first, later = Passages.unpacked(b for b, k in zip(blocks, kinds, strict=True) if k == 0).earliest()
        same = first.anchor[1:] == first.anchor[:-1]
        several = np.append(False, same)[: len(first)] | np.append(same, False)[: len(first)]
        search = first.take(several | (first.again > 0) | np.isin(first.digest, later.digest))
        marked = Passages.unpacked(b for b, k in zip(blocks, kinds, strict=True) if k == 1)
        rows = [*_grouped(search, doc_bucket(search, buckets), 0), *_grouped(marked, doc_bucket(marked, buckets), 1), *_grouped(later, group_of(later.anchor, prefix), 2)]
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()),
            "words": pa.array([r[2] for r in rows], pa.int64()), "block": pa.array([r[3] for r in rows], pa.binary()),
        })

    return run


def _numbered(flat: np.ndarray) -> bytes:
    """Word hashes as a list of distinct ones and places in it, compressed."""
    values, place = np.unique(flat, return_inverse=True)
    raw = struct.pack("<QQ", len(values), len(flat)) + values.tobytes() + place.astype(np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _hashes_of(block: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(block)
    v, n = struct.unpack_from("<QQ", raw)
    return np.frombuffer(raw, np.uint64, v, 16)[np.frombuffer(raw, np.uint32, n, 16 + 8 * v)]


def _cut(shards: int, prefix: int):
    """Joins a bucket's documents with its passages: rows (shard, passages, words)."""

    hashes = WordHashes()  # for all buckets of a task

    def run(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        out = ([], [], [])
        p = Passages.unpacked(b.as_py() for b in wanted.column("block"))
        p = p.take(p.by_place())
        left = p.documents()  # a repeated row's words are needed once
        held: list[tuple[Passages, np.ndarray]] = []
        if left:
            for batch in slices(docs.combine_chunks().to_batches(), 2):
                column = batch.column(2).cast(pa.binary())
                for r, own in enumerate(Documents(batch, 1).keys()):
                    low, high = left.pop(own, (0, 0))
                    if low == high:
                        continue
                    part = p.take(slice(low, high))
                    words = hashes.of((column[r].as_py() or b"").split())
                    held.append((part, words[np.minimum(stretches(part.start, part.n.astype(np.int64) + WINDOW - 1), len(words) - 1)]))
        if held:
            part = Passages.concat([h[0] for h in held])
            flat = np.concatenate([h[1] for h in held])
            begin, _ = spans_of(part.n.astype(np.int64) + WINDOW - 1)
            shard = group_of(part.anchor, prefix) % shards
            order = np.argsort(shard, kind="stable")
            for k, run_at in ranges(shard[order]):
                rows = order[run_at]
                out[0].append(k)
                out[1].append(part.take(rows).pack())
                out[2].append(_numbered(flat[stretches(begin[rows], part.n[rows].astype(np.int64) + WINDOW - 1)]))
        return pa.table({"shard": pa.array(out[0], pa.int64()), "block": pa.array(out[1], pa.binary()), "words": pa.array(out[2], pa.binary())})

    return run


class WaveletMatrix:
    """A sequence of numbers as one packed bit vector per bit of its alphabet, with ranks by popcount."""

    def __init__(self, values: np.ndarray, alphabet: int):
        self.n, self.levels = len(values), max(1, int(alphabet - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            one = (values >> level) & 1
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            raw = np.packbits(one.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])).astype(np.int32))
            self.zeros.append(int(self.n - one.sum()))
            values = np.concatenate((values[one == 0], values[one == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """Occurrences of `symbol` before `at`; origin: where the symbol's own stretch begins after all levels."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1
            block = at >> 6
            ones = self.before[k][block] + np.bitwise_count(self.bits[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at - origin


class FmIndex:
    """Compressed index over distinct passages of words, ordered by WINDOW words.

    It keeps the wavelet matrix of the Burrows-Wheeler transform, the number of smaller words below each word, and of
    each interval of suffixes that share WINDOW words - if it holds two or more - its ends and its earliest suffix.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        """words: numbers from 1; passages follow each other, in order of their places in the corpus."""
        begin, end = spans_of(lengths + 1)
        text = np.zeros(int(end[-1]), np.int64)  # a 0 ends each passage
        text[stretches(begin, lengths)] = words
        n = len(text)

        def paired(rank: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
            """(order, ranks) of stretches of doubled length, by sorting pairs of ranks."""
            key = rank * (int(rank.max()) + 2)
            key[: n - shift] += rank[shift:] + 1
            order = np.argsort(key, kind="stable")
            ranked = np.empty(n, np.int64)
            key = key[order]
            ranked[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
            return order, ranked

        rank, reach = text, 1
        while 2 * reach <= WINDOW:
            (_, rank), reach = paired(rank, reach), 2 * reach
        order, rank = paired(rank, WINDOW - reach)
        group = rank[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        end = np.append(start[1:], n)
        many = end - start > 1
        self.n, self.start, self.end = n, start[many].astype(np.int32), end[many].astype(np.int32)
        self.earliest = order[self.start].astype(np.int32)  # equal stretches keep the order of the text
        alphabet = int(text.max()) + 1
        self.wavelet = WaveletMatrix(text[order - 1], alphabet)
        counts = np.bincount(text, minlength=alphabet)
        self.below = np.cumsum(counts) - counts
        self.origin = self.wavelet.rank(np.arange(alphabet), np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64))

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences of the window that starts at each word, the text's first one, or -1 if it is the only one).

        Passages are searched side by side, each from its last word backwards. The interval [low, high) holds the
        suffixes that begin with the match, whose length is the matching statistic, at most WINDOW. A match that grows
        beyond WINDOW loses its last word: its interval widens to all suffixes with these WINDOW words. Words up to
        WINDOW - 1 before a passage's end start no window and get 0.
        """
        count, first = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        begin = spans_of(lengths)[0]
        live = np.argsort(-lengths, kind="stable")
        lengths = lengths[live]
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            k = int(np.searchsorted(-lengths, -step, side="right"))  # passages of this many words or more
            live, lengths, low, high = live[:k], lengths[:k], low[:k], high[:k]
            at = begin[live] + lengths - step
            symbol = words[at]
            origin, below = self.origin[symbol], self.below[symbol]
            low = below + self.wavelet.rank(symbol, low, origin)
            high = below + self.wavelet.rank(symbol, high, origin)
            if step >= WINDOW and len(self.start):
                i = np.maximum(np.searchsorted(self.start, low, side="right") - 1, 0)
                inside = (high > low) & (self.start[i] <= low) & (low < self.end[i])
                low, high = np.where(inside, self.start[i], low), np.where(inside, self.end[i], high)
                first[at[inside]] = self.earliest[i[inside]]
            if step >= WINDOW:
                count[at] = high - low
        return count, first


def repeated_windows(p: Passages, flat: np.ndarray, more: Passages) -> Passages:
    """Runs of windows of distinct passages `p`, whose words are `flat`, that start earlier elsewhere among these; `more`
    are later places of some of them, known by their digest, and share what the index finds."""
    length = p.n.astype(np.int64) + WINDOW - 1
    begin = spans_of(length)[0]
    order = p.by_place()
    p, length, begin = p.take(order), length[order], begin[order]
    words = np.unique(flat[stretches(begin, length)], return_inverse=True)[1].astype(np.int64) + 1
    count, first = FmIndex(words, length).search(words, length)
    begin, text = spans_of(length)[0], spans_of(length + 1)[0]
    sorted_digest = np.argsort(p.digest, kind="stable")
    places, of = [p], [np.arange(len(p))]
    for at in range(0, len(more), 100_000):
        part = more.take(slice(at, at + 100_000))
        places.append(part)
        of.append(sorted_digest[np.searchsorted(p.digest[sorted_digest], part.digest)])
    return Passages.concat([_marked(a, b, p, begin, text, count, first) for a, b in zip(places, of, strict=True)])


def _marked(own: Passages, of: np.ndarray, p: Passages, begin, text, count, first) -> Passages:
    """Runs of windows of the passages `own`, equal to those numbered `of`, that occur earlier."""
    n = p.n[of].astype(np.int64)
    window = stretches(begin[of], n)
    which = np.repeat(np.arange(len(own)), n)
    k = window - begin[of][which]
    place = np.where(first[window] >= 0, first[window], text[of][which] + k)
    there = np.searchsorted(text, place, side="right") - 1
    start = p.start[there].astype(np.int64) + place - text[there]
    here = own.start[which].astype(np.int64) + k
    other = (p.doc[there] != own.doc[which]) | (p.twin[there] != own.twin[which]) | (p.none[there] != own.none[which]) | (start != here)
    at = np.flatnonzero((count[window] > 0) & other)
    if not len(at):
        return Passages.concat([])
    new = np.append(True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]]))
    head = at[new]
    run, by = np.diff(np.append(np.flatnonzero(new), len(at))), which[head]
    return Passages.marks(own.doc[by], own.twin[by], own.none[by], here[head], run)


def _searched(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        blocks, words = table.column("block").to_pylist(), table.column("words").to_pylist()
        p = Passages.unpacked(b for b, w in zip(blocks, words, strict=True) if w is not None)
        more = Passages.unpacked(b for b, w in zip(blocks, words, strict=True) if w is None)
        found = repeated_windows(p, np.concatenate([_hashes_of(w) for w in words if w is not None]), more) if len(p) else p
        rows = list(_grouped(found, doc_bucket(found, buckets), 1))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[3] for r in rows], pa.binary())})

    return run


def _removed(key, docs: pa.Table, marks: pa.Table) -> pa.Table:
    p = Passages.unpacked(b.as_py() for b in marks.column("block"))
    p = p.take(p.by_place())
    known = p.documents()
    n_words, n_removed, digest, kept_text = [], [], [], []
    for batch in slices(docs.combine_chunks().to_batches(), 2):
        for text, own in zip(texts(batch, 2), Documents(batch, 1).keys(), strict=True):
            words = text.split()
            n = len(words)
            a, b = known.get(own, (0, 0))
            if b > a:
                cover = np.zeros(n + 1, np.int64)
                start = np.minimum(p.start[a:b].astype(np.int64), n)
                np.add.at(cover, start, 1)
                np.add.at(cover, np.minimum(start + p.n[a:b] + WINDOW - 1, n), -1)
                keep = (np.cumsum(cover[:-1]) == 0).tolist()
                words = [w for w, k in zip(words, keep, strict=True) if k]
            kept = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
    return pa.table({
        "id": docs.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "kept_text": pa.array(kept_text, pa.string()), "kept_sha256": pa.array(digest, pa.string()),
    })


def shared_anchors(base: DataFrame, total: int) -> np.ndarray:
    """Anchors that, by a sample of documents, hold over HOT_SHARE of all passages."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    sample = base.where(F.pmod(F.xxhash64("id", "twin"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))

    def listed(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            p = passages(Documents(batch), texts(batch), hashes, np.zeros(0, np.uint64))[0].earliest()[0]
            anchor, n = np.unique(p.anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    counts = cut_lineage(sample.mapInArrow(listed, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    passages_in_sample = total * share / 40
    least = max(20, passages_in_sample * HOT_SHARE)
    return np.array([r.anchor for r in counts.where(F.col("n") > least).collect()], np.int64).view(np.uint64)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text, kept_sha256) per row of `docs`.

    A word goes if a window that covers it also starts earlier: in a document with a smaller id, or earlier in its
    own. Windows are judged on the input. Null and empty texts have no words. Rows without an id come after all others.
    Texts that share an id, or have none, are documents of their own, of which the one with the smaller digest comes
    first; rows with one id (or none) and one text are one document, given twice, and don't precede each other. Texts of
    any length are read whole, SLICE_BYTES of short ones at a time. An empty table gives no rows. Other columns of any
    name are ignored. Words are compared by 64-bit hashes, windows thus by 20 of them.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    by_id = base.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    state = by_id.agg(F.sum("n"), F.sum("b"), F.max((F.col("n") > 1) | F.col("id").isNull())).first()
    rows, total = state[0] or 0, state[1] or 0
    # Where every id is there once, it says all; else a digest of the text tells apart what an id doesn't.
    base = base.withColumn("twin", F.xxhash64("text") if state[2] else F.lit(0).cast("long"))
    passage_count = total / 40
    prefix = max(0, int(np.ceil(np.log2(max(1, passage_count / 200_000, min(4 * partitions(spark), passage_count / 2_500))))))
    buckets = max(1, int(total / 1_000_000), min(4 * partitions(spark), rows // 50))
    hot = shared_anchors(base, total)
    listed = base.mapInArrow(_listed(prefix, hot), "range long, kind int, block binary")
    met = cut_lineage(listed.groupBy("range").applyInArrow(_met(buckets, prefix), "bucket long, kind int, words long, block binary"))
    words = met.where("kind <> 1").agg(F.sum("words")).first()[0] or 0
    shards = min(SUBS << prefix, max(1, int(words / 600_000), min(partitions(spark), int(words / 20_000))))
    # Texts too short for a window have no marks to meet; those of one digest spread by partition.
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * WINDOW - 1
    bucket = F.when(short, F.xxhash64("id", "twin", F.spark_partition_id())).otherwise(F.xxhash64("id", "twin"))
    placed = base.select(F.pmod(bucket, F.lit(buckets)).alias("bucket"), "id", "text", "twin")
    search = met.where("kind = 0").select("bucket", "block")
    cut = placed.groupBy("bucket").cogroup(search.groupBy("bucket")).applyInArrow(_cut(shards, prefix), "shard long, block binary, words binary")
    copies = met.where("kind = 2").select(F.pmod("bucket", F.lit(shards)).alias("shard"), "block", F.lit(None).cast("binary").alias("words"))
    found = cut.unionByName(copies).groupBy("shard").applyInArrow(_searched(buckets), "bucket long, block binary")
    marks = met.where("kind = 1").select("bucket", "block").unionByName(found)
    out = placed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_removed, "id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
