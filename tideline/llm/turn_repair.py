"""Conversation structure repair: cheapest edits by Four-Russians block tables.

A conversation's roles must read (s?(ua)+)? by their initials. Four states follow that pattern: 0 nothing yet, 1 after the
system turn, 2 after a user turn, 3 after an assistant turn; the role that may come next is the same for all ways to
reach a state. What the rest of a conversation costs from each state is a vector of four numbers. Less its minimum it
takes few values, so that a table tells, for every such vector and every block of BLOCK row symbols, the vector before
the block and what it adds. The tables are made once, by composing the steps of single symbols.

Rows meet by conversation, in order, and are read as a stream: faults and symbols are noted, and blocks are looked up from
the last to the first. Then each block is expanded backward into the vectors between its rows, and edits are read off
forward, at each place the least initial of those that keep the cost. Conversations of up to HOLD bytes are finished at
once. Of longer ones only a byte per row is held: their rows come a second time, after their edits, and are written
along as they pass. Earlier rows of the same role and text are found by aggregation, not by a set held per conversation.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Row symbols: 0 must go; 1 to 4 are sound rows of a role with initial s, u, a or another; 5 to 8 are truncated ones.
SYMBOLS, BLOCK = 9, 4
#: Bytes of role and text that are held per conversation.
HOLD = 4_000_000
BLANK_CHARS = " \t\n\v\f\r"
#: The role that is due in a state and the state after it.
DUE = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
NEXT = [after for _, after in DUE]
#: State after keeping a row, by state and initial (s, u, a, another); -1: not allowed.
KEPT = [[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]]
NEVER = 1 << 20


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return costs


def _before(costs: list[int], symbol: int) -> list[int]:
    """What the rest costs from each state before a row, given that after it; turns may be inserted before the row."""
    out = []
    for q in range(4):
        ways = [DELETE + costs[q]]
        if symbol:
            extra = TRUNCATED * (symbol > 4)
            kept = KEPT[q][(symbol - 1) % 4]
            ways += [REROLE + extra + costs[NEXT[q]]] + ([KEEP + extra + costs[kept]] if kept >= 0 else [])
        out.append(min(ways))
    return _with_inserts(out)


class BlockTables:
    """Normalised cost vectors, and where a symbol or a block of symbols leads from each of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = _with_inserts([0, NEVER, NEVER, 0])
        self.vectors, known, step = [tuple(end)], {tuple(end): 0}, []
        for vector in self.vectors:  # grows until no new vector appears
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(list(vector), symbol)
                key = tuple(c - min(costs) for c in costs)
                if key not in known:
                    known[key] = len(self.vectors)
                    self.vectors.append(key)
                row.append((known[key], min(costs)))
            step.append(row)
        self.step = np.array(step, np.int64)  # vector, symbol -> (vector before, added)
        to, add = self.step[:, :, 0], self.step[:, :, 1]
        self.to, self.add = to, add
        for _ in range(block - 1):  # one more symbol in front: the rest first, then it
            self.add = (self.add[:, None, :] + add[self.to].transpose(0, 2, 1)).reshape(len(to), -1)
            self.to = to[self.to].transpose(0, 2, 1).reshape(len(to), -1)
        self.edits = [[[self._edits(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in range(len(to))]

    def _edits(self, vector: int, symbol: int, state: int) -> tuple[str, int]:
        """The least cheapest edits from a state up to and with a row, and the state then; `vector` is that after the row."""
        after = self.vectors[vector]
        before = _before(list(after), symbol)
        done = ""
        while True:
            extra = TRUNCATED * (symbol > 4)
            cost = before[state]
            if DELETE + after[state] == cost:
                return done + "D", state
            if INSERT + before[NEXT[state]] == cost:
                done, state = done + "I", NEXT[state]
                continue
            kept = KEPT[state][(symbol - 1) % 4] if symbol else -1
            if kept >= 0 and KEEP + extra + after[kept] == cost:
                return done + "K", kept
            return done + "R", NEXT[state]

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """(cost, edits) of a conversation's row symbols."""
        n, b = len(symbols), self.block
        head = n % b
        power = SYMBOLS ** np.arange(b - 1, -1, -1)
        blocks = (symbols[head:].astype(np.int64).reshape(-1, b) @ power).tolist()
        after, vector, cost = [0] * len(blocks), 0, 0
        for i in range(len(blocks) - 1, -1, -1):
            after[i] = vector
            cost += int(self.add[vector, blocks[i]])
            vector = int(self.to[vector, blocks[i]])
        pieces = [(symbols[head + i * b : head + i * b + b], v) for i, v in enumerate(after)]
        pieces = [(symbols[:head], vector), *pieces]
        out, state = [], 0
        for i, (piece, vector) in enumerate(pieces):
            piece, between = piece.tolist(), []
            for symbol in reversed(piece):
                between.append(vector)
                vector, add = self.step[vector, symbol].tolist()
                if i == 0:
                    cost += add
            if i == 0:
                cost += self.vectors[vector][0]
            for symbol, v in zip(piece, reversed(between), strict=True):
                done, state = self.edits[v][symbol][state]
                out.append(done)
        return cost, "".join(out) + "I" * {0: 0, 3: 0, 2: 1, 1: 2}[state]


@functools.cache
def tables() -> BlockTables:
    return BlockTables()


def fault_of(text: str) -> str:
    """blank, truncated or nothing; duplicates are told by the rows before."""
    bare = text.rstrip(BLANK_CHARS)
    return "blank" if not bare else "" if bare[-1] in ".!?" else "truncated"


def turns_after(edits: str, rows):
    """(role, text) of the repaired turns, from the edits and an iterable of (role, text)."""
    rows, state = iter(rows), 0
    for edit in edits:
        if edit == "I":
            role, state = DUE[state]
            yield role, ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEPT[state]["sua".find(role[:1])]
            yield role, text
        elif edit == "R":
            role, state = DUE[state]
            yield role, text


class _Digest:
    """sha256 of `role:text` lines joined by newlines."""

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False


class _Conversation:
    """What is noted of a conversation while its rows pass in order."""

    def __init__(self):
        self.symbols, self.held, self.bytes = bytearray(), [], 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.first, self.last_turn, self.last = 0, 0, None, None, None

    def add(self, turn, role: str, text: str, again: bool) -> None:
        fault = fault_of(text)
        if fault != "blank" and (again or self.last == (role, text, turn)):
            fault = "duplicate"
        if fault:
            self.faults[fault] += 1
        initial = "sua".find(role[:1]) if role else -1
        self.symbols.append(0 if fault in ("blank", "duplicate") else 1 + (initial if initial >= 0 else 3) + 4 * (fault == "truncated"))
        if self.last is not None and self.last[0][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += self.last_turn != turn
            self.last_turn = turn
        self.last = (role, text, turn)
        self.bytes += len(role) + len(text)
        if self.bytes > HOLD:
            self.held = None
        else:
            self.held.append((role, text))

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last_turn - self.first + 1 - self.turns
        cost, audit = tables().solve(np.frombuffer(self.symbols, np.uint8))
        whole = None
        if self.held is not None:
            digest = _Digest()
            for turn in turns_after(audit, self.held):
                digest.add(*turn)
            whole = digest.hash.hexdigest()
        return (gaps, *self.faults.values(), self.illegal, cost, audit, whole)


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(batches):
    """Rows (conversation, turn, role, text, times, again) in order -> one row per conversation."""
    key, now, n = None, None, 0

    def flush(done):
        columns = list(zip(*(r[1:] for r in done), strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], kind), *arrays], names=["conv", *FIELDS, "audit", "whole"])

    done, kind = [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, turn, role, text, times, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != key:
                if now is not None:
                    done.append((key, *now.result()))
                    n += len(done[-1][7])
                key, now = conv, _Conversation()
            for _ in range(times):
                now.add(turn, role, text, again)
        if n > HOLD or len(done) > 10_000:
            yield flush(done)
            done, n = [], 0
    if now is not None:
        yield flush([*done, (key, *now.result())])


def _rewritten(make):
    """Streams of rows (conversation, edits or null, role, text, times) in order, each conversation's edits first, to what
    `make` yields from (conversation, iterator of repaired turns)."""

    def work(batches):
        kind = None

        def rows():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for conv, own in itertools.groupby(rows(), key=lambda r: r[0]):
            edits = next(own)[1]
            again = ((role, text) for _, _, role, text, times in own for _ in range(times))
            yield from make(kind, conv, turns_after(edits or "", again))

    return work


def _whole_digest(kind, conv, turns):
    digest = _Digest()
    for turn in turns:
        digest.add(*turn)
    yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hash.hexdigest()])], names=["conv", "digest"])


def _turn_rows(kind, conv, turns):
    number = 0
    for part in iter(lambda: list(itertools.islice(turns, 2_000)), []):
        numbers = pa.array(range(number, number + len(part)), pa.int64())
        role, text = (pa.array(x) for x in zip(*part, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([conv] * len(part), kind), numbers, role, text], names=["conv", "turn", "role", "text"])
        number += len(part)


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), "role", "text")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times): `rows` with known faults put in, by the checksum of `conversation:turn` modulo 20.

    0 drops a row (times 0), 1 empties its text, 2 takes the [.!?] out, 3 repeats it (times 2), 4 makes it a user's. Nulls
    of any column read as one space; the turn stays null in the result.
    """
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    return rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(text(role_col)).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text(text_col), "[.!?]", "")).otherwise(text(text_col)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def repair_turns(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest), one row per conversation of `rows`.

    `rows`: (conv, turn long, role, text, times), where `times` says how often a row is there, 0 for a conversation's sake
    only. Rows go by turn, null turns first; equal turns by role, then text. Null conversations are one conversation. Blank,
    duplicate (role and text of an earlier row) and truncated rows are counted by their first fault, `gaps` counts turns
    that are absent between the first and the last, `illegal` neighbours whose roles don't follow each other. `audit` holds
    the initials of the cheapest edits (Keep, Rerole, Delete, Insert), the least such text; `digest` is the sha256 of the
    repaired turns. A role whose initial is none of s, u and a, and an empty one, is never kept as it is. Texts of any
    length are read whole. An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "times")
    # Where one role and text is there at several turns, the rows of all but the first turn are duplicates.
    mark = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    at = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = rows.where("times > 0").groupBy("conv", mark.alias("mark")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    first = first.where("first <> last OR first.there <> last.there").select(F.col("conv").alias("c"), "mark", F.col("first.turn").alias("t"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("mark_") == F.col("mark"))
    told = rows.withColumn("mark_", mark).join(first, same, "left")
    told = told.select("conv", "turn", "role", "text", "times", (F.col("mark").isNotNull() & ~F.col("turn").eqNullSafe(F.col("t"))).alias("again"))
    kind = rows.schema["conv"].dataType
    longs = [T.StructField(n, T.LongType()) for n in FIELDS]
    schema = T.StructType([T.StructField("conv", kind), *longs, T.StructField("audit", T.StringType()), T.StructField("whole", T.StringType())])
    found = cut_lineage(_ordered(told).mapInArrow(_streamed, schema))
    long = found.where("whole IS NULL")
    if not long.isEmpty():
        schema = T.StructType([T.StructField("conv", kind), T.StructField("digest", T.StringType())])
        digests = _with_edits(rows, long).mapInArrow(_rewritten(_whole_digest), schema)
        digests = digests.select(F.col("conv").alias("c"), F.col("digest").alias("d"))
        found = found.join(digests, F.col("conv").eqNullSafe(F.col("c")), "left").withColumn("whole", F.coalesce("whole", "d")).drop("c", "d")
    return found.withColumnRenamed("whole", "digest")


def _with_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the conversations of `found` in order, each conversation's edits first."""
    some = found.select(F.col("conv").alias("c"), F.col("audit").alias("edits"))
    own = rows.where("times > 0").join(some.select("c"), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    own = own.select("conv", F.lit(None).cast("string").alias("edits"), F.lit(1).alias("kind"), "turn", "role", "text", "times")
    heads = some.select(F.col("c").alias("conv"), "edits", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("times"))
    both = heads.unionByName(own).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    return both.select("conv", "edits", "role", "text", "times")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, turn, role, text): the repaired conversations themselves, from `rows` and what `repair_turns` found of them."""
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "times")
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return _with_edits(rows, found).mapInArrow(_rewritten(_turn_rows), schema)
