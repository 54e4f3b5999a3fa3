"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document may count for). The network has an
arc from each pattern to each of its sources; a pattern offers its words once for nothing and again at a cost, so
repetition costs are convex, and a source takes its quota at most. The flow says how many words of a pattern's first
and second repetition each source gets; seeded documents then fill these amounts.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Patterns and sources that the network may have; more raise an error rather than fill the driver.
MAX_ARCS = 200_000
#: Documents of a bucket of the seeded order, and buckets of a pattern at most.
BUCKET_DOCS, MAX_BUCKETS = 64, 1 << 16


def targets(sizes: list[int], weights: list[float], total: float, cap: float = REPEATS) -> list[float]:
    """Shares of `total` by weight; none exceeds cap times its size, and the excess is shared anew."""
    out = [0.0] * len(sizes)
    active, left = list(range(len(sizes))), total
    while active:
        whole = sum(weights[i] for i in active)
        full = [i for i in active if left * weights[i] / whole > cap * sizes[i]]
        if not full:
            for i in active:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        active = [i for i in active if i not in set(full)]
    return out


class MinCostFlow:
    """A cheapest greatest flow, by the primal-dual method: all paths of one cost at a time, as blocking flows.

    Costs sit on the arcs that leave the source. An augmenting path never leads back into the source, so its cost is
    that of its first arc, and the arcs of the next cost open when no path of the former is left.
    """

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.closed: list[tuple[int, int, int]] = []  # cost, arc, room

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        e = len(self.to)
        self.out[a].append(e)
        self.out[b].append(e + 1)
        self.to += [b, a]
        self.room += [0 if cost else room, 0]
        if cost:
            self.closed.append((cost, e, room))
        return e

    def run(self, source: int, sink: int) -> None:
        self._augment(source, sink)
        for cost in sorted({c for c, _, _ in self.closed}):
            for c, e, room in self.closed:
                if c == cost:
                    self.room[e] = room
            self._augment(source, sink)

    def _augment(self, source: int, sink: int) -> None:
        """Blocking flows along arcs that lead one level further from the source, until the sink is out of reach."""
        out, to, room = self.out, self.to, self.room
        while True:
            level = [-1] * len(out)
            level[source] = 0
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in out[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[sink] < 0:
                return
            turn = [0] * len(out)
            path, at = [], source
            while True:
                if at == sink:
                    send = min(room[e] for e in path)
                    for e in path:
                        room[e] -= send
                        room[e ^ 1] += send
                    k = next(i for i, e in enumerate(path) if not room[e])
                    at = to[path[k] ^ 1]
                    del path[k:]
                elif turn[at] < len(out[at]):
                    e = out[at][turn[at]]
                    if room[e] and level[to[e]] == level[at] + 1:
                        path.append(e)
                        at = to[e]
                    else:
                        turn[at] += 1
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break

    def sent(self, e: int) -> int:
        return self.room[e ^ 1]


def route(patterns: list[tuple[tuple, int]], quotas: dict[object, int]) -> list[tuple[int, int, object, int]]:
    """(pattern number, repetition, source, words) for patterns given as (sources, words)."""
    names = list(quotas)
    number = {s: i for i, s in enumerate(names)}
    first = 2 + len(names)
    net = MinCostFlow(first + len(patterns) * (1 + REPEATS))
    arcs = []
    for p, (members, words) in enumerate(patterns):
        for k in range(REPEATS):
            layer = first + p * REPEATS + k
            net.arc(0, layer, words, k)
            arcs += [(p, k, s, net.arc(layer, 2 + number[s], words)) for s in members]
    for s in names:
        net.arc(2 + number[s], 1, quotas[s])
    net.run(0, 1)
    return [(p, k, s, net.sent(e)) for p, k, s, e in arcs if net.sent(e)]


def _fill(table: pa.Table) -> pa.Table:
    """Chooses whole documents of one bucket and repetition, in seeded order, for the amounts that are due from it."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "id", "size", "row")), strict=True), key=lambda r: (r[0], str(r[1]), r[2]))
    due = [d["words"] for d in table.column("due")[0].as_py()]
    got = []
    for left in due:
        rest = []
        for r in rows:
            if 0 < r[2] <= left:
                left -= r[2]
                got.append(r)
            else:
                rest.append(r)
        rows = rest
    layer = table.column("layer")[0].as_py()
    return pa.table({"row": pa.array([r[3] for r in got], pa.int64()), "layer": pa.array([layer] * len(got), pa.int32())})


def mix_sources(docs: DataFrame, members_col: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, members, size, source_size, target, taken) per row of `docs`; members_col is an array of source names.

    Sources are ordered by code point with null last, weigh WEIGHTS in turn, and share SHARE of all words; no target
    exceeds REPEATS times its source's words. `source_size` and `target` belong to the first of a row's sources.
    `taken` is `size` times the repetitions that the mix takes; it is whole documents, so a source's sum falls short
    of its target by less than its smallest passed-over document near the quota. Null and empty texts have size 0 and
    are never taken. A row without any source is never taken and has null source_size and target. Repeated rows count
    each. An empty table gives no rows. Reruns with one seed agree.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.array_sort(F.array_distinct(members_col)), F.array().cast("array<string>")).alias("members"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), id_col).alias("place"),
    )
    base = cut_lineage(base.withColumn("row", F.monotonically_increasing_id()))  # sizes and row names, without texts
    found = base.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_ARCS + 1).collect()
    patterns = sorted(((tuple(r["members"]), r["words"], r["n"]) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    if len(found) > MAX_ARCS or sum(len(p[0]) for p in patterns) > MAX_ARCS:
        raise ValueError(f"over {MAX_ARCS} membership patterns or arcs")
    names = sorted({s for p in patterns for s in p[0]}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for members, words, _ in patterns:
        for s in members:
            sizes[s] += words
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]
    total = SHARE * sum(words for members, words, _ in patterns if members)
    aims = dict(zip(names, targets([sizes[s] for s in names], weights, total), strict=True))
    flow = route([(members, words) for members, words, _ in patterns], {s: round(aims[s]) for s in names})

    # The amounts of a pattern's repetition lie one after another along the seeded order of its documents.
    at: dict[tuple[int, int], int] = {}
    segments = []
    for p, k, _, words in flow:
        low = at.get((p, k), 0)
        segments.append((list(patterns[p][0]), k, low, low + words))
        at[p, k] = low + words
    bins = [(list(members), max(1, min(MAX_BUCKETS, n // BUCKET_DOCS))) for members, _, n in patterns]
    plan = spark.createDataFrame(segments, "members array<string>, layer int, low long, high long")
    bins = spark.createDataFrame(bins, "members array<string>, bins int")
    binned = base.join(F.broadcast(bins), _same("members", base, bins), "inner").drop(bins["members"])
    binned = binned.withColumn("bucket", F.pmod("place", "bins"))
    sums = binned.groupBy("members", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("words").over(order)).withColumn("begin", F.col("end") - F.col("words"))
    # `plan` has one row per arc and repetition, which MAX_ARCS bounds.
    due = sums.join(F.broadcast(plan), _same("members", sums, plan) & (F.least("end", "high") > F.greatest("begin", "low")), "inner").drop(plan["members"])
    due = due.withColumn("part", F.least("end", "high") - F.greatest("begin", "low"))
    due = due.groupBy("members", "bucket", "layer", "words").agg(F.array_sort(F.collect_list(F.struct("low", F.col("part").alias("words")))).alias("due"), F.sum("part").alias("part"))
    members = F.to_json("members")  # equal for null sources too
    keyed = binned.select("row", "id", "size", "place", F.xxhash64("bucket", members).alias("key"))
    due = due.select(F.xxhash64("bucket", members).alias("key"), "layer", "due", (F.col("part") == F.col("words")).alias("whole"))
    wanted = keyed.join(due, "key")
    whole = wanted.where("whole AND size > 0").select("row", "layer")
    partial = wanted.where("NOT whole").groupBy("key", "layer").applyInArrow(_fill, "row long, layer int")
    taken = whole.unionByName(partial).groupBy("row").agg(F.count("*").alias("times"))
    aim = spark.createDataFrame([(s, sizes[s], aims[s]) for s in names] or [], "source string, source_size long, target double")
    lead = F.get("members", F.lit(0))
    out = base.join(taken, "row", "left").withColumn("source", lead)
    out = out.join(F.broadcast(aim.withColumnRenamed("source", "aim")), F.col("source").eqNullSafe(F.col("aim")) & (F.size("members") > 0), "left")
    return out.select(F.col("id").alias(id_col), "members", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"))


def _same(name: str, a: DataFrame, b: DataFrame):
    return a[name].eqNullSafe(b[name])

