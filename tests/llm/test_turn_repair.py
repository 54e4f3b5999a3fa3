"""Repair of conversations against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tideline.llm import turn_repair as tr
from tideline.llm.turn_repair import BlockTables, damaged, repair_turns, repaired_turns

SPACE = re.compile(r"[^\x20\x09-\x0D]")
FOLLOWS = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) over all edits; strings compare as such, so ties go to the least."""

    @functools.cache
    def best(i, last):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        for new in FOLLOWS[last]:
            if new in FULL and depth[0] < 2:
                depth[0] += 1
                cost, audit, done = best.__wrapped__(i, new)
                depth[0] -= 1
                ways.append((5 + cost, "I" + audit, ((FULL[new], ""), *done)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, done = best(i + 1, last)
            ways.append((2 + cost, "D" + audit, done))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                for new in FOLLOWS[last]:
                    cost, audit, done = best(i + 1, new)
                    if role[:1] == new:
                        ways.append((more + cost, "K" + audit, ((role, text), *done)))
                    if new in FULL:
                        ways.append((1 + more + cost, "R" + audit, ((FULL[new], text), *done)))
        return min(ways) if ways else (10**9, "", ())

    depth = [0]
    return best(0, "")


def brute(rows):
    convs, out = {}, {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows):
        convs[r[0]].append(r)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = SPACE.findall(text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, done = cheapest([r[2:] for r in own], faults) if own else (0, "", ())
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest, done)
    return out


def table(n=400):
    rng = random.Random(n)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, 11)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "Why?", "so it is", "", " \t", None, f"Text {turn}.", "Üb. \n", "x" * 40 + "."])
            rows.append((rng.choice([conv, conv, -conv]), rng.choice([turn] * 6 + [None, 3]), role, text))
    rows += [(None, t, "user", "Hm.") for t in (None, None, 1, 2)] + [(10**6, 1, "user", "Once.")] + rows[:30]
    return rows


@pytest.mark.parametrize("hold", [4_000_000, 60])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, hold):
    monkeypatch.setattr(tr, "HOLD", hold)
    rows, want = table(), brute(table())
    data = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, times int").repartition(3)
    bad = damaged(data)
    found = repair_turns(bad)
    got = {r["conv"]: tuple(r)[1:] for r in found.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    turns = {}
    for r in repaired_turns(bad, found).collect():
        turns.setdefault(r["conv"], []).append((r["turn"], r["role"], r["text"]))
    assert {k: tuple(t[1:] for t in sorted(v)) for k, v in turns.items()} == {k: v[-1] for k, v in want.items() if v[-1]}


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_of_every_length_give_one_result(block):
    rng = np.random.default_rng(block)
    one, other = BlockTables(1), BlockTables(block)
    for n in (0, 1, 2, 5, 7, 8, 500):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        assert one.solve(symbols) == other.solve(symbols)


def test_conversations_without_rows_and_long_ones(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_turns(damaged(empty)).count() == 0
    whole = spark.createDataFrame([(1, 0, "user", "dropped", 0)], "conv long, turn long, role string, text string, times int")
    assert tuple(repair_turns(whole).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    text = "word " * 100_000 + "end."
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} {text}", 1) for t in range(20)]
    got = repair_turns(spark.createDataFrame(rows, "conv long, turn long, role string, text string, times int")).first()
    assert got["audit"] == "K" * 20 and got["digest"] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()
