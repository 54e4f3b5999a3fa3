"""Secret scans through a trigram inverted index.

Every rule's regular expression is parsed into a Boolean query of trigrams that any match must hold: the strings that
the expression spells out give conjunctions, alternatives give disjunctions. Each slice of documents gets an inverted
index of the trigrams that some query names; postings are intersected and united as a query says, and only the
documents that remain are verified by the expression itself, over their whole texts. A rule without a mandatory
trigram scans every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices, spans_of, texts


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind; expression over UTF-8 bytes, with ASCII classes only; which of its matches hold."""

    kind: str
    expression: str
    holds: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")

#: In order of listing. Matches of a rule are leftmost and don't overlap; a match that doesn't hold is dropped afterwards.
RULES = (
    Rule("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # maximal runs either way, as a shorter run can't hold a match
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: Strings that are spelled out side by side while a query is derived, and the widest class of characters in them.
MOST_STRINGS, MOST_CHARS = 64, 6

ALL = ("all",)


def _and(*parts):
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(*parts):
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _spelled(strings: set[str]):
    """Any of these strings: all trigrams of one of them."""
    return _or(*(_and(*(("gram", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


def _lower(byte: int) -> str:
    """A byte of an expression as one character, A to Z in lower case."""
    return bytes([byte]).lower().decode("latin-1")


def _analysed(items) -> tuple[set[str] | None, tuple]:
    """(the strings that a parsed expression spells out, if it does; the query that its matches satisfy)."""
    strings, query, exact = {""}, ALL, True
    for op, arg in items:
        name = str(op)
        own, inner = None, ALL
        if name == "LITERAL":
            own = {_lower(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            own = {_lower(c) for _, c in arg}
            own = own if len(own) <= MOST_CHARS else None
        elif name == "SUBPATTERN":
            own, inner = _analysed(arg[-1])
        elif name == "BRANCH":
            found = [_analysed(x) for x in arg[1]]
            if all(s is not None for s, _ in found):
                own = set().union(*(s for s, _ in found))
            else:
                inner = _or(*(q if s is None else _and(q, _spelled(s)) for s, q in found))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            own, inner = _analysed(body)
            if high == 1 and low == 0 and own is not None:
                own = own | {""}
            elif low and not (low == high == 1):
                inner, own = inner if own is None else _and(inner, _spelled(own)), None
            elif not low:
                own, inner = None, ALL
        query = _and(query, inner)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, own)}
        else:
            query = _and(query, _spelled(strings))
            strings, exact = (own, False) if own is not None else ({""}, False)
    return (strings, query) if exact else (None, _and(query, _spelled(strings)))


def trigram_query(expression: str):
    """Boolean query of lower-case trigrams of UTF-8 bytes (as characters) that every match satisfies; ALL if there is none."""
    strings, query = _analysed(re._parser.parse(expression.encode()))
    return query if strings is None else _and(query, _spelled(strings))


def grams_of(query) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*(grams_of(q) for q in query[1:])) if query != ALL else set()


class TrigramIndex:
    """Postings of the named trigrams: for each, which documents of a slice hold it."""

    def __init__(self, grams: list[str]):
        self.row = {g: i + 1 for i, g in enumerate(grams)}
        self.number = np.zeros(1 << 24, np.uint16 if len(grams) < 1 << 16 else np.uint32)
        for g, i in self.row.items():
            a, b, c = g.encode("latin-1")
            self.number[a << 16 | b << 8 | c] = i

    def postings(self, docs: list[bytes]) -> np.ndarray:
        held = np.zeros((len(self.row) + 1, len(docs)), bool)
        held[0] = True
        text = np.frombuffer(b"".join(docs).lower(), np.uint8).astype(np.uint32)
        if len(text) > 2:
            found = self.number[text[:-2] << 16 | text[1:-1] << 8 | text[2:]]
            at = np.flatnonzero(found)
            ends = spans_of(np.array([len(x) for x in docs]))[1]
            held[found[at], np.searchsorted(ends, at, side="right")] = True
        return held

    def documents(self, query, held: np.ndarray) -> np.ndarray:
        if query == ALL:
            return held[0]
        if query[0] == "gram":
            return held[self.row[query[1]]]
        parts = [self.documents(q, held) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def _scan(rules: tuple[Rule, ...]):
    def run(batches):
        compiled = [re.compile(r.expression.encode()) for r in rules]
        wanted = [trigram_query(r.expression) for r in rules]
        index = TrigramIndex(sorted(set().union(*map(grams_of, wanted))))
        for batch in slices(batches):
            docs = texts(batch)
            held = index.postings(docs)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for k, (rule, pattern) in enumerate(zip(rules, compiled, strict=True)):
                for d in np.flatnonzero(index.documents(wanted[k], held)).tolist():
                    for m in pattern.finditer(docs[d]):
                        if rule.holds(m):
                            found.setdefault(d, []).append((m.start(), k, m.end()))
            out = []
            for d in range(len(docs)):
                spans = sorted(found.get(d, ()))
                named, base, counts = [], [], dict.fromkeys(("assign", "access", "hex"), 0)
                if spans:  # code points before each byte
                    points = np.append(0, np.cumsum((np.frombuffer(docs[d], np.uint8) & 0xC0) != 0x80))
                for start, k, end in spans:
                    named.append(f"{rules[k].kind}:{points[start]}:{points[end]}")
                    if rules[k].base:
                        base.append(named[-1])
                        counts[rules[k].kind] += 1
                out.append((*counts.values(), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(named)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) per row of `docs`.

    `spans` lists kind:start:end of every match by start, then order of rules; offsets are code points, ends exclusive.
    base_sha256 digests the spans of base rules. Null and empty texts have none. Rows that repeat count each by itself;
    an empty table gives no rows; texts of any length are read whole; other columns of any name are ignored. Rules may be
    of any number and alphabet.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(_scan(tuple(rules)), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
