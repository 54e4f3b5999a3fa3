"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths. The hash of that set, its fingerprint, selects one of the
declared mappings, which say where a record's turns, roles and texts are. Canonical turns then pass through a template
that marks turns and escapes control characters within texts, so that the output can be read back without loss.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import partitions


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are.

    each: path of the array whose elements are turns, or "" if the record itself holds them.
    turns: (role or path of the role, path of the text) of every turn that an element, or the record, gives.
    roles: names of roles to replace. optional: paths that may be absent.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


#: A role that begins with "." is a path; any other is the role itself.
MAPPINGS = (
    Mapping("turn row", ("role", "text", "turn"), ((".role", "text"),), optional=("role", "text", "turn")),
    Mapping("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), ((".role", "content"),), each="messages", optional=("messages[].content",)),
    Mapping("shared conversation", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), ((".from", "value"),), each="conversations", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", ("input", "instruction", "output"), (("system", "input"), ("user", "instruction"), ("assistant", "output")), optional=("input",)),
    Mapping("prompt", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("nested prompt", ("data", "data.answer", "data.question"), (("user", "data.question"), ("assistant", "data.answer"))),
)


def field_paths(value, path: str = "") -> set[str]:
    """Nested field paths of a record; [] stands for any element. Null fields are absent ones."""
    if isinstance(value, dict):
        inner = [field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items() if v is not None]
    elif isinstance(value, list):
        inner = [field_paths(v, path + "[]") for v in value]
    else:
        inner = []
    return set().union({path} if path else set(), *inner)


def fingerprint(paths: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


def layouts(mappings=MAPPINGS) -> dict[int, Mapping]:
    """Fingerprint -> mapping, with and without the optional paths."""
    out: dict[int, Mapping] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for absent in itertools.combinations(m.optional, n):
                out.setdefault(fingerprint(set(m.paths) - set(absent)), m)
    return out


def turns_of(record: dict, known: dict[int, Mapping]) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns, or None if no mapping fits. Null roles and texts become empty."""
    mapping = known.get(fingerprint(field_paths(record)))
    if mapping is None:
        return None

    def at(value, path: str):
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    found = []
    for element in record[mapping.each] if mapping.each else [record]:
        for role, text in mapping.turns:
            if role.startswith("."):
                role = at(element, role[1:])
            elif mapping.optional and text in mapping.optional and not at(element, text):
                continue
            found.append((mapping.roles.get(role, role), at(element, text)))
    return found


END = "</turn>\n"
#: Escapes leave neither "###" nor "</turn>" within a text, not even as part of an escape.
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_TEXT, _ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.DOTALL)
_PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def escaped(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: _ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def piece_of(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, begin and end of its loss mask); only what the assistant says is under the mask."""
    head, body = f"### {escaped(_ROLE, role)}: ", escaped(_TEXT, text)
    begin = len(head)
    return head + body + END, begin, begin + len(body) if role == "assistant" else begin


def read_piece(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError("not a formatted turn")
    return unescaped(found[1]), unescaped(found[2])


def _formatted(batches):
    known = layouts()
    for batch in batches:
        out: list[tuple] = []
        for own, record in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = turns_of(json.loads(record), known) if record is not None else None
            if found is None:
                out.append((own.as_py(), None, None, None))
            else:
                out.extend((own.as_py(), *piece_of(*turn)) for turn in found)
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
            names=["conv_id", "piece", "loss_begin", "loss_end"],
        )


def format_chats(records: DataFrame, id_col: str, order_cols: list[str], record_col: str) -> DataFrame:
    """(conv_id, piece, loss_begin, loss_end): formatted turns; those of a conversation follow each other in a partition.

    A conversation may consist of many records, in order of `order_cols`; ties are ordered by the record itself.
    Its pieces, one after the other, are its formatted text. It streams through its task piece by piece, so no
    conversation is held whole. A record whose layout no mapping knows, or a null one, gives a row with a null piece.
    An empty table gives no rows.
    """
    rows = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).alias("record"), *order_cols)
    rows = rows.repartition(partitions(records.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order_cols, "record")
    return rows.select("conv_id", "record").mapInArrow(_formatted, "conv_id long, piece string, loss_begin long, loss_end long")


def _read_back(batches):
    """Digests of each conversation, from pieces that stream by."""

    def row():
        return own, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    own, n, out = None, -1, []
    for batch in batches:
        columns = (c.to_pylist() for c in batch.columns)
        for conv, piece, begin, end in zip(*columns, strict=True):
            if n < 0 or conv != own:
                if n >= 0:
                    out.append(row())
                own, n, chars, loss_chars = conv, 0, 0, 0
                all_turns, loss = hashlib.sha256(), hashlib.sha256()
            if piece is None:
                continue
            role, text = read_piece(piece)
            masked = unescaped(piece[begin:end])
            n += 1
            chars += len(piece)
            loss_chars += len(masked)
            all_turns.update(f"{role}\n{text}\n".encode())
            loss.update(masked.encode())
        if len(out) > 5_000:
            yield _digests(out)
            out = []
    if n >= 0:
        out.append(row())
    yield _digests(out)


def _digests(rows):
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, parsed from format_chats() output (which keeps a conversation's pieces together)."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
