"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. What a line looks like, and what its neighbours look like, speaks for its label, and labels
of adjacent lines depend on each other. Only documents are labelled, so the field is fitted to them: all lines of a
good document are good, and at least one line of a bad document is bad; the likelihood of either follows from the
score of the all-good labelling and the partition function. Forward-backward marginals of good lines, weighted by
length, give a document's quality, which a logistic calibration on the other half of the sample turns into a score.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import share, slices, spans_of, texts
from tideline.llm.learn import fit_logistic, labelled_sample, sigmoid

#: Labelled rows that the model is fitted on at most, and lines of each; what is scored is always the whole text.
SAMPLE_ROWS, SAMPLE_LINES = 8_000, 256
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

#: Classes of bytes that are counted per line.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"#$%&*@~^=<>{}[]\\_", b"|", b".,;:?", bytes(range(128, 256)))
WIDTH = 17


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, features) of each line that has words."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not lines:
        return np.zeros(0), np.zeros((0, WIDTH))
    size = np.array([len(x) for x in lines], np.int64)
    raw = np.frombuffer(b"".join(lines), np.uint8)
    starts = spans_of(size)[0]
    share = np.zeros((len(lines), len(_CLASSES)))
    for k, chars in enumerate(_CLASSES):
        share[:, k] = np.add.reduceat(_MEMBER[k][raw], starts, dtype=np.int64)
    letters = np.maximum(1, share[:, 0] + share[:, 1] + share[:, 7] / 2)
    words, distinct, repeats, most = (np.zeros(len(lines)) for _ in range(4))
    seen: set[bytes] = set()
    again = np.zeros(len(lines))
    for i, line in enumerate(lines):
        own = line.split()
        words[i], distinct[i] = len(own), len(set(own))
        repeats[i] = sum(map(eq, own, own[1:]))
        most[i] = max(map(len, own))
        again[i] = len(line) > 20 and line in seen
        seen.add(line)
    x = np.column_stack([
        np.log1p(size), share[:, 0] / letters, share[:, 2] / size, np.minimum(1, share[:, 3] / words), np.minimum(2, share[:, 4] / words),
        share[:, 5] / words, share[:, 6] / words, share[:, 7] / size, np.log1p(words), distinct / words, repeats / words, size / words,
        np.log1p(most), again, words < 4, (distinct / words) * np.log1p(words), np.array([x.rstrip()[-1:] in b".!?" for x in lines]),
    ])
    return size.astype(np.float64), x


_MEMBER = np.zeros((len(_CLASSES), 256), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _MEMBER[_k, list(_chars)] = 1


class LineField:
    """Linear-chain field with labels 0 (bad) and 1 (good)."""

    def __init__(self):
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.weights = np.zeros(3 * WIDTH + 1)
        self.moves = np.array([[1.0, 0.0], [0.0, 1.0]])

    def inputs(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Standardised features of each line, its predecessor and its successor in the same document."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        before, after = np.zeros_like(z), np.zeros_like(z)
        if len(z) > 1:
            starts, ends = spans_of(counts)
            before[1:], after[:-1] = z[:-1], z[1:]
            some = counts > 0
            before[starts[some]] = 0
            after[ends[some] - 1] = 0
        return np.column_stack([z, before, after, np.ones(len(z))])

    def marginals(self, emission: np.ndarray, counts: np.ndarray):
        """(P(good) per line, pair marginals summed over each document, log partition function) of many documents.

        emission: the score of label good per line; bad scores 0. Documents advance side by side, longest first.
        """
        order = np.argsort(-counts, kind="stable")
        n, starts = counts[order], spans_of(counts)[0][order]
        e = np.zeros((len(emission), 2))
        e[:, 1] = emission
        alpha, beta = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
        longest = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")  # documents of t lines or more
        for t in range(longest):
            at = starts[: active[t]] + t
            if t:
                a = alpha[at - 1]
                alpha[at] = np.logaddexp(a[:, :1] + self.moves[0], a[:, 1:] + self.moves[1])
            alpha[at] += e[at]
        for t in range(longest - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            b = beta[at + 1] + e[at + 1]
            beta[at] = np.logaddexp(b[:, :1] + self.moves[:, 0], b[:, 1:] + self.moves[:, 1])
        last = starts + np.maximum(n, 1) - 1
        log_z = np.zeros(len(counts))
        some = n > 0
        log_z[order[some]] = np.logaddexp(alpha[last[some], 0], alpha[last[some], 1])
        z = np.repeat(log_z, counts)
        good = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - z)) if len(z) else np.zeros(0)
        inner = np.ones(len(emission), bool)
        inner[spans_of(counts)[1][counts > 0] - 1] = False
        at = np.flatnonzero(inner)
        pairs = np.zeros((len(counts), 2, 2))
        doc = np.repeat(np.arange(len(counts)), counts)[at]
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(alpha[at, i] + self.moves[i, j] + e[at + 1, j] + beta[at + 1, j] - z[at])
                pairs[:, i, j] = np.bincount(doc, p, len(counts))
        return good, pairs, log_z

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 90, rate: float = 0.08, ridge: float = 1e-3) -> LineField:
        """x: features of all lines; counts: lines of each document; y: 1 for good documents. Adam on the likelihood."""
        if not len(x):
            return self
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        inputs = self.inputs(x, counts)
        self.weights[-1] = 2.0
        doc = np.repeat(np.arange(len(counts)), counts)
        first = second = np.zeros(len(self.weights) + 4)
        links = np.maximum(counts - 1, 0)
        for step in range(1, steps + 1):
            emission = inputs @ self.weights
            good, pairs, log_z = self.marginals(emission, counts)
            log_p = np.minimum(np.bincount(doc, emission, len(counts)) + links * self.moves[1, 1] - log_z, -1e-6)
            p = np.exp(log_p)
            pull = np.where(y == 1, 1.0, -np.minimum(p / (1 - p), 50.0))
            pull[counts == 0] = 0
            moves = -pairs
            moves[:, 1, 1] += links
            gradient = np.concatenate([inputs.T @ (pull[doc] * (1 - good)), np.einsum("d,dij->ij", pull, moves).ravel()]) / len(counts)
            gradient -= ridge * np.concatenate([self.weights, self.moves.ravel()])
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights + change[:-4]
            self.moves = self.moves + change[-4:].reshape(2, 2)
        return self

    def document_features(self, size: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(quality, its log odds, share of text in bad lines, has lines) of each document."""
        good = self.marginals(self.inputs(x, counts) @ self.weights, counts)[0] if len(x) else np.zeros(0)
        doc = np.repeat(np.arange(len(counts)), counts)
        whole = np.maximum(1, np.bincount(doc, size, len(counts)))
        quality = np.bincount(doc, size * good, len(counts)) / whole
        bad = np.bincount(doc, size * (good < 0.5), len(counts)) / whole
        m = np.clip(quality, 1e-4, 1 - 1e-4)
        return np.column_stack([quality, np.log(m / (1 - m)), bad, counts > 0])


class QualityModel:
    def __init__(self, field: LineField, calibration: np.ndarray):
        self.field, self.calibration = field, calibration

    def score(self, docs: list[bytes]) -> np.ndarray:
        found = [line_features(x) for x in docs]
        counts = np.array([len(f[0]) for f in found], np.int64)
        x = self.field.document_features(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), counts)
        return sigmoid(np.column_stack([x, np.ones(len(x))]) @ self.calibration)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> QualityModel:
    """A model of training rows only, SAMPLE_ROWS of them at most: one half fits the field, the other calibrates it.

    The driver holds WIDTH numbers for each of SAMPLE_ROWS x SAMPLE_LINES lines at most.
    """
    sample = labelled_sample(labels, id_col, label_col, SAMPLE_ROWS, FOLDS, HELD_OUT)

    def middle(found):
        """SAMPLE_LINES consecutive lines, from the middle of a longer text."""
        at = max(0, (len(found[0]) - SAMPLE_LINES) // 2)
        return [f[at : at + SAMPLE_LINES] for f in found]

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def featured(batches):
        for batch in slices(batches):
            found = [middle(line_features(x)) for x in texts(batch)]
            size, x = ([f[k].astype(np.float32).tobytes() for f in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(size, pa.binary()), pa.array(x, pa.binary())], names=["id", "label", "part", "size", "x"])

    # About SAMPLE_ROWS rows of three numbers: small by construction, so they are sent to every executor.
    rows = base.join(F.broadcast(sample), "id").select("id", "text", "label", "part")
    rows = rows.mapInArrow(featured, "id long, label int, part int, size binary, x binary").toArrow().sort_by("id")
    part, y = rows.column("part").to_numpy(), rows.column("label").to_numpy()
    sizes = [np.frombuffer(b, np.float32) for b in rows.column("size").to_pylist()]
    features = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows.column("x").to_pylist()]

    def half(p: int):
        at = np.flatnonzero(part == p)
        none = np.zeros((0, WIDTH), np.float32)
        return (
            np.concatenate([sizes[i] for i in at] or [none[:, 0]]).astype(np.float64),
            np.concatenate([features[i] for i in at] or [none]).astype(np.float64),
            np.array([len(sizes[i]) for i in at], np.int64),
            y[at],
        )

    _, x, counts, own = half(0)
    field = LineField().fit(x, counts, own)
    size, x, counts, own = half(1)
    calibration = fit_logistic(field.document_features(size, x, counts), own) if len(own) else np.zeros(5)
    return QualityModel(field, calibration)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that score_quality() predicts 1 for, unchanged and without a shuffle."""
    model = share(docs.sparkSession, fit_quality(docs, labels, id_col, text_col, label_col))
    column = docs.columns.index(text_col)

    def kept(batches):
        fitted = model()
        for batch in slices(batches, column):
            yield batch.filter(pa.array(fitted.score(texts(batch, column)) >= THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) per row of `docs`; predicted is 1 from THRESHOLD on.

    Only the text counts for a score. Null and empty texts have no lines and score as such a document does. Rows that
    repeat are scored each by itself; an empty table gives no rows; without labelled training rows scores are 0.5.
    """
    model = share(docs.sparkSession, fit_quality(docs, labels, id_col, text_col, label_col))

    def scored(batches):
        fitted = model()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.score(texts(batch)))], names=["id", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(scored, "id long, score double")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
