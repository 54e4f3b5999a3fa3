"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: whole words and word beginnings that labelled toxic texts hold far more often than others.
Features are lexicon densities, how near a lexicon word stands to the second person, and rates of capitals,
punctuation and obfuscation. The training sample is halved: features of either half are taken with the other half's
lexicon, so that trees don't trust words that a lexicon holds by chance, and the calibration is fitted to margins that
trees of the other half give. The model that scores has a lexicon and trees of both halves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut_lineage, share, slices
from tideline.llm.learn import BoostedTrees, Isotonic, labelled_sample

#: Labelled rows that the model is fitted on at most, and words of the lexicon at most.
SAMPLE_ROWS, LEXICON = 10_000, 4_000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
PREFIXES = range(3, 9)

#: Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos ton ta du dich dir dein deine sie ihr euch usted tú ti tus vosotros os".split())
#: Characters that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

WORD = re.compile(r"\w+")
DISGUISED = re.compile(r"(?<=[^\W\d_])[\d@$!*.\-_#%]+(?=[^\W\d_])")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
LETTERS = re.compile(r"[^\W\d_]")


def units_of(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


class Lexicon(dict):
    """Word -> log odds of its most telling unit, 0 if it has none, -1 for the second person."""

    def __init__(self, units: dict[str, float]):
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        value = max((self.units.get(u, 0.0) for u in units_of(word)), default=0.0) or -float(word in SECOND_PERSON)
        if len(self) < 300_000:
            self[word] = value
        return value


def features_of(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text."""
    words = WORD.findall(text.lower())
    n, chars = len(words), len(text)
    weight = np.fromiter(map(lexicon.__getitem__, words), np.float64, n)
    hits, second = np.flatnonzero(weight > 0), np.flatnonzero(weight < 0)
    weight = np.maximum(weight, 0)
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    capitals = int(count[65:91].sum() + ((raw[:-1] == 0xC3) & (raw[1:] < 0x9F)).sum())
    letters = int(count[65:91].sum() + count[97:123].sum() + count[0xC2:].sum())
    disguised = stretched = hidden = 0
    thrice = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] >= 65)
    if thrice.any() or DISGUISED.search(text):
        for token in text.split():
            if DISGUISED.search(token):
                disguised += 1
                plain = "".join(LETTERS.findall(token.lower().translate(LEET)))
            elif STRETCHED.search(token):
                stretched += 1
                plain = STRETCHED.sub(r"\1", token.lower())
            else:
                continue
            hidden += lexicon[plain] > 0 or lexicon[STRETCHED.sub(r"\1\1", plain)] > 0
    near = 0.0
    if len(hits) and len(second):
        k = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(hits - second[np.maximum(k - 1, 0)]), np.abs(second[np.minimum(k, len(second) - 1)] - hits))
        near = float((1 / (1 + gap)).sum())
    dense = 0.0  # most hits in any stretch of 50 words
    if len(hits):
        dense = float((np.searchsorted(hits, hits + 50) - np.arange(len(hits))).max())
    size = max(1, n)
    return [
        len(hits) / size,
        weight.sum() / size,
        float(len(hits)),
        float(len(np.unique(weight[hits]))),
        float(weight.max()) if n else 0.0,
        (weight > 4).sum() / size,
        dense,
        near / size,
        near / max(1, len(hits)),
        len(second) / size,
        capitals / max(1, letters),
        count[33] / max(1, chars),
        (count[44] + count[46] + count[63]) / max(1, chars),
        (chars - letters - count[32]) / max(1, chars),
        disguised / size,
        stretched / size,
        hidden / size,
        float(hidden),
        float(np.log1p(n)),
    ]


def _units(batches):
    """Rows (unit, toxic, n): in how many texts of a slice and label a unit occurs."""
    for batch in slices(batches):
        counts: dict[tuple[str, int], int] = {}
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for unit in {u for w in set(WORD.findall((text or "").lower())) for u in units_of(w)}:
                counts[unit, label] = counts.get((unit, label), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["unit", "label", "n"],
        )


def learn_lexicons(texts: DataFrame) -> list[dict[str, float]]:
    """Units with their log odds of part 0, of part 1 and of both, from (id, text, label, part) rows."""
    size = {(r["part"], r["label"]): r["n"] for r in texts.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    counts = None
    for part in (0, 1):  # a slice tells apart labels, so parts go one by one
        found = texts.where(F.col("part") == part).select("id", "text", "label").mapInArrow(_units, "unit string, label int, n long")
        found = found.select("unit", "label", "n", F.lit(part).alias("part"))
        counts = found if counts is None else counts.unionByName(found)
    of = {(p, y): F.sum(F.when((F.col("part") == p) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}") for p in (0, 1) for y in (0, 1)}
    counts = cut_lineage(counts.groupBy("unit").agg(*of.values()).where(F.col("n01") + F.col("n11") >= 3))
    out = []
    for parts in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(size.get((p, y), 0) for p in parts) for y in (1, 0))
        if not toxic or not clean:
            out.append({})
            continue
        t, c = (sum((F.col(f"n{p}{y}") for p in parts), F.lit(0)) for y in (1, 0))
        odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
        least = max(3, round(0.004 * toxic))
        # Odds that stay above 2 after two standard errors, so that rare words don't enter by chance.
        sure = odds - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) * (t < 30).cast("int") * 0.5
        found = counts.where(t >= least).select("unit", odds.alias("odds"), sure.alias("sure")).where("sure > 2").orderBy(F.desc("odds"), "unit").limit(LEXICON).collect()
        out.append({r["unit"]: r["odds"] for r in found})
    return out


class ToxicityModel:
    def __init__(self, units: dict[str, float], trees: BoostedTrees, calibration: Isotonic):
        self.units, self.trees, self.calibration = units, trees, calibration

    def score(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        x = np.array([features_of(t or "", lexicon) for t in texts], np.float64)
        return np.clip(self.calibration(self.trees.margin(x)), 0, 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> ToxicityModel:
    """A model of training rows only; SAMPLE_ROWS of them at most. Without any it scores every text alike."""
    sample = labelled_sample(labels, id_col, label_col, SAMPLE_ROWS, FOLDS, HELD_OUT)
    # About SAMPLE_ROWS rows of two numbers: small by construction, so they are sent to every executor.
    # Their texts are read several times, so they are written once.
    texts = cut_lineage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id"))
    units = learn_lexicons(texts)

    def featured(batches):
        lexicons = [Lexicon(units[1]), Lexicon(units[0])]
        for batch in slices(batches):
            x = [features_of(t or "", lexicons[p]) for t, p in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "part", "x"])

    rows = texts.select("id", "text", "label", "part").mapInArrow(featured, "id long, label int, part int, x array<double>").toArrow().sort_by("id")
    y, part = rows.column("label").to_numpy(), rows.column("part").to_numpy()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(y), -1 if len(y) else 0)
    margin = np.zeros(len(y))
    for p in (0, 1):
        margin[part == p] = BoostedTrees().fit(x[part != p], y[part != p]).margin(x[part == p])
    return ToxicityModel(units[2], BoostedTrees().fit(x, y), Isotonic().fit(margin, y))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) per row of `docs`; score is calibrated, predicted 1 from THRESHOLD on.

    Only the text counts for a score. Null and empty texts score as a text without words. Rows that repeat are scored
    each by itself; an empty table gives no rows; without labelled training rows all scores are 0.5.
    """
    model = share(docs.sparkSession, fit_toxicity(docs, labels, id_col, text_col, label_col))

    def scored(batches):
        fitted = model()
        lexicon = Lexicon(fitted.units)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.score(batch.column(1).to_pylist(), lexicon))], names=["id", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(scored, "id long, score double")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
