"""A corpus pipeline: from raw documents to a deduplicated, decontaminated mix.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of `documents`; the last returns the mixed corpus: the documents it takes, how many words of each (repeats
counted) and how often.

Stages judge rows, not ids: decisions are joined by a number of the row, which is the id where every row has its own.
So rows that repeat an id, or have none, keep or lose their own text only. Further columns of any name pass through;
where one bears the name of a column that a stage adds, the new one gets a prefix. Texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import cut_lineage, numbered
from tideline.llm.decontaminate import decontaminate
from tideline.llm.exact_dedup import exact_dedup
from tideline.llm.mixing import mix_sources
from tideline.llm.near_dup import near_dup
from tideline.llm.quality import keep_good

def _free(docs: DataFrame, name: str, prefix: str) -> str:
    """`name`, with as many prefixes as it takes to differ from all columns of `docs`."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = prefix + name
    return name


def _without(docs: DataFrame, decisions: DataFrame, row: str) -> DataFrame:
    """The rows of numbered `docs` whose number isn't decided against."""
    return docs.join(decisions.where("NOT kept").select(row), row, "left_anti").drop(row)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the line field predicts to be good; labels come from the labels table.

    Null and empty texts have no lines and are judged as such. Repeated rows are judged each by itself; an empty table
    stays empty.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of equal texts, that with the largest doc_id.

    Null texts count as empty. Rows without an id yield to those with one; of rows that repeat an id and text, or of
    several without an id, any one stays. An empty table stays empty.
    """
    row = _free(docs, "row", "_")
    rows = numbered(docs, "doc_id", "text", row, nulls_last=False)
    return _without(rows, exact_dedup(rows, row), row)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of near copies (similarity of 0.85, as op9), that with the smallest doc_id.

    Rows without words, null texts too, have no near copies and stay. Rows without an id yield to those with one; of
    rows that tie any one stays. An empty table stays empty.
    """
    row = _free(docs, "row", "_")
    rows = numbered(docs, "doc_id", "text", row)
    return _without(rows, near_dup(rows, row), row)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth at least.

    Null and empty texts are clean. Repeated rows are judged each by itself; an empty table stays empty.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where("NOT contaminated").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents that the mix takes, with size, source_size, target, taken and copies.

    Where `docs` has a column of such a name, the new one is prefixed with mix_, as often as it takes. Null sources are a source; texts without
    words are never taken. Repeated rows are taken each by itself; an empty table stays empty.
    """
    row = _free(docs, "row", "_")
    rows = numbered(docs, "doc_id", "text", row)
    mix = mix_sources(rows.select(row, "text", F.array("source").alias("_members")), "_members", row)
    mix = mix.where("taken > 0").withColumn("copies", F.expr("taken div size"))
    new = ("size", "source_size", "target", "taken", "copies")
    mix = mix.select(row, *(F.col(c).alias(_free(docs, c, "mix_")) for c in new))
    return rows.join(mix, row).drop(row)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: The first and third stage fit models or compare sets by hashes, so no SQL states the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. What a stage keeps is written once, as the next reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
