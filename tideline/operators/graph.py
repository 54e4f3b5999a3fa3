"""Linked groups over edges, and lineage cuts for iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names (spark.checkpoint.dir); a temporary one only on a local master."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its hosts share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder. Unlike a checkpoint it keeps nothing of the plan that made it, constraints and
    statistics included, which grow from round to round where a loop joins its own results."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a checked table up to which it is broadcast.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """Checkpoint of a table that is small as a rule, such as a row per event: broadcast after a count of FEW rows at most,
    so that the rows that meet it aren't shuffled first."""
    df = cut(df)
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


#: Directed edges up to which labels may be broadcast: beyond, each round would send them through the driver.
SENT = 100_000


def linked_groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group_id): group_id is the smallest node reachable. Labels jump along each other until none changes."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    both = cut(both)
    met = (lambda df: df) if both.limit(SENT + 1).count() <= SENT else (lambda df: df.hint("merge"))
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = both.join(met(labels.select(F.col("x").alias("y"), F.col("label").alias("theirs"))), "y").groupBy("x").agg(F.min("theirs").alias("theirs"))
        step = labels.join(met(near), "x").select("x", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("far"))
        step = cut(step.join(met(jump), "label", "left").select("x", "old", F.coalesce(F.least("far", "label"), "label").alias("label")))
        labels = step.select("x", "label")
        if step.where("old <> label").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("group_id"))
