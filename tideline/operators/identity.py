"""Identity matching over embedding prototypes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import top_by_vector

#: Score and margin of a tier, and the boost by context.
HIGH, HIGH_MARGIN, PROBABLE, PROBABLE_MARGIN, LOW, BOOST = 0.62, 0.10, 0.50, 0.06, 0.42, 0.05


def match_tier(best: Column, margin: Column, boost: Column) -> Column:
    return (
        F.when((best >= HIGH - boost) & (margin >= HIGH_MARGIN), "high")
        .when((best >= PROBABLE - boost) & (margin >= PROBABLE_MARGIN), "probable")
        .when(best >= LOW - boost, "low")
    )


def cap_tier(tier: Column, flags: Column) -> Column:
    """Quality flags cap a tier: too small at low; profile, low quality or low confidence at probable."""
    weak = F.arrays_overlap(flags, F.array(*(F.lit(x) for x in ("profile", "low_quality", "low_confidence"))))
    return F.when(F.array_contains(flags, "too_small") & tier.isNotNull(), "low").when(weak & (tier == "high"), "probable").otherwise(tier)


def match_faces(faces: DataFrame, prototypes: DataFrame, face: str, emb: str, person: str, boost: Column | None = None) -> DataFrame:
    """(face, person, best, margin, tier): greatest cosine with any prototype of a person, and its lead over the next person.

    Ties go to the higher person; a single person leads by its whole score. Prototypes are broadcast in blocks of whole
    persons, about PROTOTYPES and PROTOTYPE_BYTES at most at a time; each block leaves two persons per face, and the best two
    of all blocks remain.
    """
    spark = faces.sparkSession
    held = prototypes.select(F.col(person).cast("long").alias("person"), "proto")
    count, width = held.agg(F.count("*"), F.coalesce(F.max(F.size("proto")), F.lit(0))).first()
    blocks = max(1, -(-count // PROTOTYPES), -(-count * width * 8 // PROTOTYPE_BYTES))
    rows = faces.select(F.col(face).cast("long").alias("face"), emb)
    found = None
    for n in range(blocks):
        part = (held if blocks == 1 else held.where(F.pmod(F.xxhash64("person"), F.lit(blocks)) == n)).toArrow()
        owner = part.column(0).to_numpy().astype(np.int64)
        if not len(owner):
            continue
        order = np.argsort(owner, kind="stable")
        names, starts = np.unique(owner[order], return_index=True)
        vec = part.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(owner), -1)[order]
        shared = spark.sparkContext.broadcast((names, starts, vec))

        def matched(batches, shared=shared):
            names, starts, vec = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, FACES):
                    own = batch.column(0).slice(at, FACES)
                    x = np.array(batch.column(1).slice(at, FACES).to_pylist(), np.float64)
                    score = np.maximum.reduceat(x @ vec.T, starts, axis=1)
                    out = []
                    for _ in range(min(2, len(names))):
                        at_ = len(names) - 1 - score[:, ::-1].argmax(axis=1)
                        best = score[np.arange(len(x)), at_]
                        out.append(pa.RecordBatch.from_arrays([own, pa.array(names[at_]), pa.array(best)], names=["face", "person", "score"]))
                        score[np.arange(len(x)), at_] = -np.inf
                    yield from out

        part = rows.mapInArrow(matched, "face long, person long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:  # nobody is known
        found = rows.select("face", F.lit(0).cast("long").alias("person"), F.lit(0.0).alias("score")).limit(0)
    two = found.groupBy("face").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "person")), asc=False), 1, 2).alias("two"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    out = two.select(F.col("face").alias(face), first["person"].alias(person), first["score"].alias("best"), (first["score"] - F.coalesce(second["score"], F.lit(0.0))).alias("margin"))
    return out.withColumn("tier", match_tier(F.col("best"), F.col("margin"), boost if boost is not None else F.lit(0.0)))


#: Prototypes and bytes of a broadcast block, and faces that a worker scores against it at a time.
PROTOTYPES, PROTOTYPE_BYTES, FACES = 50_000, 64_000_000, 200


def mean_prototypes(faces: DataFrame, person: str, emb: str) -> DataFrame:
    """(person, proto): the mean embedding of a person at unit length, by partial sums per dimension."""
    long = faces.select(person, F.posexplode(emb).alias("dim", "x")).groupBy(person, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    proto = long.groupBy(person).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select(person, F.transform("v", lambda e: e["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return proto.select(person, F.transform("v", lambda x: x / norm).alias("proto"))


def similar_assets(queries: DataFrame, rows: DataFrame, key: str, emb: str, k: int = 12) -> DataFrame:
    """The k most similar rows of each query row, itself excluded."""
    return top_by_vector(queries.withColumnRenamed(key, "query_id"), rows, "query_id", emb, key, emb, k)
