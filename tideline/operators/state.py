"""Mutations as functions from an old table to a new one, and the constraints that they leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows of `new` replace those of `old` with equal keys. keep: column -> condition on the old row to keep its value.

    Conditions see old columns as `old_<name>`. Both tables have the same columns and unique keys.
    """
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in rest), F.lit(True).alias("_a"))
    b = new.select(*keys, *rest, F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")

    def value(c: str) -> Column:
        stays = F.col("_b").isNull()
        if keep and c in keep:
            stays = stays | (F.col("_a").isNotNull() & F.coalesce(keep[c], F.lit(False)))
        return F.when(stays, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*keys, *(value(c) for c in rest)).select(old.columns)


def deleted_except(known: DataFrame, present: DataFrame, key: str, flag: str) -> DataFrame:
    """Marks known rows that are no longer present."""
    gone = known.join(present.select(key), key, "left_anti").withColumn(flag, F.lit(True))
    return known.join(present.select(key), key, "left_semi").unionByName(gone)


def merge_exact_copies(blobs: DataFrame, assets: DataFrame, blob: str, content: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(blobs, assets) after copies of one content become its earliest blob and assets point there. Unknown content stays."""
    canonical = blobs.groupBy(*content).agg(F.min_by(blob, F.struct(order, blob)).alias("_to"))
    moved = blobs.join(canonical, content, "left").select(blob, F.coalesce("_to", blob).alias("_to"))
    kept = blobs.join(moved.where(F.col(blob) == F.col("_to")).select(blob), blob, "left_semi")
    pointed = assets.join(moved, blob, "left").withColumn(blob, F.coalesce("_to", blob)).drop("_to").select(assets.columns)
    return kept, pointed


def hard_deleted(assets: DataFrame, blobs: DataFrame, blob: str, deleted_at: str, now: Column, grace: str = "INTERVAL 7 DAYS") -> tuple[DataFrame, DataFrame]:
    """(assets, blobs) without what was deleted before the grace period, and without blobs that nothing refers to."""
    left = assets.where(F.col(deleted_at).isNull() | (F.col(deleted_at) + F.expr(grace) > now))
    return left, blobs.join(left.select(blob).distinct(), blob, "left_semi")


def staging_actions(listing: DataFrame, assets: DataFrame, jobs: DataFrame, key: str, modified: str, now: Column, grace: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Adds `action` to staged objects: what is derived goes, what is completed without a job is enqueued, and what no
    asset refers to goes after the grace period. assets: (key, completed, derived), one row per key; jobs: keys."""
    queued = jobs.select(key).distinct().withColumn("_queued", F.lit(True))
    rows = listing.join(assets.select(key, "completed", "derived", F.lit(True).alias("_asset")), key, "left").join(queued, key, "left")
    action = (
        F.when(F.col("derived"), "delete")
        .when(F.col("completed") & F.col("_queued").isNull(), "enqueue")
        .when(F.col("_asset").isNull() & (F.col(modified) + F.expr(grace) < now), "delete")
        .otherwise("keep")
    )
    return rows.select(*listing.columns, action.alias("action"))


def apply_constraints(members: DataFrame, includes: DataFrame, excludes: DataFrame, event: str, asset: str) -> DataFrame:
    """Memberships after edits: excluded pairs go, included assets move to their event with full confidence."""
    left = members.join(excludes.select(event, asset), [event, asset], "left_anti").join(includes.select(asset), asset, "left_anti")
    added = includes.select(event, asset).distinct().withColumns({"confidence": F.lit(1.0), "tier": F.lit("confirmed"), "source": F.lit("manual")})
    return left.select(added.columns).unionByName(added)


def patched_interest(interest: Column, manual: Column) -> Column:
    """keep raises interest to 0.9 at least, quiet lowers it to 0.1 at most."""
    return F.when(manual == "keep", F.greatest(interest, F.lit(0.9))).when(manual == "quiet", F.least(interest, F.lit(0.1))).otherwise(interest)


def labelled_faces(faces: DataFrame, labels: DataFrame, face: str, person: str) -> DataFrame:
    """Faces after human labels (face, person, verdict): a confirmation wins, the lowest person of several; a rejection
    clears an assignment to that very person only."""
    confirmed = labels.where("verdict = 'confirm'").groupBy(face).agg(F.min(person).alias("_yes"))
    rejected = labels.where("verdict = 'reject'").select(face, person, F.lit(True).alias("_no")).distinct()
    rows = faces.join(confirmed, face, "left").join(rejected, [face, person], "left")
    who = F.when(F.col("_yes").isNotNull(), F.col("_yes")).when(F.col("_no").isNull(), F.col(person))
    return rows.withColumn(person, who).withColumn("tier", F.when(F.col("_yes").isNotNull(), "confirmed").when(F.col("_no").isNull(), F.col("tier"))).select(faces.columns)
