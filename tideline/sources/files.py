"""File sources and sinks: folder scans, typed readers, nested exports, incremental reads by high-water mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings and their media types.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "heic": "image/heic", "heif": "image/heif", "webp": "image/webp"}
VIDEO_TYPES = {"mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/x-m4v", "avi": "video/x-msvideo"}


def mime_of(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in (IMAGE_TYPES | VIDEO_TYPES).items() for x in kv))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def scan_folder(spark: SparkSession, root: str, hashes: bool = False) -> DataFrame:
    """Media files under `root`, hidden ones left out: path, relative path, album (first folder), mime, size, modified.

    Contents are read only if `hashes` are asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + _literal(root.rstrip("/").rpartition("://")[2]) + "/", "")
    rows = files.withColumn("relative", relative).withColumn("mime", mime_of(F.col("path")))
    rows = rows.where(F.col("mime").isNotNull() & ~F.col("relative").rlike(r"(^|/)\."))
    album = F.when(F.col("relative").contains("/"), F.element_at(F.split("relative", "/"), 1))
    more = [F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")] if hashes else []
    return rows.select("path", "relative", album.alias("album"), "mime", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *more)


def _literal(text: str) -> str:
    """A literal within a regular expression."""
    return r"\Q" + text + r"\E"


def since(rows: DataFrame, modified: str, mark) -> DataFrame:
    """Rows after a high-water mark (all of them if it is None); their greatest value is the next mark."""
    return rows if mark is None else rows.where(F.col(modified) > F.lit(mark))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A Parquet, ORC, JSON or CSV table. CSV and JSON need a schema, so that no pass is spent on guessing it."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_by_group(df: DataFrame, path: str, group: str, order: list[str]) -> None:
    """Replaces the groups present in `df` only; files are sorted, so that time filters prune row groups."""
    df.repartition(group).sortWithinPartitions(group, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def vector_of(column: Column) -> Column:
    """A vector from text such as "[0.1, 0.2]", as floats."""
    return F.from_json(column.cast("string"), "array<float>")


def gps_of_iso6709(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of "+59.9227+010.7575/"; null for (0, 0) and what doesn't parse."""
    pattern = r"^([+-]\d{1,3}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)"
    lat, lon = (F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double") for i in (1, 2))
    known = ~((lat == 0) & (lon == 0))
    return F.when(known, lat), F.when(known, lon)


def frame_times(duration_s: Column) -> Column:
    """Seconds at which a video's frames are sampled: up to eight, in the middles of equal parts."""
    n = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(duration_s).cast("int")))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) / n * duration_s)
