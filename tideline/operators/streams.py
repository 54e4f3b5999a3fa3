"""Request coalescing and the clean-up of arrivals, in batch form; tideline.streaming has the incremental forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000


def coalesce_jobs(jobs: DataFrame, key: str, us: str, person: str, priority: str, debounce_us: int = MINUTE_US, pad_us: int = 6 * HOUR_US) -> DataFrame:
    """One pending job per key: latest start, highest priority, widest range; a person only if all requests name it."""
    return jobs.groupBy(key).agg(
        (F.max(us) + debounce_us).alias("run_after_us"),
        (F.min(us) - pad_us).alias("from_us"),
        (F.max(us) + pad_us).alias("to_us"),
        F.max(priority).alias("priority"),
        F.when((F.min(person) == F.max(person)) & (F.count(person) == F.count("*")), F.max(person)).alias("person"),
        F.count("*").alias("n_requests"),
    )


def queue_depths(jobs: DataFrame, kind: str, status: str) -> DataFrame:
    """Ready, running and parked jobs of each kind."""
    return jobs.groupBy(kind).agg(*(F.count_if(F.col(status) == s).alias(name) for s, name in (("O", "ready"), ("P", "running"), ("F", "parked"))))


def backoff_minutes(attempts):
    """Minutes until a failed job runs again; null once it is parked after five attempts."""
    return F.when(attempts < 5, attempts * attempts)
