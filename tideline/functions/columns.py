"""Scalar functions as Column builders; all of them stay within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x, low=0.0, high=1.0) -> Column:
    """x within [low, high]; null stays null (least and greatest alone would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def round_half_up(x, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10.0**digits
    return F.floor(_c(x) * k + 0.5) / k


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of a reference point, on a plane."""
    x = F.radians(_c(lon) - _c(lon0)) * F.cos(F.radians(_c(lat0))) * EARTH_M
    return x, F.radians(_c(lat) - _c(lat0)) * EARTH_M


def centroid(lat, lon) -> tuple[Column, Column]:
    """Aggregates: latitude and longitude of the mean unit vector, which is safe at the antimeridian."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    x, y, z = F.avg(F.cos(la) * F.cos(lo)), F.avg(F.cos(la) * F.sin(lo)), F.avg(F.sin(la))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def jaccard(a, b) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(text) -> Column:
    """Set of trigrams of lower-cased words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    grams = F.transform(
        words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a, b) -> Column:
    a, b = trigrams(a), trigrams(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def time_of_day(hour) -> Column:
    h = _c(hour)
    return F.when((h >= 5) & (h < 11), "morning").when((h >= 11) & (h < 17), "afternoon").when((h >= 17) & (h < 22), "evening").otherwise("night")


def tier(confidence) -> Column:
    c = _c(confidence)
    return F.when(c >= 0.85, "confirmed").when(c >= 0.6, "probable").otherwise("uncertain")


def list_names(names, most: int = 3) -> Column:
    """"A", "A and B", "A, B and C", "A, B, C and 2 others"."""
    names = _c(names)
    n = F.size(names)
    rest = n - most
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(names, F.lit(0)))
        .when(n <= most, F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))
        .otherwise(
            F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" and "), rest.cast("string"), F.when(rest == 1, " other").otherwise(" others"))
        )
    )


def interest(*signals) -> Column:
    """interest_raw() to three places."""
    return round_half_up(interest_raw(*signals), 3)


def interest_raw(others, faces, contributors, specific, n_assets, hours, named, routine, mundane, n_videos, manual) -> Column:
    """Interest of an event from 0 to 1; manual is 1, -1 or null."""
    s = (
        F.lit(0.10) + 0.30 * clamp(_c(others) / 3) + 0.15 * clamp(_c(faces) / 2) + F.when(_c(contributors) >= 2, 0.10).otherwise(0.0)
        + 0.15 * clamp(specific) + 0.10 * clamp(_c(n_assets) / 24) + 0.05 * clamp(_c(hours) / 4) + F.when(_c(named), 0.05).otherwise(0.0)
        - 0.35 * clamp(routine) - 0.15 * clamp(mundane)
        - F.when((_c(n_assets) > 0) & (_c(n_videos) >= _c(n_assets)), 0.10).otherwise(0.0)
    )
    s = F.when(_c(manual) == 1, F.greatest(s, F.lit(0.9))).when(_c(manual) == -1, F.least(s, F.lit(0.1))).otherwise(s)
    return clamp(s)


def routine(n_events, avg_others, multi, demoted, promoted) -> Column:
    """How routine a place is, from 0 to 1."""
    n = _c(n_events)
    base = clamp((n - 2) / 8) * (1 - clamp(_c(avg_others) / 1.5)) * (1 - clamp(_c(multi) * 2))
    feedback = F.when(n > 0, (_c(demoted) - _c(promoted)) / n).otherwise(0.0)
    return round_half_up(clamp(base + 0.5 * feedback), 3)
