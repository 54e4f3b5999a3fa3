"""Places founded in time order: an item joins the nearest place within reach, or founds one where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import EARTH_M, haversine_m
from tideline.operators.graph import cut

REACH_M = 300.0
_CELL = ["cx", "cy", "cz"]


def _with_cells(df: DataFrame, lat: str, lon: str, side: float) -> DataFrame:
    """Cells of a grid through space: points within `side` of each other are in the same or touching cells, anywhere."""
    la, lo = F.radians(lat), F.radians(lon)
    axes = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    return df.withColumns({c: F.floor(F.lit(EARTH_M) * x / side) for c, x in zip(_CELL, axes)})


def _spread(df: DataFrame) -> DataFrame:
    """Each row in its own cell and in the 26 around it."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for c in _CELL:
        df = df.withColumn("_d", F.explode(steps)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    return df


def assign_places(items: DataFrame, group: str, key: str, order: str, lat: str, lon: str, existing: DataFrame | None = None, reach: float = REACH_M) -> DataFrame:
    """(key, place, distance_m, is_new): what a pass over a group's items by (order, key) gives, without such a pass.

    An item founds a place unless a place within reach exists by then; else it joins the nearest one (ties: smaller
    place). A new place has its founder's key. `existing` has (group, place, lat, lon, radius_m), with keys of places
    apart from those of items; its reach is radius_m, `reach` at least. Items without a position get no place.

    Founders are found in rounds. The earliest open item of a cell founds a place if no touching cell holds an earlier
    open one; then every open item in reach of a new place is settled. No pairs of items are formed: items meet places,
    of which a cell holds a few at most.
    """
    rows = items.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(group).alias("g"), F.col(key).alias("id"), F.col(order).alias("at"), F.col(lat).alias("lat"), F.col(lon).alias("lon")
    )
    side, held = reach, None
    if existing is not None:
        held = existing.select(F.col(group).alias("g"), F.col("place").alias("p_id"), F.lit(None).cast(rows.schema["at"].dataType).alias("p_at"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.greatest(F.lit(reach), "radius_m").alias("p_reach"))
        side = max(reach, held.agg(F.max("p_reach")).first()[0] or reach)
    points = cut(_with_cells(rows, "lat", "lon", side))
    in_reach = haversine_m("lat", "lon", "p_lat", "p_lon") <= F.col("p_reach")

    def uncovered(left: DataFrame, places: DataFrame) -> DataFrame:
        by_cell = _spread(_with_cells(places, "p_lat", "p_lon", side)).alias("p")
        same = (F.col("i.g") == F.col("p.g")) & in_reach
        for c in _CELL:
            same = same & (F.col(f"i.{c}") == F.col(f"p.{c}"))
        return cut(left.alias("i").join(by_cell, same, "left_anti"))

    left = uncovered(points, held) if held is not None else points
    places = held
    while not left.isEmpty():
        first = left.groupBy("g", *_CELL).agg(F.min(F.struct("at", "id", "lat", "lon")).alias("f"))
        lead = _spread(first).groupBy("g", *_CELL).agg(F.min("f").alias("lead"))
        new = first.join(lead, ["g", *_CELL]).where("f = lead")
        new = cut(new.select("g", F.col("f.id").alias("p_id"), F.col("f.at").alias("p_at"), F.col("f.lat").alias("p_lat"), F.col("f.lon").alias("p_lon"), F.lit(reach).alias("p_reach")))
        places = new if places is None else places.unionByName(new)
        left = uncovered(left, new)
    if places is None:
        return rows.select(F.col("id").alias(key), F.col("id").alias("place"), F.lit(0.0).alias("distance_m"), F.lit(True).alias("is_new"))
    by_cell = _spread(_with_cells(places, "p_lat", "p_lon", side))
    earlier = F.col("p_at").isNull() | (F.struct("p_at", "p_id") <= F.struct(F.col("at").alias("p_at"), F.col("id").alias("p_id")))
    met = points.join(by_cell, ["g", *_CELL]).where(in_reach & earlier)
    best = F.min(F.struct(haversine_m("lat", "lon", "p_lat", "p_lon").alias("m"), F.col("p_id").alias("p"), F.col("p_at").isNotNull().alias("new"))).alias("b")
    return met.groupBy("id").agg(best).select(F.col("id").alias(key), F.col("b.p").alias("place"), F.col("b.m").alias("distance_m"), F.col("b.new").alias("is_new"))
