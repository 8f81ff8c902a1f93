"""Geo sets: sorted sets whose score is a 52-bit geohash. Requests: (key, member, lon, lat)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo


def geoadd(requests: DataFrame) -> DataFrame:
    """(key, member, score) rows; positions outside the limits have no row."""
    rows = requests.select("key", "member", geo.geo_score(F.col("lon"), F.col("lat")).cast("double").alias("score"))
    return rows.where(F.col("score").isNotNull())


def geopos(state: DataFrame) -> DataFrame:
    found = state.withColumn("_point", geo.geo_point(F.col("score").cast("long")))
    return found.select(*state.columns, F.col("_point.lon").alias("lon"), F.col("_point.lat").alias("lat"))


def geohash(state: DataFrame) -> DataFrame:
    return state.withColumn("geohash", geo.geohash_string(F.col("score").cast("long")))


def geodist(pairs: DataFrame, state: DataFrame, unit: str = "m") -> DataFrame:
    """(key, a, b) pairs with ``dist``; null where a member is missing."""
    own = geopos(state).select("key", "member", "lon", "lat")
    a = own.select("key", F.col("member").alias("a"), F.col("lon").alias("_x1"), F.col("lat").alias("_y1"))
    b = own.select("key", F.col("member").alias("b"), F.col("lon").alias("_x2"), F.col("lat").alias("_y2"))
    joined = pairs.join(a, ["key", "a"], "left").join(b, ["key", "b"], "left")
    return joined.withColumn("dist", geo.geo_dist(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2"), unit)).drop("_x1", "_y1", "_x2", "_y2")


def _inside(lon: Column, lat: Column, x: Column, y: Column, width: float, height: float) -> Column:
    return (geo.EARTH * F.abs(F.radians(y) - F.radians(lat)) <= height / 2) & (geo.geo_dist(lon, y, x, y) <= width / 2)


def geosearch(state: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, descending: bool = False) -> DataFrame:
    """(key, member, score, lon, lat, dist) inside a circle or box.

    At most nine score intervals go to the scan as range predicates; the exact shape is tested behind them. With a
    count, each key gives its nearest (or farthest) members.
    """
    size = geo.UNITS[unit]
    reach = radius * size if radius is not None else None
    width, height = (box[0] * size, box[1] * size) if box else (0.0, 0.0)
    near = state.where(geo.in_intervals(F.col("score"), geo.areas(lon, lat, reach, width, height)))
    a, b = F.lit(lon), F.lit(lat)

    def facts(x, y):
        dist = geo.geo_dist(a, b, x, y, unit)
        return [dist.alias("dist"), ((dist <= radius) if radius is not None else _inside(a, b, x, y, width, height)).alias("inside")]

    own = near.withColumn("_point", geo.geo_point(F.col("score").cast("long"), facts)).where("_point.inside")
    own = own.select(*state.columns, F.col("_point.lon").alias("lon"), F.col("_point.lat").alias("lat"), F.col("_point.dist").alias("dist"))
    if count is None:
        return own
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy(F.col("dist").desc() if descending else F.col("dist"), "member")
    return own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count).drop("_r")


def geosearch_many(centres: DataFrame, state: DataFrame, radius: float, unit: str = "m", step: int = 20) -> DataFrame:
    """Circles around many centres (req, lon, lat) of one radius: an equi-join on cells of a grid, then the exact test.

    The grid has at most 2^``step`` cells an axis, and as many as leave a cell no lower than the radius. A centre asks
    its row of cells and the two beside it, in each all cells between the circle's westernmost and easternmost
    meridians: three at the equator, more towards the poles, and whole rows where the circle holds a pole.
    """
    reach = radius * geo.UNITS[unit] / geo.EARTH
    high = math.radians(2 * geo.LAT_MAX)
    cells = 1 << max(0, min(step, math.floor(math.log2(high / reach)) if reach > 0 else step))
    row = lambda v: F.floor((v + geo.LAT_MAX) / (2 * geo.LAT_MAX) * cells).cast("int")
    column = lambda v: F.floor((v + geo.LON_MAX) / (2 * geo.LON_MAX) * cells).cast("long")
    own = geopos(state).withColumn("_cx", F.pmod(column(F.col("lon")), F.lit(cells)).cast("int")).withColumn("_cy", row(F.col("lat")))
    lat = F.radians("lat")
    polar = F.abs(lat) + reach * (1 + 1e-9) >= math.pi / 2
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(reach, math.pi / 2))) / F.cos(lat)))) * (1 + 1e-9))
    first = column(F.col("lon") - half)
    asked = centres.select("req", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), first.alias("_first"), F.least(column(F.col("lon") + half), first + (cells - 1)).alias("_last"))
    asked = asked.select("req", "_lon", "_lat", F.explode(F.sequence("_first", "_last")).alias("_x"))
    asked = asked.select("req", "_lon", "_lat", F.pmod("_x", F.lit(cells)).cast("int").alias("_cx"), F.explode(F.array(*[row(F.col("_lat")) + d for d in (-1, 0, 1)])).alias("_cy"))
    joined = asked.join(own, ["_cx", "_cy"])
    dist = geo.geo_dist(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"), unit)
    return joined.withColumn("dist", dist).where(F.col("dist") <= radius).select("req", "key", "member", "dist")
