"""Geohash scores, distances and search areas.

The column functions are pure expressions, so Catalyst folds, pushes and compiles them. The scalar functions serve the
command interpreter and the driver, which turns a search shape into at most nine score intervals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, earth radius, units and alphabet.
LAT_MAX, LON_MAX, STEPS = 85.05112878, 180.0, 26
EARTH, MERCATOR = 6372797.560856, 20037726.37
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"

_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


# ---- column expressions


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: the optimiser may copy a column expression, not a lambda's variable."""
    return F.transform(F.array(value), use).getItem(0)


def _stepped(x: Column, steps: list[tuple[str, int, int]]) -> Column:
    """x after (x | x shifted) & mask for each (direction, shift, mask)."""

    def step(way, shift, mask):
        move = F.shiftleft if way == "left" else F.shiftright
        return lambda v: v.bitwiseOR(move(v, shift)).bitwiseAND(_long(mask))

    for one in steps:
        x = _bound(x, step(*one))
    return x


def _spread(x: Column) -> Column:
    """Bit i to bit 2i."""
    return _stepped(x, [("left", shift, mask) for shift, mask in _SPREAD])


def _gather(x: Column) -> Column:
    """Bit 2i to bit i."""
    masks = [mask for _, mask in _SPREAD[::-1]][1:] + [0xFFFFFFFF]
    return _stepped(x.bitwiseAND(_long(_SPREAD[-1][1])), [("right", 1 << i, mask) for i, mask in enumerate(masks)])


def _interleaved(lon: Column, lat: Column, lat_max: float) -> Column:
    y = ((lat + lat_max) / (2 * lat_max) * float(1 << STEPS)).cast("long")
    x = ((lon + LON_MAX) / (2 * LON_MAX) * float(1 << STEPS)).cast("long")
    return _spread(y).bitwiseOR(F.shiftleft(_spread(x), 1))


def geo_score(lon: Column, lat: Column) -> Column:
    """52-bit score of a position: latitude in the even bits, longitude in the odd ones; null outside the limits."""
    inside = (F.abs(lon) <= LON_MAX) & (F.abs(lat) <= LAT_MAX)
    return F.when(inside, _interleaved(lon, lat, LAT_MAX))


def _middle(cell: Column, limit: float) -> Column:
    """Middle of the cell of this number, on an axis from -limit to limit."""
    unit = float(1 << STEPS)
    low, high = -limit + cell / unit * (2 * limit), -limit + (cell + 1) / unit * (2 * limit)
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), (low + high) / 2))


def geo_lon(score: Column) -> Column:
    """Longitude of the middle of the score's cell."""
    return _bound(_gather(F.shiftright(score, 1)).cast("double"), lambda x: _middle(x, LON_MAX))


def geo_lat(score: Column) -> Column:
    return _bound(_gather(score).cast("double"), lambda y: _middle(y, LAT_MAX))


def geo_point(score: Column, more=None) -> Column:
    """Struct (lon, lat) of the score, with the fields that ``more(lon, lat)`` gives."""

    def point(s):
        place = F.struct(geo_lon(s).alias("lon"), geo_lat(s).alias("lat"))
        return _bound(place, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), *more(p["lon"], p["lat"]))) if more else place

    return _bound(score, point)


def geo_dist(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Haversine distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    u = F.sin((b - a) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    whole = 2.0 * EARTH * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))
    return F.when(v == 0.0, EARTH * F.abs(b - a)).otherwise(whole) / UNITS[unit]


def geohash_string(score: Column) -> Column:
    """The 11 characters of the standard geohash of the score's cell; the last is always 0."""

    def text(bits):
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(bits, 52 - 5 * (i + 1)).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(10)], F.lit("0"))

    return _bound(geo_point(score), lambda p: _bound(_interleaved(p["lon"], p["lat"], 90.0), text))


def in_intervals(score: Column, intervals: list[tuple[int, int]]) -> Column:
    """Predicate that reaches the scan: the score lies in one of the [low, high) intervals."""
    out = F.lit(False)
    for low, high in intervals:
        out = out | ((score >= float(low)) & (score < float(high)))
    return out


# ---- scalars


def _bits(x: int) -> int:
    for shift, mask in _SPREAD:
        x = (x | x << shift) & mask
    return x


def _unbits(x: int) -> int:
    x &= _SPREAD[-1][1]
    for shift, mask in [(1, _SPREAD[3][1]), (2, _SPREAD[2][1]), (4, _SPREAD[1][1]), (8, _SPREAD[0][1]), (16, 0xFFFFFFFF)]:
        x = (x | x >> shift) & mask
    return x


def encode(lon: float, lat: float, steps: int = STEPS, lat_max: float = LAT_MAX) -> int:
    scale = 1 << steps
    y, x = int((lat + lat_max) / (2 * lat_max) * scale), int((lon + LON_MAX) / (2 * LON_MAX) * scale)
    return _bits(y & 0xFFFFFFFF) | _bits(x & 0xFFFFFFFF) << 1


def box(bits: int, steps: int) -> tuple[float, float, float, float]:
    """Longitude and latitude limits of a cell: west, east, south, north."""
    scale, y, x = float(1 << steps), _unbits(bits), _unbits(bits >> 1)
    return (-LON_MAX + x / scale * 360, -LON_MAX + (x + 1) / scale * 360, -LAT_MAX + y / scale * (2 * LAT_MAX), -LAT_MAX + (y + 1) / scale * (2 * LAT_MAX))


def decode(score: float) -> tuple[float, float]:
    west, east, south, north = box(int(score), STEPS)
    return max(-LON_MAX, min(LON_MAX, (west + east) / 2)), max(-LAT_MAX, min(LAT_MAX, (south + north) / 2))


def distance(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    v = math.sin((math.radians(lon2) - math.radians(lon1)) / 2)
    if v == 0:
        return EARTH * abs(b - a)
    u = math.sin((b - a) / 2)
    return 2 * EARTH * math.asin(math.sqrt(u * u + math.cos(a) * math.cos(b) * v * v))


def string(score: float) -> str:
    lon, lat = decode(score)
    bits = encode(lon, lat, STEPS, 90.0)
    return "".join(ALPHABET[bits >> 52 - 5 * (i + 1) & 31] for i in range(10)) + "0"


def within(lon: float, lat: float, plon: float, plat: float, radius: float | None, width: float, height: float) -> float | None:
    """Distance of a point that lies in the circle or box around (lon, lat), else None."""
    d = distance(lon, lat, plon, plat)
    if radius is not None:
        return d if d <= radius else None
    if EARTH * abs(math.radians(plat) - math.radians(lat)) > height / 2 or distance(lon, plat, plon, plat) > width / 2:
        return None
    return d


def areas(lon: float, lat: float, radius: float | None, width: float, height: float) -> list[tuple[int, int]]:
    """Score intervals [low, high) that cover a shape: centre, N, S, E, W, NE, NW, SE, SW without those it cannot reach."""
    half_w, half_h = (radius, radius) if radius is not None else (width / 2, height / 2)
    reach = radius if radius is not None else math.hypot(half_w, half_h)
    d_lat = math.degrees(half_h / EARTH)
    south, north = lat - d_lat, lat + d_lat
    widest = max((abs(x) for x in (south, north)), default=0)
    d_lon = math.degrees(half_w / EARTH / max(1e-12, math.cos(math.radians(min(widest, 89.999999)))))
    west, east = lon - d_lon, lon + d_lon
    steps = STEPS
    if reach > 0:
        steps, r = 1, reach
        while r < MERCATOR:
            r *= 2
            steps += 1
        steps -= 2
        steps -= (abs(lat) > 66) + (abs(lat) > 80)
        steps = max(1, min(STEPS, steps))
    while True:
        scale = 1 << steps
        centre = encode(lon, lat, steps)
        y, x = _unbits(centre), _unbits(centre >> 1)
        y, x = min(y, scale - 1), min(x, scale - 1)
        cell = lambda dx, dy: _bits((y + dy) % scale) | _bits((x + dx) % scale) << 1
        edge = min(distance(lon, lat, lon, box(cell(0, 1), steps)[3]), distance(lon, lat, lon, box(cell(0, -1), steps)[2]), distance(lon, lat, box(cell(1, 0), steps)[1], lat), distance(lon, lat, box(cell(-1, 0), steps)[0], lat))
        if steps == 1 or edge >= reach:
            break
        steps -= 1
    w, e, s, n = box(cell(0, 0), steps)
    spots = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, 1), (1, -1), (-1, -1)]
    if steps >= 2:
        spots = [(dx, dy) for dx, dy in spots if not (dy == -1 and s < south) and not (dy == 1 and n > north) and not (dx == -1 and w < west) and not (dx == 1 and e > east)]
    shift, out = 2 * (STEPS - steps), []
    for dx, dy in spots:
        low = cell(dx, dy) << shift
        if (low, low + (1 << shift)) not in out:
            out.append((low, low + (1 << shift)))
    return out
