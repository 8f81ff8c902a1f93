"""SQL names for the sketches, geo and text functions: ``register(spark)`` makes them temporary functions of a session.

Geo functions are SQL expressions, which Catalyst inlines. Sketch builders are table-side: ``hll_sketch`` and
``cms_sketch`` are grouped aggregates that give the binary image of the exact sketch, which the commands can restore;
for keys with very many rows use the row forms in ``tessera.operators.sketches``, which fold before the shuffle. Spark
takes such aggregates in a query of their own, not beside built-in ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType

from tessera.functions import geo, sketches, text
from tessera.functions.hashing import as_bytes

# Mean earth radius and units stand in the geo module.
_GEO = {
    "geo_dist": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", f"2 * {geo.EARTH} * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))"),
}


def _each(series: pd.Series, of) -> pd.Series:
    return series.map(lambda v: None if v is None or v is pd.NA else of(v))


def _hll_sketch(items: pd.Series) -> bytes:
    own = sketches.Hll()
    own.add(as_bytes(items.dropna().tolist()))
    return own.pack()


def _hll_merge(images: pd.Series) -> bytes:
    own = sketches.Hll()
    for image in images.dropna():
        own.merge(sketches.Hll.unpack(bytes(image)))
    return own.pack()


def _hll_estimate(images: pd.Series) -> pd.Series:
    return _each(images, lambda x: sketches.Hll.unpack(bytes(x)).count())


def _cms_sketch(items: pd.Series, counts: pd.Series, widths: pd.Series, depths: pd.Series) -> bytes:
    own = sketches.Cms(int(widths.iloc[0]), int(depths.iloc[0]))
    known = items.notna()
    names, n = as_bytes(items[known].tolist()), counts[known].to_numpy(np.int64)
    at = sketches.cells(names, own.width, own.depth)
    for row in range(own.depth):
        total = np.bincount(at[row], n, own.width)
        own.table[row] = np.minimum(total, sketches.U32).astype(np.uint32)
    own.total = int(n.sum())
    return own.pack()


def _cms_estimate(images: pd.Series, items: pd.Series) -> pd.Series:
    return pd.Series([None if i is None or x is None else sketches.Cms.unpack(bytes(i)).count(as_bytes([x])[0]) for i, x in zip(images, items, strict=True)], dtype="Int64")


def _bloom_sketch(items: pd.Series, capacities: pd.Series, errors: pd.Series) -> bytes:
    own = sketches.Bloom(int(capacities.iloc[0]), float(errors.iloc[0]), 2)
    for item in as_bytes(sorted(set(items.dropna()))):
        own.add(item)
    return own.pack()


def _bloom_has(images: pd.Series, items: pd.Series) -> pd.Series:
    return pd.Series([None if i is None or x is None else sketches.Bloom.unpack(bytes(i)).has(as_bytes([x])[0]) for i, x in zip(images, items, strict=True)], dtype="boolean")


def _geo_score(lon: pd.Series, lat: pd.Series) -> pd.Series:
    lon, lat = lon.astype("float64"), lat.astype("float64")
    inside = (lon.abs() <= geo.LON_MAX) & (lat.abs() <= geo.LAT_MAX)
    return pd.Series([geo.encode(x, y) if ok else None for x, y, ok in zip(lon, lat, inside, strict=True)], dtype="Int64")


def _geo_lon(score: pd.Series) -> pd.Series:
    return _each(score, lambda s: geo.decode(s)[0])


def _geo_lat(score: pd.Series) -> pd.Series:
    return _each(score, lambda s: geo.decode(s)[1])


def _geo_hash(score: pd.Series) -> pd.Series:
    return _each(score, geo.string)


def _glob(values: pd.Series, patterns: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or p is None else bool(text.glob_regex(p.encode()).match(v.encode())) for v, p in zip(values, patterns, strict=True)], dtype="boolean")


def _lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else len(text.lcs(x.encode(), y.encode())[0]) for x, y in zip(a, b, strict=True)], dtype="Int64")


#: Name, function, type of the result.
FUNCTIONS = [
    ("hll_sketch", _hll_sketch, BinaryType()), ("hll_merge", _hll_merge, BinaryType()), ("hll_estimate", _hll_estimate, LongType()), ("cms_sketch", _cms_sketch, BinaryType()), ("cms_estimate", _cms_estimate, LongType()),
    ("bloom_sketch", _bloom_sketch, BinaryType()), ("bloom_has", _bloom_has, BooleanType()), ("geo_score", _geo_score, LongType()), ("geo_lon", _geo_lon, DoubleType()), ("geo_lat", _geo_lat, DoubleType()), ("geo_hash", _geo_hash, StringType()),
    ("glob_match", _glob, BooleanType()), ("lcs_length", _lcs_length, LongType()),
]


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to SQL; gives their names."""
    for name, (arguments, result, body) in _GEO.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, run, kind in FUNCTIONS:
        spark.udf.register(name, F.pandas_udf(run, kind))
    return [*_GEO, *(name for name, *_ in FUNCTIONS)]
