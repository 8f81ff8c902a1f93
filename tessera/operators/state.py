"""State rules shared by all types: last write wins, upserts, deletes, liveness, the key directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import glob_match


def last_write(changes: DataFrame, ids: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """The last value of each id. A partial aggregate, so a hot key sends one row a task."""
    return changes.groupBy(*ids).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*ids, *[F.col(f"_v.{v}").alias(v) for v in values])


def first_write(changes: DataFrame, ids: list[str], values: list[str], order: str = "seq") -> DataFrame:
    return changes.groupBy(*ids).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*ids, *[F.col(f"_v.{v}").alias(v) for v in values])


def upsert(state: DataFrame, rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows replace the state's rows of the same ids."""
    return state.join(rows.select(*ids), ids, "left_anti").unionByName(rows)


def remove(state: DataFrame, ids_of: DataFrame, ids: list[str]) -> DataFrame:
    return state.join(ids_of.select(*ids), ids, "left_anti")


def remove_counted(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Replies of DEL and UNLINK: requests (seq, key), several keys a request -> (seq, removed); a key counts for the first request that names it."""
    owner = requests.groupBy("key").agg(F.min("seq").alias("_owner")).join(names.select("key").distinct(), "key", "left_semi")
    counts = owner.groupBy(F.col("_owner").alias("seq")).agg(F.count(F.lit(1)).alias("_n"))
    return requests.select("seq").distinct().join(counts, "seq", "left").select("seq", F.coalesce("_n", F.lit(0)).alias("removed"))


def average_ttl(state: DataFrame, now_ms: int, expire: str = "expire_at_ms") -> DataFrame:
    """One row: keys with a time to live that are alive, and the mean of what is left of it in milliseconds, exact."""
    own = state.where(F.col(expire) > now_ms)
    return own.agg(F.count(F.lit(1)).alias("expires"), F.coalesce(F.floor(F.avg(F.col(expire) - now_ms)), F.lit(0)).cast("long").alias("avg_ttl"))


def live(state: DataFrame, now_ms: int, expire: str = "expire_at_ms") -> DataFrame:
    """Rows that are alive at a fixed instant; the instant is a literal, the same for every table of a query."""
    return state.where(F.col(expire).isNull() | (F.col(expire) > now_ms))


def ttl(expire: Column, now_ms: int, unit: str = "s") -> Column:
    """TTL (rounded to seconds) or PTTL: -1 without a time to live, -2 for a missing or dead key."""
    left = expire - F.lit(now_ms)
    shown = F.floor((left + 500) / 1000) if unit == "s" else left
    return F.when(expire.isNull(), F.lit(-1).cast("long")).when(expire <= now_ms, F.lit(-2).cast("long")).otherwise(shown.cast("long"))


def expire_if(old: Column, new: Column, condition: str = "") -> Column:
    """Time to live after EXPIRE with NX, XX, GT or LT; no time to live counts as endless."""
    allowed = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (new > old), "LT": old.isNull() | (new < old)}[condition.upper()]
    return F.when(allowed, new).otherwise(old)


def directory(**stores: DataFrame) -> DataFrame:
    """(key, type, type_ord) over the stores, in their canonical order."""
    from tessera.plans.machine import TYPES

    out = None
    for kind, df in stores.items():
        part = df.select("key").distinct().select("key", F.lit(kind).alias("type"), F.lit(TYPES.index(kind)).alias("type_ord"))
        out = part if out is None else out.unionByName(part)
    return out


def keys(names: DataFrame, pattern: str) -> DataFrame:
    return names.where(glob_match(F.col("key"), pattern))


def scan(names: DataFrame, cursor: tuple[int, str] | None, count: int, pattern: str | None = None, kind: str | None = None) -> DataFrame:
    """A page behind a cursor (type_ord, key); the filters look at the page, as they must not change its bounds."""
    rest = names if cursor is None else names.where((F.col("type_ord") > cursor[0]) | ((F.col("type_ord") == cursor[0]) & (F.col("key") > cursor[1])))
    page = rest.orderBy("type_ord", "key").limit(count)
    if pattern:
        page = page.where(glob_match(F.col("key"), pattern))
    return page.where(F.col("type") == kind) if kind else page


def exists(requests: DataFrame, names: DataFrame) -> DataFrame:
    """The requests (repeated ones too) whose key exists."""
    return requests.join(names.select("key"), "key", "left_semi")


def type_of(requests: DataFrame, names: DataFrame) -> DataFrame:
    return requests.join(names.select("key", "type"), "key", "left").withColumn("type", F.coalesce("type", F.lit("none")))
