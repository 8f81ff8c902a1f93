"""Resolution of not-modified revisit records.

Each revisit takes the latest earlier full response of its canonical URL. Records are range-sorted by (URL, time), so a
URL that holds a third of all records spreads over many partitions; inside a partition the last response is carried
forward, and one row a partition says what its neighbours carry in. The validators must then agree (entity tag, else
modification date, else payload digest), and the headers that a 304 may update are merged over the stored ones.

Defined results: a revisit without an earlier response is "orphan"; one whose validators differ is "mismatch" and keeps
its own headers; one without validators is "unverified" and is resolved; a null URL matches nothing; null times come
first; records of one URL and time are ordered responses first, then by id; repeated revisits get a row each, and of
repeated responses either may be taken, as they agree; null headers are none; headers of any length are kept whole; extra
columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.staging import Staging, partitions, whole_id

# Headers that a 304 response may send (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
_CARRIED = ["_id", "_etag", "_modified", "_digest", "_headers"]
_ROW = "_url string, _time long, _revisit int, _id long, _etag string, _modified string, _digest string, _headers string"


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking parameters and closing slash; the host in lower case."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(u, "^[^/?]*(.*)$", 1), "([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def _carry(batches):
    """Each revisit with the last response of its URL in this partition; and the partition's last response."""
    schema = pa.schema([("_url", pa.string()), ("_revisit", pa.int32()), ("_id", pa.int64()), ("_etag", pa.string()), ("_modified", pa.string()), ("_digest", pa.string()), ("_headers", pa.string())])
    held: dict = {}
    part = TaskContext.get().partitionId()
    url = None
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            if r["_url"] != url:
                url, held = r["_url"], {}
            if not r["_revisit"]:
                held = {f"_r{k}": r[k] for k in _CARRIED} if url is not None else {}
            out.append(r | {"_part": part, "_known": bool(held)} | (held or {f"_r{k}": None for k in _CARRIED}))
        names = [*batch.schema.names, "_part", "_known", *[f"_r{k}" for k in _CARRIED]]
        types = [*batch.schema.types, pa.int32(), pa.bool_(), *[schema.field(k).type for k in _CARRIED]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records (record_id, url, time, type, etag, last_modified, digest, headers map) -> one row per revisit.

    type: "response" or "revisit". Result: record_id, canonical, response_id, status (resolved, unverified, mismatch,
    orphan), digest, headers.
    """
    spark = records.sparkSession
    staging = Staging(spark, "revisit")
    rows = records.select(
        canonical_url(F.col("url")).alias("_url"), F.col("time").cast("long").alias("_time"), (F.col("type") == "revisit").cast("int").alias("_revisit"), whole_id(records, "record_id").alias("_id"),
        F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"), F.col("digest").alias("_digest"), F.to_json("headers").alias("_headers"),
    )
    order = ["_url", "_time", "_revisit", "_id"]
    sorted_ = staging.put(rows, "records").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    carried = ", ".join(f"_r{k} {'long' if k == '_id' else 'string'}" for k in _CARRIED)
    placed = staging.put(sorted_.mapInArrow(_carry, f"{_ROW}, _part int, _known boolean, {carried}"), "placed")
    staging.drop("records")
    last = F.max_by(F.struct("_url", "_known", *[f"_r{k}" for k in _CARRIED]), F.struct(F.coalesce("_url", F.lit("")), F.coalesce("_time", F.lit(-(1 << 62))), "_revisit", "_id"))
    ends = placed.groupBy("_part").agg(last.alias("_e"), F.min(F.coalesce("_url", F.lit(""))).alias("_head"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("_e._known"), F.struct("_part", "_e")), ignorenulls=True).over(earlier)
    carry = ends.withColumn("_c", known).where(F.col("_c._e._url") == F.col("_head"))
    carry = carry.select(F.col("_part").alias("_p"), F.col("_head"), *[F.col(f"_c._e._r{k}").alias(f"_c{k}") for k in _CARRIED])
    joined = placed.where("_revisit = 1").join(carry, (F.col("_part") == F.col("_p")) & (F.col("_url") == F.col("_head")) & ~F.col("_known"), "left")
    r = {k: F.when(F.col("_known"), F.col(f"_r{k}")).otherwise(F.col(f"_c{k}")) for k in _CARRIED}
    own_tag, tag = (F.regexp_replace(x, "^W/", "") for x in (F.col("_etag"), r["_etag"]))
    both = [(own_tag, tag), (F.col("_modified"), r["_modified"]), (F.col("_digest"), r["_digest"])]
    agree = F.lit(None).cast("boolean")
    for mine, stored in reversed(both):
        agree = F.when(mine.isNotNull(), F.coalesce(mine == stored, F.lit(False))).otherwise(agree)
    status = F.when(r["_id"].isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    done = status.isin("resolved", "unverified")
    mine, stored = F.from_json("_headers", "map<string,string>"), F.from_json(r["_headers"], "map<string,string>")
    update = F.map_filter(mine, lambda k, v: F.lower(k).isin(PERMITTED))
    names = F.transform(F.coalesce(F.map_keys(update), F.array()), F.lower)
    merged = F.map_concat(F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(names, F.lower(k))), F.coalesce(update, F.create_map().cast("map<string,string>")))
    return joined.select(
        F.col("_id").alias("record_id"), F.col("_url").alias("canonical"), r["_id"].alias("response_id"), status.alias("status"),
        F.when(done, r["_digest"]).otherwise(F.col("_digest")).alias("digest"), F.when(done, merged).otherwise(mine).alias("headers"),
    )
