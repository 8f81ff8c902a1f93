"""Registered queries of the keyed operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geo, hashes, lists, sets, sketches, state, strings, zsets
from tessera.plans.ranking import distributed_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed instant of the expiry queries, in epoch milliseconds.
NOW = 1_704_500_000_000


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _board(spark, d):
    """Sorted sets: customers of each nation by balance."""
    return _t(spark, d, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


_BOARD = "(SELECT 'nation:' || c_nationkey AS key, c_name AS member, c_acctbal AS score FROM customer)"


# ---- sorted sets


@query(f"SELECT key, rank, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM {_BOARD}) WHERE rank <= 9")
def zset_top10_by_nation(spark, d):
    return zsets.zrange(_board(spark, d), 0, 9, reverse=True).select("key", "rank", "member", "score")


@query(f"SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM {_BOARD}")
def zset_rank(spark, d):
    return zsets.zrank(_board(spark, d)).select("key", "member", "rank")


@query("SELECT 'all' AS key, c_name AS member, row_number() OVER (ORDER BY c_acctbal, c_name) - 1 AS rank FROM customer")
def zset_rank_one_hot_key(spark, d):
    own = _board(spark, d).withColumn("key", F.lit("all"))
    return distributed_rank(own, ["key"], ["score", "member"]).select("key", "member", "rank")


@query(f"SELECT key, rank, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM {_BOARD}) WHERE rank >= greatest(0, n - 5) AND rank <= n - 2")
def zset_range_from_end(spark, d):
    return zsets.zrange(_board(spark, d), -5, -2).select("key", "rank", "member")


@query(f"SELECT key, count(*) AS members FROM {_BOARD} WHERE score > 0 AND score <= 5000 GROUP BY key")
def zset_count_by_score(spark, d):
    return zsets.zcount(_board(spark, d), 0.0, 5000.0, open_low=True)


@query(f"SELECT key, place, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS place FROM {_BOARD} WHERE score >= 1000 AND score < 8000) WHERE place >= 3 AND place < 10")
def zset_range_by_score_limit(spark, d):
    return zsets.zrange_by_score(_board(spark, d), 1000.0, 8000.0, open_high=True, offset=3, count=7).select("key", "place", "member", "score")


@query(f"SELECT key, place, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS place FROM {_BOARD} WHERE score >= 2000 AND score <= 9000) WHERE place < 4")
def zset_revrange_by_score(spark, d):
    return zsets.zrange_by_score(_board(spark, d), 2000.0, 9000.0, reverse=True, count=4).select("key", "place", "member")


@query(f"SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM {_BOARD}) WHERE r <= 2")
def zset_popmin(spark, d):
    return zsets.zpop(_board(spark, d), 2)[0].select("key", "member", "score")


@query(f"SELECT key, count(*) AS members FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS r FROM {_BOARD}) WHERE r > 3 GROUP BY key")
def zset_popmax_rest(spark, d):
    return zsets.zcard(zsets.zpop(_board(spark, d), 3, highest=True)[1])


@query("SELECT 'p' || (l_partkey % 100) AS key, 's' || l_suppkey AS member, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS score FROM lineitem GROUP BY ALL")
def zset_incrby_revenue(spark, d):
    rows = _t(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 100).alias("key"), F.concat(F.lit("s"), "l_suppkey").alias("member"), F.col("l_quantity").cast("long").alias("delta"))
    return zsets.zincrby(spark.createDataFrame([], "key string, member string, score double"), rows)


_ORDERS = "(SELECT o_orderkey AS seq, 'cust:' || (o_custkey % 500) AS key, o_orderpriority AS member, o_totalprice AS score FROM orders)"


def _order_changes(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("cust:"), F.col("o_custkey") % 500).alias("key"), F.col("o_orderpriority").alias("member"), F.col("o_totalprice").alias("score"))


@query(f"SELECT key, member, arg_max(score, seq) AS score FROM {_ORDERS} GROUP BY key, member")
def zset_zadd_last_write(spark, d):
    return zsets.zadd(spark.createDataFrame([], "key string, member string, score double"), _order_changes(spark, d))


@query(f"SELECT key, member, arg_min(score, seq) AS score FROM {_ORDERS} GROUP BY key, member")
def zset_zadd_nx(spark, d):
    return zsets.zadd(spark.createDataFrame([], "key string, member string, score double"), _order_changes(spark, d), "NX")


@query(f"WITH b AS (SELECT key, member, arg_max(score, seq) AS score FROM {_ORDERS} WHERE seq % 2 = 0 GROUP BY key, member), c AS (SELECT key, member, arg_max(score, seq) AS score FROM {_ORDERS} WHERE seq % 2 = 1 GROUP BY key, member) SELECT b.key, b.member, coalesce(c.score, b.score) AS score FROM b LEFT JOIN c USING (key, member)")
def zset_zadd_xx(spark, d):
    empty, rows = spark.createDataFrame([], "key string, member string, score double"), _order_changes(spark, d)
    return zsets.zadd(zsets.zadd(empty, rows.where("seq % 2 = 0")), rows.where("seq % 2 = 1"), "XX")


@query(f"SELECT key, count(*) AS members FROM {_BOARD} GROUP BY key")
def zset_card(spark, d):
    return zsets.zcard(_board(spark, d))


@query(f"SELECT 'nation:' || s_nationkey AS key, 'Customer#' || s_suppkey AS member, score FROM supplier s LEFT JOIN {_BOARD} b ON b.key = 'nation:' || s_nationkey AND b.member = 'Customer#' || s_suppkey")
def zset_score_lookup(spark, d):
    asked = _t(spark, d, "supplier").select(F.concat(F.lit("nation:"), "s_nationkey").alias("key"), F.concat(F.lit("Customer#"), "s_suppkey").alias("member"))
    return zsets.zscore(asked, _board(spark, d))


@query(f"SELECT key, member FROM {_BOARD} WHERE member NOT LIKE '%7'")
def zset_rem(spark, d):
    own = _board(spark, d)
    return zsets.zrem(own, own.where(F.col("member").endswith("7"))).select("key", "member")


# ---- hashes


_HASH = "(SELECT o_orderkey AS seq, 'cust:' || o_custkey AS key, o_orderstatus AS field, o_orderpriority AS value, CAST(floor(o_totalprice) AS BIGINT) AS delta FROM orders)"


def _hash_changes(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("value"), F.floor("o_totalprice").alias("delta"))


def _no_hash(spark):
    return spark.createDataFrame([], "key string, field string, value string")


@query(f"SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS pairs FROM (SELECT key, field, arg_max(value, seq) AS value FROM {_HASH} GROUP BY key, field) GROUP BY key")
def hash_hgetall(spark, d):
    own = hashes.hgetall(hashes.hset(_no_hash(spark), _hash_changes(spark, d)))
    return own.select("key", F.array_join(F.transform(F.array_sort(F.map_entries("map")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("pairs"))


@query(f"SELECT key, field, sum(delta)::BIGINT AS value FROM {_HASH} GROUP BY key, field")
def hash_hincrby(spark, d):
    return hashes.hincrby(_no_hash(spark), _hash_changes(spark, d))


@query(f"SELECT seq, key, field, CAST(sum(delta) OVER (PARTITION BY key, field ORDER BY seq) AS BIGINT) AS reply FROM {_HASH}")
def hash_hincrby_replies(spark, d):
    return hashes.hincrby_running(_hash_changes(spark, d)).select("seq", "key", "field", "reply")


@query(f"SELECT key, field, arg_min(value, seq) AS value FROM {_HASH} GROUP BY key, field")
def hash_hsetnx(spark, d):
    return hashes.hsetnx(_no_hash(spark), _hash_changes(spark, d))


@query(f"SELECT key, count(DISTINCT field) AS fields FROM {_HASH} GROUP BY key")
def hash_hlen(spark, d):
    return hashes.hlen(hashes.hset(_no_hash(spark), _hash_changes(spark, d)))


@query(f"WITH h AS (SELECT key, field, arg_max(value, seq) AS value FROM {_HASH} GROUP BY key, field) SELECT key, field, value FROM (SELECT 'cust:' || c_custkey AS key, unnest(['O', 'X']) AS field FROM customer) r LEFT JOIN h USING (key, field)")
def hash_hmget(spark, d):
    asked = _t(spark, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.explode(F.array(F.lit("O"), F.lit("X"))).alias("field"))
    return hashes.hmget(asked, hashes.hset(_no_hash(spark), _hash_changes(spark, d)))


@query(f"SELECT key, count(DISTINCT field) AS fields FROM {_HASH} WHERE field <> 'F' GROUP BY key")
def hash_hdel(spark, d):
    own = hashes.hset(_no_hash(spark), _hash_changes(spark, d))
    return hashes.hlen(hashes.hdel(own, own.where("field = 'F'")))


@query(f"WITH h AS (SELECT DISTINCT key, field FROM {_HASH}) SELECT r.key, r.field, (h.key IS NOT NULL)::INT AS found FROM (SELECT 'cust:' || c_custkey AS key, 'O' AS field FROM customer) r LEFT JOIN h USING (key, field)")
def hash_hexists(spark, d):
    asked = _t(spark, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.lit("O").alias("field"))
    return hashes.hexists(asked, hashes.hset(_no_hash(spark), _hash_changes(spark, d)))


@query(f"SELECT key, string_agg(field, ',' ORDER BY field) AS fields FROM (SELECT DISTINCT key, field FROM {_HASH}) GROUP BY key")
def hash_hkeys(spark, d):
    own = hashes.hkeys(hashes.hset(_no_hash(spark), _hash_changes(spark, d)))
    return own.select("key", F.array_join(F.array_sort("fields"), ",").alias("fields"))


@query(f"WITH b AS (SELECT DISTINCT key, field FROM {_HASH} WHERE seq % 2 = 0), c AS (SELECT DISTINCT key, field FROM {_HASH} WHERE seq % 2 = 1) SELECT key, count(*) AS added FROM (SELECT * FROM c EXCEPT SELECT * FROM b) GROUP BY key")
def hash_hset_replies(spark, d):
    rows = _hash_changes(spark, d)
    return hashes.hset_replies(hashes.hset(_no_hash(spark), rows.where("seq % 2 = 0")), rows.where("seq % 2 = 1"))


# ---- sets


_SUPPLIERS = "(SELECT DISTINCT 'part:' || l_partkey AS key, 's' || l_suppkey AS member FROM lineitem)"


def _suppliers(spark, d):
    rows = _t(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("key"), F.concat(F.lit("s"), "l_suppkey").alias("member"))
    return sets.sadd(spark.createDataFrame([], "key string, member string"), rows)


@query(f"SELECT key, count(*) AS members FROM {_SUPPLIERS} GROUP BY key")
def set_scard(spark, d):
    return sets.scard(_suppliers(spark, d))


@query(f"SELECT r.key, r.member, (s.key IS NOT NULL)::INT AS found FROM (SELECT 'part:' || p_partkey AS key, unnest(['s1', 's2', 's3']) AS member FROM part) r LEFT JOIN {_SUPPLIERS} s USING (key, member)")
def set_smismember(spark, d):
    asked = _t(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("key"), F.explode(F.array(F.lit("s1"), F.lit("s2"), F.lit("s3"))).alias("member"))
    return sets.smismember(asked, _suppliers(spark, d))


@query(f"SELECT key, count(*) AS members FROM {_SUPPLIERS} WHERE member NOT LIKE '%1' GROUP BY key")
def set_srem(spark, d):
    own = _suppliers(spark, d)
    return sets.scard(sets.srem(own, own.where(F.col("member").endswith("1"))))


@query(f"SELECT key, string_agg(member, ',' ORDER BY member) AS members FROM {_SUPPLIERS} GROUP BY key")
def set_smembers(spark, d):
    return sets.smembers(_suppliers(spark, d)).select("key", F.array_join("members", ",").alias("members"))


@query("WITH a AS (SELECT DISTINCT 'part:' || l_partkey AS key, 's' || l_suppkey AS member FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT 'part:' || l_partkey AS key, 's' || l_suppkey AS member FROM lineitem WHERE l_linenumber > 2) SELECT key, count(*) AS added FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY key")
def set_sadd_replies(spark, d):
    rows = _t(spark, d, "lineitem").select("l_linenumber", F.concat(F.lit("part:"), "l_partkey").alias("key"), F.concat(F.lit("s"), "l_suppkey").alias("member"))
    first = rows.where("l_linenumber <= 2").select("key", "member").distinct()
    return sets.sadd_replies(first, rows.where("l_linenumber > 2"))


@query("WITH x AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f FROM lineitem) SELECT op, count(*) AS members FROM (SELECT 'union' AS op, s FROM (SELECT s FROM x WHERE f = 'A' UNION SELECT s FROM x WHERE f = 'N') UNION ALL SELECT 'inter', s FROM (SELECT s FROM x WHERE f = 'A' INTERSECT SELECT s FROM x WHERE f = 'N') UNION ALL SELECT 'diff', s FROM (SELECT s FROM x WHERE f = 'N' EXCEPT SELECT s FROM x WHERE f = 'Z')) GROUP BY op")
def set_algebra(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_suppkey").alias("s")).distinct()
    a, b, z = (rows.where(F.col("f") == x).select("s") for x in "ANZ")
    parts = [("union", sets.sunion(a, b)), ("inter", sets.sinter(a, b)), ("diff", sets.sdiff(b, z))]
    out = [df.agg(F.count(F.lit(1)).alias("members")).select(F.lit(op).alias("op"), "members") for op, df in parts]
    return out[0].union(out[1]).union(out[2]).where("members > 0")


@query(f"SELECT key, least(count(*), 2) AS popped, count(*) - least(count(*), 2) AS kept FROM {_SUPPLIERS} GROUP BY key")
def set_spop(spark, d):
    popped, rest = sets.spop(_suppliers(spark, d), 2)
    both = popped.select("key", F.lit(1).alias("p"), F.lit(0).alias("r")).union(rest.select("key", F.lit(0), F.lit(1)))
    return both.groupBy("key").agg(F.sum("p").alias("popped"), F.sum("r").alias("kept"))


@query()
def set_srandmember(spark, d):
    return sets.srandmember(_suppliers(spark, d), 3).union(sets.srandmember_repeats(_suppliers(spark, d), 2).select("key", "member"))


# ---- lists


_TURNS = "(SELECT conv_id AS key, turn AS pos, role AS value FROM conversations)"
_INDEXED = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM {_TURNS})"


def _turns(spark, d):
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value"))


@query(f"SELECT key, idx, value FROM {_INDEXED} WHERE idx >= 1 AND idx <= n - 2")
def list_lrange(spark, d):
    return lists.lrange(_turns(spark, d), 1, -2).select("key", "idx", "value")


@query(f"SELECT key, count(*) AS length FROM {_INDEXED} WHERE idx >= greatest(0, n - 3) GROUP BY key")
def list_ltrim(spark, d):
    return lists.llen(lists.lrange(_turns(spark, d), -3, -1))


@query(f"SELECT key, idx FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS r FROM {_INDEXED} WHERE value = 'user') WHERE r >= 2 AND r < 4")
def list_lpos(spark, d):
    return lists.lpos(_turns(spark, d), "user", rank=2, count=2)


@query(f"SELECT key, idx FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM {_INDEXED} WHERE value = 'user' AND idx >= n - 4) WHERE r = 1")
def list_lpos_from_tail(spark, d):
    return lists.lpos(_turns(spark, d), "user", rank=-1, maxlen=4)


@query(f"SELECT key, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS r FROM {_TURNS}) WHERE value <> 'assistant' OR r > 1")
def list_lrem(spark, d):
    return lists.lrem(_turns(spark, d), -1, "assistant")


@query(f"WITH f AS (SELECT key, min(idx) AS p FROM {_INDEXED} WHERE value = 'assistant' GROUP BY key), x AS (SELECT key, idx * 2 AS pos, value FROM {_INDEXED} UNION ALL SELECT key, p * 2 - 1, 'note' FROM f) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, value FROM x")
def list_linsert(spark, d):
    return lists.indexed(lists.linsert(_turns(spark, d), "assistant", "note")).select("key", "idx", "value")


@query("WITH l AS (SELECT conv_id AS key, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn DESC) AS l FROM conversations WHERE role = 'user' GROUP BY conv_id), r AS (SELECT conv_id AS key, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS r FROM conversations WHERE role <> 'user' GROUP BY conv_id) SELECT key, concat_ws(',', l, r) AS items FROM l FULL JOIN r USING (key)")
def list_lpush_rpush(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("turn").alias("seq"), F.col("conv_id").alias("key"), F.col("turn").cast("string").alias("value"), "role")
    empty = spark.createDataFrame([], "key long, pos long, value string")
    own = lists.push(lists.push(empty, rows.where("role = 'user'").drop("role"), left=True), rows.where("role <> 'user'").drop("role"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return own.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), ",").alias("items"))


@query(f"SELECT key, value FROM {_INDEXED} WHERE idx = n - 1")
def list_lindex(spark, d):
    return lists.lindex(_turns(spark, d), -1)


@query(f"SELECT key, pos, CASE WHEN idx = 1 THEN 'set' ELSE value END AS value FROM {_INDEXED}")
def list_lset(spark, d):
    return lists.lset(_turns(spark, d), 1, "set")


@query(f"SELECT key, idx AS pos, value FROM {_INDEXED} WHERE idx >= n - 2")
def list_rpop(spark, d):
    return lists.pop(lists.indexed(_turns(spark, d)).select("key", F.col("idx").alias("pos"), "value"), 2, left=False)[0]


@query("WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT CASE WHEN r <= 2 THEN conv_id + 1000000 ELSE conv_id END AS key, count(*) AS length, CAST(sum(turn) AS BIGINT) AS turns FROM x GROUP BY 1")
def list_lmovem(spark, d):
    own = _t(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("turn").alias("value"))
    pairs = own.select(F.col("key").alias("src")).distinct().withColumn("dst", F.col("src") + 1000000)
    return lists.lmove(own, pairs, left=True, to_left=False, n=2).groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.sum("value").alias("turns"))


@query(f"WITH r AS (SELECT c_custkey AS req, unnest([c_custkey * 3, c_custkey * 2, c_custkey]) AS key, unnest([1, 2, 3]) AS ord FROM customer), h AS (SELECT req, arg_min(key, ord) AS key FROM r WHERE key IN (SELECT key FROM {_TURNS}) GROUP BY req) SELECT h.req, h.key, x.value FROM h JOIN {_INDEXED} x ON x.key = h.key AND x.idx = 0")
def list_lmpop(spark, d):
    c = F.col("c_custkey")
    asked = _t(spark, d, "customer").select(c.alias("req"), F.posexplode(F.array(c * 3, c * 2, c)).alias("ord", "key"))
    return lists.lmpop(asked, _turns(spark, d), 1).select("req", "key", "value")


# ---- strings and counters


_EVENTS = "(SELECT event_id AS seq, 'user:' || user_id AS key, event_type AS value, CAST(floor(value) AS BIGINT) AS delta FROM events)"


def _event_changes(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"), F.floor("value").alias("delta"))


def _no_strings(spark):
    return spark.createDataFrame([], "key string, value string")


@query(f"SELECT key, arg_max(value, seq) AS value FROM {_EVENTS} GROUP BY key")
def string_set_lww(spark, d):
    return strings.set_(_no_strings(spark), _event_changes(spark, d))


@query(f"SELECT key, arg_min(value, seq) AS value FROM {_EVENTS} GROUP BY key")
def string_setnx(spark, d):
    return strings.setnx(_no_strings(spark), _event_changes(spark, d))


@query(f"WITH s AS (SELECT key, arg_max(value, seq) AS value FROM {_EVENTS} GROUP BY key) SELECT key, value FROM (SELECT 'user:' || c_custkey AS key FROM customer) r LEFT JOIN s USING (key)")
def string_mget(spark, d):
    asked = _t(spark, d, "customer").select(F.concat(F.lit("user:"), "c_custkey").alias("key"))
    return strings.mget(asked, strings.set_(_no_strings(spark), _event_changes(spark, d)))


@query(f"SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM {_EVENTS} GROUP BY key")
def string_append(spark, d):
    return strings.append(_no_strings(spark), _event_changes(spark, d))


@query(f"SELECT key, substr(value, 2, 3) AS part FROM (SELECT key, arg_max(value, seq) AS value FROM {_EVENTS} GROUP BY key)")
def string_getrange(spark, d):
    own = strings.set_(_no_strings(spark), _event_changes(spark, d))
    return own.select("key", strings.getrange(F.col("value"), 1, 3).cast("string").alias("part"))


@query(f"SELECT key, substr(value, 1, 1) || 'ZZ' || substr(value, 4) AS value FROM (SELECT key, arg_max(value, seq) AS value FROM {_EVENTS} GROUP BY key)")
def string_setrange(spark, d):
    own = strings.set_(_no_strings(spark), _event_changes(spark, d))
    return own.select("key", strings.setrange(F.col("value"), 1, b"ZZ").cast("string").alias("value"))


@query("SELECT p_partkey, strlen(p_name) AS bytes FROM part")
def string_strlen(spark, d):
    return _t(spark, d, "part").select("p_partkey", strings.strlen(F.col("p_name")).cast("long").alias("bytes"))


@query(f"SELECT seq, key, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM {_EVENTS}")
def string_getset(spark, d):
    return strings.getset(_event_changes(spark, d)).select("seq", "key", "value", "old")


@query(f"WITH b AS (SELECT DISTINCT key FROM {_EVENTS} WHERE seq % 5 = 0), x AS (SELECT *, seq // 3 AS tx FROM {_EVENTS} WHERE seq % 5 <> 0), r AS (SELECT DISTINCT tx FROM x WHERE key IN (SELECT key FROM b)) SELECT key, arg_max(value, seq) AS value FROM x WHERE tx NOT IN (SELECT tx FROM r) GROUP BY key UNION ALL SELECT key, arg_max(value, seq) FROM {_EVENTS} WHERE seq % 5 = 0 GROUP BY key")
def string_msetnx(spark, d):
    rows = _event_changes(spark, d)
    own = strings.set_(_no_strings(spark), rows.where("seq % 5 = 0"))
    return strings.msetnx(own, rows.where("seq % 5 <> 0").withColumn("tx", F.floor(F.col("seq") / 3)))


@query(f"SELECT seq, key, CAST(sum(delta) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS reply FROM {_EVENTS}")
def counter_incr_running(spark, d):
    return strings.incr_running(_event_changes(spark, d)).select("seq", "key", "reply")


@query(f"SELECT key, -sum(delta)::BIGINT AS value, false AS overflow FROM {_EVENTS} GROUP BY key")
def counter_decrby(spark, d):
    return strings.incr(_no_strings(spark), _event_changes(spark, d).withColumn("delta", -F.col("delta")))


_OPTIONED = f"(SELECT *, CASE seq % 3 WHEN 0 THEN 'NX' WHEN 1 THEN 'XX' END AS option FROM {_EVENTS})"
_APPLIED = f"""w AS (SELECT *, coalesce(max(CAST(option IS DISTINCT FROM 'XX' AS INT)) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS there FROM {_OPTIONED}),
a AS (SELECT *, CASE option WHEN 'NX' THEN NOT there WHEN 'XX' THEN there ELSE true END AS applied FROM w)"""


def _optioned(spark, d):
    turn = F.col("seq") % 3
    return strings.set_options(_no_strings(spark), _event_changes(spark, d).withColumn("option", F.when(turn == 0, "NX").when(turn == 1, "XX")))


@query(f"WITH {_APPLIED} SELECT seq, key, applied, last_value(CASE WHEN applied THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM a")
def string_set_options(spark, d):
    return _optioned(spark, d)[0]


@query(f"WITH {_APPLIED} SELECT key, arg_max(value, seq) AS value FROM a WHERE applied GROUP BY key")
def string_set_options_state(spark, d):
    return _optioned(spark, d)[1]


@query(f"SELECT key, arg_max(value, seq) AS value, {NOW} + 1000 * (1 + max(seq) % 100) AS expire_at_ms FROM {_EVENTS} GROUP BY key")
def string_setex(spark, d):
    rows = _event_changes(spark, d).withColumn("ttl_ms", 1000 * (1 + F.col("seq") % 100)).withColumn("ts_ms", F.lit(NOW))
    return strings.setex(spark.createDataFrame([], "key string, value string, expire_at_ms long"), rows)


@query(f"WITH s AS (SELECT key, arg_max(value, seq) AS value FROM {_EVENTS} WHERE seq % 2 = 0 GROUP BY key), r AS (SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM {_EVENTS} WHERE seq % 2 = 1) SELECT seq, r.key, CASE WHEN n = 1 THEN value END AS value FROM r LEFT JOIN s ON s.key = r.key")
def string_getdel(spark, d):
    rows = _event_changes(spark, d)
    return strings.getdel(rows.where("seq % 2 = 1").select("seq", "key"), strings.set_(_no_strings(spark), rows.where("seq % 2 = 0")))[0]


@query(f"WITH s AS (SELECT key, arg_max(value, seq) AS value FROM {_EVENTS} WHERE seq % 2 = 0 GROUP BY key), r AS (SELECT key, arg_max(CASE WHEN seq % 3 = 0 THEN NULL ELSE {NOW} + seq END, seq) AS e, max(seq) AS m FROM {_EVENTS} WHERE seq % 2 = 1 GROUP BY key) SELECT s.key, value, CASE WHEN m IS NULL THEN 5 WHEN m % 3 = 0 THEN NULL ELSE {NOW} + m END AS expire_at_ms FROM s LEFT JOIN r USING (key)")
def string_getex(spark, d):
    rows = _event_changes(spark, d)
    own = strings.set_(_no_strings(spark), rows.where("seq % 2 = 0")).withColumn("expire_at_ms", F.lit(5).cast("long"))
    asked = rows.where("seq % 2 = 1").select("seq", "key", F.when(F.col("seq") % 3 != 0, F.lit(NOW) + F.col("seq")).alias("expire_at_ms"))
    return strings.getex(asked, own)[1]


@query(f"SELECT key, CASE WHEN t % 4 = 0 THEN CAST(t // 4 AS VARCHAR) ELSE CASE WHEN t < 0 THEN '-' ELSE '' END || CAST(abs(t) // 4 AS VARCHAR) || CASE abs(t) % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END END AS value FROM (SELECT key, CAST(sum(delta) AS BIGINT) AS t FROM {_EVENTS} GROUP BY key)")
def string_incrbyfloat(spark, d):
    rows = _event_changes(spark, d).select("key", (F.col("delta").cast("decimal(20,2)") / 4).cast("string").alias("delta"))
    return strings.incrbyfloat(_no_strings(spark), rows)


@query("WITH n AS (SELECT DISTINCT 'part:' || p_partkey AS key FROM part), r AS (SELECT l_orderkey AS seq, 'part:' || l_partkey * 2 AS key FROM lineitem), o AS (SELECT key, min(seq) AS seq FROM r WHERE key IN (SELECT key FROM n) GROUP BY key), c AS (SELECT seq, count(*) AS n FROM o GROUP BY seq) SELECT seq, coalesce(n, 0) AS removed FROM (SELECT DISTINCT seq FROM r) LEFT JOIN c USING (seq)")
def del_replies(spark, d):
    asked = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.concat(F.lit("part:"), F.col("l_partkey") * 2).alias("key"))
    return state.remove_counted(asked, _t(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("key")))


# ---- keys and expiry


_TTL = f"(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE {NOW} + (event_id % 1000 - 500) * 777 END AS expire_at_ms, {NOW} + (event_id % 700) * 999 AS new_ms FROM events)"


def _ttls(spark, d):
    e = F.col("event_id")
    return _t(spark, d, "events").select("event_id", F.when(e % 3 == 0, F.lit(None)).otherwise(F.lit(NOW) + (e % 1000 - 500) * 777).cast("long").alias("expire_at_ms"), (F.lit(NOW) + (e % 700) * 999).alias("new_ms"))


@query(f"SELECT event_id, CASE WHEN expire_at_ms IS NULL THEN -1 WHEN expire_at_ms <= {NOW} THEN -2 ELSE CAST(floor((expire_at_ms - {NOW} + 500) / 1000) AS BIGINT) END AS ttl, CASE WHEN expire_at_ms IS NULL THEN -1 WHEN expire_at_ms <= {NOW} THEN -2 ELSE expire_at_ms - {NOW} END AS pttl FROM {_TTL}")
def ttl_remaining(spark, d):
    at = F.col("expire_at_ms")
    return _ttls(spark, d).select("event_id", state.ttl(at, NOW).alias("ttl"), state.ttl(at, NOW, "ms").alias("pttl"))


@query(f"SELECT event_id, CASE WHEN expire_at_ms IS NULL THEN new_ms ELSE expire_at_ms END AS nx, CASE WHEN expire_at_ms IS NOT NULL THEN new_ms END AS xx, CASE WHEN new_ms > expire_at_ms THEN new_ms ELSE expire_at_ms END AS gt, CASE WHEN expire_at_ms IS NULL OR new_ms < expire_at_ms THEN new_ms ELSE expire_at_ms END AS lt FROM {_TTL}")
def expire_nx_xx_gt_lt(spark, d):
    old, new = F.col("expire_at_ms"), F.col("new_ms")
    return _ttls(spark, d).select("event_id", *[state.expire_if(old, new, c).alias(c.lower()) for c in ("NX", "XX", "GT", "LT")])


@query(f"SELECT count(*) AS alive FROM {_TTL} WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW}")
def keys_alive(spark, d):
    return state.live(_ttls(spark, d), NOW).agg(F.count(F.lit(1)).alias("alive"))


@query(f"SELECT count(*) AS expires, coalesce(CAST(floor(avg(expire_at_ms - {NOW})) AS BIGINT), 0) AS avg_ttl FROM {_TTL} WHERE expire_at_ms > {NOW}")
def average_ttl(spark, d):
    return state.average_ttl(_ttls(spark, d), NOW)


@query(f"SELECT event_id, (expire_at_ms IS NOT NULL)::INT AS reply FROM {_TTL} WHERE expire_at_ms IS NULL OR expire_at_ms > {NOW}")
def persist(spark, d):
    return state.live(_ttls(spark, d), NOW).select("event_id", F.col("expire_at_ms").isNotNull().cast("int").alias("reply"))


_NAMES = "(SELECT c_name AS key, 'string' AS type, 0 AS type_ord FROM customer UNION ALL SELECT 'part:' || p_partkey, 'set', 2 FROM part UNION ALL SELECT 'nation:' || n_nationkey, 'zset', 1 FROM nation)"


def _names(spark, d):
    return state.directory(
        string=_t(spark, d, "customer").select(F.col("c_name").alias("key")),
        set=_t(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("key")),
        zset=_t(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("key")),
    )


@query(f"SELECT key, type FROM {_NAMES} WHERE key GLOB 'part:1?[0-4]*' OR key GLOB 'nation:*'")
def keys_glob(spark, d):
    own = _names(spark, d)
    return state.keys(own, "part:1?[0-4]*").union(state.keys(own, "nation:*")).select("key", "type")


@query(f"SELECT key, type FROM (SELECT * FROM {_NAMES} WHERE (type_ord, key) > (1, 'nation:3') ORDER BY type_ord, key LIMIT 50) WHERE key LIKE '%1%'")
def scan_page(spark, d):
    return state.scan(_names(spark, d), (1, "nation:3"), 50, pattern="*1*").select("key", "type")


@query(f"SELECT r.key FROM (SELECT 'part:' || l_partkey * 2 AS key FROM lineitem) r SEMI JOIN {_NAMES} n USING (key)")
def exists_multi(spark, d):
    asked = _t(spark, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey") * 2).alias("key"))
    return state.exists(asked, _names(spark, d))


@query(f"SELECT r.key, coalesce(n.type, 'none') AS type FROM (SELECT 'nation:' || c_custkey AS key FROM customer) r LEFT JOIN {_NAMES} n USING (key)")
def type_of(spark, d):
    return state.type_of(_t(spark, d, "customer").select(F.concat(F.lit("nation:"), "c_custkey").alias("key")), _names(spark, d))


@query(f"SELECT count(*) AS keys FROM {_NAMES}")
def dbsize(spark, d):
    return _names(spark, d).agg(F.count(F.lit(1)).alias("keys"))


# ---- geo: positions are made from customer keys by the same arithmetic on both sides


_LON, _LAT = "((c_custkey * 7919) % 3600) / 10.0 - 180.0 + 0.05", "((c_custkey * 104729) % 1700) / 10.0 - 85.0 + 0.05"


def _places(spark, d):
    c = F.col("c_custkey")
    return _t(spark, d, "customer").select(F.lit("all").alias("key"), F.col("c_name").alias("member"), ((c * 7919 % 3600) / 10.0 - 180.0 + 0.05).alias("lon"), ((c * 104729 % 1700) / 10.0 - 85.0 + 0.05).alias("lat"))


def _spread_sql(x: str) -> str:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = f"list_transform([{x}], lambda v: (v | (v << {shift})) & {mask})[1]"
    return x


_GEO = f"""
p AS (SELECT c_name AS member, CAST({_LON} AS DOUBLE) AS lon, CAST({_LAT} AS DOUBLE) AS lat FROM customer),
q AS (SELECT *, CAST(floor((lat + 85.05112878) / 170.10225756 * 67108864.0) AS BIGINT) AS y, CAST(floor((lon + 180.0) / 360.0 * 67108864.0) AS BIGINT) AS x FROM p),
s AS (SELECT *, {_spread_sql("y")} | ({_spread_sql("x")} << 1) AS score FROM q),
c AS (SELECT *, greatest(-180.0, least(180.0, -180.0 + (x + 0.5) / 67108864.0 * 360.0)) AS clon, -85.05112878 + (y + 0.5) / 67108864.0 * 170.10225756 AS clat FROM s),
r AS (SELECT *, 2 * 6372797.560856 * asin(sqrt(pow(sin((radians(clat) - radians(48.0)) / 2), 2) + cos(radians(48.0)) * cos(radians(clat)) * pow(sin((radians(clon) - radians(11.0)) / 2), 2))) AS dist FROM c)"""


@query(f"WITH {_GEO} SELECT member, score FROM s")
def geo_encode(spark, d):
    return geo.geoadd(_places(spark, d)).select("member", F.col("score").cast("long").alias("score"))


@query(f"WITH {_GEO} SELECT member, round(clon, 6) AS lon, round(clat, 6) AS lat FROM c")
def geo_pos(spark, d):
    return geo.geopos(geo.geoadd(_places(spark, d))).select("member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"WITH {_GEO} SELECT member, round(dist, 3) AS dist FROM r WHERE dist <= 3000000")
def geo_radius(spark, d):
    return geo.geosearch(geo.geoadd(_places(spark, d)), 11.0, 48.0, radius=3000.0, unit="km").select("member", F.round(F.col("dist") * 1000, 3).alias("dist"))


@query(f"WITH {_GEO} SELECT member, round(dist, 3) AS dist FROM r WHERE 6372797.560856 * abs(radians(clat) - radians(48.0)) <= 1000000 AND 2 * 6372797.560856 * asin(sqrt(pow(cos(radians(clat)) * sin((radians(clon) - radians(11.0)) / 2), 2))) <= 1500000")
def geo_box(spark, d):
    return geo.geosearch(geo.geoadd(_places(spark, d)), 11.0, 48.0, box=(3000.0, 2000.0), unit="km").select("member", F.round(F.col("dist") * 1000, 3).alias("dist"))


@query(f"WITH {_GEO} SELECT member FROM r WHERE dist <= 8000000 ORDER BY dist, member LIMIT 10")
def geo_nearest(spark, d):
    return geo.geosearch(geo.geoadd(_places(spark, d)), 11.0, 48.0, radius=8000.0, unit="km", count=10).select("member")


@query(f"WITH {_GEO} SELECT a.member AS a, b.member AS b, round(2 * 6372797.560856 * asin(sqrt(pow(sin((radians(b.clat) - radians(a.clat)) / 2), 2) + cos(radians(a.clat)) * cos(radians(b.clat)) * pow(sin((radians(b.clon) - radians(a.clon)) / 2), 2))) / 1609.34, 4) AS dist FROM customer k JOIN c a ON a.member = k.c_name JOIN customer k2 ON k2.c_custkey = k.c_custkey + 1 JOIN c b ON b.member = k2.c_name")
def geo_dist(spark, d):
    c = _t(spark, d, "customer")
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("b"))
    pairs = c.select("c_custkey", F.lit("all").alias("key"), F.col("c_name").alias("a")).join(after, "c_custkey").select("key", "a", "b")
    return geo.geodist(pairs, geo.geoadd(_places(spark, d)), "mi").select("a", "b", F.round("dist", 4).alias("dist"))


@query(f"""WITH {_GEO},
h AS (SELECT member, CAST(floor((clat + 90.0) / 180.0 * 67108864.0) AS BIGINT) AS hy, CAST(floor((clon + 180.0) / 360.0 * 67108864.0) AS BIGINT) AS hx FROM c),
b AS (SELECT member, {_spread_sql("hy")} | ({_spread_sql("hx")} << 1) AS bits FROM h)
SELECT member, array_to_string(list_transform(range(0, 10), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((bits >> (52 - 5 * (i + 1))) & 31) + 1 AS BIGINT), 1)), '') || '0' AS geohash FROM b""")
def geo_hash(spark, d):
    return geo.geohash(geo.geoadd(_places(spark, d))).select("member", "geohash")


@query(f"WITH {_GEO} SELECT o.s_suppkey AS req, c.member FROM supplier o JOIN c ON 2 * 6372797.560856 * asin(sqrt(pow(sin((radians(c.clat) - radians((o.s_suppkey * 31) % 120 - 60.0)) / 2), 2) + cos(radians((o.s_suppkey * 31) % 120 - 60.0)) * cos(radians(c.clat)) * pow(sin((radians(c.clon) - radians((o.s_suppkey * 53) % 340 - 170.0)) / 2), 2))) <= 300000")
def geo_many_centres(spark, d):
    k = F.col("s_suppkey")
    centres = _t(spark, d, "supplier").select(k.alias("req"), (k * 53 % 340 - 170.0).alias("lon"), (k * 31 % 120 - 60.0).alias("lat"))
    return geo.geosearch_many(centres, geo.geoadd(_places(spark, d)), 300.0, "km", step=5).select("req", "member")


# ---- sketches over eight-character items


_ITEM = "printf('%08d', l_suppkey * 131 + l_partkey)"


def _items(spark, d):
    return _t(spark, d, "lineitem").select(F.concat(F.lit("flag:"), "l_returnflag").alias("key"), F.format_string("%08d", F.col("l_suppkey") * 131 + F.col("l_partkey")).alias("item"), F.lit(1).cast("long").alias("n"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


def _mul(x: str, by: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {by}) % 18446744073709551616 AS UBIGINT)"


def _add(x: str, y: str) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) + CAST({y} AS UHUGEINT)) % 18446744073709551616 AS UBIGINT)"


def _rot(x: str, r: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {1 << r}) % 18446744073709551616 + CAST({x} AS UHUGEINT) // {1 << (64 - r)} AS UBIGINT)"


def _hash128_sql(items: str, seed: int) -> str:
    """CTEs m0..m9 over distinct 8-character items: both 64-bit halves as a and b."""
    word = " + ".join(f"CAST(ascii(substr(item, {i + 1}, 1)) AS UHUGEINT) * {1 << 8 * i}" for i in range(8))
    mixed = lambda v: f"xor({v}, {v} >> 33)"
    return f"""m0 AS (SELECT DISTINCT item, CAST({word} AS UBIGINT) AS k FROM {items}),
m1 AS (SELECT item, {_mul("k", 0x87C37B91114253D5)} AS k FROM m0),
m2 AS (SELECT item, {_rot("k", 31)} AS k FROM m1),
m3 AS (SELECT item, xor(xor(CAST({seed} AS UBIGINT), {_mul("k", 0x4CF5AD432745937F)}), CAST(8 AS UBIGINT)) AS a, xor(CAST({seed} AS UBIGINT), CAST(8 AS UBIGINT)) AS b FROM m2),
m4 AS (SELECT item, {_add("a", "b")} AS a, b FROM m3),
m5 AS (SELECT item, a, {_add("b", "a")} AS b FROM m4),
m6 AS (SELECT item, {_mul(mixed("a"), 0xFF51AFD7ED558CCD)} AS a, {_mul(mixed("b"), 0xFF51AFD7ED558CCD)} AS b FROM m5),
m7 AS (SELECT item, {_mul(mixed("a"), 0xC4CEB9FE1A85EC53)} AS a, {_mul(mixed("b"), 0xC4CEB9FE1A85EC53)} AS b FROM m6),
m8 AS (SELECT item, {_add(mixed("a"), mixed("b"))} AS a, {mixed("b")} AS b FROM m7),
m9 AS (SELECT item, a, {_add("b", "a")} AS b FROM m8)"""


_LINES = f"(SELECT 'flag:' || l_returnflag AS key, {_ITEM} AS item FROM lineitem)"
_HLL = f"""WITH l AS (SELECT * FROM {_LINES}), {_hash128_sql("l", 0xADC83B19)},
g AS (SELECT item, CAST(a & 16383 AS INT) AS reg, CAST(a >> 14 AS BIGINT) | 1125899906842624 AS rest FROM m9),
e AS (SELECT item, reg, CAST(round(log2(rest & (-rest))) AS INT) + 1 AS rank FROM g)"""


@query(f"{_HLL} SELECT key, reg, max(rank) AS rank FROM l JOIN e USING (item) GROUP BY key, reg")
def hll_registers(spark, d):
    return sketches.hll_registers(_items(spark, d))


@query(f"{_HLL} SELECT reg, max(rank) AS rank FROM l JOIN e USING (item) WHERE key <> 'flag:R' GROUP BY reg")
def hll_pfmerge(spark, d):
    regs = sketches.hll_registers(_items(spark, d)).where("key <> 'flag:R'")
    return sketches.hll_merge(regs, F.lit("both")).select("reg", "rank")


_SIGMA = "(x + list_sum([pow(x, pow(2, k)) * pow(2, k - 1) for k in range(1, 40)]))"
_TAU = "(CASE WHEN t = 0 OR t = 1 THEN 0 ELSE (1 - t - list_sum([pow(1 - pow(t, pow(0.5, k)), 2) * pow(0.5, k) for k in range(1, 60)])) / 3 END)"


@query(f"""{_HLL}, r AS (SELECT key, reg, max(rank) AS rank FROM l JOIN e USING (item) GROUP BY key, reg),
f AS (SELECT key, (16384 - count(*)) / 16384.0 AS x, (16384 - count(*) FILTER (rank = 51)) / 16384.0 AS t, coalesce(sum(pow(2, -rank)) FILTER (rank <= 50), 0) AS s FROM r GROUP BY key)
SELECT key, CAST(floor(16384.0 * 16384.0 / (2 * ln(2)) / (16384 * {_TAU} * pow(2, -50) + s + 16384 * {_SIGMA}) + 0.5) AS BIGINT) AS estimate FROM f""")
def hll_pfcount(spark, d):
    return sketches.hll_estimate(sketches.hll_registers(_items(spark, d)))


_IN_ORDER = f"(SELECT l_orderkey * 8 + l_linenumber AS seq, 'flag:' || l_returnflag AS key, {_ITEM} AS item, 1 AS n FROM lineitem)"


@query(f"""{_HLL}, p AS (SELECT seq, key, rank, coalesce(max(rank) OVER (PARTITION BY key, reg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY key ORDER BY seq) AS place FROM {_IN_ORDER} JOIN e USING (item))
SELECT seq, key, CAST(rank > before OR place = 1 AS INT) AS changed FROM p""")
def hll_pfadd_replies(spark, d):
    return sketches.hll_changed(_items(spark, d)).select("seq", "key", "changed")


def _hash32_sql(items: str, rows: int) -> str:
    """CTE h of (item, row, h): murmur3 of 8-character items for seeds 0 to rows - 1."""
    word = lambda s: " + ".join(f"CAST(ascii(substr(item, {s + i}, 1)) AS UBIGINT) * {1 << 8 * i}" for i in range(4))
    low = lambda x: f"(({x}) % 4294967296)"
    rot = lambda x, r: f"(({x} * {1 << r}) % 4294967296 + {x} // {1 << (32 - r)})"
    scr = lambda k: low(f"{rot(low(f'{k} * 3432918353'), 15)} * 461845907")
    return f"""w AS (SELECT DISTINCT item, CAST({word(1)} AS UBIGINT) AS k1, CAST({word(5)} AS UBIGINT) AS k2 FROM {items}),
w1 AS (SELECT item, {scr("k1")} AS k1, {scr("k2")} AS k2, CAST(unnest(range(0, {rows})) AS UBIGINT) AS row FROM w),
w2 AS (SELECT item, row, k2, xor(row, k1) AS h FROM w1),
w3 AS (SELECT item, row, k2, ({rot("h", 13)} * 5 + 3864292196) % 4294967296 AS h FROM w2),
w4 AS (SELECT item, row, xor(h, k2) AS h FROM w3),
w5 AS (SELECT item, row, xor(({rot("h", 13)} * 5 + 3864292196) % 4294967296, CAST(8 AS UBIGINT)) AS h FROM w4),
w6 AS (SELECT item, row, xor(h, h >> 16) * 2246822507 % 4294967296 AS h FROM w5),
w7 AS (SELECT item, row, xor(h, h >> 13) * 3266489909 % 4294967296 AS h FROM w6),
h AS (SELECT item, CAST(row AS INT) AS row, xor(h, h >> 16) AS h FROM w7)"""


_CMS = f"WITH l AS (SELECT * FROM {_LINES}), {_hash32_sql('l', 4)}, cells AS (SELECT key, row, CAST(h % 2000 AS INT) AS col, count(*) AS cnt FROM l JOIN h USING (item) GROUP BY ALL)"


@query(f"{_CMS} SELECT key, row, col, cnt FROM cells")
def cms_cells(spark, d):
    return sketches.cms_cells(_items(spark, d), 2000, 4)


@query(f"{_CMS}, r AS (SELECT DISTINCT key, item FROM l) SELECT r.key, r.item, min(cnt) AS estimate FROM r JOIN h USING (item) JOIN cells c ON c.key = r.key AND c.row = h.row AND c.col = CAST(h.h % 2000 AS INT) GROUP BY r.key, r.item")
def cms_query(spark, d):
    rows = _items(spark, d)
    return sketches.cms_query(sketches.cms_cells(rows, 2000, 4), rows.select("key", "item").distinct(), 2000, 4)


@query(f"{_CMS} SELECT 'both' AS key, row, col, CAST(sum(cnt * CASE key WHEN 'flag:A' THEN 3 ELSE 2 END) AS BIGINT) AS cnt, true AS valid FROM cells WHERE key <> 'flag:R' GROUP BY row, col")
def cms_merge_weighted(spark, d):
    weights = spark.createDataFrame([("flag:A", "both", 3), ("flag:N", "both", 2)], "src string, dst string, weight long")
    return sketches.cms_merge(sketches.cms_cells(_items(spark, d), 2000, 4), weights)


@query(f"WITH l AS (SELECT * FROM {_LINES}), {_hash32_sql('l', 4)}, c AS (SELECT seq, key, item, n, sum(n) OVER (PARTITION BY key, row, h % 2000 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt FROM {_IN_ORDER} JOIN h USING (item)) SELECT seq, key, item, CAST(n AS BIGINT) AS n, CAST(min(cnt) AS BIGINT) AS estimate FROM c GROUP BY seq, key, item, n")
def cms_incrby_replies(spark, d):
    """Lines of one order and number come in the order of the table."""
    rows = _items(spark, d).select("seq", "key", "item", "n", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return sketches.cms_running(rows, 2000, 4, ties=("_file", "_row"))


_BLOOM = f"WITH l AS (SELECT * FROM {_LINES}), {_hash128_sql('l', 0x9747B28C)}, bits AS (SELECT item, CAST((a + CAST(b AS UHUGEINT) * CAST(i AS UHUGEINT)) % 18446744073709551616 % 191744 AS BIGINT) AS bit FROM (SELECT CAST(a AS UHUGEINT) AS a, b, item, unnest(range(0, 7)) AS i FROM m9))"


@query(f"{_BLOOM} SELECT DISTINCT key, bit FROM l JOIN bits USING (item)")
def bloom_bits(spark, d):
    return sketches.bloom_filter(_items(spark, d), 20000, 0.01)


@query(f"{_BLOOM}, f AS (SELECT DISTINCT key, bit FROM l JOIN bits USING (item) WHERE key = 'flag:A'), r AS (SELECT DISTINCT 'flag:A' AS key, item FROM l) SELECT r.key, r.item, bool_and(f.bit IS NOT NULL) AS found FROM r JOIN bits USING (item) LEFT JOIN f ON f.bit = bits.bit GROUP BY r.key, r.item")
def bloom_exists(spark, d):
    rows = _items(spark, d)
    bits = sketches.bloom_filter(rows.where("key = 'flag:A'"), 20000, 0.01)
    return sketches.bloom_exists(rows.select(F.lit("flag:A").alias("key"), "item").distinct(), bits, 20000, 0.01)


@query(f"""{_BLOOM}, f AS (SELECT key, item, min(seq) AS seq FROM {_IN_ORDER} GROUP BY key, item), b AS (SELECT key, item, seq, min(seq) OVER (PARTITION BY key, bit) AS owner FROM f JOIN bits USING (item)), n AS (SELECT key, item FROM b GROUP BY key, item HAVING bool_or(owner = seq)) SELECT key, count(*) AS items FROM n GROUP BY key""")
def bloom_card(spark, d):
    return sketches.bloom_card(_items(spark, d), 20000, 0.01)


@query()
def bloom_scaling(spark, d):
    rows = _t(spark, d, "supplier").select(F.lit("s").alias("key"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("item"))
    return sketches.bloom_add(rows, 20, 0.01, 2)


@query()
def cuckoo_add(spark, d):
    rows = _t(spark, d, "supplier").select(F.lit("s").alias("key"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("item"))
    return sketches.cuckoo_add(rows, 1024)


@query()
def morris_incrby(spark, d):
    rows = _t(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("key"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("item"), F.lit(1000).cast("long").alias("n"))
    return sketches.morris_incrby(rows, 200, 5)


# ---- windows and operations


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type AS item, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, d):
    rows = _t(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_timestamp(F.col("w.start").cast("timestamp_ntz").cast("timestamp")).alias("start_s"), "item", "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY user_id, s) GROUP BY user_id")
def session_counts(spark, d):
    rows = _t(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


_USEC = "CAST(floor(abs(value) * 100) AS BIGINT)"


@query(f"SELECT event_type AS cmd, bucket, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS BIGINT) AS calls FROM (SELECT event_type, CAST(pow(2, greatest(0, ceil(log2(greatest({_USEC}, 1))))) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL)")
def latency_histogram(spark, d):
    from tessera.operators import admin

    return admin.latency_histogram(_t(spark, d, "events").select(F.col("event_type").alias("cmd"), F.floor(F.abs("value") * 100).alias("usec")))


@query(f"SELECT event_id AS id, event_type AS cmd, {_USEC} AS usec FROM events WHERE {_USEC} >= 5000 ORDER BY event_id DESC LIMIT 128")
def slowlog_topn(spark, d):
    from tessera.operators import admin

    return admin.slowlog(_t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("cmd"), F.floor(F.abs("value") * 100).alias("usec")), 5000, 128)


_SIZES = "(SELECT c_name AS key, 76 + strlen(c_name) + strlen(c_mktsegment) + CASE WHEN c_custkey % 2 = 0 THEN 48 ELSE 0 END AS bytes, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS expire_at_ms, (c_custkey * 7919) % 100003 AS access FROM customer)"


def _sized(spark, d):
    c = F.col("c_custkey")
    return _t(spark, d, "customer").select(F.col("c_name").alias("key"), F.lit("string").alias("type"), F.col("c_mktsegment").alias("value"), F.when(c % 2 == 0, c).alias("expire_at_ms"), (c * 7919 % 100003).alias("access"))


@query(f"SELECT key, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (ORDER BY access DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS used FROM {_SIZES}) WHERE used <= 60000")
def evict_lru(spark, d):
    from tessera.operators import admin

    return admin.evict(admin.memory_usage(_sized(spark, d)), "allkeys-lru", 60000).select("key", "bytes")


@query(f"WITH k AS (SELECT coalesce(sum(bytes), 0) AS fixed FROM {_SIZES} WHERE expire_at_ms IS NULL), v AS (SELECT *, sum(bytes) OVER (ORDER BY expire_at_ms DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {_SIZES} WHERE expire_at_ms IS NOT NULL) SELECT key, bytes FROM {_SIZES} WHERE expire_at_ms IS NULL UNION ALL SELECT v.key, v.bytes FROM v, k WHERE v.used + k.fixed <= 120000")
def evict_volatile_ttl(spark, d):
    from tessera.operators import admin

    return admin.evict(admin.memory_usage(_sized(spark, d)), "volatile-ttl", 120000).select("key", "bytes")


@query(f"SELECT 'string' AS type, count(*) AS keys, CAST(sum(bytes) AS BIGINT) AS bytes FROM {_SIZES}")
def memory_stats(spark, d):
    from tessera.operators import admin

    return admin.memory_stats(admin.memory_usage(_sized(spark, d)))


@query()
def lfu_frequency(spark, d):
    from tessera.operators import admin

    return admin.lfu_frequency(_t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("clock")))


@query()
def command_catalog(spark, d):
    from tessera.operators import admin

    return admin.command_catalog(spark)


@query()
def lcs_pairs(spark, d):
    from tessera.operators import pairs

    b = _t(spark, d, "benchmark").where("text is not null")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return pairs.lcs(b.select("item_id", F.col("text").alias("a")).join(after, "item_id"), "a", "b").select("item_id", "length", "subsequence")


# ---- command logs


_COMMANDS = f"SELECT key, CAST(sum(delta) AS VARCHAR) AS value FROM {_EVENTS} GROUP BY key"


def _log(spark, d):
    """INCRBY commands made from the events."""
    e = _event_changes(spark, d)
    return e.select("seq", F.lit(NOW).alias("ts_ms"), F.lit("c").alias("client"), F.lit("INCRBY").alias("cmd"), F.array(F.col("key").cast("binary"), F.col("delta").cast("string").cast("binary")).alias("args"))


@query(_COMMANDS)
def fold_incrby_state(spark, d):
    from tessera.plans import fold

    records = fold.run(_log(spark, d), outputs="state")
    return records.where("type = 'string'").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"SELECT seq, CAST(sum(delta) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS reply FROM {_EVENTS}")
def fold_incrby_replies(spark, d):
    from tessera.plans import fold

    return fold.run(_log(spark, d), outputs="replies").select("seq", F.col("i").alias("reply"))


# Logs made from the events of each user: the n-th event of a user makes the command that n % count names.

_PLACED = "(SELECT event_id AS seq, 'user:' || user_id AS key, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, row_number() OVER (ORDER BY event_id) - 1 AS every FROM events)"


def _placed_log(spark, d, *commands):
    """(seq, cmd, args): commands are (name, *arguments), each a column or text; the key comes first."""
    from pyspark.sql import Window

    e = _event_changes(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1)
    turn = F.pmod(F.col("n"), F.lit(len(commands)))
    binary = lambda x: (x if not isinstance(x, str) else F.lit(x)).cast("string").cast("binary")
    cmd, args = F.lit(None).cast("string"), F.lit(None).cast("array<binary>")
    for i, (name, *rest) in enumerate(commands):
        cmd = F.when(turn == i, F.lit(name)).otherwise(cmd)
        args = F.when(turn == i, F.array(binary(F.col("key")), *map(binary, rest))).otherwise(args)
    return e.select("seq", F.lit(NOW).alias("ts_ms"), F.lit("c").alias("client"), cmd.alias("cmd"), args.alias("args"))


def _texts(replies):
    """(seq, reply): integers, strings, statuses and errors as text, nulls as null."""
    return replies.select("seq", F.coalesce(F.col("s").cast("string"), F.col("i").cast("string"), "error", F.col("d").cast("string")).alias("reply"))


def _replies(spark, d, *commands):
    from tessera.plans import fold

    return _texts(fold.run(_placed_log(spark, d, *commands)))


_LAST = "lag(value) OVER (PARTITION BY key ORDER BY seq)"


@query(f"SELECT seq, CASE n % 3 WHEN 0 THEN 'OK' WHEN 1 THEN {_LAST} END AS reply FROM {_PLACED}")
def fold_getdel(spark, d):
    return _replies(spark, d, ("SET", F.col("value")), ("GETDEL",), ("GET",))


@query(f"SELECT seq, CASE n % 4 WHEN 0 THEN 'OK' WHEN 1 THEN '100' WHEN 2 THEN {_LAST.replace('lag(value)', 'lag(value, 2)')} ELSE '-1' END AS reply FROM {_PLACED}")
def fold_setex_getex(spark, d):
    return _replies(spark, d, ("SETEX", "100", F.col("value")), ("TTL",), ("GETEX", "PERSIST"), ("TTL",))


@query(f"SELECT seq, CASE n % 3 WHEN 0 THEN CASE WHEN n = 0 THEN NULL ELSE lag(value, 2) OVER (PARTITION BY key ORDER BY seq) END WHEN 1 THEN 'OK' ELSE NULL END AS reply FROM {_PLACED}")
def fold_set_options(spark, d):
    """SET with GET, XX and NX: the old value, OK as the key is there, null as it is."""
    return _replies(spark, d, ("SET", F.col("value"), "GET"), ("SET", F.col("value"), "XX"), ("SET", "never", "NX"))


@query(f"SELECT seq, CASE n % 4 WHEN 0 THEN 'OK' WHEN 1 THEN '50000' WHEN 2 THEN 'OK' ELSE '50000' END AS reply FROM {_PLACED}")
def fold_psetex_keepttl(spark, d):
    return _replies(spark, d, ("PSETEX", "50000", F.col("value")), ("PTTL",), ("SET", F.col("value"), "KEEPTTL"), ("PTTL",))


@query(f"SELECT seq, CASE n % 3 WHEN 0 THEN 'OK' WHEN 1 THEN '1' ELSE '0' END AS reply FROM {_PLACED}")
def fold_del(spark, d):
    return _replies(spark, d, ("SET", F.col("value")), ("DEL",), ("UNLINK",))


@query(f"SELECT seq, CASE n % 4 WHEN 0 THEN 'OK' WHEN 1 THEN '1.5' WHEN 2 THEN '3' ELSE '3' END AS reply FROM {_PLACED}")
def fold_incrbyfloat(spark, d):
    return _replies(spark, d, ("SET", "1"), ("INCRBYFLOAT", "0.5"), ("INCRBYFLOAT", "1.5"), ("GET",))


@query(f"SELECT seq, CASE n % 5 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' ELSE '1' END AS reply FROM {_PLACED}")
def fold_pushx(spark, d):
    return _replies(spark, d, ("LPUSHX", F.col("value")), ("RPUSH", F.col("value"), "b"), ("LPUSHX", "a"), ("RPUSHX", "c"), ("DEL",))


@query(f"SELECT seq, CASE n % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERR item exists' WHEN 2 THEN '1' ELSE '1' END AS reply FROM {_PLACED} WHERE n % 4 <> 1")
def fold_bloom_reserve(spark, d):
    """A filter of its own for each turn of four: reserved, filled, asked."""
    from tessera.plans import fold

    log = _placed_log(spark, d, ("BF.RESERVE", "0.01", "100"), ("GET",), ("BF.ADD", "x"), ("BF.EXISTS", "x"))
    turn = F.concat(F.col("args")[0], F.lit(":").cast("binary"), F.col("seq").cast("string").cast("binary"))
    from pyspark.sql import Window

    first = F.first(turn).over(Window.partitionBy(F.col("args")[0], F.col("_turn")).orderBy("seq"))
    log = log.withColumn("_turn", F.floor((F.row_number().over(Window.partitionBy(F.col("args")[0]).orderBy("seq")) - 1) / 4))
    log = log.withColumn("args", F.concat(F.array(first), F.slice("args", F.lit(2), F.size("args")))).drop("_turn").where("cmd <> 'GET'")
    return _texts(fold.run(log))


_KEYSPACE = f"""
WITH p AS (SELECT *, every % 50 AS e FROM {_PLACED}),
w AS (SELECT seq, key, coalesce(max(seq) FILTER (e = 49) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS epoch, e FROM p),
f AS (SELECT epoch, key, min(seq) AS first FROM w WHERE e < 47 GROUP BY epoch, key)
SELECT w.seq, CASE e WHEN 47 THEN CAST((SELECT count(*) FROM f WHERE f.epoch = w.epoch AND f.first < w.seq) AS VARCHAR)
                     WHEN 48 THEN (SELECT string_agg(f.key, ',' ORDER BY f.first) FROM f WHERE f.epoch = w.epoch AND f.first < w.seq) ELSE 'OK' END AS reply
FROM w"""


@query(_KEYSPACE)
def fold_keyspace_replies(spark, d):
    """Of every 50 commands the last three are DBSIZE, KEYS and FLUSHDB, which see and empty all keys."""
    from tessera.plans import fold

    e = distributed_rank(_event_changes(spark, d), [], ["seq"], "every")
    turn = F.pmod("every", F.lit(50))
    cmd = F.when(turn < 47, "SET").when(turn == 47, "DBSIZE").when(turn == 48, "KEYS").otherwise("FLUSHDB")
    args = F.when(turn < 47, F.array(F.col("key").cast("binary"), F.col("value").cast("binary"))).when(turn == 48, F.array(F.lit("*").cast("binary"))).otherwise(F.array().cast("array<binary>"))
    log = e.select("seq", F.lit(NOW).alias("ts_ms"), F.lit("c").alias("client"), cmd.alias("cmd"), args.alias("args"))
    found = fold.run(log)
    names = F.array_join(F.from_json("nested", "array<string>"), ",")
    return found.select("seq", F.coalesce(F.col("s").cast("string"), F.col("i").cast("string"), names).alias("reply"))


@query(f"SELECT seq, CASE every % 4 WHEN 0 THEN 'OK' WHEN 1 THEN CAST(1 + CAST(length(value) AS BIGINT) AS VARCHAR) WHEN 2 THEN 'OK' ELSE CAST(length(lag(value, 2) OVER (ORDER BY seq)) + 1 AS VARCHAR) END AS reply FROM {_PLACED}")
def fold_transactions(spark, d):
    """Blocks of four: SET, INCRBY by the value's length, SET elsewhere, GET; a block's own keys tie its commands."""
    from pyspark.sql import Window

    from tessera.plans import fold

    e = _event_changes(spark, d).withColumn("every", F.row_number().over(Window.orderBy("seq")) - 1)
    block = F.floor(F.col("every") / 4).cast("long")
    turn, name = F.pmod(F.col("every"), F.lit(4)), F.concat(F.lit("t"), block.cast("string")).cast("binary")
    other = F.concat(F.lit("o"), block.cast("string")).cast("binary")
    cmd = F.when(turn == 1, "INCRBY").when(turn == 3, "GET").otherwise("SET")
    args = F.when(turn == 0, F.array(name, F.lit("1").cast("binary"))).when(turn == 1, F.array(name, F.length("value").cast("string").cast("binary"))).when(turn == 2, F.array(other, F.col("value").cast("binary"))).otherwise(F.array(name))
    return _texts(fold.run(e.select("seq", F.lit(NOW).alias("ts_ms"), F.lit("c").alias("client"), block.alias("tx_id"), cmd.alias("cmd"), args.alias("args"))))


def _cycle(*turns: tuple):
    """Registers a query of each name whose user logs go round a cycle of commands; turns: (command, reply at its turn)."""

    def register(name: str):
        commands, replies = [t[0] for t in turns], [t[1] for t in turns]
        cases = " ".join(f"WHEN {i} THEN {reply}" for i, reply in enumerate(replies))

        def run(spark, d):
            from tessera.plans import fold

            found = fold.run(_placed_log(spark, d, *[tuple(x() if callable(x) else x for x in c) for c in commands]))
            return found.select("seq", F.coalesce(F.col("s").cast("string"), F.col("i").cast("string"), "nested", "error", F.col("d").cast("string")).alias("reply"))

        run.__name__ = name
        query(f"SELECT seq, CASE n % {len(turns)} {cases} END AS reply FROM {_PLACED}")(run)

    return register


_GONE = "CASE WHEN n = 0 THEN '0' ELSE '1' END"


def _register_cycles():
    """One cycle for each family of commands; the first command of some clears what the cycle before has left."""
    _cycle((("CF.ADDNX", "x"), "'1'"), (("CF.COUNT", "x"), "'1'"), (("CF.DEL", "x"), "'1'"), (("CF.EXISTS", "x"), "'0'"))("fold_cuckoo")
    _cycle((("DEL",), _GONE), (("CF.RESERVE", "64"), "'OK'"), (("CF.INSERT", "ITEMS", "a", "b"), "'[true, true]'"), (("CF.MEXISTS", "a", "z"), "'[true, false]'"))("fold_cuckoo_insert")
    _cycle((("DEL",), _GONE), (("CMS.INITBYDIM", "100", "4"), "'OK'"), (("CMS.INCRBY", "x", "3", "x", "2"), "'[3, 5]'"), (("CMS.QUERY", "x", "none"), "'[5, 0]'"))("fold_cms")
    _cycle((("DEL",), _GONE), (("BF.INSERT", "CAPACITY", "50", "ITEMS", "a", "b"), "'[true, true]'"), (("BF.CARD",), "'2'"), (("BF.MEXISTS", "a", "none"), "'[true, false]'"))("fold_bloom_insert")
    _cycle((("DEL",), _GONE), (("MORRIS.INITBYDIM", "50", "3"), "'OK'"), (("MORRIS.INCRBY", "x", "1"), """'["1"]'"""), (("MORRIS.QUERY", "x", "none"), """'["1", "0"]'"""))("fold_morris")
    _cycle((("DEL",), _GONE), (("PFADD", "a", "b"), "'1'"), (("PFCOUNT",), "'2'"), (("PFADD", "a"), "'0'"))("fold_hll")
    _cycle((("GEOADD", "13.361389", "38.115556", "p", "15.087269", "37.502669", "c"), "'2'"), (("GEODIST", "p", "c", "km"), "'166.2742'"), (("GEOHASH", "p"), """'["sqc8b49rny0"]'"""), (("DEL",), "'1'"))("fold_geo")
    _cycle((("ZADD", "1", "a", "2", "b"), "'2'"), (("ZRANK", "b"), "'1'"), (("ZRANGE", "0", "-1"), """'["a", "b"]'"""), (("DEL",), "'1'"))("fold_zset")
    _cycle((("SADD", "a", "b", "a"), "'2'"), (("SMISMEMBER", "a", "z"), "'[1, 0]'"), (("SREM", "a", "z"), "'1'"), (("DEL",), "'1'"))("fold_set")
    _cycle((("SET", "x"), "'OK'"), (("EXPIRE", "100", "NX"), "'1'"), (("EXPIRE", "50", "GT"), "'0'"), (("PERSIST",), "'1'"))("fold_expire")
    _cycle((("HSET", "f", "1", "g", "2"), "'2'"), (("HINCRBY", "f", "4"), "'5'"), (("HMGET", "f", "z"), """'["5", null]'"""), (("DEL",), "'1'"))("fold_hash")
    other = lambda: F.concat(F.lit("to:"), F.col("key"))
    _cycle((("RPUSH", "a", "b", "c"), "'3'"), (("LMOVE", other, "LEFT", "RIGHT"), "'a'"), (("RPOPLPUSH", other), "'c'"), (("DEL",), "'1'"))("fold_lmove")
    _cycle((("SETRANGE", "3", "xyz"), "'6'"), (("GETRANGE", "3", "-1"), "'xyz'"), (("STRLEN",), "'6'"), (("TYPE",), "'string'"))("fold_ranges")


_register_cycles()
