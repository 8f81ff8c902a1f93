"""Batch fold, streaming fold, log sources, snapshots."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import fold
from tessera.plans.machine import Machine
from tessera.sources import resp, snapshots
from tessera.streaming import commands as streaming

SCHEMA = "seq long, ts_ms long, client string, tx_id long, cmd string, args array<binary>"
LINES = [
    (None, "SET a 1"), (None, "INCRBY a 4"), (None, "RPUSH l x y z"), (None, "LMOVE l m LEFT RIGHT"), (1, "SET t 1"), (1, "INCR t"), (None, "SADD s p q"), (2, "SET u 1"), (2, "NOPE"), (None, "ZADD z 1 a 2 b"), (None, "ZPOPMIN z"),
    (None, "PFADD h a b c"), (None, "MSET k1 a k2 b"), (None, "PEXPIRE k1 5"), (None, "GET k1"), (None, "PEXPIRE k2 60000"),
]


def log(spark, lines=LINES):
    rows = []
    for i, (tx, line) in enumerate(lines):
        cmd, *args = resp.split_inline(line.encode())
        rows.append((i, 1000 + 10 * i, "c", tx, cmd.decode(), [bytearray(x) for x in args]))
    return spark.createDataFrame(rows, SCHEMA)


def test_replies(spark):
    found = {r["seq"]: r for r in fold.run(log(spark)).collect()}
    assert len(found) == len(LINES)
    assert found[1]["i"] == 5 and bytes(found[3]["s"]) == b"x" and found[5]["i"] == 2
    assert "unknown command" in found[8]["error"] and found[7]["error"].startswith("EXECABORT")
    assert found[14]["kind"] == "null"


def test_replay_gives_the_state(spark):
    own = log(spark)
    state = {bytes(r["key"]): r for r in fold.run(own, "state").collect()}
    again = {bytes(r["key"]): r for r in fold.replay(fold.run(own, "log")).collect()}
    assert state.keys() == again.keys() and b"u" not in state and b"k1" not in state
    assert all(state[k]["expire_at_ms"] == again[k]["expire_at_ms"] for k in state)
    assert bytes(state[b"a"]["value"]) == b"5"


def test_tied_keys_share_a_component(spark):
    from tessera.plans import router

    routed = router.components(router.with_keys(log(spark))).collect()
    by_line = {r["seq"]: bytes(r["component"]) for r in routed}
    assert by_line[2] == by_line[3] and by_line[12] == by_line[13] == by_line[15] and by_line[0] != by_line[2]


def test_stream_equals_batch(spark, tmp_path):
    single = [(None, line) for _, line in LINES if line.split()[0] not in ("LMOVE", "MSET", "NOPE")]
    own = log(spark, single).drop("tx_id")
    own.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sink = streaming.log_sink(streaming.fold_stream(stream), str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    sink.awaitTermination(120)
    assert sink.exception() is None
    written = spark.read.parquet(str(tmp_path / "log"))
    records = {r["seq"]: [[bytes(x) for x in y] for y in r["records"]] for r in written.collect()}
    m = Machine()
    want = {}
    for i, (_, line) in enumerate(single):
        start = len(m.log)
        m.execute(resp.split_inline(line.encode()), now=1000 + 10 * i)
        if len(m.log) > start:
            want[i] = m.log[start:]
    assert records == want


def test_windowed_sketches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = streaming.windowed_registers(stream, "ts", "user_id", "1 day", "36500 days")
    query = out.writeStream.format("memory").queryName("registers").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    days = events.select(F.to_date("ts")).distinct().count()
    assert spark.table("registers").select("start").distinct().count() == days


def test_resp_source(spark, tmp_path):
    path = tmp_path / "log.resp"
    path.write_bytes(resp.records([b"SET", b"k", b"v"]) + resp.records([b"GET", b"k"]) + b"*1\r\n$4\r\nPI")
    spark.dataSource.register(resp.RespSource)
    rows = spark.read.format("resp").load(str(path)).orderBy("seq").collect()
    assert [(r["cmd"], [bytes(x) for x in r["args"]]) for r in rows] == [("SET", [b"k", b"v"]), ("GET", [b"k"])]
    with pytest.raises(Exception, match="torn record"):
        spark.read.format("resp").option("mode", "FAILFAST").load(str(path)).collect()


def test_snapshots_and_terms(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    store.save({"strings": spark.createDataFrame([("k", "v")], "key string, value string")}, 3)
    tables, seq = store.load()
    assert seq == 3 and tables["strings"].count() == 1
    rows = spark.createDataFrame([(i,) for i in range(6)], "seq long")
    assert store.tail(rows).count() == 2
    with pytest.raises(ValueError, match="gap"):
        store.tail(rows.where("seq <> 4"))
    other = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    other.promote(5)
    with pytest.raises(snapshots.Fenced):
        store.save({}, 9)
    with pytest.raises(snapshots.Fenced):
        other.promote(5)


def test_commands_over_all_keys(spark):
    lines = [(None, x) for x in ("SET a 1", "SET b 2", "DBSIZE", "KEYS *", "RPUSH l x", "SCAN 0 COUNT 2", "MEMORY STATS", "INFO keyspace", "FLUSHDB", "GET a", "DBSIZE", "SET c 3", "KEYS *", "PING", "SCAN x", "MEMORY USAGE c", "MSET d 1 e 2", "DBSIZE")]
    lines += [(7, "SET f 1"), (7, "DBSIZE"), (7, "SET g 1"), (None, "DBSIZE")]
    own = log(spark, lines)
    found = {r["seq"]: r for r in fold.run(own).collect()}
    m, want = fold._machine(b""), {}
    for i, (_, line) in enumerate(lines):
        m.slots = max(m.slots, i << 10)
        m.now = 1000 + 10 * i
        want[i] = fold.row(i, m.run(resp.split_inline(line.encode())))
    assert found.keys() == want.keys()
    for i, w in want.items():
        r = found[i]
        assert (r["kind"], r["i"], None if r["s"] is None else bytes(r["s"]), r["nested"], r["error"]) == (w[1], w[2], w[3], w[5], w[6]), (i, lines[i])
    state = {bytes(r["key"]) for r in fold.run(own, "state").collect()}
    assert state == {b"c", b"d", b"e", b"f", b"g"}
    again = {bytes(r["key"]) for r in fold.replay(fold.run(own, "log")).collect()}
    assert again == state


@pytest.mark.parametrize("unquiet", [False, True])
def test_more_commands_over_all_keys_than_travel_with_the_tasks(spark, monkeypatch, unquiet):
    lines = [(None, x) for x in ("DBSIZE", "SET a 1", "SET b 2", "DBSIZE", "KEYS *", "FLUSHDB", "KEYS *", "SET b 3", "DBSIZE", "FLUSHDB now", "FLUSHDB ASYNC", "GET b", "DBSIZE", "SCAN 0 COUNT 2", "RPUSH l x", "MSET d 1 e 2", "MEMORY STATS", "SCAN x")]
    lines += [(7, "SET f 1"), (None, "DBSIZE"), (7, "FLUSHDB"), (7, "DBSIZE"), (7, "SET g 1"), (None, "KEYS *")] + [(None, "INFO keyspace")] * unquiet
    own = log(spark, [x for x in lines if x[0] is None]).drop("tx_id") if unquiet else log(spark, lines)
    shown = lambda df: sorted(map(str, df.collect()))
    want = [shown(fold.run(own, x)) for x in ("replies", "state", "log")]
    monkeypatch.setattr(fold, "GLOBALS", 3)
    assert [shown(fold.run(own, x)) for x in ("replies", "state", "log")] == want


def test_rewrite_in_a_log(spark):
    own = log(spark, [(None, x) for x in ("SET a 1", "INCR a", "SET b 1", "DEL b", "BGREWRITEAOF", "INCR a")])
    records = sorted((r["seq"], [bytes(x) for x in r["record"]]) for r in fold.run(own, "log").collect())
    assert records[0] == (4, [b"SET", b"a", b"2"]) and [s for s, _ in records] == [4, 5]


def test_a_long_chain_of_tied_keys_is_one_component(spark):
    from tessera.plans import router

    own = log(spark, [(None, f"LMOVE k{i} k{i + 1} LEFT RIGHT") for i in range(200)] + [(None, "GET other")])
    found = {bytes(r["component"]) for r in router.components(router.with_keys(own)).collect()}
    assert found == {b"k0", b"other"}


def test_a_crash_before_publishing_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    frame = lambda n: {"strings": spark.createDataFrame([("k", n)], "key string, value long")}
    store.save(frame(1), 3)
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.save(frame(2), 5)
    monkeypatch.undo()
    tables, seq = store.load()
    assert seq == 3 and tables["strings"].first()["value"] == 1
    assert store.save(frame(3), 6) == 2 and store.load()[0]["strings"].first()["value"] == 3
    # a writer that read the pointer before another one published loses
    late = store.pointer() | {"number": 1}
    with pytest.raises(snapshots.Fenced):
        store._publish(late, late)


def test_resp_source_in_parts(spark, tmp_path):
    """Records of all sizes, values that look like records, and parts far smaller than some records."""
    import random

    rng = random.Random(7)
    lines = [[b"SET", b"k%d" % i, bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 5, 40, 900))))] for i in range(400)]
    lines[50][2] = b"x\r\n*1\r\n$4\r\nFAKE\r\nrest"
    raw = b"".join(map(resp.records, lines))
    (tmp_path / "a.resp").write_bytes(raw + b"*2\r\n$3\r\nGE")
    spark.dataSource.register(resp.RespSource)
    for split in (0, 700, 20_000, 1 << 26):
        found = spark.read.format("resp").option("splitBytes", split).load(str(tmp_path)).orderBy("seq").collect()
        assert [[r["cmd"].encode(), *map(bytes, r["args"])] for r in found] == lines
    inner = resp.records([b"SET", b"a", b"b"]) * 40
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.resp").write_bytes(resp.records([b"SET", b"log", inner]) + resp.records([b"GET", b"log"]))
    with pytest.raises(Exception, match="splitBytes=0|do not lead"):
        spark.read.format("resp").option("splitBytes", 500).load(str(tmp_path / "b")).collect()
    assert spark.read.format("resp").option("splitBytes", 0).load(str(tmp_path / "b")).count() == 2


def test_resp_stream(spark, tmp_path):
    spark.dataSource.register(resp.RespSource)
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "log.resp"
    path.write_bytes(resp.records([b"SET", b"k", b"1"]) + b"*2\r\n$3\r\nGE")

    def run():
        stream = spark.readStream.format("resp").load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return [r["cmd"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]

    assert run() == ["SET"]
    path.write_bytes(resp.records([b"SET", b"k", b"1"]) + resp.records([b"GET", b"k"]) + resp.records([b"DEL", b"k"]))
    assert run() == ["SET", "GET", "DEL"]


def test_timers_take_expired_keys(spark, tmp_path):
    """k1 is due before the stream's end and goes by a timer; k2 had its time extended; k3 is due later."""
    lines = ["SET k1 a", "PEXPIRE k1 50", "SET k2 b", "PEXPIRE k2 50", "PEXPIRE k2 9000000", "SET k3 c", "PEXPIRE k3 9000000"]
    own = log(spark, [(None, x) for x in lines]).drop("tx_id")
    later = log(spark, [(None, "SET z 1")]).drop("tx_id").withColumn("seq", F.lit(100).cast("long")).withColumn("ts_ms", F.lit(100_000).cast("long"))
    own.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
        query = streaming.fold_stream(stream, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return spark.read.parquet(str(tmp_path / "out"))

    run()
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = run()
    gone = [(bytes(r["key"]), [[bytes(x) for x in y] for y in r["records"]]) for r in found.where("kind = 'expired'").collect()]
    assert gone == [(b"k1", [[b"DEL", b"k1"]])]
    assert found.where("seq is not null").count() == 8


def test_a_replica_pulls_what_it_lacks(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(i,) for i in range(8)], "seq long")
    assert store.pull(rows)[0] == {} and store.pull(rows)[1].count() == 8
    store.save({"strings": spark.createDataFrame([("k", "v")], "key string, value string")}, 3)
    tables, rest = store.pull(rows)
    assert tables["strings"].count() == 1 and sorted(r["seq"] for r in rest.collect()) == [4, 5, 6, 7]
    tables, rest = store.pull(rows, since=5)
    assert tables == {} and sorted(r["seq"] for r in rest.collect()) == [6, 7]
    store.promote(4)
    with pytest.raises(snapshots.Fenced):
        store.pull(rows, since=5, term=3)
