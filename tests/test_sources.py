import pytest
from pyspark.sql import functions as F

from keyloom.operators.metrics import escaped
from keyloom.operators.state import CacheTable
from keyloom.schema import ENTRY, CacheConfig
from keyloom.sources import aof, files, snapshot, wire


def resp(*args):
    return f"*{len(args)}\r\n".encode() + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in (x if isinstance(x, bytes) else x.encode() for x in args))


def test_resp_parse():
    c, n = wire.read_resp(resp("SET", "mykey", "value", "EX", "10"))
    assert (c.op, c.key, c.value, c.ttl_ns, n) == ("SET", b"mykey", b"value", 10 * 10**9, len(resp("SET", "mykey", "value", "EX", "10")))
    two = resp("get", "a") + resp("GET", "b")
    first, at = wire.read_resp(two)
    assert (first.op, first.key, wire.read_resp(two, at)[0].key) == ("GET", b"a", b"b")
    assert wire.read_resp(resp("SAVE", "TO", "/x", "FAST"))[0].path == b"/x"
    assert wire.read_resp(resp("SET", "k", "v", "EX", "1", "PX", "5"))[0].ttl_ns == 5 * 10**6


@pytest.mark.parametrize(("data", "error"), [
    (resp("SET", "k", "v", "NX", "XX"), "MalformedRequest"), (resp("SET", "k", "v", "EX"), "MalformedRequest"), (resp("SET", "k", "v", "EX", "nope"), "InvalidNumber"), (resp("NOPE"), "MalformedRequest"),
    (resp("GET"), "MalformedRequest"), (b"$4\r\nshort\r\n", "MalformedRequest"), (b"*1\r\n$2\r\nabc\r\n", "MalformedRequest"), (b"*33\r\n", "TooManyArgs"), (b"*0\r\n", "MalformedRequest"),
    (resp("EXPIRE", "k", "9223372036854775807"), "InvalidNumber"), (b"*1\r\n$9999999\r\n", "ValueTooLarge"), (resp("LOAD", "TO", "/x"), "MalformedRequest")])
def test_resp_errors(data, error):
    with pytest.raises(wire.WireError, match=error):
        wire.read_resp(data)


def test_needs_more():
    whole = resp("GET", "mykey")
    for n in range(len(whole)):
        with pytest.raises(wire.NeedMore):
            wire.read_resp(whole[:n])


def test_http_parse():
    c, _ = wire.read_http(b"POST /mykey HTTP/1.1\r\nContent-Length: 5\r\n\r\nvalue")
    assert (c.op, c.key, c.value, c.xx, c.keepalive) == ("set", b"mykey", b"value", False, True)
    c, _ = wire.read_http(b"POST /@save?path=/tmp/snap&fast=1 HTTP/1.1\r\n\r\n")
    assert (c.op, c.path, c.fast) == ("save", b"/tmp/snap", True)
    assert wire.read_http(b"GET /@whoami HTTP/1.1\r\n\r\n")[0].op == "ops_not_found"
    assert wire.read_http(b"GET /@health HTTP/1.1\r\nConnection: close\r\n\r\n")[0].keepalive is False
    assert wire.read_http(b"GET /a?b=1 HTTP/1.1\r\n\r\n")[0].key == b"a?b=1"


@pytest.mark.parametrize(("data", "error"), [
    (b"PATCH /k HTTP/1.1\r\n\r\n", "InvalidMethod"), (b"GET /k HTTP/1.0\r\n\r\n", "MalformedRequest"), (b"GET / HTTP/1.1\r\n\r\n", "MalformedRequest"), (b"GET /k HTTP/1.1\r\nContent-Length: 1\r\n\r\nx", "MalformedRequest"),
    (b"PUT /k HTTP/1.1\r\nContent-Length: 0\r\n\r\n", "MalformedRequest"), (b"PUT /k HTTP/1.1\r\nContent-Length: 99999999\r\n\r\n", "ValueTooLarge")])
def test_http_errors(data, error):
    with pytest.raises(wire.WireError, match=error):
        wire.read_http(data)


def test_parse_frames(spark):
    rows = spark.createDataFrame([(1, bytearray(resp("GET", "a") + resp("PING") + b"*1\r\n$4\r\nPI")), (2, bytearray(b"oops"))], "seq long, data binary")
    got = [(r.seq, r.nr, r.op, r.error) for r in wire.parse_resp(rows).orderBy("seq", "nr").collect()]
    assert got == [(1, 0, "GET", None), (1, 1, "PING", None), (1, 2, None, "NeedMore"), (2, 0, None, "MalformedRequest")]
    wire.register(spark)
    rows.createOrReplaceTempView("requests")
    assert spark.sql("SELECT t.op FROM requests, LATERAL resp_commands(data) t WHERE t.op IS NOT NULL").count() == 2


def test_replies(spark):
    one = spark.range(1).select(wire.http_response(F.lit(200), F.lit("hi"), F.lit(True)).alias("a"), wire.resp_reply(F.lit("$v1")).alias("b"), wire.resp_reply(F.lit("$-1")).alias("c"), wire.resp_reply(F.lit(":5")).alias("d")).first()
    assert [bytes(x) for x in one] == [b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\nConnection: keep-alive\r\n\r\nhi", b"$2\r\nv1\r\n", b"$-1\r\n", b":5\r\n"]


def test_escape(spark):
    got = spark.createDataFrame([(bytearray(b'a\n\r\t"\\\x01\xff'),), (bytearray(b""),), (bytearray(b"plain ~"),)], "a binary").select(escaped(F.col("a"))).collect()
    assert [r[0] for r in got] == [r' "a\n\r\t\"\\\x01\xFF"', ' ""', ' "plain ~"']


ROWS = [(f"key:{i}", "v" * (i % 50), 5, 0 if i % 3 else (20 if i % 2 else 99), i % 4, i) for i in range(500)]


def test_snapshot(spark, tmp_path):
    t = CacheTable(spark.createDataFrame(ROWS, ENTRY).repartition(3), CacheConfig(usecas=True))
    for fast in (True, False):
        path = str(tmp_path / f"s{fast}")
        snapshot.save(t, path, 50, fast)
        assert len([f for f in files.listed(path) if f.endswith(".snap")]) == (3 if fast else 1)
        back = snapshot.read(spark, path).collect()
        live = [r for r in ROWS if r[3] == 0 or r[3] > 50]
        assert sorted((bytes(r.key).decode(), bytes(r.value).decode(), r.expire_unix_ns, r.flags, r.cas) for r in back) == sorted((r[0], r[1], r[3], r[4], r[5]) for r in live)
        loaded, stats = snapshot.load(CacheTable(spark.createDataFrame([("key:1", "x", 1, 0, 0, 0), ("mine", "x", 1, 0, 0, 0)], ENTRY), t.config), path, 99)
        assert tuple(stats.first()) == (len([r for r in live if r[3] == 0]), len([r for r in live if r[3]]))
        assert loaded.state.filter("key = 'mine'").count() == 1 and loaded.state.filter("key = 'key:1'").first().value == "v"
    snapshot.save_native(t, str(tmp_path / "native"), 50)
    assert spark.read.parquet(str(tmp_path / "native")).count() == len(live)


def test_snapshot_blocks_and_errors(tmp_path):
    rows = [(b"k%d" % i, b"v" * 300, 0, 0, 0) for i in range(40)]
    blocks = list(snapshot.encode_blocks(iter(rows), 2048))
    assert len(blocks) > 3
    raw = [snapshot.decode_block(b[:16], b[16:]) for b in blocks]
    assert [x for r in raw for x in snapshot.decode_records(r)] == rows
    bad = bytearray(blocks[0])
    bad[20] ^= 1
    with pytest.raises(snapshot.SnapshotError, match="BlockCrcMismatch"):
        snapshot.decode_block(bytes(bad[:16]), bytes(bad[16:]))
    with pytest.raises(snapshot.SnapshotError, match="RecordMalformed"):
        list(snapshot.decode_records(raw[0][:-1]))
    head = snapshot.encode_header(1, True)
    assert len(head) == 28 and snapshot.decode_header(head) == (True, 1)
    for i, error in ((0, "InvalidHeader"), (8, "UnsupportedVersion"), (24, "UnsupportedCompression")):
        with pytest.raises(snapshot.SnapshotError, match=error):
            snapshot.decode_header(head[:i] + bytes([head[i] + 1]) + head[i + 1 :])


def test_aof(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(1, 1, "a", "1", 0, 0, 0), (2, 1, "b", "2", 3, 0, 500), (3, 2, "a", None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "pos long, kind int, key string, value string, flags long, cas long, expire_unix_ns long")
    aof.append(df, path)
    aof.append(spark.createDataFrame([(9, 1, "c", "4", 0, 0, 0)], df.schema), path)
    back = aof.read(spark, path).orderBy("pos").collect()
    assert [(r.kind, bytes(r.key), bytes(r.value)) for r in back] == [(1, b"a", b"1"), (1, b"b", b"2"), (2, b"a", b""), (1, b"c", b"4")]
    aof.rewrite(spark, path, str(tmp_path / "small"), 100)
    assert sorted(bytes(r.key) for r in aof.read(spark, str(tmp_path / "small")).collect()) == [b"b", b"c"]
    assert aof.startup(spark, path, None) == "aof" and aof.startup(spark, str(tmp_path / "no"), path) == "snapshot" and aof.startup(spark, None, None) == "empty"


def test_aof_damage():
    data = aof.encode_header() + aof.encode_record(1, b"k", b"v", 7, 2, 9) + aof.encode_record(2, b"k")
    assert [r[1:7] for r in aof.decode(data)] == [(1, b"k", b"v", 7, 2, 9), (2, b"k", b"", 0, 0, 0)]
    assert len(list(aof.decode(data[:-1]))) == 1  # a record cut short at the end
    bad = bytearray(data)
    bad[16 + 33] ^= 1
    with pytest.raises(aof.AofError, match="RecordCrcMismatch"):
        list(aof.decode(bytes(bad)))
    assert [r[-1] for r in aof.decode(bytes(bad), strict=False)] == [False, True]
    with pytest.raises(aof.AofError, match="InvalidHeader"):
        list(aof.decode(b"x" + data[1:]))
    with pytest.raises(aof.AofError, match="UnsupportedVersion"):
        list(aof.decode(data[:8] + b"\x02" + data[9:]))


def test_aof_tail_follows_a_growing_log(spark, tmp_path):
    path, out, seen = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "seen")
    record = aof.encode_record(aof.SET, b"k1", b"v1")
    (tmp_path / "log").mkdir()
    grows = tmp_path / "log" / "0000000000.aof"

    def step():
        aof.tail(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
        return [(r.pos, bytes(r.key)) for r in spark.read.parquet(out).orderBy("pos").collect()]

    grows.write_bytes(aof.encode_header() + record + aof.encode_record(aof.SET, b"k2", b"v2")[:-1])  # the second record is not whole yet
    first = aof.HEADER.size
    assert step() == [(first, b"k1")]
    grows.write_bytes(aof.encode_header() + record + aof.encode_record(aof.SET, b"k2", b"v2") + aof.encode_record(aof.DEL, b"k1"))
    expected = [(first, b"k1"), (first + len(record), b"k2"), (first + 2 * len(record), b"k1")]
    assert step() == expected
    (tmp_path / "log" / "0000000007.aof").write_bytes(aof.encode_header() + record)
    assert step() == [*expected, ((7 << 40) + first, b"k1")]
    assert aof.read(spark, path).count() == 4


def test_streamed_log_keeps_the_order_of_records(spark, tmp_path, monkeypatch):
    """Parts of the sort outnumber the segments of a batch, or a batch fills several segments."""
    from keyloom.streaming import replay as S

    monkeypatch.setattr(S, "SEGMENT_ROWS", 50, raising=False)
    schema, n = "pos long, kind int, key string, value string, flags long, cas long, expire_unix_ns long", 1000
    path, given = str(tmp_path / "log"), str(tmp_path / "in")
    confs = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        for b in range(2):
            rows = spark.range(b * n, (b + 1) * n, 1, 1).selectExpr("id AS pos", "1 AS kind", "'k' AS key", "CAST(id AS string) AS value", "0L AS flags", "0L AS cas", "0L AS expire_unix_ns")
            rows.sortWithinPartitions(F.hash("pos")).write.mode("append").parquet(given)
            S.append_log(spark.readStream.schema(schema).parquet(given), path, str(tmp_path / "seen")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [int(r.value) for r in aof.read(spark, path).orderBy("pos").select(F.col("value").cast("string")).collect()] == list(range(2 * n))
    assert 2 < len(files.listed(path)) <= 2 * 64
