import threading

from keyloom.operators.state import CacheTable, empty
from keyloom.schema import ENTRY, CacheConfig
from keyloom.sources import files, serve
from keyloom.sources.manager import Batch, Manager, current, publish

from test_sources import resp


def session(spark, *rows):
    return spark.createDataFrame([(i, 1000 + i, bytearray(d)) for i, d in enumerate(rows)], "seq long, t_ns long, data binary")


def test_resp_session(spark):
    out = serve.resp_session(session(spark, resp("PING") + resp("SET", "k", "10", "EX", "100") + resp("INCR", "k"), resp("GET", "k"), resp("TTL", "none"), resp("NOPE"), resp("GET", "k")[:-4], resp("DEL", "k") + resp("INFO"), b"*1\r\n$9999999\r\n"), info="a:1").orderBy("seq", "nr").collect()
    assert [(r.seq, bytes(r.reply), r.closes) for r in out] == [
        (0, b"+PONG\r\n", False), (0, b"+OK\r\n", False), (0, b":11\r\n", False), (1, b"$2\r\n11\r\n", False), (2, b":-2\r\n", False), (3, b"-ERR protocol error\r\n", True),
        (5, b":1\r\n", False), (5, b"$3\r\na:1\r\n", False), (6, b"-ERR value too large\r\n", True)]


def test_http_session(spark):
    put = b"PUT /k HTTP/1.1\r\nContent-Length: 1\r\n\r\nx"
    post = b"POST /k HTTP/1.1\r\nContent-Length: 2\r\n\r\nv1"
    rows = [put, post, b"GET /k HTTP/1.1\r\nConnection: close\r\n\r\n", b"DELETE /k HTTP/1.1\r\n\r\n", b"GET /k HTTP/1.1\r\n\r\n", b"GET /@health HTTP/1.1\r\n\r\n", b"GET /@stats HTTP/1.1\r\n\r\n", b"BAD /k HTTP/1.1\r\n\r\n", b"GET /@x HTTP/1.1\r\n\r\n"]
    out = serve.http_session(session(spark, *rows)).orderBy("seq").collect()
    assert [(r.status, r.body) for r in out] == [(404, ""), (201, ""), (200, "v1"), (200, ""), (404, ""), (200, "OK"), (200, "{}"), (400, ""), (404, "")]
    assert bytes(out[2].response) == b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\nConnection: close\r\n\r\nv1"
    assert b"Content-Type: application/json" in bytes(out[6].response)


def test_manager(spark, tmp_path):
    t = CacheTable(spark.createDataFrame([("a", "1", 1, 0, 0, 0)], ENTRY), CacheConfig())
    assert Manager(None).start_save(t, 5) == "disabled"
    m, gate, done = Manager(str(tmp_path / "snap")), threading.Event(), []
    assert m._start("saving", None, lambda p: gate.wait(30), done.append) == "started"
    assert m.start_save(t, 5) == "busy_save" and m.start_load(t, 5) == "busy_save"
    gate.set()
    m.wait(30)
    assert m.start_save(t, 5, done.append) == "started"
    m.wait(120)
    got = []
    assert m.start_load(empty(spark), 5, done.append, got.append) == "started"
    m.wait(120)
    assert done == [True, True, True] and [r.key for r in got[0].state.collect()] == ["a"]


def test_batch_and_publish(spark, tmp_path):
    root = str(tmp_path / "state")
    first = publish(CacheTable(spark.createDataFrame([("a", "1", 1, 9, 0, 0)], ENTRY), CacheConfig(nshards=4)), root)
    b = Batch(first, root)
    b.store(spark.createDataFrame([("b", "2")], "key string, value string"), 5)
    assert [r.result for r in b.delete(spark.createDataFrame([("a",)], "key string"), 5).collect()] == ["Deleted"]
    assert [r.key for r in current(spark, root).state.collect()] == ["a"]  # readers see the old state until the batch ends
    assert tuple(b.sweep(6).first()) == (0, 1) and b.sweep_poll(6).first()[0] == 0.0 and b.iterate(6).count() == 1
    b.end()
    assert [r.key for r in current(spark, root).state.collect()] == ["b"]
    assert [r.kind for r in Batch(current(spark, root)).clear(7).collect()] == ["Cleared"]
    assert len(files.listed(root)) == 1


def test_buckets(spark):
    t = CacheTable(spark.createDataFrame([(f"k{i}", "v", 1, 0, 0, 0) for i in range(97)], ENTRY), CacheConfig(nshards=1))
    assert [t.buckets().first().nbuckets, CacheTable(t.state.limit(96), t.config).buckets().first().nbuckets, CacheTable(t.state.limit(48), t.config).buckets().first().nbuckets] == [256, 128, 64]
