"""Registered queries over tables' lives: configuration, numbers, batches, administration, jobs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyloom.functions import hashing as H
from keyloom.operators import maintenance as M
from keyloom.operators.state import CacheTable, empty
from keyloom.plans import inputs as I
from keyloom.plans import replay as R
from keyloom.plans.catalogue import ALIVE, AOF_STATE, NOW, NUMBERED, SHARD, LOG_NOW, N, NS, TWO_CHOICE, _kv, _outcome, query
from keyloom.schema import COMMAND, CacheConfig
from keyloom.sources import serve


@query(f"SELECT 0::BIGINT AS count, {N} AS nshards, true AS usecas, 20 AS pollsize")
def init_empty(s, d):
    t = empty(s, CacheConfig(nshards=N, usecas=True, pollsize=0))
    return t.count().select("count", F.lit(t.config.nshards).alias("nshards"), F.lit(t.config.usecas).alias("usecas"), F.lit(t.config.pollsize).alias("pollsize"))


# --- CAS numbers ----------------------------------------------------------
@query(_outcome("CASE WHEN live THEN 'Replaced' ELSE 'Inserted' END", **NUMBERED))
def store_numbered(s, d):
    return _kv(s, d, usecas=True).store(I.upd(s, d), NOW)


@query(f"""WITH {I.KV}, {I.UPD} SELECT upd.key, CASE WHEN kv.key IS NULL OR NOT {ALIVE} THEN 'NotFound' WHEN kv.cas = upd.cas THEN 'Replaced' ELSE 'Found' END AS once,
 CASE WHEN kv.key IS NULL OR NOT {ALIVE} THEN 'NotFound' ELSE 'Found' END AS again FROM upd LEFT JOIN kv ON kv.key = upd.key""")
def store_cas_twice(s, d):
    """Two swaps with one token: the second finds the row's number renewed."""
    t, w = _kv(s, d, usecas=True), I.upd(s, d)
    once = t.store(w, NOW, casop=True).filter("result IS NOT NULL").select("key", F.col("result").alias("once"))
    again = t.stored(w, NOW, casop=True).store(w, NOW, casop=True, counters=t.counters_after(w)).filter("result IS NOT NULL").select("key", F.col("result").alias("again"))
    return once.join(again, "key")


RESTORED = f"""u AS (SELECT key, {SHARD} AS shard, CASE WHEN flags % 2 = 0 THEN cas ELSE 0 END AS rc, row_number() OVER (PARTITION BY {SHARD} ORDER BY key) AS nr FROM upd),
b AS (SELECT {SHARD} AS shard, greatest(1, max(cas)) AS cas FROM kv GROUP BY 1),
c AS (SELECT DISTINCT u.shard, 0::BIGINT AS nr, NULL::VARCHAR AS key, coalesce(b.cas, 1) AS ctr, 0::BIGINT AS cas FROM u LEFT JOIN b ON b.shard = u.shard
 UNION ALL SELECT u.shard, u.nr, u.key, CASE WHEN rc <> 0 THEN greatest(ctr, rc) ELSE ctr + 1 END, CASE WHEN rc <> 0 THEN rc ELSE ctr + 1 END FROM c JOIN u ON u.shard = c.shard AND u.nr = c.nr + 1)"""


@query(f"WITH RECURSIVE {I.KV}, {I.UPD}, {RESTORED} SELECT key, cas FROM c WHERE nr > 0")
def store_restore_cas(s, d):
    w = I.upd(s, d).withColumn("cas", F.when(F.col("flags") % 2 == 0, F.col("cas")).otherwise(0))
    return _kv(s, d, usecas=True).store(w, NOW, restore_cas=True).filter("result IN ('Inserted', 'Replaced')").select("key", "cas")


@query(f"WITH RECURSIVE {I.KV}, {I.UPD}, {RESTORED} SELECT shard, max(ctr)::BIGINT AS cas FROM (SELECT shard, ctr FROM c UNION ALL SELECT shard, cas FROM b) GROUP BY 1")
def restore_cas_counters(s, d):
    w = I.upd(s, d).withColumn("cas", F.when(F.col("flags") % 2 == 0, F.col("cas")).otherwise(0))
    return _kv(s, d, usecas=True).counters_after(w, restore_cas=True)


@query(f"""WITH {I.KV}, {I.REQ}, h AS (SELECT kv.*, {SHARD} AS shard, key IN (SELECT key FROM req) AS asked, {ALIVE} AS live FROM kv), b AS (SELECT shard, greatest(1, max(cas)) AS top FROM h GROUP BY 1),
n AS (SELECT key, row_number() OVER (PARTITION BY shard ORDER BY key) AS nr FROM h WHERE asked AND live AND flags % 2 = 0)
SELECT h.key, CASE WHEN n.nr IS NULL THEN h.cas ELSE top + nr END::BIGINT AS cas FROM h JOIN b ON b.shard = h.shard LEFT JOIN n ON n.key = h.key WHERE live OR NOT asked""")
def update_numbered(s, d):
    return _kv(s, d, usecas=True).update(I.req(s, d), NOW, value=F.upper, where=F.col("flags") % 2 == 0).state.select("key", "cas")


AOF_CAS = AOF_STATE + f""", p AS (SELECT *, CASE WHEN kind = 1 AND pos % 3 <> 0 THEN pos + 2 ELSE 0 END AS cas, last_value(CASE WHEN d <> 'x' THEN d END IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
u AS (SELECT key, pos, {SHARD} AS shard, CASE WHEN d = 's' THEN cas ELSE 0 END AS rc, row_number() OVER (PARTITION BY {SHARD} ORDER BY pos) AS nr FROM p WHERE d = 's' OR (d = 'x' AND prev = 's')),
c AS (SELECT DISTINCT shard, 0::BIGINT AS nr, NULL::VARCHAR AS key, 1::BIGINT AS ctr, 0::BIGINT AS cas FROM u
 UNION ALL SELECT u.shard, u.nr, u.key, CASE WHEN rc <> 0 THEN greatest(ctr, rc) ELSE ctr + 1 END, CASE WHEN rc <> 0 THEN rc ELSE ctr + 1 END FROM c JOIN u ON u.shard = c.shard AND u.nr = c.nr + 1),
g AS (SELECT key, arg_max(cas, nr)::BIGINT AS cas FROM c WHERE nr > 0 GROUP BY key)"""


def _aof_with_cas(s, d):
    return I.aof(s, d).withColumn("cas", F.when((F.col("kind") == 1) & (F.col("pos") % 3 != 0), F.col("pos") + 2).otherwise(0).cast("bigint"))


@query(f"WITH RECURSIVE {I.LOG}, {I.AOF}, {AOF_CAS} SELECT st.key, value, flags, expires_ns, g.cas FROM st JOIN g ON g.key = st.key")
def aof_replay_cas(s, d):
    return R.aof_state(_aof_with_cas(s, d), LOG_NOW, CacheConfig(nshards=N, usecas=True))


@query(f"WITH RECURSIVE {I.LOG}, {I.AOF}, {AOF_CAS} SELECT st.key, value, flags, g.cas, expires_ns AS expire_unix_ns FROM st JOIN g ON g.key = st.key")
def aof_rewrite_cas(s, d):
    """A log written, compacted and read back: numbers survive."""
    from keyloom.sources import aof, snapshot

    a, b = snapshot.scratch(s), snapshot.scratch(s)
    aof.append(_aof_with_cas(s, d), a)
    aof.rewrite(s, a, b, LOG_NOW, CacheConfig(nshards=N, usecas=True))
    return aof.read(s, b).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "flags", "cas", "expire_unix_ns")


# --- memory, batches, sweeps ----------------------------------------------
@query(f"WITH {I.KV}, {I.UPD} SELECT coalesce(kv.key, upd.key) AS key, kv.value, kv.key IS NOT NULL AS present, CASE WHEN upd.key IS NOT NULL THEN 'OutOfMemory' END AS result FROM kv FULL JOIN upd ON upd.key = kv.key")
def store_lowmem(s, d):
    return _kv(s, d, noevict=True).store(I.upd(s, d), NOW, lowmem=True).select("key", "value", "present", "result")


STORED = f"held AS (SELECT key, value, {NOW} AS time_ns, CASE WHEN ttl_ns > 0 THEN {NOW} + ttl_ns ELSE 0 END::BIGINT AS expires_ns FROM upd UNION ALL SELECT key, value, time_ns, expires_ns FROM kv WHERE key NOT IN (SELECT key FROM upd)), a AS (SELECT key FROM upd WHERE key NOT IN (SELECT key FROM kv))"


@query(f"WITH {I.KV}, {I.UPD}, {STORED}, {TWO_CHOICE} SELECT key, value, time_ns::BIGINT AS time_ns, expires_ns FROM held WHERE key NOT IN (SELECT victim FROM lost)")
def store_evicting(s, d):
    """Inserts under memory pressure, each of which sends a row off."""
    return M.store_evicting(_kv(s, d), I.upd(s, d), NOW, lowmem=True)[0].state.select("key", "value", "time_ns", "expires_ns")


@query(f"""WITH {I.KV}, {I.UPD}, {I.REQ}, a AS (SELECT key, value, flags, CASE WHEN ttl_ns > 0 THEN {NOW} + ttl_ns ELSE 0 END::BIGINT AS expires_ns FROM upd UNION ALL SELECT key, value, flags, expires_ns FROM kv WHERE key NOT IN (SELECT key FROM upd)),
b AS (SELECT * FROM a WHERE NOT (key IN (SELECT key FROM req) AND key LIKE '%7'))
SELECT key, value, flags, expires_ns FROM b WHERE expires_ns = 0 OR expires_ns > {NOW} + {NS}""")
def batch_published(s, d):
    """A batch of a store, deletes and a sweep, published as a new state and read back."""
    from keyloom.sources import snapshot
    from keyloom.sources.manager import Batch

    b = Batch(_kv(s, d), snapshot.scratch(s))
    b.store(I.upd(s, d), NOW)
    b.delete(I.req(s, d).filter("key LIKE '%7'"), NOW)
    b.sweep(NOW + NS)
    return b.end().state.select("key", "value", "flags", "expires_ns")


def _polled_sql() -> str:
    from keyloom.plans.catalogue import SQL

    poll = SQL["sweep_poll"]
    return f"WITH kept AS ({poll}), {I.KV} SELECT kv.* FROM kv, kept WHERE ratio <= 0.1 OR {ALIVE}"


@query(_polled_sql())
def autosweep_tick(s, d):
    return M.autosweep(_kv(s, d), NOW).state


# --- events ---------------------------------------------------------------
DEAD = f"WITH {I.KV}, {I.REQ}, {I.UPD}, dead AS (SELECT key, 'Expired' AS kind, value FROM kv WHERE NOT {ALIVE})"


@query(f"{DEAD} SELECT * FROM dead")
def sweep_events(s, d):
    return M.sweep_events(_kv(s, d), NOW)


@query(f"{DEAD} SELECT * FROM dead WHERE key IN (SELECT key FROM req)")
def load_events(s, d):
    return M.touch_events(_kv(s, d), I.req(s, d), NOW)


@query(f"{DEAD} SELECT * FROM dead WHERE key IN (SELECT key FROM upd) UNION ALL SELECT upd.key, CASE WHEN kv.key IS NOT NULL AND {ALIVE.replace('expires_ns', 'kv.expires_ns')} THEN 'Replaced' ELSE 'Inserted' END, upd.value FROM upd LEFT JOIN kv ON kv.key = upd.key")
def store_events(s, d):
    return M.store_events(_kv(s, d), I.upd(s, d), NOW)


# --- administration -------------------------------------------------------
def _requests(s, words: list[bytes]):
    return s.createDataFrame([(i, NOW + i, bytearray(w)) for i, w in enumerate(words)], "seq long, t_ns long, data binary")


@query("SELECT * FROM (VALUES (0::BIGINT, '+PONG' || chr(13) || chr(10), false), (1, '-ERR protocol error' || chr(13) || chr(10), true), (2, '$4' || chr(13) || chr(10) || 'a:1b' || chr(13) || chr(10), false)) v(seq, reply, closes)")
def resp_admin(s, d):
    rows = _requests(s, [b"*1\r\n$4\r\nping\r\n", b"*1\r\n$4\r\nNOPE\r\n", b"*1\r\n$4\r\nINFO\r\n"])
    return serve.resp_session(rows, info="a:1b").select("seq", F.col("reply").cast("string").alias("reply"), "closes")


@query("SELECT * FROM (VALUES (0::BIGINT, 200, 'OK'), (1, 404, ''), (2, 200, '{}'), (3, 404, ''), (4, 400, '')) v(seq, status, body)")
def http_admin(s, d):
    rows = _requests(s, [f"{w} HTTP/1.1\r\n\r\n".encode() for w in ("GET /@health", "GET /@other", "GET /@stats", "GET /key", "NOPE /key")])
    return serve.http_session(rows).select("seq", "status", "body")


@query("SELECT 2::BIGINT AS active_connections, 3::BIGINT AS total_connections, 3::BIGINT AS total_requests, 4::BIGINT AS total_responses, 14 + 8 + 20 + 27 + 10::BIGINT AS bytes_read, 7 + 5 + 21 + 5::BIGINT AS bytes_written, 1::BIGINT AS parse_errors")
def session_counters(s, d):
    """Counters of a session of three clients: one request is malformed, one is not whole."""
    words = [("a", b"*1\r\n$4\r\nPING\r\n"), ("b", b"*1\r\n!4\r\n"), ("a", _words(b"GET", b"k")), ("c", _words(b"SET", b"k", b"v")), ("c", b"*1\r\n$4\r\nPI")]
    rows = s.createDataFrame([(i, NOW + i, c, bytearray(w)) for i, (c, w) in enumerate(words)], "seq long, t_ns long, client string, data binary")
    return serve.session_stats(rows, serve.resp_session(rows))


def _words(*words: bytes) -> bytes:
    return b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(w), w) for w in words)


@query("SELECT * FROM (VALUES (0::BIGINT, '+OK'), (1, '+OK'), (2, '+OK'), (3, ':1'), (4, '$-1'), (5, '+OK'), (6, '+OK'), (7, '$1' || chr(13) || chr(10) || '1'), (8, ':96'), (9, ':3'), (10, '-ERR persistence failed'), (11, '-ERR aof disabled'), (12, '+OK')) v(seq, reply)")
def resp_jobs(s, d):
    """Saves and loads at their places in a session: what a save wrote is what its load brings back."""
    from keyloom.sources import snapshot
    from keyloom.sources.manager import Manager

    words = [(b"SET", b"a", b"1"), (b"SET", b"b", b"2", b"EX", b"100"), (b"SAVE", b"FAST"), (b"DEL", b"a"), (b"GET", b"a"), (b"SET", b"b", b"9"), (b"LOAD",), (b"GET", b"a"), (b"TTL", b"b"), (b"INCR", b"b"),
             (b"LOAD", b"FROM", f"{snapshot.scratch(s)}/none".encode()), (b"BGREWRITEAOF",), (b"MONITOR",)]
    rows = s.createDataFrame([(i, NOW + i * NS // 2, bytearray(_words(*w))) for i, w in enumerate(words)], "seq long, t_ns long, data binary")
    out = serve.resp_session(rows, manager=Manager(snapshot.scratch(s)))
    return out.select("seq", F.regexp_replace(F.col("reply").cast("string"), "\r\n$", "").alias("reply"))


@query("SELECT * FROM (VALUES (0::BIGINT, 201, ''), (1, 200, 'OK'), (2, 200, ''), (3, 200, 'OK'), (4, 200, 'v'), (5, 500, '')) v(seq, status, body)")
def http_jobs(s, d):
    from keyloom.sources import snapshot
    from keyloom.sources.manager import Manager

    rows = _requests(s, [b"POST /k HTTP/1.1\r\nContent-Length: 1\r\n\r\nv"] + [f"{w} HTTP/1.1\r\n\r\n".encode() for w in ("POST /@save", "DELETE /k", "POST /@load", "GET /k", f"POST /@load?path={snapshot.scratch(s)}/none")])
    return serve.http_session(rows, manager=Manager(snapshot.scratch(s))).select("seq", "status", "body")


# --- persistence ----------------------------------------------------------
ALIVE_ROWS = f"WITH {I.KV} SELECT key, value, expires_ns, flags, cas FROM kv WHERE {ALIVE}"


@query(ALIVE_ROWS)
def snapshot_single(s, d):
    """Written as one file, not by all tasks, and read back."""
    from keyloom.sources import snapshot

    path = snapshot.scratch(s)
    snapshot.save(_kv(s, d, usecas=True), path, NOW, fast=False)
    return snapshot.load(empty(s, CacheConfig(nshards=N, usecas=True)), path, NOW)[0].state.select("key", "value", "expires_ns", "flags", "cas")


@query(ALIVE_ROWS)
def manager_jobs(s, d):
    """A background save, then a background load."""
    from keyloom.sources import snapshot
    from keyloom.sources.manager import Manager

    jobs, got = Manager(snapshot.scratch(s)), []
    jobs.start_save(_kv(s, d, usecas=True), NOW)
    jobs.wait()
    jobs.start_load(empty(s, CacheConfig(nshards=N, usecas=True)), NOW, got=got.append)
    jobs.wait()
    return got[0].state.select("key", "value", "expires_ns", "flags", "cas")


@query("SELECT * FROM (VALUES ('none', 'empty'), ('snapshot', 'snapshot'), ('both', 'aof')) v(there, chosen)")
def startup_choice(s, d):
    from keyloom.sources import aof, snapshot

    a, b = snapshot.scratch(s), snapshot.scratch(s)
    chosen = [("none", aof.startup(s, a, b))]
    snapshot.save(_kv(s, d), b, NOW)
    chosen.append(("snapshot", aof.startup(s, a, b)))
    aof.append(I.aof(s, d), a)
    chosen.append(("both", aof.startup(s, a, b)))
    return s.createDataFrame(chosen, "there string, chosen string")


# --- functions ------------------------------------------------------------
def _mixed(x: str) -> str:
    m = "18446744073709551616::UHUGEINT"
    steps = "".join(f", [{shift}::UHUGEINT, {factor}::UHUGEINT]" for shift, factor in ((30, H.MIX13_FACTORS[0]), (27, H.MIX13_FACTORS[1]), (31, 1)))
    return f"list_reduce(list_concat([[({x})::UHUGEINT, 0::UHUGEINT]], [{steps[2:]}]), lambda h, f: [(xor(h[1], h[1] >> f[1]) * f[2]) % {m}, 0::UHUGEINT])[1]"


@query(f"SELECT o_orderkey AS id, ({_mixed('o_orderkey * 1000003')})::VARCHAR AS mixed FROM orders")
def mix13_column(s, d):
    return I.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), H.unsigned(H.mix_col(F.col("o_orderkey") * 1000003)).alias("mixed"))


CRC32 = "list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, len(c_name)), lambda i: ord(substr(c_name, (i + 1)::BIGINT, 1))::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1::UBIGINT, 3988292384::UBIGINT * (x & 1::UBIGINT))))"


@query(f"SELECT c_custkey AS id, xor({CRC32}, 4294967295::UBIGINT)::BIGINT AS crc FROM customer")
def crc32_of_values(s, d):
    return I.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.crc32(F.col("c_name").cast("binary")).alias("crc"))


# --- streams --------------------------------------------------------------
def _streamed(s, rows, schema):
    """``rows`` as a stream, and a fresh folder for its output and checkpoints."""
    from keyloom.sources import snapshot

    base = snapshot.scratch(s)
    rows.write.parquet(f"{base}/in")
    return s.readStream.schema(schema).parquet(f"{base}/in"), base


def _run(stream, base: str, mode: str = "append"):
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@query(f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT seq, key, op, result, reply FROM f WHERE rn > 0")
def stream_replay(s, d):
    """The command log as a stream: state per key with its own expiry, and the replies."""
    from keyloom.streaming import replay as S

    log = I.log(s, d)
    stream, base = _streamed(s, log.select(*COMMAND.names), COMMAND)
    S.use_rocksdb(s)
    return _run(S.command_results(stream), base)


@query(f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT seq, key, op, result, reply FROM f WHERE rn > 0")
def stream_replay_timers(s, d):
    """As ``stream_replay``, with timers that clear dead rows."""
    from keyloom.streaming import replay as S

    stream, base = _streamed(s, I.log(s, d).select(*COMMAND.names), COMMAND)
    S.use_rocksdb(s)
    return _run(S.command_results(stream, clean="1 hour"), base)


@query(f"""WITH {I.LOG} SELECT seq, '+' || (t_ns // {NS}) || '.' || lpad((t_ns // 1000 % 1000000)::VARCHAR, 6, '0') || ' [0 10.0.0.1:6379] "' || op || '" "' || key || '"' || chr(13) || chr(10) AS line FROM log""")
def stream_monitor(s, d):
    from keyloom.streaming import replay as S

    rows = I.log(s, d).select("seq", "t_ns", F.lit("10.0.0.1:6379").alias("client"), F.array("op", "key").alias("args"))
    stream, base = _streamed(s, rows, rows.schema)
    return _run(S.monitor(stream), base)


@query(f"WITH {I.LOG} SELECT (t_ns // 3600000000000) AS hour, op, count(*) AS n FROM log GROUP BY 1, 2")
def stream_windows(s, d):
    """Event-time windows, an extension."""
    from keyloom.streaming import replay as S

    stream, base = _streamed(s, I.log(s, d).select(*COMMAND.names), COMMAND)
    name = f"windows_{uuid.uuid4().hex}"
    S.windowed_ops(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{base}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return s.table(name).select(F.call_function("div", F.unix_seconds("start"), F.lit(3600)).alias("hour"), "op", "n")


@query(f"WITH {I.LOG}, {I.AOF}, {AOF_STATE} SELECT key, value, flags, expires_ns FROM st")
def stream_aof_tail(s, d):
    """Records appended to a log by a stream, then replayed from the log's files."""
    from keyloom.sources import aof, snapshot
    from keyloom.streaming import replay as S

    rows, out = I.aof(s, d), snapshot.scratch(s)
    stream, base = _streamed(s, rows, rows.schema)
    S.append_log(stream, out, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    back = aof.read(s, out).select("pos", "kind", F.col("key").cast("string").alias("key"), F.when(F.col("kind") == 1, F.col("value").cast("string")).alias("value"), "flags", "expire_unix_ns")
    return R.aof_state(back, LOG_NOW)


@query(f"WITH {I.LOG}, {I.AOF}, {AOF_STATE} SELECT key, value, flags, expires_ns FROM st")
def stream_aof_read(s, d):
    """A log's files followed by a stream, and replayed from what it read."""
    from keyloom.sources import aof, snapshot

    path, base = snapshot.scratch(s), snapshot.scratch(s)
    aof.append(I.aof(s, d).withColumn("cas", F.lit(0).cast("bigint")), path)
    back = _run(aof.tail(s, path), base).select("pos", "kind", F.col("key").cast("string").alias("key"), F.when(F.col("kind") == 1, F.col("value").cast("string")).alias("value"), "flags", "expire_unix_ns")
    return R.aof_state(back, LOG_NOW)
