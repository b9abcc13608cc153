"""The registered queries over the reference's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import codec
from keyloom.functions import expr as E
from keyloom.functions import hashing as H
from keyloom.operators import maintenance as M
from keyloom.operators import metrics as X
from keyloom.operators.state import CacheTable
from keyloom.plans import inputs as I
from keyloom.plans import replay as R
from keyloom.schema import CacheConfig
from keyloom.sources import serve, wire

NOW, NS, LOG_NOW, N = I.NOW, I.NS, I.LOG_NOW, I.NSHARDS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ALIVE = f"(expires_ns = 0 OR expires_ns > {NOW})"
SHARD = f"((({I.th64('key')}) >> 32::UHUGEINT) % {N})::INTEGER"
PACKS = "regexp_full_match(key, '[-.0-9:A-PR-Y_a-y]{1,128}')"
KEYLEN = f"(CASE WHEN {PACKS} THEN (strlen(key) * 6 + 7) // 8 ELSE strlen(key) END)"
BODY = f"(16 + CASE WHEN expires_ns > 0 THEN 8 ELSE 0 END + CASE WHEN flags > 0 THEN 4 ELSE 0 END + CASE WHEN {KEYLEN} < 128 THEN 1 WHEN {KEYLEN} < 16384 THEN 2 ELSE 3 END + {KEYLEN} + strlen(value))"
SIZE = f"({BODY} + CASE WHEN {BODY} <= 254 THEN 1 WHEN {BODY} <= 65533 THEN 2 ELSE 4 END)::BIGINT"


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _kv(s: SparkSession, d: str, **options) -> CacheTable:
    return CacheTable(I.kv(s, d), CacheConfig(nshards=N, **options))


# --- point operations -----------------------------------------------------
@query(f"WITH {I.KV}, {I.REQ} SELECT req.key, kv.key IS NOT NULL AS hit, value, flags, expires_ns, cas, greatest(time_ns, {NOW}) AS time_ns "
       f"FROM req LEFT JOIN (SELECT * FROM kv WHERE {ALIVE}) kv ON kv.key = req.key".replace("greatest(time_ns", "CASE WHEN kv.key IS NOT NULL THEN greatest(time_ns").replace(") AS time_ns FROM req", ") END AS time_ns FROM req"))
def load_multi_get(s, d):
    return _kv(s, d).load(I.req(s, d), NOW)


@query(f"WITH {I.KV}, {I.REQ} SELECT key, value, CASE WHEN key IN (SELECT key FROM req) THEN greatest(time_ns, {NOW}) ELSE time_ns END AS time_ns, expires_ns, flags, cas FROM kv WHERE {ALIVE} OR key NOT IN (SELECT key FROM req)")
def touch_last_access(s, d):
    return _kv(s, d).after_load(I.req(s, d), NOW).state


@query(f"WITH {I.KV}, {I.REQ} SELECT key, CASE WHEN hit AND flags % 2 = 0 THEN upper(value) ELSE value END AS value, CASE WHEN hit THEN greatest(time_ns, {NOW}) ELSE time_ns END AS time_ns, "
       f"CASE WHEN hit AND flags % 2 = 0 THEN 0 ELSE expires_ns END::BIGINT AS expires_ns, CASE WHEN hit AND flags % 2 = 0 THEN flags + 100 ELSE flags END AS flags, cas FROM (SELECT *, key IN (SELECT key FROM req) AS hit FROM kv) WHERE {ALIVE} OR NOT hit")
def load_update(s, d):
    return _kv(s, d).update(I.req(s, d), NOW, value=F.upper, flags=F.col("flags") + 100, expires=F.lit(0).cast("bigint"), where=F.col("flags") % 2 == 0).state


#: Numbers that the writes of a table with CAS numbers take: each the next of its shard, by key.
NUMBERS = f"""num AS (SELECT u.key, coalesce(b.cas, 1) + row_number() OVER (PARTITION BY u.shard ORDER BY u.key) AS cas FROM (SELECT key, {SHARD} AS shard FROM upd) u
 LEFT JOIN (SELECT {SHARD} AS shard, greatest(1, max(cas)) AS cas FROM kv GROUP BY 1) b ON b.shard = u.shard)"""


def _outcome(result: str, expires: str = "", cas: str = "0", ctes: str = "") -> str:
    """SQL of a store's outcome; ``result`` in terms of live, o (old row or null), w (write or null); ``cas`` is a stored row's number."""
    new_expires = f"CASE WHEN w.ttl_ns > 0 THEN {NOW} + w.ttl_ns ELSE 0 END"
    expires = expires.replace("NEW", new_expires) or new_expires
    return f"""WITH {I.KV}, {I.UPD}, {ctes} j AS (SELECT coalesce(o.key, w.key) AS key, o.value AS ov, o.time_ns AS ot, o.expires_ns AS oe, o.flags AS fl, o.cas AS oc, w.value AS nv, w.flags AS nf, w.cas AS nc,
 o.key IS NOT NULL AS had, w.key IS NOT NULL AS wr, o.key IS NOT NULL AND (o.expires_ns = 0 OR o.expires_ns > {NOW}) AS live,
 ({expires})::BIGINT AS ne, {cas} AS nn FROM kv o FULL JOIN upd w ON o.key = w.key),
k AS (SELECT *, CASE WHEN wr THEN {result} END AS result FROM j), q AS (SELECT *, coalesce(result IN ('Inserted', 'Replaced'), false) AS st FROM k)
SELECT key, CASE WHEN st THEN nv ELSE ov END AS value, CASE WHEN st THEN {NOW} ELSE ot END AS time_ns, CASE WHEN st THEN ne ELSE oe END AS expires_ns, CASE WHEN st THEN nf ELSE fl END AS flags,
 CASE WHEN st THEN nn ELSE oc END::BIGINT AS cas, st OR (had AND NOT (wr AND NOT live)) AS present, result FROM q"""


@query(_outcome("CASE WHEN live THEN 'Replaced' ELSE 'Inserted' END"))
def store_upsert(s, d):
    return _kv(s, d).store(I.upd(s, d), NOW)


@query(_outcome("CASE WHEN live THEN 'Found' ELSE 'Inserted' END"))
def store_nx(s, d):
    return _kv(s, d).store(I.upd(s, d), NOW, nx=True)


@query(_outcome("CASE WHEN live THEN 'Replaced' ELSE 'NotFound' END"))
def store_xx(s, d):
    return _kv(s, d).store(I.upd(s, d), NOW, xx=True)


NUMBERED = {"cas": "(SELECT num.cas FROM num WHERE num.key = w.key)", "ctes": NUMBERS + ","}


@query(_outcome("CASE WHEN live AND oc = nc THEN 'Replaced' WHEN live THEN 'Found' ELSE 'NotFound' END", **NUMBERED))
def store_cas(s, d):
    return _kv(s, d, usecas=True).store(I.upd(s, d), NOW, casop=True)


@query(_outcome("CASE WHEN live THEN 'Replaced' ELSE 'Inserted' END", f"CASE WHEN o.key IS NOT NULL AND (o.expires_ns = 0 OR o.expires_ns > {NOW}) THEN o.expires_ns ELSE NEW END"))
def store_keepttl(s, d):
    return _kv(s, d).store(I.upd(s, d), NOW, keepttl=True)


@query(_outcome("CASE WHEN live AND fl <= nf THEN 'Replaced' WHEN live THEN 'Canceled' ELSE 'Inserted' END"))
def store_veto(s, d):
    return _kv(s, d).store(I.upd(s, d), NOW, allow=F.col("o_flags") <= F.col("n_flags"))


@query(f"""SELECT s_suppkey AS id, CASE WHEN e > 0 THEN e WHEN t > 0 THEN CASE WHEN t > 9223372036854775807 - {NOW} THEN 9223372036854775807 ELSE {NOW} + t END ELSE 0 END::BIGINT AS expires_ns
FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 9223372036854775807 - s_suppkey WHEN 1 THEN s_suppkey * {NS} WHEN 2 THEN 0 ELSE -s_suppkey END::BIGINT AS t, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey ELSE 0 END AS e FROM supplier)""")
def store_ttl(s, d):
    k = F.col("s_suppkey")
    t = F.when(k % 4 == 0, F.lit(E.LONG_MAX) - k).when(k % 4 == 1, k * NS).when(k % 4 == 2, 0).otherwise(-k).cast("bigint")
    rows = I.table(s, d, "supplier").select(k.alias("id"), t.alias("t"), F.when(k % 5 == 0, k).otherwise(0).alias("e"))
    return rows.select("id", E.resolve_expires(F.lit(NOW), "t", "e").alias("expires_ns"))


@query(f"WITH {I.KV}, {I.REQ} SELECT * FROM kv WHERE key NOT IN (SELECT key FROM req)")
def delete_anti(s, d):
    return _kv(s, d).delete(I.req(s, d), NOW)[0].state


@query(f"WITH {I.KV}, {I.REQ} SELECT req.key, CASE WHEN kv.key IS NULL OR NOT {ALIVE} THEN 'NotFound' WHEN flags % 3 = 0 THEN 'Canceled' ELSE 'Deleted' END AS result FROM req LEFT JOIN kv ON kv.key = req.key")
def delete_results(s, d):
    return _kv(s, d).delete(I.req(s, d), NOW, allow=F.col("flags") % 3 != 0)[1]


@query(f"WITH {I.KV}, {I.REQ} SELECT req.key, CASE WHEN kv.key IS NULL OR NOT {ALIVE} THEN -2 WHEN expires_ns = 0 THEN -1 ELSE (expires_ns - {NOW}) // {NS} END::BIGINT AS ttl FROM req LEFT JOIN kv ON kv.key = req.key")
def ttl_seconds(s, d):
    out = I.req(s, d).join(I.kv(s, d).withColumn("had", F.lit(True)), "key", "left")
    return out.select("key", E.ttl_seconds(F.col("had"), "expires_ns", NOW).alias("ttl"))


# --- scans ----------------------------------------------------------------
@query(f"WITH {I.KV} SELECT * FROM kv WHERE {ALIVE}")
def iter_scan(s, d):
    return _kv(s, d).iterate(NOW)


@query(f"WITH {I.KV} SELECT * FROM (SELECT *, {SHARD} AS shard FROM kv WHERE {ALIVE}) WHERE shard = 7")
def iter_one_shard(s, d):
    return _kv(s, d).iterate(NOW, shard=7)


@query(f"WITH {I.KV} SELECT * FROM kv WHERE {ALIVE} AND flags % 2 = 0")
def iter_delete_where(s, d):
    return _kv(s, d).iterate_delete(NOW, F.col("flags") % 2 == 1).state


@query(f"WITH {I.KV} SELECT * FROM kv WHERE {ALIVE} ORDER BY key LIMIT 25")
def iter_stop_limit(s, d):
    return _kv(s, d).iterate_stop(NOW, 25)


@query(f"WITH {I.KV} SELECT * FROM (SELECT *, {SHARD} AS shard FROM kv WHERE {ALIVE}) WHERE shard > 3 OR (shard = 3 AND key > 'customer:5') ORDER BY shard, key LIMIT 20")
def cursor_page(s, d):
    return _kv(s, d).page(NOW, 20, after=(3, "customer:5"))


# --- counts ---------------------------------------------------------------
@query("SELECT count(*) AS count FROM customer")
def count_all(s, d):
    return _kv(s, d).count()


@query(f"WITH {I.KV} SELECT {SHARD} AS shard, count(*) AS count FROM kv GROUP BY 1")
def count_by_shard(s, d):
    return _kv(s, d).count_by_shard()


@query(f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT sum(total)::BIGINT AS total FROM last")
def total_inserts(s, d):
    return R.total_inserts(I.log(s, d))


@query(f"WITH {I.KV} SELECT sum({SIZE})::BIGINT AS bytes FROM kv")
def size_entries(s, d):
    return _kv(s, d).size()


@query(f"WITH {I.KV}, c AS (SELECT {SHARD} AS shard, count(*) AS count FROM kv GROUP BY 1) SELECT shard, count, (CASE WHEN count <= 48 THEN 64 ELSE 64 * 2 ** ceil(log2(ceil(count / 0.75) / 64)) END)::BIGINT AS nbuckets FROM c")
def shard_buckets(s, d):
    return _kv(s, d).buckets()


@query(f"WITH {I.KV}, c AS (SELECT {SHARD} AS shard, count(*) AS count FROM kv GROUP BY 1), b AS (SELECT sum(CASE WHEN count <= 48 THEN 64 ELSE 64 * 2 ** ceil(log2(ceil(count / 0.75) / 64)) END)::BIGINT AS n, count(*) AS k FROM c), z AS (SELECT sum({SIZE})::BIGINT AS bytes FROM kv) SELECT bytes + (n + ({N} - k) * 64) * 10 + 96 * {N} AS bytes FROM b, z")
def size_whole(s, d):
    return _kv(s, d).whole_size(shard_bytes=96)


def _stats(s, d):
    return X.snapshot(_kv(s, d), I.log(s, d), 90_000, 30_000)


STATS = (f"WITH {I.KV}, {I.LOG}, a AS (SELECT count(*) AS n, sum(strlen(key))::BIGINT AS r, coalesce(sum(strlen(value)), 0)::BIGINT AS w FROM log), b AS (SELECT count(*) AS items, sum({SIZE})::BIGINT AS bytes FROM kv) ")


@query(STATS + """SELECT '{"time_unix_ms":90000,"uptime_ms":60000,"server":{"active_connections":0,"total_connections":1,"total_requests":' || n || ',"total_responses":' || n || ',"bytes_read":' || r || ',"bytes_written":' || w ||
 '},"errors":{"accept":0,"read":0,"write":0,"parse":0,"protocol":0,"pool_full":0,"buffer_overflow":0,"cache":0,"timeout":0},"cache":{"items":' || items || ',"total_items":' || items || ',"bytes":' || bytes || ',"shards":64}}' AS json FROM a, b""")
def stats_json(s, d):
    return X.stats_json(_stats(s, d))


@query(STATS + """SELECT concat_ws(chr(10), 'time_unix_ms:90000', 'uptime_ms:60000', 'server.active_connections:0', 'server.total_connections:1', 'server.total_requests:' || n, 'server.total_responses:' || n,
 'server.bytes_read:' || r, 'server.bytes_written:' || w, 'errors.accept:0', 'errors.read:0', 'errors.write:0', 'errors.parse:0', 'errors.protocol:0', 'errors.pool_full:0', 'errors.buffer_overflow:0', 'errors.cache:0', 'errors.timeout:0',
 'cache.items:' || items, 'cache.total_items:' || items, 'cache.bytes:' || bytes, 'cache.shards:64') AS info FROM a, b""")
def stats_info_lines(s, d):
    return X.info_lines(_stats(s, d))


@query(f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT op, count(*) AS requests, count(*) FILTER (result IN ('Hit', 'Inserted', 'Replaced', 'Deleted', 'Updated')) AS hits, 0::BIGINT AS errors FROM f WHERE rn > 0 GROUP BY op")
def stats_by_op(s, d):
    return X.stats_by_op(R.results(I.log(s, d)))


# --- maintenance ----------------------------------------------------------
@query(f"WITH {I.KV} SELECT * FROM kv WHERE {ALIVE}")
def sweep_state(s, d):
    return M.sweep(_kv(s, d), NOW).state


@query(f"WITH {I.KV} SELECT count(*) FILTER (NOT {ALIVE}) AS swept, count(*) FILTER ({ALIVE}) AS kept FROM kv")
def sweep_counts(s, d):
    return M.sweep_counts(_kv(s, d), NOW)


def _poll_sql() -> str:
    import numpy as np

    shard = int(H.mix13(np.array([NOW], dtype=np.uint64))[0]) % N
    start = int(H.mix13(np.array([NOW + shard], dtype=np.uint64))[0]) % (1 << 24)
    return f"""WITH {I.KV}, h AS (SELECT *, {I.th64('key')} AS hash FROM kv), p AS (SELECT CASE WHEN {ALIVE} THEN 0.0 ELSE 1.0 END::DOUBLE AS dead FROM h
 WHERE (hash >> 32::UHUGEINT) % {N} = {shard} ORDER BY ((hash % 16777216)::BIGINT - {start} + 16777216) % 16777216, key LIMIT 20) SELECT coalesce(avg(dead), 0.0) AS ratio FROM p"""


@query(_poll_sql())
def sweep_poll(s, d):
    return M.sweep_poll(_kv(s, d), NOW)


@query(f"WITH {I.KV} SELECT *, CASE WHEN {ALIVE} THEN 'LowMem' ELSE 'Expired' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {ALIVE}::INTEGER, time_ns, key)::INTEGER AS rank FROM (SELECT *, {SHARD} AS shard FROM kv)) WHERE rank <= 3")
def evict_lru_topk(s, d):
    return M.evict_lru(_kv(s, d), NOW, 3)


#: Of the tables ``held`` (key, time_ns, expires_ns) and ``a`` (key): the two rows that stand behind each key of ``a``, and the one that goes.
TWO_CHOICE = f"""rows AS (SELECT key, {SHARD} AS shard, ({I.th64('key')} % 16777216)::BIGINT AS slot, time_ns, expires_ns FROM held),
asks AS (SELECT key, {SHARD} AS shard, ({I.th64('key')} % 16777216)::BIGINT AS slot FROM a),
c AS (SELECT asks.key AS ask, rows.*, row_number() OVER (PARTITION BY asks.key ORDER BY (rows.slot - asks.slot + 16777216) % 16777216, rows.key) AS nr FROM asks JOIN rows ON rows.shard = asks.shard AND rows.slot <> asks.slot),
t AS (SELECT ask, max(CASE WHEN nr = 1 THEN key END) AS k1, max(CASE WHEN nr = 2 THEN key END) AS k2, bool_or(nr = 1 AND NOT {ALIVE}) AS d1, bool_or(nr = 2 AND NOT {ALIVE}) AS d2, max(CASE WHEN nr = 1 THEN time_ns END) AS t1, max(CASE WHEN nr = 2 THEN time_ns END) AS t2 FROM c WHERE nr <= 2 GROUP BY ask),
lost AS (SELECT ask AS key, CASE WHEN d1 THEN k1 WHEN d2 THEN k2 WHEN t2 < t1 THEN k2 ELSE k1 END AS victim, CASE WHEN d1 OR d2 THEN 'Expired' ELSE 'LowMem' END AS reason FROM t)"""


@query(f"WITH {I.KV}, held AS (SELECT * FROM kv), a AS (SELECT 'new:' || s_suppkey AS key FROM supplier), {TWO_CHOICE} SELECT * FROM lost")
def evict_two_choice(s, d):
    return M.evict_two_choice(_kv(s, d), I.table(s, d, "supplier").select(F.concat(F.lit("new:"), F.col("s_suppkey").cast("string")).alias("key")), NOW)


@query(f"WITH {I.KV} SELECT key, value, time_ns, expires_ns, flags, cas FROM (SELECT *, sum(size) OVER (PARTITION BY shard ORDER BY {ALIVE} DESC, time_ns DESC, key ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT *, {SHARD} AS shard, {SIZE} AS size FROM kv)) WHERE used <= {40_000 // N}")
def evict_to_budget(s, d):
    return M.evict_to_budget(_kv(s, d), NOW, 40_000).state


@query(f"WITH {I.KV} SELECT key, CASE WHEN {ALIVE} THEN 'Cleared' ELSE 'Expired' END AS kind FROM kv")
def clear_events(s, d):
    return M.clear_events(_kv(s, d), NOW)


@query(f"""WITH {I.KV}, {I.UPD}, n AS (SELECT key, value, flags, expires_ns FROM kv WHERE key NOT IN (SELECT key FROM upd) AND {ALIVE} UNION ALL SELECT key, value, flags, CASE WHEN ttl_ns > 0 THEN {NOW} + ttl_ns ELSE 0 END::BIGINT FROM upd)
SELECT coalesce(o.key, n.key) AS key, o.value AS old_value, o.flags AS old_flags, o.expires_ns AS old_expires_ns, n.value AS new_value, n.flags AS new_flags, n.expires_ns AS new_expires_ns,
 CASE WHEN o.key IS NULL THEN 'Inserted' WHEN n.key IS NULL THEN 'Deleted' ELSE 'Replaced' END AS kind FROM kv o FULL JOIN n ON n.key = o.key
WHERE o.key IS NULL OR n.key IS NULL OR o.value <> n.value OR o.flags <> n.flags OR o.expires_ns <> n.expires_ns""")
def cdc_diff(s, d):
    old = _kv(s, d)
    return M.cdc_diff(old, M.sweep(old, NOW).stored(I.upd(s, d), NOW))


# --- replay ---------------------------------------------------------------
@query(f"WITH {I.LOG} SELECT key, sum(CASE op WHEN 'INCR' THEN 1 ELSE -1 END)::BIGINT AS value FROM log WHERE op IN ('INCR', 'DECR') GROUP BY key")
def counter_simple(s, d):
    return R.counters(I.log(s, d).filter(F.col("op").isin("INCR", "DECR")))


@query(f"""WITH {I.LOG}, l AS (SELECT * FROM log WHERE op IN ('INCR', 'DECR', 'SET', 'DEL')), g AS (SELECT *, count(*) FILTER (op IN ('SET', 'DEL')) OVER (PARTITION BY key ORDER BY seq) AS island FROM l),
i AS (SELECT key, island, max(CASE WHEN op = 'SET' THEN value::BIGINT END) AS base, sum(CASE op WHEN 'INCR' THEN 1 WHEN 'DECR' THEN -1 ELSE 0 END) AS d, count(*) FILTER (op IN ('INCR', 'DECR')) AS n FROM g GROUP BY key, island)
SELECT key, (coalesce(base, 0) + d)::BIGINT::VARCHAR AS value FROM i WHERE island = (SELECT max(island) FROM i j WHERE j.key = i.key) AND (n > 0 OR base IS NOT NULL)""")
def counter_islands(s, d):
    return R.counter_islands(I.log(s, d).filter(F.col("op").isin("INCR", "DECR", "SET", "DEL")))


@query(f"WITH {I.LOG} SELECT key, value, flags, t_ns AS time_ns FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op IN ('SET', 'DEL')) WHERE rn = 1 AND op = 'SET'")
def replay_last_writer(s, d):
    return R.last_writer_wins(I.log(s, d).filter(F.col("op").isin("SET", "DEL")))


def _replay_sql(ops: str) -> str:
    some = I.LOG.replace("FROM ev)", f"FROM ev), part AS (SELECT * FROM log WHERE op IN ({ops}))")
    return f"WITH RECURSIVE {some}, {I.REPLAY.replace('FROM log', 'FROM part')} SELECT key, phys, value, expires_ns, flags, time_ns, total, burned FROM last"


@query(_replay_sql("'SET', 'GET', 'DEL'"))
def replay_set_family(s, d):
    return R.replay(I.log(s, d).filter(F.col("op").isin("SET", "GET", "DEL")))


@query(_replay_sql("'SET', 'EXPIRE', 'TTL'"))
def replay_expire(s, d):
    return R.replay(I.log(s, d).filter(F.col("op").isin("SET", "EXPIRE", "TTL")))


FULL = f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT key, phys, value, expires_ns, flags, time_ns, total, burned FROM last"


@query(FULL)
def replay_full(s, d):
    return R.replay(I.log(s, d))


@query(FULL)
def replay_full_sorted(s, d):
    return R.fold_sorted(I.log(s, d))


@query(f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT seq, key, op, result, reply FROM f WHERE rn > 0")
def replay_results(s, d):
    return R.results(I.log(s, d))


@query(f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT seq, key, reply FROM f WHERE rn > 0 AND op = 'GET'")
def resp_get_reply(s, d):
    return R.results(I.log(s, d)).filter("op = 'GET'").select("seq", "key", "reply")


@query(f"WITH {I.LOG}, l AS (SELECT seq, key, {SHARD} AS shard FROM log WHERE op = 'SET') SELECT seq, key, shard, 1 + count(*) OVER (PARTITION BY shard ORDER BY seq) AS cas FROM l")
def cas_sequence(s, d):
    log = I.log(s, d).filter("op = 'SET'")
    return R.cas_sequence(log, H.shard_of(H.hash_col("key"), N))


@query(f"WITH {I.KV} SELECT {SHARD} AS shard, greatest(1, max(cas)) AS cas FROM kv GROUP BY 1")
def restore_cas(s, d):
    return _kv(s, d).restored_cas()


# --- scalar functions -----------------------------------------------------
@query(f"WITH {I.KV} SELECT key, ({I.th64('key', 7)})::VARCHAR AS hash FROM kv")
def hash_th64(s, d):
    return I.kv(s, d).select("key", H.unsigned(H.hash_col("key", 7)).alias("hash"))


@query(f"WITH {I.KV} SELECT key, {SHARD} AS shard, ({I.th64('key')} % 16777216)::INTEGER AS slot FROM kv")
def shard_assignment(s, d):
    return I.kv(s, d).withColumn("h", H.hash_col("key")).select("key", H.shard_of(F.col("h"), N).alias("shard"), H.slot_of(F.col("h")).alias("slot"))


@query(f"SELECT key, {PACKS} AS packs FROM (SELECT p_name AS key FROM part UNION ALL SELECT 'part:' || p_partkey FROM part)")
def sixpack_packable(s, d):
    p = I.table(s, d, "part")
    return p.select(F.col("p_name").alias("key")).union(p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))).select("key", E.packable("key").alias("packs"))


@query(f"SELECT key, {KEYLEN}::INTEGER AS stored FROM (SELECT p_name AS key FROM part UNION ALL SELECT 'part:' || p_partkey FROM part)")
def sixpack_len(s, d):
    p = I.table(s, d, "part")
    return p.select(F.col("p_name").alias("key")).union(p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))).select("key", E.stored_key_len("key").alias("stored"))


@query("SELECT 'part:' || p_partkey AS key, (strlen('part:' || p_partkey) * 6 + 7) // 8 AS bytes, 'part:' || p_partkey AS back FROM part")
def sixpack_roundtrip(s, d):
    p = I.table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"))
    return p.withColumn("p", codec.pack_col("key")).select("key", F.octet_length("p").cast("bigint").alias("bytes"), codec.unpack_col("p").cast("string").alias("back"))


@query("SELECT o_orderkey AS id, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 WHEN v < 34359738368 THEN 5 WHEN v < 4398046511104 THEN 6 WHEN v < 562949953421312 THEN 7 WHEN v < 72057594037927936 THEN 8 ELSE 9 END AS bytes FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_custkey * 97 AS v FROM orders)")
def varint_len(s, d):
    """Products are decimals of up to 38 digits: those beyond a long, at which the SQL's multiplication fails, have their own lengths, 10 bytes and more."""
    k, c = F.col("o_orderkey").cast("decimal(38,0)"), F.col("o_custkey").cast("decimal(38,0)")
    rows = I.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (k * k * c * 97).alias("v"))
    return rows.select("id", E.varint_len("v", 19).alias("bytes"))


@query(f"WITH {I.KV} SELECT key, {SIZE} AS bytes FROM kv")
def entry_mem_size(s, d):
    return I.kv(s, d).select("key", E.entry_mem_size("key", "value", "expires_ns", "flags").alias("bytes"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_size::BIGINT * 1024 * 1024 WHEN 1 THEN p_size WHEN 2 THEN floor((p_size + 0.5) * 1024) WHEN 3 THEN p_size::BIGINT * 1073741824 WHEN 4 THEN NULL ELSE floor(p_size / 100.0 * 8589934592) END::BIGINT AS bytes FROM part""")
def parse_byte_size(s, d):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (F.when(k == 0, F.concat(n, F.lit("mb"))).when(k == 1, F.concat(F.lit(" "), n)).when(k == 2, F.concat(n, F.lit(".5 K"))).when(k == 3, F.concat(n, F.lit("GB"))).when(k == 4, F.concat(n, F.lit("q"))).otherwise(F.concat(n, F.lit("%"))))
    return I.table(s, d, "part").select(F.col("p_partkey").alias("id"), E.parse_byte_size(text, 8 * 1024**3).alias("bytes"))


# --- protocol -------------------------------------------------------------
@query(f"WITH {I.LOG} SELECT seq, op, key, value, nx, xx, ttl_ns FROM log WHERE op IN ('SET', 'GET', 'DEL', 'INCR', 'DECR', 'TTL', 'EXPIRE') AND (op <> 'EXPIRE' OR ttl_ns > 0)")
def resp_parse(s, d):
    log = I.log(s, d).filter("op <> 'EXPIRE' OR ttl_ns > 0")
    bytes_ = log.select("seq", wire.resp_bytes(wire.resp_args()).alias("data"))
    return wire.parse_resp(bytes_).select("seq", "op", "key", "value", "nx", "xx", "ttl_ns")


@query(f"WITH {I.LOG} SELECT seq, CASE op WHEN 'GET' THEN 'get' WHEN 'DEL' THEN 'delete' ELSE 'set' END AS command, key, CASE WHEN op NOT IN ('GET', 'DEL') THEN coalesce(value, op) END AS value, op NOT IN ('GET', 'DEL', 'SET') AS xx, seq % 2 = 1 AS keepalive FROM log")
def http_parse(s, d):
    return wire.parse_http(I.log(s, d).select("seq", wire.http_bytes().alias("data"))).select("seq", "command", "key", "value", "xx", "keepalive")


@query(f"WITH {I.KV}, {I.UPD} SELECT upd.key, CASE WHEN kv.key IS NOT NULL AND {ALIVE} THEN 200 ELSE 201 END AS post, CASE WHEN kv.key IS NOT NULL AND {ALIVE} THEN 200 ELSE 404 END AS put, CASE WHEN kv.key IS NOT NULL AND {ALIVE} THEN 200 ELSE 404 END AS get, CASE WHEN kv.key IS NOT NULL AND {ALIVE} THEN 200 ELSE 404 END AS del FROM upd LEFT JOIN kv ON kv.key = upd.key")
def http_status_codes(s, d):
    t, w = _kv(s, d), I.upd(s, d)
    post = t.store(w, NOW).filter("result IS NOT NULL").select("key", wire.http_status("POST", "result").alias("post"))
    put = t.store(w, NOW, xx=True).filter("result IS NOT NULL").select("key", wire.http_status("PUT", "result").alias("put"))
    get = t.load(w, NOW).select("key", wire.http_status("GET", F.when(F.col("hit"), "Hit").otherwise("Miss")).alias("get"))
    gone = t.delete(w, NOW)[1].select("key", wire.http_status("DELETE", "result").alias("del"))
    return post.join(put, "key").join(get, "key").join(gone, "key")


@query(f"""WITH {I.LOG} SELECT seq, '+' || (t_ns // {NS}) || '.' || lpad((t_ns // 1000 % 1000000)::VARCHAR, 6, '0') || ' [0 10.0.0.' || seq % 250 || ':6379] "' || op || '" "' || key || '"' || CASE WHEN value IS NULL THEN '' ELSE ' "' || value || '\\t\\"q\\"\\xC3\\xA9"' END || chr(13) || chr(10) AS line FROM log""")
def monitor_lines(s, d):
    log = I.log(s, d)
    args = F.array_compact(F.array(F.col("op"), F.col("key"), F.concat(F.col("value"), F.lit('\t"q"é'))))
    return X.monitor_lines(log.select("seq", "t_ns", F.concat(F.lit("10.0.0."), (F.col("seq") % 250).cast("string"), F.lit(":6379")).alias("client"), args.alias("args")))


BULK = "CASE WHEN reply LIKE '$%' AND reply <> '$-1' THEN '$' || strlen(reply[2:]) || chr(13) || chr(10) || reply[2:] ELSE reply END || chr(13) || chr(10)"


@query(f"WITH RECURSIVE {I.LOG}, {I.REPLAY} SELECT seq, {BULK} AS reply FROM f WHERE rn > 0")
def resp_session(s, d):
    log = I.log(s, d)
    # an expire of 0 seconds cannot be told from none in the log's words, so words are written out here
    data = log.select("seq", "t_ns", wire.resp_bytes(F.when(F.col("op") == "EXPIRE", F.array(F.col("op"), F.col("key"), F.call_function("div", F.col("ttl_ns"), F.lit(NS)).cast("string"))).otherwise(wire.resp_args())).alias("data"), "flags")
    out = serve.resp_session(data)
    return out.select("seq", F.col("reply").cast("string").alias("reply"))


HTTP_LOG = I.LOG.replace("log AS (", "log0 AS (") + """, log AS (SELECT seq, t_ns, CASE op WHEN 'GET' THEN 'GET' WHEN 'DEL' THEN 'DEL' ELSE 'SET' END AS op, key, coalesce(value, op) AS value, false AS nx, op NOT IN ('GET', 'DEL', 'SET') AS xx, 0::BIGINT AS ttl_ns, 0::BIGINT AS flags FROM log0)"""


@query(f"WITH RECURSIVE {HTTP_LOG}, {I.REPLAY} SELECT seq, CASE result WHEN 'Hit' THEN 200 WHEN 'Replaced' THEN 200 WHEN 'Deleted' THEN 200 WHEN 'Inserted' THEN 201 WHEN 'Found' THEN 409 ELSE 404 END AS status, CASE WHEN result = 'Hit' THEN reply[2:] ELSE '' END AS body FROM f WHERE rn > 0")
def http_session(s, d):
    return serve.http_session(I.log(s, d).select("seq", "t_ns", wire.http_bytes().alias("data"))).select("seq", "status", "body")


# --- persistence ----------------------------------------------------------
AOF_STATE = f"""l AS (SELECT * FROM aof WHERE NOT (kind = 1 AND expire_unix_ns > 0 AND expire_unix_ns <= {LOG_NOW})), t AS (SELECT *, CASE WHEN kind = 1 THEN 's' WHEN kind = 2 OR expire_unix_ns = 0 OR expire_unix_ns <= {LOG_NOW} THEN 'd' ELSE 'x' END AS d FROM l),
z AS (SELECT key, pos, d, value, flags, expire_unix_ns AS e, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS rn FROM t WHERE d <> 'x'),
y AS (SELECT key, pos, expire_unix_ns AS e, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS rn FROM t WHERE d = 'x'),
st AS (SELECT z.key, z.value, z.flags, CASE WHEN y.pos > z.pos THEN y.e ELSE z.e END AS expires_ns FROM z LEFT JOIN y ON y.key = z.key AND y.rn = 1 WHERE z.rn = 1 AND z.d = 's')"""


@query(f"WITH {I.LOG}, {I.AOF}, {AOF_STATE} SELECT key, value, flags, expires_ns FROM st")
def aof_replay_state(s, d):
    return R.aof_state(I.aof(s, d), LOG_NOW)


@query(f"WITH {I.LOG}, {I.AOF}, c AS (SELECT kind = 1 AND expire_unix_ns > 0 AND expire_unix_ns <= {LOG_NOW} AS sk, kind = 2 OR (kind = 3 AND expire_unix_ns <= {LOG_NOW}) AS de FROM aof) SELECT count(*) FILTER (NOT sk AND NOT de) AS applied, count(*) FILTER (sk) AS skipped, count(*) FILTER (de) AS deleted FROM c")
def aof_replay_stats(s, d):
    return R.aof_stats(I.aof(s, d), LOG_NOW)


@query(f"WITH {I.LOG}, {I.AOF}, {AOF_STATE} SELECT 1 AS kind, key, value, flags, 0::BIGINT AS cas, expires_ns AS expire_unix_ns FROM st")
def aof_rewrite(s, d):
    return R.aof_rewrite(I.aof(s, d), LOG_NOW)


@query("SELECT o_orderkey AS id, c >= 67108864 AND b > 0 AND c * 100 // greatest(b, 1) >= 200 AS rewrite FROM (SELECT o_orderkey, o_orderkey * 100003 AS c, o_orderkey % 7 * 50000 * o_orderkey % 400000000 AS b FROM orders)")
def aof_should_rewrite(s, d):
    o = F.col("o_orderkey")
    return I.table(s, d, "orders").select(o.alias("id"), R.aof_should_rewrite(o * 100003, o % 7 * 50000 * o % 400000000).alias("rewrite"))


@query(f"WITH {I.KV} SELECT key, value, expires_ns, flags, cas FROM kv WHERE {ALIVE}")
def snapshot_alive_rows(s, d):
    return _kv(s, d).iterate(NOW).select("key", "value", "expires_ns", "flags", "cas")


@query(f"WITH {I.KV}, {I.UPD}, snap AS (SELECT key, value, flags, CASE WHEN ttl_ns > 0 THEN {NOW} - 20000000000 + ttl_ns ELSE 0 END::BIGINT AS expires_ns, cas FROM upd), a AS (SELECT * FROM snap WHERE {ALIVE}) "
       f"SELECT key, value, time_ns, expires_ns, flags, cas FROM kv WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT key, value, {NOW}, expires_ns, flags, cas FROM a")
def snapshot_load_merge(s, d):
    from keyloom.sources.snapshot import merge

    return merge(_kv(s, d, usecas=True), _snap(s, d), NOW)[0].state


def _snap(s, d):
    return I.upd(s, d).select("key", "value", F.when(F.col("ttl_ns") > 0, F.lit(NOW - 20 * NS) + F.col("ttl_ns")).otherwise(0).cast("bigint").alias("expires_ns"), "flags", "cas")


@query(f"WITH {I.UPD}, snap AS (SELECT CASE WHEN ttl_ns > 0 THEN {NOW} - 20000000000 + ttl_ns ELSE 0 END::BIGINT AS expires_ns FROM upd) SELECT count(*) FILTER ({ALIVE}) AS inserted, count(*) FILTER (NOT {ALIVE}) AS skipped FROM snap")
def snapshot_load_stats(s, d):
    from keyloom.sources.snapshot import merge

    return merge(_kv(s, d, usecas=True), _snap(s, d), NOW)[1]


@query(f"WITH {I.KV} SELECT key, value, expires_ns, flags, cas FROM kv WHERE {ALIVE}")
def snapshot_roundtrip(s, d):
    from keyloom.sources import snapshot

    path = snapshot.scratch(s)
    snapshot.save(_kv(s, d, usecas=True), path, NOW)
    return snapshot.read(s, path).select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("expire_unix_ns").alias("expires_ns"), "flags", "cas")


@query(f"WITH {I.LOG}, {I.AOF}, {AOF_STATE} SELECT key, value, flags, expires_ns FROM st")
def aof_roundtrip(s, d):
    from keyloom.sources import aof, snapshot

    path = snapshot.scratch(s)
    aof.append(I.aof(s, d), path)
    back = aof.read(s, path).filter("crc_ok").select("pos", "kind", F.col("key").cast("string").alias("key"), F.when(F.col("kind") == 1, F.col("value").cast("string")).alias("value"), "flags", "expire_unix_ns")
    return R.aof_state(back, LOG_NOW)


from keyloom.plans import lifecycle  # noqa: E402, F401  registers its queries beside these
