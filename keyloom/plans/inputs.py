"""Inputs of the registered queries, derived from the driver's tables; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = 1_000_000_000
#: The clock of the queries over ``kv``.
NOW = 50 * NS
#: The clock of log replays: some days into the events.
LOG_NOW = 1_705_000_000 * NS
NSHARDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer:"), k.cast("string")).alias("key"), F.col("c_name").alias("value"), (k * NS).alias("time_ns"),
        F.when(k % 4 == 0, 0).otherwise((k % 100 + 1) * NS).cast("bigint").alias("expires_ns"), F.col("c_nationkey").cast("bigint").alias("flags"), (k + 1).alias("cas"))


KV = f"""kv AS (SELECT 'customer:' || c_custkey AS key, c_name AS value, c_custkey * {NS} AS time_ns,
 CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE (c_custkey % 100 + 1) * {NS} END::BIGINT AS expires_ns, c_nationkey::BIGINT AS flags, c_custkey + 1 AS cas FROM customer)"""


def req(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys asked for: those of orders, and some that do not exist."""
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("key"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("missing:"), F.col("s_suppkey").cast("string")).alias("key"))
    return a.union(b).distinct()


REQ = "req AS (SELECT DISTINCT 'customer:' || o_custkey AS key FROM orders UNION SELECT 'missing:' || s_suppkey FROM supplier)"


def upd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes: suppliers onto every third customer and onto new keys."""
    s = F.col("s_suppkey")
    src = table(spark, sf_dir, "supplier")
    ttl = F.when(s % 2 == 0, s * NS).otherwise(0).cast("bigint").alias("ttl_ns")
    flags = F.col("s_nationkey").cast("bigint").alias("flags")
    cas = (s * 3 + 1 + s % 2).alias("cas")
    old = src.select(F.concat(F.lit("customer:"), (s * 3).cast("string")).alias("key"), F.col("s_name").alias("value"), flags, ttl, cas)
    new = src.select(F.concat(F.lit("new:"), s.cast("string")).alias("key"), F.col("s_name").alias("value"), flags, ttl, cas)
    return old.union(new)


UPD = f"""upd AS (SELECT p || (s_suppkey * f) AS key, s_name AS value, s_nationkey::BIGINT AS flags,
 CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * {NS} ELSE 0 END::BIGINT AS ttl_ns, s_suppkey * 3 + 1 + s_suppkey % 2 AS cas
 FROM supplier, (VALUES ('customer:', 3), ('new:', 1)) v(p, f))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a command log."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    t = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    e = F.col("event_type")
    op = (F.when(e == "signup", "SET").when(e == "click", "INCR").when(e == "purchase", "DECR").when((e == "view") & (k % 2 == 0), "GET").when(e == "view", "TTL")
          .when(k < 50, "DEL").otherwise("EXPIRE"))
    ttl = F.when(e == "signup", F.when(k % 3 == 0, 0).otherwise(k * 3600 * NS)).when((e == "error") & (k >= 50), k * 600 * NS).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), t.alias("t_ns"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(e == "signup", k.cast("string")).alias("value"), ((e == "signup") & (k % 5 == 0)).alias("nx"), ((e == "signup") & (k % 5 == 1)).alias("xx"),
        F.lit(False).alias("keepttl"), ttl.cast("bigint").alias("ttl_ns"), F.when(e == "signup", k % 7).otherwise(0).cast("bigint").alias("flags"))


LOG = f"""ev AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS t_ns, event_type AS e, 'user:' || user_id AS key, (props->>'$.k')::BIGINT AS k FROM events),
log AS (SELECT seq, t_ns, CASE WHEN e = 'signup' THEN 'SET' WHEN e = 'click' THEN 'INCR' WHEN e = 'purchase' THEN 'DECR' WHEN e = 'view' AND k % 2 = 0 THEN 'GET'
 WHEN e = 'view' THEN 'TTL' WHEN k < 50 THEN 'DEL' ELSE 'EXPIRE' END AS op, key, CASE WHEN e = 'signup' THEN k::VARCHAR END AS value,
 e = 'signup' AND k % 5 = 0 AS nx, e = 'signup' AND k % 5 = 1 AS xx,
 CASE WHEN e = 'signup' THEN CASE WHEN k % 3 = 0 THEN 0 ELSE k * 3600 * {NS} END WHEN e = 'error' AND k >= 50 THEN k * 600 * {NS} ELSE 0 END::BIGINT AS ttl_ns,
 CASE WHEN e = 'signup' THEN k % 7 ELSE 0 END::BIGINT AS flags FROM ev)"""


def aof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's sets, deletes and expires as append-only records with absolute expiry."""
    c = log(spark, sf_dir).filter(F.col("op").isin("SET", "DEL", "EXPIRE"))
    expire = F.when(F.col("ttl_ns") > 0, F.col("t_ns") + F.col("ttl_ns")).otherwise(0).cast("bigint")
    kind = F.when(F.col("op") == "SET", 1).when(F.col("op") == "DEL", 2).otherwise(3)
    return c.select(F.col("seq").alias("pos"), kind.alias("kind"), "key", "value", "flags", F.lit(0).cast("bigint").alias("cas"), expire.alias("expire_unix_ns"))


AOF = """aof AS (SELECT seq AS pos, CASE op WHEN 'SET' THEN 1 WHEN 'DEL' THEN 2 ELSE 3 END AS kind, key, value, flags,
 CASE WHEN ttl_ns > 0 THEN t_ns + ttl_ns ELSE 0 END::BIGINT AS expire_unix_ns FROM log WHERE op IN ('SET', 'DEL', 'EXPIRE'))"""

#: The state machine, one command of each key at a time.
REPLAY = """r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM log),
f AS (SELECT DISTINCT key, 0::BIGINT AS rn, 0::BIGINT AS seq, '' AS op, false AS phys, NULL::VARCHAR AS value, 0::BIGINT AS expires_ns, 0::BIGINT AS flags, 0::BIGINT AS time_ns, 0::BIGINT AS total, 0::BIGINT AS burned, '' AS result, '' AS reply FROM log
 UNION ALL
 SELECT key, rn, seq, op,
  CASE WHEN op = 'SET' THEN CASE WHEN live AND nx THEN true WHEN NOT live AND xx THEN false ELSE true END WHEN op IN ('INCR', 'DECR') THEN true WHEN op = 'DEL' THEN false ELSE live END,
  CASE WHEN op = 'SET' THEN CASE WHEN live AND nx THEN old WHEN NOT live AND xx THEN NULL ELSE value END WHEN op = 'INCR' THEN CASE WHEN live THEN (old::BIGINT + 1)::VARCHAR ELSE '1' END
       WHEN op = 'DECR' THEN CASE WHEN live THEN (old::BIGINT - 1)::VARCHAR ELSE '-1' END WHEN op = 'DEL' THEN NULL WHEN live THEN old END,
  CASE WHEN op = 'SET' THEN CASE WHEN live AND nx THEN ex WHEN NOT live AND xx THEN 0 WHEN ttl_ns > 0 THEN t_ns + ttl_ns ELSE 0 END WHEN op = 'EXPIRE' AND live THEN t_ns + ttl_ns WHEN op <> 'DEL' AND live THEN ex ELSE 0 END,
  CASE WHEN op = 'SET' THEN CASE WHEN live AND nx THEN fl WHEN NOT live AND xx THEN 0 ELSE flags END WHEN op <> 'DEL' AND live THEN fl ELSE 0 END,
  CASE WHEN op = 'SET' THEN CASE WHEN live AND nx THEN tm WHEN NOT live AND xx THEN 0 ELSE t_ns END WHEN op = 'DEL' THEN 0 WHEN live OR op IN ('INCR', 'DECR') THEN t_ns ELSE 0 END,
  total + CASE WHEN op = 'SET' AND NOT (live AND nx) AND NOT (NOT live AND xx) AND NOT phys THEN 1 WHEN op IN ('INCR', 'DECR') AND NOT live THEN 1 ELSE 0 END,
  burned + CASE WHEN op IN ('SET', 'INCR', 'DECR') OR (op = 'EXPIRE' AND live) THEN 1 ELSE 0 END,
  CASE op WHEN 'SET' THEN CASE WHEN live AND nx THEN 'Found' WHEN NOT live AND xx THEN 'NotFound' WHEN live THEN 'Replaced' ELSE 'Inserted' END WHEN 'DEL' THEN CASE WHEN live THEN 'Deleted' ELSE 'NotFound' END
       WHEN 'EXPIRE' THEN CASE WHEN live THEN 'Updated' ELSE 'NotFound' END WHEN 'GET' THEN CASE WHEN live THEN 'Hit' ELSE 'Miss' END WHEN 'TTL' THEN CASE WHEN live THEN 'Hit' ELSE 'Miss' END ELSE CASE WHEN live THEN 'Updated' ELSE 'Inserted' END END,
  CASE op WHEN 'SET' THEN CASE WHEN (live AND nx) OR (NOT live AND xx) THEN '$-1' ELSE '+OK' END WHEN 'DEL' THEN CASE WHEN live THEN ':1' ELSE ':0' END WHEN 'EXPIRE' THEN CASE WHEN live THEN ':1' ELSE ':0' END
       WHEN 'GET' THEN CASE WHEN live THEN '$' || old ELSE '$-1' END WHEN 'TTL' THEN CASE WHEN NOT live THEN ':-2' WHEN ex = 0 THEN ':-1' ELSE ':' || ((ex - t_ns) // 1000000000) END
       WHEN 'INCR' THEN ':' || CASE WHEN live THEN old::BIGINT + 1 ELSE 1 END ELSE ':' || CASE WHEN live THEN old::BIGINT - 1 ELSE -1 END END
 FROM (SELECT r.*, f.phys, f.value AS old, f.expires_ns AS ex, f.flags AS fl, f.time_ns AS tm, f.total, f.burned, f.phys AND (f.expires_ns = 0 OR f.expires_ns > r.t_ns) AS live
       FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1) x),
last AS (SELECT f.* FROM f JOIN (SELECT key, max(rn) AS rn FROM r GROUP BY key) m ON m.key = f.key AND m.rn = f.rn)"""


def th64(key: str, seed: int = 0) -> str:
    """SQL of the 64-bit hash of an ASCII text, as an unsigned 128-bit number."""
    m = "18446744073709551616::UHUGEINT"
    r = f"{0x14020A57ACCED8B7}::UHUGEINT"

    def mul(a: str) -> str:
        return f"((({a}) * {r}) % {m})"

    def turn(a: str) -> str:
        return f"(((({a}) << 31::UHUGEINT) % {m}) | (({a}) >> 33::UHUGEINT))"

    words = (f"list_transform(range(0, len({key}) // 8), lambda w: list_reduce(list_transform(range(0, 8), lambda b: ord(substr({key}, (w * 8 + b + 1)::BIGINT, 1))::UHUGEINT << (8 * b)::UHUGEINT), lambda p, q: p | q))")
    x = turn(mul("x"))
    h = turn(f"xor({mul('h')}, {x})")
    body = f"list_reduce(list_concat([{seed}::UHUGEINT], {words}), lambda h, x: {h})"
    tail = f"list_transform(range(len({key}) // 8 * 8, len({key})), lambda b: ord(substr({key}, (b + 1)::BIGINT, 1))::UHUGEINT)"
    mixed = f"list_reduce(list_concat([{body}], {tail}), lambda h, x: xor({mul('h')}, x))"
    summed = f"(({mul(mixed)} + len({key})::UHUGEINT) % {m})"
    fin = f"list_reduce(list_concat([{summed}], [0::UHUGEINT, 0::UHUGEINT, 0::UHUGEINT]), lambda h, x: {mul('xor(h, h >> 31::UHUGEINT)')})"
    return fin
