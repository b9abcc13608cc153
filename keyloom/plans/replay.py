"""Replaying a command log (seq, t_ns, op, key, value, nx, xx, keepttl, ttl_ns, flags) into states and results.

The plan depends on what the log holds:

* unconditional SET and DEL only: the last writer wins, a partial aggregate;
* INCR and DECR only: a sum;
* both, without expiry: islands between resets, then sums;
* anything else: an ordered fold per key, as a Column expression over the
  key's sorted commands while keys are of bounded length, else as a stream of
  sorted rows through one state, so that a key of any length takes no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import expr as E
from keyloom.operators.state import CacheTable
from keyloom.plans import model
from keyloom.schema import FOLD, RESULT, CacheConfig

#: Commands of a key up to which the fold gathers them in one array.
ARRAY_LIMIT = 50_000


def last_writer_wins(log: DataFrame) -> DataFrame:
    """key, value, flags after unconditional SET and DEL."""
    last = F.max_by(F.struct("op", "value", "flags", "t_ns"), "seq").alias("l")
    return log.groupBy("key").agg(last).filter("l.op = 'SET'").select("key", "l.value", "l.flags", F.col("l.t_ns").alias("time_ns"))


def counters(log: DataFrame) -> DataFrame:
    """key, value after INCR and DECR alone: commutative, so summed before the shuffle."""
    return log.groupBy("key").agg(F.sum(F.when(F.col("op") == "INCR", 1).otherwise(-1)).cast("bigint").alias("value"))


def counter_islands(log: DataFrame) -> DataFrame:
    """key, value after INCR, DECR, unconditional SET and DEL without expiry.

    Only what follows a key's last reset counts, so resets are found by a
    partial aggregate and the rest is a sum; a SET to a non-integer makes
    the counter's commands fail, and the value stays.
    """
    resets = log.filter(F.col("op").isin("SET", "DEL")).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("r"), F.max("seq").alias("_at"))
    joined = log.join(resets, "key", "left").filter(F.col("_at").isNull() | (F.col("seq") >= F.col("_at")))
    delta = F.when(F.col("op") == "INCR", 1).when(F.col("op") == "DECR", -1).otherwise(0)
    out = joined.groupBy("key").agg(F.sum(delta).cast("bigint").alias("d"), F.count_if(F.col("op").isin("INCR", "DECR")).alias("n"), F.first("r").alias("r"))
    base = F.when(F.col("r.op") == "SET", F.col("r.value"))
    value = F.when(base.isNull(), F.col("d").cast("string")).when((F.col("n") == 0) | E.parse_long(base).isNull(), base).otherwise((E.parse_long(base) + F.col("d")).cast("string"))
    return out.filter((F.col("n") > 0) | base.isNotNull()).select("key", value.alias("value"))


def _step(s: Column, c: Column) -> Column:
    """The state machine as a Column: struct state, struct command."""
    t, op = c["t_ns"], c["op"]
    live = s["phys"] & ((s["expires_ns"] == 0) | (s["expires_ns"] > t))
    zero = F.lit(0).cast("bigint")

    def state(phys: Column | bool, value: Column, expires: Column, flags: Column, time: Column, total: Column, burned: Column) -> Column:
        p = F.lit(phys) if isinstance(phys, bool) else phys
        return F.struct(p.alias("phys"), value.alias("value"), expires.alias("expires_ns"), flags.alias("flags"), time.alias("time_ns"), total.alias("total"), burned.alias("burned")).cast(f"struct<{FOLD.replace(' ', ':')}>".replace(",:", ","))

    none = F.lit(None).cast("string")

    def gone(burned: Column) -> Column:
        return state(False, none, zero, zero, zero, s["total"], burned)

    def touched(value: Column, expires: Column, burned: Column) -> Column:
        return state(True, value, expires, s["flags"], t, s["total"], burned)

    burn = s["burned"] + 1
    expires = F.when(c["keepttl"] & live, s["expires_ns"]).when(c["ttl_ns"] > 0, E.sat_add(t, c["ttl_ns"])).otherwise(zero)
    put = state(True, c["value"], expires, c["flags"], t, s["total"] + F.when(s["phys"], 0).otherwise(1), burn)
    same = state(s["phys"], s["value"], s["expires_ns"], s["flags"], s["time_ns"], s["total"], burn)
    setting = F.when(live & c["nx"], same).when(~live & c["xx"], gone(burn)).otherwise(put)
    delta = F.when(op == "INCR", 1).otherwise(-1).cast("bigint")
    number = F.try_add(E.parse_long(s["value"]), delta)
    counted = (F.when(~live, state(True, delta.cast("string"), zero, zero, t, s["total"] + 1, burn))
               .when(number.isNull(), touched(s["value"], s["expires_ns"], s["burned"])).otherwise(touched(number.cast("string"), s["expires_ns"], burn)))
    read = F.when(live, touched(s["value"], s["expires_ns"], s["burned"])).otherwise(gone(s["burned"]))
    lives = F.when(live, touched(s["value"], F.greatest(E.sat_add(t, c["ttl_ns"]), F.lit(1).cast("bigint")), burn)).otherwise(gone(s["burned"]))
    return (F.when(op == "SET", setting).when(op.isin("INCR", "DECR"), counted).when(op.isin("GET", "TTL"), read)
            .when(op == "DEL", gone(s["burned"])).when(op == "EXPIRE", lives).otherwise(s))


def replay(log: DataFrame) -> DataFrame:
    """key and its state (phys, value, expires_ns, flags, time_ns, total, burned) after the whole log; keys that left no row too."""
    most = log.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    return fold(log) if most <= ARRAY_LIMIT else fold_sorted(log)


def fold(log: DataFrame) -> DataFrame:
    """The fold in the JVM: a key's commands gathered, sorted by seq, reduced."""
    start = F.struct(F.lit(False).alias("phys"), F.lit(None).cast("string").alias("value"), *(F.lit(0).cast("bigint").alias(x) for x in ("expires_ns", "flags", "time_ns", "total", "burned")))
    cmds = F.array_sort(F.collect_list(F.struct("seq", "t_ns", "op", "value", "nx", "xx", "keepttl", "ttl_ns", "flags")))
    return log.groupBy("key").agg(F.aggregate(cmds, start, _step).alias("s")).select("key", "s.*")


_ARGS = ("t_ns", "value", "nx", "xx", "keepttl", "ttl_ns", "flags")


def _sorted(log: DataFrame) -> DataFrame:
    return log.select("key", "seq", "op", *_ARGS).repartition("key").sortWithinPartitions("key", "seq")


def fold_sorted(log: DataFrame) -> DataFrame:
    """The fold over rows sorted by key and seq: one state at a time, whatever the key's length."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        key, s, out = None, model.EMPTY, []
        for b in batches:
            for r in b.itertuples(index=False):
                if r.key != key:
                    if key is not None:
                        out.append((key, *s))
                    key, s = r.key, model.EMPTY
                s = model.step(s, r.op, r.t_ns, r.value, r.nx, r.xx, r.keepttl, r.ttl_ns, r.flags)[0]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["key", *model.State._fields])
                out = []
        if key is not None:
            out.append((key, *s))
        yield pd.DataFrame(out, columns=["key", *model.State._fields])

    return _sorted(log).mapInPandas(run, f"key string, {FOLD}")


def results(log: DataFrame) -> DataFrame:
    """seq, key, op, result, reply of every command."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        key, s = None, model.EMPTY
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.key != key:
                    key, s = r.key, model.EMPTY
                s, result, reply = model.step(s, r.op, r.t_ns, r.value, r.nx, r.xx, r.keepttl, r.ttl_ns, r.flags)
                out.append((r.seq, r.key, r.op, result, reply))
            yield pd.DataFrame(out, columns=["seq", "key", "op", "result", "reply"])

    return _sorted(log).mapInPandas(run, RESULT)


def total_inserts(log: DataFrame) -> DataFrame:
    """total: new keys ever inserted."""
    return replay(log).agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"))


def aof_state(aof: DataFrame, now: int, config: CacheConfig | None = None) -> DataFrame:
    """key, value, flags, expires_ns (and cas, if ``config`` uses it) after an append-only log (pos, kind 1 set / 2 del / 3 expire, key, value, flags, expire_unix_ns), judged at ``now``.

    Sets already expired are dropped first, so an older one may show again.  Then
    the last set or delete of a key decides (an expire that is past or 0 is a
    delete), and the last live expire after it sets the expiry.

    A set keeps its recorded CAS number and lifts its shard's counter to it; one
    without, and an expire of a key that is there, take the shard's next number.
    """
    e = F.col("expire_unix_ns")
    live = aof.filter(~((F.col("kind") == 1) & (e > 0) & (e <= now)))
    decides = F.when(F.col("kind") == 1, "set").when((F.col("kind") == 2) | (e == 0) | (e <= now), "del").otherwise("exp")
    d = live.withColumn("d", decides)
    last = F.max_by(F.when(F.col("d") != "exp", F.struct("d", "value", "flags", "expire_unix_ns")), F.when(F.col("d") != "exp", F.col("pos"))).alias("l")
    out = d.groupBy("key").agg(last, F.max(F.when(F.col("d") != "exp", F.col("pos"))).alias("at"), F.max_by(F.when(F.col("d") == "exp", e), F.when(F.col("d") == "exp", F.col("pos"))).alias("x"), F.max(F.when(F.col("d") == "exp", F.col("pos"))).alias("xat"))
    state = out.filter("l.d = 'set'").select("key", "l.value", "l.flags", F.when(F.col("xat") > F.col("at"), F.col("x")).otherwise(F.col("l.expire_unix_ns")).alias("expires_ns"))
    return state.join(_aof_numbers(d, config), "key") if config is not None and config.usecas else state


def _aof_numbers(judged: DataFrame, config: CacheConfig) -> DataFrame:
    """key, cas: the last number that each key's records took."""
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    there = F.last(F.when(F.col("d") != "exp", F.col("d")), ignorenulls=True).over(before)
    took = judged.withColumn("there", there).filter((F.col("d") == "set") | ((F.col("d") == "exp") & (F.col("there") == "set")))
    took = took.select("key", "pos", F.when(F.col("d") == "set", F.col("cas")).otherwise(0).cast("bigint").alias("_cas"))
    none = judged.sparkSession.createDataFrame([], "shard int, cas long")
    numbers = CacheTable(judged, config)._numbered(took, "pos", True, none)
    return numbers.groupBy("key").agg(F.max_by("number", "pos").alias("cas"))


def aof_stats(aof: DataFrame, now: int) -> DataFrame:
    """applied, skipped, deleted."""
    e, k = F.col("expire_unix_ns"), F.col("kind")
    skipped = (k == 1) & (e > 0) & (e <= now)
    deleted = (k == 2) | ((k == 3) & ((e == 0) | (e <= now)))
    return aof.agg(F.count_if(~skipped & ~deleted).cast("bigint").alias("applied"), F.count_if(skipped).cast("bigint").alias("skipped"), F.count_if(deleted).cast("bigint").alias("deleted"))


def aof_rewrite(aof: DataFrame, now: int, config: CacheConfig | None = None) -> DataFrame:
    """The compacted log: one set per live key, with its CAS number if ``config`` uses it (else 0)."""
    state = aof_state(aof, now, config)
    cas = F.col("cas") if "cas" in state.columns else F.lit(0).cast("bigint").alias("cas")
    return state.select(F.lit(1).alias("kind"), "key", "value", "flags", cas, F.col("expires_ns").alias("expire_unix_ns"))


def aof_should_rewrite(current: Column, base: Column, percentage: int = 100, min_size: int = 64 * 1024 * 1024) -> Column:
    """Whether a log has grown enough over its size after the last rewrite; a least size of 0 turns it off."""
    if min_size == 0:
        return F.lit(False)
    return (current >= min_size) & (base > 0) & (F.call_function("div", current * 100, F.greatest(base, F.lit(1))) >= 100 + percentage)


def cas_sequence(log: DataFrame, shard: Column) -> DataFrame:
    """seq, key, shard, cas of a log of stores only: every attempt burns a number, the first is 2."""
    n = F.count(F.lit(1)).over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("shard", shard).select("seq", "key", "shard", (n + 1).cast("bigint").alias("cas"))
