"""Sweeps, eviction, clearing and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import expr as E
from keyloom.functions.hashing import hash_col, mix13, shard_of, slot_of
from keyloom.operators.state import COLUMNS, CacheTable


def sweep(table: CacheTable, now: int) -> CacheTable:
    """The table without its dead rows."""
    return CacheTable(table.state.filter(E.alive("expires_ns", now)), table.config)


def sweep_counts(table: CacheTable, now: int) -> DataFrame:
    """swept, kept."""
    live = E.alive("expires_ns", now)
    return table.state.agg(F.count_if(~live).cast("bigint").alias("swept"), F.count_if(live).cast("bigint").alias("kept"))


def sweep_poll(table: CacheTable, now: int) -> DataFrame:
    """ratio: the share of dead rows among a few of one shard.

    Shard and starting slot follow from the clock.  A shard's rows are taken in
    the order of their 24-bit slots (bucket positions depend on history).
    """
    import numpy as np

    cfg = table.config
    shard = int(mix13(np.array([now % 2**64], dtype=np.uint64))[0]) % cfg.nshards
    start = int(mix13(np.array([(now + shard) % 2**64], dtype=np.uint64))[0]) % (1 << 24)
    hashed = table.state.withColumn("_h", hash_col("key", cfg.seed)).filter(shard_of(F.col("_h"), cfg.nshards) == shard)
    turned = F.pmod(slot_of(F.col("_h")) - F.lit(start), F.lit(1 << 24))
    sample = hashed.select(turned.alias("at"), "key", E.alive("expires_ns", now).alias("live")).orderBy("at", "key").limit(cfg.pollsize)
    return sample.agg(F.coalesce(F.avg(F.when(F.col("live"), 0.0).otherwise(1.0)), F.lit(0.0)).alias("ratio"))


def autosweep(table: CacheTable, now: int) -> CacheTable:
    """One tick: a full sweep where the poll finds more dead rows than the configured share."""
    return sweep(table, now) if sweep_poll(table, now).first()[0] > table.config.autosweep_ratio else table


def _oldest_first(now: int) -> list[Column]:
    return [E.alive("expires_ns", now).cast("int"), F.col("time_ns"), F.col("key")]


def evict_lru(table: CacheTable, now: int, per_shard: int) -> DataFrame:
    """The rows that go when each shard must give ``per_shard``: dead ones first (Expired), then by last access (LowMem)."""
    rows = table.sharded()
    n = F.row_number().over(Window.partitionBy("shard").orderBy(*_oldest_first(now)))
    return rows.withColumn("rank", n).filter(F.col("rank") <= per_shard).withColumn("reason", F.when(E.alive("expires_ns", now), "LowMem").otherwise("Expired"))


def evict_two_choice(table: CacheTable, inserted: DataFrame, now: int) -> DataFrame:
    """key, victim, reason for each inserted key under memory pressure.

    Of the two rows that follow the key's slot in its shard, with other slots,
    a dead one goes at once; else the one with the older access, the first if
    they tie.  Rows stand in slot order, so each decision sees the same state.
    """
    cfg = table.config

    def placed(df: DataFrame, is_row: int, *more: str) -> DataFrame:
        h = df.select("key", *more).withColumn("_h", hash_col("key", cfg.seed))
        return h.select("key", shard_of(F.col("_h"), cfg.nshards).alias("shard"), slot_of(F.col("_h")).alias("slot"), F.lit(is_row).alias("is_row"), *more)

    rows = placed(table.state, 1, "time_ns", "expires_ns")
    asks = placed(inserted, 0).withColumns({"time_ns": F.lit(0).cast("bigint"), "expires_ns": F.lit(0).cast("bigint")})
    in_shard = Window.partitionBy("shard")
    # rows up to a place in slot order: a request stands behind the rows of its own slot
    upto = F.sum("is_row").over(in_shard.orderBy("slot", F.col("is_row").desc(), "key").rowsBetween(Window.unboundedPreceding, 0))
    line = rows.unionByName(asks).withColumns({"upto": upto, "n": F.sum("is_row").over(in_shard)})
    ranked = line.filter("is_row = 1").select("shard", (F.col("upto") - 1).alias("rank"), F.struct("key", "slot", "time_ns", "expires_ns").alias("row"))
    wanted = line.filter("is_row = 0 AND n > 0").select("key", "shard", "slot", F.pmod("upto", "n").alias("ra"), F.when(F.col("n") > 1, F.pmod(F.col("upto") + 1, F.col("n"))).alias("rb"))
    a = ranked.select("shard", F.col("rank").alias("ra"), F.col("row").alias("a"))
    b = ranked.select("shard", F.col("rank").alias("rb"), F.col("row").alias("b"))
    met = wanted.join(a, ["shard", "ra"]).join(b, ["shard", "rb"], "left").filter("a.slot <> slot").withColumn("b", F.when(F.col("b.slot") != F.col("slot"), F.col("b")))
    a_dead, b_dead = ~E.alive("a.expires_ns", now), F.coalesce(~E.alive("b.expires_ns", now), F.lit(False))
    second = ~a_dead & (b_dead | F.coalesce(F.col("b.time_ns") < F.col("a.time_ns"), F.lit(False)))
    return met.select("key", F.when(second, F.col("b.key")).otherwise(F.col("a.key")).alias("victim"), F.when(a_dead | b_dead, "Expired").otherwise("LowMem").alias("reason"))


def store_evicting(table: CacheTable, writes: DataFrame, now: int, **options) -> tuple[CacheTable, DataFrame]:
    """A store under memory pressure that may evict: the state afterwards, and (key, victim, reason).

    Each write that adds a row, not one that takes the place of a dead row, sends
    one row off by :func:`evict_two_choice`.  All writes of a call look at the state
    after the store, so one row may be the victim of several of them.
    """
    done = table.store(writes, now, **options)
    after = CacheTable(done.filter("present").select(*COLUMNS), table.config)
    added = done.filter("result = 'Inserted'").select("key").join(table.state.select("key"), "key", "left_anti")
    lost = evict_two_choice(after, added, now)
    return CacheTable(after.state.join(lost.select(F.col("victim").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS), table.config), lost


def evict_to_budget(table: CacheTable, now: int, budget: int) -> CacheTable:
    """The table with each shard cut to its share of ``budget`` bytes: dead rows go first, then the longest unused.

    The running sum is per shard, so no task holds more than a shard.
    """
    share = budget // table.config.nshards
    bytes_ = E.entry_mem_size("key", "value", "expires_ns", "flags", table.config.usecas)
    order = [E.alive("expires_ns", now).cast("int").desc(), F.col("time_ns").desc(), F.col("key")]
    used = F.sum(bytes_).over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = table.sharded().withColumn("_used", used).filter(F.col("_used") <= share).drop("_used", "shard")
    return CacheTable(kept, table.config)


def clear_events(table: CacheTable, now: int) -> DataFrame:
    """key, kind: what clearing the table announces for each row."""
    return table.state.select("key", F.when(E.alive("expires_ns", now), "Cleared").otherwise("Expired").alias("kind"))


def sweep_events(table: CacheTable, now: int) -> DataFrame:
    """key, kind, value: the Expired events of a sweep, one for each dead row."""
    return table.state.filter(~E.alive("expires_ns", now)).select("key", F.lit("Expired").alias("kind"), "value")


def touch_events(table: CacheTable, requests: DataFrame, now: int) -> DataFrame:
    """key, kind, value: the Expired events of a load, update or delete of ``requests`` (key): the dead rows that they meet."""
    return sweep_events(table, now).join(requests.select("key").distinct(), "key", "left_semi")


def store_events(table: CacheTable, writes: DataFrame, now: int, **options) -> DataFrame:
    """key, kind, value: what :meth:`CacheTable.store` announces.

    A dead row that a write meets is Expired, with its old value, whatever comes
    of the write; then the row is Inserted or Replaced, with the new one.  A
    write that finds no memory comes before any of this and announces nothing.
    """
    if options.get("lowmem") and table.config.noevict:
        return sweep_events(table, now).limit(0)
    done = table.store(writes, now, **options).filter(F.col("result").isin("Inserted", "Replaced")).select("key", F.col("result").alias("kind"), "value")
    return touch_events(table, writes, now).unionByName(done)


def clear(table: CacheTable) -> CacheTable:
    return CacheTable(table.state.limit(0), table.config)


def cdc_diff(old: CacheTable, new: CacheTable) -> DataFrame:
    """key, kind (Inserted, Replaced, Deleted), old and new value, flags, expiry: the change feed between two states."""
    def side(t: CacheTable, p: str) -> DataFrame:
        return t.state.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("value", "flags", "expires_ns")), F.lit(True).alias(f"_{p}"))

    both = side(old, "old").join(side(new, "new"), "key", "full_outer")
    same = F.col("old_value").eqNullSafe(F.col("new_value")) & F.col("old_flags").eqNullSafe(F.col("new_flags")) & F.col("old_expires_ns").eqNullSafe(F.col("new_expires_ns"))
    kind = F.when(F.col("_old").isNull(), "Inserted").when(F.col("_new").isNull(), "Deleted").when(~same, "Replaced")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").drop("_old", "_new")
