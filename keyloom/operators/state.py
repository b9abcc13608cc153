"""Cache tables: immutable state DataFrames with bulk point operations as joins.

A table's rows are physical: a dead row (expired by the clock of an operation)
stays, and is counted, until an operation touches or sweeps it.  Every
operation takes its clock, so results are reproducible.  Bulk operations take
one request per key; ordered logs of requests go through ``plans.replay``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import expr as E
from keyloom.functions.hashing import hash_col, shard_of
from keyloom.schema import CacheConfig

COLUMNS = ["key", "value", "time_ns", "expires_ns", "flags", "cas"]


@dataclass(frozen=True)
class CacheTable:
    """State (key, value, time_ns, expires_ns, flags, cas) and its options."""

    state: DataFrame
    config: CacheConfig = field(default_factory=CacheConfig)

    # --- point operations -------------------------------------------------
    def load(self, requests: DataFrame, now: int, touch: bool = True) -> DataFrame:
        """key, hit, value, flags, expires_ns, cas, time_ns for each request; a dead row is a miss."""
        live = self.state.filter(E.alive("expires_ns", now)).withColumn("hit", F.lit(True))
        out = requests.select("key").join(live, "key", "left")
        return out.select("key", F.coalesce("hit", F.lit(False)).alias("hit"), "value", "flags", "expires_ns", "cas",
                          (F.when(F.col("hit"), F.greatest("time_ns", F.lit(now))) if touch else F.col("time_ns")).alias("time_ns"))

    def after_load(self, requests: DataFrame, now: int, touch: bool = True) -> CacheTable:
        """The state after a multi-get: dead rows asked for are gone, live ones touched."""
        asked = requests.select("key").distinct().withColumn("_asked", F.lit(True))
        out = self.state.join(asked, "key", "left").filter(F.col("_asked").isNull() | E.alive("expires_ns", now))
        when = F.when(F.col("_asked"), F.greatest("time_ns", F.lit(now))).otherwise(F.col("time_ns")) if touch else F.col("time_ns")
        return self._with(out.withColumn("time_ns", when).select(*COLUMNS))

    def update(self, requests: DataFrame, now: int, value: Callable[[Column], Column] | None = None, flags: Column | None = None,
               expires: Column | None = None, where: Column | None = None, counters: DataFrame | None = None) -> CacheTable:
        """Read-modify-write of the live rows asked for: new value, flags or expiry; where false or null the row is left.

        With ``usecas`` every row written takes its shard's next CAS number, by key.
        """
        asked = requests.select("key").distinct().withColumn("_asked", F.lit(True))
        out = self.state.join(asked, "key", "left").filter(F.col("_asked").isNull() | E.alive("expires_ns", now))
        hit = F.coalesce("_asked", F.lit(False)) & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
        if self.config.usecas:
            numbers = self._numbered(out.filter(hit).select("key"), "key", False, counters).select("key", F.col("number").alias("_next"))
            out = out.join(numbers, "key", "left")
        cas = F.coalesce("_next", "cas").alias("cas") if self.config.usecas else F.col("cas")
        new = {"value": value(F.col("value")) if value else F.col("value"), "flags": flags if flags is not None else F.col("flags"), "expires_ns": expires if expires is not None else F.col("expires_ns")}
        return self._with(out.select("key", F.when(hit, new["value"]).otherwise(F.col("value")).alias("value"),
                                     F.when(F.coalesce("_asked", F.lit(False)), F.greatest("time_ns", F.lit(now))).otherwise(F.col("time_ns")).alias("time_ns"),
                                     F.when(hit, new["expires_ns"]).otherwise(F.col("expires_ns")).alias("expires_ns"),
                                     F.when(hit, new["flags"]).otherwise(F.col("flags")).alias("flags"), cas))

    def store(self, writes: DataFrame, now: int, nx: bool = False, xx: bool = False, casop: bool = False, keepttl: bool = False,
              allow: Column | None = None, lowmem: bool = False, restore_cas: bool = False, order: str = "key", counters: DataFrame | None = None) -> DataFrame:
        """Upsert; returns the outcome: every key of table and writes with its row afterwards, ``present`` and ``result``.

        With ``usecas`` a row stored gets a new CAS number: every attempt takes
        its shard's next one, in the ``order`` of a column of ``writes``, whether
        it succeeds or not.  ``casop`` compares the row's number with the
        request's, so a number that has been used up never matches again.  With
        ``restore_cas`` a request's number, if not 0, is kept and raises the
        shard's counter to it.  ``counters`` (shard, cas) are where the shards
        stand, see :meth:`counters_after`; without it, at the largest number of
        their rows.  Without ``usecas`` rows have the number 0.

        ``writes``: key, value, and optionally flags, ttl_ns, expires_ns, cas;
        one row per key.  ``result`` is Inserted, Replaced, Found, NotFound,
        Canceled or OutOfMemory, null for keys not written.  ``allow`` is tested where a
        live row would be replaced, over o_value, o_flags, n_value, n_flags.
        """
        have = {c.lower() for c in writes.columns}
        opt = {c: (F.col(c).cast("bigint") if c in have else F.lit(0).cast("bigint")) for c in ("flags", "ttl_ns", "expires_ns", "cas")}
        new = writes.select("key", F.col("value").alias("n_value"), opt["flags"].alias("n_flags"), E.resolve_expires(F.lit(now), opt["ttl_ns"], opt["expires_ns"]).alias("n_expires"),
                            opt["cas"].alias("n_cas"), F.lit(True).alias("_w"), F.col(order).alias("_order"))
        if self.config.usecas:
            new = self._numbered(new.withColumn("_cas", F.col("n_cas")), "_order", restore_cas, counters)
        else:
            new = new.withColumn("number", F.lit(0).cast("bigint"))
        old = self.state.select("key", *(F.col(c).alias(f"o_{c}") for c in COLUMNS[1:]), F.lit(True).alias("_o"))
        both = old.join(new, "key", "full_outer")
        written, had = F.coalesce("_w", F.lit(False)), F.coalesce("_o", F.lit(False))
        live = had & E.alive("o_expires_ns", now)
        ok_cas = F.coalesce(F.col("o_cas") == F.col("n_cas"), F.lit(False)) if self.config.usecas else F.lit(False)
        result = F.lit("Inserted")
        if xx or casop:
            result = F.lit("NotFound")
        replaced = F.lit("Replaced")
        if allow is not None:
            replaced = F.when(F.coalesce(allow, F.lit(False)), "Replaced").otherwise("Canceled")
        if casop:
            replaced = F.when(~ok_cas, "Found").otherwise(replaced)
        elif nx:
            replaced = F.lit("Found")
        result = F.when(live, replaced).otherwise(result)
        if lowmem and self.config.noevict:
            result = F.lit("OutOfMemory")
        out = both.withColumn("result", F.when(written, result)).withColumn("_live", live)
        stored = F.coalesce(F.col("result").isin("Inserted", "Replaced"), F.lit(False))
        gone = written & had & ~F.col("_live") & ~stored & (F.col("result") != "OutOfMemory")
        kept = F.when(F.col("_live"), F.col("o_expires_ns")).otherwise(F.col("n_expires")) if keepttl else F.col("n_expires")

        def pick(new_value: Column, name: str) -> Column:
            return F.when(stored, new_value).otherwise(F.col(f"o_{name}")).alias(name)

        return out.withColumn("present", stored | (had & ~gone)).select(
            "key", pick(F.col("n_value"), "value"), pick(F.lit(now).cast("bigint"), "time_ns"), pick(kept, "expires_ns"), pick(F.col("n_flags"), "flags"),
            pick(F.col("number"), "cas"), "present", "result")

    def stored(self, writes: DataFrame, now: int, **options) -> CacheTable:
        """The state after :meth:`store`."""
        return self._with(self.store(writes, now, **options).filter("present").select(*COLUMNS))

    def delete(self, requests: DataFrame, now: int, allow: Column | None = None) -> tuple[CacheTable, DataFrame]:
        """The state afterwards, and key, result (Deleted, NotFound, Canceled) for each request."""
        asked = requests.select("key").distinct()
        ok = F.coalesce(allow, F.lit(False)) if allow is not None else F.lit(True)
        hit = self.state.withColumn("_live", E.alive("expires_ns", now)).withColumn("_ok", ok)
        result = F.when(F.coalesce("_live", F.lit(False)), F.when(F.col("_ok"), "Deleted").otherwise("Canceled")).otherwise("NotFound")
        results = asked.join(hit.select("key", "_live", "_ok"), "key", "left").select("key", result.alias("result"))
        goes = hit.filter(~F.col("_live") | F.col("_ok")).select("key") if allow is not None else None
        if goes is None:
            return self._with(self.state.join(asked, "key", "left_anti")), results
        return self._with(self.state.join(asked.join(goes, "key", "left_semi"), "key", "left_anti")), results

    # --- counts -----------------------------------------------------------
    def sharded(self) -> DataFrame:
        return self.state.withColumn("shard", shard_of(hash_col("key", self.config.seed), self.config.nshards))

    def count(self, shard: int | None = None) -> DataFrame:
        """Physical rows, dead ones too."""
        rows = self.state if shard is None else self.sharded().filter(F.col("shard") == shard)
        return rows.agg(F.count(F.lit(1)).alias("count"))

    def count_by_shard(self) -> DataFrame:
        return self.sharded().groupBy("shard").agg(F.count(F.lit(1)).alias("count"))

    def size(self) -> DataFrame:
        """Bytes of all entries."""
        return self.state.agg(F.coalesce(F.sum(E.entry_mem_size("key", "value", "expires_ns", "flags", self.config.usecas)), F.lit(0)).cast("bigint").alias("bytes"))

    def buckets(self, load_factor: int = 75, first: int = 64) -> DataFrame:
        """shard, count, nbuckets: the slots of a table that doubles when it is ``load_factor`` percent full and was never shrunk."""
        n, slots = F.col("count"), F.when(F.col("count") <= int(first * load_factor / 100), F.lit(first).cast("bigint"))
        for power in range(1, 40):  # the least power of two that holds the rows
            slots = slots.when(n <= int(first * 2**power * load_factor / 100), F.lit(first * 2**power).cast("bigint"))
        return self.count_by_shard().select("shard", "count", slots.alias("nbuckets"))

    def whole_size(self, shard_bytes: int = 0, load_factor: int = 75, first: int = 64) -> DataFrame:
        """Bytes of all entries, of ten a slot, and of ``shard_bytes`` a shard; shards without rows have their first slots."""
        used = self.buckets(load_factor, first).agg(F.coalesce(F.sum("nbuckets"), F.lit(0)).alias("slots"), F.count(F.lit(1)).alias("shards"))
        idle = (F.lit(self.config.nshards) - F.col("shards")) * first
        return self.size().join(used).select((F.col("bytes") + (F.col("slots") + idle) * 10 + shard_bytes * self.config.nshards).cast("bigint").alias("bytes"))

    # --- scans ------------------------------------------------------------
    def iterate(self, now: int, shard: int | None = None) -> DataFrame:
        """Live rows; of one shard if named.  No order."""
        rows = self.state.filter(E.alive("expires_ns", now))
        return rows if shard is None else CacheTable(rows, self.config).sharded().filter(F.col("shard") == shard)

    def iterate_delete(self, now: int, where: Column) -> CacheTable:
        """A scan that deletes the live rows that ``where`` names; dead rows go too."""
        return self._with(self.state.filter(E.alive("expires_ns", now)).filter(~F.coalesce(where, F.lit(False))))

    def iterate_stop(self, now: int, n: int) -> DataFrame:
        """The first n live rows by key: an early stop, under an order that makes it reproducible."""
        return self.state.filter(E.alive("expires_ns", now)).orderBy("key").limit(n)

    def page(self, now: int, n: int, after: tuple[int, str] | None = None) -> DataFrame:
        """n live rows after the cursor (shard, key), by shard and key; the last row is the next cursor."""
        rows = CacheTable(self.state.filter(E.alive("expires_ns", now)), self.config).sharded()
        if after is not None:
            rows = rows.filter((F.col("shard") > after[0]) | ((F.col("shard") == after[0]) & (F.col("key") > after[1])))
        return rows.orderBy("shard", "key").limit(n)

    # --- CAS numbers ------------------------------------------------------
    def _numbered(self, writes: DataFrame, order: str, restore: bool, counters: DataFrame | None) -> DataFrame:
        """``writes`` with the ``number`` that each takes in its shard; a ``_cas`` that is restored is kept and lifts those after it."""
        base = (self.restored_cas() if counters is None else counters).select(F.col("shard").alias("_shard"), F.col("cas").alias("_base"))
        rows = writes.withColumn("_shard", shard_of(hash_col("key", self.config.seed), self.config.nshards)).join(base, "_shard", "left")
        kept = F.coalesce(F.col("_cas") != 0, F.lit(False)) if restore else F.lit(False)
        so_far = Window.partitionBy("_shard").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_n", F.sum(F.when(kept, 0).otherwise(1)).over(so_far))
        first = F.coalesce("_base", F.lit(1).cast("bigint"))
        lifted = F.greatest(first, F.max(F.when(kept, F.col("_cas") - F.col("_n"))).over(so_far)) if restore else first
        number = F.when(kept, F.col("_cas")).otherwise(F.col("_n") + lifted) if restore else F.col("_n") + lifted
        return rows.withColumn("number", number.cast("bigint")).drop("_n", "_base", "_cas")

    def assign_cas(self, writes: DataFrame, order: str, first: DataFrame | None = None) -> DataFrame:
        """``writes`` with the CAS number each store takes: from 2 on in each shard, or after ``first`` (shard, cas)."""
        none = writes.sparkSession.createDataFrame([], "shard int, cas long")
        return self._numbered(writes.drop("cas"), order, False, none if first is None else first).withColumnsRenamed({"_shard": "shard", "number": "cas"})

    def counters_after(self, writes: DataFrame, restore_cas: bool = False, order: str = "key", counters: DataFrame | None = None) -> DataFrame:
        """shard, cas: where the shards' counters stand after :meth:`store` of ``writes``."""
        cas = F.col("cas").cast("bigint") if "cas" in {c.lower() for c in writes.columns} else F.lit(0).cast("bigint")
        taken = self._numbered(writes.select("key", cas.alias("_cas"), F.col(order).alias("_order")), "_order", restore_cas, counters)
        both = taken.select(F.col("_shard").alias("shard"), F.col("number").alias("cas")).unionByName((self.restored_cas() if counters is None else counters).select("shard", "cas"))
        return both.groupBy("shard").agg(F.max("cas").alias("cas"))

    def restored_cas(self) -> DataFrame:
        """shard, cas: the counters after restoring entries with their numbers."""
        return self.sharded().groupBy("shard").agg(F.greatest(F.lit(1), F.max("cas")).cast("bigint").alias("cas"))

    def _with(self, state: DataFrame) -> CacheTable:
        return CacheTable(state, self.config)


def empty(spark, config: CacheConfig | None = None) -> CacheTable:
    """A table without rows."""
    from keyloom.schema import ENTRY

    return CacheTable(spark.createDataFrame([], ENTRY), config or CacheConfig())
