"""Scenarios with an explicit clock."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import maintenance as M
from keyloom.operators.state import CacheTable, empty
from keyloom.schema import ENTRY, CacheConfig

E = "key string, value string, time_ns long, expires_ns long, flags long, cas long"


def table(spark, rows, **options):
    return CacheTable(spark.createDataFrame(rows, ENTRY), CacheConfig(nshards=1, **options))


def writes(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string, cas long, ttl_ns long, expires_ns long, flags long")


def w(key, value, cas=0, ttl=0, expires=0, flags=0):
    return key, value, cas, ttl, expires, flags


def result(outcome):
    return {r.key: r.result for r in outcome.collect() if r.result}


def state(t):
    return {r.key: tuple(r)[1:] for r in t.state.collect()}


def test_conditions(spark):
    t = empty(spark, CacheConfig(nshards=1, usecas=True))
    assert result(t.store(writes(spark, w("k", "v1", 2)), 10)) == {"k": "Inserted"}
    t = t.stored(writes(spark, w("k", "v1", 2)), 10)
    assert result(t.store(writes(spark, w("k", "v2", 3)), 11, casop=True)) == {"k": "Found"}
    assert result(t.store(writes(spark, w("k", "v2", 2)), 11, casop=True, nx=True)) == {"k": "Replaced"}
    assert result(t.store(writes(spark, w("q", "v", 2)), 11, casop=True)) == {"q": "NotFound"}
    assert result(t.store(writes(spark, w("k", "v2")), 11, nx=True)) == {"k": "Found"}
    assert result(t.store(writes(spark, w("q", "v")), 11, xx=True)) == {"q": "NotFound"}
    assert result(t.store(writes(spark, w("k", "v2")), 11, xx=True)) == {"k": "Replaced"}
    assert result(t.store(writes(spark, w("k", "v2")), 11, allow=F.lit(False))) == {"k": "Canceled"}
    assert result(CacheTable(t.state, CacheConfig(nshards=1, noevict=True)).store(writes(spark, w("k", "v2")), 11, lowmem=True)) == {"k": "OutOfMemory"}


def test_without_cas_numbers_casop_never_matches(spark):
    t = table(spark, [("k", "v", 1, 0, 0, 7)])
    assert result(t.store(writes(spark, w("k", "x", 7)), 2, casop=True)) == {"k": "Found"}


def test_keepttl_and_plain_set(spark):
    t = table(spark, [("k", "v1", 10, 50, 3, 0)])
    assert state(t.stored(writes(spark, w("k", "v2", expires=100)), 20, keepttl=True))["k"][:3] == ("v2", 20, 50)
    assert state(t.stored(writes(spark, w("k", "v2")), 20))["k"] == ("v2", 20, 0, 0, 0)


def test_touch_and_notouch(spark):
    t = table(spark, [("k", "v", 100, 0, 0, 0)])
    ask = spark.createDataFrame([("k",)], "key string")
    assert state(t.after_load(ask, 200, touch=False))["k"][1] == 100
    assert state(t.after_load(ask, 300))["k"][1] == 300


def test_lazy_expiry(spark):
    t = table(spark, [("k", "v", 10, 20, 0, 0), ("other", "v", 10, 20, 0, 0)])
    ask = spark.createDataFrame([("k",)], "key string")
    assert [r.hit for r in t.load(ask, 30).collect()] == [False]
    assert t.count().first()[0] == 2  # the dead are counted until touched
    assert set(state(t.after_load(ask, 30))) == {"other"}


def test_xx_on_a_dead_row_removes_it(spark):
    t = table(spark, [("k", "v", 10, 20, 0, 0)])
    out = t.store(writes(spark, w("k", "x")), 30, xx=True)
    assert result(out) == {"k": "NotFound"}
    assert state(t.stored(writes(spark, w("k", "x")), 30, xx=True)) == {}


def test_sweep_clear_delete(spark):
    t = table(spark, [("dead", "v", 10, 15, 0, 0), ("live", "v", 10, 0, 0, 0)])
    assert tuple(M.sweep_counts(t, 20).first()) == (1, 1)
    assert set(state(M.sweep(t, 20))) == {"live"}
    assert {tuple(r) for r in M.clear_events(t, 20).collect()} == {("dead", "Expired"), ("live", "Cleared")}
    assert state(M.clear(t)) == {}
    ask = spark.createDataFrame([("dead",), ("live",), ("none",)], "key string")
    after, results = t.delete(ask, 20)
    assert {tuple(r) for r in results.collect()} == {("dead", "NotFound"), ("live", "Deleted"), ("none", "NotFound")}
    assert state(after) == {}
    after, results = t.delete(ask, 20, allow=F.lit(False))
    assert dict(map(tuple, results.collect()))["live"] == "Canceled"
    assert set(state(after)) == {"live"}


def test_autosweep(spark):
    t = table(spark, [(f"k{i}", "v", 1, 5 if i % 2 else 0, 0, 0) for i in range(10)])
    assert M.sweep_poll(t, 10).first()[0] == 0.5
    assert M.autosweep(t, 10).count().first()[0] == 5
    assert M.autosweep(t, 3).count().first()[0] == 10


@pytest.mark.parametrize(("rows", "victim", "reason"), [([("a", "v", 10, 15, 0, 0), ("b", "v", 12, 0, 0, 0)], "a", "Expired"), ([("a", "v", 10, 0, 0, 0), ("b", "v", 20, 0, 0, 0)], "a", "LowMem")])
def test_two_choice(spark, rows, victim, reason):
    out = M.evict_two_choice(table(spark, rows), spark.createDataFrame([("c",)], "key string"), 30).collect()
    assert [(r.victim, r.reason) for r in out] == [(victim, reason)]


def test_iterate(spark):
    t = table(spark, [(f"k{i}", "v", 1, 0, i % 2, 0) for i in range(6)])
    assert [r.key for r in t.iterate_stop(5, 2).collect()] == ["k0", "k1"]
    assert set(state(t.iterate_delete(5, F.col("flags") == 1))) == {"k0", "k2", "k4"}
    seen, after = [], None
    while rows := t.page(5, 4, after).collect():
        seen += [r.key for r in rows]
        after = (rows[-1].shard, rows[-1].key)
    assert seen == [f"k{i}" for i in range(6)]


def test_update_and_feed(spark):
    t = table(spark, [("a", "1", 1, 9, 0, 0), ("b", "2", 1, 0, 1, 0)])
    ask = spark.createDataFrame([("a",), ("b",)], "key string")
    new = t.update(ask, 5, value=lambda v: F.concat(v, F.lit("!")), where=F.col("flags") == 0)
    assert state(new) == {"a": ("1!", 5, 9, 0, 0), "b": ("2", 5, 0, 1, 0)}
    assert [(r.key, r.kind, r.old_value, r.new_value) for r in M.cdc_diff(t, new).collect()] == [("a", "Replaced", "1", "1!")]


def test_cas_numbers(spark):
    t = table(spark, [])
    got = t.assign_cas(spark.createDataFrame([(i, f"k{i}") for i in range(3)], "seq long, key string"), "seq").collect()
    assert sorted((r.seq, r.cas) for r in got) == [(0, 2), (1, 3), (2, 4)]
    assert table(spark, [("a", "v", 0, 0, 0, 9), ("b", "v", 0, 0, 0, 4)]).restored_cas().first().cas == 9


def test_events_of_dead_rows(spark):
    t = table(spark, [("dead", "1", 1, 5, 0, 0), ("live", "2", 1, 0, 0, 0), ("other", "3", 1, 5, 0, 0)])
    kinds = lambda df: sorted(map(tuple, df.collect()))
    assert kinds(M.sweep_events(t, 9)) == [("dead", "Expired", "1"), ("other", "Expired", "3")]
    assert kinds(M.touch_events(t, spark.createDataFrame([("dead",), ("dead",), ("none",), (None,)], "key string"), 9)) == [("dead", "Expired", "1")]
    w = spark.createDataFrame([("dead", "x"), ("live", "y"), ("new", "z")], "key string, value string")
    assert kinds(M.store_events(t, w, 9)) == [("dead", "Expired", "1"), ("dead", "Inserted", "x"), ("live", "Replaced", "y"), ("new", "Inserted", "z")]
    assert kinds(M.store_events(t, w, 9, xx=True)) == [("dead", "Expired", "1"), ("live", "Replaced", "y")]
    assert kinds(M.store_events(CacheTable(t.state, CacheConfig(noevict=True)), w, 9, lowmem=True)) == []


def test_inserts_under_pressure_send_rows_off(spark):
    t = table(spark, [("a", "1", 1, 0, 0, 0), ("b", "2", 5, 0, 0, 0), ("dead", "3", 9, 5, 0, 0)])
    w = spark.createDataFrame([("a", "x"), ("dead", "y")], "key string, value string")
    after, lost = M.store_evicting(t, w, 9, lowmem=True)  # neither adds a row
    assert sorted(state(after)) == ["a", "b", "dead"] and lost.count() == 0
    after, lost = M.store_evicting(t, spark.createDataFrame([("new", "z")], "key string, value string"), 9, lowmem=True)
    gone = lost.first()
    assert gone.key == "new" and gone.victim in ("a", "b", "dead") and sorted(state(after)) == sorted({"a", "b", "dead", "new"} - {gone.victim})
    assert M.store_evicting(empty(spark), w.limit(0), 9, lowmem=True)[0].state.count() == 0
