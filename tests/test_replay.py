"""The Column fold, the sorted fold and the stream against the plain state machine."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.plans import model
from keyloom.plans import replay as R
from keyloom.schema import COMMAND

OPS = ["SET"] * 4 + ["GET", "TTL", "DEL", "INCR", "DECR", "EXPIRE", "EXPIRE"]


def random_log(seed, n=400, keys=9):
    rng, out, t = random.Random(seed), [], 1000
    for i in range(n):
        t += rng.randint(0, 3)
        op = rng.choice(OPS)
        cond = rng.random()
        ttl = rng.choice([0, 0, 2, 5, 20, 2**63 - 5]) if op == "SET" else rng.choice([-3, 0, 1, 6, 30]) if op == "EXPIRE" else 0
        value = rng.choice(["1", "-7", "x", "", "9223372036854775807", "+3", "1_0"]) if op == "SET" else None
        out.append((i, t, op, f"k{rng.randrange(keys)}", value, op == "SET" and cond < 0.2, op == "SET" and 0.2 <= cond < 0.4, op == "SET" and rng.random() < 0.2, ttl, rng.randrange(3)))
    return out


def expected(log):
    states, results = {}, []
    for seq, t, op, key, value, nx, xx, keep, ttl, flags in sorted(log):
        states[key], result, reply = model.step(states.get(key, model.EMPTY), op, t, value, nx, xx, keep, ttl, flags)
        results.append((seq, key, op, result, reply))
    return states, results


@pytest.mark.parametrize("seed", range(4))
def test_folds(spark, seed):
    log = random_log(seed)
    states, results = expected(log)
    df = spark.createDataFrame(random.Random(seed).sample(log, len(log)), COMMAND)
    want = {(k, *s) for k, s in states.items()}
    assert {tuple(r) for r in R.fold(df).collect()} == want
    assert {tuple(r) for r in R.fold_sorted(df).collect()} == want
    assert sorted(tuple(r) for r in R.results(df).collect()) == results


def test_islands(spark):
    rng = random.Random(5)
    log = [r for r in random_log(7, 600) if r[2] in ("SET", "DEL", "INCR", "DECR")]
    log = [(i, t, op, key, rng.choice(["5", "x", "-2"]) if op == "SET" else None, False, False, False, 0, 0) for i, t, op, key, *_ in log]
    states, _ = expected(log)
    got = dict(map(tuple, R.counter_islands(spark.createDataFrame(log, COMMAND)).collect()))
    assert got == {k: s.value for k, s in states.items() if s.phys}


def test_transitions():
    run = model.step
    alive, dead = model.State(True, "10", 0, 5, 1, 1, 0), model.State(True, "10", 3, 5, 1, 1, 0)
    assert run(alive, "INCR", 9)[2] == ":11" and run(alive, "DECR", 9)[2] == ":9"
    assert run(model.EMPTY, "DECR", 9)[1:] == ("Inserted", ":-1")
    assert run(dead, "INCR", 9)[0].total == 2 and run(dead, "SET", 9, "v")[0].total == 1  # the asymmetry of dead rows
    assert run(alive._replace(value="abc"), "INCR", 9)[1:] == ("NotInteger", "-ERR value is not an integer")
    assert run(alive._replace(value=str(2**63 - 1)), "INCR", 9)[1] == "NotInteger"
    assert [run(s, "TTL", 9)[2] for s in (model.EMPTY, dead, alive, alive._replace(expires_ns=9 + 2_500_000_000))] == [":-2", ":-2", ":-1", ":2"]
    gone = run(alive, "EXPIRE", 9, ttl=0)
    assert gone[2] == ":1" and not model.alive(gone[0], 9)
    assert run(alive, "SET", 9, "v", nx=True)[1:] == ("Found", "$-1") and run(dead, "SET", 9, "v", xx=True)[0].phys is False


def test_aof_older_set_shows_again(spark):
    rows = [(1, 1, "k", "old", 0, 0), (2, 1, "k", "new", 0, 50), (3, 3, "k", None, 0, 500), (4, 1, "gone", "v", 0, 0), (5, 3, "gone", None, 0, 60), (6, 1, "d", "v", 0, 0), (7, 2, "d", None, 0, 0), (8, 3, "none", None, 0, 500)]
    df = spark.createDataFrame(rows, "pos long, kind int, key string, value string, flags long, expire_unix_ns long")
    assert [tuple(r) for r in R.aof_state(df, 100).collect()] == [("k", "old", 0, 500)]
    assert tuple(R.aof_stats(df, 100).first()) == (5, 1, 2)


def test_last_writer(spark):
    df = spark.createDataFrame([(1, 5, "SET", "k", "a", False, False, False, 0, 1), (2, 6, "SET", "k", "b", False, False, False, 0, 2), (3, 7, "SET", "q", "a", False, False, False, 0, 0), (4, 8, "DEL", "q", None, False, False, False, 0, 0)], COMMAND)
    assert [tuple(r) for r in R.last_writer_wins(df).collect()] == [("k", "b", 2, 6)]
    assert R.total_inserts(df.filter(F.lit(False))).first()[0] == 0


def test_stream(spark, tmp_path):
    from keyloom.streaming import replay as S

    log = random_log(11, 300)
    _, results = expected(log)
    S.use_rocksdb(spark)
    df = spark.createDataFrame(log, COMMAND)
    for a in (0, 100, 200):
        df.filter((F.col("seq") >= a) & (F.col("seq") < a + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = S.command_results(spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("replayed").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(tuple(r) for r in spark.table("replayed").collect()) == results


def test_timers_clear_dead_rows(spark, tmp_path):
    """State is left for live rows alone: no tombstones, no dead rows, and a prolonged row stays after its first timer."""
    from keyloom.streaming import replay as S

    s = 1_000_000_000
    rows = [(0, 0, "SET", "dies", "v", False, False, False, 5 * s, 0), (1, 0, "SET", "stays", "v", False, False, False, 0, 0), (2, 0, "SET", "longer", "v", False, False, False, 5 * s, 0),
            (3, s, "EXPIRE", "longer", None, False, False, False, 900 * s, 0), (4, s, "SET", "goes", "v", False, False, False, 0, 0), (5, 2 * s, "DEL", "goes", None, False, False, False, 0, 0),
            (6, 60 * s, "GET", "dies too", None, False, False, False, 0, 0), (7, 100 * s, "INCR", "dies", None, False, False, False, 0, 0)]
    rows = [(r[0], 1_000 * s + r[1], *r[2:]) for r in rows]
    for a in ((0, 6), (6, 7)):
        spark.createDataFrame(rows[a[0]:a[1]], COMMAND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.use_rocksdb(spark)

    def run():
        stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        S.command_results(stream, clean="10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)

    def held():
        return {r.k for r in spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "entry").load().select(F.col("key.key").alias("k")).collect()}

    run()
    assert held() == {"stays", "longer"}
    spark.createDataFrame(rows[7:], COMMAND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert held() == {"stays", "longer", "dies"}
    _, results = expected(rows)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("seq", "key", "op", "result", "reply").collect()) == results


def test_windowed_stream(spark, tmp_path):
    from keyloom.streaming import replay as S

    rows = [(i, i * 1_800_000_000_000, "GET", "k", None, False, False, False, 0, 0) for i in range(8)]
    spark.createDataFrame(rows, COMMAND).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.windowed_ops(spark.readStream.schema(COMMAND).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("windowed").collect()) == [2, 2, 2, 2]
