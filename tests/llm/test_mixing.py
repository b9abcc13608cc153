import collections
import math

from pyspark.sql import functions as F

from keyloom.llm import mixing, queries

S = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))


def test_sql(same):
    same(queries.op2_mix_sources, mixing.ORACLE)


def test_target_weights(spark):
    out = mixing.mix(docs(spark), weights={"hot": 0.1, "b": 0.6, "c": 0.3}, target_rows=6000).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in out}
    for s, w in (("hot", 600), ("b", 3600), ("c", 1800)):
        assert abs(got[s] - w) < 6 * math.sqrt(w)


def test_reproducible_and_shuffled(spark):
    a = mixing.mix(docs(spark)).select("doc_id", "copy", "shuffle_key").collect()
    b = mixing.mix(docs(spark).repartition(7)).select("doc_id", "copy", "shuffle_key").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    first = [r.doc_id for r in a[:200]]
    assert first != sorted(first)


def test_poisson_of_any_rate(spark):
    rows = spark.createDataFrame([(0.0,), (0.3,), (5.0,), (900.0,)], "rate double").select("rate", mixing.poisson_cdf(F.col("rate")).alias("c")).collect()
    for r in rows:
        if r.rate:
            want, logf, total = [], 0.0, 0.0
            for k in range(len(r.c)):
                logf += math.log(k) if k else 0
                total += math.exp(-r.rate + k * math.log(r.rate) - logf)
                want.append(total)
            assert max(abs(x - y) for x, y in zip(r.c, want)) < 1e-12 and abs(r.c[-1] - 1) < 1e-9
        else:
            assert r.c == [1.0]


def test_salted_join_gives_the_same(spark, monkeypatch):
    a = sorted(map(tuple, mixing.mix(docs(spark, 300)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs(spark, 300)).collect())) == a


def test_odd_rows(spark):
    rows = [(1, "a", "en", None, 1), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "long " * 50000, "en", "s", 1)]
    out = mixing.mix(spark.createDataFrame(rows, S).withColumn("copy", F.lit(9)), target_rows=50).collect()
    by = collections.Counter(r.doc_id for r in out)
    assert by[2] % 2 == 0 and {r.copy for r in out} == {9} and "copy_" in out[0].__fields__
    assert mixing.mix(spark.createDataFrame([], S)).collect() == []
    assert mixing.mix(spark.createDataFrame(rows, S), weights={"other": 1.0}).collect() == []


def test_null_ids_draw_apart(spark):
    df = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    by = collections.Counter(r.text for r in mixing.mix(df).collect())
    assert set(by.values()) >= {1, 2, 3} and abs(sum(by.values()) - 500) < 6 * math.sqrt(500)


def test_sql_on_odd_rows(spark, duck):
    rows = [(None, f"t{i}", "en", "s", 1) for i in range(40)] + [(7, f"u{i}", "en", None, 1) for i in range(40)] + [(8, None, None, "s", None)]
    df = spark.createDataFrame(rows, S)
    duck.register("odd", df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    out = mixing.mix(df)
    ref = duck.execute(mixing.ORACLE.replace("documents", "odd"))
    cols = [c[0] for c in ref.description]
    assert sorted(map(repr, map(tuple, out.select(*cols).collect()))) == sorted(map(repr, ref.fetchall()))
