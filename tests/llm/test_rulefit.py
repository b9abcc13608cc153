import zlib

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import rulefit

S = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=600):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(60)).capitalize() + "."
    rows = []
    for i in range(n):
        t = good()
        bad = i % 4 == 0
        if bad:
            t = [t.upper() + "!!", " | ".join(t.split()), "spam " * 60, "%%% ".join(t.split())][i // 4 % 4]
        rows.append((i, t, "en", "s", len(t), int(not bad)))
    df = spark.createDataFrame(rows, S + ", quality int")
    return df.drop("quality"), df.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_held_out(spark):
    docs, labels = corpus(spark)
    out = rulefit.quality_scores(docs, labels).collect()
    truth = dict(labels.select("doc_id", "quality").collect())
    assert len(out) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    spoiled = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, rulefit.quality_scores(docs, x).collect())) for x in (labels, spoiled))
    assert a == b


def test_rules_are_columns(spark):
    docs, labels = corpus(spark, 300)
    model = rulefit.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 200 and all(1 <= len(r.terms) <= 2 * rulefit.DEPTH for r in model.rules)
    plan = rulefit.scored(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    odd = spark.createDataFrame([(None, None, None, None, None), (1000, "", "en", "s", 0), (1001, None, "en", "s", 0), (1002, "w " * 100000, "en", "s", 1), (1002, "w " * 100000, "en", "s", 1)], S)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    out = rulefit.quality_scores(docs.unionByName(odd).withColumns({"score": F.lit(5), "n_words": F.lit(6), "_stats": F.lit(7)}), labels).collect()
    assert len(out) == 205 and all(r.score is not None and r.held_out is not None for r in out)
    assert rulefit.quality_scores(spark.createDataFrame([], S), labels).collect() == []
    none = rulefit.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = rulefit.keep_good(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "score"] and 0 < kept.count() < 200


def test_training_keeps_few_rules():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.5)).astype(float)
    m = rulefit.train(x, y, list("abcde"))
    new = rng.normal(size=(500, 5))
    on = np.array([[all((new[i, "abcde".index(n)] > c) == above for n, above, c in r.terms) for r in m.rules] for i in range(500)])
    got = on @ np.array([r.weight for r in m.rules]) + m.bias > 0
    assert np.mean(got == ((new[:, 0] > 0.3) & (new[:, 1] <= 0.5))) > 0.96
    assert 0 < len(m.rules) < rulefit.TREES * 2**rulefit.DEPTH
    assert rulefit.train(x[:0], y[:0], list("abcde")).rules == [] and rulefit.train(x, np.ones(800), list("abcde")).bias > 3


def test_scores_outside_spark(spark):
    """The compiled column against the same rules evaluated with numpy, over whole documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = rulefit.fit_quality(docs, labels)
    stats = docs.select("doc_id", *(v.alias(k) for k, v in rulefit.statistics(F.coalesce("text", F.lit(""))).items())).toPandas()
    z = np.full(len(stats), model.bias)
    for r in model.rules:
        holds = np.ones(len(stats), dtype=bool)
        for name, above, cut in r.terms:
            holds &= (stats[name].to_numpy(float) > cut) == above
        z += np.where(holds, r.weight, 0.0)
    got = {r.doc_id: r.score for r in rulefit.quality_scores(docs, labels).collect()}
    assert model.rules and max(abs(got[i] - 1 / (1 + np.exp(-x))) for i, x in zip(stats["doc_id"], z)) < 1e-9


def test_repeated_ids_of_labelled_rows(spark):
    """The fit depends neither on the order of rows nor on how often they stand there."""
    docs, labels = corpus(spark, 300)
    a = rulefit.fit_quality(docs, labels)
    b = rulefit.fit_quality(docs.unionByName(docs).repartition(7), labels.unionByName(labels).repartition(3))
    assert a == b
