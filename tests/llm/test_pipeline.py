import re


import corpus_pipeline
from keyloom.llm import queries
from keyloom.llm.common import materialize

D = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_binary_output"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, ids, sizes = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, D), name)
        sizes.append(docs.count())
        if name != "token_binary_output":
            assert docs.columns == columns
            now = {r.doc_id for r in docs.select("doc_id").collect()}
            assert now <= ids
            ids = now
    assert sizes[0] > sizes[1] > 0 and sizes[1] > sizes[2] and sizes[3] == sizes[4]
    low = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").filter("quality = 0").collect()}
    assert not low & ids
    run = corpus_pipeline.run(spark, D)
    assert run.columns == docs.columns and sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, D).select("doc_id").collect()}
    assert len(good - kept) <= 0.02 * len(good)


def test_odd_rows_pass_all_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "en", None, 0), (9003, "Word there. " * 20000, "en", "s", 1), (9003, "Word there. " * 20000, "en", "s", 1)], docs.schema)
    for rows in (docs.unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = materialize(stage(spark, rows, D), name)
            rows.count()


def test_registered():
    names = sorted(queries.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [re.match(r"op(\d+)_", n)[1] for n in names] == [str(i) for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_native_plans(spark):
    for name in ("op3_contextual_pii", "op4_secret_ownership", "op9_line_runs"):
        plan = queries.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
