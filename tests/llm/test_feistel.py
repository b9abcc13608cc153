import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import feistel

S = "doc_id long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000, 4097])
def test_permutation(n):
    p = feistel.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert n < 10 or p.tolist() != list(range(n))


def check(rows, out, shards=16):
    assert len(out) == len(rows)
    sizes = collections.Counter(r.shard for r in out)
    counts = [sizes.get(i, 0) for i in range(shards)]
    assert max(counts) - min(counts) <= 1
    for i in range(shards):
        assert sorted(r.slot for r in out if r.shard == i) == list(range(counts[i]))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} <= {("rows", None)}
    for r in out:
        assert feistel.shard_of_row(r.row_number, len(rows)) == (r.shard, r.slot)


def test_rows(spark):
    rows = [(i, f"téxt {i}") for i in range(500)] + [(7, "twice"), (7, "twice"), (None, None), (None, "x"), (8, ""), (9, "long " * 100000)]
    df = spark.createDataFrame(rows, S)
    out = feistel.shard_rows(df).collect()
    check(rows, out)
    again = feistel.shard_rows(df.repartition(5).withColumns({"shard": F.lit(1), "_n": F.lit(2)})).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_one_row_without_end(spark):
    df = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    check([(1, "same")] * 2000, feistel.shard_rows(df).collect())


def test_empty(spark):
    assert feistel.shard_rows(spark.createDataFrame([], S)).collect() == []
    check([(5, "a")], feistel.shard_rows(spark.createDataFrame([(5, "a")], S)).collect())


def test_a_row_repeated_very_often(spark):
    df = spark.range(45_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.createDataFrame([(2, "x")], "doc_id long, text string"))
    out = feistel.shard_rows(df).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("top")).collect()
    assert sum(r.n for r in out) == 45_001 and all(r.n == r.d == r.top + 1 for r in out) and max(r.n for r in out) - min(r.n for r in out) <= 1
