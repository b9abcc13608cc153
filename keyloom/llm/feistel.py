"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global row number; a keyed Feistel network over the smallest
square that holds all numbers, walked along its cycle until it lands inside
``[0, n)``, permutes them; shard and slot are the permuted number modulo and
divided by the number of shards.  So shard sizes differ by one row at most,
slots are gapless, and both can be computed again from the row number, the
number of rows and the seed alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import each, materialize, text_of

LAW = "rows"
SHARDS = 16
SEED = 20240229
ROUNDS = 6
#: Buckets of the numbering; their counts are the only thing that is broadcast.
BUCKETS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps silently on uint64 arrays)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The permuted row numbers; ``rows`` are distinct or not, all in [0, n)."""
    x = np.asarray(rows, dtype=np.uint64).copy()
    if n <= 1 or not len(x):
        return x.astype(np.int64)
    side = np.uint64(int(np.ceil(np.sqrt(n))))
    while int(side) * int(side) < n:
        side += np.uint64(1)
    keys = [_mix(np.array([(seed * 0x9E3779B97F4A7C15 + i + 1) % 2**64], dtype=np.uint64))[0] for i in range(ROUNDS)]
    out = np.ones(len(x), dtype=bool)
    while out.any():  # cycle walking: those still outside go round again
        left, right = x[out] // side, x[out] % side
        for k in keys:
            left, right = right, (left + _mix(right ^ k) % side) % side
        x[out] = left * side + right
        out[out] = x[out] >= np.uint64(n)
    return x.astype(np.int64)


def number_rows(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 of the rows of ``df``, which has only ``keys``; and n.

    The numbering orders rows by (bucket, keys), the bucket being a hash of the
    keys, so it does not depend on how the input is split.  Rows that are
    alike in all keys are counted before the shuffle and spread afterwards, in
    parts of bounded size that are dealt over the cluster, so one row repeated
    without end is no hot spot.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    counted = materialize(counted, "numbered")
    sizes = counted.groupBy("_bucket").agg(F.sum("_n").alias("_size"), F.max("_n").alias("_most")).collect()  # BUCKETS rows at most
    bases = sorted((int(r["_bucket"]), int(r["_size"])) for r in sizes)
    total, base = 0, []
    for b, s in bases:
        base.append((b, total))
        total += s
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(base, "_bucket int, _base long"))
    w = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_base") + F.coalesce(F.sum("_n").over(w), F.lit(0))
    out = counted.join(table, "_bucket").withColumn("_first", first)
    out = each(out, "_n", "_nr", max((int(r["_most"]) for r in sizes), default=0))
    return out.select(*keys, (F.col("_first") + F.col("_nr")).alias(name)), total


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard for every document.

    Null text: as empty (size 1, crc 0).  Long texts: size and crc are of the whole.  Null or repeated ids: rows like any
    other; rows alike in id and text are interchangeable, and take numbers of
    their own.  Empty table: no rows.  Other columns are not read.
    ``grown_shard`` is null: the law is ``rows``, under which one more shard
    moves rows between old shards too.
    """
    t = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"], "row_number")

    @F.pandas_udf("long")
    def permuted(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    return numbered.withColumn("_p", permuted("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "row_number",
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_of_row(row_number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row, from its number alone."""
    p = int(permute(np.array([row_number]), n, seed)[0])
    return p % shards, p // shards
