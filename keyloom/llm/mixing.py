"""Mixing sources to target weights by Poisson replication.

Each source has a target weight; its mean repetition rate is
weight * target rows / its rows.  A document's number of copies inverts the
Poisson distribution of that mean at a uniform value hashed from seed and
document, so any executor, at any time, gives the same copies.  Copies are
exploded and shuffled globally by a hash of (seed, document, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import fresh, materialize, text_of

SEED = 17
#: Without given weights a source weighs its rows to this power (1: as it is, 0: all alike).
TEMPERATURE = 0.5
#: The per-source table is broadcast up to so many sources, else joined by salted key.
BROADCAST_SOURCES = 10_000
SALTS = 32


def _uniform(*parts: Column | str) -> Column:
    """Uniform in [0, 1): the first 48 bits of an md5 over the parts, joined by colons."""
    hexed = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(hexed, 1, 12), 16, 10).cast("double") / F.lit(2.0**48)


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= k), k from 0 up to far in the tail; for rates of any size.

    Works on logarithms, so that exp(-rate) does not underflow.  Rate 0 gives [1.0].
    """
    top = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)).cast("int")
    start = F.struct(F.lit(0.0).alias("logf"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("a"))

    def step(s: Column, k: Column) -> Column:
        logf = s["logf"] + F.ln(k.cast("double"))
        c = s["c"] + F.exp(-rate + k * F.ln(rate) - logf)
        return F.struct(logf.alias("logf"), c.alias("c"), F.concat(s["a"], F.array(c)).alias("a"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["a"]))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: float | None = None,
                 temperature: float = TEMPERATURE, source_col: str = "source") -> DataFrame:
    """source key, its rows and its mean repetition rate.  A null source is a source of its own."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    sizes = docs.select(key.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        raw = F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature)))
        sized = sizes.withColumn("weight", raw)
    else:
        given = docs.sparkSession.createDataFrame(
            [("n" if k is None else f"s{k}", float(v)) for k, v in weights.items()], "_key string, weight double")
        sized = sizes.join(F.broadcast(given), "_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = sized.agg(F.sum("n_rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    rows = F.col("all_rows").cast("double") if target_rows is None else F.lit(float(target_rows))
    rate = F.try_divide(F.col("weight"), F.col("all_weight")) * rows / F.col("n_rows")
    return sized.join(F.broadcast(total)).select("_key", "n_rows", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: float | None = None,
        temperature: float = TEMPERATURE, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text") -> DataFrame:
    """The mixed corpus: all columns of ``docs``, and copy (from 1), copies and shuffle_key, in shuffled order.

    ``weights`` names the target weight of each source (those not named get
    none); without it sources weigh as rows ** ``temperature``.  ``target_rows``
    is the expected size of the result, by default that of the input.

    The uniform value is hashed from id and text: rows alike in both share it,
    and so their number of copies; rows that differ in one do not.  Null ids
    are hashed as "null", null texts as empty ones, long texts whole; an empty
    table gives an empty one.  Columns of ``docs`` named as a new one are kept,
    the new one then ends in "_".
    """
    spark = docs.sparkSession
    rates = materialize(source_rates(docs, weights, target_rows, temperature, source_col).withColumn("cdf", poisson_cdf(F.col("rate"))), "rates")
    key, cdf, salt = (fresh(docs, c) for c in ("_key", "_cdf", "_salt"))
    copy, copies, order = (fresh(docs, c) for c in ("copy", "copies", "shuffle_key"))
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")))
    small = rates.select(F.col("_key").alias(key), F.col("cdf").alias(cdf))
    ident = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text_of(text_col).cast("binary")))
    if rates.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(small), key)
    else:  # a hot source is dealt over SALTS keys
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(ident), F.lit(SALTS))).join(
            small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), [key, salt]).drop(salt)
    who = fresh(docs, "_who")
    joined = joined.withColumn(who, ident)
    n = F.aggregate(F.col(cdf), F.struct(_uniform(F.lit(str(seed)), F.col(who)).alias("u"), F.lit(0).alias("n")),
                    lambda s, c: F.struct(s["u"].alias("u"), (s["n"] + F.when(c <= s["u"], 1).otherwise(0)).alias("n")), lambda s: s["n"])
    out = joined.withColumn(copies, n).drop(key, cdf).filter(F.col(copies) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    out = out.withColumn(order, F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col(who), F.col(copy).cast("string")).cast("binary"))).drop(who)
    # each row goes to a partition by its hash, and stands there by its hash
    return out.repartition(order).sortWithinPartitions(order)


ORACLE = f"""
WITH s AS (SELECT coalesce('s' || source, 'n') AS k, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT sum(n) AS all_rows, sum(pow(n::DOUBLE, {TEMPERATURE})) AS all_w FROM s),
r AS (SELECT k, pow(n::DOUBLE, {TEMPERATURE}) / all_w * all_rows::DOUBLE / n AS rate FROM s, t),
c AS (SELECT k, j, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) OVER (PARTITION BY k ORDER BY j) AS cdf
      FROM (SELECT k, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS j FROM r)),
d AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT / pow(2.0, 48) AS u,
      coalesce('s' || source, 'n') AS k FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS copies
      FROM d JOIN c ON d.k = c.k AND c.cdf <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copies::INTEGER AS copies, copy::INTEGER AS copy,
       md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM m)
"""
