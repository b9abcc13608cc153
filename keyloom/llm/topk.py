"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are ordered so that like ones stand together and cut into blocks of
consecutive vectors.  A block carries the largest and the least value of each
component (the "term maxima" of signed terms) and a forward index, the matrix
of its vectors.  For a query the bound of a block is the sum over components of
the larger of q*max and q*min.  Blocks are taken by falling bound and scored
through their forward index until the bound falls below the k-th best score;
the first k-th score comes from the query's own block, scored while it is made.

Queries and blocks meet in a grid.  First slices of queries of bounded size meet
the blocks' bounds only, a small part of the data; then the blocks that some
query of a slice still needs are joined by key with the slice, chunk by chunk,
and the per-chunk best lists merge by a window.  Nothing is broadcast and no
pair of rows is ever emitted other than the k best of a query in a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import materialize

BLOCK = 256
CHUNK = 8192
SLICE = 8192
#: Chunks whose bounds meet a slice at once.
GROUP = 64
LONG = 2**63


def _reach(q: np.ndarray, m: np.ndarray) -> int:
    """What no inner product of their rows exceeds in size."""
    most = [max(1, abs(int(x.max())), abs(int(x.min()))) if x.size else 1 for x in (q, m)]
    return most[0] * most[1] * max(1, q.shape[1])


def exact_scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T over int64, exact; results beyond a long are cut to its bounds."""
    if not len(q) or not len(m):
        return np.zeros((len(q), len(m)), dtype=np.int64)
    top = _reach(q, m)
    if top < 2**53:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    if top < LONG:
        return q.astype(np.int64) @ m.astype(np.int64).T
    wide = q.astype(object) @ m.astype(object).T
    return np.vectorize(lambda x: min(max(int(x), -LONG), LONG - 1), otypes=[np.int64])(wide)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of one query, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == -LONG else -scores))[:k]
    return scores[order], ids[order]


def _bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x blocks) of the scores in each block."""
    if max(_reach(q, hi), _reach(q, lo)) >= LONG // 2:
        return np.full((len(q), len(hi)), LONG - 1)
    return exact_scores(np.maximum(q, 0), hi) + exact_scores(np.minimum(q, 0), lo)


def search_chunk(qids: np.ndarray, q: np.ndarray, seeds: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of the k best of each query in these blocks, but for what lies below the query's seed.

    ``seeds``: a score that the query's k-th best reaches for sure (the least long: none known).
    """
    hi, lo = np.stack([m.max(axis=0) for _, m in blocks]), np.stack([m.min(axis=0) for _, m in blocks])
    for a in range(0, len(q), 512):
        sub, ids = q[a : a + 512], qids[a : a + 512]
        bound = _bounds(sub, hi, lo)
        order = np.argsort(-bound, axis=1, kind="stable")
        kth = seeds[a : a + 512].copy()
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in sub]
        live = np.arange(len(sub))
        for turn in range(len(blocks)):
            nth = order[live, turn]
            go = bound[live, nth] >= kth[live]  # at the k-th score ties may still win
            live, nth = live[go], nth[go]
            if not len(live):
                break
            for b in np.unique(nth):
                who = live[nth == b]
                bid, m = blocks[b]
                s = exact_scores(sub[who], m)
                for row, i in enumerate(who):
                    take = (s[row] >= kth[i]) & (bid != ids[i])
                    if take.any():
                        found[i].append((s[row][take], bid[take]))
                        if sum(len(x[0]) for x in found[i]) >= k:
                            got = best(np.concatenate([x[0] for x in found[i]]), np.concatenate([x[1] for x in found[i]]), k)
                            found[i] = [got]
                            if len(got[0]) == k:
                                kth[i] = max(kth[i], got[0][-1])
        for i, x in enumerate(found):
            if x:
                s, d = best(np.concatenate([y[0] for y in x]), np.concatenate([y[1] for y in x]), k)
                yield from ((int(ids[i]), int(d[j]), int(s[j])) for j in range(len(s)))


def quantized(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long>: floor(scale * x), x as double; only whole vectors of finite components with an id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(ok).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _likeness() -> Column:
    """Order key: the components of largest size, with their signs, come first."""
    top = F.slice(F.array_sort(F.transform(F.col("v"), lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"), F.signum(x).alias("s")))), 1, 3)
    return F.concat_ws(",", F.transform(top, lambda t: F.concat(F.lpad(t["i"].cast("string"), 6, "0"), F.when(t["s"] < 0, "-").otherwise("+"))))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query (ids divisible by ``every``) among all other rows.

    Ties go to the smaller vec_id; with fewer than k candidates all are given.
    Vectors that are null or hold null or non-finite components, and rows
    without id, take no part.  A repeated vec_id is a row each time: as a
    candidate it may stand in a result several times, as a query its rows have
    one common result, and none of its rows is a candidate for another.
    Vectors of different lengths are scored over the shorter length (absent
    components are 0); an empty table gives no rows.  Components are cut to a
    long.  Extra columns are not read.
    """
    whole = quantized(vectors, scale, id_col, vector_col)
    sized = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max("v")), F.lit(0)), F.coalesce(F.min(F.array_min("v")), F.lit(0))).first()
    n, dims = int(sized[0]), max(1, int(sized[1]))
    kind = "<i2" if max(int(sized[2]), -int(sized[3])) < 2**15 else "<i8"  # components as narrow as they all fit
    parts = max(1, math.ceil(n / chunk))
    # enough ranges for the cores, each of a few blocks at least
    parts = max(parts, min(vectors.sparkSession.sparkContext.defaultParallelism * 2, math.ceil(n / (4 * block))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of consecutive vectors, with a seed score for each query among them."""
        from pyspark import TaskContext

        part, nr, rest = TaskContext.get().partitionId(), 0, None

        def made(p: pd.DataFrame) -> dict:
            m = np.zeros((len(p), dims), dtype=kind)
            for i, r in enumerate(p["v"]):
                m[i, : len(r)] = r
            ids = p["vec_id"].to_numpy(dtype=np.int64)
            q = np.flatnonzero(ids % every == 0)
            seeds = np.full(len(q), -LONG, dtype=np.int64)
            if len(q) and len(ids) > k:
                s = exact_scores(m[q], m)
                for j, i in enumerate(q):
                    own = s[j][ids != ids[i]]
                    if len(own) >= k:
                        seeds[j] = np.partition(own, len(own) - k)[len(own) - k]
            return {"chunk": part, "block": nr, "ids": ids.tobytes(), "m": m.tobytes(), "qids": ids[q].tobytes(), "qm": m[q].tobytes(), "seeds": seeds.tobytes(), "hi": m.max(axis=0).tobytes(), "lo": m.min(axis=0).tobytes()}

        for p in batches:
            rest = p if rest is None or not len(rest) else pd.concat([rest, p], ignore_index=True)
            while len(rest) >= block:
                yield pd.DataFrame([made(rest.iloc[:block].reset_index(drop=True))])
                nr += 1
                rest = rest.iloc[block:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pd.DataFrame([made(rest)])

    ordered = whole.withColumn("_like", _likeness()).repartitionByRange(parts, "_like", "vec_id").sortWithinPartitions("_like", "vec_id")
    blocks = materialize(ordered.select("vec_id", "v").mapInPandas(
        cut, "chunk int, block int, ids binary, m binary, qids binary, qm binary, seeds binary, hi binary, lo binary"), "blocks")
    queries = int(blocks.agg(F.coalesce(F.sum(F.octet_length("qids")), F.lit(0))).first()[0]) // 8
    slices = max(1, math.ceil(queries / slice_rows))
    pick = F.pmod(F.xxhash64("chunk", "block"), F.lit(slices)).cast("int")
    asked = blocks.filter(F.octet_length("qids") > 0).select(pick.alias("slice"), "qids", "qm", "seeds")
    packed = materialize(asked.groupBy("slice").agg(F.collect_list(F.struct("qids", "qm", "seeds")).alias("qs")), "slices")  # slice_rows queries each, about

    def numbers(x: bytes, what: str) -> np.ndarray:
        return np.frombuffer(x, dtype=what).astype(np.int64)

    def needed(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        """The blocks that some query of the slice cannot do without, by their bounds alone."""
        if not len(qs) or not len(bs):
            return pd.DataFrame(columns=["slice", "chunk", "block"])
        here = [x for r in qs["qs"] for x in r]
        q = np.concatenate([numbers(x["qm"], kind).reshape(-1, dims) for x in here])
        seeds = np.concatenate([numbers(x["seeds"], "<i8") for x in here])
        hi, lo = (np.stack([numbers(x, kind) for x in bs[c]]) for c in ("hi", "lo"))
        keep = np.zeros(len(bs), dtype=bool)
        for a in range(0, len(q), 512):
            keep |= (_bounds(q[a : a + 512], hi, lo) >= seeds[a : a + 512, None]).any(axis=0)
        return pd.DataFrame({"slice": qs["slice"].iloc[0], "chunk": bs["chunk"][keep], "block": bs["block"][keep]})

    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    bounds = blocks.select((F.col("chunk") / GROUP).cast("int").alias("group"), "chunk", "block", "hi", "lo", every_slice)
    near_to = packed.select("slice", "qs", F.explode(F.sequence(F.lit(0), F.lit((parts - 1) // GROUP))).alias("group"))
    wanted = materialize(near_to.groupBy("slice", "group").cogroup(bounds.groupBy("slice", "group")).applyInPandas(needed, "slice int, chunk int, block int"), "wanted")
    left = packed.join(wanted.select("slice", "chunk").distinct(), "slice").select("slice", "qs", "chunk")
    right = blocks.select("chunk", "block", "ids", "m").join(wanted, ["chunk", "block"])

    def meet(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(qs) and len(bs):
            here = [x for r in qs["qs"] for x in r]
            qids = np.concatenate([np.frombuffer(x["qids"], dtype=np.int64) for x in here])
            q = np.concatenate([numbers(x["qm"], kind).reshape(-1, dims) for x in here])
            seeds = np.concatenate([np.frombuffer(x["seeds"], dtype=np.int64) for x in here])
            bl = [(np.frombuffer(i, dtype=np.int64), np.frombuffer(m, dtype=kind).reshape(-1, dims)) for i, m in zip(bs["ids"], bs["m"], strict=True)]
            found = list(search_chunk(qids, q, seeds, bl, k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = left.groupBy("slice", "chunk").cogroup(right.groupBy("slice", "chunk")).applyInPandas(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""
