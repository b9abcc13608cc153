import numpy as np
import pytest

from keyloom.llm import topk


def brute(rows, k=10, every=100):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    out = set()
    for q in {i for i, _ in kept if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for i, x in kept if i == q for c, y in kept if c != q)
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    return {tuple(r) for r in topk.top_k(df, **kw).collect()}


@pytest.mark.parametrize(("seed", "copies"), [(1, 0), (2, 150)])
def test_brute_force(spark, seed, copies):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[:copies] = base[0]  # ties
    rows = [(i - 20, v.tolist()) for i, v in enumerate(base)]
    assert run(spark, rows, every=7, block=16, chunk=64, slice_rows=9) == brute(rows, every=7)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (None, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-0.5, 0.25]), (5, [-0.5, 0.25]), (100, [0.0, 0.0]), (7, [0.1, 0.1])]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_and_unlike_lengths(spark, duck):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=rng.integers(0, 6)).astype(np.float32).tolist()) for i in rng.integers(0, 30, 200)]
    assert run(spark, rows, every=10, block=8, chunk=32) == brute(rows, every=10)
    even = [(i, [*v, *[0.0] * 6][:6]) for i, v in rows]
    import pandas as pd

    duck.register("few", pd.DataFrame({"vec_id": [100 * i for i, _ in even], "embedding": [v for _, v in even]}))
    ref = duck.execute(topk.ORACLE.replace("embeddings", "few")).fetchall()
    assert sorted(run(spark, [(100 * i, v) for i, v in even])) == sorted(ref)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, []) == set()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2), (1, [2.0], 1, 2)], "vec_id long, embedding array<float>, score int, chunk int")
    assert {tuple(r) for r in topk.top_k(df).collect()} == {(0, 1, 1, 1024 * 2048)}


def test_scores_stay_exact():
    big = np.array([[2**40, -(2**40)], [2**62, 2**62]], dtype=np.int64)
    assert topk.exact_scores(big, big).tolist() == [[2**63 - 1, 0], [0, 2**63 - 1]]
    mid = np.array([[2**28 + 1, 3]], dtype=np.int64)
    assert topk.exact_scores(mid, mid)[0, 0] == (2**28 + 1) ** 2 + 9


def test_pruning_skips_blocks(monkeypatch):
    calls = []
    real = topk.exact_scores
    monkeypatch.setattr(topk, "exact_scores", lambda q, m: calls.append(len(m)) or real(q, m))
    near, far = np.full((20, 4), 100, dtype=np.int64), np.full((20, 4), 1, dtype=np.int64)
    got = list(topk.search_chunk(np.array([1000]), np.array([[5, 5, 5, 5]]), np.array([-(2**63)]), [(np.arange(20), near), (np.arange(20, 40), far)], 10))
    assert len(got) == 10 and calls.count(20) == 1  # the bounds, then one block of 20
