import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import dartminhash as D
from keyloom.llm.graph import components
from keyloom.llm.words import shingle_sets, words

S = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Class of each row: chains of Jaccard similarity of 0.8 or more; no words at all is one class."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        rows.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 200))))
    for i in range(12):  # chains: each copy edits the one before it
        t = rows[i].split() + [rng.choice(vocab) for _ in range(120)]
        for _ in range(6):
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    star = [rng.choice(vocab) for _ in range(150)]  # copies like the middle, less like each other
    rows.append(" ".join(star))
    for i in range(25):
        t = list(star)
        t[4 + i * 5] = f"x{i}"
        t[(60 + i * 7) % 150] = f"y{i}"
        rows.append(" ".join(t))
    rows += [rows[3], rows[3].upper() + "!", "a b", "A b.", "a", "", None, "...", "one two three four five"]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], S).repartition(5)
    got = {r.doc_id: r for r in D.near_classes(df).collect()}
    want = brute(rows)
    assert {i: got[i].class_id for i, _ in rows} == {i: want[i] for i, _ in rows}
    assert [i for i, _ in rows if got[i].keep] == sorted(set(want))
    kept = D.drop_near(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    k, sets, truth = 4000, [], []
    for share in (0.2, 0.5, 0.9):
        e = rng.integers(0, 2**63, 300).astype(np.uint64)
        wa, wb = rng.integers(1, 5, 300), rng.integers(1, 5, 300)
        other = rng.random(300) > share
        f = np.where(other, e + np.uint64(1), e)
        sets += [(e, wa), (f, wb)]
        both = np.where(other, 0, np.minimum(wa, wb)).sum()
        truth.append(both / (wa.sum() + wb.sum() - both))
    sig = D.signatures(sets, k, by_count=True)
    assert not (sig == D.EMPTY).any()
    for i, t in enumerate(truth):
        assert abs((sig[2 * i] == sig[2 * i + 1]).mean() - t) < 4 * np.sqrt(t * (1 - t) / k) + 0.01


def test_small_and_large_sets_are_consistent():
    h, edges, _ = words(pa.array(["a b c d e f g", "a b c d e f g " + " ".join(f"x{i}" for i in range(30000))]))
    sig = D.signatures(shingle_sets(h, edges), 64)
    assert not (sig == D.EMPTY).any() and (sig[0] == sig[1]).mean() < 0.1


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "x y z", "en", "s", 1), (5, "x y z", "en", "s", 1), (5, "x y z", "en", "s", 1), (6, "long " * 50000, "en", "s", 1), (7, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, S).withColumns({"key": F.lit(1), "_text_hash": F.lit(2)})
    out = D.near_classes(df).collect()
    assert len(out) == 6 and {r.class_id for r in out if r.doc_id == 5} == {5}
    kept = D.drop_near(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text[:5]) for r in kept.collect()) == [(5, "x y z"), (6, "long "), (7, "")]
    assert D.near_classes(spark.createDataFrame([], S)).collect() == [] and D.drop_near(spark.createDataFrame([], S)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: top(x) for x in list(up)}


def test_crowd_mostly_below_the_threshold(spark, monkeypatch):
    """Copies of one text, edited so much that most pairs are unlike: classes as by brute force, from few comparisons."""
    rng = random.Random(9)
    text = [f"t{i}" for i in range(140)]
    rows = []
    for i in range(500):
        t = list(text)
        for _ in range(rng.randint(0, 14)):
            at, how = rng.randrange(len(t)), rng.random()
            t[at : at + 1] = [rng.choice([f"n{rng.randrange(10**6)}", f"e{rng.randrange(4)}"])] if how < 0.6 else [] if how < 0.8 else [t[at], "more"]
        rows.append((i, " ".join(t)))
    made = {}
    keep = D.materialize

    def counted(df, name):
        out = keep(df, name)
        made[name] = max(made.get(name, 0), out.count()) if name == "pairs" else 0
        return out

    monkeypatch.setattr(D, "materialize", counted)
    got = {r.doc_id: r.class_id for r in D.near_classes(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], S)).collect()}
    want = brute(rows)
    assert len(set(want)) > 100
    assert got == dict(enumerate(want))
    assert made["pairs"] < 4 * len(rows)


def test_weights(spark):
    """Texts alike as sets and unlike as weighted sets."""
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a), (2, f"{a} {a}"), (3, " ".join([a] * 6)), (4, " ".join([a] * 7))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], S)
    assert {r.doc_id: r.class_id for r in D.near_classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}  # 36 of 40 shingles; 40 of 40
    assert {r.doc_id: r.class_id for r in D.near_classes(df, by_count=True).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
