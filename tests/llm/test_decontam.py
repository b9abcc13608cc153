import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keyloom.llm import decontam as C
from keyloom.llm.words import words

S = "doc_id long, text string, lang string, source string, n_chars long"


def smith_waterman(w, t):
    rows = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
    best = 0
    for i in range(1, len(t) + 1):
        for j in range(1, len(w) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (C.MATCH if t[i - 1] == w[j - 1] else C.MISMATCH), rows[i - 1][j] + C.GAP, rows[i][j - 1] + C.GAP)
            best = max(best, rows[i][j])
    return best / (C.MATCH * len(t))


def test_alignment():
    rng = random.Random(2)
    pairs = []
    for _ in range(40):
        t = [rng.randrange(100, 130) for _ in range(rng.randint(1, 30))]
        w = [x for x in t if rng.random() > 0.2] + [rng.randrange(100, 130) for _ in range(rng.randint(1, 20))]
        pairs.append((np.array(w, np.uint64) * np.uint64(4), np.array(t, np.uint64) * np.uint64(4)))
    got = C.align([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [smith_waterman(a.tolist(), b.tolist()) for a, b in pairs])


def setup(spark, extra=()):
    rng = random.Random(4)
    vocab = ["the", "of", "and", "to"] * 60 + [f"v{i}" for i in range(800)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(15, 50)) for _ in range(20)]
    docs, want = [], set()
    for i in range(150):
        d = text(rng.randint(50, 300))
        if i % 5 == 0:
            k = i // 5 % 20
            p = list(items[k])
            if i % 10 == 0:  # edited: every seventh word changed, one dropped, one added
                p[::7] = [f"edit{j}" for j in range(len(p[::7]))]
                del p[4]
                p.insert(9, "added")
            d[20:20] = p
            want.add((i, k))
        docs.append((i, " ".join(d).capitalize() + ".", "en", "s", 0))
    for j in range(80):  # one item in many documents
        docs.append((1000 + j, " ".join(text(60) + items[3] + text(40)), "en", "s", 0))
        want.add((1000 + j, 3))
    bench = spark.createDataFrame([(k, " ".join(t) + "!") for k, t in enumerate(items)] + list(extra), "item_id long, text string")
    return spark.createDataFrame(docs, S).repartition(4), bench, want


def test_exact_and_edited_copies(spark):
    docs, bench, want = setup(spark)
    out = C.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want
    assert all(r.score > 0.99 for r in out if r.doc_id % 10 == 5 or r.doc_id >= 1000)
    clean = C.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_blocks_of_items(spark, monkeypatch):
    docs, bench, want = setup(spark)
    monkeypatch.setattr(C, "BLOCK_CHARS", 500)
    assert {(r.doc_id, r.item_id) for r in C.contaminated(docs, bench).collect()} == want
    assert C.drop_contaminated(docs, bench).count() == docs.count() - len({d for d, _ in want})


def test_every_run_of_an_item_has_a_seed(spark, monkeypatch):
    docs, bench, _ = setup(spark)
    monkeypatch.setattr(C, "RARE", -1)  # none is rare
    monkeypatch.setattr(C, "RARE_SHARE", -1)
    for items in C._blocks(bench, "item_id", "text"):
        _, item, pos = C._seeds(docs, items, "text")
        for k in range(len(items.ids)):
            at = np.sort(pos[item == k])
            last = items.edges[k + 1] - items.edges[k] - C.NGRAM
            assert at[0] < C.SPAN and last - at[-1] < C.SPAN and (np.diff(at) <= C.SPAN).all()


def test_an_edited_copy_of_a_common_item(spark, monkeypatch):
    item = [f"w{i}" for i in range(15)]
    edited = list(item)
    edited[2::5] = ["x", "y", "z"]  # four 3-grams are left; the copies make just these the most frequent
    docs = [(i, " ".join(["before", *item, "after"]), "en", "s", 0) for i in range(30)] + [(100, " ".join(["before", *edited, "after"]), "en", "s", 0), (101, "w3 w4 w5 and nothing else of it " + "word " * 30, "en", "s", 0)]
    docs, bench = spark.createDataFrame(docs, S), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for pairs in (None, 5):
        if pairs:
            monkeypatch.setattr(C, "PAIRS", pairs)
        out = {r.doc_id: r for r in C.contaminated(docs, bench).collect()}
        assert set(out) == {*range(30), 100} and out[100].score == 0.7 and out[100].seeds == 4
        assert [r.doc_id for r in C.drop_contaminated(docs, bench).collect()] == [101]


def test_excerpts_of_long_items(spark):
    items = [[f"{k}w{i}" for i in range(n)] for k, n in ((0, 60), (1, 500), (2, 60))]
    parts = [items[0][10:36], items[1][100:300], items[2][:13], items[2][:12]]
    edited = list(items[1][100:300])
    edited[::7] = ["edit"] * len(edited[::7])
    docs = spark.createDataFrame([(i, " ".join([f"a{i}"] * 20 + p + [f"z{i}"] * 20), "en", "s", 0) for i, p in enumerate([*parts, edited])], S)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    out = {r.doc_id: (r.item_id, round(r.score, 2)) for r in C.contaminated(docs, bench).collect()}
    assert out.pop(4)[0] == 1 and out == {0: (0, 0.43), 1: (1, 0.4), 2: (2, 0.22)}
    assert [r.doc_id for r in C.drop_contaminated(docs, bench).collect()] == [3]


def test_odd_rows(spark):
    docs, bench, want = setup(spark, extra=[(None, None), (90, ""), (91, "two words"), (3, "of the and of")])
    odd = spark.createDataFrame([(None, None, None, None, None), (2000, "", "en", "s", 0), (2001, "word " * 60000, "en", "s", 0), (None, bench.filter("item_id = 5").first().text, "en", "s", 0)], S)
    both = docs.unionByName(odd).withColumn("item_id", F.lit(1))
    out = C.contaminated(both, bench).filter("item_id <> 3 OR score > 0.99 AND seeds > 3").collect()
    assert {(r.doc_id, r.item_id) for r in out} >= want and (None, 5) in {(r.doc_id, r.item_id) for r in out}
    assert C.contaminated(spark.createDataFrame([], S), bench).collect() == []
    assert C.contaminated(docs, bench.limit(0)).collect() == []
    assert C.drop_contaminated(both, bench.limit(0)).count() == both.count()


def test_words_match_the_plain_split():
    import re

    import xxhash

    texts = ["It's a Test, of über-words!", "", None, "  \n ", "x", "a_b 12 é"]
    h, edges, _ = words(pa.array(texts))
    want = [[xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", (t or "").lower())] for t in texts]
    assert [h[a:z].tolist() for a, z in zip(edges[:-1], edges[1:])] == want
