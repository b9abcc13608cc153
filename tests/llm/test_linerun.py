import random
import re

import pytest
from pyspark.sql import functions as F

from keyloom.llm import linerun as L
from keyloom.llm import queries

S = "doc_id long, text string, lang string, source string, n_chars long"


def test_sql(same):
    same(queries.op9_line_runs, L.ORACLE)


def brute(rows, least):
    """Lines to delete of each document: those in any run of enough words that stands at an earlier place."""
    seen, out = set(), {}
    docs = [(i, [x.strip(" \t\r") for x in t.split("\n") if x.strip(" \t\r")]) for i, t in rows]
    for i, lines in docs:
        n = [len(re.split(r"\s+", x)) for x in lines]
        runs = [(a, z) for a in range(len(lines)) for z in range(a + 1, len(lines) + 1) if sum(n[a:z]) >= least]
        gone = set()
        for a, z in runs:
            key = tuple(lines[a:z])
            if key in seen:
                gone |= set(range(a, z))
            seen.add(key)
        out[i] = sorted(gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 6))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice([*lines, "", "  "]) for _ in range(rng.randint(0, 16)))) for i in range(40)]
    got = {r.doc_id: r for r in L.repeated_runs(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], S), min_words=7).collect()}
    for i, gone in brute(rows, 7).items():
        spans = [tuple(map(int, r.split(":"))) for r in got[i].runs.split(",") if r]
        assert sorted(x for a, n in spans for x in range(a, a + n)) == gone
        assert got[i].n_deleted == len(gone)


def test_texts_are_cut(spark):
    a, b, c = ("first " * 30).strip(), ("second " * 25).strip(), "short line"
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"x\n\n{a}\n{b}\ny"), (3, c), (4, f"{a}")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], S)
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "x\n\ny", 3: c, 4: a}  # one line of 30 words is no run of 50
    assert {r.doc_id: r.text for r in L.dedup_lines(df, min_words=30).collect()}[4] == ""


def test_lines_that_collide_in_64_bits(spark):
    x = "aaaaaaaaaaaaaaaa1HcJLVk3bbbbbbbbcccccccccccccccc3Ne0zXAOdddddddd"
    y = "aaaaaaaaaaaaaaaa5i5hefY2bbbbbbbbcccccccccccccccclLrng2BMdddddddd"
    df = spark.createDataFrame([(1, x, "en", "s", 0), (2, y, "en", "s", 0), (3, x, "en", "s", 0)], S)
    assert x != y and df.select(F.xxhash64("text")).distinct().count() == 1
    assert {r.doc_id: r.n_deleted for r in L.repeated_runs(df, min_words=1).collect()} == {1: 0, 2: 0, 3: 1}


def test_odd_rows(spark):
    p = "many words " * 40
    rows = [(None, None), (None, p), (1, p), (1, p), (2, ""), (3, "\n\n"), (4, "l " * 100 + "\n" + "z\n" * 5000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], S).withColumns({"runs": F.lit(1), "n_lines": F.lit(2), "_l": F.lit(3)})
    out = L.repeated_runs(df).collect()
    assert len(out) == 7
    assert sorted((r.doc_id, r.n_deleted) for r in out if r.doc_id in (1, 2, 3)) == [(1, 0), (1, 0), (2, 0), (3, 0)]
    assert [r.n_deleted for r in out if r.doc_id is None] in ([0, 1], [1, 0])
    cut = L.dedup_lines(df)
    assert cut.columns == df.columns and cut.count() == 7 and cut.filter("text IS NULL").count() == 1
    assert L.repeated_runs(spark.createDataFrame([], S)).collect() == []


def test_text_of_very_many_lines(spark):
    """Time and memory are near linear in the lines of one text."""
    one = [f"line {i}" for i in range(60000)]
    rows = [(1, "\n".join(one)), (2, "\n".join(["x"] + one[100:50000:1] + ["y"] + one[:30]))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], S)
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.runs) for r in L.repeated_runs(df).collect()}
    assert got == {1: (60000, 0, ""), 2: (49932, 49930, "1:49900,49902:30")}
