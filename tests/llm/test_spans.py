import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keyloom.llm import pii, secretscan

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

S = "doc_id long, text string, source string"
CASES = (("pii", pii.find_pii, brute.pii, ("email", "ip", "card", "phone")), ("secrets", secretscan.find_secrets, brute.secrets, ("assign", "access", "hex")))


def noisy(seed, n):
    rng = random.Random(seed)
    bits = ["a@b.co", "user.x@", "10.0.0.", "1.2.3.4", "255", "256.", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 1234567", "+", "é", " ", ".", "-", "token", "Secret", ": ", "=", "\"", "abcdef", "AKIA", "ABCDEFGHIJKLMNOPQ", "deadbeef01", "\n", "7", "x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_brute_force(spark, case):
    _, find, base, kinds = case
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(brute.TRICKY + noisy(3, 300))] + [(None, "a@b.cc token=abcdefg", None), (10**6, None, None), (10**6, None, None)]
    out = find(spark.createDataFrame(rows, S)).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(want), (r.doc_id, r.spans)
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[3] == k for x in want) for k in kinds]
        assert {x for x in brute.joined(want).split(",") if x} <= set(r.spans.split(","))


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_empty_and_clashing(spark, case):
    find = case[1]
    assert find(spark.createDataFrame([], S)).collect() == []
    df = spark.createDataFrame([(1, "a@b.cc", "s")], S).withColumns({c: F.lit(1) for c in ("base", "cands", "spans", "n_email", "value", "opaque")})
    assert len(find(df).collect()) == 1


def test_contexts_find_more(spark):
    seeds = [(i, f"Please write to my mailbox person{i}@mail.example.com today", "s") for i in range(8)]
    more = [(100, "Please write to my mailbox person77 today", "s"), (101, "It took about 1500 steps today", "s"), (102, "Please write to my mailbox now", "s")]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(seeds + more, S)).collect()}
    text = more[0][1]
    at = text.index("person77")
    assert out[100].spans == f"email:{at}:{at + 8}" and out[100].n_found == 1 and out[100].n_email == 0
    assert out[101].n_found == 0 and out[102].n_found == 0 and all(out[i].n_found == 0 for i in range(8))


def test_a_pattern_of_mixed_neighbours_is_not_trusted(spark):
    rows = [(i, f"the number {i}@mail.example.com here" if i % 2 else f"the number {1000 + i} here", "s") for i in range(20)]
    assert sum(r.n_found for r in pii.find_pii(spark.createDataFrame(rows, S)).collect()) == 0


def test_unseen_identifiers_do_not_refute_a_pattern(spark):
    """Many unknown identifiers in a context of known ones are found; what the kind cannot look like tells against it."""
    seeds = [(i, f"Please write to my mailbox person{i}@mail.example.com today", "s") for i in range(8)]
    more = [(100 + i, f"Please write to my mailbox person{i * 7 + 20} today", "s") for i in range(9)]
    got = {r.doc_id: r.n_found for r in pii.find_pii(spark.createDataFrame(seeds + more, S)).collect()}
    assert all(got[100 + i] == 1 for i in range(9)) and not any(got[i] for i in range(8))
    numbers = [(200 + i, f"Please write to my mailbox {10000 + i} today", "s") for i in range(9)]
    assert not any(r.n_found for r in pii.find_pii(spark.createDataFrame(seeds + more + numbers, S)).collect())
    crowd = [(300 + i, f"Please write to my mailbox room{i * 3 + 100} today", "s") for i in range(60)]
    assert not any(r.n_found for r in pii.find_pii(spark.createDataFrame(seeds + crowd, S)).collect())


def test_ownership(spark):
    example, own = "token = EXAMPLEkey0123456789", "Zx81hQpL0a9KqW7vRt5YbN3m"
    rows = [(i, f"see {example} there", f"owner{i % 5}") for i in range(20)] + [(50, f"my {own} value", "owner1"), (51, f"my {own} value again", "owner1"), (52, "Ab3" * 10, "o1"), (53, "Ab3" * 10, "o2"), (54, f"pass {example}", "owner9")]
    out = {r.doc_id: r for r in secretscan.find_secrets(spark.createDataFrame(rows, S)).collect()}
    assert out[0].n_example == 1 and out[0].n_live == 0 and out[0].most_owners == 6 and out[0].most_repos == 21
    assert out[50].spans == f"opaque:3:{3 + len(own)}" and out[50].n_live == 1 and out[50].most_repos == 2
    assert out[52].spans == "" and out[52].most_owners == 2


def test_repositories_and_examples(spark):
    """A repository under two owners counts once; what very many repositories of one owner hold is an example."""
    a, b = "tokenA1" * 4, "Zz9keyB" * 4
    rows = [(1, f"use {a} here", "x", "r1"), (2, f"use {a} here", "y", "r1")] + [(10 + i, f"use {b} here {i}", "x", f"p{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r for r in secretscan.find_secrets(df, repo_col="repo").collect()}
    assert (got[1].most_owners, got[1].most_repos) == (2, 1)
    assert (got[10].most_owners, got[10].most_repos, got[10].n_live, got[10].n_example, got[10].spans) == (1, 150, 0, 1, "")


def test_planted_contexts(spark):
    """Unseen identifiers in the contexts of known ones are found, all of them, and nothing in other contexts."""
    rng = random.Random(3)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    fill = lambda: " ".join(rng.choice(words) for _ in range(6))
    rows, hidden = [], {}
    for i in range(60):
        rows.append((len(rows), f"{fill()} call me on +49 30 {1000000 + i * 37} today {fill()}", "s"))
        rows.append((len(rows), f"{fill()} write to user{i}@mail.example.com please {fill()}", "s"))
    for i in range(10):
        for head, value, tail, kind in ((f"{fill()} call me on ", f"0151 {2000000 + i * 41}", f" today {fill()}", "phone"), (f"{fill()} write to ", f"user{i}@localhost", f" please {fill()}", "email")):
            hidden[len(rows)] = f"{kind}:{len(head)}:{len(head) + len(value)}"
            rows.append((len(rows), head + value + tail, "s"))
    for i in range(80):
        rows.append((len(rows), f"{fill()} {rng.choice(words)} {30000 + i * 7} {fill()}", "s"))
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, S)).collect()}
    found = {i: r.spans for i, r in got.items() if r.n_found}
    right = sum(found.get(i) == x for i, x in hidden.items())
    assert right == len(hidden) and len(found) == len(hidden)  # recall and precision 1
