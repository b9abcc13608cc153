import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import tokenbin as T
from keyloom.llm.common import scratch_path

S = "doc_id long, text string"
TEXTS = ["Hello, wörld!", "", None, "a  b\nc\td\r\n", "it's CAN'T we've", "<|endoftext|> x <|startoftext|>y", "中文 字 😀😀", "１２３ ½ Ⅷ", "É ́x é", "\x1c a\x1f b", "x" * 20000, "$$$ %%% 12.5", "Straße ÀÉÎ ªº µ ÿ Ÿ ﬁ", "é a b"]


def reference(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.tokenizer_path())
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return r[1]


def test_brute_force(spark):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)]) for i in range(100)] + [(None, "none")]
    df = spark.createDataFrame(rows, S).repartition(6).withColumns({"start": F.lit(1), "_h": F.lit(2)})
    assert sorted((tuple(r) for r in T.token_binary(df).collect()), key=key) == reference(rows)


def test_query_over_whole_table(spark):
    from keyloom.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op10_token_binary(spark, "/root/testdata/sf0.001").collect()), key=key) == reference(rows)


def test_encoder_equals_the_library():
    enc = T.Encoder(T.tokenizer_path())
    assert enc.by_piece and enc.by_part
    texts = [t or "" for t in TEXTS]
    ids, n = enc.texts(pa.array(texts))
    at = np.cumsum(n) - n
    assert [ids[a : a + k].tolist() for a, k in zip(at, n)] == [enc.whole(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_another_tokenizer(spark, name):
    import public_tokenizers

    enc = T.Encoder(public_tokenizers.path(name))
    texts = ["Hello,  world\n it's", "", "x"]
    ids, n = enc.texts(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in enc.whole(t)] and n.tolist() == [len(enc.whole(t)) for t in texts]


def test_files(spark):
    rows = [(i, f"text number {i}") for i in range(50)]
    out = scratch_path(spark, "t")
    table = T.write_tokens(spark.createDataFrame(rows, S), out, T.tokenizer_path(), shards=3).collect()
    assert [r.base for r in table] == [sum(x.n_ids for x in table[:i]) for i in range(len(table))]
    doc = 0
    for r in table:
        ids, idx, ids_of = T._map(r.path + ".ids", "<u2"), T._map(r.path + ".idx", "<u8"), T._map(r.path + ".doc", "<i8")
        assert isinstance(ids, np.memmap) and len(ids) == r.n_ids == idx[-1] and len(idx) == r.n_docs + 1
        assert ids_of.tolist() == list(range(doc, doc + r.n_docs)) and all(ids[int(e) - 1] == 2 for e in idx[1:])
        doc += r.n_docs


def test_empty_table(spark):
    assert T.token_binary(spark.createDataFrame([], S)).collect() == []


def test_ties(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, "c")]
    a, b = (sorted(map(tuple, T.token_binary(spark.createDataFrame(r, S)).collect()), key=key) for r in (rows, rows[::-1]))
    assert a == b and [r[0] for r in a] == [1, 1, 1, 2]


def test_shuffled(spark):
    """Copies of a document are not neighbours, offsets have no gaps, and the order does not depend on the input's."""
    rows = [(i % 40, f"text {i % 40} " + "word " * (i % 40)) for i in range(400)] + [(None, "none")] * 3
    make = lambda r, n: T.token_binary(spark.createDataFrame(r, S).repartition(n), shuffled=True, shards=3).collect()
    got, again = (sorted(map(tuple, make(r, n)), key=key) for r, n in ((rows, 5), (rows[::-1], 2)))
    assert got == again and len(got) == len(rows)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    want = {(r[0], r[2], r[3]) for r in reference(rows)}
    assert {(r[0], r[2], r[3]) for r in got} == want and sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in rows)
    assert sum(a[0] == b[0] for a, b in zip(got, got[1:])) < 40  # a fortieth of neighbours by chance; 360 in order of ids


def test_long_text_and_clashing_columns(spark):
    rows = [(1, "Many words, and more. " * 40000), (2, "b")]
    df = spark.createDataFrame(rows, S).withColumns({"ids": F.lit(1), "n": F.lit(2), "width": F.lit(3), "h": F.lit(4)})
    assert sorted((tuple(r) for r in T.token_binary(df).collect()), key=key) == reference(rows)
