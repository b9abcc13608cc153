import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import codec, expr
from keyloom.functions.hashing import hash_col, mix13, th64


@pytest.mark.parametrize(("key", "seed", "want"), [("", 0, 0), ("a", 0, 0xBC02FC57C97C3A15), ("hello", 1, 0xC36FD6F18D578B3D), ("The quick brown fox", 12345, 0x83F420005430684E)])
def test_th64(key, seed, want):
    assert int(th64([key.encode()], seed)[0]) == want


def test_mix13():
    assert [int(x) for x in mix13(np.array([0, 1, 0xDEADBEEFDEADBEEF, 0x0123456789ABCDEF], dtype=np.uint64))] == [0, 0x5692161D100B05E5, 0x64C2DF93E2E8338C, 0xB2C058E4EBB5112C]


@pytest.mark.parametrize(("key", "want"), [("hello", "babcb2d4"), ("user:42", "ef9af8347140"), ("abcd", "9e8a6a"), ("abc", "9e8a40"), ("A-._", "3810a6")])
def test_sixpack(key, want):
    assert codec.pack(key.encode()).hex() == want
    assert codec.unpack(bytes.fromhex(want)) == key.encode()


def test_sixpack_refuses():
    assert [codec.pack(k) for k in (b"", b"z", b"Q", b"!")] == [None] * 4


@pytest.mark.parametrize(("n", "want"), [(0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (300, "ac02"), (16384, "808001"), (0x1122334455667788, "88ef99abc5e88c9111"), (2**64 - 1, "ff" * 9 + "01")])
def test_varint(n, want):
    assert codec.varint(n).hex() == want
    assert codec.read_varint(bytes.fromhex(want)) == (n, len(want) // 2)


@pytest.mark.parametrize(("n", "want"), [(0, "00"), (1, "02"), (-1, "01"), (-2, "03"), (63, "7e"), (-64, "7f")])
def test_zigzag(n, want):
    assert codec.zigzag(n).hex() == want
    assert codec.read_zigzag(bytes.fromhex(want))[0] == n


def test_varint_errors():
    with pytest.raises(codec.VarintError, match="Incomplete"):
        codec.read_varint(b"\x80")
    with pytest.raises(codec.VarintError, match="Overflow"):
        codec.read_varint(b"\xff" * 10 + b"\x01")


def test_columns(spark):
    rows = spark.createDataFrame([("user:42", "value", 1234, 7), ("hello!", "x" * 70000, 0, 0)], "key string, value string, e long, f long")
    got = rows.select(expr.packable("key").alias("p"), expr.entry_mem_size("key", "value", "e", "f", True).alias("s"), hash_col("key", 3).alias("h")).collect()
    assert [r.p for r in got] == [True, False]
    assert got[0].s == 16 + 8 + 4 + 8 + 1 + 6 + 5 + 1
    assert got[1].s == 16 + 8 + 1 + 6 + 70000 + 4
    assert got[0].h == int(th64([b"user:42"], 3).view(np.int64)[0])


def test_saturation_and_parsers(spark):
    one = spark.range(1)
    big = expr.LONG_MAX
    r = one.select(expr.sat_add(F.lit(big - 1), F.lit(5)).alias("a"), expr.sat_add(F.lit(-big), F.lit(-5)).alias("b"), expr.sat_add(F.lit(5), F.lit(-7)).alias("c"),
                   expr.parse_byte_size(F.lit(" 1.5kb ")).alias("d"), expr.parse_byte_size(F.lit("5x")).alias("e"), expr.parse_max_memory(F.lit("50%"), 1000).alias("f"), expr.parse_max_memory(F.lit("unlimited"), 1000).alias("g"),
                   expr.parse_bool(F.lit("YES")).alias("h"), expr.parse_bool(F.lit("maybe")).alias("i"), expr.parse_fsync(F.lit("EverySec")).alias("j"), expr.parse_long(F.lit("+12")).alias("k"), expr.parse_long(F.lit("1_0")).alias("l"),
                   expr.parse_long(F.lit("9" * 30)).alias("m")).first()
    assert tuple(r) == (big, -big - 1, -2, 1536, None, 500, None, True, None, "everysec", 12, None, None)


def test_hash_of_nulls_and_a_long_key(spark):
    """A null key has no hash; one long key among many costs its own bytes only."""
    from keyloom.functions import hashing as H

    keys = [b"", b"a", b"12345678", b"x" * 1_000_000] + [f"key:{i}".encode() for i in range(5000)]
    alone = [int(H.th64([k], 3)[0]) for k in keys[:50]]
    assert H.th64(keys, 3).tolist()[:50] == alone
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b" * 1000)], "id int, key string")
    got = {r.id: r.h for r in rows.select("id", H.hash_col("key").alias("h")).collect()}
    assert got[2] is None and got[1] == int(H.th64([b"a"]).view("i8")[0]) and got[3] == int(H.th64([b"b" * 1000]).view("i8")[0])
    assert {r.id: r.m is None for r in spark.createDataFrame([(1, 5), (2, None)], "id int, x long").select("id", H.mix_col("x").alias("m")).collect()} == {1: False, 2: True}
