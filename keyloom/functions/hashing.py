"""The cache's 64-bit hash and what follows from it: shard, slot, mix.

Unsigned wrap-around is not an operation of Spark SQL, so these are Arrow
UDFs over numpy; all rows of a batch advance together, word by word.  Where
only a partitioning is needed, use Spark's own hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash functions.
TH64_FACTOR = 0x14020A57ACCED8B7
MIX13_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def th64(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """Hashes of byte strings, as uint64; memory grows with the bytes of all, not with the longest."""
    r = np.uint64(TH64_FACTOR)
    size = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(keys) + bytes(8), dtype=np.uint8)
    words = np.ndarray(len(flat) - 7, dtype="<u8", buffer=flat, strides=(1,))  # the 8 bytes from every place on
    h = np.full(len(keys), seed % 2**64, dtype=np.uint64)
    on = np.flatnonzero(size >= 8)
    for w in range(int(size.max(initial=0)) // 8):
        h[on] = _turn((h[on] * r) ^ _turn(words[start[on] + 8 * w] * r, 31), 31)
        on = on[size[on] >= 8 * w + 16]
    for b in range(7):
        at = size // 8 * 8 + b
        on = np.flatnonzero(at < size)
        if not len(on):
            break
        h[on] = (h[on] * r) ^ flat[start[on] + at[on]].astype(np.uint64)
    h = h * r + size.astype(np.uint64)
    for _ in range(3):
        h = (h ^ (h >> np.uint64(31))) * r
    return h


def mix13(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX13_FACTORS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX13_FACTORS[1])
    return x ^ (x >> np.uint64(31))


def hash_col(key: Column | str, seed: int = 0) -> Column:
    """th64 of a string or binary column, as a long of the same bits; null of null."""
    @F.pandas_udf("long")
    def hashed(k: pd.Series) -> pd.Series:
        h = th64([b"" if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in k], seed).view(np.int64)
        return pd.Series(pd.arrays.IntegerArray(h, k.isna().to_numpy()))

    return hashed(key)


def mix_col(x: Column | str) -> Column:
    @F.pandas_udf("long")
    def mixed(v: pd.Series) -> pd.Series:
        none = v.isna().to_numpy()
        return pd.Series(pd.arrays.IntegerArray(mix13(v.astype("Int64").fillna(0).to_numpy(np.int64).view(np.uint64)).view(np.int64), none))

    return mixed(x)


def shard_of(hashed: Column, nshards: int) -> Column:
    """Shard number: the hash's high 32 bits modulo the number of shards."""
    return F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(nshards)).cast("int")


def slot_of(hashed: Column) -> Column:
    """The 24-bit hash that orders a shard's buckets."""
    return hashed.bitwiseAND(F.lit(0xFFFFFF)).cast("int")


def unsigned(hashed: Column) -> Column:
    """The long's bits read as an unsigned number, in decimal."""
    d = hashed.cast("decimal(20,0)")
    return F.when(hashed < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("string")
