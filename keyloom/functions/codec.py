"""Key packing and varints: plain functions over bytes, and Arrow UDFs of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 63 characters that pack, in the order of their codes from 1 on.
ALPHABET = b"-.0123456789:ABCDEFGHIJKLMNOPRSTUVWXY_abcdefghijklmnopqrstuvwxy"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
KEY_LIMIT = 128


class VarintError(ValueError):
    """Incomplete or Overflow."""


def pack(key: bytes) -> bytes | None:
    """Six bits a character, most significant first; None if a character has no code or the key is empty."""
    if not key or any(c not in CODE for c in key):
        return None
    bits = "".join(f"{CODE[c]:06b}" for c in key)
    size = -(-len(bits) // 8)
    return int(bits.ljust(8 * size, "0"), 2).to_bytes(size, "big")


def unpack(packed: bytes) -> bytes:
    bits = "".join(f"{b:08b}" for b in packed)
    codes = [int(bits[i : i + 6], 2) for i in range(0, len(bits) - 5, 6)]
    if codes and codes[-1] == 0:  # padding of a full character
        codes.pop()
    return bytes(ALPHABET[c - 1] for c in codes)


def varint(n: int) -> bytes:
    """Unsigned LEB128 of a 64-bit number."""
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes) -> tuple[int, int]:
    """The number and the bytes it took."""
    n = 0
    for i, b in enumerate(data):
        if i == 9 and b > 1 or i > 9:
            raise VarintError("Overflow")
        n |= (b & 127) << (7 * i)
        if b < 128:
            return n, i + 1
    raise VarintError("Incomplete")


def zigzag(n: int) -> bytes:
    """Signed numbers: 0, -1, 1, -2, ... as 0, 1, 2, 3, ..."""
    return varint((n << 1) ^ (n >> 63) if n >= 0 else (-n << 1) - 1)


def read_zigzag(data: bytes) -> tuple[int, int]:
    n, size = read_varint(data)
    return (n >> 1) ^ -(n & 1), size


def pack_col(key: Column | str) -> Column:
    @F.pandas_udf("binary")
    def packed(k: pd.Series) -> pd.Series:
        return k.map(lambda x: None if x is None else pack(x.encode() if isinstance(x, str) else bytes(x)))

    return packed(key)


def unpack_col(key: Column | str) -> Column:
    @F.pandas_udf("binary")
    def unpacked(k: pd.Series) -> pd.Series:
        return k.map(lambda x: None if x is None else unpack(bytes(x)))

    return unpacked(key)
