"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1
SECOND = 1_000_000_000


def _c(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def alive(expires: Column | str, now: Column | int) -> Column:
    """Not expired at ``now``; 0 never expires."""
    e = _c(expires)
    return (e == 0) | (e > _c(now))


def sat_add(a: Column | str | int, b: Column | str | int) -> Column:
    """a + b, cut to the bounds of a long."""
    a, b = _c(a), _c(b)
    high, low = F.lit(LONG_MAX), F.lit(-LONG_MAX - 1)
    return F.when((b > 0) & (a > high - F.greatest(b, F.lit(0))), high).when((b < 0) & (a < low - F.least(b, F.lit(0))), low).otherwise(
        F.try_add(a, b))


def resolve_expires(now: Column | int, ttl: Column | str, expires: Column | str | int = 0) -> Column:
    """Absolute expiry of a store: a given one, else now + ttl, else none (0)."""
    e, t = _c(expires), _c(ttl)
    return F.when(e > 0, e).when(t > 0, sat_add(now, t)).otherwise(F.lit(0).cast("bigint"))


def ttl_seconds(present: Column, expires: Column | str, now: Column | int) -> Column:
    """-2 for a missing or dead key, -1 without expiry, else the whole seconds left."""
    e, n = _c(expires), _c(now)
    left = F.call_function("div", e - n, F.lit(SECOND))
    return F.when(~F.coalesce(present & alive(e, n), F.lit(False)), F.lit(-2).cast("bigint")).when(e == 0, F.lit(-1).cast("bigint")).otherwise(left)


def varint_len(n: Column | str, most: int = 9) -> Column:
    """Bytes of an unsigned LEB128 number; ``most`` is what the largest takes: 9 for longs (0 <= n < 2^63), up to 19 for decimals without fraction."""
    n = _c(n)
    out = F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(n < 2 ** (7 * size), F.lit(size)).otherwise(out)
    for size in range(9, most):
        out = F.when(n >= F.lit(Decimal(2 ** (7 * size))), F.lit(size + 1)).otherwise(out)
    return out


def packable(key: Column | str) -> Column:
    """Whether a key packs into six bits a character."""
    return _c(key).rlike(r"^[-.0-9:A-PR-Y_a-y]{1,128}$")


def stored_key_len(key: Column | str) -> Column:
    """Bytes that a key takes in an entry: packed if it can be."""
    n = F.octet_length(_c(key))
    return F.when(packable(key), F.ceil(n * F.lit(6) / F.lit(8)).cast("int")).otherwise(n)


def entry_mem_size(key: Column | str, value: Column | str, expires: Column | str, flags: Column | str, usecas: bool = False) -> Column:
    """Bytes of one entry: header, optional fields, key, value and its own size field."""
    k = stored_key_len(key)
    body = (F.lit(16) + F.when(_c(expires) > 0, 8).otherwise(0) + F.when(_c(flags) > 0, 4).otherwise(0) + F.lit(8 if usecas else 0)
            + varint_len(k) + k + F.octet_length(_c(value))).cast("bigint")
    return body + F.when(body <= 254, 1).when(body <= 65533, 2).when(body <= 4294967291, 4).otherwise(8)


def parse_long(text: Column | str) -> Column:
    """A decimal long with an optional sign, else null.  Underscores between digits are not accepted."""
    t = _c(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


# Suffixes of byte sizes and their factors.
SUFFIXES = {"": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3, "t": 1024**4, "tb": 1024**4}


def parse_byte_size(text: Column | str, system_bytes: int | None = None) -> Column:
    """Bytes of "64mb", "1.5g", "100"; with ``system_bytes`` also "80%".  Null where it is malformed."""
    t = F.lower(F.regexp_replace(_c(text), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    number = F.regexp_extract(t, r"^([0-9.]+)[ \t\r\n]*([a-z%]*)$", 1).try_cast("double")
    suffix = F.regexp_extract(t, r"^([0-9.]+)[ \t\r\n]*([a-z%]*)$", 2)
    factor = F.lit(None).cast("double")
    for name, by in SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(float(by))).otherwise(factor)
    if system_bytes:
        factor = F.when(suffix == "%", F.lit(system_bytes / 100.0)).otherwise(factor)
    out = number * factor
    return F.when((out >= 0) & (out < 2.0**63), F.floor(out))


def parse_max_memory(text: Column | str, system_bytes: int) -> Column:
    """As ``parse_byte_size`` with percent, above 0; "unlimited" and malformed text give null."""
    out = parse_byte_size(text, system_bytes)
    return F.when(out > 0, out)


def parse_bool(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return F.when(t.isin("yes", "true", "1"), True).when(t.isin("no", "false", "0"), False)


def parse_fsync(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return F.when(t.isin("always", "everysec", "no"), t)
