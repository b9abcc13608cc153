"""Fixed schemas and the configuration of a cache table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("time_ns", T.LongType()),
    T.StructField("expires_ns", T.LongType()), T.StructField("flags", T.LongType()), T.StructField("cas", T.LongType()),
])
COMMAND = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("t_ns", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("nx", T.BooleanType()), T.StructField("xx", T.BooleanType()), T.StructField("keepttl", T.BooleanType()),
    T.StructField("ttl_ns", T.LongType()), T.StructField("flags", T.LongType()),
])
RESULT = "seq long, key string, op string, result string, reply string"
#: One key's state while a log is replayed.
FOLD = "phys boolean, value string, expires_ns bigint, flags bigint, time_ns bigint, total bigint, burned bigint"
AOF = "pos long, kind int, key binary, value binary, flags long, cas long, expire_unix_ns long, crc long, crc_ok boolean"
SNAPSHOT = "key binary, value binary, expire_unix_ns long, flags long, cas long"


@dataclass(frozen=True)
class CacheConfig:
    """Options; 0 takes the default.  Of the reference's options those that have a meaning here."""

    nshards: int = 4096
    usecas: bool = False
    seed: int = 0
    noevict: bool = False
    max_key_length: int = 1024 * 1024
    max_value_length: int = 1024 * 1024
    max_args: int = 32
    pollsize: int = 20
    autosweep_ratio: float = 0.10
    aof_rewrite_percentage: int = 100
    aof_rewrite_min_size: int = 64 * 1024 * 1024

    def __post_init__(self) -> None:
        for name, value in (("nshards", 4096), ("pollsize", 20)):
            if not getattr(self, name):
                object.__setattr__(self, name, value)
