"""Snapshot files: a Spark data source over blocks of compressed records.

A snapshot is one file or a folder of files (one per task).  Readers index the
block headers and decode blocks in parallel; writers rename whole files.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keyloom.functions import expr as E
from keyloom.operators.state import COLUMNS, CacheTable
from keyloom.schema import SNAPSHOT
from keyloom.sources import files

# Fixed values of the format; numbers are little-endian.
MAGIC = b"CRUCIBL\0"
VERSION, LZ4, FLAG_CAS = 2, 1, 1
TAG = b"CRUC"
HEADER, BLOCK, RECORD = files.Layout("<8sIIQI"), files.Layout("<4sIII"), files.Layout("<IIQIQ")
BLOCK_SIZE = 1024 * 1024


class SnapshotError(ValueError):
    """InvalidHeader, UnsupportedVersion, UnsupportedCompression, BlockMalformed, BlockCrcMismatch, RecordMalformed, UnexpectedEof."""


def encode_header(saved_ns: int, usecas: bool) -> bytes:
    return HEADER.pack(MAGIC, VERSION, FLAG_CAS if usecas else 0, saved_ns, LZ4)


def decode_header(data: bytes) -> tuple[bool, int]:
    """Whether CAS numbers are recorded, and when it was saved."""
    if len(data) < HEADER.size:
        raise SnapshotError("UnexpectedEof")
    magic, version, flags, saved, compression = HEADER.unpack(data[: HEADER.size])
    if magic != MAGIC:
        raise SnapshotError("InvalidHeader")
    if version != VERSION:
        raise SnapshotError("UnsupportedVersion")
    if compression != LZ4:
        raise SnapshotError("UnsupportedCompression")
    return bool(flags & FLAG_CAS), saved


def encode_block(raw: bytes) -> bytes:
    packed = pa.Codec("lz4_raw").compress(raw, asbytes=True)
    return BLOCK.pack(TAG, zlib.crc32(packed), len(raw), len(packed)) + packed


def encode_blocks(rows: Iterator[tuple[bytes, bytes, int, int, int]], block_size: int = BLOCK_SIZE) -> Iterator[bytes]:
    """Blocks of records (key, value, expire_unix_ns, flags, cas)."""
    buf = bytearray()
    for key, value, expire, flags, cas in rows:
        size = RECORD.size + len(key) + len(value)
        if buf and len(buf) + size > block_size:
            yield encode_block(bytes(buf))
            buf = bytearray()
        buf += RECORD.pack(len(key), len(value), expire, flags, cas) + key + value
        if len(buf) >= block_size:
            yield encode_block(bytes(buf))
            buf = bytearray()
    if buf:
        yield encode_block(bytes(buf))


def decode_records(raw: bytes) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    at = 0
    while at < len(raw):
        if len(raw) - at < RECORD.size:
            raise SnapshotError("RecordMalformed")
        k, v, expire, flags, cas = RECORD.unpack_from(raw, at)
        at += RECORD.size
        if len(raw) - at < k + v:
            raise SnapshotError("RecordMalformed")
        yield raw[at : at + k], raw[at + k : at + k + v], expire, flags, cas
        at += k + v


def decode_block(head: bytes, packed: bytes) -> bytes:
    tag, crc, size, length = BLOCK.unpack(head)
    if tag != TAG:
        raise SnapshotError("BlockMalformed")
    if len(packed) < length:
        raise SnapshotError("UnexpectedEof")
    if zlib.crc32(packed) != crc:
        raise SnapshotError("BlockCrcMismatch")
    try:
        return pa.Codec("lz4_raw").decompress(packed, decompressed_size=size, asbytes=True)
    except OSError as e:
        raise SnapshotError("BlockMalformed") from e


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int) -> None:
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        """Runs of blocks of about ``per_task`` bytes; only block headers are read here."""
        out: list[InputPartition] = []
        for f in files.listed(self.path):
            decode_header(files.read_range(f, 0, HEADER.size))
            size, at, first = files.size_of(f), HEADER.size, HEADER.size
            store, path = files.open_store(f)
            with store.open_input_file(path) as stream:
                while at < size:
                    stream.seek(at)
                    head = stream.read(BLOCK.size)
                    if len(head) < BLOCK.size:
                        raise SnapshotError("UnexpectedEof")
                    tag, _, _, length = BLOCK.unpack(head)
                    if tag != TAG:
                        raise SnapshotError("BlockMalformed")
                    at += BLOCK.size + length
                    if at - first >= self.per_task:
                        out.append(Range(f, first, at))
                        first = at
            if first < size:
                out.append(Range(f, first, size))
        return out or [Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        at = partition.start
        store, path = files.open_store(partition.path)
        with store.open_input_file(path) as f:
            while at < partition.end:
                f.seek(at)
                head = f.read(BLOCK.size)
                packed = f.read(BLOCK.unpack(head)[3])
                at += BLOCK.size + len(packed)
                yield from decode_records(decode_block(head, packed))


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None) -> None:
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, path: str, saved_ns: int, usecas: bool) -> None:
        self.path, self.saved_ns, self.usecas = path, saved_ns, usecas

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        blocks = list(encode_blocks((bytes(r.key), bytes(r.value), max(0, r.expire_unix_ns), r.flags, r.cas if self.usecas else 0) for r in rows))
        part = TaskContext.get().partitionId()
        if not blocks and part:
            return _Written(None)
        path = f"{self.path}/part-{part:05d}.snap"
        files.put(path, encode_header(self.saved_ns, self.usecas) + b"".join(blocks))
        return _Written(path)

    def commit(self, messages: list) -> None:
        files.put(f"{self.path}/_SUCCESS", b"")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path:
                store, path = files.open_store(m.path)
                store.delete_file(path)


class SnapshotSource(DataSource):
    """format("kv_snapshot"): options path, per_task (bytes a task reads), saved_ns, usecas (writing)."""

    @classmethod
    def name(cls) -> str:
        return "kv_snapshot"

    def schema(self) -> str:
        return SNAPSHOT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("per_task", 64 * 1024 * 1024)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("saved_ns", 0)), self.options.get("usecas", "false").lower() == "true")


def save(table: CacheTable, path: str, now: int, fast: bool = True) -> None:
    """Write the live rows; ``fast`` by all tasks at once, else as one file."""
    spark = table.state.sparkSession
    spark.dataSource.register(SnapshotSource)
    rows = table.state.filter(E.alive("expires_ns", now)).select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("expires_ns").alias("expire_unix_ns"), "flags", "cas")
    rows = rows if fast else rows.coalesce(1)
    rows.write.format("kv_snapshot").option("path", path).option("saved_ns", now).option("usecas", str(table.config.usecas)).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, value, expire_unix_ns, flags, cas of all records."""
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("kv_snapshot").option("path", path).load()


def merge(table: CacheTable, records: DataFrame, now: int) -> tuple[CacheTable, DataFrame]:
    """Load records (key, value, expires_ns, flags, cas; one per key) into a table; and inserted, skipped.

    Expired records are skipped, others are stored over what is there; nothing else is cleared.
    """
    live = E.alive("expires_ns", now)
    kept = records.filter(live)
    old = table.state.join(kept.select("key"), "key", "left_anti").select(*COLUMNS)
    cas = F.col("cas") if table.config.usecas else F.lit(0).cast("bigint").alias("cas")
    new = kept.select("key", "value", F.lit(now).cast("bigint").alias("time_ns"), "expires_ns", "flags", cas)
    stats = records.agg(F.count_if(live).cast("bigint").alias("inserted"), F.count_if(~live).cast("bigint").alias("skipped"))
    return CacheTable(old.unionByName(new), table.config), stats


def load(table: CacheTable, path: str, now: int) -> tuple[CacheTable, DataFrame]:
    """Load a snapshot file or folder into a table."""
    r = read(table.state.sparkSession, path).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("expire_unix_ns").alias("expires_ns"), "flags", "cas")
    return merge(table, r, now)


def save_native(table: CacheTable, path: str, now: int) -> None:
    """The native form: live rows as Parquet, partitioned by shard, so one shard is read alone."""
    CacheTable(table.state.filter(E.alive("expires_ns", now)), table.config).sharded().repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``; unset, in local mode, a folder of our own)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        base = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/kv-{uuid.uuid4().hex}"
