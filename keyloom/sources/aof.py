"""Append-only command logs: a Spark data source over their records."""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keyloom.schema import AOF, CacheConfig
from keyloom.sources import files

# Fixed values of the format; numbers are little-endian.
MAGIC = b"CRUCAOF\0"
VERSION = 1
HEADER, RECORD = files.Layout("<8sII"), files.Layout("<BIIIQQI")
SET, DEL, EXPIRE = 1, 2, 3


class AofError(ValueError):
    """InvalidHeader, UnsupportedVersion, RecordCrcMismatch."""


def encode_header() -> bytes:
    return HEADER.pack(MAGIC, VERSION, 0)


def encode_record(kind: int, key: bytes, value: bytes = b"", flags: int = 0, cas: int = 0, expire: int = 0) -> bytes:
    return RECORD.pack(kind, len(key), len(value), flags, cas, expire, zlib.crc32(key + value)) + key + value


def decode(data: bytes, strict: bool = True) -> Iterator[tuple]:
    """(pos, kind, key, value, flags, cas, expire, crc, ok); a record cut short at the end is left out, a wrong sum is an error if ``strict``."""
    if len(data) < HEADER.size or data[:8] != MAGIC:
        raise AofError("InvalidHeader")
    if HEADER.unpack(data[: HEADER.size])[1] != VERSION:
        raise AofError("UnsupportedVersion")
    yield from records(data, HEADER.size, strict)


def records(data: bytes, at: int, strict: bool = True) -> Iterator[tuple]:
    """As :func:`decode`, from a record's start ``at``."""
    while at + RECORD.size <= len(data):
        kind, k, v, flags, cas, expire, crc = RECORD.unpack_from(data, at)
        body = data[at + RECORD.size : at + RECORD.size + k + v]
        if len(body) < k + v:
            break
        ok = zlib.crc32(body) == crc
        if strict and not ok:
            raise AofError("RecordCrcMismatch")
        yield at, kind, body[:k], body[k:], flags, cas, expire, crc, ok
        at += RECORD.size + k + v


class File(InputPartition):
    def __init__(self, path: str, nr: int) -> None:
        self.path, self.nr = path, nr


class _Reader(DataSourceReader):
    def __init__(self, path: str, strict: bool) -> None:
        self.path, self.strict = path, strict

    def partitions(self) -> list[InputPartition]:
        return [File(f, i) for i, f in enumerate(files.listed(self.path))] or [File("", 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Records of one segment; positions order segments by name, then by place."""
        if partition.path:
            for pos, *rest in decode(files.read_range(partition.path, 0), self.strict):
                yield ((partition.nr << 40) + pos, *rest)


class Stretch(InputPartition):
    def __init__(self, path: str, nr: int, start: int, end: int) -> None:
        self.path, self.nr, self.start, self.end = path, nr, start, end


def whole_end(uri: str, at: int) -> int:
    """Where the last whole record of a segment ends, from a record's end ``at`` on (0: the segment's start)."""
    store, path = files.open_store(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        if size < HEADER.size:
            return 0
        at = max(at, HEADER.size)
        while at + RECORD.size <= size:
            f.seek(at)
            _, k, v, *_ = RECORD.unpack(f.read(RECORD.size))
            if at + RECORD.size + k + v > size:
                break
            at += RECORD.size + k + v
    return at


class _Tail(DataSourceStreamReader):
    """Follows a log: an offset is the bytes read of each segment.

    Only the last segment may still grow; it is read up to its last whole
    record.  Segments are told apart by their number, that of their name (0 if
    it has none), which also orders positions.  Offsets grow with the number of
    segments, so a long log is to be rewritten now and then.
    """

    def __init__(self, path: str, strict: bool) -> None:
        self.path, self.strict, self.seen = path, strict, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        try:
            found = files.listed(self.path)
        except FileNotFoundError:
            return self.seen
        ends = {posixpath.basename(f): files.size_of(f) for f in found[:-1]}
        for f in found[-1:]:
            name = posixpath.basename(f)
            ends[name] = whole_end(f, self.seen.get(name, 0))
        self.seen = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        at = {posixpath.basename(f): f for f in files.listed(self.path)} if end else {}
        stem = {n: n.split(".")[0] for n in end}
        return [Stretch(at[n], int(stem[n]) if stem[n].isdigit() else 0, start.get(n, 0), z) for n, z in sorted(end.items()) if z > start.get(n, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        data, first = files.read_range(partition.path, partition.start, partition.end - partition.start), partition.nr << 40
        found = records(data, 0, self.strict) if partition.start else decode(data, self.strict)
        for pos, *rest in found:
            yield (first + partition.start + pos, *rest)


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None) -> None:
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, path: str, first: int) -> None:
        self.path, self.first = path, first

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        out = bytearray(encode_header())
        for r in rows:
            out += encode_record(r.kind, bytes(r.key), bytes(r.value or b""), r.flags or 0, r.cas or 0, r.expire_unix_ns or 0)
        if len(out) == HEADER.size:
            return _Written(None)
        path = f"{self.path}/{self.first + TaskContext.get().partitionId():010d}.aof"
        files.put(path, bytes(out))
        return _Written(path)

    def commit(self, messages: list) -> None:
        files.put(f"{self.path}/_SUCCESS", b"")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path:
                store, path = files.open_store(m.path)
                store.delete_file(path)


class AofSource(DataSource):
    """format("kv_aof"): options path, strict (reading), first (number of the first segment written)."""

    @classmethod
    def name(cls) -> str:
        return "kv_aof"

    def schema(self) -> str:
        return AOF

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("strict", "true").lower() == "true")

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Tail(self.options["path"], self.options.get("strict", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("first", 0)))


def append(records: DataFrame, path: str) -> None:
    """Append records (pos, kind, key, value, flags, cas, expire_unix_ns) in the order of pos, as new segments after those there."""
    spark = records.sparkSession
    spark.dataSource.register(AofSource)
    try:
        have = files.listed(path)
    except FileNotFoundError:
        have = []
    first = 1 + max((int(f.rsplit("/", 1)[1].split(".")[0]) for f in have), default=-1)
    rows = records.orderBy("pos").select("pos", "kind", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "flags", "cas", "expire_unix_ns",
                                         F.lit(0).cast("bigint").alias("crc"), F.lit(True).alias("crc_ok"))
    rows.write.format("kv_aof").option("path", path).option("first", first).mode("append").save()


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    spark.dataSource.register(AofSource)
    return spark.read.format("kv_aof").option("path", path).option("strict", str(strict)).load()


def tail(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A stream of a log's records, those there and those that are appended, each once."""
    spark.dataSource.register(AofSource)
    return spark.readStream.format("kv_aof").option("path", path).option("strict", str(strict)).load()


def rewrite(spark: SparkSession, path: str, out: str, now: int, config: CacheConfig | None = None) -> None:
    """Compact a log into a fresh folder: one set per live key, with its CAS number where ``config`` uses them."""
    from keyloom.plans.replay import aof_rewrite

    small = aof_rewrite(read(spark, path), now, config)
    append(small.select(F.monotonically_increasing_id().alias("pos"), "kind", "key", "value", "flags", "cas", "expire_unix_ns"), out)


def startup(spark: SparkSession, aof_path: str | None, snapshot_path: str | None) -> str:
    """What to start from: "aof" if there is one, else "snapshot", else "empty"."""
    for name, path in (("aof", aof_path), ("snapshot", snapshot_path)):
        if path:
            try:
                files.listed(path)
                return name
            except FileNotFoundError:
                continue
    return "empty"
