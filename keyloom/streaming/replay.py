"""A command stream into per-key state and replies, with Structured Streaming.

One state value per key holds the row, so every entry has its own expiry,
tested against the clock of each command.  Rows that are gone leave no state;
with a watermark, timers also clear dead rows that no command touches.  The
same state machine serves the batch replay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from keyloom.operators.metrics import monitor_lines
from keyloom.plans import model
from keyloom.schema import FOLD, RESULT

MILLI = 1_000_000
#: Numbers of segments that each micro-batch of a streamed log has, and the records of a segment while these suffice.
SEGMENTS, SEGMENT_ROWS = 64, 50_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CommandProcessor(StatefulProcessor):
    """Applies a key's commands of a micro-batch in the order of seq; with ``timers``, dead rows are cleared when the watermark passes their expiry."""

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("entry", FOLD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        s = model.State(*held) if held is not None else model.EMPTY
        out = []
        for r in sorted(rows, key=lambda r: r.seq):
            s, result, reply = model.step(s, r.op, r.t_ns, r.value, r.nx, r.xx, r.keepttl, r.ttl_ns, r.flags)
            out.append(Row(seq=r.seq, key=key[0], op=r.op, result=result, reply=reply))
        # a timer that has no longer a meaning finds its row alive, or none
        if self.timers and s.phys and s.expires_ns > 0:
            self.handle.registerTimer(-(-s.expires_ns // MILLI))
        if s.phys:
            self.state.update(tuple(s))
        elif held is not None:
            self.state.clear()
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        if held is not None and not model.alive(model.State(*held), expiredTimerInfo.getExpiryTimeInMs() * MILLI):
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, off the heap, as state per key needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def command_results(commands: DataFrame, clean: str | None = None) -> DataFrame:
    """seq, key, op, result, reply of a stream of commands (as of a log).  Commands of a key must not be split against their order between micro-batches.

    With ``clean``, a delay such as "1 hour", state is bounded by the live rows:
    a dead row that no command touches is cleared once the watermark, the latest
    command's time less that delay, has passed its expiry.  Replies stay the same, as a dead
    row answers like none; commands that come later than the delay, or
    before 1 ms of the epoch, are dropped.
    """
    if clean is not None:
        at = F.timestamp_micros(F.call_function("div", F.col("t_ns"), F.lit(1000)))
        commands = commands.withColumn("_at", at).withWatermark("_at", clean)
    return commands.groupBy("key").transformWithState(statefulProcessor=CommandProcessor(clean is not None), outputStructType=RESULT, outputMode="Append",
                                                      timeMode="None" if clean is None else "EventTime")


def monitor(commands: DataFrame) -> DataFrame:
    """The monitor line of each command (seq, t_ns, client, args) of a stream."""
    return monitor_lines(commands)


def windowed_ops(commands: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extension beyond the cache's own operations: commands per operation and tumbling window of event time, late ones within a watermark."""
    at = F.timestamp_micros(F.call_function("div", F.col("t_ns"), F.lit(1000)))
    return commands.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", length), "op").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "op", "n")


def append_log(records: DataFrame, path: str, checkpoint: str):
    """Write a stream of log records as segments, one set per micro-batch; a batch that is run again overwrites its own segments.

    A batch's segments are ranges of pos in ascending order; how many there are follows from
    its rows alone.  They are never merged by ``coalesce``, which joins and
    numbers the parts of a sort by where they lie, not by their order.
    """
    from keyloom.sources import aof

    def write(batch: DataFrame, epoch: int) -> None:
        batch.sparkSession.dataSource.register(aof.AofSource)
        parts = min(SEGMENTS, max(1, -(-batch.count() // SEGMENT_ROWS)))
        ordered = batch.repartitionByRange(parts, "pos").sortWithinPartitions("pos")
        rows = ordered.select("pos", "kind", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "flags", "cas", "expire_unix_ns",
                              F.lit(0).cast("bigint").alias("crc"), F.lit(True).alias("crc_ok"))
        rows.write.format("kv_aof").option("path", path).option("first", epoch * SEGMENTS).mode("append").save()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
