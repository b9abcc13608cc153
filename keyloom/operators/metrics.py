"""Stats and monitor lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import expr as E
from keyloom.operators.state import CacheTable

# The groups and fields of the stats, in their order.
STATS = {
    None: ("time_unix_ms", "uptime_ms"),
    "server": ("active_connections", "total_connections", "total_requests", "total_responses", "bytes_read", "bytes_written"),
    "errors": ("accept", "read", "write", "parse", "protocol", "pool_full", "buffer_overflow", "cache", "timeout"),
    "cache": ("items", "total_items", "bytes", "shards"),
}


def snapshot(table: CacheTable, log: DataFrame, now_ms: int, start_ms: int, total_items: int | None = None) -> DataFrame:
    """One row of nested stats: cache gauges of the table, server counters of a command log (seq, op, key, value).

    Requests and responses are the log's commands, bytes those of their keys
    and values, connections the distinct clients (1 without that column).
    """
    clients = F.count_distinct("client") if "client" in log.columns else F.lit(1)
    server = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).cast("bigint").alias("r"),
                     F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("bigint").alias("w"), clients.cast("bigint").alias("c"))
    gauges = table.state.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(E.entry_mem_size("key", "value", "expires_ns", "flags", table.config.usecas)), F.lit(0)).cast("bigint").alias("bytes"))
    none = F.lit(0).cast("bigint")
    total = F.col("items") if total_items is None else F.lit(total_items).cast("bigint")
    return server.join(gauges).select(
        F.lit(now_ms).cast("bigint").alias("time_unix_ms"), F.lit(max(0, now_ms - start_ms)).cast("bigint").alias("uptime_ms"),
        F.struct(none.alias("active_connections"), F.col("c").alias("total_connections"), F.col("n").alias("total_requests"), F.col("n").alias("total_responses"),
                 F.col("r").alias("bytes_read"), F.col("w").alias("bytes_written")).alias("server"),
        F.struct(*(none.alias(k) for k in STATS["errors"])).alias("errors"),
        F.struct("items", total.alias("total_items"), "bytes", F.lit(table.config.nshards).cast("bigint").alias("shards")).alias("cache"))


def stats_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct("time_unix_ms", "uptime_ms", "server", "errors", "cache")).alias("json"))


def info_lines(stats: DataFrame) -> DataFrame:
    """One text of 21 key:value lines."""
    names = [f"{g}.{k}" if g else k for g, keys in STATS.items() for k in keys]
    return stats.select(F.concat_ws("\n", *(F.concat(F.lit(f"{n}:"), F.col(n).cast("string")) for n in names)).alias("info"))


def stats_by_op(results: DataFrame) -> DataFrame:
    """op, requests, hits, errors of replayed commands (op, result)."""
    hit = F.col("result").isin("Hit", "Inserted", "Replaced", "Deleted", "Updated")
    return results.groupBy("op").agg(F.count(F.lit(1)).alias("requests"), F.count_if(hit).cast("bigint").alias("hits"), F.count_if(F.col("result") == "NotInteger").cast("bigint").alias("errors"))


def escaped(arg: Column) -> Column:
    """A quoted monitor argument: \\n \\r \\t \\" \\\\ escaped, other bytes outside 32..126 as \\xNN."""
    data = arg.cast("binary")
    hexed = F.hex(data)
    plain = arg.cast("string").rlike(r"^[ !#-\[\]-~]*$")
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: hexed.substr(i * 2 - 1, F.lit(2)))

    def one(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        return (F.when(h == "0A", "\\n").when(h == "0D", "\\r").when(h == "09", "\\t").when(h == "22", '\\"').when(h == "5C", "\\\\")
                .when((code < 32) | (code >= 127), F.concat(F.lit("\\x"), h)).otherwise(F.char(code)))

    body = F.when(plain, arg.cast("string")).when(F.octet_length(data) == 0, "").otherwise(F.array_join(F.transform(bytes_, one), ""))
    return F.concat(F.lit(' "'), body, F.lit('"'))


def monitor_lines(commands: DataFrame) -> DataFrame:
    """seq, line for commands (seq, t_ns, client, args array<string or binary>)."""
    us = F.call_function("div", F.col("t_ns"), F.lit(1000))
    head = F.concat(F.lit("+"), F.call_function("div", us, F.lit(1_000_000)).cast("string"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit(" [0 "), F.col("client"), F.lit("]"))
    return commands.select("seq", F.concat(head, F.array_join(F.transform("args", escaped), ""), F.lit("\r\n")).alias("line"))
