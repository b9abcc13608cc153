"""Whole sessions: request bytes parsed, replayed in order and answered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.state import CacheTable, empty
from keyloom.plans import replay
from keyloom.schema import CacheConfig
from keyloom.sources import snapshot, wire
from keyloom.sources.manager import Manager, publish

#: Requests in one row's bytes at most, as sequence numbers are made from row and place.
PIPELINED = 1_000_000
#: Saves and loads in one session at most, as each is a job over the whole state.
MAX_JOBS = 1_000
# Error replies.
TOO_LARGE, PROTOCOL = "-ERR value too large", "-ERR protocol error"
NO_PATH, SAVING, LOADING, FAILED, NO_LOG = "-ERR path not provided", "-ERR save already in progress", "-ERR load already in progress", "-ERR persistence failed", "-ERR aof disabled"


def _log(parsed: DataFrame, requests: DataFrame, op: Column, keyed: Column) -> DataFrame:
    """Keyed commands as a log; its seq is made from the row's and the place within the row."""
    timed = parsed.join(requests.select("seq", "t_ns"), "seq").filter(keyed)
    return timed.select((F.col("seq") * PIPELINED + F.col("nr")).alias("seq"), "t_ns", op.alias("op"), "key", "value", "nx", "xx", F.lit(False).alias("keepttl"), "ttl_ns", F.lit(0).cast("bigint").alias("flags"))


def _run_jobs(parsed: DataFrame, requests: DataFrame, log: DataFrame, manager: Manager, save: str, load: str) -> tuple[DataFrame, DataFrame]:
    """The log with what loads brought, and (seq, nr, how) of each save and load, run in their places in the log.

    A save writes the rows as they stand before it.  A load stores a snapshot's
    live entries, as sets at its own place.  ``how`` is done, failed, disabled,
    busy_save or busy_load.
    """
    at = F.col("seq") * PIPELINED + F.col("nr")
    spark = requests.sparkSession
    asked = parsed.filter(F.col("op").isin(save, load)).join(requests.select("seq", "t_ns"), "seq").select(at.alias("at"), "t_ns", "op", "path", "fast").orderBy("at").limit(MAX_JOBS + 1).collect()
    if len(asked) > MAX_JOBS:
        raise ValueError(f"more than {MAX_JOBS} saves and loads in one session")
    ends = []
    for r in asked:
        ok, got = [], []
        if r.op == save:
            rows = replay.replay(log.filter(F.col("seq") < r.at)).filter("phys").select("key", "value", "time_ns", "expires_ns", "flags", F.lit(0).cast("bigint").alias("cas"))
            how = manager.start_save(CacheTable(rows), r.t_ns, ok.append, r.path, r.fast)
        else:  # what was loaded is kept apart, as a later save may write to the same path
            how = manager.start_load(empty(spark), r.t_ns, ok.append, lambda t, to=got: to.append(publish(t, snapshot.scratch(spark))), r.path)
        if how == "started":
            manager.wait()
            how = "done" if ok == [True] else "failed"
        for t in got:
            never = F.lit(False)
            log = log.unionByName(t.state.select(
                F.lit(r.at).cast("bigint").alias("seq"), F.lit(r.t_ns).cast("bigint").alias("t_ns"), F.lit("SET").alias("op"), "key", "value", never.alias("nx"), never.alias("xx"), never.alias("keepttl"),
                F.when(F.col("expires_ns") > 0, F.col("expires_ns") - r.t_ns).otherwise(0).cast("bigint").alias("ttl_ns"), F.col("flags").cast("bigint").alias("flags")))
        ends.append((r.at // PIPELINED, r.at % PIPELINED, how))
    return log, spark.createDataFrame(ends, "seq long, nr int, how string")


def _answered(log: DataFrame, jobs: DataFrame | None) -> DataFrame:
    """seq, nr, result, reply of the log's commands; the sets of loads get no reply."""
    out = replay.results(log).select(F.call_function("div", F.col("seq"), F.lit(PIPELINED)).alias("seq"), (F.col("seq") % PIPELINED).cast("int").alias("nr"), "result", "reply")
    return out if jobs is None else out.join(jobs, ["seq", "nr"], "left_anti")


def resp_session(requests: DataFrame, info: str = "", limits: CacheConfig = CacheConfig(), manager: Manager | None = None) -> DataFrame:
    """seq, nr, reply, closes: the reply to each RESP request of rows (seq, t_ns, data).

    Rows are taken in the order of seq, as one total order of arrival; several
    requests in one row are pipelined.  A malformed request is answered by an
    error and closes its connection; an unfinished one gets no reply.  SAVE and
    LOAD are run by ``manager`` at their places in the session; without one
    they find no path.  A session has no log of its own, so BGREWRITEAOF is told that it is
    disabled.  MONITOR is accepted; its lines are ``metrics.monitor_lines``.
    """
    parsed = wire.parse_resp(requests, limits)
    keyed = F.col("op").isin("SET", "GET", "DEL", "INCR", "DECR", "TTL", "EXPIRE")
    log, jobs = _log(parsed, requests, F.col("op"), keyed), None
    if manager is not None:
        log, jobs = _run_jobs(parsed, requests, log, manager, "SAVE", "LOAD")
    done = _answered(log, jobs).select("seq", "nr", "reply")
    direct = parsed.filter(~F.coalesce(keyed, F.lit(False)) & ~F.coalesce(F.col("error") == "NeedMore", F.lit(False)))
    direct = direct.withColumn("how", F.lit("disabled")) if jobs is None else direct.join(jobs, ["seq", "nr"], "left")
    job = F.when(F.col("how") == "done", "+OK").when(F.col("how") == "busy_save", SAVING).when(F.col("how") == "busy_load", LOADING).when(F.col("how") == "failed", FAILED).otherwise(NO_PATH)
    text = (F.when(F.col("op") == "PING", "+PONG").when(F.col("op").isin("INFO", "STATS"), F.lit(f"${info}")).when(F.col("error") == "ValueTooLarge", TOO_LARGE)
            .when(F.col("error").isNotNull(), PROTOCOL).when(F.col("op") == "MONITOR", "+OK").when(F.col("op") == "BGREWRITEAOF", NO_LOG).otherwise(job))
    every = done.withColumn("closes", F.lit(False)).unionByName(direct.select("seq", "nr", text.alias("reply"), F.col("error").isNotNull().alias("closes")))
    return every.select("seq", "nr", wire.resp_reply("reply").alias("reply"), "closes")


def session_stats(requests: DataFrame, answers: DataFrame, parse: Callable[[DataFrame], DataFrame] = wire.parse_resp) -> DataFrame:
    """One row of a session's counters, under the names that the stats give them; ``parse_errors`` is the stats' ``errors.parse``.

    ``answers`` are those of :func:`resp_session` or :func:`http_session`, and
    ``parse`` reads the same protocol.  Bytes are those on the wire.  A connection
    is a ``client`` of the requests (without that column, all are one), and is
    active until an answer closes it.
    """
    client = F.col("client") if "client" in requests.columns else F.lit("")
    data = "reply" if "reply" in answers.columns else "response"
    told = F.col("error").isNotNull()
    asked = parse(requests).agg(F.count_if(~told).cast("bigint").alias("total_requests"), F.count_if(told & (F.col("error") != "NeedMore")).cast("bigint").alias("parse_errors"))
    sent = answers.agg(F.count(F.lit(1)).alias("total_responses"), F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).cast("bigint").alias("bytes_written"))
    ended = answers.groupBy("seq").agg(F.max("closes").alias("closes"))
    clients = requests.select("seq", client.alias("client"), F.octet_length("data").alias("bytes")).join(ended, "seq", "left").groupBy("client").agg(
        F.sum("bytes").alias("bytes"), F.max(F.coalesce("closes", F.lit(False))).alias("closed"))
    met = clients.agg(F.count_if(~F.col("closed")).cast("bigint").alias("active_connections"), F.count(F.lit(1)).alias("total_connections"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes_read"))
    return met.join(asked).join(sent).select("active_connections", "total_connections", "total_requests", "total_responses", "bytes_read", "bytes_written", "parse_errors")


def http_session(requests: DataFrame, stats_json: str = "{}", limits: CacheConfig = CacheConfig(), manager: Manager | None = None) -> DataFrame:
    """seq, nr, status, body, response, closes: the answer to each HTTP request of rows (seq, t_ns, data), in the order of seq.

    Saves and loads as in :func:`resp_session`.
    """
    parsed = wire.parse_http(requests, limits)
    op = F.when(F.col("command") == "get", "GET").when(F.col("command") == "delete", "DEL").otherwise("SET")
    keyed = F.col("command").isin("get", "set", "delete")
    log, jobs = _log(parsed, requests, op, keyed), None
    if manager is not None:
        log, jobs = _run_jobs(parsed.withColumnRenamed("command", "op"), requests, log, manager, "save", "load")
    done = _answered(log, jobs)
    both = parsed.filter(~F.coalesce(F.col("error") == "NeedMore", F.lit(False))).join(done, ["seq", "nr"], "left")
    both = both.withColumn("how", F.lit("disabled")) if jobs is None else both.join(jobs, ["seq", "nr"], "left")
    ended = F.col("how") == "done"
    status = (F.when(F.col("error") == "KeyTooLarge", 414).when(F.col("error") == "ValueTooLarge", 413).when(F.col("error").isNotNull(), 400)
              .when(F.col("command").isin("health", "stats"), 200).when(F.col("command") == "ops_not_found", 404).when(keyed, wire.http_status("", "result"))
              .when(ended, 200).when(F.col("how").startswith("busy"), 409).when(F.col("how") == "failed", 500).otherwise(400))
    body = F.when((F.col("command") == "health") | F.coalesce(ended, F.lit(False)), "OK").when(F.col("command") == "stats", stats_json).when(F.col("result") == "Hit", F.substring("reply", 2, 1 << 30)).otherwise("")
    out = both.select("seq", "nr", status.alias("status"), body.alias("body"), (F.col("error").isNotNull() | ~F.col("keepalive")).alias("closes"), F.col("command"))
    plain = wire.http_response(F.col("status"), F.col("body"), ~F.col("closes"))
    return out.select("seq", "nr", "status", "body", F.when(F.col("command") == "stats", wire.http_response(F.col("status"), F.col("body"), ~F.col("closes"), "application/json")).otherwise(plain).alias("response"), "closes")
