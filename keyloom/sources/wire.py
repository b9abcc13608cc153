"""Wire requests: parsing RESP arrays and HTTP/1.1 requests, and rendering both, and replies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.schema import CacheConfig

SECOND, MILLI = 1_000_000_000, 1_000_000
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)

# Status lines.
REASONS = {200: "OK", 201: "Created", 400: "Bad Request", 404: "Not Found", 409: "Conflict", 413: "Payload Too Large", 414: "URI Too Long", 500: "Internal Server Error"}


class WireError(Exception):
    """A request that ends its connection; the message names the kind."""


class NeedMore(Exception):
    """The bytes end inside a request."""


@dataclass
class Command:
    op: str
    key: bytes | None = None
    value: bytes | None = None
    nx: bool = False
    xx: bool = False
    ttl_ns: int = 0
    path: bytes | None = None
    fast: bool = False
    keepalive: bool = True
    args: tuple[bytes, ...] = ()


def _long(text: bytes) -> int:
    digits = text[1:] if text[:1] in (b"+", b"-") else text
    if not digits or not digits.isdigit() or not LONG_MIN <= int(text) <= LONG_MAX:
        raise WireError("InvalidNumber")
    return int(text)


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\r\n", at)
    if end < 0:
        raise NeedMore
    return data[at:end], end + 2


def read_resp(data: bytes, at: int = 0, limits: CacheConfig = CacheConfig()) -> tuple[Command, int]:
    """The request that starts at ``at`` and where the next one does."""
    if at >= len(data):
        raise NeedMore
    if data[at : at + 1] != b"*":
        raise WireError("MalformedRequest")
    head, at = _line(data, at + 1)
    n = _long(head)
    if n < 0:
        raise WireError("MalformedRequest")
    if n > limits.max_args:
        raise WireError("TooManyArgs")
    args = []
    for _ in range(n):
        if at >= len(data):
            raise NeedMore
        if data[at : at + 1] != b"$":
            raise WireError("MalformedRequest")
        head, at = _line(data, at + 1)
        size = _long(head)
        if size < 0:
            raise WireError("MalformedRequest")
        if size > limits.max_value_length:
            raise WireError("ValueTooLarge")
        if len(data) < at + size + 2:
            raise NeedMore
        if data[at + size : at + size + 2] != b"\r\n":
            raise WireError("MalformedRequest")
        args.append(data[at : at + size])
        at += size + 2
    if not args:
        raise WireError("MalformedRequest")
    return _command(args, limits), at


def _scaled(text: bytes, by: int) -> int:
    n = _long(text) * by
    if not LONG_MIN <= n <= LONG_MAX:
        raise WireError("InvalidNumber")
    return n


# Commands of a fixed number of words.
PLAIN = {"PING": 1, "INFO": 1, "STATS": 1, "MONITOR": 1, "BGREWRITEAOF": 1, "GET": 2, "DEL": 2, "INCR": 2, "DECR": 2, "TTL": 2, "EXPIRE": 3}


def _command(args: list[bytes], limits: CacheConfig) -> Command:
    op = args[0].decode("latin-1").upper()
    out = Command(op, args=tuple(args))
    if op in PLAIN:
        if len(args) != PLAIN[op]:
            raise WireError("MalformedRequest")
        if len(args) > 1:
            out.key = _key(args[1], limits)
        if op == "EXPIRE":
            out.ttl_ns = _scaled(args[2], SECOND)
        return out
    words, rest = [a.upper() for a in args], iter(range(3 if op == "SET" else 1, len(args)))
    if op == "SET" and len(args) >= 3:
        out.key, out.value = _key(args[1], limits), args[2]
        for i in rest:
            if words[i] in (b"NX", b"XX"):
                out.nx, out.xx = out.nx or words[i] == b"NX", out.xx or words[i] == b"XX"
            elif words[i] in (b"EX", b"PX") and next(rest, None) is not None:
                out.ttl_ns = _scaled(args[i + 1], SECOND if words[i] == b"EX" else MILLI)
            else:
                raise WireError("MalformedRequest")
        if out.nx and out.xx:
            raise WireError("MalformedRequest")
        return out
    if op in ("SAVE", "LOAD"):
        for i in rest:
            if words[i] == b"FAST":
                out.fast = True
            elif words[i] == (b"TO" if op == "SAVE" else b"FROM") and out.path is None and next(rest, None) is not None:
                out.path = args[i + 1]
            else:
                raise WireError("MalformedRequest")
        return out
    raise WireError("MalformedRequest")


def _key(key: bytes, limits: CacheConfig) -> bytes:
    if len(key) > limits.max_key_length:
        raise WireError("ValueTooLarge")
    return key


def read_http(data: bytes, at: int = 0, limits: CacheConfig = CacheConfig()) -> tuple[Command, int]:
    """The HTTP request that starts at ``at`` and where the next one does.  Keys are taken as they stand, query string and all."""
    if at >= len(data):
        raise NeedMore
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise NeedMore
    first, *headers = data[at:end].split(b"\r\n")
    method, space, rest = first.partition(b" ")
    if not space:
        raise WireError("MalformedRequest")
    if method not in (b"GET", b"POST", b"PUT", b"DELETE"):
        raise WireError("InvalidMethod")
    path, space, version = rest.partition(b" ")
    if not space or not path or version != b"HTTP/1.1" or path[:1] != b"/" or len(path) < 2:
        raise WireError("MalformedRequest")
    key = path[1:]
    if len(key) > limits.max_key_length:
        raise WireError("KeyTooLarge")
    size, keep = 0, True
    for h in headers:
        name, colon, value = h.partition(b":")
        name, value = name.strip(b" \t").lower(), value.strip(b" \t")
        if colon and name == b"content-length":
            if not value.isdigit():
                raise WireError("MalformedRequest")
            size = int(value)
            if size > limits.max_value_length:
                raise WireError("ValueTooLarge")
        elif colon and name == b"connection":
            keep = False if b"close" in value.lower() else True if b"keep-alive" in value.lower() else keep
    base, _, query = key.partition(b"?")
    asks = method == b"POST" and base in (b"@save", b"@load")
    if method in (b"POST", b"PUT"):
        if size == 0 and not asks:
            raise WireError("MalformedRequest")
    elif size:
        raise WireError("MalformedRequest")
    body, after = end + 4, end + 4 + size
    if len(data) < after:
        raise NeedMore
    if key[:1] == b"@":
        if asks:
            out = Command(base[1:].decode(), keepalive=keep)
            for pair in query.split(b"&"):
                name, eq, value = pair.partition(b"=")
                if eq and name == b"path" and value:
                    out.path = value
                elif eq and name == b"fast" and (value == b"1" or value.lower() == b"true"):
                    out.fast = True
            return out, after
        if method == b"GET" and key in (b"@health", b"@stats"):
            return Command(key[1:].decode(), keepalive=keep), after
        return Command("ops_not_found", keepalive=keep), after
    if method == b"GET" or method == b"DELETE":
        return Command(method.decode().lower(), key, keepalive=keep), after
    return Command("set", key, data[body:after], xx=method == b"PUT", keepalive=keep), after


COMMANDS = "seq long, nr int, op string, key string, value string, nx boolean, xx boolean, ttl_ns long, path string, fast boolean, keepalive boolean, error string, consumed long"


def _parsed(reader, limits: CacheConfig):
    def text(b: bytes | None) -> str | None:
        return None if b is None else b.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for p in batches:
            out = []
            for seq, data in zip(p["seq"], p["data"], strict=True):
                data, at, nr = bytes(data or b""), 0, 0
                while at < len(data):
                    try:
                        c, at = reader(data, at, limits)
                    except (WireError, NeedMore) as e:  # the rest of the connection's bytes is not read
                        out.append((seq, nr, None, None, None, False, False, 0, None, False, False, str(e) or "NeedMore", at))
                        break
                    out.append((seq, nr, c.op, text(c.key), text(c.value), c.nx, c.xx, c.ttl_ns, text(c.path), c.fast, c.keepalive, None, at))
                    nr += 1
            yield pd.DataFrame(out, columns=[x.split()[0] for x in COMMANDS.split(", ")])

    return run


def parse_resp(requests: DataFrame, limits: CacheConfig = CacheConfig()) -> DataFrame:
    """The commands in each row's bytes (seq, data): several if pipelined; an error or an unfinished one ends the row."""
    return requests.select("seq", "data").mapInPandas(_parsed(read_resp, limits), COMMANDS)


def parse_http(requests: DataFrame, limits: CacheConfig = CacheConfig()) -> DataFrame:
    """As :func:`parse_resp` for HTTP; the operation is in ``command``."""
    return requests.select("seq", "data").mapInPandas(_parsed(read_http, limits), COMMANDS).withColumnRenamed("op", "command")


def register(spark, limits: CacheConfig = CacheConfig()) -> None:
    """Make both parsers SQL table functions: resp_commands(data), http_commands(data)."""
    from pyspark.sql.functions import udtf

    returns = "nr int, op string, key string, value string, nx boolean, xx boolean, ttl_ns long, path string, fast boolean, keepalive boolean, error string"

    def make(reader):
        class Parse:
            def eval(self, data: bytes):
                data, at, nr = bytes(data or b""), 0, 0
                while at < len(data):
                    try:
                        c, at = reader(data, at, limits)
                    except (WireError, NeedMore) as e:
                        yield nr, None, None, None, False, False, 0, None, False, False, str(e) or "NeedMore"
                        return
                    t = lambda b: None if b is None else b.decode("utf-8", "replace")
                    yield nr, c.op, t(c.key), t(c.value), c.nx, c.xx, c.ttl_ns, t(c.path), c.fast, c.keepalive, None
                    nr += 1

        return udtf(Parse, returnType=returns)

    spark.udtf.register("resp_commands", make(read_resp))
    spark.udtf.register("http_commands", make(read_http))


# --- rendering ------------------------------------------------------------
def resp_args() -> Column:
    """The words of a logged command (op, key, value, nx, xx, ttl_ns)."""
    ttl = F.col("ttl_ns")
    whole = F.call_function("div", ttl, F.lit(SECOND)).cast("string")
    return F.array_compact(F.array(
        "op", "key", F.when(F.col("op") == "SET", F.col("value")), F.when(F.col("nx"), "NX"), F.when(F.col("xx"), "XX"),
        F.when((F.col("op") == "SET") & (ttl > 0), "EX"), F.when((F.col("op") == "SET") & (ttl > 0), whole), F.when(F.col("op") == "EXPIRE", whole)))


def resp_bytes(args: Column) -> Column:
    """A RESP array of bulk strings, as binary."""
    n = F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"))
    bulk = F.transform(args, lambda a: F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a, F.lit("\r\n")))
    return F.concat(n, F.array_join(bulk, "")).cast("binary")


def http_bytes() -> Column:
    """An HTTP request of a logged command: GET, DELETE, POST for SET, PUT for the rest; odd seqs stay alive."""
    op = F.col("op")
    body = F.when(op.isin("GET", "DEL"), F.lit("")).otherwise(F.coalesce("value", "op"))
    method = F.when(op == "GET", "GET").when(op == "DEL", "DELETE").when(op == "SET", "POST").otherwise("PUT")
    size = F.when(op.isin("GET", "DEL"), F.lit("")).otherwise(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n")))
    keep = F.when(F.col("seq") % 2 == 1, "keep-alive").otherwise("close")
    return F.concat(method, F.lit(" /"), F.col("key"), F.lit(" HTTP/1.1\r\n"), size, F.lit("Connection: "), keep, F.lit("\r\n\r\n"), body).cast("binary")


def http_status(method: str, result: Column | str) -> Column:
    """Status code of an operation's result."""
    r = F.col(result) if isinstance(result, str) else result
    return (F.when(r.isin("Hit", "Replaced", "Deleted"), 200).when(r == "Inserted", 201).when(r.isin("Miss", "NotFound"), 404)
            .when(r.isin("Found", "Canceled"), 409).otherwise(500))


def http_response(status: Column, body: Column, keepalive: Column, kind: str | None = None) -> Column:
    """A whole HTTP response, as binary; ``kind`` is the content type, if one is named."""
    reason = F.lit(REASONS[500])
    for code, text in REASONS.items():
        reason = F.when(status == code, text).otherwise(reason)
    return F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), reason, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\nConnection: "),
                    F.when(keepalive, "keep-alive").otherwise("close"), F.lit(f"\r\nContent-Type: {kind}\r\n\r\n" if kind else "\r\n\r\n"), body).cast("binary")


def resp_reply(reply: Column | str) -> Column:
    """Bytes of a replayed reply: "$" and a value becomes a bulk string, the rest a line."""
    r = F.col(reply) if isinstance(reply, str) else reply
    value = F.substring(r, 2, 1 << 30)
    return F.when(r.startswith("$") & (r != "$-1"), F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n"))).otherwise(F.concat(r, F.lit("\r\n"))).cast("binary")
