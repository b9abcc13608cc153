"""One key's state machine: a command applied to a state, in plain Python.

The batch fold is the same machine as Column expressions (``plans.replay``);
this form serves per-command results, streams and tests.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
SECOND = 1_000_000_000
_INTEGER = re.compile(r"[+-]?[0-9]+\Z")


class State(NamedTuple):
    phys: bool = False
    value: str | None = None
    expires_ns: int = 0
    flags: int = 0
    time_ns: int = 0
    total: int = 0
    burned: int = 0


EMPTY = State()


def alive(s: State, now: int) -> bool:
    return s.phys and (s.expires_ns == 0 or s.expires_ns > now)


def as_integer(value: str | None) -> int | None:
    if value is None or not _INTEGER.match(value):
        return None
    n = int(value)
    return n if LONG_MIN <= n <= LONG_MAX else None


def _gone(s: State) -> State:
    """The row removed; counters stay."""
    return State(total=s.total, burned=s.burned)


def step(s: State, op: str, t: int, value: str | None = None, nx: bool = False, xx: bool = False, keepttl: bool = False, ttl: int = 0, flags: int = 0) -> tuple[State, str, str]:
    """State, result and reply after a command.

    SET, GET, TTL, DEL, INCR, DECR, EXPIRE; anything else leaves the state
    (result "Unknown").  ``ttl`` is relative, in ns; for EXPIRE it may be 0 or
    less.  A counter that would leave a long is an error, and stays.
    """
    live = alive(s, t)
    if op == "SET":
        s = s._replace(burned=s.burned + 1)
        if live and nx:
            return s, "Found", "$-1"
        if not live and xx:
            return _gone(s), "NotFound", "$-1"
        expires = min(t + ttl, LONG_MAX) if ttl > 0 else 0
        if keepttl and live:
            expires = s.expires_ns
        new = State(True, value, expires, flags, t, s.total + (not s.phys), s.burned)
        return new, "Replaced" if live else "Inserted", "+OK"
    if op == "GET":
        return (s._replace(time_ns=t), "Hit", f"${s.value}") if live else (_gone(s), "Miss", "$-1")
    if op == "TTL":
        if not live:
            return _gone(s), "Miss", ":-2"
        left = -1 if s.expires_ns == 0 else (s.expires_ns - t) // SECOND
        return s._replace(time_ns=t), "Hit", f":{left}"
    if op == "DEL":
        return _gone(s), "Deleted" if live else "NotFound", f":{int(live)}"
    if op in ("INCR", "DECR"):
        delta = 1 if op == "INCR" else -1
        if not live:
            return State(True, str(delta), 0, 0, t, s.total + 1, s.burned + 1), "Inserted", f":{delta}"
        n = as_integer(s.value)
        if n is None or not LONG_MIN <= n + delta <= LONG_MAX:
            return s._replace(time_ns=t), "NotInteger", "-ERR value is not an integer"
        return s._replace(value=str(n + delta), time_ns=t, burned=s.burned + 1), "Updated", f":{n + delta}"
    if op == "EXPIRE":
        if not live:
            return _gone(s), "NotFound", ":0"
        return s._replace(expires_ns=min(max(t + ttl, 1), LONG_MAX), time_ns=t, burned=s.burned + 1), "Updated", ":1"
    return s, "Unknown", "-ERR protocol error"
