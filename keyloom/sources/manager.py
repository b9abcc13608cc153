"""Background persistence jobs, one at a time, and published states."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from keyloom.operators.state import CacheTable
from keyloom.schema import ENTRY, CacheConfig
from keyloom.sources import files, snapshot

POINTER = "CURRENT"


class Manager:
    """Starts saves and loads of snapshots in the background: one at a time, as a second is refused."""

    def __init__(self, default_path: str | None) -> None:
        self.default_path, self._lock, self._state, self._thread = default_path, threading.Lock(), "idle", None
        self.error: Exception | None = None  # that of the last job, if it failed

    def start_save(self, table: CacheTable, now: int, done: Callable[[bool], None] = lambda ok: None, path: str | None = None, fast: bool = False) -> str:
        return self._start("saving", path, lambda p: snapshot.save(table, p, now, fast), done, table.state.sparkSession)

    def start_load(self, table: CacheTable, now: int, done: Callable[[bool], None] = lambda ok: None, got: Callable[[CacheTable], None] = lambda t: None, path: str | None = None) -> str:
        return self._start("loading", path, lambda p: got(snapshot.load(table, p, now)[0]), done, table.state.sparkSession)

    def wait(self, timeout: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(timeout)

    def _start(self, state: str, path: str | None, job: Callable[[str], None], done: Callable[[bool], None], spark: SparkSession | None = None) -> str:
        """started, disabled, busy_save or busy_load."""
        path = path if path is not None else self.default_path
        if self.default_path is None or not path:
            return "disabled"
        with self._lock:
            if self._state != "idle":
                return "busy_save" if self._state == "saving" else "busy_load"
            self._state = state

        def run() -> None:
            ok, self.error = False, None
            try:
                if spark is not None:  # a new thread has no session of its own, and sources are registered by session
                    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
                job(path)
                ok = True
            except Exception as e:  # noqa: BLE001  whatever fails a job is kept for who asks
                self.error = e
            finally:
                with self._lock:
                    self._state = "idle"
                done(ok)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return "started"


class Batch:
    """Several operations as one plan: each sees the state the ones before it left; :meth:`end` publishes the last.

    There is no rollback within a batch, but nothing is seen by readers before it ends.
    """

    def __init__(self, table: CacheTable, root: str | None = None) -> None:
        self.table, self.root = table, root

    def store(self, writes, now: int, **options):
        out = self.table.store(writes, now, **options)
        self.table = self.table.stored(writes, now, **options)
        return out

    def load(self, requests, now: int, touch: bool = True):
        out = self.table.load(requests, now, touch)
        self.table = self.table.after_load(requests, now, touch)
        return out

    def delete(self, requests, now: int, allow=None):
        self.table, out = self.table.delete(requests, now, allow)
        return out

    def iterate(self, now: int, shard: int | None = None):
        return self.table.iterate(now, shard)

    def sweep(self, now: int):
        from keyloom.operators import maintenance

        out = maintenance.sweep_counts(self.table, now)
        self.table = maintenance.sweep(self.table, now)
        return out

    def sweep_poll(self, now: int):
        from keyloom.operators import maintenance

        return maintenance.sweep_poll(self.table, now)

    def clear(self, now: int):
        from keyloom.operators import maintenance

        out = maintenance.clear_events(self.table, now)
        self.table = maintenance.clear(self.table)
        return out

    def end(self) -> CacheTable:
        if self.root is not None:
            self.table = publish(self.table, self.root)
        return self.table


def publish(table: CacheTable, root: str) -> CacheTable:
    """Write a state as a new version below ``root`` and point to it; readers see the old one or the new one, whole."""
    version = uuid.uuid4().hex
    table.state.write.parquet(f"{root}/{version}")
    files.put(f"{root}/{POINTER}", version.encode())
    return current(table.state.sparkSession, root, table.config)


def current(spark: SparkSession, root: str, config: CacheConfig | None = None) -> CacheTable:
    """The state last published below ``root``."""
    version = files.read_range(f"{root}/{POINTER}", 0).decode()
    return CacheTable(spark.read.schema(ENTRY).parquet(f"{root}/{version}"), config or CacheConfig())
