"""Shared helpers: scratch tables in the cluster's shared folder, null-safe text."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests in local mode) a folder of our own is made;
    off local mode the warehouse, which is shared too, is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + os.path.realpath(_LOCAL[app])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/keyloom/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and
    what a retried task sees is the same for every attempt.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Delete this application's scratch files, when results that read them have been written."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(_own(spark))
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: Numbers that one array of ``each`` holds at most.
RUN = 10_000


def each(df: DataFrame, count: str, name: str, most: int | None = None) -> DataFrame:
    """Every row ``count`` times, numbered from 0 in ``name``, in arrays of bounded size.

    ``most``: the largest count, where it is known; then a row of very many is dealt over the cluster before it is expanded.
    """
    part = fresh(df, "_part")
    first = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {RUN}"))))
    if most is not None and most > RUN:
        first = first.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return first.withColumn(name, F.explode(F.sequence(F.col(part) * RUN, F.least(F.col(part) * RUN + (RUN - 1), F.col(count) - 1)))).drop(part)


def lean() -> None:
    """In a Python worker: Arrow's memory comes from the system's allocator, and what is free goes back to the system.

    Workers serve task after task beside a large heap, and would keep what their largest task took.
    """
    import ctypes
    import gc

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_of(col: str | Column = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name
