"""The folder that driver and executors share, and tables written there.

``spark.checkpoint.dir`` of the session names it. Only a session on one
machine (master ``local``) may go without: it gets a fresh temporary folder. A
cluster without the setting is an error, since executors don't see each
other's local folders.

What a session writes there lies in one folder of its own, which goes when the
driver's process ends in order, or earlier by ``clear``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

_own: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's folder below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-riskgrid-")
        if not _own:
            atexit.register(_clear_all)
        _own[app] = spark, f"{base.rstrip('/')}/riskgrid-{uuid.uuid4().hex}"
    return _own[app][1]


def clear(spark: SparkSession) -> None:
    """Remove all tables this session wrote for itself; DataFrames that still read them can't be used after it."""
    _, path = _own.pop(spark.sparkContext.applicationId, (spark, ""))
    if path:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear_all() -> None:
    for spark, path in _own.values():
        with contextlib.suppress(Exception):  # the session may have ended before
            _remove(spark, path)
    _own.clear()


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a path and read back: computed once, with no lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *calls: Callable[[], Any]) -> list[Any]:
    """What the calls return, made at the same time: for small tables that don't read each other, whose jobs leave the cluster idle one by one."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


#: Rows that a task sorts or gathers at most on average, where ``dealt`` decides.
TASK_ROWS = 100_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by keys over as many tasks as its rows (counted if not given) ask for, so that what a task holds doesn't grow with the table."""
    n = df.count() if rows is None else rows
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), *keys)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file, whole, unless there is one. Returns whether this call did.

    The text goes to a file of another name, which is then renamed without
    replacing anything: a writer that is lost on the way leaves nothing under
    the path, and of several writers one wins. Where a store can't rename so,
    its file context raises.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    fs = where.getFileSystem(conf)
    if fs.exists(where):
        return False
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
    never = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(own), fs.makeQualified(where), never)
    except Exception:
        fs.delete(own, False)
        if fs.exists(where):
            return False
        raise
    return True
