"""Helpers that the corpus operators share: shared storage, word access, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


_HELD: dict = {}


def hold(key, make: Callable):
    """What ``make`` gives, kept in the worker process from task to task until another operator's task starts there."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give up what earlier tasks of other operators have left in this worker process, and hand free memory back to the machine.

    Spark keeps Python workers, so without this a job of several operators has all their caches in memory at once.
    """
    if _HELD:
        _HELD.clear()
        gc.collect()
    give_free()


def give_free() -> None:
    """Hand this process' free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def trimmed(f: Callable) -> Callable:
    """``f`` on Arrow tables, with its memory handed back to the machine when it returns, so that idle worker processes are small."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out

    return one if f.__code__.co_argcount == 1 else two


def _in_one_process(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``. Where the setting is absent and all runs in this process (a local master) a
    temporary folder of this machine takes its place; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if path is None:
        if not _in_one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(context, "_quillspar_dir", None)
        if path is None:
            path = context._quillspar_dir = tempfile.mkdtemp(prefix="quillspar-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    hand_back(df.sparkSession)
    return out


#: Seconds between two collections of the driver's garbage, at least.
PAUSE = 5.0


def hand_back(spark: SparkSession) -> None:
    """Let the driver give its free memory back to the machine, and collect its garbage if that wasn't done a moment ago. Where all runs in this process that is left to time.

    Loops of many small jobs leave plans, task records and compiled code behind. Without this the heap grows to its limit before it is
    collected, and what native code has freed stays with the process besides.
    """
    context = spark.sparkContext
    if _in_one_process(spark):
        return
    if time.monotonic() - getattr(context, "_quillspar_collected", -PAUSE) >= PAUSE:
        context._jvm.System.gc()
        release()
        context._quillspar_collected = time.monotonic()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Hand back what the driver's JVM has freed of its native memory; whether it could."""
    jvm, make = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        find = jvm.java.lang.Class.forName
        kinds, values = make(jvm.java.lang.Class, 4), make(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = find(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, values)
    except Py4JError:  # a JVM or a machine without this command
        return False
    return True


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from a compressed table written in the shared folder (at ``path`` if given), so that they are made once."""
    path = path or new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder that is not taken."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of the shared folder and is read no more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver find the shuffles that no plan refers to any more: their files go from the executors' disks once it does.

    What has just ended is referred to by objects that the first collection frees, so there are two. Where all runs in this process that is left to time.
    """
    if _in_one_process(spark):
        return
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    trim(spark)


def empty_executors(spark: SparkSession) -> None:
    """Let the executors collect their garbage, so that their heaps shrink to what is in use. Where all runs in this process that is left to time.

    A heap that has grown to its limit stays there, and what Python workers take comes on top. There is a task for each core, so that idle
    executors have one at least; what the first collection frees is handed back by the second.
    """
    if _in_one_process(spark):
        return
    cores = spark.sparkContext.defaultParallelism
    for _ in range(2):
        spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: Rows of a side of a join, of some 20 bytes each, that are broadcast at most.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """The rows as the broadcast side of a join if there are BROADCAST_ROWS at most, else as they are, to be joined by a shuffle. They are counted, so they should be made already."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words (maximal runs of bytes other than space and 0x09-0x0D) in blocks of about ``size`` bytes of text.

    bytes.split() without an argument breaks at exactly these six bytes.
    """
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns under fixed names; other columns, whatever their names, are left out."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
