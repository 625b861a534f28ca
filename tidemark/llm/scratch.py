"""Intermediate tables in the folder that driver and executors share.

Every table is written as Parquet and read again, which cuts lineage: an
executor that is lost later costs a re-read and not a re-run of the job that
made the table.  The folder is the one that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: While a step runs: its shuffles go once its result stands, and Python workers get batches of bounded size, so that long
#: texts don't gather beside an executor's heap.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Seconds between two collections of the driver's finished objects.
APART = 3.0


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("executors on other machines need a folder that all of them share: set spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def small_batches(spark: SparkSession) -> None:
    """For a job that owns its session: small batches for Python workers in all that follows, also in results that are written later."""
    for k, v in WRITING.items():
        if ".arrow." in k:
            spark.conf.set(k, v)


@contextmanager
def running(spark: SparkSession) -> Iterator[None]:
    """Run a step with the settings of ``WRITING``, and put the session's own ones back."""
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def trim(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed outside its heap to the system, as ``jcmd`` does with System.trim_native_heap.

    The C library keeps what each of the JVM's many threads frees, and every compiled plan adds to it.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    # The server's own class is not open to callers, its interface is.
    types, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = kind(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # other JVMs have no such command
        pass


class Scratch:
    """Names, writes, rereads and removes the tables of one operator call."""

    _released = 0.0

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
        """Write ``df`` and read it back with the schema that was written; ``options`` go to the writer."""
        self.release()
        path = self.path(name)
        writer = df.write.mode("overwrite").option("compression", "zstd").options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with running(self.spark):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps, and the driver return memory that it has freed.

        Spark does so when the driver's objects for them are collected, which a
        driver with a large heap may put off until the disks are full.
        """
        if time.monotonic() - Scratch._released < APART:
            return
        Scratch._released = time.monotonic()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        trim(self.spark)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
