"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder; a temporary one only where none is set and driver and workers are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="nightloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def released() -> None:
    """Give memory that Python no longer needs back to the system: workers and the driver live on, and hold what they once took."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def trimmed(spark: SparkSession) -> None:
    """Give back what the driver's JVM took outside its heap, to compile and to send: `jcmd <pid> System.trim_native_heap`, where the JVM has it."""
    from py4j.protocol import Py4JError

    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    lang, java = jvm.java.lang, jvm.java.lang.Class.forName
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds, values = new(lang.Class, 4), new(lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = java(kind)
        values[0], values[1], values[2], values[3] = name, "systemTrimNativeHeap", new(lang.Object, 0), new(lang.String, 0)
        java("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # another JVM, or another C library: nothing to give back
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written to a new shared folder and read back: later steps neither compute it again nor lose it with an executor."""
    path = staging_dir(df.sparkSession, name)
    df.write.parquet(path)
    released()
    trimmed(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
