"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: list[str] = []
_TIDY: list[bool] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all tasks run in this process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _OWN_ROOT[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later jobs read files that survive the loss of an executor, and an
    expensive or non-repeatable step (Python, range partitioning) runs once.
    """
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the folder, for those who drop it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Keep Arrow batches of texts small: a worker holds a batch, and so does the JVM beside it.

    Only Spark's own default (64 MiB) is lowered; a size that the session sets otherwise stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, size)


def return_freed_memory() -> None:
    """Let this worker give large freed buffers back to the system at once (once in each process).

    A worker is used again by later stages; without this it keeps the most it ever held.
    """
    if _TIDY:
        return
    _TIDY.append(True)
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, which is then fixed
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def trim() -> None:
    """Give what this worker has freed in small pieces back to the system."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy_driver(spark: SparkSession) -> None:
    """Let the driver's JVM give back what finished jobs have left: heap, their shuffles and broadcasts, and freed native memory.

    A driver runs hundreds of jobs for a query and collects its garbage only when its heap is full; until
    then the heap stays as large as it may be, shuffle files stay on disk, and what compiling freed stays with malloc.
    """
    jvm = spark._jvm
    jvm.System.gc()
    try:  # not every JVM has this command; through the interface, since the server's own class isn't open
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = bean, "systemTrimNativeHeap"
        call.invoke(server, values)
    except Py4JError:
        pass


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` through the file system that holds it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
