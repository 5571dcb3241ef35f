"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def without_ws(c: Column) -> Column:
    return F.translate(c, WS, "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a fresh one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
        path = f"file://{path}"
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it again.

    Lost executors don't matter to what has been written.  Column types and nulls survive.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftmesh-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Clears the driver's heap of what finished plans have left, once two fifths of it are in use: else it grows to its bound over many plans of many tasks."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 5 * (heap.totalMemory() - heap.freeMemory()) > 2 * heap.maxMemory():
        gc.collect()
        jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing will read again, and lets Spark drop old shuffle files."""
    jvm = tables[0].sparkSession.sparkContext._jvm
    conf = tables[0].sparkSession.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()  # Spark removes the shuffle files of plans that are out of use when the driver collects garbage


def small_batches(spark: SparkSession, rows: int = 4000, size: int = 16 << 20) -> None:
    """Tells the session to hand Python workers at most so many rows, and about so many bytes, at once: texts are long.  Lower settings stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        value = int(re.sub(r"\D", "", now)) << {"k": 10, "m": 20, "g": 30}.get(now.strip("b")[-1:], 0)
        if not 0 < value <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers are reused, and what one operator freed the next doesn't need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hints a broadcast only for a counted side of at most ``most`` rows; a larger one joins by shuffle."""
    return F.broadcast(df) if rows <= most else df
