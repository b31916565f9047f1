"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.session import staging_root

#: ASCII white space: everything else is part of a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as the struct ``row``: apart from names that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder, read it back, and let go of its shuffle files.

    Shuffle files live until the driver's garbage is collected, which on a driver with
    little to do may be never; a job of several phases asks for it between them.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    del df
    for _ in range(2):          # frames here, then what they held there; Spark cleans up after
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables.  Only for tables whose every reader is written itself: what
    those wrote does not need them again, whichever executor is lost."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:             # another C library frees as it sees fit
        return None


def keep_memory() -> None:
    """For a task that goes through large arrays: what one batch frees the next one uses,
    instead of fresh pages from the system each time."""
    if libc := _libc():
        libc.mallopt(-3, 1 << 29)       # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 30)       # M_TRIM_THRESHOLD


def give_back_memory() -> None:
    """At the end of a task: Spark keeps Python workers, and with them what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.mallopt(-3, 1 << 25)       # about what the defaults grow to
        libc.mallopt(-1, 1 << 26)
        libc.malloc_trim(0)
