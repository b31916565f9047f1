"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortscope", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tuned for.

    AQE sizes shuffles, converts joins and splits skew.  ``codegen.maxFields`` stays at
    its default: fusing a whole stage over about 250 columns passes the 64 KB method
    limit, while wide rows still run compiled projections, operator by operator.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # unique-key joins build small hash tables per partition instead of sorting wide rows
        LOCAL_MAPS: "64MB",
        # methods above 8000 bytes are never JIT-compiled; fall back to split projections
        HUGE_METHOD: "8000",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
LOCAL_MAPS = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def split_huge_methods(spark: SparkSession) -> None:
    """Where the session leaves Spark's default, stages above 8000 bytes of code, which are
    never JIT-compiled, run as split projections, as in :func:`build_session`."""
    if spark.conf.get(HUGE_METHOD) == "65535":
        spark.conf.set(HUGE_METHOD, "8000")


@contextmanager
def hashed_partitions(spark: SparkSession) -> Iterator[None]:
    """Where the session leaves Spark's default (never), joins that run in here build hash tables
    of shuffled partitions that are small enough for it, as in :func:`build_session`, instead
    of sorting both sides; larger ones are sorted."""
    before = spark.conf.get(LOCAL_MAPS)
    if before in ("0", "0b"):
        spark.conf.set(LOCAL_MAPS, "64MB")
    try:
        yield
    finally:
        spark.conf.set(LOCAL_MAPS, before)


def name_folder(spark: SparkSession, folder: str) -> None:
    """Use ``folder`` for staged tables where the session names none."""
    if not _named(spark):
        spark.sparkContext.setCheckpointDir(folder)


def _named(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def staging_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    There is no fallback: a machine-local folder would lose its files with the machine.
    """
    shared = _named(spark)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return shared.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of replaying the job) and
    gives the optimizer a real size, so a small table is broadcast by the ordinary
    size threshold and a large one is not.
    """
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # The written schema is known: reading it back needs no footer inference job.
    return df.sparkSession.read.schema(df.schema).parquet(path)
