"""Tables that later jobs read cheaply: observed writes, bucketed tables, id lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

C = F.col


# --------------------------------------------------------------- observed writes
def summary_metrics(year: str = "tax_year", years: list[int] | None = None,
                    label: str = "fraud_label", nullable: list[str] | None = None,
                    rules: dict[str, Column] | None = None) -> dict[str, Column]:
    """Aggregates for ``write_observed``: rows and label rate, rows per year and outside the
    years, NULLs per column, violations per rule."""
    out = {"rows": F.count(F.lit(1)), "positives": F.count(F.when(C(label) == 1, 1))}
    for y in years or []:
        out[f"rows_{y}"] = F.count(F.when(C(year) == y, 1))
    if years:
        out["rows_other"] = F.count(F.when(~F.coalesce(C(year).isin(years), F.lit(False)), 1))
    out.update({f"nulls_{c}": F.count(F.when(C(c).isNull(), 1)) for c in nullable or []})
    out.update({f"broken_{n}": F.count(F.when(x, 1)) for n, x in (rules or {}).items()})
    return out


def write_observed(df: DataFrame, path: str, partition_by: list[str],
                   metrics: dict[str, Column]) -> dict[str, int]:
    """Write partitions and return what the writing job saw of its rows: no second scan.

    Partitions that ``df`` has replace those of the same value; others keep their files.
    """
    seen = Observation()
    (df.observe(seen, *[x.alias(n) for n, x in metrics.items()]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
    return seen.get


def metric_rows(spark: SparkSession, load: str, seen: dict[str, int]) -> DataFrame:
    """One row per metric: (load, item, value)."""
    return spark.createDataFrame([(load, n, int(v)) for n, v in seen.items()],
                                 "load string, item string, value bigint")


# --------------------------------------------------------------- bucketed tables
def co_bucketed(spark: SparkSession) -> None:
    """Let joins on more keys than the bucketed one use the buckets as they lie."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int,
                   order: list[str] | None = None) -> DataFrame:
    """A table in ``path`` in buckets of ``key``, one sorted file each, read back by name.

    Joins and aggregates on ``key`` of tables with equally many buckets need no exchange.  A
    bucket is read by one task: for keys that own few rows each, such as persons.
    """
    (df.repartition(buckets, key).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key, *(order or [])).saveAsTable(name))
    return df.sparkSession.table(name)


# -------------------------------------------------------------------- id lookups
def write_lookup(df: DataFrame, path: str, ids: list[str], distinct_ids: int = 1_000_000,
                 row_group_bytes: int = 16 * 1024 * 1024) -> None:
    """Files sorted by the first id, with Parquet bloom filters on all ids, in row groups
    small enough that skipping one saves something."""
    w = df.repartitionByRange(ids[0]).sortWithinPartitions(ids[0]).write.mode("overwrite")
    w = w.option("parquet.block.size", row_group_bytes)
    for c in ids:
        w = (w.option(f"parquet.bloom.filter.enabled#{c}", "true")
             .option(f"parquet.bloom.filter.expected.ndv#{c}", distinct_ids))
    w.parquet(path)


def lookup(spark: SparkSession, path: str, id_col: str, ids: list) -> DataFrame:
    """Rows of the given ids, a list the caller holds.  Equalities, not ranges, reach the
    scan: row groups whose statistics or bloom filter exclude every id are not read."""
    cond = F.lit(False)
    for at in range(0, len(ids), 10):           # longer lists would be pushed as one range
        cond = cond | C(id_col).isin(ids[at:at + 10])
    return spark.read.parquet(path).filter(cond)
