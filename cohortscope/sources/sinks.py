"""Sinks: partitioned outputs, stage overwrites, CSV dimensions, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.session import stage

ROW_GROUP_BYTES = 128 * 1024 * 1024


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  compression: str = "snappy") -> None:
    """Compressed Parquet with column statistics, replacing what is there."""
    w = (df.write.mode("overwrite").option("compression", compression)
         .option("parquet.block.size", ROW_GROUP_BYTES))
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def overwrite_stage(df: DataFrame, base: str, version: str) -> str:
    """Write a new version of a stage next to the old one and return its path.

    A job cannot overwrite the files it reads; readers switch to the new path.
    """
    path = f"{base.rstrip('/')}/{version}"
    write_parquet(df, path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON-lines file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def with_metadata(df: DataFrame) -> DataFrame:
    """Default-fill the metadata columns every output must carry."""
    out = {c: F.lit(0) if c == "fraud_label" else F.lit(V.UNKNOWN)
           for c in ("fraud_label", "tax_year", "state", "taxpayer_type")
           if c not in df.columns}
    return df.withColumns(out) if out else df


def write_outputs(df: DataFrame, base: str) -> dict[str, str]:
    """by_year, by_state and by_state_by_year; absent combinations simply have no folder.

    States outside the known ones are written under ``other``.  Rows are range-partitioned
    on (state, year) once and staged; every layout is written from that table without
    another exchange: a few large files per folder, and a large state or year still spreads
    over many tasks.
    """
    df = with_metadata(df)
    name = E.normalise_label("state")
    known = name.isin([s.lower().replace(" ", "_") for s in V.STATES])
    safe = df.withColumn("state_safe", F.when(known, name).otherwise(F.lit("other")))
    order = ["state_safe", "tax_year", *(["person_id"] if "person_id" in df.columns else [])]
    safe = stage(safe.repartitionByRange(*order), "outputs")
    layout = {"by_year": (safe.drop("state_safe"), ["tax_year"]),
              "by_state": (safe, ["state_safe"]),
              "by_state_by_year": (safe, ["state_safe", "tax_year"])}
    paths = {}
    for name, (d, cols) in layout.items():
        paths[name] = f"{base.rstrip('/')}/{name}"
        write_parquet(d, paths[name], cols)
    return paths


def output_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and label rate per output partition."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.avg("fraud_label").alias("fraud_rate"))
