"""A person's value of the year before, for year files that arrive as a stream.

Rows meet the rows of the year before in a stream-stream left join whose state the JVM
keeps.  A year is an event time, and a watermark says when no row of a year can come any
more: rows without a year before are then returned with NULL, and state older than that is
dropped.  One year's rows of all persons are held at most, plus those of ``late`` years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def year_start(year: Column) -> Column:
    return F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).cast(
        "timestamp")


def prior_year_arrivals(rows: DataFrame, again: DataFrame, col: str, name: str,
                        late: int = 0) -> DataFrame:
    """``rows`` with ``name``: ``col`` of the same person one year earlier.

    ``rows`` and ``again`` are two readers of the same stream, with person_id (one row per
    person and year) and tax_year; rows come at most ``late`` years after a later year's.  A
    year is complete once a later one has come: ``closing_row`` makes one that closes the
    last, and rows without a person are not returned.
    """
    delay = f"{366 * late} days"
    now = rows.withColumn("at", year_start(C("tax_year"))).withWatermark("at", delay)
    past = again.select(C("person_id").alias("of_person"), C(col).alias(name),
                        year_start(C("tax_year") + 1).alias("of_at")).withWatermark("of_at", delay)
    met = (C("person_id") == C("of_person")) & (C("at") == C("of_at"))
    return now.join(past, met, "left").drop("of_person", "of_at", "at").filter(
        "person_id IS NOT NULL")


def closing_row(rows: DataFrame, year: int) -> DataFrame:
    """One row of no person in ``year``: to be written behind the last file of a replay."""
    spark = rows.sparkSession
    return spark.range(1).select(*[
        (F.lit(year) if f.name == "tax_year" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in rows.schema.fields])
