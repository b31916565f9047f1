"""Readers: pruned Parquet, explicit-schema CSV, JSON parameter files, year discovery."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope.functions import exprs as E


def read_panel(spark: SparkSession, base: str, years: list[int] | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """A panel split by ``tax_year``; years prune folders, columns prune the scan."""
    df = E.nan_as_null(spark.read.parquet(base))
    if years is not None:
        df = df.filter(F.col("tax_year").isin([int(y) for y in years]))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def available_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from file footers; no rows are read."""
    return spark.read.parquet(path).columns


def _open(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_years(spark: SparkSession, pattern: str, years: list[int],
               required: bool = False) -> tuple[DataFrame | None, list[int]]:
    """Union of the year tables that exist, by column name, and the missing years.

    ``pattern`` holds ``{year}``.  A missing year is skipped, or an error if required.
    """
    found = {y: _open(spark, pattern.format(year=y)) for y in years}
    missing = [y for y in years if found[y] is None]
    if required and missing:
        raise FileNotFoundError(f"missing years: {missing}")
    out = None
    for y, part in found.items():
        if part is None:
            continue
        if "tax_year" not in part.columns:
            part = part.withColumn("tax_year", F.lit(y))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, missing


PERSONS = ("person_id string, zone int, entry_year int, exit_year int, age_at_entry int, "
           "sex string, education string, filing_status string, primary_occupation string, "
           "taxpayer_type string, fraud_persona string, primary_fraud_type string, "
           "has_foreign_account int, is_crypto_user int, has_rental_property int, "
           "risk_score_base double, one_time_target_year int")
BUSINESSES = ("business_id string, zone int, open_year int, exit_year int, entity_type string, "
              "industry string, n_employees_base int, business_fraud_type string, "
              "has_pos_system int, accepts_cash int")
OWNERSHIP = ("person_id string, business_id string, ownership_pct double, role string, "
             "ownership_start int, ownership_end int, is_active_owner int")
EMPLOYMENT = ("person_id string, business_id string, employment_start int, employment_end int, "
              "base_salary_2019 double, occupation string, is_part_time int, "
              "job_title_level string")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parameters(spark: SparkSession, path: str, key: str,
                    fields: str = "map<string,string>") -> DataFrame:
    """A JSON object of objects as rows: the outer key and its fields.

    ``fields`` is the type of the inner object; keys starting with ``_`` are comments.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string,{fields}>")
    out = text.select(F.explode(parsed).alias(key, "v"))
    out = out.filter(~F.col(key).startswith("_") & F.col("v").isNotNull())
    return out.select(key, "v.*") if fields.startswith("struct") else out


# ------------------------------------------------------ parameters of mixed nesting
def read_variant(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A JSON object, one per file, whose values are nested in different ways: the outer key
    and its value as VARIANT.  Keys starting with ``_`` are comments; files may differ."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    out = doc.select(F.explode(F.col("doc").cast("map<string,variant>")).alias(key, "value"))
    return out.filter(~F.col(key).startswith("_"))


def variant_fields(values: DataFrame, fields: dict[str, tuple[str, str]],
                   value: str = "value") -> DataFrame:
    """Typed fields of VARIANT values: ``fields`` names, per column, a path and a type.  What
    is missing or of another type is NULL; ``variant_problems`` says which."""
    rest = [c for c in values.columns if c != value]
    return values.select(*rest, *[F.try_variant_get(value, path, kind).alias(n)
                                  for n, (path, kind) in fields.items()])


def variant_problems(values: DataFrame, fields: dict[str, tuple[str, str]],
                     value: str = "value") -> DataFrame:
    """One row per wanted field that is ``missing``, ``null`` or of the ``wrong type``."""
    rest = [c for c in values.columns if c != value]

    def problem(path, kind):
        raw = F.try_variant_get(value, path, "variant")
        return (F.when(raw.isNull(), "missing").when(F.is_variant_null(raw), "null")
                .when(F.try_variant_get(value, path, kind).isNull(), "wrong type"))

    found = F.array(*[F.struct(F.lit(n).alias("field"), problem(path, kind).alias("problem"))
                      for n, (path, kind) in fields.items()])
    return values.select(*rest, F.explode(found).alias("x")).select(*rest, "x.*").filter(
        "problem IS NOT NULL")
