"""Distribution fits from data: wages, zone income, housing, industries, demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.quantiles import exact_quantiles, same_keys

C = F.col


def fit_wages(df: DataFrame, group: str, value: str) -> DataFrame:
    """Lognormal parameters per group from its percentiles, and its share of rows."""
    q = exact_quantiles(df, [group], [value], {"p10": 0.10, "p25": 0.25, "p50": 0.50,
                                               "p75": 0.75, "p90": 0.90})
    q = q.withColumnsRenamed({f"{value}_{p}": p for p in ("p10", "p25", "p50", "p75", "p90")})
    n = df.filter(C(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    d = same_keys(q, n, [group], "inner")
    one = F.lit(1.0)
    spread = F.when((C("p25") > 0) & (C("p75") > 0), (
        F.ln(F.greatest("p75", one)) - F.ln(F.greatest("p25", one))) / 1.35).otherwise(0.35)
    return d.withColumns({
        "log_mean": F.ln(F.greatest(F.when(C("p50") > 0, C("p50")).otherwise(50_000.0), one)),
        "log_std": F.greatest(spread, F.lit(0.15)),
        "emp_share": C("n") / F.lit(df.filter(C(value).isNotNull()).count())}).drop("n")


def fit_zone() -> dict[str, int]:
    """State -> fitting zone (not the output map)."""
    return {s: z for z, states in V.STATE_TO_FIT_ZONE.items() for s in states}


def _spine(spark: SparkSession) -> DataFrame:
    return spark.range(1, 6).select(C("id").cast("int").alias("zone"))


def fit_zone_income(states: DataFrame, national_log_mean: float) -> DataFrame:
    """Mean log income, spread and median per zone; multiplier against the nation.

    ``states``: one row per state with log_mean, log_std, p50.
    """
    z = (states.withColumn("zone", E.lookup("state", fit_zone()))
         .filter("zone is not null and log_mean is not null").groupBy("zone").agg(
             F.avg("log_mean").alias("log_mean"),
             F.avg(F.coalesce(C("log_std"), F.lit(0.35))).alias("log_std"),
             F.avg(F.coalesce(C("p50"), F.exp("log_mean"))).alias("p50"),
             F.count(F.lit(1)).alias("n_states")))
    d = _spine(states.sparkSession).join(z, "zone", "left")
    return d.withColumn("income_multiplier", F.coalesce(
        F.exp(C("log_mean") - F.lit(national_log_mean)),
        E.lookup("zone", V.FALLBACK_INCOME_MULTIPLIER)))


def state_log_income(df: DataFrame, value: str) -> DataFrame:
    """Per state: mean and spread of log values and the median."""
    pos = df.filter(C(value) > 0)
    g = pos.groupBy("state").agg(F.avg(F.ln(value)).alias("log_mean"),
                                 F.stddev_samp(F.ln(value)).alias("log_std"))
    q = exact_quantiles(pos, ["state"], [value], {"p50": 0.5}).withColumnRenamed(
        f"{value}_p50", "p50")
    return g.join(q, "state")


def fit_zone_housing(homes: DataFrame) -> DataFrame:
    """Median home value and rent per zone, with fallbacks where a zone is empty.

    ``homes``: state, home_value.
    """
    spark = homes.sparkSession
    hv = exact_quantiles(homes.withColumn("zone", E.lookup("state", fit_zone()))
                         .filter("zone is not null and home_value > 0"),
                         ["zone"], ["home_value"], {"median": 0.5})
    d = _spine(spark).join(hv, "zone", "left")
    fallback = E.lookup("zone", {k: float(v) for k, v in V.FALLBACK_HOME_VALUE.items()})
    d = d.select("zone", F.coalesce("home_value_median", fallback).alias("median_home_value"))
    rent = F.floor(C("median_home_value") * E.lookup("zone", V.RENTAL_YIELD) / 12)
    return d.withColumn("median_rent_2br", rent.cast("long"))


def fit_zone_growth(growth: DataFrame) -> DataFrame:
    """Median growth per zone and year, with fallbacks.  ``growth``: state, year, growth."""
    spark = growth.sparkSession
    g = exact_quantiles(growth.withColumn("zone", E.lookup("state", fit_zone()))
                        .filter("zone is not null and growth is not null"),
                        ["zone", "year"], ["growth"], {"median": 0.5})
    years = _spine(spark).withColumn("year", F.explode(F.array(*[F.lit(y) for y in V.YEARS])))
    default = F.create_map(*[x for z, gs in V.FALLBACK_HOME_GROWTH.items()
                             for x in (F.lit(z), F.array(*[F.lit(v) for v in gs]))])
    return years.join(g, ["zone", "year"], "left").select(
        "zone", "year", F.coalesce(F.bround("growth_median", 4), F.get(
            default[C("zone")], C("year") - V.YEARS[0])).alias("growth"))


RECEIPT_FIELDS = ["median_gross_receipts", "mean_gross_receipts", "avg_gross_receipts",
                  "gross_receipts", "avg_receipts"]
COGS_FIELDS = ["cogs_ratio", "cost_of_goods_ratio", "cogs_r"]
MARGIN_FIELDS = ["net_profit_margin", "profit_margin", "net_income_ratio", "net_margin"]


def fit_industry(codes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Industry defaults overridden by code-level figures.

    ``codes``: code, position and any of the accepted field names.  Several codes may
    map to one industry; the one with the highest ``position`` wins per field.
    ``defaults``: industry, receipts, cogs_ratio, margin.
    """
    have = set(codes.columns)

    def first(fields):
        found = [C(f).cast("double") for f in fields if f in have]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    d = codes.withColumn("industry", E.lookup("code", V.NAICS_TO_INDUSTRY)).filter(
        "industry is not null").withColumns({"__r": first(RECEIPT_FIELDS),
                                             "__c": first(COGS_FIELDS),
                                             "__m": first(MARGIN_FIELDS)})

    def latest(value, valid):
        return F.max(F.when(valid, F.struct("position", value)))[value]

    o = d.groupBy("industry").agg(
        latest("__r", C("__r") > 0).alias("__r"),
        latest("__c", (C("__c") > 0) & (C("__c") < 1)).alias("__c"),
        latest("__m", C("__m").isNotNull()).alias("__m"))
    return defaults.join(o, "industry", "left").select(
        "industry", F.coalesce("__r", "receipts").alias("median_gross_receipts"),
        F.coalesce("__c", "cogs_ratio").alias("cogs_ratio"),
        F.coalesce("__m", "margin").alias("net_profit_margin"))


def fit_education(shares: DataFrame) -> DataFrame:
    """Mean share per level over states (fallback where absent), normalised to 1.

    ``shares``: one row per state, one column per level.
    """
    have = set(shares.columns)
    one = shares.agg(*[F.round(F.avg(k), 4).alias(k) for k in V.EDUCATION_LEVELS if k in have])
    cells = ", ".join(f"'{k}', " + (f"coalesce(`{k}`, {V.EDUCATION_FALLBACK[k]}D)"
                                    if k in have else f"{V.EDUCATION_FALLBACK[k]}D")
                      for k in V.EDUCATION_LEVELS)
    long = one.select(F.expr(f"stack({len(V.EDUCATION_LEVELS)}, {cells}) as (level, raw)"))
    return long.select("level", (C("raw") / F.sum("raw").over(Window.partitionBy(F.lit(0))))
                       .alias("share"))


def fit_filing_status(marital: DataFrame) -> DataFrame:
    """Filing-status shares as a linear mix of mean marital shares, normalised."""
    m = marital.agg(*[F.avg(E.nz(c)).alias(c) for c in
                      ("married", "widowed", "never_married", "divorced", "separated")])
    mix = {
        "single": C("never_married") + C("divorced") * 0.6,
        "married_joint": C("married") * 0.92,
        "married_separate": C("married") * 0.08 + C("separated"),
        "head_of_household": C("divorced") * 0.4 + C("never_married") * 0.15,
        "qualifying_widow": C("widowed"),
    }
    one = m.select(*[x.alias(k) for k, x in mix.items()])
    cells = ", ".join(f"'{k}', `{k}`" for k in mix)
    long = one.select(F.expr(f"stack({len(mix)}, {cells}) as (filing_status, raw)"))
    return long.select("filing_status", (
        C("raw") / F.sum("raw").over(Window.partitionBy(F.lit(0)))).alias("share"))


def age_distribution(by_state: DataFrame) -> DataFrame:
    return by_state.agg(F.coalesce(F.avg("mean"), F.lit(42.1)).alias("mean"),
                        F.coalesce(F.avg("std"), F.lit(13.8)).alias("std"))
