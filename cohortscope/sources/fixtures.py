"""Views that map the driver tables onto panels, links, sources and parameters.

Amounts are summed as whole numbers (cents times hundredths) and divided once, so
the panel is bit-identical however rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E

C = F.col
REGION_STATE = {0: "California", 1: "Florida", 2: "Texas", 3: "New York", 4: "Illinois"}
SEGMENT_TYPE = {"AUTOMOBILE": "pure_w2", "BUILDING": "business_owner",
                "FURNITURE": "w2_with_side_biz", "HOUSEHOLD": "retired"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation key -> region key (fixed-size reference tables)."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")


WAGE, BUSINESS, GIG, RENT = range(1, 5)


def _kind() -> Column:
    """What a line pays for, as one number instead of two texts: lines move by order."""
    ret, stat = C("l_returnflag"), C("l_linestatus")
    return (F.when(ret == "N", WAGE).when((ret == "R") & (stat == "O"), BUSINESS)
            .when((ret == "A") & (stat == "F"), GIG).when((ret == "A") & (stat == "O"), RENT))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, amounts as whole numbers."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        (F.year("o_orderdate") + 24).alias("tax_year"))
    lines = table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber",
        _kind().alias("kind"), F.floor(C("l_extendedprice") * 100 + 0.5).alias("p"),
        F.floor(C("l_discount") * 100 + 0.5).alias("d"),
        F.floor(C("l_tax") * 100 + 0.5).alias("t"),
        F.floor(C("l_quantity") + 0.5).alias("q"))
    return orders.join(lines, "o_orderkey")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (person, year) with the raw columns the library reads."""
    s = sales(spark, sf_dir)
    p, d, t, q, n = C("p"), C("d"), C("t"), C("q"), F.count(F.lit(1))
    line = C("l_linenumber")

    def amount(x, scale, cond=None, times=1):
        """The factor follows the sum, so that equal sums are kept and moved once."""
        whole = F.sum(x if cond is None else F.when(cond, x)) * times
        return whole.cast("double") / float(scale)

    wage, biz, gig, rent = (C("kind") == k for k in (WAGE, BUSINESS, GIG, RENT))
    g = s.groupBy("o_custkey", "tax_year").agg(
        F.min("l_suppkey").alias("employer"),
        amount(p, 1e4, wage, 25).alias("w2_wages"),
        amount(p, 1e4, biz, 25).alias("gross_receipts"),
        amount(p * d, 1e4, biz, 2).alias("cogs"),
        amount(p * 25 - p * d * 2, 1e4, biz).alias("net_se_income"),
        amount(p, 1e4, gig, 8).alias("gig_income"),
        amount(p, 1e4, gig, 2).alias("gig_expenses"),
        amount(p, 1e4, gig, 6).alias("gig_net"),
        amount(p, 1e4, rent, 10).alias("rental_gross"),
        amount(p * (t - 3), 1e4, rent).alias("rental_net"),
        F.count(F.when(rent, 1)).alias("n_rental_units"),
        amount(p * t * 5, 1e5, q > 40).alias("dividends"),
        amount(p * (d - 2) * 5, 1e5, q < 10).alias("capital_gains_lt"),
        amount(p * t, 1e5, q.between(20, 25)).alias("interest_income"),
        amount(p * d, 1e6, line == 1, 25).alias("sch_c_advertising"),
        amount(p * d, 1e6, line == 2, 25).alias("sch_c_car_truck"),
        amount(q * 100, 1, line == 3).alias("sch_c_meals"),
        amount(p * d, 1e6, line == 4, 25).alias("sch_c_home_office"),
        amount(p * d, 1e6, line == 5, 25).alias("sch_c_wages"),
        amount(p * t, 1e6, line == 6, 25).alias("sch_c_depreciation"),
        amount(p, 1e4, line == 7, 3).alias("crypto_proceeds"),
        amount(p * d, 1e4, line == 7).alias("crypto_cost_basis"),
        amount(p, 1e4, line == 1).alias("foreign_income"),
        amount(p, 1e4, line == 2, 4).alias("social_security_income"),
        amount(p * d, 1e5, times=5).alias("ded"),
        amount(p * d, 1e5, times=3).alias("itemized_mortgage_int"),
        amount(p * t, 1e6, times=25).alias("tax"),
        amount(p * d, 1e6, wage, 45).alias("federal_withheld"),
        amount(p * d, 1e6, wage, 50).alias("federal_withheld_total"),
        amount(q, 1, times=10).alias("total_credits"),
        amount(q, 1, times=7).alias("utility_cost_estimated"),
        amount(p, 1e4, times=5).alias("hidden"),
        F.sum("q").cast("double").alias("sq"), F.sum("d").alias("sd"), F.sum("t").alias("st"),
        n.alias("cnt"), F.max("o_totalprice").alias("top"),
        F.max(E.flag(C("o_orderstatus") == "F")).alias("any_f"))
    cust = table(spark, sf_dir, "customer").select(
        C("c_custkey").alias("o_custkey"), "c_mktsegment", C("c_nationkey").alias("n_nationkey"))
    g = g.join(cust.join(places(spark, sf_dir), "n_nationkey"), "o_custkey")
    k, avg_q = C("o_custkey"), C("sq") / C("cnt")
    streams = E.total(V.INCOME_SOURCES)
    g = g.withColumns({
        "agi": F.when(k % 37 != 0, F.greatest(F.lit(0.0), streams)),
        "total_tax_liability": F.when(k % 29 == 0, 0.0).otherwise(C("tax")),
        "deduction_taken": C("ded") + 12000.0,
        "fraud_label": E.flag((C("any_f") == 1) & (C("sd") * 10 > C("cnt") * 52)),
    })
    kind = E.lookup(k % 17, dict(enumerate(V.SCENARIOS)))
    g = g.withColumn("fraud_type", F.when(C("fraud_label") == 1, kind).otherwise("none"))
    return g.select(
        k.cast("string").alias("person_id"), "tax_year",
        (C("n_regionkey") + 1).alias("zone"),
        E.lookup("n_regionkey", REGION_STATE).alias("state"),
        E.lookup("c_mktsegment", SEGMENT_TYPE, "pure_se").alias("taxpayer_type"),
        F.when(k % 19 != 0, C("employer").cast("string")).alias("employer_id"),
        F.when(k % 23 != 0, (18 + k % 60 + C("tax_year") - 2019).cast("int")).alias("age"),
        E.lookup(k % 5, dict(enumerate(V.FILING_STATUSES))).alias("filing_status"),
        (2019 + k % 7).cast("string").alias("entry_cohort"),
        E.flag(C("tax_year") == 2019 + k % 7).alias("first_year_filing"),
        "w2_wages", "gross_receipts", "cogs", "net_se_income", "gig_income", "gig_expenses",
        "gig_net", "rental_gross", "rental_net", "n_rental_units", "dividends",
        "capital_gains_lt", "interest_income", *V.SCHEDULE_C,
        "crypto_proceeds", "crypto_cost_basis", "foreign_income", "social_security_income",
        "itemized_mortgage_int", "deduction_taken", "agi",
        (C("agi") - C("deduction_taken")).alias("taxable_income"),
        "total_tax_liability",
        (C("total_tax_liability") + C("total_credits")).alias("tax_before_credits"),
        "total_credits",
        F.when((k % 31 != 0) & C("agi").isNotNull(), F.least(
            C("total_tax_liability") / (C("agi") + 1e-9), F.lit(1.2))).alias("effective_tax_rate"),
        "federal_withheld", "federal_withheld_total", "utility_cost_estimated",
        F.least(F.lit(100.0), C("sd").cast("double") * 10 / C("cnt")).alias("irs_risk_score"),
        (C("top") / (avg_q * avg_q * avg_q)).alias("bank_deposit_ratio"),
        (avg_q / 25).alias("lifestyle_income_ratio"),
        (C("st").cast("double") * 0.3 / C("cnt")).alias("utility_income_ratio"),
        E.flag(C("gross_receipts").isNotNull()).alias("has_schedule_c"),
        E.flag(C("gig_income").isNotNull()).alias("has_gig"),
        E.flag(k % 2 == 0).alias("has_rental"), E.flag(k % 3 == 0).alias("has_crypto"),
        E.flag(k % 7 == 0).alias("has_foreign_account"),
        E.flag(C("deduction_taken") > 30000).alias("uses_itemized"),
        "fraud_label", "fraud_type",
        F.coalesce(E.lookup("fraud_type", V.SCENARIO_CATEGORY), F.lit("none"))
        .alias("fraud_category"),
        C("hidden").alias("evasion_amount"),
        (C("hidden") / (C("hidden") + F.greatest(streams, F.lit(0.0)) + 1))
        .alias("evasion_rate"))


def persons(base: DataFrame) -> DataFrame:
    """Person dimension with a validity interval, from the panel."""
    g = base.groupBy("person_id").agg(
        F.min("tax_year").alias("entry_year"), F.max("tax_year").alias("last_year"),
        F.min("zone").alias("zone"), F.min("taxpayer_type").alias("taxpayer_type"),
        F.min("filing_status").alias("filing_status"), F.max("fraud_label").alias("ever"))
    k = C("person_id").cast("long")
    # personas with fixed points in the risk rule; the last two carry none
    persona = E.lookup(k % 5, dict(enumerate(
        ["chronic_evader", "escalating", "opportunistic", "late_onset", "one_time"])))
    return g.select(
        "person_id", "zone", "taxpayer_type", "filing_status", "entry_year",
        F.when(k % 4 == 0, V.OPEN_ENDED).otherwise(C("last_year")).alias("exit_year"),
        (18 + k % 60).cast("int").alias("age_at_entry"),
        F.when(C("ever") == 0, "clean").otherwise(persona).alias("fraud_persona"),
        E.flag(k % 7 == 0).alias("has_foreign_account"),
        E.flag(k % 3 == 0).alias("is_crypto_user"),
        E.lookup(k % 17, dict(enumerate(V.SCENARIOS))).alias("primary_fraud_type"))


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    k = C("s_suppkey")
    opened = (2019 + k % 5).cast("int")
    kinds = dict(enumerate(["sole_prop", "ccorp", "llc_single", "scorp"]))
    return s.join(places(spark, sf_dir), "n_nationkey").select(
        k.cast("string").alias("business_id"), (C("n_regionkey") + 1).alias("zone"),
        opened.alias("open_year"),
        F.when(k % 3 != 0, V.OPEN_ENDED).otherwise((opened + k % 4).cast("int"))
        .alias("exit_year"),
        E.lookup(k % 9, dict(enumerate(V.INDUSTRIES + ["unlisted"]))).alias("industry"),
        E.lookup(k % 4, kinds).alias("entity_type"), (k % 50).cast("int")
        .alias("n_employees_base"), "s_acctbal")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (person, business) edges with validity and a base salary."""
    g = sales(spark, sf_dir).groupBy("o_custkey", "l_suppkey").agg(
        F.min("tax_year").alias("start"), F.max("tax_year").alias("last"),
        (F.sum("p").cast("double") / F.count(F.lit(1)) / 100).alias("base_salary"))
    occupations = dict(enumerate(list(V.OCCUPATION_GROWTH) + ["other"]))
    return g.select(
        C("o_custkey").cast("string").alias("person_id"),
        C("l_suppkey").cast("string").alias("business_id"), C("start").alias("link_start"),
        F.when(C("last") == 2025, V.OPEN_ENDED).otherwise(C("last")).alias("link_end"),
        "base_salary", E.lookup(C("l_suppkey") % 10, occupations).alias("occupation"))


def sources(base: DataFrame) -> dict[str, DataFrame]:
    """Six tagged sources with different columns and some repeated rows.

    ``real`` lacks nothing and holds repeated rows; the generated ones lack columns,
    and one has no year.
    """
    k = C("person_id").cast("long")
    base = base.drop("state")
    part = {tag: base.filter(k % 6 == i) for i, tag in enumerate(V.SOURCE_PREFIX)}
    part["real"] = part["real"].unionByName(part["real"].filter(k % 4 == 0))
    part["ctab_w2"] = part["ctab_w2"].drop("crypto_proceeds", "crypto_cost_basis", "gig_income")
    part["ctab_se"] = part["ctab_se"].withColumn(
        "tax_year", F.when(C("tax_year") != 2022, C("tax_year")))
    part["ctab_itemizers"] = part["ctab_itemizers"].drop("evasion_amount", "evasion_rate")
    part["timegan_evader"] = part["timegan_evader"].drop("employer_id", "filing_status")
    return part


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (user, slot 1..7): average value and count per slot."""
    e = table(spark, sf_dir, "events")
    slot = (F.dayofmonth("ts") - 1) % 7
    return (e.groupBy(C("user_id").cast("string").alias("person_id"),
                      (slot + 2019).alias("tax_year"))
            .agg((F.sum(F.floor(C("value") * 100 + 0.5)).cast("double")
                  / F.count(F.lit(1)) / 100).alias("value"),
                 F.count(F.lit(1)).cast("double").alias("hits")))
