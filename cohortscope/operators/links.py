"""Temporal links between persons and businesses, wage and survival paths.

Validity intervals are expanded to calendar years (at most seven per link), so every
interval join is an equality join that Spark can hash, sort or broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E

C = F.col
LAST = V.YEARS[-1]


def until(end: Column, last: int = LAST) -> Column:
    """Last active year of an interval; open intervals run to the last panel year."""
    return F.least(F.when(end == V.OPEN_ENDED, last).otherwise(end), F.lit(last))


def active_years(df: DataFrame, start: str, end: str, year: str = "tax_year",
                 years: tuple[int, int] = (V.YEARS[0], LAST)) -> DataFrame:
    """One row per year of ``[start, end]`` inside ``years``; intervals that never meet these
    years vanish, ``outside_years`` counts them."""
    lo, hi = F.greatest(C(start), F.lit(years[0])), until(C(end), years[1])
    return (df.withColumns({"__lo": lo, "__hi": hi}).filter("__lo <= __hi")
            .withColumn(year, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi"))


def outside_years(df: DataFrame, start: str, end: str,
                  years: tuple[int, int] = (V.YEARS[0], LAST)) -> DataFrame:
    """One row: intervals, how many are cut by the years, and how many lie outside."""
    s, e = C(start), C(end)
    outside = F.coalesce((s > years[1]) | (e < years[0]) | (s > e), F.lit(True))
    cut = ~outside & ((s < years[0]) | ((e > years[1]) & (e != V.OPEN_ENDED)))
    return df.agg(F.count(F.lit(1)).alias("n_intervals"), F.count(F.when(cut, 1)).alias("n_cut"),
                  F.count(F.when(outside, 1)).alias("n_outside"))


def expand_active_years(persons: DataFrame) -> DataFrame:
    """Person x active year with current age and first-filing flag."""
    d = active_years(persons, "entry_year", "exit_year")
    return d.withColumns({
        "age": C("age_at_entry") + C("tax_year") - C("entry_year"),
        "first_year_filing": E.flag(C("tax_year") == C("entry_year"))})


def first_links(links: DataFrame, name: str) -> DataFrame:
    """Earliest active link per person-year (ties to the smaller id), combined map-side."""
    d = active_years(links, "link_start", "link_end")
    best = d.groupBy("person_id", "tax_year").agg(
        F.min(F.struct("link_start", "business_id")).alias("b"),
        F.count(F.lit(1)).alias(f"n_{name}"))
    return best.select("person_id", "tax_year", C("b.business_id").alias(name), f"n_{name}")


def attach_links(panel: DataFrame, ownership: DataFrame, employment: DataFrame,
                 businesses: DataFrame) -> DataFrame:
    """Primary owned business with its maturity factor, and first employer, per row."""
    keys = ["person_id", "tax_year"]
    d = panel.join(first_links(ownership, "owned_business"), keys, "left")
    d = d.join(first_links(employment, "first_employer"), keys, "left")
    b = businesses.select(C("business_id").alias("owned_business"),
                          C("industry").alias("owned_industry"), "open_year")
    d = d.join(b, "owned_business", "left")
    age = C("tax_year") - C("open_year")
    return d.withColumn("maturity", F.least(1.0 + age * 0.08, F.lit(1.6))).drop("open_year")


def persons_with_links(persons: DataFrame, links: DataFrame) -> DataFrame:
    """Each person's link count and span; persons without links stay."""
    n = links.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_links"),
                                       F.min("link_start").alias("first_start"),
                                       F.max(until(C("link_end"))).alias("last_end"))
    return persons.join(n, "person_id", "left").withColumn("n_links", E.nz("n_links", 0))


def link_overlap(pairs: DataFrame, persons: DataFrame, businesses: DataFrame,
                 offset: int = 0) -> DataFrame:
    """Common validity of assigned (person, business) pairs of one zone.

    Start is the later start, end the earlier end and open only if both are; pairs
    that never coexist are dropped.
    """
    p = persons.select("person_id", "zone", "entry_year", C("exit_year").alias("p_exit"))
    b = businesses.select("business_id", C("zone").alias("b_zone"), "open_year",
                          C("exit_year").alias("b_exit"))
    d = pairs.select("person_id", "business_id").join(p, "person_id").join(b, "business_id")
    d = d.filter(C("zone") == C("b_zone"))
    both = (C("p_exit") == V.OPEN_ENDED) & (C("b_exit") == V.OPEN_ENDED)

    def cap(c):
        return F.when(C(c) == V.OPEN_ENDED, LAST).otherwise(C(c))

    d = d.select("person_id", "business_id", "zone",
                 F.greatest(C("entry_year") + offset, C("open_year")).alias("ownership_start"),
                 F.when(both, V.OPEN_ENDED).otherwise(F.least(cap("p_exit"), cap("b_exit")))
                 .alias("ownership_end"))
    d = d.filter(C("ownership_start") <= cap("ownership_end"))
    return d.withColumn("is_active_owner", E.flag(
        (C("ownership_end") == V.OPEN_ENDED) | (C("ownership_end") >= 2024)))


def prior_year(df: DataFrame, col: str, name: str) -> DataFrame:
    """Value of the same person one year earlier (NULL where there is none)."""
    past = (df.groupBy("person_id", (C("tax_year") + 1).alias("tax_year"))
            .agg(F.max(col).alias(name)))
    return df.join(past, ["person_id", "tax_year"], "left")


# -------------------------------------------------------------------- wage paths
def wage_factor(occupation: Column, year: Column) -> Column:
    """Cumulative wage growth since 2019: inflation plus occupation trend, COVID dip.

    A product of at most six factors per row; no table, no join.
    """
    trend = E.lookup(occupation, V.OCCUPATION_GROWTH, V.DEFAULT_OCCUPATION_GROWTH)
    steps = []
    for y in V.YEARS[1:]:
        dip = V.COVID_SHOCK[y] * 0.08 if y == 2020 else 0.0
        grown = F.greatest(F.lit(1.0 + V.INFLATION[y] - dip) + trend, F.lit(0.0))
        steps.append(F.when(year >= y, grown).otherwise(1.0))
    return reduce(mul, steps)


def yearly_wages(employment: DataFrame) -> DataFrame:
    """Wages per person-year over all active jobs."""
    d = active_years(employment, "link_start", "link_end")
    pay = C("base_salary") * wage_factor(C("occupation"), C("tax_year"))
    return d.groupBy("person_id", "tax_year").agg(
        F.sum(pay).alias("w2_wages"), F.count(F.lit(1)).alias("n_jobs"))


def survival_curve(businesses: DataFrame) -> DataFrame:
    """Expected survival of each business to the end of every panel year since opening."""
    adj = (F.when(C("entity_type").isin("ccorp", "scorp"), 0.6)
           .when(C("entity_type") == "sole_prop", 1.3).otherwise(1.0))
    d = businesses.filter(C("open_year") <= LAST).withColumn(
        "tax_year", F.explode(F.sequence("open_year", F.lit(LAST))))
    steps = []
    for i, y in enumerate(V.YEARS):
        rate = E.lookup("industry", {k: v[i] for k, v in V.FAILURE_RATES.items()},
                        V.DEFAULT_FAILURE_RATE)
        inside = (C("open_year") <= y) & (C("tax_year") >= y)
        steps.append(F.when(inside, 1.0 - rate * adj).otherwise(1.0))
    return d.select("business_id", "tax_year", reduce(mul, steps).alias("survival"))


# -------------------------------------------------------------------- risk points
def rule_points(persons: DataFrame) -> DataFrame:
    """Additive base risk score in [1, 99]; ``noise`` is an optional input column."""
    t, p = C("taxpayer_type"), C("fraud_persona")
    points = (F.lit(15.0) + F.when(t.isin("business_owner", "multi_biz_owner"), 18).otherwise(0)
              + F.when(t == "pure_se", 12).otherwise(0)
              + F.when(p == "chronic_evader", 35).otherwise(0)
              + F.when(p.isin("escalating", "opportunistic"), 20).otherwise(0)
              + E.nz("has_foreign_account", 0) * 22 + E.nz("is_crypto_user", 0) * 8)
    if "noise" in persons.columns:
        points = points + E.nz("noise")
    return persons.withColumn("risk_score_base", E.cents(E.clip(points, 1, 99)))


def yearly_risk(df: DataFrame) -> DataFrame:
    """Year score: base plus evasion uplift (input) plus 15 x lifestyle ratio."""
    uplift = E.nz("evasion_uplift") if "evasion_uplift" in df.columns else F.lit(0.0)
    x = C("risk_score_base") + uplift + E.nz("lifestyle_income_ratio") * 15
    return df.withColumn("irs_risk_score_yearly", E.rounded(E.clip(x, 1, 99), 1))


# ----------------------------------------------------------------- compatibility
def type_violations(df: DataFrame) -> DataFrame:
    """Rows whose scenario or income streams their taxpayer type does not allow.

    The compatibility rules are constants inside the expression: no join, one pass.
    """
    pairs = []
    for t, kinds in V.ALLOWED_SCENARIOS.items():
        pairs += [F.lit(t), F.array(*[F.lit(k) for k in kinds])]
    allowed = F.create_map(*pairs)[C("taxpayer_type")]
    bad = (C("fraud_type") != "none") & ~F.coalesce(
        F.array_contains(allowed, C("fraud_type")), F.lit(False))
    streams = F.lit(False)
    for t, cols in V.FORBIDDEN_STREAMS.items():
        for c in cols:
            if c in df.columns:
                streams = streams | ((C("taxpayer_type") == t) & (E.nz(c) > 0))
    return (df.withColumns({"bad_scenario": E.flag(bad), "bad_stream": E.flag(streams)})
            .filter("bad_scenario = 1 or bad_stream = 1"))
