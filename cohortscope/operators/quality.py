"""Data-quality rules as aggregates: one pass of conditional counts per table.

Every checker returns rows (group..., rule, value, severity, passed).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators import profile
from cohortscope.operators.evaluate import roc_auc
from cohortscope.operators.quantiles import exact_quantiles

C = F.col


@dataclass(frozen=True)
class Rule:
    """A measured value, how bad a failure is, and when the value is acceptable."""

    name: str
    value: Column
    ok: Callable[[Column], Column]
    severity: str = "error"


def none(v: Column) -> Column:
    return v == 0


def within(lo: float, hi: float) -> Callable[[Column], Column]:
    return lambda v: v.between(lo, hi)


def below(limit: float) -> Callable[[Column], Column]:
    return lambda v: v < limit


def at_most(limit: float) -> Callable[[Column], Column]:
    return lambda v: v <= limit


def above(limit: float) -> Callable[[Column], Column]:
    return lambda v: v > limit


def violations(cond: Column) -> Column:
    """Rows for which a condition is true (NULL counts as no violation)."""
    return F.sum(E.flag(cond))


def nulls(c: str) -> Column:
    return F.sum(E.flag(C(c).isNull()))


def share(cond: Column, among: Column) -> Column:
    """Share of rows meeting ``cond`` among rows meeting ``among``."""
    return F.coalesce(F.try_divide(F.sum(E.flag(cond & among)).cast("double"),
                                   F.sum(E.flag(among))), F.lit(0.0))


def run_rules(df: DataFrame, rules: list[Rule], by: list[str] | None = None) -> DataFrame:
    """Evaluate all rules in one aggregate and turn the columns into rows."""
    by = by or []
    one = df.groupBy(*by).agg(*[r.value.cast("double").alias(f"v{i}")
                                for i, r in enumerate(rules)])
    one = one.withColumns({f"p{i}": E.flag(r.ok(C(f"v{i}"))) for i, r in enumerate(rules)})
    cells = ", ".join(f"'{r.name}', v{i}, '{r.severity}', p{i}" for i, r in enumerate(rules))
    return one.select(*by, F.expr(
        f"stack({len(rules)}, {cells}) as (rule, value, severity, passed)"))


def summary(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Failed errors and warnings per group, and the overall verdict."""
    bad = C("passed") == 0
    return report.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rules"),
        F.sum(E.flag(bad & (C("severity") == "error"))).alias("errors"),
        F.sum(E.flag(bad & (C("severity") == "warning"))).alias("warnings")).withColumn(
        "passed", E.flag(C("errors") == 0))


def required_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per required column: is it there?  Decided on the schema, no data read."""
    have = set(df.columns)
    listed = F.array(*[F.struct(F.lit(f"has_{c}").alias("rule"),
                                F.lit(1.0 if c in have else 0.0).alias("value"),
                                F.lit("error").alias("severity"),
                                F.lit(1 if c in have else 0).alias("passed")) for c in cols])
    return df.sparkSession.range(1).select(F.inline(listed))


def _null_rules(df: DataFrame, cols: list[str]) -> list[Rule]:
    return [Rule(f"null_{c}", nulls(c), none) for c in cols if c in df.columns]


def _w2() -> Column:
    return C("taxpayer_type").isin(V.W2_TYPES)


def _contradiction() -> Column:
    return (C("fraud_label") == 1) & (C("fraud_type") == "none")


def _taxable_above_agi() -> Column:
    return C("taxable_income") > C("agi")


def _cogs_above_receipts() -> Column:
    return C("cogs") > C("gross_receipts")


# ---------------------------------------------------------------- panel outputs
def check_zone_year(df: DataFrame) -> DataFrame:
    """Rules on every (zone, year) of a generated panel."""
    by = ["zone", "tax_year"]
    rules = [
        Rule("rows", F.count(F.lit(1)), above(0)),
        Rule("fraud_rate", F.avg("fraud_label"), within(0.10, 0.35)),
        Rule("label_type_contradiction", violations(_contradiction()), none, "warning"),
        Rule("w2_zero_wages", violations(_w2() & (C("w2_wages") == 0)), none),
        Rule("negative_agi", violations(C("agi") < 0), none),
        Rule("taxable_above_agi", violations(_taxable_above_agi()), none),
        Rule("cogs_above_receipts", violations(_cogs_above_receipts()), at_most(5), "warning"),
    ]
    if "evasion_rate" in df.columns:
        rules.append(Rule("max_evasion_rate", F.coalesce(F.max("evasion_rate"), F.lit(0.0)),
                          at_most(2.0), "warning"))
    rules += _null_rules(df, V.MUST_NOT_BE_NULL)
    rules = [r for r in rules if r.name not in ("null_zone", "null_tax_year")]
    out = run_rules(df, rules, by)
    med = exact_quantiles(df, by, ["agi"], {"median": 0.5}).select(
        *by, F.lit("agi_median").alias("rule"), C("agi_median").alias("value"),
        F.lit("error").alias("severity"), E.flag(C("agi_median") >= 5000).alias("passed"))
    return out.unionByName(med)


def check_panel_years(df: DataFrame) -> DataFrame:
    """Rules on every year file, with the score-leakage guard and yearly drift."""
    by = ["tax_year"]
    not_se = ~C("taxpayer_type").isin(V.SE_INCOME_TYPES)
    rules = _null_rules(df, ["person_id", "zone", "fraud_label", "agi", "total_tax_liability",
                             "irs_risk_score"]) + [
        Rule("negative_agi", violations(C("agi") < 0), none),
        Rule("taxable_above_agi", violations(C("taxable_income") > C("agi") + 1), none),
        Rule("negative_tax", violations(C("total_tax_liability") < 0), none),
        Rule("rate_out_of_range", violations(~C("effective_tax_rate").between(0, 0.37)), none),
        Rule("score_out_of_range", violations(~C("irs_risk_score").between(1, 99)), none),
        Rule("fraud_rate", F.avg("fraud_label"), lambda v: (v > 0.05) & (v < 0.50)),
        Rule("receipts_of_non_se", violations(not_se & C("gross_receipts").isNotNull()), none),
    ]
    auc = roc_auc(df, "irs_risk_score", by).select(
        *by, F.lit("score_auc").alias("rule"), C("auc").alias("value"),
        F.lit("error").alias("severity"), E.flag(C("auc") < 0.80).alias("passed"))
    drift = profile.rate_drift(df).select(
        F.lit(None).cast("int").alias("tax_year"), F.lit("rate_drift").alias("rule"),
        C("drift").alias("value"), F.lit("warning").alias("severity"),
        E.flag(C("drift") < 0.15).alias("passed"))
    return run_rules(df, rules, by).unionByName(auc).unionByName(drift)


# ---------------------------------------------------------------- splits and seeds
def inspect_splits(tagged: DataFrame, tag: str = "split") -> DataFrame:
    """Rules on every split or seed table (rows tagged with their table)."""
    pos = C("fraud_label") == 1
    rules = [
        Rule("fraud_rate", F.avg("fraud_label"), within(0.18, 0.24)),
        Rule("label_type_contradiction", violations(_contradiction()), none),
        Rule("zero_wage_share", share(E.nz("w2_wages") == 0, _w2()), below(0.05)),
        Rule("taxable_above_agi", violations(_taxable_above_agi()), none),
        Rule("cogs_above_receipts", violations(_cogs_above_receipts()), none, "warning"),
    ]
    if "evasion_amount" in tagged.columns:
        rules.append(Rule("zero_evasion_share", share(E.nz("evasion_amount") == 0, pos),
                          below(0.05)))
    if "evasion_rate" in tagged.columns:
        rules += [Rule("mean_evasion_rate", F.avg("evasion_rate"), below(1.0)),
                  Rule("max_evasion_rate", F.max("evasion_rate"), at_most(1.0))]
    return run_rules(tagged, rules + _null_rules(tagged, V.MUST_NOT_BE_NULL), [tag])


def check_splits(tagged: DataFrame, targets: dict[str, float], tag: str = "split") -> DataFrame:
    """Rate near target per split; validation and test hold their single year."""
    g = tagged.groupBy(tag).agg(F.avg("fraud_label").alias("rate"),
                                F.min("tax_year").alias("lo"), F.max("tax_year").alias("hi"))
    goal = E.lookup(tag, targets or {"": None})
    year = E.lookup(tag, {"val": V.VALIDATION_YEAR, "test": V.TEST_YEAR})
    rate = g.filter(goal.isNotNull()).select(
        tag, F.lit("rate_near_target").alias("rule"), C("rate").alias("value"),
        F.lit("error").alias("severity"),
        E.flag(F.abs(C("rate") - goal) <= V.RATE_TOLERANCE + 0.01).alias("passed"))
    single = g.filter(year.isNotNull()).select(
        tag, F.lit("single_year").alias("rule"), C("hi").cast("double").alias("value"),
        F.lit("error").alias("severity"),
        E.flag((C("lo") == year) & (C("hi") == year)).alias("passed"))
    pure = E.lookup(tag, {"seed_compliant": 0.0, "seed_evaders": 1.0})
    purity = g.filter(pure.isNotNull()).select(
        tag, F.lit("seed_purity").alias("rule"), C("rate").alias("value"),
        F.lit("error").alias("severity"), E.flag(C("rate") == pure).alias("passed"))
    return rate.unionByName(single).unionByName(purity)


def split_log(tagged: DataFrame, tag: str = "split") -> DataFrame:
    """Shares of type, zone and fraud type, and yearly rates, per split (long form)."""
    parts = []
    for dim, d in (("taxpayer_type", tagged), ("zone", tagged),
                   ("fraud_type", tagged.filter("fraud_label = 1"))):
        v = profile.value_counts(d, dim, [tag])
        parts.append(v.select(tag, F.lit(dim).alias("dim"), C(dim).cast("string").alias("value"),
                              C("n").alias("n_rows"), C("share").alias("amount")))
    y = profile.rate_table(tagged, [tag, "tax_year"])
    parts.append(y.select(tag, F.lit("tax_year").alias("dim"), C("tax_year").cast("string")
                          .alias("value"), "n_rows", C("rate").alias("amount")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------- merged table
def merge_report(df: DataFrame) -> DataFrame:
    """Merge report in long form: totals, rates, rows per dimension, sanity counts."""
    label = E.nz("fraud_label", 0)
    cells = df.groupBy("data_source", "tax_year", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("s"),
        F.sum(E.flag(C("agi") < 0)).alias("neg"),
        F.sum(E.flag((label == 0) & C("fraud_type").isNotNull()
                     & (C("fraud_type") != "none"))).alias("bad"))
    long = cells.select("n", "s", "neg", "bad", F.expr(
        "stack(4, 'all', 'all', 'source', data_source, 'year', cast(tax_year as string), "
        "'zone', cast(zone as string)) as (dim, key)"))
    g = long.groupBy("dim", "key").agg(*[F.sum(c).alias(c) for c in ("n", "s", "neg", "bad")])
    rows = g.select("dim", "key", F.expr(
        "stack(4, 'rows', cast(n as double), 'fraud_rate', s / n, 'negative_agi', "
        "cast(neg as double), 'label_0_typed', cast(bad as double)) as (item, value)"))
    rows = rows.filter("dim = 'all' or item in ('rows', 'fraud_rate')")
    dup = profile.duplicate_keys(df, ["person_id", "tax_year"]).select(
        F.lit("all").alias("dim"), F.lit("all").alias("key"),
        F.lit("duplicate_person_years").alias("item"),
        C("duplicate_rows").cast("double").alias("value"))
    high = profile.high_null_columns(df).select(
        F.lit("column").alias("dim"), C("column").alias("key"),
        F.lit("null_pct").alias("item"), C("null_pct").alias("value"))
    return rows.unionByName(dup).unionByName(high)


def check_merged(df: DataFrame) -> DataFrame:
    """Bounds, label consistency, id disjointness between sources, leakage guard."""
    rules = [
        Rule("rows", F.count(F.lit(1)), above(0)),
        Rule("negative_agi", violations(C("agi") < 0), none),
        Rule("taxable_above_agi", violations(C("taxable_income") > C("agi") + 1), none),
        Rule("rate_out_of_range", violations(~C("effective_tax_rate").between(0, 0.37)), none),
        Rule("score_out_of_range", violations(~C("irs_risk_score").between(1, 99)), none),
        Rule("label_0_typed", violations((C("fraud_label") == 0) & (C("fraud_type") != "none")),
             none),
    ]
    per_id = df.groupBy("person_id").agg(
        F.max(E.flag(C("data_source") == "real")).alias("real"),
        F.max(E.flag(C("data_source") != "real")).alias("made"))
    ids = run_rules(per_id, [
        Rule("id_collisions", violations((C("real") == 1) & (C("made") == 1)), none)])
    auc = roc_auc(df, "irs_risk_score").select(
        F.lit("score_auc").alias("rule"), C("auc").alias("value"),
        F.lit("error").alias("severity"), E.flag(C("auc") < 0.80).alias("passed"))
    return run_rules(df, rules).unionByName(ids).unionByName(auc)


def check_generated(df: DataFrame, target: float, by: list[str] | None = None) -> DataFrame:
    """Model-made rows: rate, non-negatives, label consistency, years per person."""
    by = by or []
    rules = [
        Rule("rows", F.count(F.lit(1)), above(0)),
        Rule("fraud_rate", F.avg("fraud_label"),
             lambda v: F.abs(v - target) <= V.RATE_TOLERANCE + 0.02),
        Rule("rate_out_of_range", violations(~C("effective_tax_rate").between(0, 0.37)), none),
        Rule("label_0_typed", violations((C("fraud_label") == 0) & (C("fraud_type") != "none")),
             none),
    ] + [Rule(f"negative_{c}", violations(C(c) < 0), none)
         for c in ("agi", "w2_wages", "gross_receipts") if c in df.columns]
    years = df.groupBy(*by, "person_id").agg(F.size(F.collect_set("tax_year")).alias("years"))
    years = years.withColumn("__all", F.lit(1))
    med = exact_quantiles(years, by or ["__all"], ["years"], {"median": 0.5}).select(
        *by, F.lit("median_years").alias("rule"), C("years_median").alias("value"),
        F.lit("error").alias("severity"), E.flag(C("years_median") >= 3).alias("passed"))
    return run_rules(df, rules, by).unionByName(med)


# ------------------------------------------------------------------------ samples
def validate_sample(original: DataFrame, sample: DataFrame, target_rows: int,
                    rate_tolerance: float = 0.005) -> DataFrame:
    """Per state: size, rate, whole histories, year gaps, type drift, yearly shares."""
    key = ["state", "person_id"]

    def spans(d, name):
        return d.groupBy(*key).agg(F.collect_set("tax_year").alias("y")).select(
            *key, F.size("y").alias(name),
            (F.array_max("y") - F.array_min("y") + 1).alias(f"{name}_span"))

    s, o = spans(sample, "kept"), spans(original, "had").select(*key, "had")
    persons = s.join(o, key, "left").groupBy("state").agg(
        violations(C("kept") != C("had")).cast("double").alias("partial"),
        violations(C("kept_span") != C("kept")).cast("double").alias("gaps"))
    goal = E.lookup("state", V.STATE_TARGET_RATE)
    size = sample.groupBy("state").agg(
        (F.count(F.lit(1)) / target_rows - 1).alias("row_drift"),
        F.avg("fraud_label").alias("rate")).withColumn("rate_gap", F.abs(C("rate") - goal))
    a = profile.value_counts(original, "taxpayer_type", ["state"]).select(
        "state", "taxpayer_type", C("share").alias("a"))
    b = profile.value_counts(sample, "taxpayer_type", ["state"]).select(
        "state", "taxpayer_type", C("share").alias("b"))
    drift = a.join(b, ["state", "taxpayer_type"], "left").groupBy("state").agg(
        F.max(F.abs(C("a") - E.nz("b"))).alias("type_drift"))
    d = size.join(persons, "state").join(drift, "state")
    out = d.select("state", F.expr(
        "stack(5, 'row_drift', row_drift, 'rate_gap', rate_gap, 'partial_histories', partial, "
        "'year_gaps', gaps, 'type_drift', type_drift) as (rule, value)"))
    ok = (F.when(C("rule") == "row_drift", C("value").between(-0.02, 0.05))
          .when(C("rule") == "rate_gap", C("value") < rate_tolerance)
          .when(C("rule") == "type_drift", C("value") < 0.03).otherwise(C("value") == 0))
    out = out.withColumns({"severity": F.lit("error"), "passed": E.flag(ok)})
    per_year = profile.value_counts(sample, "tax_year", ["state"]).select(
        "state", F.concat(F.lit("share_"), C("tax_year")).alias("rule"),
        C("share").alias("value"), F.lit("info").alias("severity"), F.lit(1).alias("passed"))
    return out.unionByName(per_year)


def year_gaps(df: DataFrame) -> DataFrame:
    """Persons whose years are not consecutive."""
    d = df.groupBy("person_id").agg(F.collect_set("tax_year").alias("y"))
    return d.filter(F.array_max("y") - F.array_min("y") + 1 != F.size("y")).select("person_id")


def partial_histories(original: DataFrame, sample: DataFrame) -> DataFrame:
    """Sampled persons with another number of years than in the original."""
    def n(d, name):
        return d.groupBy("person_id").agg(F.size(F.collect_set("tax_year")).alias(name))

    return (n(sample, "kept").join(n(original, "had"), "person_id", "left")
            .filter(~C("kept").eqNullSafe(C("had"))))


# ---------------------------------------------------------------------- dimensions
def check_persons(df: DataFrame) -> DataFrame:
    dup = df.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    rules = [
        Rule("age_out_of_range", violations(~C("age_at_entry").between(18, 80)), none),
        Rule("null_taxpayer_type", nulls("taxpayer_type"), none),
        Rule("null_fraud_persona", nulls("fraud_persona"), none),
        Rule("score_out_of_range", violations(~C("risk_score_base").between(1, 99)), none),
        Rule("bad_zone", violations(~C("zone").isin(1, 2, 3, 4, 5)), none),
        Rule("clean_share", F.avg(E.flag(C("fraud_persona") == "clean")),
             lambda v: (v > 0.75) & (v < 0.92)),
        Rule("score_persona_correlation", F.corr(C("risk_score_base").cast("double"), E.flag(
            C("fraud_persona") != "clean").cast("double")), below(0.25)),
    ]
    return run_rules(df, rules).unionByName(run_rules(
        dup, [Rule("duplicate_ids", violations(C("n") > 1), none)]))


def check_businesses(df: DataFrame) -> DataFrame:
    dup = df.groupBy("business_id").agg(F.count(F.lit(1)).alias("n"))
    rules = [
        Rule("bad_zone", violations(~C("zone").isin(1, 2, 3, 4, 5)), none),
        Rule("null_industry", nulls("industry"), none),
        Rule("null_entity_type", nulls("entity_type"), none),
        Rule("negative_employees", violations(C("n_employees_base") < 0), none),
        Rule("exit_set_share", F.avg(E.flag(C("exit_year").isNotNull())), above(0.30), "warning"),
    ]
    return run_rules(df, rules).unionByName(run_rules(
        dup, [Rule("duplicate_ids", violations(C("n") > 1), none)]))


def check_links(df: DataFrame) -> DataFrame:
    rules = [
        Rule("null_person", nulls("person_id"), none),
        Rule("null_business", nulls("business_id"), none),
        Rule("start_after_end", violations(
            C("link_start") > F.coalesce(C("link_end"), F.lit(2025))), none),
        Rule("base_salary_not_positive", violations(C("base_salary") <= 0), none),
    ]
    return run_rules(df, rules)


def missing_tables(expected: dict[str, bool], found: set[str], like: DataFrame) -> DataFrame:
    """Expected tables (name -> required) that were not found."""
    rows = [F.struct(F.lit(n).alias("table"), F.lit(
        "MISSING_REQUIRED" if req else "MISSING_OPTIONAL").alias("status"))
        for n, req in expected.items() if n not in found]
    one = like.sparkSession.range(1)
    if not rows:
        return one.select(F.lit("").alias("table"), F.lit("").alias("status")).limit(0)
    return one.select(F.inline(F.array(*rows)))
