"""Tax-return arithmetic over fact columns; statutory tables are constants per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.blocks import optional

C = F.col


def _by_year(values: dict) -> Column:
    """Year -> value map as one literal."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def bracket_tops(year: Column) -> Column:
    pairs = []
    for y, tops in V.BRACKET_TOPS.items():
        pairs += [F.lit(y), F.array(*[F.lit(float(t)) for t in tops])]
    default = F.array(*[F.lit(float(t)) for t in V.BRACKET_TOPS[V.DEFAULT_BRACKET_YEAR]])
    return F.coalesce(F.create_map(*pairs)[year], default)


def liability(income: Column, year: Column, status: Column) -> Column:
    """Progressive liability by year and filing status."""
    return E.bracket_tax(income, bracket_tops(year), status)


def standard_deduction(year: Column, status: Column) -> Column:
    single = _by_year({y: float(s) for y, (s, _) in V.STANDARD_DEDUCTION.items()})[year]
    head = _by_year({y: float(h) for y, (_, h) in V.STANDARD_DEDUCTION.items()})[year]
    amount = (F.when(status.isin(V.DOUBLED_STATUSES), single * 2)
              .when(status == "head_of_household", head)
              .when(status.isin("single", "married_separate"), single))
    return F.coalesce(amount, F.lit(float(V.DEFAULT_STANDARD_DEDUCTION)))


def wage_base(year: Column) -> Column:
    return F.coalesce(_by_year({y: float(b) for y, b in V.WAGE_BASE.items()})[year],
                      F.lit(float(V.DEFAULT_WAGE_BASE)))


PLAIN_INCOME = ["w2_wages", "net_se_income", "rental_net", "gig_net", "dividends",
                "capital_gains_lt", "capital_gains_st", "interest_income", "crypto_net_gain",
                "foreign_income", "pension_income", "ira_distributions", "unemployment_comp",
                "k1_income"]


def compute_return(facts: DataFrame) -> DataFrame:
    """Deductions, AGI, tax, credits, withholding and balance of every return row."""
    def o(c):
        return optional(facts, c)

    year, status, kind = C("tax_year"), C("filing_status"), C("taxpayer_type")
    plain = sum((o(c) for c in PLAIN_INCOME), F.lit(0.0))
    w2, se, base = o("w2_wages"), o("net_se_income"), wage_base(year)
    n_dep = F.coalesce(C("n_dep"), F.lit(0)) if "n_dep" in facts.columns else F.lit(0)
    d = facts.withColumns({
        "total_pre": E.cents(plain + o("social_security_income")),
        "standard_deduction": standard_deduction(year, status),
        "__se_tax": F.when(se > 400, F.least(se, base) * 0.153).otherwise(0.0)})
    medical = E.floor0(o("itemized_medical") - C("total_pre") * 0.075)
    d = d.withColumn("itemized_total", o("itemized_mortgage_int")
                     + F.least(o("itemized_salt"), F.lit(10_000.0)) + o("itemized_charitable")
                     + medical + o("fictitious_deduction"))
    d = d.withColumns({
        "uses_itemized": E.flag(C("itemized_total") > C("standard_deduction")),
        "deduction_taken": E.cents(F.greatest("itemized_total", "standard_deduction")),
        "se_tax_amount": E.cents("__se_tax"),
        "se_tax_deduction": E.cents(C("__se_tax") / 2)})
    d = d.withColumn("agi", E.cents(E.floor0(
        plain + o("social_security_income") * 0.85 - C("se_tax_deduction"))))
    qbi = F.least(E.floor0(se + o("k1_income")) * 0.20, C("agi") * 0.20)
    d = d.withColumn("qbi_deduction", F.when(kind.isin(V.QBI_TYPES), E.cents(qbi)).otherwise(0.0))
    d = d.withColumn("taxable_income", E.cents(E.floor0(
        C("agi") - C("deduction_taken") - C("qbi_deduction"))))
    d = d.withColumn("tax_before_credits", liability(C("taxable_income"), year, status))
    cap = E.lookup(F.least(n_dep, F.lit(3)), {k: float(v) for k, v in V.EITC_MAX.items()}, 0.0)
    eligible = ((C("agi") > 0) & (C("agi") < 57_000) & (w2 + se + o("gig_net") > 0)
                & ~kind.isin("retired", "investor", "business_owner"))
    d = d.withColumn("eitc_credit", F.when(eligible, F.least(cap, C("tax_before_credits")))
                     .otherwise(0.0))
    d = d.withColumn("child_tax_credit", F.least(
        n_dep * 2000.0, E.floor0(C("tax_before_credits") - C("eitc_credit"))))
    d = d.withColumn("total_credits", E.cents(C("eitc_credit") + C("child_tax_credit")))
    d = d.withColumn("total_tax_liability", E.cents(E.floor0(
        C("tax_before_credits") - C("total_credits"))))
    d = d.withColumns({
        "effective_tax_rate": E.rounded(
            C("total_tax_liability") / F.greatest(C("agi"), F.lit(1.0)), 4),
        "fica_withheld": E.cents(F.least(w2, base) * 0.062),
        "medicare_withheld": E.cents(w2 * 0.0145), "federal_withheld": E.cents(w2 * 0.18)})
    return d.withColumns({
        "refund_amount": E.cents(E.floor0(C("federal_withheld") - C("total_tax_liability"))),
        "balance_due": E.cents(E.floor0(C("total_tax_liability") - C("federal_withheld"))),
    }).drop("__se_tax")


def detection_signals(returns: DataFrame) -> DataFrame:
    """Lifestyle, deposit and deduction ratios; rate against the zone's base rate."""
    agi1 = F.greatest(C("agi"), F.lit(1.0))
    return returns.withColumns({
        "lifestyle_income_ratio": E.rounded(optional(returns, "utility_cost_estimated")
                                          / F.greatest(C("agi") * 0.12, F.lit(1.0)), 4),
        "bank_deposit_ratio": E.rounded((C("agi") + optional(returns, "evasion_amount")) / agi1, 4),
        "deduction_income_ratio": E.rounded(C("deduction_taken") / agi1, 4),
        "effective_rate_vs_zone": E.rounded(
            C("effective_tax_rate") - E.lookup("zone", V.ZONE_BASE_RATE), 4)})
