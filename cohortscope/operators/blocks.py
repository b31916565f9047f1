"""Phase 2: behavioural, tax, deduction, income, consistency, ratio and time features.

Every block is one projection over the clean panel; blocks compose by
``DataFrame.transform`` and stay narrow (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.preprocess import present

C = F.col


def optional(df: DataFrame, c: str, fill: float = 0.0) -> Column:
    """A column with NULLs filled, or the fill itself where the column is absent."""
    return E.nz(c, fill) if c in df.columns else F.lit(fill)


def lifestyle(df: DataFrame) -> DataFrame:
    agi, lir, bdr = C("agi"), E.nz("lifestyle_income_ratio"), E.nz("bank_deposit_ratio")
    bdr_log = (E.nz("bank_deposit_ratio_log") if "bank_deposit_ratio_log" in df.columns
               else E.log1p0("bank_deposit_ratio"))
    df = df.withColumns({
        "absolute_lifestyle_gap": E.clip(lir * agi - agi, -1e6, 5e6),
        "bank_deposit_gap": E.clip(bdr * agi - agi, -1e6, 25e6),
        "absolute_lifestyle_spend": E.clip(lir * agi, 0, 1e7),
        "lifestyle_deposit_combined": E.clip(lir + bdr_log, 0, 30),
        "income_band": E.income_band(agi),
    })
    df = df.withColumns({
        "bank_deposit_gap_ratio": E.clip(E.safe_ratio(C("bank_deposit_gap"), agi), -5, 500),
        "unexplained_cash_proxy": E.clip(C("bank_deposit_gap") - E.nz("deduction_taken"),
                                         -1e6, 25e6),
    })
    return df.withColumn("bank_deposit_gap_ratio_log", E.log1p0("bank_deposit_gap_ratio"))


def tax_burden(df: DataFrame) -> DataFrame:
    agi, etr, expected = C("agi"), E.nz("effective_tax_rate"), C("expected_tax_rate")
    if "withholding_rate" in df.columns:
        low = 1.0 - E.clip(E.nz("withholding_rate"), 0, 1)
    elif "federal_withheld" in df.columns:
        low = 1.0 - E.clip(E.log1p0("federal_withheld") / 12.0, 0, 1)
    else:
        low = F.lit(0.5)
    odd = (agi > 100_000) & (etr < 0.08)
    if "deduction_taken" in df.columns:
        odd = odd & (E.nz("deduction_taken") < agi * 0.20)
    computed = E.clip(E.safe_ratio(E.nz("total_tax_liability"), agi), 0, 1)
    df = df.withColumns({
        "tax_rate_gap": E.clip(expected - etr, -0.5, 0.5),
        "bracket_rate_ratio": E.clip(etr / (expected + F.lit(V.EPS)), 0, 2),
        "effective_rate_consistency_error": E.clip(F.abs(etr - computed), 0, 1),
        "low_withholding_indicator": low,
        "progressive_anomaly": E.flag(odd),
    })
    return df.withColumns({
        "tax_rate_gap_ratio": E.clip(E.safe_ratio(C("tax_rate_gap"), expected), -2, 2),
        "underpayment_proxy": E.clip(C("tax_rate_gap") * agi, -5e5, 1e6),
    })


def deductions(df: DataFrame) -> DataFrame:
    agi, ded, gr = C("agi"), E.nz("deduction_taken"), E.nz("gross_receipts")
    sch = present(df, V.SCHEDULE_C)
    df = df.withColumn("sch_c_total_expenses", E.total(sch))
    exp = C("sch_c_total_expenses")
    revenue = gr + F.lit(V.EPS)
    out = {
        "deduction_per_1k_agi": E.clip(E.safe_ratio(ded, agi) * 1000, 0, 2000),
        "net_deduction_rate": E.clip(E.safe_ratio(ded, agi), 0, 5),
        "sch_c_to_revenue_ratio": E.clip(exp / revenue, 0, 10),
        "phantom_business_flag": E.flag((exp > 500) & (gr == 0)),
        "se_perpetual_loss": E.flag(E.nz("net_se_income") < -1000),
        "expense_concentration": (
            E.clip(E.row_max(sch) / (exp + F.lit(V.EPS)), 0, 1)
            if len(sch) > 1 else F.lit(1.0)),
        "expense_entropy": E.row_entropy(sch),
    }
    if "sch_c_meals" in sch:
        out["meals_to_revenue_ratio"] = E.clip(E.nz("sch_c_meals") / revenue, 0, 5)
    if "sch_c_car_truck" in sch:
        out["car_to_revenue_ratio"] = E.clip(E.nz("sch_c_car_truck") / revenue, 0, 5)
    if "sch_c_home_office" in sch:
        out["home_office_w2_flag"] = E.flag(
            (E.nz("sch_c_home_office") > 0) & (E.nz("w2_wages") > 0)
            & (E.nz("net_se_income") == 0))
    return df.withColumns(out)


def income_sources(df: DataFrame) -> DataFrame:
    agi_abs = F.abs("agi") + F.lit(V.EPS)
    w2, se, gr = E.nz("w2_wages"), E.nz("net_se_income"), E.nz("gross_receipts")
    src = present(df, V.INCOME_SOURCES)
    invest = E.nz("dividends") + E.nz("capital_gains_lt") + E.nz("interest_income")
    df = df.withColumns({
        "w2_share_of_agi": E.clip(w2 / agi_abs, 0, 1),
        "se_share_of_agi": E.clip(se / agi_abs, -0.5, 1),
        "gig_share_of_agi": E.clip(E.nz("gig_net") / agi_abs, 0, 1),
        "rental_share_of_agi": E.clip(E.nz("rental_net") / agi_abs, -0.5, 1),
        "investment_share_of_agi": E.clip(invest / agi_abs, 0, 1),
        "income_stream_count": sum((E.flag(C(c) > 0) for c in src), F.lit(0)),
        "income_entropy": E.row_entropy(src),
        "income_concentration": E.clip(E.row_max(src) / agi_abs, 0, 1),
        "has_cash_business": E.flag(gr > 0),
        "cash_business_dominance": E.clip(gr / agi_abs, 0, 5),
        "se_loss_offsetting_w2": E.flag((se < -1000) & (w2 > 0)),
    })
    return df.withColumn("income_type_mismatch", E.flag(
        (C("taxpayer_type") == "pure_w2")
        & ((C("gig_share_of_agi") > 0.10) | (C("se_share_of_agi") > 0.10))))


def consistency(df: DataFrame) -> DataFrame:
    agi, ded, tax = C("agi"), E.nz("deduction_taken"), E.nz("total_tax_liability")
    etr, gr, exp = E.nz("effective_tax_rate"), E.nz("gross_receipts"), C("sch_c_total_expenses")
    out = {
        "impossible_w2_exceeds_agi": E.flag(E.nz("w2_wages") > agi + 100),
        "deduction_exceeds_agi": E.flag(ded > agi + 100),
        "impossible_negative_tax_high_income": E.flag((tax < 0) & (agi > 100_000)),
        "impossible_rate_above_one": E.flag(etr > 1.0),
        "expense_without_revenue_amount": E.clip(exp * E.flag(gr == 0), 0, 1e6),
        "business_profit_margin": F.when(gr > 0, E.clip((gr - exp) / (gr + F.lit(V.EPS)), -2, 1)),
    }
    if "taxable_income" in df.columns:
        out["taxable_income_error"] = E.clip(F.abs(C("taxable_income") - (agi - ded)), 0, 1e6)
        out["tax_liability_error"] = E.clip(
            F.abs(tax - E.nz("taxable_income") * etr), 0, 5e5)
    df = df.withColumns(out)
    last = {"negative_margin_flag": E.flag(E.nz("business_profit_margin") < -0.1)}
    if "taxable_income" in df.columns:
        last["taxable_income_error_ratio"] = E.clip(
            E.safe_ratio(C("taxable_income_error"), agi), 0, 5)
    return df.withColumns(last)


def financial_ratios(df: DataFrame) -> DataFrame:
    """Ratios guarded by ``+ 1``; absent inputs count as 0."""
    def o(c):
        return optional(df, c)

    def ratio(a, b, lo, hi):
        return E.clip(F.try_divide(a, b + 1), lo, hi)

    agi = o("agi")
    earned = (o("w2_wages") + o("gross_receipts") + o("gig_income") + o("rental_gross")
              + o("crypto_proceeds"))
    return df.withColumns({
        "credit_to_income": ratio(o("total_credits"), agi, -5, 5),
        "debt_to_income": ratio(o("itemized_mortgage_int"), agi, 0, 5),
        "mortgage_leverage_ratio": ratio(o("itemized_mortgage_int"), agi, 0, 5),
        "credit_dependency_index": ratio(o("total_credits"), o("tax_before_credits"), 0, 5),
        "deduction_aggression_score": ratio(o("deduction_taken"), earned, 0, 10),
        "cogs_to_receipts_ratio": ratio(o("cogs"), o("gross_receipts"), 0, 5),
        "sch_c_wages_to_revenue": ratio(o("sch_c_wages"), o("gross_receipts"), 0, 5),
        "gig_expense_ratio": ratio(o("gig_expenses"), o("gig_income"), 0, 10),
        "crypto_loss_shield_ratio": ratio(o("crypto_cost_basis"), o("crypto_proceeds"), 0, 20),
        "utility_cost_per_rental_unit": ratio(o("utility_cost_estimated"), o("n_rental_units"),
                                              0, 50_000),
        "passive_income_density": ratio(o("dividends") + o("interest_income"), agi, 0, 5),
        "new_business_interaction": E.clip(
            (o("has_schedule_c") * o("first_year_filing")).cast("double"), 0, 1),
        "w2_withholding_accuracy": ratio(o("federal_withheld_total"), o("w2_wages"), 0, 2),
    })


def temporal_context(df: DataFrame) -> DataFrame:
    age, agi = E.nz("age"), C("agi")
    return df.withColumns({
        "years_since_base": C("tax_year") - V.YEARS[0],
        "is_covid_year": E.flag(C("tax_year").isin(2020, 2021)),
        "is_recent_year": E.flag(C("tax_year").isin(2024, 2025)),
        "age_group": E.age_group(C("age")),
        "is_near_retirement": E.flag(age.between(60, 70)),
        "is_young_high_earner": E.flag((age < 30) & (agi > 150_000)),
        "retired_high_se_income": E.flag((age > 65) & (E.nz("net_se_income") > 50_000)),
    })


BLOCKS = [lifestyle, tax_burden, deductions, income_sources, consistency, financial_ratios,
          temporal_context]


def core_features(clean: DataFrame) -> DataFrame:
    for block in BLOCKS:
        clean = clean.transform(block)
    return clean
