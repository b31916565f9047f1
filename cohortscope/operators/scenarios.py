"""What-if scenarios for back-testing detectors: deterministic edits of fact columns.

Rates and amounts are input columns; every scenario is a branch of a row expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.blocks import optional

C = F.col
TOUCHED = ["w2_wages", "gross_receipts", "cogs", "net_se_income", "gig_net", "rental_net",
           "interest_income", "crypto_net_gain", "foreign_income", "capital_gains_lt",
           "capital_gains_st", "sch_c_meals", "sch_c_car_truck", "sch_c_home_office",
           "sch_c_wages"]


def inject_scenario(df: DataFrame, type_col: str = "fraud_type", rate_col: str = "rate",
                    amount_col: str = "amount", total_col: str = "total_pre") -> DataFrame:
    """Apply each row's scenario.

    Adds ``scenario`` (capital-gains rows without gains fall back to fictitious
    deductions), its category, ``evasion_amount`` and ``fictitious_deduction``.
    """
    def o(c):
        return optional(df, c)

    v = {c: o(c) for c in TOUCHED}
    rate, amount, whole = E.nz(rate_col), E.nz(amount_col), E.nz(total_col)
    gains = v["capital_gains_lt"] + v["capital_gains_st"]
    kind = F.when((C(type_col) == "capital_gains_omit") & (gains <= 0), "fictitious_deductions")
    df = df.withColumn("scenario", F.coalesce(kind, C(type_col), F.lit("none")))
    s = C("scenario")

    def on(*names):
        return s.isin(*names)

    hidden_1099 = (v["gig_net"] + v["interest_income"]) * rate
    farm = whole * rate * 0.3
    profit = v["gross_receipts"] - v["cogs"]
    expenses = profit - v["net_se_income"]      # stays as it was while revenue moves
    lost = v["gross_receipts"] * rate
    kept = E.floor0(v["gross_receipts"] - lost)
    crypto = E.floor0(v["crypto_net_gain"]) * rate
    offshore = v["foreign_income"] * rate
    wages = v["sch_c_wages"] * rate
    shifted = E.floor0(v["net_se_income"]) * rate
    omitted = gains * rate
    lt_share = F.coalesce(F.try_divide(v["capital_gains_lt"], gains), F.lit(0.0))
    suppress = on("revenue_suppression", "cash_skimming")

    new = {
        "w2_wages": F.when(on("low_salary_scorp") & (v["w2_wages"] > 0),
                           v["w2_wages"] * (1 - rate)),
        "gross_receipts": F.when(suppress, kept),
        "cogs": F.when(on("inflated_cogs"), v["cogs"] + lost),
        "net_se_income": F.when(on("farm_income_hidden"), E.floor0(v["net_se_income"] - farm))
        .when(on("inflated_cogs"), profit - lost - expenses)
        .when(suppress, kept - v["cogs"] - expenses)
        .when(on("shell_company_income_shifting"), E.floor0(v["net_se_income"] - shifted)),
        "gig_net": F.when(on("1099_not_reported"), E.floor0(v["gig_net"] - hidden_1099 * 0.6))
        .when(on("gig_income_omitted"), E.floor0(v["gig_net"] * (1 - rate))),
        "interest_income": F.when(on("1099_not_reported"),
                                  E.floor0(v["interest_income"] - hidden_1099 * 0.4)),
        "rental_net": F.when(on("rental_income_hidden"),
                             E.floor0(v["rental_net"] - o("rental_gross") * rate)),
        "crypto_net_gain": F.when(on("crypto_unreported"), E.floor0(v["crypto_net_gain"] - crypto)),
        "foreign_income": F.when(on("offshore_hidden"), E.floor0(v["foreign_income"] - offshore)),
        "capital_gains_lt": F.when(on("capital_gains_omit"),
                                   E.floor0(v["capital_gains_lt"] - omitted * lt_share)),
        "capital_gains_st": F.when(on("capital_gains_omit"),
                                   E.floor0(v["capital_gains_st"] - omitted * (1 - lt_share))),
        "sch_c_wages": F.when(on("payroll_underreporting", "worker_misclassification"),
                              E.floor0(v["sch_c_wages"] - wages)),
    }
    for c in ("sch_c_meals", "sch_c_car_truck", "sch_c_home_office"):
        new[c] = F.when(on("expense_recharacterization"), v[c] + amount * 0.33)
    evaded = (
        F.when(on("unreported_cash_income"), whole * rate)
        .when(on("1099_not_reported"), hidden_1099)
        .when(on("gig_income_omitted"), o("gig_income") * rate)
        .when(on("rental_income_hidden"), o("rental_gross") * rate)
        .when(on("farm_income_hidden"), farm).when(on("crypto_unreported"), crypto)
        .when(on("offshore_hidden"), offshore)
        .when(on("fictitious_deductions", "expense_recharacterization"), amount)
        .when(on("inflated_cogs", "revenue_suppression", "cash_skimming"), lost)
        .when(on("low_salary_scorp"), E.floor0(v["w2_wages"]) * rate)
        .when(on("payroll_underreporting"), wages)
        .when(on("worker_misclassification"), wages * 0.0765)
        .when(on("shell_company_income_shifting"), shifted)
        .when(on("capital_gains_omit"), omitted).otherwise(0.0))
    out = {c: F.coalesce(E.cents(x), C(c) if c in df.columns else F.lit(None).cast("double"))
           for c, x in new.items() if c in df.columns}
    out["evasion_amount"] = E.cents(E.floor0(evaded))
    out["fictitious_deduction"] = F.when(on("fictitious_deductions"), E.cents(amount)).otherwise(0.0)
    out["scenario_category"] = E.lookup("scenario", V.SCENARIO_CATEGORY, "none")
    return df.withColumns(out)
