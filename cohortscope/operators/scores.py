"""Phases 6 to 8: network risk, impossibility flags, composite scores, one-hots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.blocks import optional
from cohortscope.operators.forensic import stable_norm
from cohortscope.operators.peer import employer_distribution

C = F.col


# --------------------------------------------------------------------- network
def network_features(df: DataFrame, employers: DataFrame | None = None) -> DataFrame:
    """Employer rate joined to the row, its z-score, and the mixed network scores.

    The employer table may be large: no broadcast is forced, so the optimizer decides
    by its staged size and AQE splits an employer that holds too many rows.
    """
    df = df.drop("employer_fraud_rate", "employer_n_employees", "employer_fraud_z_score",
                 "high_risk_employer", "network_risk_score", "contagion_score")
    if employers is not None and "employer_id" in df.columns:
        d = employer_distribution(employers).first()
        # rows without an employer meet nobody: spread them instead of sending them to one task
        spread = F.concat(F.lit("none-"), F.pmod(F.xxhash64(*[
            c for c in ("row_id", "person_id", "tax_year") if c in df.columns]), F.lit(4096)))
        right = employers.select(C("employer_id").cast("string").alias("__employer"),
                                 "employer_fraud_rate", "employer_n_employees")
        df = df.withColumn("__employer", F.coalesce(C("employer_id").cast("string"), spread)).join(
            right, "__employer", "left").drop("__employer")
        df = df.withColumns({
            "employer_fraud_rate": F.coalesce(C("employer_fraud_rate"), F.lit(d["mu"])),
            "employer_n_employees": F.coalesce(C("employer_n_employees"), F.lit(0)),
        })
        df = df.withColumns({
            "employer_fraud_z_score": E.clip(
                (C("employer_fraud_rate") - F.lit(d["mu"])) / F.lit(d["sigma"]), -5, 5),
            "high_risk_employer": E.flag(C("employer_fraud_rate") > 0.30),
        })
    else:
        df = df.withColumns({"employer_fraud_rate": F.lit(V.DEFAULT_RATE),
                             "employer_n_employees": F.lit(0).cast("long"),
                             "employer_fraud_z_score": F.lit(0.0),
                             "high_risk_employer": F.lit(0)})
    return df.withColumns({
        "network_risk_score": E.clip(
            0.50 * C("employer_fraud_rate") + 0.30 * E.nz("peer_fraud_rate", V.DEFAULT_RATE)
            + 0.20 * E.nz("state_fraud_rate", V.DEFAULT_RATE), 0, 1),
        "contagion_score": E.clip(
            0.40 * E.clip(E.nz("employer_fraud_z_score"), 0, 5)
            + 0.35 * E.clip(optional(df, "z_lifestyle_income_ratio"), 0, 5)
            + 0.25 * E.clip(optional(df, "composite_z_score"), 0, 5), 0, 5),
    })


# ----------------------------------------------------------------------- flags
def impossibility_flags(df: DataFrame) -> DataFrame:
    df = df.drop(*V.IMPOSSIBILITY_FLAGS, "total_flag_count", "has_impossibility",
                 "has_legal_violation", "has_lifestyle_anomaly", "has_forensic_violation")
    agi, exp = E.nz("agi"), E.nz("sch_c_total_expenses")

    def o(c, fill=0.0):
        return optional(df, c, fill)

    net_se, gr, ded = o("net_se_income"), o("gross_receipts"), o("deduction_taken")
    bank = E.nz("bank_deposit_ratio") if "bank_deposit_ratio" in df.columns else F.lit(1.0)
    df = df.withColumns({
        "flag_phantom_business": E.flag((exp > 500) & (gr == 0)),
        "flag_hobby_loss_risk": E.flag((net_se < -5000) & (gr > 0)),
        "flag_impossible_deductions": E.flag((ded > agi * 2) & (agi > 5000)),
        "flag_zero_tax_with_income": E.flag((o("total_tax_liability") < 100) & (agi > 75_000)),
        "flag_progressive_anomaly": E.flag(
            (agi > 150_000) & (o("effective_tax_rate") < 0.06) & (ded < agi * 0.20)),
        "flag_high_bank_deposits": E.flag((bank > 50) & (agi > 10_000)),
        "flag_unexplained_wealth": E.flag(o("unexplained_wealth_ratio") > 10),
        "flag_benford_violation": E.flag(o("benford_deviation_expenses") > 3),
    })
    counted = [c for c in df.columns if c.startswith("flag_")
               and not c.endswith("_block_score") and c not in V.UNCOUNTED_FLAGS]
    return df.withColumns({
        "total_flag_count": sum((E.nz(c, 0) for c in counted), F.lit(0)),
        "has_impossibility": E.flag((C("flag_impossible_deductions")
                                     + C("flag_zero_tax_with_income")) > 0),
        "has_legal_violation": E.flag((C("flag_phantom_business")
                                       + C("flag_hobby_loss_risk")) > 0),
        "has_lifestyle_anomaly": E.flag((C("flag_high_bank_deposits")
                                         + C("flag_unexplained_wealth")) > 0),
        "has_forensic_violation": C("flag_benford_violation"),
    })


# ------------------------------------------------------------------- composite
def _bank_log(df: DataFrame) -> Column:
    if "bank_deposit_ratio_log" in df.columns:
        return E.nz("bank_deposit_ratio_log")
    return E.log1p0("bank_deposit_ratio") if "bank_deposit_ratio" in df.columns else F.lit(0.0)


def block_scores(df: DataFrame) -> DataFrame:
    """One [0, 1] score per evidence block.  Expects ``two_total_flag_count``."""
    have = set(df.columns)
    out = {}
    if "irs_risk_score" in have:
        irs = E.clip(E.nz("irs_risk_score"), 0, 100)
        out["irs_block_score"] = E.norm01(irs, 0, 100)
        out["irs_block_score_nl"] = E.clip(
            F.when(irs <= 60, irs / 60.0 * 0.30).otherwise(0.30 + (irs - 60.0) / 40.0 * 0.70),
            0, 1)
    else:
        out["irs_block_score"] = out["irs_block_score_nl"] = F.lit(0.0)
    out["bank_deposit_block_score"] = E.norm01(_bank_log(df), 0, 14)
    out["zscore_block_score"] = (E.norm01(E.nz("composite_z_score"), -3, 3)
                                 if "composite_z_score" in have else F.lit(0.5))
    out["network_block_score"] = optional(df, "network_risk_score", V.DEFAULT_RATE)
    if "federal_withheld" in have:
        out["withholding_block_score"] = 1.0 - E.norm01(
            E.clip(E.nz("federal_withheld"), 0, 50_000), 0, 20_000)
    elif "withholding_rate" in have:
        out["withholding_block_score"] = 1.0 - E.norm01(E.nz("withholding_rate"), 0, 0.30)
    else:
        out["withholding_block_score"] = F.lit(0.5)
    out["forensic_block_score"] = optional(df, "forensic_risk_score")
    out["flag_block_score"] = stable_norm("total_flag_count")
    return df.withColumns(out)


def master_score(df: DataFrame) -> DataFrame:
    """Weighted blocks plus interaction terms and flag boosts, bounded to [0, 1]."""
    have = set(df.columns)
    weights = {b: w for b, w in V.BLOCK_WEIGHTS.items() if b in have}
    base = sum((E.nz(b) * w for b, w in weights.items()), F.lit(0.0))
    base = E.clip(base / max(sum(weights.values()), V.EPS), 0, 1)
    irs = (E.nz("flag_irs_high", 0) if "flag_irs_high" in have
           else E.flag(optional(df, "irs_risk_score") > 67))
    bank = (E.nz("flag_bank_deposit_extreme", 0) if "flag_bank_deposit_extreme" in have
            else E.flag(optional(df, "bank_deposit_ratio") > 43))
    if "flag_low_withholding" in have:
        low = E.nz("flag_low_withholding", 0)
    elif "withholding_rate" in have:
        low = E.flag(E.nz("withholding_rate") < 0.03)
    else:
        low = F.lit(0)
    boost = sum((E.nz(f, 0) * b for f, b in V.FLAG_BOOSTS.items() if f in have), F.lit(0.0))
    return df.withColumn("master_fraud_propensity", E.clip(
        base + irs * bank * 0.12 + irs * low * 0.08 + boost, 0, 1))


def typed_signals(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    out = {"income_hiding_signal": E.clip(
        _bank_log(df) * (1.0 - E.norm01(E.nz("agi"), 0, 200_000)), 0, 10)}
    if {"deduction_taken", "agi"} <= have:
        out["deduction_fraud_signal"] = E.clip(
            E.safe_ratio(E.nz("deduction_taken"), C("agi")), 0, 5)
    if {"gross_receipts", "sch_c_total_expenses"} <= have:
        out["business_suppression_signal"] = E.clip(
            E.nz("sch_c_total_expenses") / (E.nz("gross_receipts") + F.lit(V.EPS)), 0, 5)
    return df.withColumns(out)


def one_hots(df: DataFrame) -> DataFrame:
    """0/1 columns over the fixed vocabularies of state, type and age group."""
    out = {f"state_{s.lower().replace(' ', '_')}": E.flag(C("state") == s) for s in V.STATES}
    out.update({f"tt_{t}": E.flag(C("taxpayer_type") == t) for t in V.TAXPAYER_TYPES})
    if "age_group" in df.columns:
        out.update({f"age_{a}": E.flag(C("age_group") == a) for a in V.AGE_GROUPS})
    return df.withColumns(out)


def composite_scores(df: DataFrame) -> DataFrame:
    """Phase 8, safe to repeat: earlier block scores are dropped first."""
    old = [c for c in df.columns if c.endswith(("_block_score", "_block_score_nl"))]
    df = df.drop(*old, "master_fraud_propensity", "deduction_fraud_signal",
                 "income_hiding_signal", "business_suppression_signal")
    for step in (block_scores, master_score, typed_signals, one_hots):
        df = df.transform(step)
    return df
