"""The panel columns that queries of the feature pipeline read: no others are computed for them.

A list that lacks a column makes its query differ from the SQL twin.
"""

from __future__ import annotations

from cohortscope import vocab as V

KEYS = ["person_id", "tax_year"]
INCOME = ["taxpayer_type", "agi", *V.INCOME_SOURCES]       # AGI is rebuilt and imputed from these
_TAX = ["deduction_taken", "total_tax_liability", "effective_tax_rate"]
_LIFE = ["bank_deposit_ratio", "lifestyle_income_ratio"]
FLAGS = [*KEYS, *INCOME, "gross_receipts", *V.SCHEDULE_C, *_TAX, *_LIFE, "irs_risk_score"]
RATES = ["tax_year", "state", *INCOME, "fraud_label"]
LEARNED = [*FLAGS, "zone", "state", "employer_id", "fraud_label"]
SCORES = [*LEARNED, "age", "federal_withheld", "utility_income_ratio"]

USED = {
    "x3_lifestyle": [*KEYS, *INCOME, "deduction_taken", *_LIFE],
    "x4_tax_burden": [*KEYS, *INCOME, *_TAX, "federal_withheld"],
    "x5_deductions": [*KEYS, *INCOME, "gross_receipts", *V.SCHEDULE_C, "deduction_taken"],
    "x6_income_sources": [*KEYS, *INCOME, "gross_receipts"],
    "x7_consistency": [*KEYS, *INCOME, "gross_receipts", *V.SCHEDULE_C, *_TAX, "taxable_income"],
    "x8_financial_ratios": [*KEYS, *INCOME, "first_year_filing", "gross_receipts", "cogs",
                            "gig_income", "gig_expenses", "rental_gross", "n_rental_units",
                            "sch_c_wages", "crypto_proceeds", "crypto_cost_basis",
                            "itemized_mortgage_int", "deduction_taken", "tax_before_credits",
                            "total_credits", "federal_withheld_total", "utility_cost_estimated",
                            "has_schedule_c"],
    "x9_temporal_context": [*KEYS, *INCOME, "age"],
    "x11_forensic_rows": [*KEYS, *INCOME, *V.SCHEDULE_C, "total_tax_liability", *_LIFE,
                          "utility_income_ratio"],
    "x13_impossibility_flags": FLAGS,
    "p14_one_hot": [*KEYS, "state", "taxpayer_type", "age"],
    "a1_peer_stats": LEARNED, "a2_peer_p95": LEARNED, "a3_single_member_std": LEARNED,
    "a6_group_rates": RATES, "peer_unusualness": LEARNED, "w1_percent_ranks": SCORES,
    "x10_z_scores": LEARNED, "j1_j4_target_encoding": LEARNED, "f18_two_valued_probe": SCORES,
    "x11_forensic_scores": SCORES, "x12_network": SCORES, "x14_block_scores": SCORES,
    "x14_master_score": SCORES, "e2_score_separation": SCORES, "e4_block_means": SCORES,
    "e7_roc_auc_master": SCORES,
    "e1_flag_calibration": [*FLAGS, "federal_withheld", "fraud_label"],
    "e5_flag_combinations": [*FLAGS, "federal_withheld", "fraud_label"],
    "e6_flag_count_distribution": [*FLAGS, "federal_withheld", "fraud_label"],
    "e7_roc_auc_flags": [*FLAGS, "federal_withheld", "fraud_label", "state"],
}
