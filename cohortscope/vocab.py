"""Vocabularies, thresholds, bounds, weights and statutory tables.

Everything here is a constant of the data model.  Results depend on these exact
values, so they are stated once, plainly, in their natural order.
"""

EPS = 1e-9
SMOOTHING_WEIGHT = 10.0
DEFAULT_RATE = 0.21
SEED = 42

YEARS = list(range(2019, 2026))
TRAIN_YEARS = list(range(2019, 2024))
VALIDATION_YEAR = 2024
TEST_YEAR = 2025
OPEN_ENDED = 9999

# ---------------------------------------------------------------- vocabularies
STATES = ["California", "Florida", "Texas", "New York", "Illinois"]
ZONE_TO_STATE = {1: "California", 2: "Florida", 3: "Texas", 4: "New York", 5: "Illinois"}
TAXPAYER_TYPES = ["pure_w2", "business_owner", "gig_only", "investor",
                  "multi_biz_owner", "pure_se", "retired", "w2_with_side_biz"]
AGE_GROUPS = ["under_25", "25_35", "35_50", "50_65", "over_65"]
AGE_EDGES = [0, 25, 35, 50, 65, 200]
INCOME_BANDS = ["under_25k", "25k_50k", "50k_75k", "75k_100k", "100k_150k",
                "150k_250k", "250k_500k", "500k_1M", "over_1M"]
INCOME_EDGES = [0, 25_000, 50_000, 75_000, 100_000, 150_000, 250_000, 500_000, 1_000_000]
UNKNOWN = "UNKNOWN"
W2_TYPES = ["pure_w2", "w2_with_side_biz"]
SE_TYPES = ["pure_se", "gig_only", "business_owner", "multi_biz_owner"]
QBI_TYPES = ["pure_se", "w2_with_side_biz", "business_owner", "multi_biz_owner"]

# --------------------------------------------------------------- column groups
SCHEDULE_C = ["sch_c_advertising", "sch_c_car_truck", "sch_c_meals",
              "sch_c_home_office", "sch_c_wages", "sch_c_depreciation"]
INCOME_SOURCES = ["w2_wages", "net_se_income", "gig_net", "rental_net",
                  "dividends", "capital_gains_lt", "interest_income"]
SIGNALS = ["lifestyle_income_ratio", "bank_deposit_ratio", "deduction_income_ratio",
           "irs_risk_score", "federal_withheld"]
ZERO_FILLED = ["gig_net", "rental_net", "dividends", "capital_gains_lt",
               "interest_income", "gross_receipts"] + SCHEDULE_C
LEAKAGE = ["fraud_type", "fraud_category", "data_source"]

# ------------------------------------------------------------------ clip bounds
CLIP_BOUNDS = {
    "agi": (0, 10_000_000),
    "taxable_income": (0, 10_000_000),
    "w2_wages": (0, 5_000_000),
    "net_se_income": (-500_000, 5_000_000),
    "gig_net": (-200_000, 2_000_000),
    "rental_net": (-200_000, 2_000_000),
    "dividends": (0, 5_000_000),
    "capital_gains_lt": (-500_000, 5_000_000),
    "interest_income": (0, 2_000_000),
    "gross_receipts": (0, 20_000_000),
    "total_tax_liability": (0, 5_000_000),
    "deduction_taken": (0, 5_000_000),
    "effective_tax_rate": (0, 0.65),
    "lifestyle_income_ratio": (0, 20.0),
    "bank_deposit_ratio": (-20.0, 550_000.0),
    "utility_income_ratio": (-15.0, 5_000.0),
    "deduction_income_ratio": (0, 5.0),
    "irs_risk_score": (0, 100.0),
    "federal_withheld": (0, 150_000),
    "age": (16, 100),
}

# ------------------------------------------------------- fixed normalisation
NORM_BOUNDS = {
    "lifestyle_income_ratio": (0.04, 5.08),
    "bank_deposit_ratio": (-20.0, 550_000.0),
    "bank_deposit_ratio_log": (0.0, 14.0),
    "utility_income_ratio": (-15.0, 5_000.0),
    "unexplained_wealth_ratio": (0.00, 5.20),
    "tax_rate_gap": (-0.15, 0.35),
    "underpayment_proxy": (0.00, 25_000.0),
    "bracket_rate_ratio": (0.00, 1.50),
    "net_deduction_rate": (0.05, 0.88),
    "sch_c_to_revenue_ratio": (0.10, 1.25),
    "expense_entropy": (0.50, 4.10),
    "total_flag_count": (0.00, 8.00),
    "z_deduction_income_ratio": (-3.50, 3.50),
    "z_lifestyle_income_ratio": (-3.50, 3.50),
    "z_sch_c_to_revenue_ratio": (-3.50, 3.50),
    "benford_deviation_expenses": (0.00, 8.50),
    "round_number_ratio": (0.00, 0.85),
    "cash_t_method_gap_ratio": (-1.00, 300.00),
    "lifestyle_asset_score": (0.05, 4.20),
    "irs_risk_score": (0.00, 100.00),
    "composite_z_score": (-3.00, 3.00),
    "federal_withheld": (0.00, 150_000.0),
    "withholding_rate": (-0.01, 0.30),
    "zone_risk": (0.00, 4.00),
    "cash_t_method_gap": (0.00, 25_000_000.0),
}

# ------------------------------------------------------------ peer statistics
PEER_KEYS = ["income_band", "taxpayer_type", "state"]
Z_FEATURES = ["lifestyle_income_ratio", "bank_deposit_ratio", "deduction_income_ratio",
              "irs_risk_score", "sch_c_to_revenue_ratio", "net_deduction_rate",
              "tax_rate_gap", "income_entropy", "expense_entropy"]
Z_WEIGHTS = {"irs_risk_score": 0.45, "bank_deposit_ratio": 0.25,
             "lifestyle_income_ratio": 0.10, "deduction_income_ratio": 0.10,
             "tax_rate_gap": 0.07, "expense_entropy": 0.03}
EXTRA_RANKED = ["bank_deposit_ratio_log", "zone_risk", "irs_risk_score_sq", "withholding_rate"]
RANKED = Z_FEATURES + EXTRA_RANKED
PEER_FEATURES = Z_FEATURES + ["sch_c_total_expenses", "income_stream_count",
                              "absolute_lifestyle_gap", "bank_deposit_gap_ratio",
                              "bank_deposit_ratio_log", "zone_risk"]
RATE_DIMS = {"state": "state_fraud_rate", "taxpayer_type": "ttype_fraud_rate",
             "income_band": "band_fraud_rate", "tax_year": "year_fraud_rate"}

# ------------------------------------------------------------------- forensic
BENFORD = [0.30103, 0.17609, 0.12494, 0.09691, 0.07918, 0.06695, 0.05799, 0.05115, 0.04576]
DIF_WEIGHTS = {"z_deduction_income_ratio": 0.25, "z_lifestyle_income_ratio": 0.20,
               "tax_rate_gap": 0.20, "z_sch_c_to_revenue_ratio": 0.15,
               "benford_deviation_expenses": 0.10, "round_number_ratio": 0.10}
FORENSIC_WEIGHTS = {"benford_deviation_expenses": 0.25, "round_number_ratio": 0.20,
                    "unexplained_wealth_ratio": 0.25, "cash_t_method_gap_ratio": 0.20,
                    "lifestyle_asset_score": 0.10}

# ------------------------------------------------------------- flags and score
SIGNAL_FLAGS = ["flag_irs_high", "flag_irs_very_high", "flag_irs_moderate",
                "flag_bank_deposit_extreme", "flag_bank_deposit_high", "flag_low_withholding"]
IMPOSSIBILITY_FLAGS = ["flag_phantom_business", "flag_hobby_loss_risk",
                       "flag_impossible_deductions", "flag_zero_tax_with_income",
                       "flag_progressive_anomaly", "flag_high_bank_deposits",
                       "flag_unexplained_wealth", "flag_benford_violation"]
UNCOUNTED_FLAGS = ["flag_irs_moderate", "flag_low_withholding"]
BLOCK_WEIGHTS = {"irs_block_score_nl": 0.50, "bank_deposit_block_score": 0.20,
                 "zscore_block_score": 0.12, "network_block_score": 0.10,
                 "withholding_block_score": 0.05, "forensic_block_score": 0.03}
FLAG_BOOSTS = {"flag_irs_high": 0.04, "flag_bank_deposit_extreme": 0.04,
               "flag_low_withholding": 0.02, "flag_phantom_business": 0.01,
               "flag_hobby_loss_risk": 0.01}
REPORTED_BLOCKS = ["irs_block_score_nl", "bank_deposit_block_score", "zscore_block_score",
                   "network_block_score", "withholding_block_score"]

# ------------------------------------------------------- effective-rate brackets
EFFECTIVE_BRACKETS = [(10_000, 0.10), (40_000, 0.12), (85_000, 0.22), (165_000, 0.24),
                      (215_000, 0.32), (540_000, 0.35), (None, 0.37)]

# ------------------------------------------------------------- statutory tables
MARGINAL_RATES = [0.10, 0.12, 0.22, 0.24, 0.32, 0.35, 0.37]
BRACKET_TOPS = {
    2019: [9_700, 39_475, 84_200, 160_725, 204_100, 510_300],
    2020: [9_875, 40_125, 85_525, 163_300, 207_350, 518_400],
    2021: [9_950, 40_525, 86_375, 164_925, 209_425, 523_600],
    2022: [10_275, 41_775, 89_075, 170_050, 215_950, 539_900],
    2023: [11_000, 44_725, 95_375, 182_950, 231_250, 578_125],
    2024: [11_600, 47_150, 100_525, 191_950, 243_725, 609_350],
    2025: [12_000, 48_475, 103_350, 197_300, 250_525, 626_350],
}
DEFAULT_BRACKET_YEAR = 2023
DOUBLED_STATUSES = ["married_joint", "qualifying_widow"]
FILING_STATUSES = ["single", "married_joint", "married_separate",
                   "head_of_household", "qualifying_widow"]
# per year: single, head of household; joint and widow are twice single,
# separate equals single
STANDARD_DEDUCTION = {2019: (12_200, 18_350), 2020: (12_400, 18_650), 2021: (12_550, 18_800),
                      2022: (12_950, 19_400), 2023: (13_850, 20_800), 2024: (14_600, 21_900),
                      2025: (15_000, 22_500)}
DEFAULT_STANDARD_DEDUCTION = 12_950
WAGE_BASE = {2019: 132_900, 2020: 137_700, 2021: 142_800, 2022: 147_000,
             2023: 160_200, 2024: 168_600, 2025: 176_100}
DEFAULT_WAGE_BASE = 160_200
EITC_MAX = {0: 538, 1: 3_584, 2: 5_920, 3: 6_660}
ZONE_BASE_RATE = {1: 0.087, 2: 0.074, 3: 0.091, 4: 0.068, 5: 0.062}
INFLATION = {2019: 0.023, 2020: 0.012, 2021: 0.047, 2022: 0.080,
             2023: 0.041, 2024: 0.030, 2025: 0.026}
COVID_SHOCK = {2019: 0.0, 2020: 1.0, 2021: 0.3, 2022: 0.05, 2023: 0.0, 2024: 0.0, 2025: 0.0}
OCCUPATION_GROWTH = {"computer_math": 0.040, "management": 0.030, "legal": 0.025,
                     "healthcare_pract": 0.028, "business_finance": 0.032,
                     "food_service": 0.018, "building_grounds": 0.019,
                     "personal_care": 0.020, "farming_fishing": 0.015}
DEFAULT_OCCUPATION_GROWTH = 0.024

# --------------------------------------------------------- scenarios and types
SCENARIO_CATEGORY = {
    "unreported_cash_income": "income_hiding", "1099_not_reported": "income_hiding",
    "gig_income_omitted": "income_hiding", "rental_income_hidden": "income_hiding",
    "farm_income_hidden": "income_hiding", "crypto_unreported": "income_hiding",
    "offshore_hidden": "income_hiding", "fictitious_deductions": "deduction_fraud",
    "expense_recharacterization": "deduction_fraud", "inflated_cogs": "deduction_fraud",
    "low_salary_scorp": "payroll_evasion", "payroll_underreporting": "payroll_evasion",
    "worker_misclassification": "payroll_evasion",
    "revenue_suppression": "business_suppression", "cash_skimming": "business_suppression",
    "shell_company_income_shifting": "business_suppression",
    "capital_gains_omit": "income_hiding",
}
SCENARIOS = list(SCENARIO_CATEGORY)
ALLOWED_SCENARIOS = {
    "pure_w2": ["fictitious_deductions", "1099_not_reported"],
    "pure_se": ["unreported_cash_income", "cash_skimming", "expense_recharacterization",
                "inflated_cogs", "fictitious_deductions"],
    "w2_with_side_biz": ["1099_not_reported", "expense_recharacterization",
                         "fictitious_deductions"],
    "business_owner": ["unreported_cash_income", "expense_recharacterization", "cash_skimming",
                       "revenue_suppression", "payroll_underreporting", "fictitious_deductions"],
    "multi_biz_owner": ["unreported_cash_income", "expense_recharacterization", "cash_skimming",
                        "payroll_underreporting", "worker_misclassification",
                        "shell_company_income_shifting", "fictitious_deductions"],
    "gig_only": ["gig_income_omitted", "expense_recharacterization", "fictitious_deductions"],
    "retired": ["fictitious_deductions", "1099_not_reported"],
    "investor": ["capital_gains_omit", "fictitious_deductions", "offshore_hidden"],
}
FORBIDDEN_STREAMS = {
    "pure_w2": ["gross_receipts", "gig_income"], "pure_se": ["w2_wages"],
    "gig_only": ["w2_wages", "gross_receipts"],
    "retired": ["w2_wages", "gross_receipts", "gig_income"],
    "investor": ["gross_receipts", "gig_income"],
}

# ------------------------------------------------------------------ null policy
SE_INCOME_TYPES = ["pure_se", "w2_with_side_biz", "business_owner", "multi_biz_owner", "gig_only"]
SE_COLUMNS = ["gross_receipts", "cogs", "gross_profit", "total_expenses", "net_se_income",
              "has_schedule_c", "sch_c_advertising", "sch_c_car_truck", "sch_c_depreciation",
              "sch_c_insurance", "sch_c_meals", "sch_c_office_expense", "sch_c_rent",
              "sch_c_repairs", "sch_c_supplies", "sch_c_utilities", "sch_c_wages",
              "sch_c_home_office", "sch_c_other", "se_tax_amount", "se_tax_deduction"]
NULL_WHEN_FLAG_OFF = {
    "has_rental": ["rental_gross", "rental_expenses", "rental_depreciation", "rental_net",
                   "n_rental_units"],
    "has_crypto": ["crypto_proceeds", "crypto_cost_basis", "crypto_net_gain"],
    "has_foreign_account": ["foreign_income", "foreign_account_balance", "fbar_required"],
    "fraud_label": ["evasion_amount", "evasion_rate"],
}
SOCIAL_SECURITY_AGE = 62
WAGE_COLUMNS = ["w2_wages", "federal_withheld", "fica_withheld", "medicare_withheld",
                "federal_withheld_total"]
STRING_COLUMNS = ["person_id", "sex", "education", "filing_status", "taxpayer_type",
                  "primary_occupation", "employer_id", "fraud_type", "fraud_category",
                  "fraud_persona", "data_source", "entry_cohort", "state"]
INT_FLAGS = ["has_schedule_c", "has_gig", "has_rental", "has_investments", "has_crypto",
             "has_foreign_account", "received_ppp", "uses_itemized", "first_year_filing",
             "fraud_label"]

# ------------------------------------------------------------------ feature roles
CATEGORICAL_FEATURES = ["filing_status", "taxpayer_type", "primary_occupation", "sex", "education"]
BINARY_FEATURES = ["has_schedule_c", "has_gig", "has_rental", "has_investments", "has_crypto",
                   "has_foreign_account", "received_ppp", "uses_itemized", "first_year_filing",
                   "fbar_required"]
NUMERIC_FEATURES = [
    "tax_year", "zone", "age", "entry_cohort",
    "w2_wages", "federal_withheld", "fica_withheld", "medicare_withheld",
    "federal_withheld_total",
    "gross_receipts", "cogs", "gross_profit", "total_expenses", "net_se_income",
    "sch_c_advertising", "sch_c_car_truck", "sch_c_depreciation", "sch_c_insurance",
    "sch_c_meals", "sch_c_office_expense", "sch_c_rent", "sch_c_repairs", "sch_c_supplies",
    "sch_c_utilities", "sch_c_wages", "sch_c_home_office",
    "gig_income", "gig_expenses", "gig_net",
    "rental_gross", "rental_expenses", "rental_depreciation", "rental_net", "n_rental_units",
    "dividends", "capital_gains_lt", "capital_gains_st", "interest_income",
    "crypto_proceeds", "crypto_cost_basis", "crypto_net_gain",
    "foreign_income", "foreign_account_balance", "k1_income", "owner_salary",
    "social_security_income", "pension_income", "ira_distributions", "unemployment_comp",
    "standard_deduction", "itemized_total", "itemized_mortgage_int", "itemized_salt",
    "itemized_charitable", "itemized_medical", "deduction_taken", "qbi_deduction",
    "se_tax_amount", "se_tax_deduction",
    "agi", "taxable_income", "tax_before_credits", "eitc_credit", "child_tax_credit",
    "total_credits", "total_tax_liability", "effective_tax_rate", "refund_amount",
    "balance_due",
    "electricity_kwh", "gas_therms", "water_gallons", "utility_cost_estimated",
    "utility_income_ratio", "lifestyle_income_ratio", "bank_deposit_ratio",
    "deduction_income_ratio", "effective_rate_vs_zone", "irs_risk_score", "ppp_loan_amount",
]
FEATURES = NUMERIC_FEATURES + BINARY_FEATURES + CATEGORICAL_FEATURES
TARGET = "fraud_label"

# -------------------------------------------------------- canonical merge schema
CANONICAL_INT = ["zone", "age", "has_schedule_c", "has_gig", "has_rental", "has_investments",
                 "has_crypto", "has_foreign_account", "uses_itemized", "first_year_filing",
                 "received_ppp", "fbar_required", "fraud_label"]
CANONICAL_STRING = ["person_id", "tax_year", "data_source", "sex", "education", "filing_status",
                    "taxpayer_type", "primary_occupation", "employer_id", "entry_cohort",
                    "fraud_type", "fraud_category"]
CANONICAL = [
    "person_id", "tax_year", "data_source", "zone", "age", "sex", "education", "filing_status",
    "taxpayer_type", "primary_occupation", "entry_cohort", "first_year_filing", "employer_id",
    "w2_wages", "federal_withheld", "fica_withheld", "medicare_withheld",
    "federal_withheld_total",
    "gross_receipts", "cogs", "gross_profit", "total_expenses", "net_se_income",
    "has_schedule_c", "sch_c_advertising", "sch_c_car_truck", "sch_c_depreciation",
    "sch_c_insurance", "sch_c_meals", "sch_c_office_expense", "sch_c_rent", "sch_c_repairs",
    "sch_c_supplies", "sch_c_utilities", "sch_c_wages", "sch_c_home_office", "se_tax_amount",
    "se_tax_deduction",
    "gig_income", "gig_expenses", "gig_net", "has_gig",
    "rental_gross", "rental_expenses", "rental_depreciation", "rental_net", "has_rental",
    "n_rental_units",
    "dividends", "capital_gains_lt", "capital_gains_st", "interest_income", "has_investments",
    "crypto_proceeds", "crypto_cost_basis", "crypto_net_gain", "has_crypto",
    "foreign_income", "foreign_account_balance", "fbar_required", "has_foreign_account",
    "k1_income", "owner_salary",
    "social_security_income", "pension_income", "ira_distributions", "unemployment_comp",
    "uses_itemized", "standard_deduction", "itemized_total", "itemized_mortgage_int",
    "itemized_salt", "itemized_charitable", "itemized_medical", "deduction_taken",
    "qbi_deduction",
    "agi", "taxable_income", "tax_before_credits", "eitc_credit", "child_tax_credit",
    "total_credits", "total_tax_liability", "effective_tax_rate", "refund_amount",
    "balance_due",
    "electricity_kwh", "gas_therms", "water_gallons", "utility_cost_estimated",
    "utility_income_ratio", "lifestyle_income_ratio", "bank_deposit_ratio",
    "deduction_income_ratio", "effective_rate_vs_zone", "irs_risk_score",
    "received_ppp", "ppp_loan_amount",
    "fraud_label", "fraud_type", "fraud_category",
]
SOURCE_PREFIX = {"real": "R", "ctab_w2": "CW", "ctab_se": "CS", "ctab_itemizers": "CI",
                 "timegan_compliant": "TC", "timegan_evader": "TE"}
SOURCE_PRIORITY = {"real": 0, "ctab_w2": 1, "ctab_se": 2, "ctab_itemizers": 3,
                   "timegan_compliant": 4, "timegan_evader": 5}
TRAIN_YEAR_WEIGHTS = {2019: 360_000, 2020: 16_500, 2021: 17_200, 2022: 15_800, 2023: 16_900}

# --------------------------------------------------------------------- sampling
LIFECYCLES = {"transient": (1, 1), "short": (2, 3), "mid": (4, 5), "persistent": (6, 7)}
LIFECYCLE_SHARE = {"transient": 0.50, "short": 0.07, "mid": 0.07, "persistent": 0.36}
PATTERN_SHARE = {"chronic": 0.78, "mixed": 0.22}
STATE_TARGET_RATE = {"California": 0.22, "Illinois": 0.16, "New York": 0.18,
                     "Florida": 0.21, "Texas": 0.19}
TARGET_ROWS_PER_STATE = 10_000
CLEAN_BUFFER = 1.1
TRIM_TOLERANCE = 0.025
TRIM_SLACK = 50

# ------------------------------------------------------------- rates and checks
RATE_OVERALL = 0.21
RATE_W2 = 0.20
RATE_SE = 0.28
RATE_ITEMIZERS = 0.18
RATE_TOLERANCE = 0.015
SEED_ROWS = 50_000
MUST_NOT_BE_NULL = ["person_id", "tax_year", "zone", "age", "fraud_label", "fraud_type", "agi",
                    "total_tax_liability", "taxpayer_type", "filing_status", "deduction_taken"]
INCOME_BENCHMARKS = {"agi": (46_000, 78_000), "w2_wages": (42_000, 65_000),
                     "total_tax_liability": (4_200, 12_000), "net_se_income": (18_000, 35_000)}

# -------------------------------------------------------------- sequence features
SEQUENCE_FEATURES = ["w2_wages", "net_se_income", "agi", "taxable_income", "total_tax_liability",
                     "effective_tax_rate", "electricity_kwh", "utility_income_ratio",
                     "lifestyle_income_ratio"]
SEQUENCE_STATICS = ["zone", "sex", "education", "taxpayer_type", "fraud_type"]
SEQUENCE_LENGTH = 7

# --------------------------------------------------------------- business hazards
FAILURE_RATES = {
    "food_service": [0.17, 0.28, 0.14, 0.12, 0.11, 0.10, 0.10],
    "retail_trade": [0.13, 0.22, 0.11, 0.09, 0.09, 0.08, 0.09],
    "construction": [0.10, 0.14, 0.08, 0.07, 0.07, 0.07, 0.08],
    "professional_services": [0.07, 0.11, 0.06, 0.05, 0.05, 0.05, 0.05],
    "healthcare_solo": [0.05, 0.08, 0.04, 0.04, 0.04, 0.03, 0.04],
    "real_estate_rental": [0.06, 0.09, 0.05, 0.06, 0.05, 0.05, 0.05],
    "transportation_gig": [0.11, 0.09, 0.08, 0.09, 0.08, 0.08, 0.08],
    "information_tech": [0.08, 0.10, 0.06, 0.05, 0.05, 0.05, 0.05],
}
INDUSTRIES = list(FAILURE_RATES)
DEFAULT_FAILURE_RATE = 0.09

# ------------------------------------------------------------- fitting defaults
STATE_TO_FIT_ZONE = {
    1: ["Illinois", "Indiana", "Michigan", "Ohio", "Pennsylvania", "Wisconsin", "New York"],
    2: ["Connecticut", "Delaware", "District of Columbia", "Maryland", "Massachusetts",
        "New Jersey", "Virginia"],
    3: ["Arkansas", "Iowa", "Kansas", "Minnesota", "Missouri", "Nebraska", "North Dakota",
        "Oklahoma", "South Dakota", "Kentucky", "Mississippi", "Alabama", "South Carolina",
        "West Virginia", "Montana", "Maine", "Vermont", "Wyoming", "New Hampshire",
        "Rhode Island"],
    4: ["California", "Colorado", "Idaho", "Oregon", "Utah", "Washington", "Alaska", "Hawaii",
        "Nevada"],
    5: ["Arizona", "New Mexico", "Texas", "Louisiana", "Florida", "Georgia", "North Carolina",
        "Tennessee"],
}
FALLBACK_INCOME_MULTIPLIER = {1: 1.15, 2: 1.35, 3: 0.82, 4: 1.55, 5: 0.92}
FALLBACK_HOME_VALUE = {1: 285_000, 2: 485_000, 3: 128_000, 4: 785_000, 5: 210_000}
FALLBACK_HOME_GROWTH = {
    1: [0.048, 0.038, 0.142, 0.085, -0.012, 0.022, 0.018],
    2: [0.055, 0.062, 0.198, 0.092, -0.028, 0.031, 0.025],
    3: [0.032, 0.025, 0.118, 0.075, 0.008, 0.015, 0.012],
    4: [0.072, 0.048, 0.245, 0.105, -0.058, 0.018, 0.035],
    5: [0.038, -0.015, 0.128, 0.095, 0.022, 0.028, 0.020],
}
RENTAL_YIELD = {1: 0.042, 2: 0.038, 3: 0.068, 4: 0.032, 5: 0.062}
NAICS_TO_INDUSTRY = {
    "722": "food_service", "812": "personal_care", "541": "professional_services",
    "621": "healthcare_solo", "236": "construction", "238": "construction",
    "441": "retail_trade", "531": "real_estate_rental", "811": "construction",
    "484": "transportation_gig", "511": "professional_services",
    "523": "professional_services", "611": "professional_services",
    "711": "professional_services", "999": "retail_trade",
}
EDUCATION_LEVELS = ["no_hs", "hs_diploma", "some_college", "associates", "bachelors", "masters",
                    "professional", "doctorate"]
EDUCATION_FALLBACK = {"no_hs": 0.09, "hs_diploma": 0.27, "some_college": 0.20,
                      "associates": 0.09, "bachelors": 0.22, "masters": 0.09,
                      "professional": 0.02, "doctorate": 0.02}
