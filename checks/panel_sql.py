"""The panel and every feature phase as plain SQL: the independent side of the check.

``with_ctes("core", query)`` prefixes a query with the chain it needs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscope import vocab as V

EPS = "1e-9"


def quote(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else str(x)
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def nz(c: str, fill="0") -> str:
    return f"coalesce({c}, {fill})"


def clip(x: str, lo=None, hi=None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {float(lo)}::DOUBLE)"
    if hi is not None:
        out = f"least({out}, {float(hi)}::DOUBLE)"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {out} END)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def total(cols) -> str:
    return "(" + " + ".join(nz(c, "0.0::DOUBLE") for c in cols) + ")"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / (abs({b}) + {EPS}::DOUBLE))"


def log1p0(c: str) -> str:
    return f"ln(1.0::DOUBLE + greatest(coalesce({c}, 0.0::DOUBLE), 0.0::DOUBLE))"


def norm01(x: str, lo: float, hi: float) -> str:
    return clip(f"(({x}) - {float(lo)}::DOUBLE) / ({float(hi) - float(lo)}::DOUBLE + {EPS}::DOUBLE)", 0, 1)


def entropy(cols) -> str:
    parts = [f"greatest(coalesce({c}, 0.0::DOUBLE), 0.0::DOUBLE)" for c in cols]
    s = "(" + " + ".join(parts) + ")"
    terms = " + ".join(f"(CASE WHEN {p} > 0 THEN -({p} / {s}) * log2({p} / {s}) ELSE 0 END)"
                       for p in parts)
    return f"(CASE WHEN {s} > 0 THEN floor(({terms}) * 1e10 + 0.5) / 1e10 ELSE 0 END)"


def digit(c: str) -> str:
    """First digit read from the decimal text of the number."""
    return (f"(CASE WHEN abs({c}) >= 1 THEN "
            f"CAST(substr(CAST(CAST(trunc(abs({c})) AS HUGEINT) AS VARCHAR), 1, 1) AS INT) END)")


def benford(counts: list[str], n: str) -> str:
    terms = " + ".join(
        f"power(({k}) / (({n}) + {EPS}) - {e}, 2) / {e}" for k, e in zip(counts, V.BENFORD))
    return f"(CASE WHEN ({n}) >= 3 THEN {terms} ELSE 0 END)"


def row_benford(digits) -> str:
    counts = ["(" + " + ".join(flag(f"{d} = {k}") for d in digits) + ")::DOUBLE"
              for k in range(1, 10)]
    n = "(" + " + ".join(flag(f"{d} IS NOT NULL") for d in digits) + ")::DOUBLE"
    return benford(counts, n)


def round_ratio(cols) -> str:
    ws = [f"CAST(trunc(abs(coalesce({c}, 0))) AS BIGINT)" for c in cols]
    hits = "(" + " + ".join(flag(f"{w} <> 0 AND {w} % 100 = 0") for w in ws) + ")"
    n = "(" + " + ".join(flag(f"{w} <> 0") for w in ws) + ")"
    return f"(CASE WHEN {n} > 0 THEN {hits} / ({n} + {EPS}) ELSE 0 END)"


def effective_rate(x: str) -> str:
    parts, lo = [], 0
    for top, rate in V.EFFECTIVE_BRACKETS:
        part = f"greatest({x} - {float(lo)}::DOUBLE, 0.0::DOUBLE)"
        if top is not None:
            part = f"least({part}, {float(top - lo)}::DOUBLE)"
            lo = top
        parts.append(f"{part} * {rate}::DOUBLE")
    return f"(CASE WHEN {x} > 0 THEN ({' + '.join(parts)}) / {x} ELSE 0 END)"


def band(x: str) -> str:
    arms = []
    for i, label in enumerate(V.INCOME_BANDS):
        lo = V.INCOME_EDGES[i]
        hi = V.INCOME_EDGES[i + 1] if i + 1 < len(V.INCOME_EDGES) else None
        arms.append(f"WHEN {x} >= {lo}" + (f" AND {x} < {hi}" if hi else "") + f" THEN '{label}'")
    return f"(CASE {' '.join(arms)} ELSE 'UNKNOWN' END)"


def r(expr: str, name: str, places: int = 6) -> str:
    """Rounded value under a name; see :func:`steady` for the shift."""
    return f"floor(CAST({expr} AS DOUBLE) * 1e{places} + 0.5001) / 1e{places} AS {name}"


def steady(c, places: int = 6):
    """The same rounding on the Spark side.

    Engines break decimal ties differently and sum in different orders; the small
    shift puts ties on one side in both.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * float(f"1e{places}") + 0.5001) / float(f"1e{places}")


def uniform(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)"


def drawn(digest: str, size: str) -> str:
    """Whole number below ``size`` by integer arithmetic on 52 bits."""
    return f"CAST((('0x' || substr({digest}, 1, 13))::HUGEINT * {size}) // 4503599627370496 AS BIGINT)"


def digest(seed, *cols) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


# --------------------------------------------------------------------- fixtures
SALES = """
sales AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
         CAST(year(o_orderdate) + 24 AS INTEGER) AS tax_year, l_suppkey, l_linenumber AS ln,
         l_returnflag AS rf, l_linestatus AS ls,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS p,
         CAST(round(l_discount * 100) AS BIGINT) AS d,
         CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(round(l_quantity) AS BIGINT) AS q
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""

WAGE, BIZ = "rf = 'N'", "rf = 'R' AND ls = 'O'"
GIG, RENT = "rf = 'A' AND ls = 'F'", "rf = 'A' AND ls = 'O'"


def amt(x: str, scale: str, name: str, cond: str | None = None) -> str:
    where = f" FILTER (WHERE {cond})" if cond else ""
    return f"CAST(sum({x}){where} AS DOUBLE) / {scale}::DOUBLE AS {name}"


_AMOUNTS = ",\n    ".join([
    amt("p * 25", "1e4", "w2_wages", WAGE), amt("p * 25", "1e4", "gross_receipts", BIZ),
    amt("p * d * 2", "1e4", "cogs", BIZ), amt("p * 25 - p * d * 2", "1e4", "net_se_income", BIZ),
    amt("p * 8", "1e4", "gig_income", GIG), amt("p * 2", "1e4", "gig_expenses", GIG),
    amt("p * 6", "1e4", "gig_net", GIG), amt("p * 10", "1e4", "rental_gross", RENT),
    amt("p * (t - 3)", "1e4", "rental_net", RENT),
    f"count(*) FILTER (WHERE {RENT}) AS n_rental_units",
    amt("p * t * 5", "1e5", "dividends", "q > 40"),
    amt("p * (d - 2) * 5", "1e5", "capital_gains_lt", "q < 10"),
    amt("p * t", "1e5", "interest_income", "q BETWEEN 20 AND 25"),
    amt("p * 25 * d", "1e6", "sch_c_advertising", "ln = 1"),
    amt("p * 25 * d", "1e6", "sch_c_car_truck", "ln = 2"),
    amt("q * 100", "1", "sch_c_meals", "ln = 3"),
    amt("p * 25 * d", "1e6", "sch_c_home_office", "ln = 4"),
    amt("p * 25 * d", "1e6", "sch_c_wages", "ln = 5"),
    amt("p * 25 * t", "1e6", "sch_c_depreciation", "ln = 6"),
    amt("p * 3", "1e4", "crypto_proceeds", "ln = 7"),
    amt("p * d", "1e4", "crypto_cost_basis", "ln = 7"),
    amt("p", "1e4", "foreign_income", "ln = 1"),
    amt("p * 4", "1e4", "social_security_income", "ln = 2"),
    amt("p * d * 5", "1e5", "ded"), amt("p * d * 3", "1e5", "itemized_mortgage_int"),
    amt("p * 25 * t", "1e6", "tax"), amt("p * 45 * d", "1e6", "federal_withheld", WAGE),
    amt("p * 50 * d", "1e6", "federal_withheld_total", WAGE),
    amt("q * 10", "1", "total_credits"), amt("q * 7", "1", "utility_cost_estimated"),
    amt("p * 5", "1e4", "hidden"),
])
_SEG = {"AUTOMOBILE": "pure_w2", "BUILDING": "business_owner", "FURNITURE": "w2_with_side_biz",
        "HOUSEHOLD": "retired"}
_REG = {0: "California", 1: "Florida", 2: "Texas", 3: "New York", 4: "Illinois"}
_STREAMS = total(V.INCOME_SOURCES)

PANEL = f"""
grouped AS (
  SELECT o_custkey AS k, tax_year, min(l_suppkey) AS employer,
    {_AMOUNTS},
    CAST(sum(q) AS DOUBLE) AS sq, sum(d) AS sd, sum(t) AS st, count(*) AS cnt,
    max(o_totalprice) AS top, max({flag("o_orderstatus = 'F'")}) AS any_f
  FROM sales GROUP BY o_custkey, tax_year),
labelled AS (
  SELECT g.*, c_mktsegment, n_regionkey, {_STREAMS} AS streams,
    CASE WHEN k % 37 <> 0 THEN greatest(0.0::DOUBLE, {_STREAMS}) END AS agi,
    CASE WHEN k % 29 = 0 THEN 0.0::DOUBLE ELSE tax END AS total_tax_liability,
    ded + 12000.0::DOUBLE AS deduction_taken,
    {flag("any_f = 1 AND sd * 10 > cnt * 52")} AS fraud_label
  FROM grouped g JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey),
panel AS (
  SELECT CAST(k AS VARCHAR) AS person_id, tax_year, n_regionkey + 1 AS zone,
    {case_map("n_regionkey", _REG)} AS state,
    {case_map("c_mktsegment", _SEG, "'pure_se'")} AS taxpayer_type,
    CASE WHEN k % 19 <> 0 THEN CAST(employer AS VARCHAR) END AS employer_id,
    CASE WHEN k % 23 <> 0 THEN CAST(18 + k % 60 + tax_year - 2019 AS INTEGER) END AS age,
    {case_map("k % 5", dict(enumerate(V.FILING_STATUSES)))} AS filing_status,
    CAST(2019 + k % 7 AS VARCHAR) AS entry_cohort,
    {flag("tax_year = 2019 + k % 7")} AS first_year_filing,
    w2_wages, gross_receipts, cogs, net_se_income, gig_income, gig_expenses, gig_net,
    rental_gross, rental_net, n_rental_units, dividends, capital_gains_lt, interest_income,
    {", ".join(V.SCHEDULE_C)}, crypto_proceeds, crypto_cost_basis, foreign_income,
    social_security_income, itemized_mortgage_int, deduction_taken, agi,
    agi - deduction_taken AS taxable_income, total_tax_liability,
    total_tax_liability + total_credits AS tax_before_credits, total_credits,
    CASE WHEN k % 31 <> 0 AND agi IS NOT NULL
      THEN least(total_tax_liability / (agi + 1e-9::DOUBLE), 1.2::DOUBLE) END AS effective_tax_rate,
    federal_withheld, federal_withheld_total, utility_cost_estimated,
    least(100.0::DOUBLE, CAST(sd AS DOUBLE) * 10 / cnt) AS irs_risk_score,
    top / ((sq / cnt) * (sq / cnt) * (sq / cnt)) AS bank_deposit_ratio,
    sq / cnt / 25 AS lifestyle_income_ratio,
    CAST(st AS DOUBLE) * 0.3::DOUBLE / cnt AS utility_income_ratio,
    {flag("gross_receipts IS NOT NULL")} AS has_schedule_c,
    {flag("gig_income IS NOT NULL")} AS has_gig, {flag("k % 2 = 0")} AS has_rental,
    {flag("k % 3 = 0")} AS has_crypto, {flag("k % 7 = 0")} AS has_foreign_account,
    {flag("deduction_taken > 30000")} AS uses_itemized, fraud_label,
    CASE WHEN fraud_label = 1 THEN {case_map("k % 17", dict(enumerate(V.SCENARIOS)))}
      ELSE 'none' END AS fraud_type,
    CASE WHEN fraud_label = 1 THEN
      {case_map("k % 17", {i: V.SCENARIO_CATEGORY[s] for i, s in enumerate(V.SCENARIOS)})}
      ELSE 'none' END AS fraud_category,
    hidden AS evasion_amount,
    hidden / (hidden + greatest(streams, 0.0::DOUBLE) + 1) AS evasion_rate
  FROM labelled)"""

# ------------------------------------------------------------- phase 1: clean
_FILL = ",\n    ".join(
    ["coalesce(taxpayer_type, 'UNKNOWN') AS taxpayer_type", "coalesce(state, 'UNKNOWN') AS state"]
    + [f"coalesce({c}, 0.0::DOUBLE) AS {c}"
       for c in dict.fromkeys(V.ZERO_FILLED + V.INCOME_SOURCES)])
_IMPUTED = ["agi", "age"] + [s for s in V.SIGNALS if s != "deduction_income_ratio"]


def _imp(c: str, last: str | None = None) -> str:
    tail = f", {last}" if last else ""
    return f"coalesce(f.{c}, mt.{c}, my.{c}{tail})"


CLEAN = f"""
filled AS (
  SELECT * REPLACE (coalesce(agi, nullif({_STREAMS}, 0)) AS agi), agi AS agi_raw FROM (
    SELECT * REPLACE ({_FILL}) FROM panel)),
med_type AS (
  SELECT tax_year, taxpayer_type, {", ".join(f"median({c}) AS {c}" for c in _IMPUTED)}
  FROM filled GROUP BY ALL),
med_year AS (
  SELECT tax_year, median(agi_raw) AS agi,
    {", ".join(f"median({c}) AS {c}" for c in _IMPUTED[1:])}
  FROM filled GROUP BY ALL),
imputed AS (
  SELECT f.* REPLACE ({_imp("agi")} AS agi), mt.age AS mta, my.age AS mya,
    {", ".join(f"mt.{c} AS mt_{c}, my.{c} AS my_{c}" for c in _IMPUTED[2:])}
  FROM filled f LEFT JOIN med_type mt USING (tax_year, taxpayer_type)
  LEFT JOIN med_year my ON my.tax_year = f.tax_year),
signalled AS (
  SELECT *, {log1p0("bank_deposit_ratio")} AS bank_deposit_ratio_log,
    power({log1p0("bank_deposit_ratio")}, 2) AS bank_deposit_ratio_sq_log,
    {flag("bank_deposit_ratio > 100")} AS flag_bank_deposit_extreme,
    {flag("bank_deposit_ratio > 10")} AS flag_bank_deposit_high,
    {flag("irs_risk_score > 67")} AS flag_irs_high,
    {flag("irs_risk_score > 97.5")} AS flag_irs_very_high,
    {flag("irs_risk_score BETWEEN 51 AND 67")} AS flag_irs_moderate,
    {nz("irs_risk_score")} * {nz("irs_risk_score")} / 10000::DOUBLE AS irs_risk_score_sq,
    {log1p0("federal_withheld")} AS federal_withheld_log,
    {clip(ratio(nz("federal_withheld", "0.0::DOUBLE"), "agi"), -0.5, 1)} AS withholding_rate,
    {flag(nz("federal_withheld") + " < 500 AND agi > 20000")} AS flag_low_withholding,
    6.0::DOUBLE - least(greatest({nz("zone", "3")}, 1), 5) AS zone_risk,
    {_STREAMS} AS gross_reconstructed_income_sum
  FROM imputed),
mismatched AS (
  SELECT *, {clip("gross_reconstructed_income_sum - agi", -1e6, 1e6)} AS gross_income_mismatch,
    {clip(ratio(nz("deduction_taken", "0.0::DOUBLE"), "agi"), 0, 5)} AS deduction_income_ratio
  FROM signalled),
completed AS (
  SELECT * REPLACE (
    coalesce(effective_tax_rate, {clip(ratio(nz("total_tax_liability", "0.0::DOUBLE"), "agi"), 0, 0.65)})
      AS effective_tax_rate,
    coalesce(age, mta, mya, 45.0) AS age,
    {", ".join(f"coalesce({c}, mt_{c}, my_{c}) AS {c}" for c in _IMPUTED[2:])}),
    {clip(ratio("abs(gross_income_mismatch)", "agi"), 0, 5)} AS gross_income_mismatch_ratio
  FROM mismatched),
clipped AS (
  SELECT * REPLACE ({", ".join(f"{clip(f'CAST({c} AS DOUBLE)', lo, hi)} AS {c}"
                               for c, (lo, hi) in V.CLIP_BOUNDS.items())}) FROM completed),
clean AS (
  SELECT * EXCLUDE (agi_raw, mta, mya, {", ".join(f"mt_{c}, my_{c}" for c in _IMPUTED[2:])})
    REPLACE (least({nz("taxable_income", "0.0::DOUBLE")}, agi) AS taxable_income,
             least({nz("total_tax_liability", "0.0::DOUBLE")}, agi) AS total_tax_liability),
    {effective_rate("agi")} AS expected_tax_rate
  FROM clipped)"""

# -------------------------------------------------------------- phase 2: core
_SCH = V.SCHEDULE_C
_A = f"(abs(agi) + {EPS}::DOUBLE)"


def _plus1(a: str, b: str, lo, hi) -> str:
    return clip(f"({a}) / nullif(({b}) + 1, 0)", lo, hi)


def _n(c: str) -> str:
    return f"coalesce({c}, 0.0::DOUBLE)"


CORE = f"""
core1 AS (
  SELECT *,
    {clip("lifestyle_income_ratio * agi - agi", -1e6, 5e6)} AS absolute_lifestyle_gap,
    {clip("bank_deposit_ratio * agi - agi", -1e6, 25e6)} AS bank_deposit_gap,
    {clip("lifestyle_income_ratio * agi", 0, 1e7)} AS absolute_lifestyle_spend,
    {clip("lifestyle_income_ratio + bank_deposit_ratio_log", 0, 30)} AS lifestyle_deposit_combined,
    {band("agi")} AS income_band,
    {clip("expected_tax_rate - effective_tax_rate", -0.5, 0.5)} AS tax_rate_gap,
    {clip(f"effective_tax_rate / (expected_tax_rate + {EPS}::DOUBLE)", 0, 2)} AS bracket_rate_ratio,
    {clip("abs(effective_tax_rate - " + clip(ratio("total_tax_liability", "agi"), 0, 1) + ")", 0, 1)}
      AS effective_rate_consistency_error,
    1.0::DOUBLE - {clip("withholding_rate", 0, 1)} AS low_withholding_indicator,
    {flag("agi > 100000 AND effective_tax_rate < 0.08 AND deduction_taken < agi * 0.20::DOUBLE")}
      AS progressive_anomaly,
    {total(_SCH)} AS sch_c_total_expenses
  FROM clean),
core AS (
  SELECT *,
    {clip(ratio("bank_deposit_gap", "agi"), -5, 500)} AS bank_deposit_gap_ratio,
    {log1p0(clip(ratio("bank_deposit_gap", "agi"), -5, 500))} AS bank_deposit_gap_ratio_log,
    {clip("bank_deposit_gap - deduction_taken", -1e6, 25e6)} AS unexplained_cash_proxy,
    {clip(ratio("tax_rate_gap", "expected_tax_rate"), -2, 2)} AS tax_rate_gap_ratio,
    {clip("tax_rate_gap * agi", -5e5, 1e6)} AS underpayment_proxy,
    {clip(ratio("deduction_taken", "agi") + " * 1000", 0, 2000)} AS deduction_per_1k_agi,
    {clip(ratio("deduction_taken", "agi"), 0, 5)} AS net_deduction_rate,
    {clip(f"sch_c_total_expenses / (gross_receipts + {EPS}::DOUBLE)", 0, 10)} AS sch_c_to_revenue_ratio,
    {clip(f"sch_c_meals / (gross_receipts + {EPS}::DOUBLE)", 0, 5)} AS meals_to_revenue_ratio,
    {clip(f"sch_c_car_truck / (gross_receipts + {EPS}::DOUBLE)", 0, 5)} AS car_to_revenue_ratio,
    {flag("sch_c_home_office > 0 AND w2_wages > 0 AND net_se_income = 0")} AS home_office_w2_flag,
    {flag("sch_c_total_expenses > 500 AND gross_receipts = 0")} AS phantom_business_flag,
    {flag("net_se_income < -1000")} AS se_perpetual_loss,
    {clip(f"greatest({', '.join(_SCH)}) / (sch_c_total_expenses + {EPS}::DOUBLE)", 0, 1)} AS expense_concentration,
    {entropy(_SCH)} AS expense_entropy,
    {clip(f"w2_wages / {_A}", 0, 1)} AS w2_share_of_agi,
    {clip(f"net_se_income / {_A}", -0.5, 1)} AS se_share_of_agi,
    {clip(f"gig_net / {_A}", 0, 1)} AS gig_share_of_agi,
    {clip(f"rental_net / {_A}", -0.5, 1)} AS rental_share_of_agi,
    {clip(f"(dividends + capital_gains_lt + interest_income) / {_A}", 0, 1)} AS investment_share_of_agi,
    {" + ".join(flag(f"{c} > 0") for c in V.INCOME_SOURCES)} AS income_stream_count,
    {entropy(V.INCOME_SOURCES)} AS income_entropy,
    {clip(f"greatest({', '.join(V.INCOME_SOURCES)}) / {_A}", 0, 1)} AS income_concentration,
    {flag("gross_receipts > 0")} AS has_cash_business,
    {clip(f"gross_receipts / {_A}", 0, 5)} AS cash_business_dominance,
    {flag("net_se_income < -1000 AND w2_wages > 0")} AS se_loss_offsetting_w2,
    {flag(f"taxpayer_type = 'pure_w2' AND (gig_net / {_A} > 0.10 OR net_se_income / {_A} > 0.10)")}
      AS income_type_mismatch,
    {flag("w2_wages > agi + 100")} AS impossible_w2_exceeds_agi,
    {flag("deduction_taken > agi + 100")} AS deduction_exceeds_agi,
    {flag("total_tax_liability < 0 AND agi > 100000")} AS impossible_negative_tax_high_income,
    {flag("effective_tax_rate > 1.0")} AS impossible_rate_above_one,
    {clip("sch_c_total_expenses * " + flag("gross_receipts = 0"), 0, 1e6)} AS expense_without_revenue_amount,
    CASE WHEN gross_receipts > 0 THEN {clip(f"(gross_receipts - sch_c_total_expenses) / (gross_receipts + {EPS}::DOUBLE)", -2, 1)} END
      AS business_profit_margin,
    {flag(f"gross_receipts > 0 AND (gross_receipts - sch_c_total_expenses) / (gross_receipts + {EPS}::DOUBLE) < -0.1")}
      AS negative_margin_flag,
    {clip("abs(taxable_income - (agi - deduction_taken))", 0, 1e6)} AS taxable_income_error,
    {clip(ratio(clip("abs(taxable_income - (agi - deduction_taken))", 0, 1e6), "agi"), 0, 5)} AS taxable_income_error_ratio,
    {clip("abs(total_tax_liability - taxable_income * effective_tax_rate)", 0, 5e5)} AS tax_liability_error,
    {_plus1(_n("total_credits"), "agi", -5, 5)} AS credit_to_income,
    {_plus1(_n("itemized_mortgage_int"), "agi", 0, 5)} AS debt_to_income,
    {_plus1(_n("itemized_mortgage_int"), "agi", 0, 5)} AS mortgage_leverage_ratio,
    {_plus1(_n("total_credits"), _n("tax_before_credits"), 0, 5)} AS credit_dependency_index,
    {_plus1("deduction_taken", "w2_wages + gross_receipts + " + _n("gig_income") + " + " + _n("rental_gross") + " + " + _n("crypto_proceeds"), 0, 10)}
      AS deduction_aggression_score,
    {_plus1(_n("cogs"), "gross_receipts", 0, 5)} AS cogs_to_receipts_ratio,
    {_plus1("sch_c_wages", "gross_receipts", 0, 5)} AS sch_c_wages_to_revenue,
    {_plus1(_n("gig_expenses"), _n("gig_income"), 0, 10)} AS gig_expense_ratio,
    {_plus1(_n("crypto_cost_basis"), _n("crypto_proceeds"), 0, 20)} AS crypto_loss_shield_ratio,
    {_plus1(_n("utility_cost_estimated"), _n("n_rental_units"), 0, 50000)} AS utility_cost_per_rental_unit,
    {_plus1("dividends + interest_income", "agi", 0, 5)} AS passive_income_density,
    least(greatest(has_schedule_c * first_year_filing, 0), 1)::DOUBLE AS new_business_interaction,
    {_plus1(_n("federal_withheld_total"), "w2_wages", 0, 2)} AS w2_withholding_accuracy,
    tax_year - 2019 AS years_since_base,
    {flag("tax_year IN (2020, 2021)")} AS is_covid_year,
    {flag("tax_year IN (2024, 2025)")} AS is_recent_year,
    CASE WHEN age > 0 AND age <= 25 THEN 'under_25' WHEN age > 25 AND age <= 35 THEN '25_35'
         WHEN age > 35 AND age <= 50 THEN '35_50' WHEN age > 50 AND age <= 65 THEN '50_65'
         WHEN age > 65 AND age <= 200 THEN 'over_65' END AS age_group,
    {flag("age BETWEEN 60 AND 70")} AS is_near_retirement,
    {flag("age < 30 AND agi > 150000")} AS is_young_high_earner,
    {flag("age > 65 AND net_se_income > 50000")} AS retired_high_se_income
  FROM core1)"""

# ------------------------------------------------ phase 3: learned statistics
_RATE = f"(n * raw + {V.SMOOTHING_WEIGHT} * mu) / (n + {V.SMOOTHING_WEIGHT})"
STATS = f"""
train AS (SELECT * FROM core WHERE tax_year BETWEEN 2019 AND 2023),
pool AS (SELECT avg(fraud_label) AS mu,
    {", ".join(f"stddev_samp({f}) AS {f}" for f in V.PEER_FEATURES)} FROM train),
peers AS (
  SELECT * EXCLUDE (mu, {", ".join(f"g_{f}" for f in V.PEER_FEATURES)}) REPLACE ({", ".join(f"coalesce({f}_std, g_{f}, 1.0) AS {f}_std" for f in V.PEER_FEATURES)}),
    (peer_group_size * raw_peer_fraud_rate + 10 * mu) / (peer_group_size + 10) AS peer_fraud_rate
  FROM (SELECT income_band, taxpayer_type, state, count(fraud_label) AS peer_group_size,
      avg(fraud_label) AS raw_peer_fraud_rate,
      {", ".join(f"avg({f}) AS {f}_mean, stddev_samp({f}) AS {f}_std, "
                 f"median({f}) AS {f}_median, quantile_cont({f}, 0.95) AS {f}_p95"
                 for f in V.PEER_FEATURES)}
    FROM train GROUP BY ALL),
    (SELECT mu, {", ".join(f"{f} AS g_{f}" for f in V.PEER_FEATURES)} FROM pool)),
employers AS (
  SELECT employer_id, raw AS raw_employer_fraud_rate, n AS employer_n_employees,
    {_RATE} AS employer_fraud_rate
  FROM (SELECT employer_id, avg(fraud_label) AS raw, count(fraud_label) AS n FROM train
        WHERE employer_id IS NOT NULL GROUP BY ALL), (SELECT mu FROM pool)),
rates AS (
  SELECT dim, key, n, {_RATE} AS rate FROM (
    {" UNION ALL ".join(f"SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS key, count(*) AS n, "
                        f"avg(fraud_label) AS raw FROM train GROUP BY ALL" for d in V.RATE_DIMS)}),
    (SELECT mu FROM pool)
  UNION ALL SELECT 'global', 'all', (SELECT count(*) FROM train), mu FROM pool)"""

# --------------------------------------------------- phases 4, 5 (rows) and 7
_Z = V.Z_FEATURES
_W = "PARTITION BY tax_year, income_band, taxpayer_type, state"


def _pct(f: str) -> str:
    """Mean of the lowest and highest position of the ties, over the group size."""
    return (f"CASE WHEN {f} IS NULL THEN 50.0 ELSE (rank() OVER ({_W} ORDER BY {f}) "
            f"+ (count(*) OVER ({_W}, {f}) - 1) / 2.0) / count({f}) OVER ({_W}) * 100 END AS pct_{f}")


_WT = sum(V.Z_WEIGHTS.values())
_FLAGS = {
    "flag_phantom_business": "sch_c_total_expenses > 500 AND gross_receipts = 0",
    "flag_hobby_loss_risk": "net_se_income < -5000 AND gross_receipts > 0",
    "flag_impossible_deductions": "deduction_taken > agi * 2 AND agi > 5000",
    "flag_zero_tax_with_income": "total_tax_liability < 100 AND agi > 75000",
    "flag_progressive_anomaly": "agi > 150000 AND effective_tax_rate < 0.06 "
                                "AND deduction_taken < agi * 0.20::DOUBLE",
    "flag_high_bank_deposits": "bank_deposit_ratio > 50 AND agi > 10000",
    "flag_unexplained_wealth": "unexplained_wealth_ratio > 10",
    "flag_benford_violation": "benford_deviation_expenses > 3",
}
_COUNTED = [f for f in V.SIGNAL_FLAGS if f not in V.UNCOUNTED_FLAGS] + V.IMPOSSIBILITY_FLAGS

EVIDENCE = f"""
zed AS (
  SELECT c.*, p.peer_group_size, p.raw_peer_fraud_rate,
    {", ".join(_pct("c." + f).replace("pct_c.", "pct_") for f in V.RANKED)},
    {", ".join(f"{clip(f'(c.{f} - p.{f}_mean) / coalesce(nullif(p.{f}_std, 0), 1.0)', -5, 5)} AS z_{f}" for f in _Z)},
    coalesce(p.peer_fraud_rate, mu) AS peer_fraud_rate,
    coalesce(rs.rate, mu) AS state_fraud_rate, coalesce(rt.rate, mu) AS ttype_fraud_rate,
    coalesce(rb.rate, mu) AS band_fraud_rate, coalesce(ry.rate, mu) AS year_fraud_rate
  FROM core c LEFT JOIN peers p USING (income_band, taxpayer_type, state)
  LEFT JOIN rates rs ON rs.dim = 'state' AND rs.key = c.state
  LEFT JOIN rates rt ON rt.dim = 'taxpayer_type' AND rt.key = c.taxpayer_type
  LEFT JOIN rates rb ON rb.dim = 'income_band' AND rb.key = c.income_band
  LEFT JOIN rates ry ON ry.dim = 'tax_year' AND ry.key = CAST(c.tax_year AS VARCHAR),
  (SELECT mu FROM pool)),
zsum AS (
  SELECT *, {" + ".join(flag(f"abs(z_{f}) > 2") for f in _Z)} AS n_z_above_2,
    {" + ".join(flag(f"abs(z_{f}) > 3") for f in _Z)} AS n_z_above_3,
    greatest({", ".join(f"abs(z_{f})" for f in _Z)}) AS max_z_score,
    list_avg([{", ".join(f"abs(z_{f})" for f in _Z)}]) AS mean_abs_z,
    {clip("(" + " + ".join(f"coalesce(z_{f}, 0) * {w}" for f, w in V.Z_WEIGHTS.items()) + f") / {_WT}", -5, 5)}
      AS composite_z_score,
    {", ".join(f"{digit(c)} AS dg{i}" for i, c in enumerate(_SCH))}
  FROM zed),
forensic AS (
  SELECT * EXCLUDE ({", ".join(f"dg{i}" for i in range(6))}),
    {row_benford([f"dg{i}" for i in range(6)])} AS benford_deviation_expenses,
    {round_ratio(_SCH)} AS round_number_ratio,
    {clip("agi - total_tax_liability - absolute_lifestyle_spend", -2e6, 2e6)} AS net_worth_growth_proxy,
    {clip("bank_deposit_ratio * agi - agi", -1e6, 25e6)} AS cash_t_method_gap,
    {clip(ratio(clip("bank_deposit_ratio * agi - agi", -1e6, 25e6), "agi"), -5, 300)} AS cash_t_method_gap_ratio,
    {clip("0.40::DOUBLE * " + clip("lifestyle_income_ratio", 0, 5) + " + 0.35::DOUBLE * "
          + clip("bank_deposit_ratio", 0, 5) + " + 0.25::DOUBLE * "
          + clip(nz("utility_income_ratio"), 0, 2) + " * 2", 0, 5)} AS lifestyle_asset_score,
    {clip("greatest(0.0::DOUBLE, absolute_lifestyle_spend + bank_deposit_ratio * agi - agi)", 0, 25e6)}
      AS unexplained_wealth_index,
    {clip(ratio(clip("greatest(0.0::DOUBLE, absolute_lifestyle_spend + bank_deposit_ratio * agi - agi)", 0, 25e6), "agi"), 0, 300)}
      AS unexplained_wealth_ratio
  FROM zsum),
flagged AS (SELECT *, {", ".join(f"{flag(c)} AS {f}" for f, c in _FLAGS.items())} FROM forensic),
evidence AS (
  SELECT *, least({" + ".join(_COUNTED)}, 127) AS total_flag_count,
    {flag("flag_impossible_deductions + flag_zero_tax_with_income > 0")} AS has_impossibility,
    {flag("flag_phantom_business + flag_hobby_loss_risk > 0")} AS has_legal_violation,
    {flag("flag_high_bank_deposits + flag_unexplained_wealth > 0")} AS has_lifestyle_anomaly,
    flag_benford_violation AS has_forensic_violation
  FROM flagged)"""

# ----------------------------------------------------------- final composites
_PROBED = sorted(set(V.DIF_WEIGHTS) | set(V.FORENSIC_WEIGHTS) | {"total_flag_count"})


def _stable(c: str) -> str:
    lo, hi = V.NORM_BOUNDS[c]
    return f"(CASE WHEN d_{c} <= 2 THEN {nz(c)} ELSE {norm01(nz(c), lo, hi)} END)"


def _weighted(weights: dict) -> str:
    body = " + ".join(f"{_stable(c)} * {w}" for c, w in weights.items())
    return clip(f"({body}) / {sum(weights.values())}", 0, 1)


_IRS = clip(nz("irs_risk_score"), 0, 100)
SCORED = f"""
probe AS (SELECT tax_year, {", ".join(f"count(DISTINCT coalesce({c}, 0)) AS d_{c}" for c in _PROBED)}
  FROM evidence GROUP BY tax_year),
emp_dist AS (SELECT avg(employer_fraud_rate) AS emu,
  CASE WHEN stddev_samp(employer_fraud_rate) > {EPS} THEN stddev_samp(employer_fraud_rate)
  ELSE 1.0 END AS esd FROM employers),
networked AS (
  SELECT e.*, {", ".join(f"d_{c}" for c in _PROBED)},
    {_weighted(V.DIF_WEIGHTS)} AS dif_proxy_score,
    {_weighted(V.FORENSIC_WEIGHTS)} AS forensic_risk_score,
    coalesce(m.employer_fraud_rate, emu) AS employer_fraud_rate,
    coalesce(m.employer_n_employees, 0) AS employer_n_employees,
    {clip("(coalesce(m.employer_fraud_rate, emu) - emu) / esd", -5, 5)} AS employer_fraud_z_score,
    {flag("coalesce(m.employer_fraud_rate, emu) > 0.30")} AS high_risk_employer,
    {clip("0.50 * coalesce(m.employer_fraud_rate, emu) + 0.30 * peer_fraud_rate + 0.20 * state_fraud_rate", 0, 1)}
      AS network_risk_score
  FROM evidence e JOIN probe USING (tax_year) LEFT JOIN employers m USING (employer_id), emp_dist),
blocked AS (
  SELECT *,
    {clip("0.40 * " + clip("employer_fraud_z_score", 0, 5) + " + 0.35 * "
          + clip(nz("z_lifestyle_income_ratio"), 0, 5) + " + 0.25 * "
          + clip(nz("composite_z_score"), 0, 5), 0, 5)} AS contagion_score,
    {norm01(_IRS, 0, 100)} AS irs_block_score,
    {clip(f"CASE WHEN {_IRS} <= 60 THEN {_IRS} / 60.0::DOUBLE * 0.30::DOUBLE ELSE 0.30::DOUBLE + ({_IRS} - 60.0::DOUBLE) / 40.0::DOUBLE * 0.70::DOUBLE END", 0, 1)}
      AS irs_block_score_nl,
    {norm01("bank_deposit_ratio_log", 0, 14)} AS bank_deposit_block_score,
    {norm01(nz("composite_z_score"), -3, 3)} AS zscore_block_score,
    network_risk_score AS network_block_score,
    1.0::DOUBLE - {norm01(clip(nz("federal_withheld"), 0, 50000), 0, 20000)} AS withholding_block_score,
    forensic_risk_score AS forensic_block_score,
    {_stable("total_flag_count")} AS flag_block_score
  FROM networked),
scored AS (
  SELECT * EXCLUDE ({", ".join(f"d_{c}" for c in _PROBED)}),
    {clip(clip("(" + " + ".join(f"{b} * {w}" for b, w in V.BLOCK_WEIGHTS.items())
               + f") / {sum(V.BLOCK_WEIGHTS.values())}", 0, 1)
          + " + flag_irs_high * flag_bank_deposit_extreme * 0.12 + flag_irs_high * flag_low_withholding * 0.08 + "
          + " + ".join(f"{f} * {b}" for f, b in V.FLAG_BOOSTS.items()), 0, 1)} AS master_fraud_propensity,
    {clip(ratio("deduction_taken", "agi"), 0, 5)} AS deduction_fraud_signal,
    {clip("bank_deposit_ratio_log * (1.0::DOUBLE - " + norm01("agi", 0, 200000) + ")", 0, 10)} AS income_hiding_signal,
    {clip(f"sch_c_total_expenses / (gross_receipts + {EPS}::DOUBLE)", 0, 5)} AS business_suppression_signal,
    {", ".join(f"{flag(f"state = '{s}'")} AS state_{s.lower().replace(' ', '_')}" for s in V.STATES)},
    {", ".join(f"{flag(f"taxpayer_type = '{t}'")} AS tt_{t}" for t in V.TAXPAYER_TYPES)},
    {", ".join(f"{flag(f"age_group = '{a}'")} AS age_{a}" for a in V.AGE_GROUPS)}
  FROM blocked)"""

CHAIN = [("sales", SALES), ("panel", PANEL), ("clean", CLEAN), ("core", CORE), ("stats", STATS),
         ("evidence", EVIDENCE), ("scored", SCORED)]


def with_ctes(upto: str, query: str, extra: str = "") -> str:
    """``query`` behind the CTE chain up to and including stage ``upto``.

    Only the heads that several later stages read are materialised.
    """
    parts = []
    for name, sql in CHAIN:
        parts.append(sql.strip())
        if name == upto:
            break
    if extra:
        parts.append(extra.strip())
    body = ",\n".join(parts)
    for head in ("panel", "core", "evidence", "filled", "peers", "scored"):
        body = body.replace(f"\n{head} AS (", f"\n{head} AS MATERIALIZED (")
    return f"WITH {body}\n{query}"
