"""Queries and SQL twins: links, returns, scenarios, fits, sequences, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.panel_sql import (benford, case_map, clip, digest, digit, flag, r, steady, uniform,
                              with_ctes)
from checks.profile_checks import rnd
from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators import (fit, forensic, links, returns, scenarios, sequences)
from cohortscope.plans.workspace import Workspace
from cohortscope.sources import fixtures

QUERIES, ORACLE = {}, {}
C = F.col


def add(name, upto, sql, extra=""):
    def wrap(fn):
        QUERIES[name] = fn
        ORACLE[name] = with_ctes(upto, sql, extra)
        return fn
    return wrap


_PERSONAS = ["chronic_evader", "escalating", "opportunistic", "late_onset", "one_time"]
_ENTITIES = ["sole_prop", "ccorp", "llc_single", "scorp"]
_OCC = list(V.OCCUPATION_GROWTH) + ["other"]
_YEARS = "(SELECT CAST(2019 + i AS INTEGER) AS y FROM range(7) t(i))"

DIMS = f"""
persons AS (SELECT person_id, zone, taxpayer_type, filing_status, entry_year,
    CASE WHEN k % 4 = 0 THEN 9999 ELSE last_year END AS exit_year,
    CAST(18 + k % 60 AS INTEGER) AS age_at_entry,
    CASE WHEN ever = 0 THEN 'clean' ELSE {case_map("k % 5", dict(enumerate(_PERSONAS)))} END AS fraud_persona,
    {flag("k % 7 = 0")} AS has_foreign_account, {flag("k % 3 = 0")} AS is_crypto_user
  FROM (SELECT person_id, CAST(person_id AS BIGINT) AS k, min(tax_year) AS entry_year,
    max(tax_year) AS last_year, min(zone) AS zone, min(taxpayer_type) AS taxpayer_type,
    min(filing_status) AS filing_status, max(fraud_label) AS ever FROM panel GROUP BY person_id)),
businesses AS (SELECT CAST(s_suppkey AS VARCHAR) AS business_id, n_regionkey + 1 AS zone,
    CAST(2019 + s_suppkey % 5 AS INTEGER) AS open_year,
    CASE WHEN s_suppkey % 3 <> 0 THEN 9999 ELSE CAST(2019 + s_suppkey % 5 + s_suppkey % 4 AS INTEGER) END AS exit_year,
    {case_map("s_suppkey % 9", dict(enumerate(V.INDUSTRIES + ["unlisted"])))} AS industry,
    {case_map("s_suppkey % 4", dict(enumerate(_ENTITIES)))} AS entity_type,
    CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_suppkey % 50 END AS n_employees_base
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
links AS (SELECT CAST(o_custkey AS VARCHAR) AS person_id, CAST(l_suppkey AS VARCHAR) AS business_id,
    min(tax_year) AS link_start, CASE WHEN max(tax_year) = 2025 THEN 9999 ELSE max(tax_year) END AS link_end,
    CAST(sum(p) AS DOUBLE) / count(*) / 100 AS base_salary,
    {case_map("l_suppkey % 10", dict(enumerate(_OCC)))} AS occupation
  FROM sales GROUP BY o_custkey, l_suppkey)"""


# ------------------------------------------------------------------------- links
@add("r1_expand_active_years", "panel", f"""SELECT person_id, y AS tax_year,
  age_at_entry + y - entry_year AS age, {flag("y = entry_year")} AS first_year_filing
  FROM persons, {_YEARS} WHERE y >= entry_year AND y <= exit_year""", DIMS)
def q_expand(spark, sf):
    return links.expand_active_years(Workspace.of(spark, sf).persons).select(
        "person_id", "tax_year", "age", "first_year_filing")


@add("j12_active_links", "panel", f"""SELECT person_id, y AS tax_year, count(*) AS n_active
  FROM links, {_YEARS} WHERE link_start <= y AND (link_end >= y OR link_end = 9999)
  GROUP BY ALL""", DIMS)
def q_active(spark, sf):
    d = links.active_years(Workspace.of(spark, sf).links, "link_start", "link_end")
    return d.groupBy("person_id", "tax_year").agg(F.count(F.lit(1)).alias("n_active"))


@add("r2_j9_j14_attach_links", "panel", f"""
SELECT p.person_id, p.tax_year, f.business_id AS owned_business, b.industry AS owned_industry,
  {r("least(1 + (p.tax_year - open_year) * 0.08::DOUBLE, 1.6)", "maturity")}, f.n AS n_owned_business,
  e.business_id AS first_employer, e.n AS n_first_employer
FROM panel p LEFT JOIN (SELECT * FROM firsts WHERE owned) f USING (person_id, tax_year)
LEFT JOIN (SELECT * FROM firsts WHERE NOT owned) e USING (person_id, tax_year)
LEFT JOIN businesses b ON b.business_id = f.business_id""", DIMS + f""",
firsts AS (SELECT person_id, tax_year, owned, business_id, n FROM (
  SELECT person_id, y AS tax_year, owned, business_id,
    row_number() OVER (PARTITION BY person_id, y, owned ORDER BY link_start, business_id) AS rn,
    count(*) OVER (PARTITION BY person_id, y, owned) AS n
  FROM (SELECT *, CAST(business_id AS BIGINT) % 3 = 0 AS owned FROM links), {_YEARS}
  WHERE link_start <= y AND (link_end >= y OR link_end = 9999)) WHERE rn = 1)""")
def q_attach(spark, sf):
    ws = Workspace.of(spark, sf)
    owned = C("business_id").cast("long") % 3 == 0      # one link in three is ownership
    d = links.attach_links(ws.panel.select("person_id", "tax_year"), ws.links.filter(owned),
                           ws.links.filter(~owned), ws.businesses)
    return rnd(d, maturity=6).select("person_id", "tax_year", "owned_business", "owned_industry",
                                     "maturity", "n_owned_business", "first_employer",
                                     "n_first_employer")


@add("r3_j13_link_overlap", "panel", f"""SELECT person_id, business_id, zone, s AS ownership_start,
  e AS ownership_end, {flag("e = 9999 OR e >= 2024")} AS is_active_owner FROM (
  SELECT l.person_id, l.business_id, p.zone, greatest(entry_year, open_year) AS s,
    CASE WHEN p.exit_year = 9999 AND b.exit_year = 9999 THEN 9999
      ELSE least(CASE WHEN p.exit_year = 9999 THEN 2025 ELSE p.exit_year END,
                 CASE WHEN b.exit_year = 9999 THEN 2025 ELSE b.exit_year END) END AS e
  FROM links l JOIN persons p USING (person_id) JOIN businesses b USING (business_id)
  WHERE p.zone = b.zone) WHERE s <= CASE WHEN e = 9999 THEN 2025 ELSE e END""", DIMS)
def q_overlap(spark, sf):
    ws = Workspace.of(spark, sf)
    return links.link_overlap(ws.links, ws.persons, ws.businesses)


@add("j10_persons_with_links", "panel", """SELECT p.person_id, p.entry_year, count(business_id) AS n_links,
  min(link_start) AS first_start, max(CASE WHEN link_end = 9999 THEN 2025 ELSE link_end END) AS last_end
  FROM persons p LEFT JOIN links l USING (person_id) GROUP BY ALL""", DIMS)
def q_persons_links(spark, sf):
    ws = Workspace.of(spark, sf)
    return links.persons_with_links(ws.persons, ws.links).select(
        "person_id", "entry_year", "n_links", "first_start", "last_end")


@add("j11_prior_year", "panel", f"""SELECT a.person_id, a.tax_year, {r("b.gross_receipts", "prior_receipts", 7)}
  FROM panel a LEFT JOIN panel b ON b.person_id = a.person_id AND b.tax_year = a.tax_year - 1""")
def q_prior(spark, sf):
    d = links.prior_year(Workspace.of(spark, sf).panel, "gross_receipts", "prior_receipts")
    return rnd(d, prior_receipts=7).select("person_id", "tax_year", "prior_receipts")


_GROW = {y: V.INFLATION[y] - (V.COVID_SHOCK[y] * 0.08 if y == 2020 else 0) for y in V.YEARS[1:]}


@add("r4_wage_index", "panel", f"""SELECT person_id, tax_year, floor(sum(pay) * 100 + 0.500001) / 100 AS w2_wages, count(*) AS n_jobs
  FROM (SELECT person_id, y AS tax_year, base_salary * coalesce((
      SELECT exp(sum(ln(1 + g + {case_map("occupation", V.OCCUPATION_GROWTH, str(V.DEFAULT_OCCUPATION_GROWTH))})))
      FROM growth WHERE gy <= y), 1) AS pay
    FROM links, {_YEARS} WHERE link_start <= y AND (link_end >= y OR link_end = 9999)) GROUP BY ALL""",
     DIMS + ", growth AS (SELECT * FROM (VALUES "
     + ", ".join(f"({y}, {g}::DOUBLE)" for y, g in _GROW.items()) + ") t(gy, g))")
def q_wages(spark, sf):
    d = links.yearly_wages(Workspace.of(spark, sf).links)
    # the small shift keeps decimal ties on one side whatever the order of the sum
    return d.withColumn("w2_wages", F.floor(C("w2_wages") * 100 + 0.500001) / 100)


_HAZ = ", ".join(f"('{k}', {2019 + i}, {x}::DOUBLE)" for k, v in V.FAILURE_RATES.items()
                 for i, x in enumerate(v))


@add("r17_survival_curve", "panel", f"""SELECT business_id, e.y AS tax_year,
  {r("exp(sum(ln(1 - coalesce(h, 0.09) * CASE WHEN entity_type IN ('ccorp', 'scorp') THEN 0.6 WHEN entity_type = 'sole_prop' THEN 1.3 ELSE 1.0 END)))", "survival", 8)}
  FROM businesses b, {_YEARS} e, {_YEARS} t LEFT JOIN (VALUES {_HAZ}) hz(ind, hy, h)
    ON hz.hy = t.y AND hz.ind = b.industry
  WHERE e.y >= open_year AND t.y >= open_year AND t.y <= e.y GROUP BY ALL""", DIMS)
def q_survival(spark, sf):
    return rnd(links.survival_curve(Workspace.of(spark, sf).businesses), survival=8)


@add("r16_rule_points", "panel", f"""SELECT person_id, {r(clip("15 + CASE WHEN taxpayer_type IN ('business_owner', 'multi_biz_owner') THEN 18 ELSE 0 END + CASE WHEN taxpayer_type = 'pure_se' THEN 12 ELSE 0 END + CASE WHEN fraud_persona = 'chronic_evader' THEN 35 WHEN fraud_persona IN ('escalating', 'opportunistic') THEN 20 ELSE 0 END + has_foreign_account * 22 + is_crypto_user * 8", 1, 99), "risk_score_base", 2)}
  FROM persons""", DIMS)
def q_points(spark, sf):
    return links.rule_points(Workspace.of(spark, sf).persons).select("person_id",
                                                                     "risk_score_base")


@add("r16_yearly_risk", "panel", f"""SELECT person_id, tax_year, round(round(least(greatest(
  40 + lifestyle_income_ratio * 15, 1), 99), 6)::DECIMAL(18, 6), 1)::DOUBLE AS irs_risk_score_yearly FROM panel""")
def q_yearly_risk(spark, sf):
    d = Workspace.of(spark, sf).panel.withColumn("risk_score_base", F.lit(40.0))
    return links.yearly_risk(d).select("person_id", "tax_year", "irs_risk_score_yearly")


_ALLOW = " OR ".join(f"(taxpayer_type = '{t}' AND fraud_type IN ({', '.join(repr(k) for k in ks)}))"
                     for t, ks in V.ALLOWED_SCENARIOS.items())
_FORBID = " OR ".join(f"(taxpayer_type = '{t}' AND ({' OR '.join(f'coalesce({c}, 0) > 0' for c in cs)}))"
                      for t, cs in V.FORBIDDEN_STREAMS.items())


@add("r8_type_violations", "panel", f"""SELECT person_id, tax_year, a AS bad_scenario, b AS bad_stream FROM (
  SELECT *, {flag(f"fraud_type <> 'none' AND NOT ({_ALLOW})")} AS a, {flag(_FORBID)} AS b FROM panel)
  WHERE a = 1 OR b = 1""")
def q_violations(spark, sf):
    return links.type_violations(Workspace.of(spark, sf).panel).select(
        "person_id", "tax_year", "bad_scenario", "bad_stream")


@add("a28_link_coverage", "panel", f"""SELECT zone, count(*) AS eligible, count(l.person_id) AS covered,
  {r("count(l.person_id) / count(*)", "coverage", 8)}
  FROM persons p LEFT JOIN (SELECT DISTINCT person_id FROM links) l USING (person_id)
  WHERE taxpayer_type IN ('pure_w2', 'w2_with_side_biz') GROUP BY ROLLUP (zone)""", DIMS)
def q_coverage(spark, sf):
    from cohortscope.operators import profile
    ws = Workspace.of(spark, sf)
    return rnd(profile.link_coverage(ws.persons, ws.links, V.W2_TYPES), coverage=8)


# ----------------------------------------------------------------------- returns
_FACTS = ["w2_wages", "net_se_income", "rental_net", "gig_net", "dividends", "capital_gains_lt",
          "interest_income", "foreign_income", "social_security_income", "itemized_mortgage_int"]


def facts(spark, sf):
    """Panel facts in whole cents, with two dependants for some rows."""
    p = Workspace.of(spark, sf).panel
    k = C("person_id").cast("long")
    return p.select("person_id", "tax_year", "zone", "filing_status", "taxpayer_type",
                    "utility_cost_estimated", "evasion_amount",
                    (k % 3).cast("int").alias("n_dep"),
                    *[(F.floor(C(c) * 100) / 100).alias(c) for c in _FACTS])


def m2(x: str) -> str:
    """Money rounding of the library: six places first, then two, halves away from zero."""
    return f"round(CAST(round({x}, 6) AS DECIMAL(24, 6)), 2)::DOUBLE"


def _z(c):
    return f"coalesce({c}, 0.0::DOUBLE)"


_PLAIN = " + ".join(_z(c) for c in ["w2_wages", "net_se_income", "rental_net", "gig_net",
                                    "dividends", "capital_gains_lt"]
                    + ["interest_income", "foreign_income"])
_TOPS = ", ".join(f"({y}, [{', '.join(f'{t}::DOUBLE' for t in tops)}])"
                  for y, tops in V.BRACKET_TOPS.items())
_STD = ", ".join(f"({y}, {s}::DOUBLE, {h}::DOUBLE)" for y, (s, h) in V.STANDARD_DEDUCTION.items())
_WB = ", ".join(f"({y}, {b}::DOUBLE)" for y, b in V.WAGE_BASE.items())


def tax_sql(x: str) -> str:
    parts = []
    for i, rate in enumerate(V.MARGINAL_RATES):
        lo = f"tops[{i}] * sc" if i else "0.0::DOUBLE"
        part = f"{x} - {lo}"
        if i < 6:
            part = f"least({part}, tops[{i + 1}] * sc - {lo})"
        parts.append(f"greatest({part}, 0.0::DOUBLE) * {rate}::DOUBLE")
    return f"round(CAST(round({' + '.join(parts)}, 6) AS DECIMAL(24, 6)), 2)::DOUBLE"


RETURNS = f"""
facts AS (SELECT person_id, tax_year, zone, filing_status, taxpayer_type, utility_cost_estimated,
    evasion_amount, CAST(CAST(person_id AS BIGINT) % 3 AS INTEGER) AS n_dep,
    {", ".join(f"floor({c} * 100) / 100 AS {c}" for c in _FACTS)} FROM panel),
ret1 AS (SELECT f.*, tops, wb, CASE WHEN filing_status IN ('married_joint', 'qualifying_widow') THEN 2.0 ELSE 1.0 END AS sc,
    {m2(_PLAIN + " + " + _z("social_security_income"))} AS total_pre,
    CASE WHEN filing_status IN ('married_joint', 'qualifying_widow') THEN single * 2
      WHEN filing_status = 'head_of_household' THEN head ELSE single END AS standard_deduction,
    CASE WHEN {_z("net_se_income")} > 400 THEN least({_z("net_se_income")}, wb) * 0.153::DOUBLE ELSE 0.0 END AS st
  FROM facts f JOIN (VALUES {_TOPS}) t(ty, tops) ON ty = tax_year
  JOIN (VALUES {_STD}) s(sy, single, head) ON sy = tax_year JOIN (VALUES {_WB}) w(wy, wb) ON wy = tax_year),
ret2 AS (SELECT *, {_z("itemized_mortgage_int")} AS itemized_total, {m2("st")} AS se_tax_amount,
    {m2("st / 2")} AS se_tax_deduction,
    {m2(f"greatest({_z('itemized_mortgage_int')}, standard_deduction)")} AS deduction_taken FROM ret1),
ret3 AS (SELECT *, {m2(f"greatest({_PLAIN} + {_z('social_security_income')} * 0.85::DOUBLE - se_tax_deduction, 0.0::DOUBLE)")} AS agi FROM ret2),
ret4 AS (SELECT *, CASE WHEN taxpayer_type IN ('pure_se', 'w2_with_side_biz', 'business_owner', 'multi_biz_owner')
    THEN {m2(f"least(greatest({_z('net_se_income')}, 0.0::DOUBLE) * 0.20::DOUBLE, agi * 0.20::DOUBLE)")} ELSE 0.0 END AS qbi_deduction FROM ret3),
ret5 AS (SELECT *, {m2("greatest(agi - deduction_taken - qbi_deduction, 0.0::DOUBLE)")} AS taxable_income FROM ret4),
ret6 AS (SELECT *, CASE WHEN taxable_income > 0 THEN {tax_sql("taxable_income")} ELSE 0.0 END AS tax_before_credits FROM ret5),
ret7 AS (SELECT *, CASE WHEN agi > 0 AND agi < 57000 AND {_z("w2_wages")} + {_z("net_se_income")} + {_z("gig_net")} > 0
    AND taxpayer_type NOT IN ('retired', 'investor', 'business_owner')
    THEN least({case_map("n_dep", V.EITC_MAX)}::DOUBLE, tax_before_credits) ELSE 0.0 END AS eitc_credit FROM ret6),
ret8 AS (SELECT *, least(n_dep * 2000.0::DOUBLE, greatest(tax_before_credits - eitc_credit, 0.0::DOUBLE)) AS child_tax_credit FROM ret7),
ret9 AS (SELECT *, {m2("eitc_credit + child_tax_credit")} AS total_credits,
    {m2("greatest(tax_before_credits - (eitc_credit + child_tax_credit), 0.0::DOUBLE)")} AS total_tax_liability,
    {m2(f"least({_z('w2_wages')}, wb) * 0.062::DOUBLE")} AS fica_withheld,
    {m2(f"{_z('w2_wages')} * 0.0145::DOUBLE")} AS medicare_withheld,
    {m2(f"{_z('w2_wages')} * 0.18::DOUBLE")} AS federal_withheld FROM ret8),
returns AS (SELECT *, {flag("itemized_total > standard_deduction")} AS uses_itemized,
    total_tax_liability / greatest(agi, 1.0) AS eff,
    {m2("greatest(federal_withheld - total_tax_liability, 0.0::DOUBLE)")} AS refund_amount,
    {m2("greatest(total_tax_liability - federal_withheld, 0.0::DOUBLE)")} AS balance_due FROM ret9)"""
_RET = ["agi", "deduction_taken", "qbi_deduction", "taxable_income", "tax_before_credits",
        "eitc_credit", "child_tax_credit", "total_credits", "total_tax_liability",
        "se_tax_amount", "fica_withheld", "medicare_withheld", "federal_withheld",
        "refund_amount", "balance_due", "standard_deduction"]


@add("r5_f23_compute_return", "panel", f"""SELECT person_id, tax_year, uses_itemized,
  {", ".join(r(c, c, 2) for c in _RET)} FROM returns""", RETURNS)
def q_return(spark, sf):
    d = returns.compute_return(facts(spark, sf))
    return rnd(d, **dict.fromkeys(_RET, 2)).select("person_id", "tax_year", "uses_itemized", *_RET)


@add("r6_detection_signals", "panel", f"""SELECT person_id, tax_year,
  floor((utility_cost_estimated / greatest(agi * 0.12::DOUBLE, 1.0)) * 1e4 + 0.500001) / 1e4 AS lifestyle_income_ratio,
  floor(((agi + evasion_amount) / greatest(agi, 1.0)) * 1e4 + 0.500001) / 1e4 AS bank_deposit_ratio,
  floor((deduction_taken / greatest(agi, 1.0)) * 1e4 + 0.500001) / 1e4 AS deduction_income_ratio,
  round(floor(eff * 1e4 + 0.500001) / 1e4 - {case_map("zone", {1: 0.087, 2: 0.074, 3: 0.091, 4: 0.068, 5: 0.062})}::DOUBLE, 4) AS effective_rate_vs_zone
  FROM returns""", RETURNS)
def q_signals(spark, sf):
    d = returns.detection_signals(returns.compute_return(facts(spark, sf)))
    return d.select("person_id", "tax_year", "lifestyle_income_ratio", "bank_deposit_ratio",
                    "deduction_income_ratio", "effective_rate_vs_zone")


@add("f22_effective_rate", "clean", f"""SELECT person_id, tax_year, {r("expected_tax_rate", "rate", 8)} FROM clean""")
def q_eff(spark, sf):
    return Workspace.of(spark, sf).core_rows.select("person_id", "tax_year", steady(
        E.effective_rate(C("agi")), 8).alias("rate"))


# --------------------------------------------------------------------- scenarios
_SCN = ["w2_wages", "gross_receipts", "cogs", "net_se_income", "gig_net", "rental_net",
        "interest_income", "foreign_income", "capital_gains_lt", "sch_c_meals",
        "sch_c_car_truck", "sch_c_home_office", "sch_c_wages"]


def _scenario_rows(spark, sf):
    p = Workspace.of(spark, sf).panel
    k = C("person_id").cast("long")
    # every scenario occurs: the type comes from the key, not from the label
    return p.select(
        "person_id", "tax_year", "gig_income", "rental_gross", *_SCN,
        E.lookup(k % 18, dict(enumerate(V.SCENARIOS + ["none"]))).alias("fraud_type"),
        ((k % 9 + 1).cast("double") / 10).alias("rate"),
        (k % 1000).cast("double").alias("amount"),
        E.total(V.INCOME_SOURCES).alias("total_pre"))


def _case(*arms, default):
    body = " ".join(f"WHEN scenario IN ({', '.join(repr(n) for n in names)}) THEN {x}"
                    for names, x in arms)
    return f"CASE {body} ELSE {default} END"


def _m(name, c, *arms):
    """The new cents value where a scenario touches the column, else the old one."""
    test = " OR ".join(f"scenario IN ({', '.join(repr(n) for n in names)})" for names, _ in arms)
    return f"CASE WHEN {test} THEN {m2(_case(*arms, default='0'))} ELSE round({c}, 7) END AS {name}"


SCENARIO = f"""
base AS (SELECT person_id, tax_year, {", ".join(f"{c}, {_z(c)} AS z_{c}" for c in _SCN)},
    {_z("gig_income")} AS z_gig_income, {_z("rental_gross")} AS z_rental_gross,
    (k % 9 + 1)::DOUBLE / 10 AS rate, (k % 1000)::DOUBLE AS amount,
    {" + ".join(_z(c) for c in V.INCOME_SOURCES)} AS whole,
    CASE WHEN k % 18 = 16 AND {_z("capital_gains_lt")} <= 0 THEN 'fictitious_deductions'
      ELSE {case_map("k % 18", dict(enumerate(V.SCENARIOS + ["none"])))} END AS scenario
  FROM (SELECT *, CAST(person_id AS BIGINT) AS k FROM panel))"""
_REV = ["revenue_suppression", "cash_skimming"]
_KEPT = "greatest(z_gross_receipts - z_gross_receipts * rate, 0.0::DOUBLE)"
_EXP = "(z_gross_receipts - z_cogs - z_net_se_income)"


@add("r7_inject_scenario", "panel", f"""SELECT person_id, tax_year, scenario,
  {_m("w2_wages", "w2_wages", (["low_salary_scorp"], "z_w2_wages * (1 - rate)")).replace("scenario IN ('low_salary_scorp') THEN round", "scenario IN ('low_salary_scorp') AND z_w2_wages > 0 THEN round")},
  {_m("gross_receipts", "gross_receipts", (_REV, _KEPT))},
  {_m("cogs", "cogs", (["inflated_cogs"], "z_cogs + z_gross_receipts * rate"))},
  {_m("net_se_income", "net_se_income",
      (["farm_income_hidden"], "greatest(z_net_se_income - whole * rate * 0.3::DOUBLE, 0.0::DOUBLE)"),
      (["inflated_cogs"], f"z_gross_receipts - z_cogs - z_gross_receipts * rate - {_EXP}"),
      (_REV, f"{_KEPT} - z_cogs - {_EXP}"),
      (["shell_company_income_shifting"], "greatest(z_net_se_income - greatest(z_net_se_income, 0.0::DOUBLE) * rate, 0.0::DOUBLE)"))},
  {_m("gig_net", "gig_net", (["1099_not_reported"], "greatest(z_gig_net - (z_gig_net + z_interest_income) * rate * 0.6::DOUBLE, 0.0::DOUBLE)"),
      (["gig_income_omitted"], "greatest(z_gig_net * (1 - rate), 0.0::DOUBLE)"))},
  {_m("rental_net", "rental_net", (["rental_income_hidden"], "greatest(z_rental_net - z_rental_gross * rate, 0.0::DOUBLE)"))},
  {_m("interest_income", "interest_income", (["1099_not_reported"], "greatest(z_interest_income - (z_gig_net + z_interest_income) * rate * 0.4::DOUBLE, 0.0::DOUBLE)"))},
  {_m("foreign_income", "foreign_income", (["offshore_hidden"], "greatest(z_foreign_income - z_foreign_income * rate, 0.0::DOUBLE)"))},
  {_m("capital_gains_lt", "capital_gains_lt", (["capital_gains_omit"], "greatest(z_capital_gains_lt - z_capital_gains_lt * rate, 0.0::DOUBLE)"))},
  {_m("sch_c_meals", "sch_c_meals", (["expense_recharacterization"], "z_sch_c_meals + amount * 0.33::DOUBLE"))},
  {_m("sch_c_wages", "sch_c_wages", (["payroll_underreporting", "worker_misclassification"], "greatest(z_sch_c_wages - z_sch_c_wages * rate, 0.0::DOUBLE)"))},
  {m2("greatest(" + _case(
      (["unreported_cash_income"], "whole * rate"),
      (["1099_not_reported"], "(z_gig_net + z_interest_income) * rate"),
      (["gig_income_omitted"], "z_gig_income * rate"), (["rental_income_hidden"], "z_rental_gross * rate"),
      (["farm_income_hidden"], "whole * rate * 0.3::DOUBLE"), (["offshore_hidden"], "z_foreign_income * rate"),
      (["fictitious_deductions", "expense_recharacterization"], "amount"),
      (["inflated_cogs", *_REV], "z_gross_receipts * rate"), (["low_salary_scorp"], "greatest(z_w2_wages, 0.0::DOUBLE) * rate"),
      (["payroll_underreporting"], "z_sch_c_wages * rate"), (["worker_misclassification"], "z_sch_c_wages * rate * 0.0765::DOUBLE"),
      (["shell_company_income_shifting"], "greatest(z_net_se_income, 0.0::DOUBLE) * rate"),
      (["capital_gains_omit"], "z_capital_gains_lt * rate"), default="0.0::DOUBLE") + ", 0.0::DOUBLE)")} AS evasion_amount,
  CASE WHEN scenario = 'fictitious_deductions' THEN amount ELSE 0.0 END AS fictitious_deduction,
  {case_map("scenario", V.SCENARIO_CATEGORY, "'none'")} AS scenario_category FROM base""", SCENARIO)
def q_scenario(spark, sf):
    d = scenarios.inject_scenario(_scenario_rows(spark, sf))
    shown = [c for c in _SCN if c not in ("sch_c_car_truck", "sch_c_home_office")]
    return rnd(d, **dict.fromkeys(shown, 7)).select(
        "person_id", "tax_year", "scenario", *shown, "evasion_amount", "fictitious_deduction",
        "scenario_category")


# --------------------------------------------------------------------------- fits
@add("r9_fit_wages", "sales", f"""SELECT p_brand, {", ".join(r(f"p{x}", f"p{x}", 8) for x in (10, 25, 50, 75, 90))},
  {r("ln(p50)", "log_mean")}, {r("greatest((ln(p75) - ln(p25)) / 1.35, 0.15)", "log_std")},
  {r("n / sum(n) OVER ()", "emp_share", 8)} FROM (SELECT p_brand, count(*) AS n,
  {", ".join(f"quantile_cont(p_retailprice, {x / 100}) AS p{x}" for x in (10, 25, 50, 75, 90))} FROM part GROUP BY ALL)""")
def q_fit_wages(spark, sf):
    d = fit.fit_wages(fixtures.table(spark, sf, "part"), "p_brand", "p_retailprice")
    return rnd(d, p10=8, p25=8, p50=8, p75=8, p90=8, log_mean=6, log_std=6, emp_share=8)


_FITZ = {s: z for z, ss in V.STATE_TO_FIT_ZONE.items() for s in ss}
STATE_INCOME = """
state_income AS (SELECT state, avg(ln(w2_wages)) AS log_mean, stddev_samp(ln(w2_wages)) AS log_std,
  median(w2_wages) AS p50 FROM panel WHERE w2_wages > 0 GROUP BY ALL),
national AS (SELECT avg(ln(w2_wages)) AS nat FROM panel WHERE w2_wages > 0)"""


@add("r10_fit_zone_income", "panel", f"""SELECT CAST(i AS INTEGER) AS zone, {r("log_mean", "log_mean")}, {r("log_std", "log_std")},
  {r("p50", "p50", 5)}, n_states, {r("coalesce(exp(log_mean - nat), " + case_map("i", V.FALLBACK_INCOME_MULTIPLIER) + ")", "income_multiplier")}
  FROM range(1, 6) t(i) LEFT JOIN (SELECT {case_map("state", _FITZ)} AS zone, avg(log_mean) AS log_mean,
    avg(log_std) AS log_std, avg(p50) AS p50, count(*) AS n_states FROM state_income GROUP BY 1) z ON z.zone = i,
  national""", STATE_INCOME)
def q_zone_income(spark, sf):
    p = Workspace.of(spark, sf).panel
    nat = p.filter("w2_wages > 0").agg(F.avg(F.ln("w2_wages"))).first()[0]
    d = fit.fit_zone_income(fit.state_log_income(p, "w2_wages"), nat)
    return rnd(d, log_mean=6, log_std=6, p50=5, income_multiplier=6)


def _homes(spark, sf):
    s = fixtures.businesses(spark, sf)
    return s.select(E.lookup("zone", V.ZONE_TO_STATE).alias("state"),
                    (C("s_acctbal") * 100).alias("home_value"),
                    (2019 + C("business_id").cast("long") % 5).cast("int").alias("year"),
                    (C("s_acctbal") / 100000).alias("growth"))


HOMES = f"""
homes AS (SELECT {case_map("state", _FITZ)} AS zone, home_value, year, growth FROM (
  SELECT {case_map("n_regionkey + 1", V.ZONE_TO_STATE)} AS state, s_acctbal * 100 AS home_value,
    CAST(2019 + s_suppkey % 5 AS INTEGER) AS year, s_acctbal / 100000 AS growth
  FROM supplier JOIN nation ON n_nationkey = s_nationkey))"""


@add("r11_fit_zone_housing", "sales", f"""SELECT CAST(i AS INTEGER) AS zone, {r("hv", "median_home_value", 4)},
  CAST(floor(hv * {case_map("i", V.RENTAL_YIELD)}::DOUBLE / 12) AS BIGINT) AS median_rent_2br FROM (
  SELECT i, coalesce(m, {case_map("i", V.FALLBACK_HOME_VALUE)}::DOUBLE) AS hv FROM range(1, 6) t(i)
  LEFT JOIN (SELECT zone, median(home_value) AS m FROM homes WHERE home_value > 0 GROUP BY ALL) z ON z.zone = i)""", HOMES)
def q_housing(spark, sf):
    return rnd(fit.fit_zone_housing(_homes(spark, sf)), median_home_value=4)


@add("r11_fit_zone_growth", "sales", f"""SELECT CAST(i AS INTEGER) AS zone, y AS year,
  coalesce(round(round_even(m, 4), 4), [{", ".join("[" + ", ".join(map(str, g)) + "]" for g in V.FALLBACK_HOME_GROWTH.values())}][i][y - 2018])::DOUBLE AS growth
  FROM range(1, 6) t(i), {_YEARS} LEFT JOIN (SELECT zone, year, median(growth) AS m FROM homes GROUP BY ALL) g
  ON g.zone = i AND g.year = y""", HOMES)
def q_growth(spark, sf):
    return fit.fit_zone_growth(_homes(spark, sf))


_CODES = list(V.NAICS_TO_INDUSTRY)


@add("r12_fit_industry", "sales", f"""
SELECT d.industry, {r("coalesce(rec, d.receipts)", "median_gross_receipts", 4)},
  {r("coalesce(cg, d.cogs_ratio)", "cogs_ratio")}, {r("coalesce(mg, d.margin)", "net_profit_margin")}
FROM defaults d LEFT JOIN (SELECT {case_map("code", V.NAICS_TO_INDUSTRY)} AS industry,
    arg_max(rec, position) FILTER (WHERE rec > 0) AS rec,
    arg_max(cg, position) FILTER (WHERE cg > 0 AND cg < 1) AS cg, arg_max(mg, position) AS mg
  FROM codes GROUP BY 1) o ON o.industry = d.industry""", f"""
codes AS (SELECT {case_map("p_size % 15", dict(enumerate(_CODES)))} AS code, p_size % 15 AS position,
    round(max(p_retailprice) * 100) AS rec, max(p_size) / 100.0::DOUBLE AS cg, min(p_size) / 50.0::DOUBLE AS mg
  FROM part GROUP BY p_size % 15),
defaults AS (SELECT {case_map("k", dict(enumerate(V.INDUSTRIES)))} AS industry, 1000.0 * (k + 1) AS receipts,
    0.3 AS cogs_ratio, 0.1 AS margin FROM (SELECT DISTINCT p_size % 8 AS k FROM part))""")
def q_industry(spark, sf):
    part = fixtures.table(spark, sf, "part")
    k = C("p_size") % 15
    codes = part.groupBy(k.alias("position")).agg(
        F.round(F.max("p_retailprice") * 100).alias("avg_receipts"),
        (F.max("p_size") / 100.0).alias("cogs_r"), (F.min("p_size") / 50.0).alias("net_margin"))
    codes = codes.withColumn("code", E.lookup("position", dict(enumerate(_CODES))))
    d = part.select((C("p_size") % 8).alias("k")).distinct().select(
        E.lookup("k", dict(enumerate(V.INDUSTRIES))).alias("industry"),
        (1000.0 * (C("k") + 1)).alias("receipts"), F.lit(0.3).alias("cogs_ratio"),
        F.lit(0.1).alias("margin"))
    return rnd(fit.fit_industry(codes, d), median_gross_receipts=4, cogs_ratio=6,
               net_profit_margin=6)


_EDU = ["no_hs", "hs_diploma", "some_college", "bachelors"]


@add("r13_fit_education", "panel", f"""SELECT level, {r("raw / sum(raw) OVER ()", "share", 8)} FROM (""" + " UNION ALL ".join(
    f"SELECT '{k}' AS level, " + (f"round(avg({k}), 4) AS raw FROM edu" if k in _EDU else f"{v}::DOUBLE AS raw")
    for k, v in V.EDUCATION_FALLBACK.items()) + ")", """
edu AS (SELECT state, avg(has_gig) AS no_hs, avg(has_rental) AS hs_diploma, avg(has_crypto) AS some_college,
  avg(has_schedule_c) AS bachelors FROM panel GROUP BY ALL)""")
def q_education(spark, sf):
    d = Workspace.of(spark, sf).panel.groupBy("state").agg(
        F.avg("has_gig").alias("no_hs"), F.avg("has_rental").alias("hs_diploma"),
        F.avg("has_crypto").alias("some_college"), F.avg("has_schedule_c").alias("bachelors"))
    return rnd(fit.fit_education(d), share=8)


@add("r13_age_distribution", "panel", f"""SELECT {r("avg(m)", "mean", 6)}, {r("avg(s)", "std", 6)} FROM (
  SELECT state, avg(age) AS m, stddev_samp(age) AS s FROM panel GROUP BY state)""")
def q_age(spark, sf):
    by_state = Workspace.of(spark, sf).panel.groupBy("state").agg(
        F.avg("age").alias("mean"), F.stddev_samp("age").alias("std"))
    return rnd(fit.age_distribution(by_state), mean=6, std=6)


_MAR = {"single": "never_married + divorced * 0.6", "married_joint": "married * 0.92",
        "married_separate": "married * 0.08 + separated",
        "head_of_household": "divorced * 0.4 + never_married * 0.15", "qualifying_widow": "widowed"}


@add("r13_fit_filing_status", "panel", f"SELECT filing_status, {r('raw / sum(raw) OVER ()', 'share', 8)} FROM ("
     + " UNION ALL ".join(f"SELECT '{k}' AS filing_status, {v} AS raw FROM m" for k, v in _MAR.items()) + ")", """
m AS (SELECT avg(married) AS married, avg(widowed) AS widowed, avg(never_married) AS never_married,
    avg(divorced) AS divorced, avg(separated) AS separated FROM (
  SELECT tax_year, avg(has_gig) AS married, avg(has_rental) AS widowed, avg(has_crypto) AS never_married,
    avg(has_schedule_c) AS divorced, avg(has_foreign_account) AS separated FROM panel GROUP BY ALL))""")
def q_filing(spark, sf):
    d = Workspace.of(spark, sf).panel.groupBy("tax_year").agg(
        F.avg("has_gig").alias("married"), F.avg("has_rental").alias("widowed"),
        F.avg("has_crypto").alias("never_married"), F.avg("has_schedule_c").alias("divorced"),
        F.avg("has_foreign_account").alias("separated"))
    return rnd(fit.fit_filing_status(d), share=8)


# ---------------------------------------------------------------------- sequences
_FEATS = [f for f in V.SEQUENCE_FEATURES if f in (
    "w2_wages", "net_se_income", "agi", "taxable_income", "total_tax_liability",
    "effective_tax_rate", "utility_income_ratio", "lifestyle_income_ratio")]
SEQ = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY tax_year) - 1 AS pos,
    count(*) OVER (PARTITION BY person_id) AS n_years FROM panel),
steps AS (SELECT p.person_id, p.n_years, 2019 + i AS tax_year, {", ".join(f"coalesce(o.{f}, 0) AS {f}" for f in _FEATS)}
  FROM (SELECT DISTINCT person_id, n_years FROM ordered WHERE n_years >= 3) p, range(7) t(i)
  LEFT JOIN ordered o ON o.person_id = p.person_id AND o.pos = i)"""


@add("w9_r14_sequences", "panel", f"""SELECT person_id, CAST(n_years AS INTEGER) AS n_years, CAST(tax_year AS INTEGER) AS tax_year,
  {", ".join(r(f, f, 7) for f in _FEATS)} FROM steps""", SEQ)
def q_sequences(spark, sf):
    p = Workspace.of(spark, sf).panel
    seqs = sequences.build_sequences(p, _FEATS).drop("zone", "taxpayer_type", "fraud_type")
    return rnd(sequences.flatten_sequences(seqs, _FEATS), **dict.fromkeys(_FEATS, 7))


@add("f24_normalised_sequences", "panel", f"""SELECT person_id, CAST(tax_year AS INTEGER) AS tax_year,
  {", ".join(r(f"({f} - lo_{f}) / CASE WHEN hi_{f} = lo_{f} THEN 1 ELSE hi_{f} - lo_{f} END", f, 8) for f in _FEATS)}
  FROM steps, (SELECT {", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in _FEATS)} FROM steps)""", SEQ)
def q_normalised(spark, sf):
    seqs = sequences.build_sequences(Workspace.of(spark, sf).panel, _FEATS).select(
        "person_id", "sequence")
    d = sequences.normalise(seqs, sequences.fit_range(seqs, len(_FEATS)))
    return rnd(sequences.flatten_sequences(d, _FEATS), **dict.fromkeys(_FEATS, 8))


@add("w9_event_sequences", "sales", """SELECT person_id, CAST(2019 + i AS INTEGER) AS tax_year, CAST(n AS INTEGER) AS n_years,
  round(coalesce(v, 0), 7) AS value, coalesce(h, 0)::DOUBLE AS hits FROM (
  SELECT p.person_id, i, p.n, v, h FROM (SELECT DISTINCT person_id, n FROM slots WHERE n >= 3) p, range(7) t(i)
  LEFT JOIN slots s ON s.person_id = p.person_id AND s.pos = i)""", """
slots AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY slot) - 1 AS pos,
    count(*) OVER (PARTITION BY person_id) AS n FROM (
  SELECT CAST(user_id AS VARCHAR) AS person_id, (day(ts) - 1) % 7 AS slot,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS v, count(*) AS h
  FROM events GROUP BY ALL))""")
def q_event_seq(spark, sf):
    e = fixtures.event_sequences(spark, sf)
    seqs = sequences.build_sequences(e, ["value", "hits"])
    return rnd(sequences.flatten_sequences(seqs, ["value", "hits"]), value=7)


# --------------------------------------------------------------- scalar functions
@add("x11_fitted_norm", "panel", f"""SELECT person_id, tax_year,
  {r(f"least(greatest((coalesce(agi, 0) - lo) / (hi - lo + {V.EPS}::DOUBLE), 0), 1)", "norm", 6)}
  FROM panel, (SELECT quantile_cont(agi, 0.01) AS lo, quantile_cont(agi, 0.99) AS hi FROM panel)""")
def q_fitted_norm(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "agi")
    bounds = forensic.fit_norm_bounds(p, ["agi"])
    return rnd(p.withColumn("two_agi", F.lit(False)).select(
        "person_id", "tax_year", forensic.stable_norm("agi", bounds).alias("norm")), norm=6)


@add("f20_grouped_benford", "sales", f"""SELECT l_suppkey, n AS n_valid, {r(benford([f"d{k}" for k in range(1, 10)], "n"), "benford_deviation", 8)}
  FROM (SELECT l_suppkey, {", ".join(f"sum({flag(f'd = {k}')})::DOUBLE AS d{k}" for k in range(1, 10))}, count(d) AS n
    FROM (SELECT l_suppkey, {digit("l_extendedprice")} AS d FROM lineitem) GROUP BY ALL)""")
def q_benford(spark, sf):
    d = fixtures.table(spark, sf, "lineitem")
    return rnd(forensic.benford_by_group(d, ["l_suppkey"], "l_extendedprice"),
               benford_deviation=8)


@add("f25_weighted_choice", "panel", f"""SELECT person_id, tax_year, CASE
  WHEN u < 0.32::DOUBLE THEN 'pure_w2' WHEN u < 0.46::DOUBLE THEN 'pure_se' WHEN u < 0.58::DOUBLE THEN 'w2_with_side_biz'
  ELSE 'other' END AS drawn, round(u, 9) AS u
  FROM (SELECT *, {uniform(digest("f25", "person_id", "tax_year"))} AS u FROM panel)""")
def q_choice(spark, sf):
    u = E.digest_uniform(E.draw_key("f25", "person_id", "tax_year"))
    w = {"pure_w2": 0.32, "pure_se": 0.14, "w2_with_side_biz": 0.12, "other": 0.42}
    return Workspace.of(spark, sf).panel.select("person_id", "tax_year", E.weighted_choice(
        u, w).alias("drawn"), steady(u, 9).alias("u"))


@add("f15_f16_labels_and_ids", "panel", """SELECT lower(replace(trim(state), ' ', '_')) AS state_safe,
  printf('P%d_%07d', zone, CAST(person_id AS BIGINT)) AS code, 'R_' || person_id AS global_id,
  printf('B%d_%s_%07d', zone, upper(substr(taxpayer_type, 1, 2)), CAST(person_id AS BIGINT)) AS business FROM panel""")
def q_labels(spark, sf):
    return Workspace.of(spark, sf).panel.select(
        E.normalise_label("state").alias("state_safe"),
        E.person_code("zone", "person_id").alias("code"),
        F.concat_ws("_", F.lit("R"), "person_id").alias("global_id"),
        E.business_code("zone", F.upper(F.substring("taxpayer_type", 1, 2)), "person_id")
        .alias("business"))


@add("f1_f14_scalar_functions", "panel", f"""SELECT person_id, tax_year,
  {r(clip("w2_wages", 1000, 20000), "clipped", 7)}, {r("coalesce(gig_net, -1)", "filled", 7)},
  {r("abs(taxable_income)", "magnitude", 7)}, {r("ln(1 + greatest(coalesce(dividends, 0), 0))", "lg", 8)},
  {r("log2(1 + irs_risk_score)", "lg2", 8)}, {r("log10(1 + bank_deposit_ratio)", "lg10", 8)},
  floor(w2_wages)::BIGINT AS down, ceil(w2_wages)::BIGINT AS up,
  round_even(irs_risk_score / 10, 0) AS nearest, CAST(trunc(w2_wages) AS BIGINT) % 100 AS rest,
  greatest(coalesce(w2_wages, 0), coalesce(gig_net, 0)) = coalesce(w2_wages, 0) AS mostly_wages,
  {flag("w2_wages > 9000")} AS high, TRY_CAST(fraud_type AS DOUBLE) AS coerced,
  {r(clip("w2_wages / (abs(agi) + 1e-9)", 0, 5), "share", 7)}, NOT (agi IS NULL) AS known FROM panel""")
def q_scalars(spark, sf):
    w2 = C("w2_wages")
    return Workspace.of(spark, sf).panel.select(
        "person_id", "tax_year", steady(E.clip(w2, 1000, 20000), 7).alias("clipped"),
        steady(E.nz("gig_net", -1.0), 7).alias("filled"),
        steady(F.abs("taxable_income"), 7).alias("magnitude"),
        steady(E.log1p0("dividends"), 8).alias("lg"),
        steady(F.log2(C("irs_risk_score") + 1), 8).alias("lg2"),
        steady(F.log10(C("bank_deposit_ratio") + 1), 8).alias("lg10"),
        F.floor(w2).alias("down"), F.ceil(w2).alias("up"),
        F.bround(C("irs_risk_score") / 10).alias("nearest"),
        (w2.cast("long") % 100).alias("rest"),
        (F.greatest(E.nz(w2), E.nz("gig_net")) == E.nz(w2)).alias("mostly_wages"),
        E.flag(w2 > 9000).alias("high"), C("fraud_type").try_cast("double").alias("coerced"),
        steady(E.clip(E.safe_ratio(w2, C("agi")), 0, 5), 7).alias("share"), (~C("agi").isNull()).alias("known"))


