"""Queries and SQL twins: data-quality rule suites, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.panel_sql import case_map, flag, r, steady, with_ctes
from checks.profile_checks import rnd
from checks.relation_checks import DIMS
from checks.sampling_checks import ALIGNED, DRAWN, TARGET, _aligned
from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators import links, merge, profile, quality, sampling
from cohortscope.plans.workspace import Workspace
from cohortscope.session import staging_root
from cohortscope.sources import readers, sinks

QUERIES, ORACLE = {}, {}
C = F.col


def add(name, upto, sql, extra=""):
    def wrap(fn):
        QUERIES[name] = fn
        ORACLE[name] = with_ctes(upto, sql, extra)
        return fn
    return wrap


def rule_rows(src: str, rules: list[tuple], by: str = "") -> str:
    """UNION of (rule, value, severity, passed) rows; a rule is (name, expr, test, severity)."""
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    parts = [f"SELECT {lead}'{n}' AS rule, round(({x})::DOUBLE, 6) AS value, '{sev}' AS severity, "
             f"{flag(test.replace('$', f'({x})'))} AS passed FROM {src}{group}"
             for n, x, test, sev in rules]
    return " UNION ALL ".join(parts)


def count_if(cond: str) -> str:
    return f"sum({flag(cond)})"


def err(name, cond):
    return (name, count_if(cond), "$ = 0", "error")


_W2 = "taxpayer_type IN ('pure_w2', 'w2_with_side_biz')"
_CONTRA = "fraud_label = 1 AND fraud_type = 'none'"
_NULLS = [err(f"null_{c}", f"{c} IS NULL") for c in V.MUST_NOT_BE_NULL]


@add("d1_zone_year_rules", "panel", rule_rows("panel", [
    ("rows", "count(*)", "$ > 0", "error"),
    ("fraud_rate", "avg(fraud_label)", "$ BETWEEN 0.10 AND 0.35", "error"),
    ("label_type_contradiction", count_if(_CONTRA), "$ = 0", "warning"),
    err("w2_zero_wages", f"{_W2} AND w2_wages = 0"), err("negative_agi", "agi < 0"),
    err("taxable_above_agi", "taxable_income > agi"),
    ("cogs_above_receipts", count_if("cogs > gross_receipts"), "$ <= 5", "warning"),
    ("max_evasion_rate", "coalesce(max(evasion_rate), 0)", "$ <= 2.0", "warning"),
    ("agi_median", "floor(median(agi) * 1e4 + 0.5001) / 1e4", "$ >= 5000", "error")]
    + [x for x in _NULLS if x[0] not in ("null_zone", "null_tax_year")], "zone, tax_year"))
def q_d1(spark, sf):
    d = quality.check_zone_year(Workspace.of(spark, sf).panel)
    return d.withColumn("value", steady(F.when(C("rule") == "agi_median", steady(
        "value", 4)).otherwise(C("value")), 6))


_AUC = """(SELECT (sum(rk) FILTER (WHERE fraud_label = 1) - count(*) FILTER (WHERE fraud_label = 1)
  * (count(*) FILTER (WHERE fraud_label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE fraud_label = 1)
  * count(*) FILTER (WHERE fraud_label = 0)) AS auc{lead} FROM (SELECT *, rank() OVER ({part}ORDER BY irs_risk_score)
  + (count(*) OVER (PARTITION BY {key}irs_risk_score) - 1) / 2.0 AS rk FROM {src} WHERE irs_risk_score IS NOT NULL){group})"""


@add("d6_panel_rules", "panel", rule_rows("panel", [
    err(f"null_{c}", f"{c} IS NULL") for c in ["person_id", "zone", "fraud_label", "agi",
                                               "total_tax_liability", "irs_risk_score"]] + [
    err("negative_agi", "agi < 0"), err("taxable_above_agi", "taxable_income > agi + 1"),
    err("negative_tax", "total_tax_liability < 0"),
    err("rate_out_of_range", "effective_tax_rate NOT BETWEEN 0 AND 0.37"),
    err("score_out_of_range", "irs_risk_score NOT BETWEEN 1 AND 99"),
    ("fraud_rate", "avg(fraud_label)", "$ > 0.05 AND $ < 0.50", "error"),
    err("receipts_of_non_se", "taxpayer_type NOT IN ('pure_se', 'w2_with_side_biz', 'business_owner', "
        "'multi_biz_owner', 'gig_only') AND gross_receipts IS NOT NULL")], "tax_year")
    + f""" UNION ALL SELECT tax_year, 'score_auc', round(auc, 6), 'error', {flag("auc < 0.80")} FROM
  {_AUC.format(lead=", tax_year", part="PARTITION BY tax_year ", key="tax_year, ", src="panel", group=" GROUP BY tax_year")}
  UNION ALL SELECT NULL, 'rate_drift', round(max(x) - min(x), 6), 'warning', {flag("max(x) - min(x) < 0.15")}
  FROM (SELECT avg(fraud_label) AS x FROM panel GROUP BY tax_year)""")
def q_d6(spark, sf):
    return rnd(quality.check_panel_years(Workspace.of(spark, sf).panel), value=6)


SPLIT = """tagged AS (SELECT *, CASE WHEN tax_year <= 2023 THEN 'train' WHEN tax_year = 2024 THEN 'val'
  ELSE 'test' END AS split FROM panel)"""


def _tagged(spark, sf):
    from cohortscope.operators import splits
    return splits.split_by_year(Workspace.of(spark, sf).panel)


@add("d2_split_inspection", "panel", rule_rows("tagged", [
    ("fraud_rate", "avg(fraud_label)", "$ BETWEEN 0.18 AND 0.24", "error"),
    err("label_type_contradiction", _CONTRA),
    ("zero_wage_share", f"coalesce({count_if(_W2 + ' AND coalesce(w2_wages, 0) = 0')} / nullif({count_if(_W2)}, 0), 0)", "$ < 0.05", "error"),
    err("taxable_above_agi", "taxable_income > agi"),
    ("cogs_above_receipts", count_if("cogs > gross_receipts"), "$ = 0", "warning"),
    ("zero_evasion_share", f"coalesce({count_if('fraud_label = 1 AND coalesce(evasion_amount, 0) = 0')} / nullif({count_if('fraud_label = 1')}, 0), 0)", "$ < 0.05", "error"),
    ("mean_evasion_rate", "avg(evasion_rate)", "$ < 1", "error"),
    ("max_evasion_rate", "max(evasion_rate)", "$ <= 1", "error")] + _NULLS, "split"), SPLIT)
def q_d2(spark, sf):
    return rnd(quality.inspect_splits(_tagged(spark, sf)), value=6)


@add("d7_split_rules", "panel", f"""
SELECT split, 'rate_near_target' AS rule, round(avg(fraud_label), 6) AS value, 'error' AS severity,
  {flag("abs(avg(fraud_label) - 0.21) <= 0.025")} AS passed FROM tagged WHERE split = 'train' GROUP BY split
UNION ALL SELECT split, 'single_year', max(tax_year)::DOUBLE, 'error', {flag("min(tax_year) = max(tax_year)")}
  FROM tagged WHERE split <> 'train' GROUP BY split""", SPLIT)
def q_d7(spark, sf):
    return rnd(quality.check_splits(_tagged(spark, sf), {"train": V.RATE_OVERALL}), value=6)


@add("d10_split_log", "panel", """
SELECT split, 'taxpayer_type' AS dim, taxpayer_type AS value, count(*) AS n_rows,
  round(count(*) / sum(count(*)) OVER (PARTITION BY split), 8) AS amount FROM tagged GROUP BY split, taxpayer_type
UNION ALL SELECT split, 'zone', CAST(zone AS VARCHAR), count(*), round(count(*) / sum(count(*)) OVER (PARTITION BY split), 8)
  FROM tagged GROUP BY split, zone
UNION ALL SELECT split, 'fraud_type', fraud_type, count(*), round(count(*) / sum(count(*)) OVER (PARTITION BY split), 8)
  FROM tagged WHERE fraud_label = 1 GROUP BY split, fraud_type
UNION ALL SELECT split, 'tax_year', CAST(tax_year AS VARCHAR), count(*), round(avg(fraud_label), 8)
  FROM tagged GROUP BY split, tax_year""", SPLIT)
def q_d10(spark, sf):
    return rnd(quality.split_log(_tagged(spark, sf)), amount=8)


@add("d3_merge_report", "panel", """
SELECT dim, key, item, round(value, 6) AS value FROM (
SELECT 'all' AS dim, 'all' AS key, 'rows' AS item, count(*)::DOUBLE AS value FROM aligned
UNION ALL SELECT 'all', 'all', 'fraud_rate', avg(coalesce(fraud_label, 0)) FROM aligned
UNION ALL SELECT 'all', 'all', 'negative_agi', sum(CASE WHEN agi < 0 THEN 1 ELSE 0 END) FROM aligned
UNION ALL SELECT 'all', 'all', 'label_0_typed', sum(CASE WHEN coalesce(fraud_label, 0) = 0 AND fraud_type <> 'none' THEN 1 ELSE 0 END) FROM aligned
UNION ALL SELECT 'source', data_source, 'rows', count(*) FROM aligned GROUP BY data_source
UNION ALL SELECT 'source', data_source, 'fraud_rate', avg(coalesce(fraud_label, 0)) FROM aligned GROUP BY data_source
UNION ALL SELECT 'year', CAST(tax_year AS VARCHAR), 'rows', count(*) FROM aligned GROUP BY tax_year
UNION ALL SELECT 'year', CAST(tax_year AS VARCHAR), 'fraud_rate', avg(coalesce(fraud_label, 0)) FROM aligned GROUP BY tax_year
UNION ALL SELECT 'zone', CAST(zone AS VARCHAR), 'rows', count(*) FROM aligned GROUP BY zone
UNION ALL SELECT 'zone', CAST(zone AS VARCHAR), 'fraud_rate', avg(coalesce(fraud_label, 0)) FROM aligned GROUP BY zone
UNION ALL SELECT 'all', 'all', 'duplicate_person_years', count(*) - count(DISTINCT (person_id, tax_year)) FROM aligned
UNION ALL SELECT 'column', c, 'null_pct', v FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, (count(*) - count({c})) * 100.0 / count(*) AS v FROM aligned"
    for c in V.CANONICAL) + ") WHERE v > 80)", ALIGNED)
def q_d3(spark, sf):
    return rnd(quality.merge_report(_aligned(spark, sf)), value=6)


@add("d9_merged_rules", "panel", rule_rows("panel0", [
    ("rows", "count(*)", "$ > 0", "error"), err("negative_agi", "agi < 0"),
    err("taxable_above_agi", "taxable_income > agi + 1"),
    err("rate_out_of_range", "effective_tax_rate NOT BETWEEN 0 AND 0.37"),
    err("score_out_of_range", "irs_risk_score NOT BETWEEN 1 AND 99"),
    err("label_0_typed", "fraud_label = 0 AND fraud_type <> 'none'")])
    + f""" UNION ALL SELECT 'id_collisions', count(*)::DOUBLE, 'error', {flag("count(*) = 0")} FROM (
  SELECT person_id FROM panel0 WHERE data_source = 'real' INTERSECT SELECT person_id FROM panel0 WHERE data_source <> 'real')
  UNION ALL SELECT 'score_auc', round(auc, 6), 'error', {flag("auc < 0.80")} FROM
  {_AUC.format(lead="", part="", key="", src="panel0", group="")}""",
     "panel0 AS (SELECT *, CASE WHEN tax_year >= 2024 THEN 'made' ELSE 'real' END AS data_source FROM panel)")
def q_d9(spark, sf):
    d = Workspace.of(spark, sf).panel.withColumn(
        "data_source", F.when(C("tax_year") >= 2024, "made").otherwise("real"))
    return rnd(quality.check_merged(d), value=6)


@add("d8_generated_rules", "panel", rule_rows("panel", [
    ("rows", "count(*)", "$ > 0", "error"),
    ("fraud_rate", "avg(fraud_label)", "abs($ - 0.21) <= 0.035", "error"),
    err("rate_out_of_range", "effective_tax_rate NOT BETWEEN 0 AND 0.37"),
    err("label_0_typed", "fraud_label = 0 AND fraud_type <> 'none'"),
    err("negative_agi", "agi < 0"), err("negative_w2_wages", "w2_wages < 0"),
    err("negative_gross_receipts", "gross_receipts < 0")], "state")
    + f""" UNION ALL SELECT state, 'median_years', median(n), 'error', {flag("median(n) >= 3")} FROM (
  SELECT state, person_id, count(DISTINCT tax_year) AS n FROM panel GROUP BY ALL) GROUP BY state""")
def q_d8(spark, sf):
    return rnd(quality.check_generated(Workspace.of(spark, sf).panel, V.RATE_OVERALL, ["state"]),
               value=6)


@add("d4_sample_validation", "panel", f"""
SELECT state, 'row_drift' AS rule, round(count(*) / {TARGET}.0 - 1, 6) AS value, 'error' AS severity,
  {flag(f"count(*) / {TARGET}.0 - 1 BETWEEN -0.02 AND 0.05")} AS passed FROM sample GROUP BY state
UNION ALL SELECT state, 'rate_gap', round(abs(avg(fraud_label) - {case_map("state", V.STATE_TARGET_RATE)}), 6), 'error',
  {flag(f"abs(avg(fraud_label) - {case_map('state', V.STATE_TARGET_RATE)}) < 0.005")} FROM sample GROUP BY state
UNION ALL SELECT state, 'partial_histories', sum(CASE WHEN kept <> had THEN 1 ELSE 0 END)::DOUBLE, 'error',
  {flag("sum(CASE WHEN kept <> had THEN 1 ELSE 0 END) = 0")} FROM spans GROUP BY state
UNION ALL SELECT state, 'year_gaps', sum(CASE WHEN span <> kept THEN 1 ELSE 0 END)::DOUBLE, 'error',
  {flag("sum(CASE WHEN span <> kept THEN 1 ELSE 0 END) = 0")} FROM spans GROUP BY state
UNION ALL SELECT state, 'type_drift', round(max(abs(a - coalesce(b, 0))), 6), 'error',
  {flag("max(abs(a - coalesce(b, 0))) < 0.03")} FROM (
  SELECT state, taxpayer_type, count(*) / sum(count(*)) OVER (PARTITION BY state) AS a FROM panel GROUP BY state, taxpayer_type)
  LEFT JOIN (SELECT state, taxpayer_type, count(*) / sum(count(*)) OVER (PARTITION BY state) AS b FROM sample
  GROUP BY state, taxpayer_type) USING (state, taxpayer_type) GROUP BY state
UNION ALL SELECT state, 'share_' || tax_year, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 6), 'info', 1
  FROM sample GROUP BY state, tax_year""", DRAWN + """,
spans AS (SELECT s.state, s.person_id, count(DISTINCT s.tax_year) AS kept, max(s.tax_year) - min(s.tax_year) + 1 AS span,
  any_value(had) AS had FROM sample s JOIN (SELECT state, person_id, count(DISTINCT tax_year) AS had FROM panel GROUP BY ALL) o
  ON o.state = s.state AND o.person_id = s.person_id GROUP BY s.state, s.person_id)""")
def q_d4(spark, sf):
    p = Workspace.of(spark, sf).panel
    s = sampling.sample_states(p, TARGET)
    return rnd(quality.validate_sample(p, s, TARGET), value=6)


@add("w4_year_gaps", "panel", """SELECT person_id FROM panel GROUP BY person_id
  HAVING max(tax_year) - min(tax_year) + 1 <> count(DISTINCT tax_year)""")
def q_gaps(spark, sf):
    return quality.year_gaps(Workspace.of(spark, sf).panel)


@add("j16_partial_histories", "panel", """SELECT person_id, count(DISTINCT tax_year) FILTER (WHERE agi > 20000) AS kept,
  count(DISTINCT tax_year) AS had FROM panel GROUP BY person_id
  HAVING kept > 0 AND kept <> had""")
def q_partial(spark, sf):
    p = Workspace.of(spark, sf).panel
    return quality.partial_histories(p, p.filter("agi > 20000"))


@add("d5_person_rules", "panel", rule_rows("scored_persons", [
    err("age_out_of_range", "age_at_entry NOT BETWEEN 18 AND 80"),
    err("null_taxpayer_type", "taxpayer_type IS NULL"),
    err("null_fraud_persona", "fraud_persona IS NULL"),
    err("score_out_of_range", "score NOT BETWEEN 1 AND 99"),
    err("bad_zone", "zone NOT IN (1, 2, 3, 4, 5)"),
    ("clean_share", f"avg({flag('fraud_persona = ' + chr(39) + 'clean' + chr(39))})", "$ > 0.75 AND $ < 0.92", "error"),
    ("score_persona_correlation", f"round(corr(score, {flag('fraud_persona <> ' + chr(39) + 'clean' + chr(39))}), 6)", "$ < 0.25", "error")])
    + f""" UNION ALL SELECT 'duplicate_ids', sum({flag("n > 1")})::DOUBLE, 'error', {flag(f"sum({flag('n > 1')}) = 0")}
  FROM (SELECT person_id, count(*) AS n FROM persons GROUP BY ALL)""", DIMS + """,
scored_persons AS (SELECT *, least(greatest(15.0::DOUBLE + CASE WHEN taxpayer_type IN ('business_owner', 'multi_biz_owner') THEN 18 ELSE 0 END
  + CASE WHEN taxpayer_type = 'pure_se' THEN 12 ELSE 0 END + CASE WHEN fraud_persona = 'chronic_evader' THEN 35
  WHEN fraud_persona IN ('escalating', 'opportunistic') THEN 20 ELSE 0 END + has_foreign_account * 22 + is_crypto_user * 8, 1), 99) AS score
  FROM persons)""")
def q_d5(spark, sf):
    return rnd(quality.check_persons(links.rule_points(Workspace.of(spark, sf).persons)), value=6)


@add("d5_link_and_business_rules", "panel", "SELECT 'links' AS tbl, * FROM (" + rule_rows("links", [
    err("null_person", "person_id IS NULL"), err("null_business", "business_id IS NULL"),
    err("start_after_end", "link_start > coalesce(link_end, 2025)"),
    err("base_salary_not_positive", "base_salary <= 0")]) + ") UNION ALL SELECT 'businesses', * FROM ("
    + rule_rows("businesses", [
        err("bad_zone", "zone NOT IN (1, 2, 3, 4, 5)"), err("null_industry", "industry IS NULL"),
        err("null_entity_type", "entity_type IS NULL"), err("negative_employees", "n_employees_base < 0"),
        ("exit_set_share", f"avg({flag('exit_year IS NOT NULL')})", "$ > 0.30", "warning")])
    + f""" UNION ALL SELECT 'duplicate_ids', sum({flag("n > 1")})::DOUBLE, 'error', {flag(f"sum({flag('n > 1')}) = 0")}
  FROM (SELECT business_id, count(*) AS n FROM businesses GROUP BY ALL))""", DIMS)
def q_d5b(spark, sf):
    ws = Workspace.of(spark, sf)
    a = quality.check_links(ws.links).withColumn("tbl", F.lit("links"))
    # every seventh business breaks the rule on employees
    b = quality.check_businesses(ws.businesses.withColumn("n_employees_base", F.when(
        C("business_id").cast("long") % 7 == 0, -1).otherwise(C("n_employees_base")))
    ).withColumn("tbl", F.lit("businesses"))
    return rnd(a.unionByName(b), value=6)


# --------------------------------------------------------------- sources and sinks
def _dir(spark, name):
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


_BY = f"count(*) AS n_rows, {r('avg(fraud_label)', 'fraud_rate', 8)}"


@add("s12_s13_partitioned_outputs", "panel", f"""
SELECT 'by_state_by_year' AS layout, lower(replace(state, ' ', '_')) AS state_safe, tax_year, {_BY} FROM panel GROUP BY ALL
UNION ALL SELECT 'by_state', lower(replace(state, ' ', '_')), NULL, {_BY} FROM panel GROUP BY ALL
UNION ALL SELECT 'by_year', NULL, tax_year, {_BY} FROM panel GROUP BY ALL""")
def q_outputs(spark, sf):
    paths = sinks.write_outputs(Workspace.of(spark, sf).panel, _dir(spark, "outputs"))
    out = None
    for layout, by in (("by_state_by_year", ["state_safe", "tax_year"]),
                       ("by_state", ["state_safe"]), ("by_year", ["tax_year"])):
        d = sinks.output_summary(spark.read.parquet(paths[layout]), by)
        for c, kind in (("state_safe", "string"), ("tax_year", "int")):
            if c not in d.columns:
                d = d.withColumn(c, F.lit(None).cast(kind))
        d = d.select(F.lit(layout).alias("layout"), "state_safe", "tax_year", "n_rows",
                     "fraud_rate")
        out = d if out is None else out.unionByName(d)
    return rnd(out, fraud_rate=8)


@add("s1_s2_pruned_scan", "panel", f"""SELECT person_id, tax_year, {r("agi", "agi", 7)} FROM panel
  WHERE tax_year IN (2020, 2023)""")
def q_scan(spark, sf):
    path = _dir(spark, "by-year")
    sinks.write_parquet(Workspace.of(spark, sf).panel, path, ["tax_year"])
    d = readers.read_panel(spark, path, [2020, 2023], ["person_id", "tax_year", "agi", "absent"])
    return rnd(d, agi=7)


@add("s4_load_years", "panel", """SELECT tax_year, count(*) AS n_rows, count(uses_itemized) FILTER
  (WHERE tax_year <> 2020) AS itemized_known FROM panel WHERE tax_year IN (2019, 2020) GROUP BY ALL""")
def q_years(spark, sf):
    base = _dir(spark, "years")
    p = Workspace.of(spark, sf).panel
    for y in (2019, 2020):
        part = p.filter(C("tax_year") == y)
        # one year lacks a column: the union fills it with NULL
        sinks.overwrite_stage(part.drop("uses_itemized") if y == 2020 else part, base, f"year_{y}")
    d, missing = readers.load_years(spark, base + "/year_{year}", [2019, 2020, 2021])
    assert missing == [2021]
    return d.groupBy("tax_year").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count("uses_itemized").alias("itemized_known"))


@add("s5_s10_csv_round_trip", "panel", """SELECT business_id, zone, open_year, exit_year, industry, entity_type,
  CAST(CAST(business_id AS BIGINT) % 50 AS INTEGER) AS n_employees_base FROM businesses""", DIMS)
def q_csv(spark, sf):
    path = _dir(spark, "businesses")
    cols = ["business_id", "zone", "open_year", "exit_year", "entity_type", "industry",
            "n_employees_base"]
    b = Workspace.of(spark, sf).businesses.select(*cols)
    sinks.write_csv(b, path)
    schema = ", ".join(readers.BUSINESSES.split(", ")[:7])
    return readers.read_csv(spark, path, schema).select(*sorted(cols))


@add("s6_s11_json_parameters", "panel", f"""SELECT state, round(avg(agi), 3) AS median_home_value,
  count(*) AS n FROM panel GROUP BY ALL""")
def q_json(spark, sf):
    path = _dir(spark, "parameters")
    g = Workspace.of(spark, sf).panel.groupBy("state").agg(
        F.round(F.avg("agi"), 3).alias("median_home_value"), F.count(F.lit(1)).alias("n"))
    # one JSON object of objects, as parameter files come: {"state": {...}, ...}
    doc = g.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "state", F.struct("median_home_value", "n"))))).alias("value"))
    doc.coalesce(1).write.text(path)
    return readers.read_parameters(spark, path, "state",
                                   "struct<median_home_value:double,n:bigint>")


@add("s11_report_sink", "panel", f"""SELECT state, tax_year, count(*) AS n_rows,
  {r('avg(fraud_label)', 'fraud_rate', 8)} FROM panel GROUP BY ALL""")
def q_report_sink(spark, sf):
    """A report written by the sink and read back."""
    path = _dir(spark, "report")
    sinks.write_report(sinks.output_summary(Workspace.of(spark, sf).panel, ["state", "tax_year"]),
                       path)
    return rnd(spark.read.schema("state string, tax_year int, n_rows bigint, fraud_rate double")
               .json(path), fraud_rate=8)


@add("s7_s14_rate_store", "stats", f"SELECT dim, key, n, {r('rate', 'rate', 8)} FROM rates")
def q_store(spark, sf):
    path = _dir(spark, "rates")
    sinks.write_parquet(Workspace.of(spark, sf).rates, path)
    return rnd(spark.read.parquet(path), rate=8)


@add("s15_default_metadata", "panel", """SELECT person_id, 0 AS fraud_label, tax_year, 'UNKNOWN' AS state,
  taxpayer_type FROM panel""")
def q_metadata(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "taxpayer_type")
    return sinks.with_metadata(p)


@add("s8_s9_p13_stage_overwrite", "panel", f"""SELECT person_id, tax_year, round(CAST(CAST(irs_risk_score AS FLOAT) AS DOUBLE), 4)
  AS irs_risk_score FROM panel""")
def q_overwrite(spark, sf):
    from cohortscope.operators.preprocess import downcast
    base = _dir(spark, "stages")
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "irs_risk_score")
    first = sinks.overwrite_stage(p, base, "v1")
    second = sinks.overwrite_stage(downcast(spark.read.parquet(first)), base, "v2")
    return spark.read.parquet(second).select("person_id", "tax_year", steady(
        C("irs_risk_score").cast("double"), 4).alias("irs_risk_score"))


_ROLES = {"numeric": ["tax_year", "zone", "age", "agi", "w2_wages"],
          "categorical": ["taxpayer_type", "filing_status"], "binary": ["has_gig", "has_rental"]}


@add("s3_p2_column_roles", "panel", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{role}' AS role, '{c}' AS name, count({c}) AS n_known, "
    f"count(DISTINCT {c}) AS n_values FROM panel"
    for role, cols in _ROLES.items() for c in cols) + ") WHERE n_values > 1")
def q_roles(spark, sf):
    """Roles of the columns that written files have and that hold more than one value."""
    path = _dir(spark, "roles")
    p = Workspace.of(spark, sf).panel.select(
        *[c for cols in _ROLES.values() for c in cols], "person_id")
    sinks.write_parquet(p, path)
    d = spark.read.parquet(path)
    roles = merge.column_roles(readers.available_columns(spark, path))
    cols = [(role, c) for role, cs in roles.items() for c in cs]
    cells = d.groupBy("person_id", *[c for _, c in cols]).agg(F.count(F.lit(1)).alias("n"))
    pairs = cells.select("n", F.explode(F.array(*[F.struct(
        F.lit(role).alias("role"), F.lit(c).alias("name"), C(c).cast("string").alias("v"))
        for role, c in cols])).alias("x")).select("n", "x.*").filter("v IS NOT NULL")
    values = pairs.groupBy("role", "name", "v").agg(F.sum("n").alias("n"))
    return values.groupBy("role", "name").agg(
        F.sum("n").alias("n_known"), F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")



