"""Queries and SQL twins: person index, distributions, column profiles, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.feature_checks import PANEL_FLOATS, PANEL_INTS, PANEL_TEXT, reading
from checks.panel_sql import flag, r, steady, with_ctes
from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators import evaluate, profile
from cohortscope.plans.workspace import Workspace

QUERIES, ORACLE = {}, {}
C = F.col


def rnd(df, **places):
    return df.withColumns({c: steady(C(c), n) for c, n in places.items()})


def add(name, upto, sql, extra=""):
    def wrap(fn):
        QUERIES[name] = fn
        ORACLE[name] = with_ctes(upto, sql, extra)
        return fn
    return wrap


def index_sql(keys: str) -> str:
    k = ", ".join(f"p.{x.strip()}" for x in keys.split(","))
    same = " AND ".join(f"p.{x.strip()} = t.{x.strip()}" for x in keys.split(","))
    return f"""
moves AS (SELECT {keys}, sum({flag("fraud_label = 1 AND prev = 0")}) AS onset,
    sum({flag("fraud_label = 0 AND prev = 1")}) AS exits FROM (
    SELECT *, lag(fraud_label) OVER (PARTITION BY {keys} ORDER BY tax_year) AS prev FROM panel)
  GROUP BY ALL),
index0 AS (SELECT {k}, count(*) AS n_rows, max(fraud_label) AS fraud_ever,
    min(fraud_label) AS fraud_always, avg(fraud_label) AS fraud_mean,
    sum(fraud_label)::BIGINT AS fraud_sum, mode(taxpayer_type) AS taxpayer_type,
    min(tax_year) AS year_min, max(tax_year) AS year_max, count(DISTINCT tax_year) AS n_years
  FROM panel p GROUP BY ALL),
pindex AS (SELECT p.*,
    CASE WHEN n_years = 1 THEN 'transient' WHEN n_years <= 3 THEN 'short'
         WHEN n_years <= 5 THEN 'mid' ELSE 'persistent' END AS lifecycle,
    CASE WHEN fraud_ever = 0 THEN 'clean' WHEN fraud_always = 1 THEN 'chronic' ELSE 'mixed' END
      AS fraud_pattern,
    CASE WHEN fraud_ever = 0 THEN 'clean' WHEN fraud_always = 1 THEN 'chronic'
         WHEN onset >= 1 AND exits = 0 THEN 'escalator' WHEN exits >= 1 AND onset = 0
         THEN 'reformed' ELSE 'sporadic' END AS fraud_detail,
    CASE WHEN year_min = 2019 THEN 'early' WHEN year_min IN (2020, 2021) THEN 'mid'
         WHEN year_min BETWEEN 2022 AND 2025 THEN 'late' END AS cohort_band
  FROM index0 p JOIN moves t ON {same})"""


INDEX = index_sql("person_id")


@add("a8_person_index", "panel", f"""SELECT person_id, n_rows, fraud_ever, fraud_always,
  {r("fraud_mean", "fraud_mean")}, fraud_sum, taxpayer_type, year_min, year_max, n_years
  FROM pindex""", INDEX)
def q_index(spark, sf):
    i = profile.person_index(Workspace.of(spark, sf).panel)
    return rnd(i, fraud_mean=6).select(
        "person_id", "n_rows", "fraud_ever", "fraud_always", "fraud_mean", "fraud_sum",
        "taxpayer_type", "year_min", "year_max", "n_years")


@add("m1_m3_lifecycle_pattern_cohort", "panel",
     "SELECT person_id, lifecycle, fraud_pattern, fraud_detail, cohort_band FROM pindex", INDEX)
def q_patterns(spark, sf):
    return profile.person_index(Workspace.of(spark, sf).panel).select(
        "person_id", "lifecycle", "fraud_pattern", "fraud_detail", "cohort_band")


@add("w3_trajectories", "panel", "SELECT fraud_detail, count(*) AS persons FROM pindex "
     "WHERE fraud_pattern = 'mixed' GROUP BY ALL", INDEX)
def q_traj(spark, sf):
    i = profile.person_index(Workspace.of(spark, sf).panel)
    return i.filter("fraud_pattern = 'mixed'").groupBy("fraud_detail").agg(
        F.count(F.lit(1)).alias("persons"))


@add("a24_cell_counts", "panel", "SELECT lifecycle, fraud_pattern, count(*) AS persons "
     "FROM pindex GROUP BY ALL", INDEX)
def q_cells(spark, sf):
    return profile.cell_counts(profile.person_index(Workspace.of(spark, sf).panel))


@add("a9_value_counts", "panel", f"""SELECT state, taxpayer_type, count(*) AS n,
  {r("count(*) / sum(count(*)) OVER (PARTITION BY state)", "share", 8)}
  FROM panel GROUP BY state, taxpayer_type""")
def q_counts(spark, sf):
    return rnd(profile.value_counts(Workspace.of(spark, sf).panel, "taxpayer_type", ["state"]),
               share=8)


@add("a9_value_counts_with_nulls", "panel", f"""SELECT employer_id, count(*) AS n,
  {r("count(*) / sum(count(*)) OVER ()", "share", 8)} FROM panel GROUP BY ALL""")
def q_counts_null(spark, sf):
    return rnd(profile.value_counts(Workspace.of(spark, sf).panel, "employer_id", dropna=False),
               share=8)


@add("a10_distinct_persons", "panel", """SELECT count(DISTINCT person_id) AS persons,
  count(DISTINCT employer_id) AS employers, count(DISTINCT tax_year) AS years FROM panel""")
def q_distinct(spark, sf):
    d = Workspace.of(spark, sf).panel
    return d.agg(F.countDistinct("person_id").alias("persons"),
                 F.countDistinct("employer_id").alias("employers"),
                 F.countDistinct("tax_year").alias("years"))


@add("a11_years_per_person", "panel", "SELECT n_years, count(*) AS persons FROM pindex "
     "GROUP BY ALL", INDEX)
def q_years(spark, sf):
    return profile.years_per_person(profile.person_index(Workspace.of(spark, sf).panel))


def _rates(by):
    return (f"SELECT {by}, {r('avg(coalesce(fraud_label, 0))', 'rate', 8)}, "
            f"sum(coalesce(fraud_label, 0))::BIGINT AS positives, count(*) AS n_rows "
            f"FROM panel GROUP BY ALL")


@add("a12_rate_by_year", "panel", _rates("tax_year"))
def q_rate_year(spark, sf):
    return rnd(profile.rate_table(Workspace.of(spark, sf).panel, ["tax_year"]), rate=8)


@add("a12_rate_by_type", "panel", _rates("taxpayer_type") + " ORDER BY rate DESC")
def q_rate_type(spark, sf):
    return rnd(profile.rate_table(Workspace.of(spark, sf).panel, ["taxpayer_type"]),
               rate=8).orderBy(C("rate").desc())


@add("a15_rate_by_zone_year", "panel", _rates("zone, tax_year"))
def q_rate_zone(spark, sf):
    return rnd(profile.rate_table(Workspace.of(spark, sf).panel, ["zone", "tax_year"]), rate=8)


@add("a13_person_consistency", "panel", f"""SELECT
  count(*) FILTER (WHERE fraud_ever = 0) AS always_clean,
  count(*) FILTER (WHERE fraud_always = 1) AS always_fraud,
  count(*) FILTER (WHERE fraud_ever <> fraud_always) AS mixed,
  {r("avg(fraud_mean) FILTER (WHERE fraud_ever <> fraud_always)", "mixed_rate_mean")},
  {r("min(fraud_mean) FILTER (WHERE fraud_ever <> fraud_always)", "mixed_rate_min")},
  {r("max(fraud_mean) FILTER (WHERE fraud_ever <> fraud_always)", "mixed_rate_max")}
  FROM pindex""", INDEX)
def q_consistency(spark, sf):
    i = profile.person_index(Workspace.of(spark, sf).panel)
    return rnd(profile.person_consistency(i), mixed_rate_mean=6, mixed_rate_min=6,
               mixed_rate_max=6)


@add("a14_state_profiles", "panel", f"""SELECT state, sum(n_rows)::BIGINT AS n_rows,
  count(*) AS n_persons, {r("sum(fraud_sum) / sum(n_rows)", "fraud_rate", 8)},
  {r("sum(n_rows) / count(*)", "years_per_person")}, sum(fraud_ever)::BIGINT AS fraud_persons,
  count(*) FILTER (WHERE fraud_pattern = 'mixed') AS mixed_fraud,
  count(*) FILTER (WHERE fraud_pattern = 'chronic') AS always_fraud,
  count(*) FILTER (WHERE fraud_pattern = 'clean') AS always_clean
  FROM pindex GROUP BY state""", index_sql("state, person_id"))
def q_states(spark, sf):
    return rnd(profile.state_profiles(Workspace.of(spark, sf).panel), fraud_rate=8,
               years_per_person=6)


_ALL = PANEL_TEXT + PANEL_INTS + PANEL_FLOATS


@add("a16_null_rates", "panel", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'(count(*) - count({c})) * 100.0 / count(*)', 'null_pct')} "
    f"FROM panel" for c in _ALL))
def q_null_rates(spark, sf):
    return rnd(profile.null_rates(Workspace.of(spark, sf).panel.select(*_ALL)), null_pct=6)


def _manifest_sql():
    parts = []
    kinds = {c: "string" for c in PANEL_TEXT}
    kinds.update({c: "double" for c in PANEL_FLOATS})
    kinds.update({c: "int" for c in PANEL_INTS})
    kinds["n_rental_units"] = "bigint"
    for c in _ALL:
        text = c in PANEL_TEXT
        stats = ("NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, "
                 f"count(DISTINCT {c}) AS n_unique" if text else
                 f"{r(f'min({c})', 'low', 4)}, {r(f'max({c})', 'high', 4)}, "
                 f"{r(f'avg({c})', 'mean', 4)}, NULL::BIGINT AS n_unique")
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kinds[c]}' AS dtype, count(*) - count({c}) AS "
            f"null_count, {r(f'(count(*) - count({c})) / count(*)', 'null_rate', 4)}, {stats}, "
            f"{str(c in V.CANONICAL).lower()} AS in_canonical FROM panel")
    return " UNION ALL ".join(parts)


@add("a18_column_manifest", "panel", _manifest_sql())
def q_manifest(spark, sf):
    m = profile.column_manifest(Workspace.of(spark, sf).panel.select(*_ALL))
    return rnd(m, null_rate=4, low=4, high=4, mean=4)


@add("a19_duplicate_keys", "sales", """SELECT count(*) - count(DISTINCT (o_custkey, tax_year))
  AS duplicate_rows FROM sales""")
def q_dups(spark, sf):
    from cohortscope.sources import fixtures
    return profile.duplicate_keys(fixtures.sales(spark, sf), ["o_custkey", "tax_year"])


_SANE = ["agi", "total_tax_liability", "w2_wages"]


@add("a20_income_sanity", "panel", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'median({c})', 'median', 5)}, {r(f'avg({c})', 'mean', 4)}, "
    f"{r(f'avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END) * 100', 'pct_zero')} "
    f"FROM panel WHERE {c} IS NOT NULL" for c in _SANE))
def q_sanity(spark, sf):
    return rnd(profile.income_sanity(Workspace.of(spark, sf).panel, _SANE), median=5, mean=4,
               pct_zero=6)


@add("a21_benchmark_deviation", "panel", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r('m', 'median', 5)}, {r('a', 'mean', 4)},
    {r(f'(m - {md}) / {md}', 'median_dev')}, {r(f'(a - {mn}) / {mn}', 'mean_dev')},
    {flag(f'abs(m - {md}) / {md} < 0.40 AND abs(a - {mn}) / {mn} < 0.40')} AS ok
    FROM (SELECT median({c}) AS m, avg({c}) AS a FROM panel WHERE {c} > 0)"""
    for c, (md, mn) in V.INCOME_BENCHMARKS.items()))
def q_bench(spark, sf):
    return rnd(profile.benchmark_deviation(Workspace.of(spark, sf).panel), median=5, mean=4,
               median_dev=6, mean_dev=6)


@add("a22_positive_distribution", "panel", f"""SELECT zone, {r("avg(evasion_amount)", "mean", 4)},
  count(*) AS n, {r("median(evasion_amount)", "median", 5)},
  {r("quantile_cont(evasion_amount, 0.99)", "p99", 7)}
  FROM panel WHERE evasion_amount > 0 GROUP BY zone""")
def q_positive(spark, sf):
    return rnd(profile.positive_distribution(Workspace.of(spark, sf).panel, "evasion_amount",
                                             ["zone"]), mean=4, median=5, p99=7)


@add("a23_w10_yearly_median_change", "panel", f"""SELECT tax_year, {r("m", "median", 5)},
  {r("(m / lag(m) OVER (ORDER BY tax_year) - 1) * 100", "change_pct")},
  abs((m / lag(m) OVER (ORDER BY tax_year) - 1) * 100) < 20 AS ok
  FROM (SELECT tax_year, median(agi) AS m FROM panel GROUP BY ALL)""")
def q_yoy(spark, sf):
    return rnd(profile.yearly_median_change(Workspace.of(spark, sf).panel, "agi"), median=5,
               change_pct=6)


@add("a25_rate_drift", "panel", f"""SELECT {r("max(x) - min(x)", "drift", 8)} FROM
  (SELECT avg(fraud_label) AS x FROM panel GROUP BY tax_year)""")
def q_drift(spark, sf):
    return rnd(profile.rate_drift(Workspace.of(spark, sf).panel), drift=8)


@add("a26_label_correlation", "panel", f"""SELECT {r("corr(irs_risk_score, "
     + flag("fraud_type <> 'none'") + "::DOUBLE)", "correlation", 6)} FROM panel""")
def q_corr(spark, sf):
    return rnd(profile.label_correlation(Workspace.of(spark, sf).panel, "irs_risk_score",
                                         C("fraud_type") != "none"), correlation=6)


@add("a27_known_vs_new", "panel", f"""SELECT known, count(*) AS n_rows,
  {r("avg(fraud_label)", "rate", 8)}, {r("count(*) / sum(count(*)) OVER ()", "share", 8)}
  FROM (SELECT *, {flag("person_id IN (SELECT person_id FROM panel WHERE tax_year <= 2023)")}
  AS known FROM panel WHERE tax_year = 2024) GROUP BY known""")
def q_known(spark, sf):
    p = Workspace.of(spark, sf).panel
    return rnd(profile.known_vs_new(p.filter("tax_year = 2024"), p.filter("tax_year <= 2023")),
               rate=8, share=8)


@add("m17_filer_comparison", "panel", f"""SELECT filer, dim, value, count(*) AS n_rows,
  sum(fraud_label)::BIGINT AS positives, {r("avg(fraud_label)", "rate", 8)},
  {r("count(*) / sum(count(*)) OVER (PARTITION BY filer, dim)", "share", 8)} FROM (
  {" UNION ALL ".join(f"SELECT filer, '{d}' AS dim, CAST({e} AS VARCHAR) AS value, fraud_label FROM filers"
    for d, e in [("all", "'all'"), ("entry_cohort", "entry_cohort"), ("tax_year", "tax_year"),
                 ("taxpayer_type", "taxpayer_type")])}) GROUP BY filer, dim, value""",
     """filers AS (SELECT p.*, CASE WHEN n = 1 THEN 'one_year' ELSE 'multi_year' END AS filer
  FROM panel p JOIN (SELECT person_id, count(DISTINCT tax_year) AS n FROM panel GROUP BY ALL)
  USING (person_id))""")
def q_filers(spark, sf):
    return rnd(profile.filer_comparison(Workspace.of(spark, sf).panel), rate=8, share=8)


# ------------------------------------------------------------------- evaluation
_FLAGS = sorted(V.SIGNAL_FLAGS + V.IMPOSSIBILITY_FLAGS)


@add("e1_flag_calibration", "scored", f"""SELECT flag, {r("a", "all_rate")}, {r("f", "fraud_rate")},
  {r("c", "clean_rate")}, {r("f / (a + 1e-9)", "lift", 5)},
  CASE WHEN a > 0.60 THEN 'NOISE' WHEN f < c THEN 'BACKWARD' WHEN f / (a + 1e-9) > 1.3 THEN 'GOOD'
    WHEN f / (a + 1e-9) > 1.1 THEN 'OK' ELSE 'WEAK' END AS status,
  CASE WHEN flag IN ({", ".join(f"'{x}'" for x in V.SIGNAL_FLAGS)}) THEN 'Phase1' ELSE 'Phase7' END
    AS owner
  FROM ({" UNION ALL ".join(f"SELECT '{x}' AS flag, avg({x}) AS a, avg({x}) FILTER (WHERE fraud_label = 1) AS f, avg({x}) FILTER (WHERE fraud_label = 0) AS c FROM scored WHERE tax_year = 2019" for x in _FLAGS)})""")
def q_calibration(spark, sf):
    d = reading(spark, sf, "e1_flag_calibration").flagged.filter("tax_year = 2019")
    return rnd(evaluate.flag_calibration(d, _FLAGS), all_rate=6, fraud_rate=6, clean_rate=6,
               lift=5)


@add("e2_score_separation", "scored", f"""SELECT {r("fm", "fraud_mean", 5)}, {r("cm", "clean_mean", 5)},
  {r("fm / cm", "ratio", 5)}, {r("a50", "fraud_above_p50", 5)}, {r("a75", "fraud_above_p75", 5)},
  {r("p50", "clean_p50", 5)}, {r("p75", "clean_p75", 5)} FROM (
  SELECT avg(s) FILTER (WHERE fraud_label = 1) AS fm, avg(s) FILTER (WHERE fraud_label = 0) AS cm,
    avg({flag("s > p50")}) FILTER (WHERE fraud_label = 1) AS a50,
    avg({flag("s > p75")}) FILTER (WHERE fraud_label = 1) AS a75,
    any_value(p50) AS p50, any_value(p75) AS p75
  FROM (SELECT master_fraud_propensity AS s, fraud_label FROM scored),
    (SELECT median(master_fraud_propensity) AS p50, quantile_cont(master_fraud_propensity, 0.75)
     AS p75 FROM scored WHERE fraud_label = 0))""")
def q_separation(spark, sf):
    s = reading(spark, sf, "e2_score_separation").scored_of(
        "fraud_label", "master_fraud_propensity")
    d = evaluate.score_separation(s, "master_fraud_propensity")
    return rnd(d, **dict.fromkeys(d.columns, 5))


@add("e3_ks_statistic", "panel", f"""SELECT {r("max(abs(f / sum_f - c / sum_c))", "ks", 6)} FROM (
  SELECT cell, sum(pos) OVER w AS f, sum(neg) OVER w AS c, sum(pos) OVER () AS sum_f,
    sum(neg) OVER () AS sum_c FROM (
    SELECT ceil((s - lo) / (hi - lo) * 499) AS cell, sum(l) AS pos, sum(1 - l) AS neg FROM
      (SELECT irs_risk_score AS s, fraud_label AS l FROM panel),
      (SELECT min(irs_risk_score) AS lo, max(irs_risk_score) AS hi FROM panel)
    GROUP BY 1) WINDOW w AS (ORDER BY cell))""")
def q_ks(spark, sf):
    return rnd(evaluate.ks_statistic(Workspace.of(spark, sf).panel, "irs_risk_score"), ks=6)


@add("e4_block_means", "scored", " UNION ALL ".join(
    f"""SELECT '{b}' AS block, {r("f", "fraud_mean", 5)}, {r("c", "clean_mean", 5)},
    {r("f / greatest(c, 1e-9)", "ratio", 4)} FROM (
    SELECT avg({b}) FILTER (WHERE fraud_label = 1) AS f,
           avg({b}) FILTER (WHERE fraud_label = 0) AS c FROM scored)"""
    for b in V.REPORTED_BLOCKS))
def q_blocks(spark, sf):
    return rnd(evaluate.block_means(reading(spark, sf, "e4_block_means").scores, V.REPORTED_BLOCKS),
               fraud_mean=5, clean_mean=5, ratio=4)


_COMBOS = {
    "irs_high=1, zero_tax=1": "flag_irs_high = 1 AND flag_zero_tax_with_income = 1",
    "irs_high=1, zero_tax=0": "flag_irs_high = 1 AND flag_zero_tax_with_income = 0",
    "irs_high=1, progressive=1": "flag_irs_high = 1 AND flag_progressive_anomaly = 1",
    "irs_high=1, progressive=0": "flag_irs_high = 1 AND flag_progressive_anomaly = 0",
    "irs_high=1, low_wh=1": "flag_irs_high = 1 AND flag_low_withholding = 1",
    "irs_high=1, low_wh=0": "flag_irs_high = 1 AND flag_low_withholding = 0",
    "bdr_extreme=1, impossible_ded=1":
        "flag_bank_deposit_extreme = 1 AND flag_impossible_deductions = 1",
    "bdr_extreme=1, impossible_ded=0":
        "flag_bank_deposit_extreme = 1 AND flag_impossible_deductions = 0",
    "irs_high=1, bdr_extreme=1, low_wh=1":
        "flag_irs_high = 1 AND flag_bank_deposit_extreme = 1 AND flag_low_withholding = 1",
    "irs_high=1, bdr_high=1, zero_tax=1":
        "flag_irs_high = 1 AND flag_bank_deposit_high = 1 AND flag_zero_tax_with_income = 1",
}


@add("e5_flag_combinations", "scored", "SELECT combo, n, rate, lift FROM (" + " UNION ALL ".join(
    f"""SELECT '{k}' AS combo, count(*) AS n, {r("avg(fraud_label)", "rate")},
    {r("avg(fraud_label) / (SELECT avg(fraud_label) FROM scored)", "lift", 5)}
    FROM scored WHERE {v}""" for k, v in _COMBOS.items()) + ") WHERE n > 0")
def q_combos(spark, sf):
    d = reading(spark, sf, "e5_flag_combinations").flagged
    return rnd(evaluate.flag_combinations(d, evaluate.standard_combinations()), rate=6, lift=5)


@add("e6_flag_count_distribution", "scored", f"""SELECT total_flag_count, count(*) AS n,
  {r("count(*) * 100.0 / sum(count(*)) OVER ()", "pct")}, {r("avg(fraud_label)", "rate")},
  {r("avg(fraud_label) / (SELECT avg(fraud_label) FROM scored)", "lift", 5)}
  FROM scored GROUP BY ALL""")
def q_flag_counts(spark, sf):
    return rnd(evaluate.flag_count_distribution(
        reading(spark, sf, "e6_flag_count_distribution").flagged), pct=6, rate=6, lift=5)


def _auc_sql(stage, score, by):
    return f"""SELECT {by}, {r("auc", "auc", 6)}, {r("greatest(auc, 1 - auc)", "auc_either_way", 6)}
  FROM (SELECT {by}, (sum(rk) FILTER (WHERE fraud_label = 1)
      - count(*) FILTER (WHERE fraud_label = 1) * (count(*) FILTER (WHERE fraud_label = 1) + 1) / 2.0)
      / (count(*) FILTER (WHERE fraud_label = 1) * count(*) FILTER (WHERE fraud_label = 0)) AS auc
    FROM (SELECT {by}, fraud_label, rank() OVER (PARTITION BY {by} ORDER BY {score})
        + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS rk FROM {stage}
        WHERE {score} IS NOT NULL) GROUP BY {by})"""


@add("e7_roc_auc_by_year", "panel", _auc_sql("panel", "irs_risk_score", "tax_year"))
def q_auc_year(spark, sf):
    return rnd(evaluate.roc_auc(Workspace.of(spark, sf).panel, "irs_risk_score", ["tax_year"]),
               auc=6, auc_either_way=6)


@add("e7_roc_auc_flags", "scored", _auc_sql("scored", "total_flag_count", "state"))
def q_auc_flags(spark, sf):
    return rnd(evaluate.roc_auc(reading(spark, sf, "e7_roc_auc_flags").flagged, "total_flag_count",
                                ["state"]), auc=6, auc_either_way=6)


@add("e7_roc_auc_master", "scored", f"""SELECT {r("auc", "auc", 5)},
  {r("greatest(auc, 1 - auc)", "auc_either_way", 5)} FROM (
  SELECT (sum(rk) FILTER (WHERE fraud_label = 1) - count(*) FILTER (WHERE fraud_label = 1)
    * (count(*) FILTER (WHERE fraud_label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE fraud_label = 1)
    * count(*) FILTER (WHERE fraud_label = 0)) AS auc
  FROM (SELECT fraud_label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk
    FROM (SELECT fraud_label, floor(master_fraud_propensity * 1e9 + 0.5001) / 1e9 AS s FROM scored)))""")
def q_auc_master(spark, sf):
    d = reading(spark, sf, "e7_roc_auc_master").scores.select(
        "fraud_label", steady("master_fraud_propensity", 9).alias("s"))
    return rnd(evaluate.roc_auc(d, "s"), auc=5, auc_either_way=5)
