"""Queries and SQL twins: the plain relational operators on the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.panel_sql import case_map, flag, r, steady, with_ctes
from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators import merge, profile, sampling
from cohortscope.operators.blocks import optional
from cohortscope.plans.workspace import Workspace

QUERIES, ORACLE = {}, {}
C = F.col


def add(name, upto, sql, extra=""):
    def wrap(fn):
        QUERIES[name] = fn
        ORACLE[name] = with_ctes(upto, sql, extra)
        return fn
    return wrap


@add("j6_j7_semi_anti_join", "panel", """SELECT 'semi' AS kind, count(*) AS n_rows FROM panel
  WHERE person_id IN (SELECT person_id FROM panel WHERE fraud_label = 1)
UNION ALL SELECT 'anti', count(*) FROM panel
  WHERE person_id NOT IN (SELECT person_id FROM panel WHERE fraud_label = 1)""")
def q_semi_anti(spark, sf):
    p = Workspace.of(spark, sf).panel
    ids = p.filter("fraud_label = 1").select("person_id").distinct()
    semi = sampling.pull_rows(p, ids).agg(F.count(F.lit(1)).alias("n_rows"))
    anti = p.join(ids, "person_id", "left_anti").agg(F.count(F.lit(1)).alias("n_rows"))
    return (semi.select(F.lit("semi").alias("kind"), "n_rows")
            .unionByName(anti.select(F.lit("anti").alias("kind"), "n_rows")))


@add("u3_u4_set_operations", "panel", """
SELECT 'both' AS kind, person_id FROM (SELECT person_id FROM panel WHERE tax_year = 2024
  INTERSECT SELECT person_id FROM panel WHERE tax_year = 2025)
UNION ALL SELECT 'only_2025', person_id FROM (SELECT person_id FROM panel WHERE tax_year = 2025
  EXCEPT SELECT person_id FROM panel WHERE tax_year = 2024)""")
def q_sets(spark, sf):
    p = Workspace.of(spark, sf).panel
    a = p.filter("tax_year = 2024").select("person_id")
    b = p.filter("tax_year = 2025").select("person_id")
    return (a.intersect(b).select(F.lit("both").alias("kind"), "person_id")
            .unionByName(b.subtract(a).select(F.lit("only_2025").alias("kind"), "person_id")))


@add("l1_l5_first_row_per_person", "panel", f"""SELECT person_id, tax_year, {r("agi", "agi", 7)} FROM panel
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY tax_year) = 1 ORDER BY person_id""")
def q_first(spark, sf):
    p = Workspace.of(spark, sf).panel
    first = p.groupBy("person_id").agg(F.min_by(F.struct("tax_year", "agi"), "tax_year").alias("r"))
    return first.select("person_id", "r.tax_year", steady(C("r.agi"), 7).alias("agi")).orderBy(
        "person_id")


@add("l6_sorted_years", "panel", "SELECT tax_year, count(*) AS n_rows FROM panel GROUP BY ALL "
     "ORDER BY tax_year")
def q_sorted(spark, sf):
    return Workspace.of(spark, sf).panel.groupBy("tax_year").agg(
        F.count(F.lit(1)).alias("n_rows")).orderBy("tax_year")


@add("p3_p5_drop_rename_default", "panel", """SELECT person_id AS entity, tax_year AS period,
  coalesce(age, 45.0)::DOUBLE AS age, 0.0::DOUBLE AS unseen FROM panel""")
def q_project(spark, sf):
    p = merge.drop_leakage(Workspace.of(spark, sf).panel)
    assert not set(V.LEAKAGE) & set(p.columns)
    d = p.withColumns({"age": optional(p, "age", 45.0), "unseen": optional(p, "no_such_column")})
    return d.withColumnsRenamed({"person_id": "entity", "tax_year": "period"}).select(
        "entity", "period", "age", "unseen")


@add("p7_p10_predicates", "panel", f"""SELECT person_id, tax_year,
  CASE WHEN age BETWEEN 60 AND 70 THEN 'near' WHEN age > 70 THEN 'past' ELSE 'before' END AS stage,
  {flag("taxpayer_type IN ('pure_se', 'retired')")} AS picked,
  {case_map("zone", V.ZONE_TO_STATE)} AS zone_state, {r("least(net_se_income, w2_wages)", "smaller", 7)}
  FROM panel WHERE fraud_label = 0 AND tax_year BETWEEN 2020 AND 2024 AND agi IS NOT NULL
  AND net_se_income IS NOT NULL AND w2_wages IS NOT NULL""")
def q_predicates(spark, sf):
    p = Workspace.of(spark, sf).panel
    d = p.filter((C("fraud_label") == 0) & C("tax_year").between(2020, 2024)
                 & C("agi").isNotNull() & C("net_se_income").isNotNull()
                 & C("w2_wages").isNotNull())
    stage = (F.when(C("age").between(60, 70), "near").when(C("age") > 70, "past")
             .otherwise("before"))
    return merge.with_state(d.drop("state")).select(
        "person_id", "tax_year", stage.alias("stage"),
        E.flag(C("taxpayer_type").isin("pure_se", "retired")).alias("picked"),
        C("state").alias("zone_state"), steady(F.least("net_se_income", "w2_wages"), 7)
        .alias("smaller"))


@add("w10_lag_change", "panel", f"""SELECT person_id, tax_year, {r("(agi - prev) / nullif(abs(prev), 0)", "change", 7)} FROM (
  SELECT *, lag(agi) OVER (PARTITION BY person_id ORDER BY tax_year) AS prev FROM panel)""")
def q_lag(spark, sf):
    # one row per person and year: at most seven rows per window
    w = Window.partitionBy("person_id").orderBy("tax_year")
    return Workspace.of(spark, sf).panel.select(
        "person_id", "tax_year", steady(profile.percent_change(F.col("agi"), F.lag("agi").over(w)), 7)
        .alias("change"))
