"""Queries and SQL twins: sampling, splits, rate enforcement, alignment, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.feature_checks import PANEL_FLOATS, PANEL_INTS, PANEL_TEXT
from checks.panel_sql import (case_map, clip, digest, drawn, quote, r, steady, uniform,
                              with_ctes)
from checks.profile_checks import index_sql, rnd
from cohortscope import vocab as V
from cohortscope.operators import merge, ordering, profile, quality, sampling, splits
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


TARGET = 500    # rows per state: well under the 1 000+ of the smallest test folder

# -------------------------------------------------------------- state sampling


def targets_sql(target: int) -> str:
    return index_sql("state, person_id") + f""",
cells AS (SELECT state, lifecycle, fraud_pattern, count(*) AS cell_size, sum(n_rows) AS cell_rows
  FROM pindex GROUP BY ALL),
state_means AS (SELECT state,
    sum(cell_rows) FILTER (WHERE fraud_pattern <> 'clean') / sum(cell_size) FILTER (WHERE fraud_pattern <> 'clean') AS mf,
    sum(cell_rows) FILTER (WHERE fraud_pattern = 'clean') / sum(cell_size) FILTER (WHERE fraud_pattern = 'clean') AS mc
  FROM cells GROUP BY state),
totals AS (SELECT state, round_even({target}.0::DOUBLE * rate / mf, 0) AS nf,
    round_even({target}.0::DOUBLE * (1 - rate) / mc * 1.1::DOUBLE, 0) AS nc
  FROM (SELECT *, {case_map("state", V.STATE_TARGET_RATE)}::DOUBLE AS rate FROM state_means)),
targets AS (SELECT state, lifecycle, fraud_pattern, cell_size, least(CAST(round_even(
    CASE fraud_pattern WHEN 'clean' THEN nc
      ELSE round_even(nf * {case_map("fraud_pattern", V.PATTERN_SHARE)}::DOUBLE, 0) END
    * {case_map("lifecycle", V.LIFECYCLE_SHARE)}::DOUBLE, 0) AS BIGINT), cell_size) AS n_target
  FROM cells JOIN totals USING (state))"""


def drawn_sql(target: int) -> str:
    return targets_sql(target) + f""",
strata AS (SELECT *, n_target * n / sum(n) OVER (PARTITION BY state, lifecycle, fraud_pattern) AS exact
  FROM (SELECT state, lifecycle, fraud_pattern, taxpayer_type, count(*) AS n FROM pindex GROUP BY ALL)
  JOIN targets USING (state, lifecycle, fraud_pattern) WHERE n_target > 0),
allocated AS (SELECT *, least(floor(exact) + CASE WHEN row_number() OVER (
      PARTITION BY state, lifecycle, fraud_pattern ORDER BY exact - floor(exact) DESC, taxpayer_type)
    <= n_target - sum(floor(exact)) OVER (PARTITION BY state, lifecycle, fraud_pattern)
    THEN 1 ELSE 0 END, n) AS n_take FROM strata),
drawn AS (SELECT * FROM (SELECT p.*, n_take, row_number() OVER (
      PARTITION BY p.state, p.lifecycle, p.fraud_pattern, p.taxpayer_type
      ORDER BY {digest(V.SEED, "p.person_id")}, p.person_id) AS rn
    FROM pindex p JOIN allocated a USING (state, lifecycle, fraud_pattern, taxpayer_type))
  WHERE rn <= n_take),
state_rows AS (SELECT state, sum(n_rows) AS rows FROM drawn GROUP BY ALL),
gone AS (SELECT state, person_id FROM (
    SELECT d.state, d.person_id, n_rows, rows, sum(n_rows) OVER (PARTITION BY d.state
      ORDER BY {digest(f"{V.SEED}-trim", "d.person_id")}, d.person_id) - n_rows AS removed_before
    FROM drawn d JOIN state_rows USING (state) WHERE fraud_pattern = 'clean')
  WHERE rows > {target} * 1.025 AND removed_before < rows - {target} - 50),
sample AS (SELECT * FROM panel p WHERE EXISTS (SELECT 1 FROM drawn d WHERE d.state = p.state
    AND d.person_id = p.person_id) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.state = p.state
    AND g.person_id = p.person_id))"""


TARGETS, DRAWN = targets_sql(TARGET), drawn_sql(TARGET)


def _index(spark, sf):
    return profile.person_index(Workspace.of(spark, sf).panel, ["state", "person_id"])


@add("m4_cell_targets", "panel",
     "SELECT state, lifecycle, fraud_pattern, cell_size, n_target FROM targets", TARGETS)
def q_targets(spark, sf):
    return sampling.cell_targets(_index(spark, sf), TARGET)


@add("w5_m5_sampled_persons", "panel", "SELECT state, person_id, lifecycle, fraud_pattern, "
     "taxpayer_type FROM drawn", DRAWN)
def q_drawn(spark, sf):
    index = _index(spark, sf)
    d = sampling.sampled_persons(index, sampling.cell_targets(index, TARGET))
    return d.select("state", "person_id", "lifecycle", "fraud_pattern", "taxpayer_type")


TRIMMED = 100   # rows per state that whole states are trimmed to: all hold more


@add("w7_m7_trimmed_persons", "panel", """
SELECT 'drawn' AS trimmed_from, state, person_id, d.n_rows FROM gone JOIN drawn d USING (state, person_id)
UNION ALL SELECT 'state', state, person_id, n_rows FROM trimmed""", DRAWN + f""",
held AS (SELECT state, sum(n_rows) AS rows FROM pindex GROUP BY ALL),
trimmed AS (SELECT state, person_id, n_rows FROM (
    SELECT p.state, p.person_id, n_rows, rows, sum(n_rows) OVER (PARTITION BY p.state
      ORDER BY {digest(f"{V.SEED}-trim", "p.person_id")}, p.person_id) - n_rows AS removed_before
    FROM pindex p JOIN held USING (state) WHERE fraud_pattern = 'clean')
  WHERE rows > {TRIMMED} * 1.025 AND removed_before < rows - {TRIMMED} - 50)""")
def q_trim(spark, sf):
    """Persons that the drawn sample loses, and those that whole states would lose."""
    index = _index(spark, sf)
    drawn = sampling.sampled_persons(index, sampling.cell_targets(index, TARGET))
    return _gone(drawn, TARGET, "drawn").unionByName(_gone(index, TRIMMED, "state"))


def _gone(persons, target, name):
    return sampling.trim_persons(persons, target).select(
        F.lit(name).alias("trimmed_from"), "state", "person_id", "n_rows")


@add("m6_m8_state_samples", "panel", f"SELECT state, person_id, tax_year, fraud_label, "
     f"{r('agi', 'agi', 5)} FROM sample", DRAWN)
def q_sample(spark, sf):
    s = sampling.sample_states(Workspace.of(spark, sf).panel, TARGET, drop=["fraud_category"])
    return s.select("state", "person_id", "tax_year", "fraud_label", steady("agi", 5).alias("agi"))


@add("m9_sample_report", "panel", f"""
SELECT state, 'rows' AS item, 'all' AS value, count(*)::DOUBLE AS amount FROM sample GROUP BY ALL
UNION ALL SELECT state, 'persons', 'all', count(DISTINCT person_id)::DOUBLE FROM sample GROUP BY ALL
UNION ALL SELECT state, 'rate', 'all', round(avg(fraud_label), 8) FROM sample GROUP BY ALL
UNION ALL SELECT state, 'year', CAST(tax_year AS VARCHAR), count(*)::DOUBLE FROM sample GROUP BY ALL
UNION ALL SELECT state, 'lifecycle', lifecycle,
  round(count(*) / sum(count(*)) OVER (PARTITION BY state), 8) FROM kept GROUP BY state, lifecycle
UNION ALL SELECT state, 'detail', fraud_detail, count(*)::DOUBLE FROM kept
  WHERE fraud_ever = 1 GROUP BY state, fraud_detail""", DRAWN + """,
kept AS (SELECT * FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.state = d.state
  AND g.person_id = d.person_id))""")
def q_report(spark, sf):
    s = sampling.sample_states(Workspace.of(spark, sf).panel, TARGET)
    return rnd(sampling.sample_report(s), amount=8)


# -------------------------------------------------------------------- hash picks
@add("l2_shuffled_rows", "panel", f"""SELECT person_id, tax_year, row_number() OVER (ORDER BY
  {digest(7, "person_id", "tax_year")}) - 1 AS position FROM panel""")
def q_shuffle(spark, sf):
    p = Workspace.of(spark, sf).panel_of("person_id", "tax_year")
    return ordering.number_by_hash(p, [], ["person_id", "tax_year"], 7)


@add("l3_sample_without_replacement", "panel", f"""SELECT person_id, tax_year, state FROM (
  SELECT *, row_number() OVER (ORDER BY {digest("l3", "person_id", "tax_year")}) AS rn FROM panel)
  WHERE rn <= 1000""")
def q_without(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "state")
    return splits.sample_rows(p, 1000, "l3")


@add("l4_sample_with_replacement", "panel", f"""SELECT draw, person_id, tax_year FROM (
  SELECT i AS draw, {drawn(digest("l4-draw", "i"), "(SELECT count(*) FROM panel)")} AS position FROM range(3000) t(i)) JOIN (
  SELECT person_id, tax_year, row_number() OVER (ORDER BY {digest("l4", "person_id", "tax_year")}) - 1
    AS position FROM panel) USING (position)""")
def q_with(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year")
    return ordering.draw_with_replacement(p, ["person_id", "tax_year"], "l4", 3000, p.count())


@add("w6_m10_proportional_sample", "panel", f"""SELECT person_id, tax_year, taxpayer_type FROM (
  SELECT p.*, n_take, row_number() OVER (PARTITION BY taxpayer_type ORDER BY
    {digest("m10", "person_id", "tax_year")}) AS rn FROM panel p JOIN alloc USING (taxpayer_type))
  WHERE rn <= n_take""", """
sizes AS (SELECT taxpayer_type, count(*) AS n, floor(count(*) / (SELECT count(*) FROM panel) * 1234)
  AS base FROM panel GROUP BY ALL),
alloc AS (SELECT taxpayer_type, base + CASE WHEN row_number() OVER (ORDER BY n DESC, taxpayer_type)
  <= 1234 - (SELECT sum(base) FROM sizes) THEN 1 ELSE 0 END AS n_take FROM sizes)""")
def q_proportional(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "taxpayer_type")
    return splits.proportional_sample(p, 1234, "taxpayer_type", "m10")


# --------------------------------------------------------------- rate enforcement
def _numbered(name, where, seed):
    return (f"{name} AS (SELECT *, row_number() OVER (ORDER BY "
            f"{digest(seed, 'person_id', 'tax_year')}) - 1 AS position FROM panel WHERE {where})")


@add("m11_raise_rate", "panel", f"""SELECT person_id, tax_year, fraud_label, count(*) AS copies FROM (
  SELECT person_id, tax_year, fraud_label FROM panel
  UNION ALL SELECT person_id, tax_year, fraud_label FROM (SELECT {drawn(digest("m11-draw", "i"), "pos")} AS position
    FROM counts, range(CAST(ceil(0.35::DOUBLE * neg / (1 - 0.35::DOUBLE)) AS BIGINT) - pos) t(i))
  JOIN evaders USING (position)) GROUP BY ALL""", f"""
counts AS (SELECT sum(fraud_label)::BIGINT AS pos, (count(*) - sum(fraud_label))::BIGINT AS neg FROM panel),
{_numbered("evaders", "fraud_label = 1", "m11")}""")
def q_raise(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "fraud_label")
    d = splits.raise_rate(p, 0.35, 0.015, "m11")
    return d.groupBy("person_id", "tax_year", "fraud_label").agg(F.count(F.lit(1)).alias("copies"))


@add("m12_fix_rate_constant_n", "panel", f"""SELECT person_id, tax_year, fraud_label, count(*) AS copies FROM (
  SELECT person_id, tax_year, fraud_label FROM (SELECT {drawn(digest("m12-1-draw", "i"), "pos")} AS position
    FROM counts, range(CAST(round_even(n * 0.35::DOUBLE, 0) AS BIGINT)) t(i))
  JOIN evaders USING (position)
  UNION ALL SELECT person_id, tax_year, fraud_label FROM clean_rows, counts
  WHERE position < n - CAST(round_even(n * 0.35::DOUBLE, 0) AS BIGINT)) GROUP BY ALL""", f"""
counts AS (SELECT sum(fraud_label)::BIGINT AS pos, count(*) AS n FROM panel),
{_numbered("evaders", "fraud_label = 1", "m12-1")},
{_numbered("clean_rows", "fraud_label = 0", "m12-0")}""")
def q_fix(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "fraud_label")
    d = splits.fix_rate(p, 0.35, 0.015, "m12")
    return d.groupBy("person_id", "tax_year", "fraud_label").agg(F.count(F.lit(1)).alias("copies"))


# ------------------------------------------------------------------------ splits
@add("m13_split_by_year", "panel", """SELECT person_id, tax_year, CASE WHEN tax_year <= 2023
  THEN 'train' WHEN tax_year = 2024 THEN 'val' ELSE 'test' END AS split FROM panel""")
def q_year_split(spark, sf):
    return splits.split_by_year(Workspace.of(spark, sf).panel).select(
        "person_id", "tax_year", "split")


@add("m13_training_subsets", "panel", f"""
SELECT 'employees' AS subset, count(*) AS n_rows, {r("avg(fraud_label)", "rate", 8)} FROM panel
  WHERE tax_year <= 2023 AND taxpayer_type IN ('pure_w2', 'w2_with_side_biz')
UNION ALL SELECT 'self_employed', count(*), round(avg(fraud_label), 8) FROM panel
  WHERE tax_year <= 2023 AND taxpayer_type IN ('pure_se', 'gig_only', 'business_owner', 'multi_biz_owner')
UNION ALL SELECT 'itemizers', count(*), round(avg(fraud_label), 8) FROM panel
  WHERE tax_year <= 2023 AND uses_itemized = 1""")
def q_subsets(spark, sf):
    train = Workspace.of(spark, sf).panel.filter("tax_year <= 2023")
    out = None
    for name, d in splits.year_subsets(train).items():
        part = d.agg(F.count(F.lit(1)).alias("n_rows"),
                     steady(F.avg("fraud_label"), 8).alias("rate")).withColumn(
            "subset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@add("m14_split_by_person", "panel", """SELECT person_id, tax_year, CASE
  WHEN person_id IN (SELECT person_id FROM panel WHERE tax_year <= 2023) THEN 'train'
  WHEN tax_year = 2024 THEN 'val' ELSE 'test' END AS split FROM panel""")
def q_person_split(spark, sf):
    return splits.split_by_person(Workspace.of(spark, sf).panel).select(
        "person_id", "tax_year", "split")


_BAND = {"target": 0.21, "tol": 0.015}


@add("m14_split_bundle", "panel", f"""
SELECT split, CAST(n + up + down AS BIGINT) AS n_rows,
  {r("(pos + up) / (n + up + down)::DOUBLE", "rate", 8)}, {_BAND["target"]}::DOUBLE AS target,
  CASE WHEN abs((pos + up) / (n + up + down)::DOUBLE - {_BAND["target"]}) <= {_BAND["tol"]} THEN 1 ELSE 0 END AS ok,
  n_persons, n_known, n_persons - n_known AS n_new
FROM (SELECT *,
  CASE WHEN NOT trained OR pos / n::DOUBLE >= {_BAND["target"]} - {_BAND["tol"]} THEN 0 ELSE greatest(
    CAST(ceil({_BAND["target"]}::DOUBLE * (n - pos) / (1 - {_BAND["target"]}::DOUBLE)) AS BIGINT) - pos, 0) END AS up,
  CASE WHEN NOT trained OR pos / n::DOUBLE <= {_BAND["target"]} + {_BAND["tol"]} THEN 0 ELSE greatest(
    CAST(ceil((1 - {_BAND["target"]}::DOUBLE) * pos / {_BAND["target"]}::DOUBLE) AS BIGINT) - (n - pos), 0) END AS down
  FROM (SELECT split, split LIKE '%train' AS trained, count(*) AS n, sum(lab)::BIGINT AS pos,
      count(DISTINCT person_id) AS n_persons,
      count(DISTINCT CASE WHEN known THEN person_id END) AS n_known
    FROM bundle GROUP BY split))""", """
fixed AS (SELECT person_id, tax_year, CASE WHEN fraud_label = 1 AND fraud_type = 'none' THEN 0
    ELSE fraud_label END AS lab, person_id IN (
      SELECT person_id FROM panel WHERE tax_year <= 2023) AS known,
    CASE WHEN tax_year <= 2023 THEN 'train' WHEN tax_year = 2024 THEN 'val' ELSE 'test' END AS y FROM panel),
bundle AS (SELECT person_id, lab, known, y AS split FROM fixed
  UNION ALL SELECT person_id, lab, known, 'person_' || CASE WHEN known THEN 'train' ELSE y END FROM fixed)""")
def q_bundle(spark, sf):
    """Use cases A and B with enforced training rates: rows, rates, known persons."""
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "taxpayer_type",
                                             "uses_itemized", "fraud_label", "fraud_type")
    parts = splits.build_splits(p)
    six = {n: d for n, d in parts.items() if n.removeprefix("person_") in ("train", "val", "test")}
    return rnd(splits.split_metrics(six, V.RATE_OVERALL, V.RATE_TOLERANCE), rate=8)


@add("m15_seed_purity", "panel", """SELECT split, rule, value, severity, passed FROM (
  SELECT 'seed_evaders' AS split, 'seed_purity' AS rule, 1.0::DOUBLE AS value, 'error' AS severity, 1 AS passed
  FROM panel WHERE fraud_label = 1 HAVING count(*) > 0
  UNION ALL SELECT 'seed_compliant', 'seed_purity', 0.0::DOUBLE, 'error', 1
  FROM panel WHERE fraud_label = 0 HAVING count(*) > 0)""")
def q_purity(spark, sf):
    p = Workspace.of(spark, sf).panel
    seeds = splits.seed_panels(p)
    tagged = None
    for name in ("seed_evaders", "seed_compliant"):
        d = seeds[name].select("tax_year", "fraud_label", F.lit(name).alias("split"))
        tagged = d if tagged is None else tagged.unionByName(d)
    return quality.check_splits(tagged, {}).filter("rule = 'seed_purity'")


@add("m15_seed_panels", "panel", f"""
SELECT 'seed_compliant' AS seed, person_id, tax_year FROM (SELECT *, row_number() OVER (ORDER BY
  {digest("42-compliant", "person_id", "tax_year")}) AS rn FROM panel WHERE fraud_label = 0)
  WHERE rn <= (SELECT least(4 * sum(fraud_label), count(*) - sum(fraud_label)) FROM panel)
UNION ALL SELECT 'seed_evaders', person_id, tax_year FROM panel WHERE fraud_label = 1
""" + "".join(f"""
UNION ALL SELECT 'seed_{k}', person_id, tax_year FROM (SELECT s.*, n_take, row_number() OVER (
  PARTITION BY taxpayer_type ORDER BY {digest(f"42-{k}", "person_id", "tax_year")}) AS rn
  FROM (SELECT * FROM panel WHERE {w}) s JOIN (
    SELECT taxpayer_type, CASE WHEN total <= 300 THEN n ELSE base + CASE WHEN row_number() OVER (ORDER BY n DESC, taxpayer_type)
      <= 300 - sum(base) OVER () THEN 1 ELSE 0 END END AS n_take FROM (
      SELECT taxpayer_type, count(*) AS n, sum(count(*)) OVER () AS total,
        floor(count(*) / sum(count(*)) OVER () * 300) AS base
      FROM panel WHERE {w} GROUP BY taxpayer_type)) a USING (taxpayer_type)) WHERE rn <= n_take"""
    for k, w in [("employees", "taxpayer_type IN ('pure_w2', 'w2_with_side_biz')"),
                 ("self_employed", "taxpayer_type IN ('pure_se', 'gig_only', 'business_owner', 'multi_biz_owner')"),
                 ("itemizers", "uses_itemized = 1")]))
def q_seeds(spark, sf):
    p = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "fraud_label",
                                             "taxpayer_type", "uses_itemized")
    out = None
    for name, d in splits.seed_panels(p, 300).items():
        part = d.select(F.lit(name).alias("seed"), "person_id", "tax_year")
        out = part if out is None else out.unionByName(part)
    return out


@add("j15_split_overlap", "panel", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS left_set, '{b}' AS right_set, count(*) AS shared FROM (SELECT DISTINCT "
    f"person_id FROM panel WHERE {wa} INTERSECT SELECT DISTINCT person_id FROM panel WHERE {wb})"
    for a, b, wa, wb in [("train", "val", "tax_year <= 2023", "tax_year = 2024"),
                         ("train", "test", "tax_year <= 2023", "tax_year = 2025"),
                         ("val", "test", "tax_year = 2024", "tax_year = 2025")]) + ")")
def q_overlap(spark, sf):
    p = Workspace.of(spark, sf).panel
    return splits.set_overlap({"train": p.filter("tax_year <= 2023"),
                               "val": p.filter("tax_year = 2024"),
                               "test": p.filter("tax_year = 2025")})


@add("p11_fix_contradictions", "panel", f"""SELECT person_id, tax_year,
  CASE WHEN fraud_label = 1 AND ft = 'none' THEN 0 ELSE fraud_label END AS fraud_label,
  CASE WHEN fraud_label = 1 AND ft = 'none' THEN 'none' ELSE fraud_category END AS fraud_category,
  CASE WHEN fraud_label = 1 AND ft = 'none' THEN NULL ELSE round(evasion_amount, 5) END AS evasion_amount
  FROM (SELECT *, CASE WHEN fraud_type = 'cash_skimming' THEN 'none' ELSE fraud_type END AS ft FROM panel)""")
def q_contradictions(spark, sf):
    p = Workspace.of(spark, sf).panel.withColumn("fraud_type", F.when(
        C("fraud_type") == "cash_skimming", "none").otherwise(C("fraud_type")))
    return rnd(splits.fix_contradictions(p), evasion_amount=5).select(
        "person_id", "tax_year", "fraud_label", "fraud_category", "evasion_amount")


# ------------------------------------------------------------ alignment and merge
_TAGS = list(V.SOURCE_PREFIX)
_SHOW = ["age", "first_year_filing", "has_schedule_c", "has_gig", "fraud_label", "has_rental",
         "has_crypto", "uses_itemized", "fbar_required"]
_TEXT = ["taxpayer_type", "employer_id", "filing_status", "sex", "fraud_type", "fraud_category"]
_NUM = ["w2_wages", "federal_withheld", "gross_receipts", "rental_net", "crypto_proceeds",
        "foreign_income", "social_security_income", "gig_income", "agi"]
_HELD = {*PANEL_TEXT, *PANEL_INTS, *PANEL_FLOATS}
_VALUES = [c for c in V.CANONICAL if c not in ("person_id", "tax_year", "data_source")]


def shown(cols, places=7):
    """Columns of a twin, floating ones rounded."""
    return ", ".join(r(c, c, places) if c in PANEL_FLOATS else c for c in cols)


def whole(df, cols, places=7):
    """The same columns on the Spark side."""
    return rnd(df.select(*cols), **{c: places for c in cols if c in PANEL_FLOATS})


def _source_sql(i, tag):
    missing = {"ctab_w2": ["crypto_proceeds", "crypto_cost_basis", "gig_income"],
               "timegan_evader": ["employer_id", "filing_status"]}.get(tag, [])
    cols = []
    for c in _VALUES:
        none = c in missing or c not in _HELD
        kind = ("BIGINT" if c in V.CANONICAL_INT else
                "VARCHAR" if c in V.CANONICAL_STRING else "DOUBLE")
        cols.append(f"CAST({'NULL' if none else c} AS {kind}) AS {c}")
    acc, arms, whole = 0, [], float(sum(V.TRAIN_YEAR_WEIGHTS.values()))
    for y, w in list(V.TRAIN_YEAR_WEIGHTS.items())[:-1]:
        acc += w
        arms.append(f"WHEN u < {acc / whole}::DOUBLE THEN {y}")
    year = "tax_year"
    if tag == "ctab_se":
        year = (f"CASE WHEN tax_year <> 2022 THEN tax_year ELSE (CASE {' '.join(arms)} "
                "ELSE 2023 END) END")
    copies = "UNION ALL SELECT * FROM panel WHERE CAST(person_id AS BIGINT) % 6 = 0 AND CAST(person_id AS BIGINT) % 4 = 0" if tag == "real" else ""
    return f"""SELECT '{V.SOURCE_PREFIX[tag]}_' || person_id AS person_id, {year} AS tax_year,
    '{tag}' AS data_source, {i} AS prio, {", ".join(cols)}
    FROM (SELECT *, {uniform(digest(f"42-{tag}", "person_id"))} AS u FROM (
      SELECT * FROM panel WHERE CAST(person_id AS BIGINT) % 6 = {i} {copies}))"""


ALIGNED = "aligned AS (" + " UNION ALL ".join(_source_sql(i, t) for i, t in enumerate(_TAGS)) + ")"


def _aligned(spark, sf):
    parts = fixtures.sources(Workspace.of(spark, sf).panel)
    return merge.union_sources([merge.align(d, t) for t, d in parts.items()])


@add("p6_u1_aligned_sources", "panel", f"""SELECT person_id, tax_year, data_source, zone,
  {", ".join(_SHOW + _TEXT)}, {", ".join(r(c, c, 7) for c in _NUM)} FROM aligned""", ALIGNED)
def q_align(spark, sf):
    d = _aligned(spark, sf).select("person_id", "tax_year", "data_source", "zone",
                                   *_SHOW, *_TEXT, *_NUM)
    return rnd(d, **dict.fromkeys(_NUM, 7))


# the winner of equal source rank is the smallest row in canonical column order
BEST = ALIGNED + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, tax_year ORDER BY prio,
  """ + ", ".join(f"{c} NULLS FIRST" for c in _VALUES) + """) AS rn FROM aligned) WHERE rn = 1)"""


@add("w8_priority_dedup", "panel",
     "SELECT person_id, tax_year, data_source FROM best", BEST)
def q_dedup(spark, sf):
    return merge.keep_best(_aligned(spark, sf), ["person_id", "tax_year"]).select(
        "person_id", "tax_year", "data_source")


def policed(cols) -> str:
    """Every column under the null policy."""
    out = []
    for c in cols:
        x = c
        if c in V.SE_COLUMNS:
            x = f"CASE WHEN taxpayer_type IN ({quote(V.SE_INCOME_TYPES)}) THEN {x} END"
        for switch, gated in V.NULL_WHEN_FLAG_OFF.items():
            if c in gated:
                x = f"CASE WHEN coalesce({switch} <> 0, TRUE) THEN {x} END"
        if c == "social_security_income":
            x = f"CASE WHEN coalesce(age >= 62, TRUE) THEN {x} END"
        if c in V.WAGE_COLUMNS:
            x = (f"CASE WHEN NOT coalesce(taxpayer_type IN ({quote(V.W2_TYPES)}) "
                 f"AND coalesce(w2_wages, 0) = 0, FALSE) THEN {x} END")
        if c in V.INT_FLAGS:
            x = f"CAST(coalesce({x}, 0) AS BIGINT)"
        out.append(f"{x} AS {c}")
    return ", ".join(out)


_PANEL = ["person_id", "tax_year", *PANEL_TEXT, *PANEL_INTS, *PANEL_FLOATS]


@add("p12_null_policy", "panel", f"SELECT {shown(_PANEL)} FROM policed",
     f"policed AS (SELECT {policed(_PANEL)} FROM panel)")
def q_policy(spark, sf):
    return whole(merge.null_policy(Workspace.of(spark, sf).panel), _PANEL)


@add("m16_merge_counts", "panel", f"""SELECT data_source, fraud_label, count(*) AS n_rows FROM (
  SELECT data_source, fraud_label FROM (SELECT *, row_number() OVER (ORDER BY
    {digest("42-1", "person_id", "tax_year")}) AS k FROM best WHERE fraud_label = 1), want
    WHERE k <= want_pos
  UNION ALL SELECT data_source, fraud_label FROM (SELECT *, row_number() OVER (ORDER BY
    {digest("42-0", "person_id", "tax_year")}) - 1 AS position FROM best WHERE fraud_label = 0)
  JOIN (SELECT {drawn(digest("42-0-draw", "i"), "neg")} AS position
    FROM want, range(n - want_pos) t(i)) USING (position)) GROUP BY ALL""", BEST + """,
want AS (SELECT count(*) AS n, CAST(round_even(count(*) * 0.12::DOUBLE, 0) AS BIGINT) AS want_pos,
  (count(*) - sum(fraud_label))::BIGINT AS neg FROM best)""")
def q_merge(spark, sf):
    parts = fixtures.sources(Workspace.of(spark, sf).panel)
    d = merge.merge_sources(parts, 0.12, 0.01, shuffled=False)
    return d.groupBy("data_source", "fraud_label").agg(F.count(F.lit(1)).alias("n_rows"))


MERGED = ["person_id", "tax_year", "data_source", *_VALUES]


@add("m16_merged_rows", "panel", f"""SELECT {shown(MERGED)} FROM (
  SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (ORDER BY
    {digest("42-1", "person_id", "tax_year")}) AS k FROM clean WHERE fraud_label = 1), want
    WHERE k <= want_pos
  UNION ALL BY NAME SELECT * EXCLUDE position FROM (SELECT *, row_number() OVER (ORDER BY
    {digest("42-0", "person_id", "tax_year")}) - 1 AS position FROM clean WHERE fraud_label = 0)
  JOIN (SELECT {drawn(digest("42-0-draw", "i"), "neg")} AS position
    FROM want, range(n - want_pos) t(i)) USING (position))""", BEST + f""",
policed AS (SELECT {policed(MERGED)} FROM best),
clean AS (SELECT * REPLACE (CASE WHEN fraud_label = 0 THEN 'none' ELSE fraud_type END AS fraud_type,
  CASE WHEN fraud_label = 0 THEN 'none' ELSE fraud_category END AS fraud_category) FROM policed),
want AS (SELECT count(*) AS n, CAST(round_even(count(*) * 0.12::DOUBLE, 0) AS BIGINT) AS want_pos,
  (count(*) - sum(fraud_label))::BIGINT AS neg FROM clean)""")
def q_merged(spark, sf):
    parts = fixtures.sources(Workspace.of(spark, sf).panel)
    return whole(merge.merge_sources(parts, 0.12, 0.01), MERGED)


@add("p15_fill_for_model", "panel", f"""SELECT person_id, tax_year, coalesce(employer_id,
  (SELECT employer_id FROM panel WHERE employer_id IS NOT NULL GROUP BY ALL
   ORDER BY count(*) DESC, employer_id LIMIT 1)) AS employer_id, coalesce(fraud_type, 'none') AS fraud_type,
  {r("coalesce(agi, 0)", "agi", 5)}, coalesce(age, 0) AS age FROM panel""")
def q_fill(spark, sf):
    d = merge.fill_for_model(Workspace.of(spark, sf).panel, ["entry_cohort", "first_year_filing"])
    return rnd(d, agi=5).select("person_id", "tax_year", "employer_id", "fraud_type", "agi", "age")


# rows as a model may make them: below zero, beyond bounds, between labels
_MADE = {"agi": "agi - 20000", "effective_tax_rate": "effective_tax_rate", "age": "age * 1.5 - 15",
         "w2_wages": "w2_wages - 30000", "gross_receipts": "gross_receipts - 10000",
         "cogs": "cogs * 9 - 500", "total_expenses": "deduction_taken - 14000",
         "itemized_salt": "deduction_taken - 12500", "taxable_income": "taxable_income",
         "fraud_label": "fraud_label * 1.6 - 0.2 + CAST(person_id AS BIGINT) % 3 * 0.3",
         "total_tax_liability": "total_tax_liability - 5000", "net_se_income": "net_se_income",
         "social_security_income": "social_security_income", "uses_itemized": "uses_itemized",
         "fraud_type": "fraud_type", "fraud_category": "fraud_category"}
_MODELS = ["w2", "se", "itemizers"]


def _made_sql(c):
    return f"CAST({_MADE[c]} AS DOUBLE) AS {c}" if c not in (
        "fraud_type", "fraud_category", "uses_itemized") else c


def _repaired(model):
    cogs = f"least({clip('cogs', 0)}, {clip('gross_receipts', 0)})"
    out = {"agi": clip("agi", 0), "taxable_income": f"least({clip('taxable_income', 0)}, {clip('agi', 0)})",
           "effective_tax_rate": clip("effective_tax_rate", 0, 0.37),
           "age": f"CAST(round_even({clip('age', 18, 85)}, 0) AS INT)",
           "total_tax_liability": clip("total_tax_liability", 0),
           "fraud_label": f"CAST(round_even({clip('fraud_label', 0, 1)}, 0) AS INT)"}
    for c in ("fraud_type", "fraud_category"):
        out[c] = f"CASE WHEN {out['fraud_label']} = 0 THEN 'none' ELSE {c} END"
    if model == "w2":
        out["w2_wages"] = clip("w2_wages", 0)
        out["social_security_income"] = (
            f"CASE WHEN coalesce({out['age']} >= 62, TRUE) THEN social_security_income END")
    if model == "se":
        out["gross_receipts"], out["total_expenses"] = clip("gross_receipts", 0), clip("total_expenses", 0)
        out["cogs"] = cogs
        net = f"{out['gross_receipts']} - coalesce({cogs}, 0) - coalesce({out['total_expenses']}, 0)"
        out["net_se_income"] = clip(net, -200000)
    if model == "itemizers":
        out["itemized_salt"], out["uses_itemized"] = clip("itemized_salt", 0, 10000), "1"
    text = ("age", "fraud_label", "fraud_type", "fraud_category", "uses_itemized")
    cols = ", ".join(f"{out.get(c, c)} AS {c}" if c in text else
                     r(out.get(c, c), c, 6 if c == "effective_tax_rate" else 5) for c in _MADE)
    return f"SELECT '{model}' AS model, person_id, tax_year, {cols} FROM made"


@add("p16_repair_generated", "panel", " UNION ALL ".join(map(_repaired, _MODELS)),
     "made AS (SELECT person_id, tax_year, " + ", ".join(map(_made_sql, _MADE)) + " FROM panel)")
def q_repair(spark, sf):
    made = Workspace.of(spark, sf).panel.select("person_id", "tax_year", *[
        F.expr(_MADE[c]).cast("double").alias(c) if c not in (
            "fraud_type", "fraud_category", "uses_itemized") else c for c in _MADE])
    parts = [merge.repair_generated(made, m).withColumn("model", F.lit(m)) for m in _MODELS]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2])
    floats = [c for c in _MADE if c not in ("age", "fraud_label", "fraud_type", "fraud_category",
                                            "uses_itemized", "effective_tax_rate")]
    return rnd(d, **dict.fromkeys(floats, 5), effective_tax_rate=6).select(
        "model", "person_id", "tax_year", *_MADE)


_TRAINING = [c for c in V.FEATURES if c in _HELD or c == "tax_year"] + [V.TARGET]


@add("p1_training_frame", "panel", f"SELECT {shown(_TRAINING)} FROM panel")
def q_training(spark, sf):
    return whole(merge.training_frame(Workspace.of(spark, sf).panel), _TRAINING)
