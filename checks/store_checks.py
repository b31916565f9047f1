"""Queries and SQL twins: interval overlaps, stored statistics, sketches, stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.panel_sql import r, with_ctes
from checks.profile_checks import rnd
from checks.relation_checks import DIMS, SEQ
from checks.relation_checks import _FEATS as FEATURES
from checks.sampling_checks import ALIGNED, BEST, MERGED, _aligned as aligned, policed, shown, whole
from cohortscope import vocab as V
from cohortscope.operators import (intervals, links, merge, peer, preprocess, quality, sequences,
                                   sketches, splits)
from cohortscope.plans.workspace import Workspace
from cohortscope.session import stage, staging_root
from cohortscope.sources import fixtures, readers, stores
from cohortscope.streaming import prior

QUERIES, ORACLE = {}, {}
C = F.col


def add(name, upto, sql, extra=""):
    def wrap(fn):
        QUERIES[name] = fn
        ORACLE[name] = with_ctes(upto, sql, extra)
        return fn
    return wrap


def folder(spark, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


# -------------------------------------------------------------------- intervals
@add("j13_zone_overlaps", "panel", """
SELECT person_id, p.zone, entry_year, p.exit_year, count(business_id) AS n_overlaps,
  (min((open_year, business_id)) FILTER (business_id IS NOT NULL))[2] AS earliest_id,
  (max((b.exit_year, business_id)) FILTER (business_id IS NOT NULL))[2] AS latest_id
FROM persons p LEFT JOIN businesses b ON b.zone = p.zone AND open_year <= p.exit_year
  AND b.exit_year >= entry_year GROUP BY ALL""", DIMS)
def q_zone_overlaps(spark, sf):
    ws = Workspace.of(spark, sf)
    return intervals.count_overlaps(
        ws.persons.select("person_id", "zone", "entry_year", "exit_year"), ws.businesses, ["zone"],
        ("entry_year", "exit_year"), ("open_year", "exit_year"), "business_id")


@add("j13_link_overlaps", "panel", """
SELECT a.person_id, a.business_id, count(*) - 1 AS n_others,
  (min((b.link_start, b.person_id)))[2] AS earliest_id
FROM links a JOIN links b ON b.business_id = a.business_id AND b.link_start <= a.link_end
  AND b.link_end >= a.link_start GROUP BY ALL""", DIMS)
def q_link_overlaps(spark, sf):
    """Persons linked to the same business at the same time."""
    links = Workspace.of(spark, sf).links.select("person_id", "business_id", "link_start", "link_end")
    span = ("link_start", "link_end")
    return intervals.count_overlaps(links, links, ["business_id"], span, span, "person_id").select(
        "person_id", "business_id", (C("n_overlaps") - 1).alias("n_others"), "earliest_id")


# ------------------------------------------------------------ stored statistics
FEATS = ["agi", "w2_wages", "deduction_taken", "irs_risk_score"]
STORED = ["taxpayer_type", "state"]
PROBS = {"median": 0.5, "p95": 0.95}


@add("a1_s14_merged_statistics", "panel", " UNION ALL ".join(
    f"""SELECT taxpayer_type, state, '{f}' AS feature, count({f}) AS n, {r(f"avg({f})", "mean", 4)},
  {r(f"stddev_samp({f})", "std", 3)}, 1 AS median_close, 1 AS p95_close FROM panel
  GROUP BY ALL HAVING count({f}) > 0""" for f in FEATS)
    + f""" UNION ALL SELECT taxpayer_type, state, NULL, count(fraud_label), {r("avg(fraud_label)", "mean", 4)},
  {r("stddev_samp(fraud_label)", "std", 3)}, NULL, NULL FROM panel GROUP BY ALL""")
def q_merged_statistics(spark, sf):
    """Years are reduced and stored one by one, one of them twice; nothing but the partials
    is read to merge them.  Quantile ranks may be off by 2 % of a group's rows."""
    panel = Workspace.of(spark, sf).panel
    path = folder(spark, "peer-partials")
    for year in [*V.YEARS, V.YEARS[2]]:
        part = panel.filter(C("tax_year") == year)
        sketches.store_load(sketches.partial_statistics(part, STORED, FEATS), path, year)
    stats = sketches.merge_statistics(sketches.stored_loads(spark, path), STORED)
    off = sketches.rank_errors(stats, panel, STORED, FEATS, PROBS).select(
        *[C(k).alias(f"_{k}") for k in [*STORED, "feature"]],
        *[(C(n) <= 0.02).cast("int").alias(f"{n}_close") for n in PROBS])
    met = [C(k).eqNullSafe(C(f"_{k}")) for k in [*STORED, "feature"]]
    return rnd(stats.drop("sketch").join(off, met, "left"), mean=4, std=3).select(
        *STORED, "feature", "n", "mean", "std", *[f"{n}_close" for n in PROBS])


# ----------------------------------------------------------------------- key sets
_SETS = {"train": "tax_year <= 2023", "val": "tax_year = 2024", "test": "tax_year = 2025"}
_CASE = "CASE WHEN tax_year <= 2023 THEN 'train' WHEN tax_year = 2024 THEN 'val' WHEN tax_year = 2025 THEN 'test' END"


def _pairs_sql(name, key):
    return f"""SELECT a.name AS set_a, b.name AS set_b, a.n AS n_a, b.n AS n_b,
  (SELECT count(*) FROM (SELECT k FROM s WHERE s.name = a.name INTERSECT SELECT k FROM s WHERE s.name = b.name)) AS n_both,
  (SELECT count(*) FROM (SELECT k FROM s WHERE s.name = a.name EXCEPT SELECT k FROM s WHERE s.name = b.name)) AS n_only_a,
  (SELECT count(*) FROM (SELECT k FROM s WHERE s.name = a.name UNION SELECT k FROM s WHERE s.name = b.name)) AS n_union
  FROM n a JOIN n b ON a.name < b.name"""


def _sets_sql(name, key):
    return f"""s AS (SELECT DISTINCT {name} AS name, {key} AS k FROM panel),
n AS (SELECT name, count(*) AS n FROM s GROUP BY ALL)"""


@add("j15_u3_theta_overlaps", "panel", _pairs_sql("", ""), _sets_sql(_CASE, "person_id"))
def q_theta_splits(spark, sf):
    return sketches.exact_overlaps(
        Workspace.of(spark, sf).panel.withColumn("split", F.expr(_CASE)), "split", "person_id")


@add("a10_theta_employers", "panel", _pairs_sql("", ""),
     _sets_sql("state", "employer_id").replace("FROM panel", "FROM panel WHERE employer_id IS NOT NULL"))
def q_theta_states(spark, sf):
    """Employers that states share."""
    return sketches.exact_overlaps(
        Workspace.of(spark, sf).panel.filter("employer_id IS NOT NULL"), "state", "employer_id")


# ------------------------------------------------------------------------ stores
_NULLABLE = ["agi", "employer_id", "rental_net"]
_SEEN = (["count(*) AS rows", "count(*) FILTER (fraud_label = 1) AS positives"]
         + [f"count(*) FILTER (tax_year = {y}) AS rows_{y}" for y in V.YEARS]
         + ["count(*) FILTER (tax_year NOT BETWEEN 2019 AND 2025) AS rows_other"]
         + [f"count(*) FILTER ({c} IS NULL) AS nulls_{c}" for c in _NULLABLE]
         + ["count(*) FILTER (agi < 0) AS broken_negative_agi",
            "count(*) FILTER (effective_tax_rate > 1) AS broken_rate_above_1"])


def _long(load, source):
    return f"""SELECT '{load}' AS load, item, value FROM (UNPIVOT (SELECT {", ".join(_SEEN)} FROM {source})
  ON COLUMNS(*) INTO NAME item VALUE value)"""


@add("s12_s13_observed_writes", "panel", " UNION ALL ".join([
    _long("all", "panel"), _long("2021", "again"), """SELECT 'stored', CAST(tax_year AS VARCHAR), count(*)
  FROM (SELECT tax_year FROM panel WHERE tax_year <> 2021 UNION ALL SELECT tax_year FROM again) GROUP BY tax_year"""]),
     "again AS (SELECT * FROM panel WHERE tax_year = 2021 AND agi IS NOT NULL)")
def q_observed(spark, sf):
    """All years are written, then one is replaced: what both jobs saw, and what is stored."""
    panel, path = Workspace.of(spark, sf).panel, folder(spark, "by-year")
    rules = {"negative_agi": C("agi") < 0, "rate_above_1": C("effective_tax_rate") > 1}
    metrics = stores.summary_metrics(years=V.YEARS, nullable=_NULLABLE, rules=rules)
    rows = panel.repartition("tax_year", F.pmod(F.xxhash64("person_id"), F.lit(4)))
    one = stores.write_observed(rows, path, ["tax_year"], metrics)
    again = rows.filter("tax_year = 2021 AND agi IS NOT NULL")
    two = stores.write_observed(again, path, ["tax_year"], metrics)
    stored = spark.read.parquet(path).groupBy("tax_year").count().select(
        F.lit("stored").alias("load"), C("tax_year").cast("string").alias("item"),
        C("count").alias("value"))
    return stores.metric_rows(spark, "all", one).unionByName(
        stores.metric_rows(spark, "2021", two)).unionByName(stored)


def bucketed(spark, sf, buckets=8):
    """Two narrow tables of the panel, bucketed by person."""
    panel = Workspace.of(spark, sf).panel
    stores.co_bucketed(spark)
    parts = {"clean": ["agi", "gross_receipts"], "raw": ["fraud_label", "employer_id", "filing_status"]}
    out = {}
    for part, cols in parts.items():
        path = folder(spark, f"bucketed_{part}")
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        out[part] = stores.write_bucketed(panel.select("person_id", "tax_year", *cols), name, path,
                                          "person_id", buckets, ["tax_year"])
    return out


@add("j8_j11_bucketed_joins", "panel", f"""SELECT a.person_id, a.tax_year, {r("a.agi", "agi", 5)},
  a.fraud_label, a.employer_id, a.filing_status, {r("b.gross_receipts", "prior_receipts", 5)}
  FROM panel a LEFT JOIN panel b ON b.person_id = a.person_id AND b.tax_year = a.tax_year - 1""")
def q_bucketed(spark, sf):
    t = bucketed(spark, sf)
    d = preprocess.reattach_raw(t["clean"], t["raw"], ["person_id", "tax_year"])
    d = links.prior_year(d, "gross_receipts", "prior_receipts")
    return rnd(d, agi=5, prior_receipts=5).drop("gross_receipts")


@add("j6_s2_bloom_lookup", "panel", f"""SELECT person_id, tax_year, employer_id, {r("agi", "agi", 5)}
  FROM panel WHERE CAST(employer_id AS BIGINT) % 97 = 5""")
def q_lookup(spark, sf):
    panel, path = Workspace.of(spark, sf).panel, folder(spark, "by-id")
    stores.write_lookup(panel, path, ["person_id", "employer_id"], 100_000)
    # the ids asked for: a list that the caller holds
    ids = [x[0] for x in panel.filter("CAST(employer_id AS BIGINT) % 97 = 5").select(
        "employer_id").distinct().collect()]
    return rnd(stores.lookup(spark, path, "employer_id", ids).select(
        "person_id", "tax_year", "employer_id", "agi"), agi=5)


@add("w8_m16_incremental_merge", "panel", f"""SELECT {shown(MERGED)} FROM (SELECT * REPLACE (
  CASE WHEN fraud_label = 0 THEN 'none' ELSE fraud_type END AS fraud_type,
  CASE WHEN fraud_label = 0 THEN 'none' ELSE fraud_category END AS fraud_category)
  FROM (SELECT {policed(MERGED)} FROM best))""", BEST)
def q_incremental(spark, sf):
    """Sources arrive in three batches, the best last; the result is that of one merge."""
    parts, path = fixtures.sources(Workspace.of(spark, sf).panel), folder(spark, "merged")
    names = list(parts)
    for batch in (names[4:], names[1:4], names[:1]):
        merge.merge_batch(spark, path, {n: parts[n] for n in batch}, 8)
    return whole(merge.merged_rows(spark, path), MERGED)


_RANKED = ["agi", "deduction_taken"]


@add("w1_arriving_ranks", "panel", " UNION ALL ".join(f"""
SELECT person_id, tax_year, '{c}' AS feature, {r(f"CASE WHEN x IS NULL OR size = 0 THEN 50 WHEN same > 0 THEN (below + 1 + below + same) / 2.0::DOUBLE / size * 100 ELSE least((below + 0.5::DOUBLE) / size * 100, 100) END", "pct", 6)}
FROM (SELECT a.person_id, a.tax_year, any_value(a.{c}) AS x, count(b.{c}) AS size,
    count(*) FILTER (b.{c} < a.{c}) AS below, count(*) FILTER (b.{c} = a.{c}) AS same
  FROM arriving a LEFT JOIN panel b ON b.tax_year <= 2023 AND b.state = a.state
    AND b.taxpayer_type = a.taxpayer_type GROUP BY ALL)""" for c in _RANKED),
     """arriving AS (SELECT * FROM panel WHERE tax_year = 2025 UNION ALL
  SELECT * FROM panel WHERE tax_year = 2019 AND CAST(person_id AS BIGINT) % 10 = 0)""")
def q_arriving(spark, sf):
    """Ranks of a later year, and of some stored rows, among the training years."""
    panel, keys = Workspace.of(spark, sf).panel, ["state", "taxpayer_type"]
    points = stage(peer.rank_breakpoints(panel.filter("tax_year <= 2023"), keys, _RANKED), "points")
    new = panel.filter("tax_year = 2025 OR (tax_year = 2019 AND CAST(person_id AS BIGINT) % 10 = 0)")
    new = new.withColumn("id", F.concat_ws("-", "person_id", "tax_year"))
    d = peer.ranks_of_arriving(new, points, keys, _RANKED, "id")
    name = F.split("id", "-")
    d = d.select(F.get(name, F.lit(0)).alias("person_id"), F.get(name, F.lit(1)).cast("int").alias(
        "tax_year"), F.expr("stack(2, 'agi', pct_agi, 'deduction_taken', pct_deduction_taken) as (feature, pct)"))
    return rnd(d, pct=6)


_FIELDS = {"n": ("$.n", "bigint"), "mean": ("$.income.mean", "double"),
           "second_rate": ("$.income.by_year[1].rate", "double"), "years": ("$.years", "array<int>"),
           "note": ("$.note", "double"), "p99": ("$.income.p99", "double")}


@add("s6_variant_parameters", "panel", f"""SELECT state, n, mean, second_rate, years, problems FROM (
  SELECT state, count(*) AS n, {r("avg(agi)", "mean", 3)},
    {r("avg(fraud_label) FILTER (tax_year = 2020)", "second_rate", 6)}, list(DISTINCT tax_year ORDER BY tax_year) AS years,
    CASE WHEN state = 'Texas' THEN 'note:null,p99:missing' ELSE 'note:wrong type,p99:missing' END AS problems
  FROM panel GROUP BY state)""")
def q_variant(spark, sf):
    """Parameters at three depths, in a list of objects and in a list of numbers."""
    panel, path = Workspace.of(spark, sf).panel, folder(spark, "nested")
    rate = panel.groupBy("state", "tax_year").agg(F.avg("fraud_label").alias("rate")).groupBy(
        "state").agg(F.sort_array(F.collect_list(F.struct("tax_year", "rate"))).alias("by_year"))
    g = panel.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("agi").alias("mean")).join(
        rate, "state")
    value = F.to_json(F.struct(
        "n", F.struct("mean", "by_year").alias("income"), C("by_year.tax_year").alias("years"),
        F.when(C("state") != "Texas", F.lit("free text")).alias("note")), {"ignoreNullFields": "false"})
    doc = g.agg(F.concat(F.lit('{"_comment": "made from the panel", '), F.array_join(F.collect_list(
        F.concat(F.lit('"'), "state", F.lit('": '), value)), ", "), F.lit("}")).alias("value"))
    doc.coalesce(1).write.text(path)
    values = readers.read_variant(spark, path, "state")
    problems = readers.variant_problems(values, _FIELDS).groupBy("state").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("field", F.lit(":"), "problem"))), ",")
        .alias("problems"))
    return rnd(readers.variant_fields(values, _FIELDS).drop("note", "p99").join(
        problems, "state"), mean=3, second_rate=6)


# ------------------------------------------------------- years outside a range
_EARLIER = {"train": [2020, 2021, 2022], "val": 2023, "test": 2024}


@add("m13_rows_outside_splits", "panel", """
SELECT use_case, count(*) AS n_rows, count(*) FILTER (split IS NULL) AS n_outside,
  min(tax_year) FILTER (split IS NULL) AS first_year, max(tax_year) FILTER (split IS NULL) AS last_year
FROM (SELECT 'by_year' AS use_case, tax_year, y AS split FROM ranged
  UNION ALL SELECT 'by_person', tax_year, CASE WHEN person_id IN (
    SELECT person_id FROM panel WHERE tax_year BETWEEN 2020 AND 2022) THEN 'train' ELSE y END FROM ranged)
GROUP BY use_case""", """ranged AS (SELECT *, CASE WHEN tax_year BETWEEN 2020 AND 2022 THEN 'train'
  WHEN tax_year = 2023 THEN 'val' WHEN tax_year = 2024 THEN 'test' END AS y FROM panel)""")
def q_outside(spark, sf):
    """Splits over an earlier range of years, and what falls in none of them."""
    panel = Workspace.of(spark, sf).panel.select("person_id", "tax_year")
    return splits.outside_splits({"by_year": splits.split_by_year(panel, **_EARLIER),
                                  "by_person": splits.split_by_person(panel, **_EARLIER)})


@add("j12_links_in_years", "panel", """
SELECT item, NULL AS tax_year, n FROM (UNPIVOT (SELECT count(*) AS n_intervals,
    count(*) FILTER (link_start <= 2023 AND link_end >= 2021 AND (link_start < 2021 OR link_end BETWEEN 2024 AND 9998)) AS n_cut,
    count(*) FILTER (link_start > 2023 OR link_end < 2021) AS n_outside FROM links)
  ON COLUMNS(*) INTO NAME item VALUE n)
UNION ALL SELECT 'n_active', y, count(*) FROM links, (SELECT CAST(2021 + i AS INTEGER) AS y FROM range(3) t(i))
  WHERE link_start <= y AND link_end >= y GROUP BY y""", DIMS)
def q_links_in_years(spark, sf):
    """Active links of an inner range of years, and what the range cuts or leaves out."""
    ws, years = Workspace.of(spark, sf), (2021, 2023)
    n = links.outside_years(ws.links, "link_start", "link_end", years).select(F.expr(
        "stack(3, 'n_intervals', n_intervals, 'n_cut', n_cut, 'n_outside', n_outside) as (item, n)"))
    d = links.active_years(ws.links, "link_start", "link_end", years=years)
    active = d.groupBy("tax_year").agg(F.count(F.lit(1)).alias("n")).withColumn("item", F.lit("n_active"))
    return active.unionByName(n.withColumn("tax_year", F.lit(None).cast("int")))


_NEEDED = [*V.FEATURES, V.TARGET]
_TABLES = {"orders": True, "lineitem": True, "returns": True, "audits": False}


@add("d9_required_columns", "panel", "SELECT * FROM (VALUES " + ", ".join(
    f"('has_{c}', {float(c in V.CANONICAL)}::DOUBLE, 'error', {int(c in V.CANONICAL)})" for c in _NEEDED)
    + ", ('missing_returns', NULL, 'MISSING_REQUIRED', 0), ('missing_audits', NULL, 'MISSING_OPTIONAL', 0)"
    + ") t(rule, value, severity, passed) UNION ALL SELECT 'rows', count(*), 'all', 1 FROM aligned", ALIGNED)
def q_required(spark, sf):
    """The features and the target in the aligned table, and tables that a run expects."""
    merged = aligned(spark, sf)
    gone = quality.missing_tables(_TABLES, {"orders", "lineitem"}, merged).select(
        F.concat(F.lit("missing_"), "table").alias("rule"), F.lit(None).cast("double").alias("value"),
        C("status").alias("severity"), F.lit(0).alias("passed"))
    rows = merged.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("rows").alias("rule"), "value", F.lit("all").alias("severity"), F.lit(1).alias("passed"))
    return quality.required_columns(merged, _NEEDED).unionByName(gone).unionByName(rows)


@add("f24_denormalised_sequences", "panel", f"""SELECT person_id, CAST(tax_year AS INTEGER) AS tax_year,
  {", ".join(r(f, f, 4) for f in FEATURES)} FROM steps""", SEQ)
def q_denormalised(spark, sf):
    """Scaled sequences, as a model returns them, back in their own units."""
    seqs = sequences.build_sequences(Workspace.of(spark, sf).panel, FEATURES).select(
        "person_id", "sequence")
    ranges = sequences.fit_range(seqs, len(FEATURES))
    d = sequences.denormalise(sequences.normalise(seqs, ranges), ranges)
    return rnd(sequences.flatten_sequences(d, FEATURES), **dict.fromkeys(FEATURES, 4))


# ------------------------------------------------------------------ year files
@add("j11_prior_year_stream", "panel", f"""SELECT a.person_id, a.tax_year, {r("b.gross_receipts", "prior_receipts", 7)}
  FROM panel a LEFT JOIN panel b ON b.person_id = a.person_id AND b.tax_year = a.tax_year - 1""")
def q_prior_stream(spark, sf):
    """Year files replayed as a stream, with a restart from the checkpoint half-way."""
    rows = Workspace.of(spark, sf).panel.select("person_id", "tax_year", "gross_receipts")
    source, out, state = (folder(spark, f"years-{x}") for x in ("in", "out", "state"))

    def arrive(years, closing=None):
        for y in years:
            rows.filter(C("tax_year") == y).coalesce(1).write.mode("append").parquet(source)
        if closing:
            closing.coalesce(1).write.mode("append").parquet(source)
        one, two = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
                    .parquet(source) for _ in range(2))
        query = (prior.prior_year_arrivals(one, two, "gross_receipts", "prior_receipts")
                 .writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()

    arrive(V.YEARS[:3])
    arrive(V.YEARS[3:], prior.closing_row(rows, V.YEARS[-1] + 10))
    got = spark.read.parquet(out)
    return rnd(got, prior_receipts=7).select("person_id", "tax_year", "prior_receipts")
