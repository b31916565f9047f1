"""Findings of round 3: narrow stages, exact key-set overlaps, trimming of drawn samples."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, connect
from cohortscope import vocab as V
from cohortscope.operators import evaluate, forensic, ordering, sampling, sketches
from cohortscope.plans.workspace import Workspace
from cohortscope.session import staging_root

NARROW = ["x12_network", "e1_flag_calibration", "p14_one_hot", "e2_score_separation",
          "e7_roc_auc_flags", "e7_roc_auc_master", "x14_master_score", "a5_employer_stats",
          "x4_tax_burden", "peer_unusualness", "w1_percent_ranks"]


def test_queries_stage_no_wide_table_but_the_panel(spark, sf):
    """Core, evidence and scores were written with all their columns."""
    root = staging_root(spark)
    Workspace.reset()
    old = set(os.listdir(root))
    for name in NARROW:
        entry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    new = [d for d in os.listdir(root) if d not in old]
    Workspace.reset()
    width = {d: len(spark.read.parquet(f"{root}/{d}").columns) for d in new
             if not d.startswith("panel-")}
    assert new and max(width.values()) < 45, width


@pytest.mark.parametrize("lg", [6, 10])
def test_overlaps_of_large_sets_are_exact(spark, lg):
    """F8: sets above the size of a sketch were estimated."""
    one = spark.range(5000).select(F.lit("a").alias("s"), F.col("id").alias("k"))
    two = spark.range(3000, 9000).select(F.lit("b").alias("s"), F.col("id").alias("k"))
    far = spark.range(20000, 20010).select(F.lit("c").alias("s"), F.col("id").alias("k"))
    none = spark.range(1).select(F.lit("a").alias("s"), F.lit(None).cast("long").alias("k"))
    d = one.unionByName(two).unionByName(far).unionByName(one).unionByName(none)
    got = {tuple(r) for r in sketches.exact_overlaps(d, "s", "k", lg).collect()}
    assert got == {("a", "b", 5000, 6000, 2000, 3000, 9000), ("a", "c", 5000, 10, 0, 5000, 5010),
                   ("b", "c", 6000, 10, 0, 6000, 6010)}


def test_overlaps_of_nothing(spark):
    d = spark.createDataFrame([], "s string, k long")
    assert sketches.exact_overlaps(d, "s", "k").collect() == []


def test_trimming_covers_the_drawn_sample(spark, sf):
    """the query had lost the trimming of the drawn sample."""
    sql = entry.oracle_sql()["w7_m7_trimmed_persons"]
    assert "FROM gone" in sql and "FROM trimmed" in sql
    df = entry.queries()["w7_m7_trimmed_persons"](spark, sf)
    assert df.columns == ["trimmed_from", "state", "person_id", "n_rows"]
    assert compare(df, connect(sf), sql) is None
    persons = spark.createDataFrame([("X", str(i), "clean", 7) for i in range(100)],
                                    "state string, person_id string, fraud_pattern string, n_rows long")
    assert sampling.trim_persons(persons, 500).count() == 22       # 700 rows to at most 550


def _scans(df):
    """How often an evaluation read its input: rows are counted as they pass."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(count, df.schema), seen


def test_scores_are_computed_once_for_a_roc_curve(spark):
    """the counts per score were computed anew for every prefix sum."""
    d, seen = _scans(spark.range(1000).select(
        (F.col("id") % 7).cast("double").alias("s"), (F.col("id") % 2).alias("fraud_label")))
    assert evaluate.roc_auc(d, "s").count() == 1
    assert seen.value == 1000


def test_two_valued_in_one_pass(spark):
    """Minimum and maximum first, the values between them in a second pass."""
    rows = [(2019, 0.0, 1.0, None, 5.0, float(i)) for i in range(40)]
    rows += [(2019, -0.0, 2.0, 3.0, 5.0, 1.0), (2020, 1.0, 1.0, None, 0.5, 1.0),
             (2020, 2.0, 3.0, 0.0, float("nan"), 1.0), (2020, 3.0, 1.0, 0.0, None, 1.0)]
    d, seen = _scans(spark.createDataFrame(
        rows, "tax_year int, a double, b double, c double, d double, e double"))
    got = {r["tax_year"]: tuple(r)[1:] for r in forensic.two_valued(d, list("abcde")).collect()}
    assert got == {2019: (True, True, True, True, False), 2020: (False, True, True, False, True)}
    assert seen.value == len(rows)


def test_ranks_move_groups_by_number(spark):
    """every row carried its group's names, once per column, through every exchange."""
    d = spark.createDataFrame([(i, ["x" * 50, None][i % 2], 2019, float(i // 4)) for i in range(16)],
                              "row_id long, name string, year int, v double")
    df = ordering.percent_ranks(d, ["year", "name"], ["v"], "row_id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [p for p in plan.splitlines() if "Aggregate" in p and "name" in p]
    assert {r.row_id: r.pct_v for r in df.collect()} == {
        i: (i // 4 * 2 + 1.5) / 8 * 100 for i in range(16)}
    assert [c for c in df.columns] == ["row_id", "year", "name", "v", "pct_v"]


def test_peer_statistics_read_the_rows_once(spark, sf):
    """Size and moments, spread and rates each computed phases 1 and 2 again."""
    Workspace.reset()
    ws = Workspace.of(spark, sf)
    ws.moments, ws.rates
    assert "training" in ws.__dict__
    assert {*V.PEER_FEATURES, *V.RATE_DIMS, "fraud_label"} == set(ws.training.columns)
    Workspace.reset()
