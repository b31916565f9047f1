"""Registered queries read and return the whole of what their operator covers."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.sampling_checks import _aligned
from cohortscope import vocab as V

WHOLE = ["a28_link_coverage", "d3_merge_report", "m16_merged_rows", "p1_training_frame",
         "p12_null_policy", "p16_repair_generated"]


@pytest.mark.parametrize("name", WHOLE)
def test_query_equals_sql(spark, sf, name):
    diff = compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
    assert diff is None, diff


def test_link_coverage_counts_links_of_every_year(spark, sf):
    assert "link_start <=" not in entry.oracle_sql()["a28_link_coverage"].split("FROM persons p")[1]


def test_merge_report_covers_every_column(spark, sf):
    d = _aligned(spark, sf)
    n = d.agg(F.count(F.lit(1)), *[F.count(c) for c in d.columns]).first()
    share = {c: 100 * (n[0] - x) / n[0] for c, x in zip(d.columns, n[1:])}
    want = {c: round(v, 6) for c, v in share.items() if v > 80}
    report = entry.queries()["d3_merge_report"](spark, sf).collect()
    assert {r["key"]: r["value"] for r in report if r["dim"] == "column"} == want


def test_merged_rows_carry_every_canonical_column(spark, sf):
    d = entry.queries()["m16_merged_rows"](spark, sf)
    assert set(d.columns) == set(V.CANONICAL)
