"""The driver contract: the flagship runs, every query has a callable, SQL twins agree."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

#: Suffix arrays, trees, language profiles and sampled segmentations have no SQL; each has tests of
#: its own against brute force, enumeration or held-out rows in tests/llm/.
WITHOUT_SQL = {"op1_fingerprints", "op2_repeats", "op3_pii", "op4_pieces", "op5_quality", "op7_language",
               "op8_jaccard_join", "op10_quality_rules", "op13_alignment", "pipeline"}
SAMPLE = ["x1_preprocess", "x6_income_sources", "a1_peer_stats", "w1_percent_ranks",
          "x14_master_score", "m6_m8_state_samples", "m12_fix_rate_constant_n",
          "w8_priority_dedup", "r5_f23_compute_return", "r7_inject_scenario",
          "d1_zone_year_rules", "e7_roc_auc_by_year", "s12_s13_partitioned_outputs",
          "s6_s11_json_parameters", "w9_r14_sequences"]


def test_entry_has_rows_and_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["person_id", "tax_year"] and "pct_irs_risk_score" in df.columns


def test_every_query_has_a_twin():
    queries, oracle = set(entry.queries()), set(entry.oracle_sql())
    assert oracle <= queries
    if entry.CORPUS:
        assert queries - oracle == WITHOUT_SQL
    else:
        assert queries == oracle


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    diff = compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
    assert diff is None, diff
