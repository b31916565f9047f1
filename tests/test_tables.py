"""Sampling, merge, null policy, links, sequences and pipeline properties."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators import (blocks, links, merge, ordering, preprocess, profile,
                                   quality, quantiles, sampling, scores, sequences, splits)
from cohortscope.plans import pipeline
from cohortscope.sources import sinks


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_hot_key_dedup_keeps_best_source(spark):
    many = [("p1", 2020, "ctab_w2", float(i)) for i in range(500)]
    df = spark.createDataFrame(many + [("p1", 2020, "real", 9.0), ("p1", 2020, "real", None),
                                       ("p2", 2020, "other", 1.0)],
                               "person_id string, tax_year int, data_source string, agi double")
    got = merge.keep_best(df, ["person_id", "tax_year"])
    assert rows(got, "person_id", "data_source", "agi") == [("p1", "real", None),
                                                            ("p2", "other", 1.0)]


def test_null_policy_edges(spark):
    df = spark.createDataFrame(
        [("retired", 5.0, 0, 3.0, 61, 9.0, None, "7"), ("pure_se", 5.0, None, 3.0, 62, 9.0, 0.0, "x"),
         ("pure_w2", 5.0, 1, 3.0, None, 9.0, 0.0, None)],
        "taxpayer_type string, gross_receipts double, has_rental int, rental_net double, "
        "age int, social_security_income double, w2_wages double, odd string")
    got = merge.null_policy(df).collect()
    assert [r["gross_receipts"] for r in got] == [None, 5.0, None]
    assert [r["rental_net"] for r in got] == [None, 3.0, 3.0]
    assert [r["has_rental"] for r in got] == [0, 0, 1]
    assert [r["social_security_income"] for r in got] == [None, 9.0, 9.0]
    assert [r["w2_wages"] for r in got] == [None, 0.0, None]
    assert [r["odd"] for r in got] == [7.0, None, None]


def test_align_adds_orders_and_types(spark):
    df = spark.createDataFrame([("1", "2.6", "abc")], "person_id string, zone string, agi string")
    got = merge.align(df, "real")
    assert got.columns == V.CANONICAL
    r = got.first()
    assert r["person_id"] == "R_1" and r["zone"] == 3 and r["agi"] is None
    assert r["tax_year"] in V.TRAIN_YEARS and r["data_source"] == "real"


def test_person_index_trajectories(spark):
    paths = {"up": [0, 0, 1], "down": [1, 0, 0], "both": [0, 1, 0], "clean": [0, 0, 0],
             "always": [1, 1, 1]}
    df = spark.createDataFrame(
        [(k, 2019 + i, x, "pure_se" if i else "pure_w2") for k, v in paths.items()
         for i, x in enumerate(v)] + [("both", 2019, 0, "pure_w2")],
        "person_id string, tax_year int, fraud_label int, taxpayer_type string")
    got = {r["person_id"]: r for r in profile.person_index(df).collect()}
    assert {k: r["fraud_detail"] for k, r in got.items()} == {
        "up": "escalator", "down": "reformed", "both": "sporadic", "clean": "clean",
        "always": "chronic"}
    assert got["both"]["n_years"] == 3 and got["both"]["n_rows"] == 4
    assert got["both"]["taxpayer_type"] == "pure_se"      # a tie goes to the smaller value


def test_samples_hold_whole_histories(ws):
    s = sampling.sample_states(ws.panel, 60)
    assert quality.partial_histories(ws.panel, s).isEmpty()
    assert s.count() == s.select("person_id", "tax_year").distinct().count()


def test_largest_remainder_sums_to_target(spark):
    cells = spark.createDataFrame([("c", t, n, 17) for t, n in [("a", 10), ("b", 13), ("d", 7)]],
                                  "cell string, kind string, n long, n_target long")
    got = sampling.largest_remainder(cells, ["cell"], "kind")
    assert got.agg(F.sum("n_take")).first()[0] == 17


def test_person_split_has_no_overlap(ws):
    s = splits.split_by_person(ws.panel)
    shared = splits.set_overlap({k: s.filter(F.col("split") == k)
                                 for k in ("train", "val", "test")})
    got = {(r[0], r[1]): r[2] for r in shared.collect()}
    assert got[("train", "val")] == 0 and got[("train", "test")] == 0


def test_split_bundle(ws):
    out = splits.build_splits(ws.panel)
    rate = out["train"].agg(F.avg("fraud_label")).first()[0]
    assert abs(rate - V.RATE_OVERALL) <= V.RATE_TOLERANCE + 0.001
    assert out["seed_compliant"].filter("fraud_label = 1").isEmpty()
    assert out["val"].select("tax_year").distinct().collect()[0][0] == 2024


def test_hot_person_with_many_links(spark):
    many = [("hot", f"b{i:05d}", 2019 + i % 7, 9999) for i in range(2000)] + [
        ("cold", "z", 2018, 2019), ("gone", "q", 2010, 2012), ("late", "y", 2026, 9999)]
    df = spark.createDataFrame(many, "person_id string, business_id string, link_start int, "
                                     "link_end int")
    got = links.first_links(df, "owned").filter("tax_year in (2019, 2025)")
    assert rows(got, "person_id", "tax_year", "owned") == [
        ("cold", 2019, "z"), ("hot", 2019, "b00000"), ("hot", 2025, "b00000")]


def test_sequences_pad_and_take_the_first_rows(spark):
    df = spark.createDataFrame(
        [("a", 2024, 3.0), ("a", 2020, 1.0), ("a", 2021, None), ("b", 2019, 1.0)]
        + [("c", 2020, 1.0)] * 300 + [("c", 2019, 2.0)], "person_id string, tax_year int, agi double")
    got = {r.person_id: r for r in sequences.build_sequences(df, ["agi"]).collect()}
    assert set(got) == {"a", "c"} and got["a"]["n_years"] == 3 and got["c"]["n_years"] == 301
    assert [x[0] for x in got["a"]["sequence"]] == [1.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0]
    assert [x[0] for x in got["c"]["sequence"]] == [2.0] + [1.0] * 6


def test_imputation_falls_back_to_year_then_constant(spark):
    df = spark.createDataFrame(
        [("a", 2020, "t1", "s", None, None, 1.0), ("b", 2020, "t2", "s", 10.0, 30, 2.0),
         ("c", 2021, None, None, 40.0, None, 3.0)],
        "person_id string, tax_year int, taxpayer_type string, state string, agi double, "
        "age int, irs_risk_score double")
    got = {r["person_id"]: r for r in preprocess.preprocess(df).collect()}
    assert got["a"]["agi"] == 10.0 and got["a"]["age"] == 30.0     # whole-year median
    assert got["c"]["age"] == 45.0 and got["c"]["taxpayer_type"] == "UNKNOWN"


def test_absent_columns_are_tolerated(spark):
    df = spark.createDataFrame([("a", 2020, 5.0)], "person_id string, tax_year int, agi double")
    got = blocks.financial_ratios(df).first()
    assert got["credit_to_income"] == 0.0 and got["gig_expense_ratio"] == 0.0


def test_scores_are_bounded_and_stages_idempotent(ws):
    s = ws.scored
    r = s.agg(*[f(c).alias(f"{n}_{c}") for c in ("master_fraud_propensity", "pct_irs_risk_score",
                                                 "forensic_risk_score", "flag_block_score")
                for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    assert 0 <= r["lo_master_fraud_propensity"] and r["hi_master_fraud_propensity"] <= 1
    assert 0 < r["lo_pct_irs_risk_score"] and r["hi_pct_irs_risk_score"] <= 100
    again = scores.impossibility_flags(s)
    assert sorted(again.columns) == sorted(s.columns)
    same = again.join(s.select("row_id", F.col("total_flag_count").alias("n")), "row_id")
    assert same.filter("total_flag_count <> n").isEmpty()
    twice = scores.network_features(s, ws.statistics["employers"])
    assert sorted(twice.columns) == sorted(s.columns)


def test_not_a_number_counts_as_unknown(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, nan), (4, None), (5, float("inf"))],
                               "row_id long, x double").withColumn("g", F.lit("a"))
    got = {r.row_id: r.pct_x for r in ordering.percent_ranks(df, ["g"], ["x"], "row_id").collect()}
    assert got == {1: pytest.approx(100 / 3), 2: pytest.approx(200 / 3), 3: 50.0, 4: 50.0, 5: 100.0}
    q = quantiles.exact_quantiles(df, ["g"], ["x"], {"p50": 0.5, "p100": 1.0}).first()
    assert (q.x_p50, q.x_p100) == (2.0, float("inf"))


def test_sequences_take_any_year_and_count_all_rows(spark):
    years = [2018, 2024, 2025, 2026, 2027]
    rows = [("a", y, float(y)) for y in years] + [("b", 2020, 1.0)] * 3 + [("c", 2020, 1.0)]
    rows += [("d", 2000 + i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "person_id string, tax_year int, agi double")
    got = {r.person_id: r for r in sequences.build_sequences(df, ["agi"]).collect()}
    assert set(got) == {"a", "b", "d"}
    assert [x[0] for x in got["a"].sequence] == [*map(float, years), 0.0, 0.0]
    assert got["b"].n_years == 3 and [x[0] for x in got["b"].sequence] == [1.0] * 3 + [0.0] * 4
    assert got["d"].n_years == 30 and [x[0] for x in got["d"].sequence] == [*map(float, range(7))]


def test_draws_reach_positions_beyond_32_bits(spark):
    size = 10 ** 12
    d = spark.range(4000).select(E.digest_position(E.draw_key("d", "id"), F.lit(size)).alias("p"))
    p = sorted(r.p for r in d.collect())
    assert 0 <= p[0] and p[-1] < size and p[-1] > 0.99 * size and len(set(p)) == 4000
    assert sum(x % 1000 != 0 for x in p) > 3900


def test_outputs_keep_rows_of_unknown_states(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020, "Texas", 0), (2, 2021, None, 1), (3, 2021, "Moon", 0)],
                               "person_id int, tax_year int, state string, fraud_label int")
    paths = sinks.write_outputs(df, str(tmp_path))
    for path in paths.values():
        assert spark.read.parquet(path).count() == 3
    assert {r.state_safe for r in spark.read.parquet(paths["by_state"]).collect()} == {
        "texas", "other"}


def test_pipeline_keeps_every_row(ws):
    fitted = pipeline.run(ws.panel)
    assert fitted.scored.count() == ws.panel.count()


def test_rule_report_counts(spark):
    df = spark.createDataFrame([(1, -1.0), (0, 5.0), (1, None)], "fraud_label int, agi double")
    rep = quality.run_rules(df, [
        quality.Rule("negative_agi", quality.violations(F.col("agi") < 0), quality.none),
        quality.Rule("rate", F.avg("fraud_label"), quality.within(0, 1))])
    got = {r["rule"]: (r["value"], r["passed"]) for r in rep.collect()}
    assert got == {"negative_agi": (1.0, 0), "rate": (2 / 3, 1)}
    assert quality.summary(rep).first()["errors"] == 1
    need = quality.required_columns(df, ["agi", "zone"]).toPandas()
    assert dict(zip(need["rule"], need["passed"])) == {"has_agi": 1, "has_zone": 0}


def test_most_common_ties_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    filled = merge.fill_for_model(df, [])
    assert sorted(filled.toPandas()["t"]) == ["a", "a", "b"]
    assert isinstance(filled.toPandas(), pd.DataFrame)
