"""Edge rows of the scalar functions: NULLs, ties, zeros, interval edges, powers of ten."""

import math

from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators import returns


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr.alias("y")).orderBy("i").select("y").collect()]


def test_clip_keeps_null(spark):
    assert column(spark, [None, -5.0, 3.0, 99.0], E.clip("x", 0, 10)) == [None, 0.0, 3.0, 10.0]


def test_flag_of_unknown_is_zero(spark):
    assert column(spark, [None, 1.0, 9.0], E.flag(F.col("x") > 5)) == [0, 0, 1]


def test_income_band_edges(spark):
    got = column(spark, [None, -1.0, 0.0, 24_999.99, 25_000.0, 1_000_000.0],
                 E.income_band(F.col("x")))
    assert got == ["UNKNOWN", "UNKNOWN", "under_25k", "under_25k", "25k_50k", "over_1M"]


def test_age_group_edges(spark):
    got = column(spark, [25.0, 25.5, 35.0, 50.0, 65.0, 66.0, None], E.age_group(F.col("x")))
    assert got == ["under_25", "25_35", "25_35", "35_50", "50_65", "over_65", "35_50"]


def test_first_digit(spark):
    got = column(spark, [1.0, 1000.0, 999.0, -7321.0, 0.5, None, 2.0, 3e9, 99999999.0],
                 E.first_digit("x"))
    assert got == [1, 1, 9, 7, None, None, 2, 3, 9]


def test_entropy(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (0.0, None, 0.0), (5.0, -3.0, 0.0)],
                               "a double, b double, c double")
    got = [r[0] for r in df.select(E.row_entropy(["a", "b", "c"])).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_round_number_ratio(spark):
    df = spark.createDataFrame([(100.0, 250.0, 2000.9), (0.0, None, 0.4)],
                               "a double, b double, c double")
    got = [r[0] for r in df.select(E.round_number_ratio(["a", "b", "c"])).collect()]
    assert abs(got[0] - 2 / 3) < 1e-6 and got[1] == 0.0


def test_benford_needs_three_values(spark):
    df = spark.createDataFrame([(1, 1, None, None), (1, 1, 1, None)],
                               "a int, b int, c int, d int")
    got = [r[0] for r in df.select(E.row_benford(["a", "b", "c", "d"])).collect()]
    want = (1 - V.BENFORD[0]) ** 2 / V.BENFORD[0] + sum(V.BENFORD[1:])
    assert got[0] == 0.0 and abs(got[1] - want) < 1e-6


def test_effective_rate(spark):
    got = column(spark, [None, -5.0, 10_000.0, 50_000.0], E.effective_rate(F.col("x")))
    want = (10_000 * .10 + 30_000 * .12 + 10_000 * .22) / 50_000
    assert got[:3] == [0.0, 0.0, 0.1] and abs(got[3] - want) < 1e-12


def test_bracket_tax_by_hand(spark):
    df = spark.createDataFrame([(50_000.0, 2023, "single"), (50_000.0, 2023, "married_joint"),
                                (0.0, 2023, "single"), (50_000.0, 1999, "single")],
                               "x double, y int, s string")
    got = [r[0] for r in df.select(
        returns.liability(F.col("x"), F.col("y"), F.col("s"))).collect()]
    single = 11_000 * .10 + (44_725 - 11_000) * .12 + (50_000 - 44_725) * .22
    joint = 22_000 * .10 + (50_000 - 22_000) * .12
    assert got == [round(single, 2), round(joint, 2), 0.0, round(single, 2)]


def test_standard_deduction(spark):
    df = spark.createDataFrame([(2019, "single"), (2024, "qualifying_widow"),
                                (2025, "head_of_household"), (2030, "single"), (2020, "other")],
                               "y int, s string")
    got = [r[0] for r in df.select(returns.standard_deduction(F.col("y"), F.col("s"))).collect()]
    assert got == [12_200, 29_200, 22_500, 12_950, 12_950]


def test_norm01_empty_range(spark):
    assert column(spark, [3.0], E.norm01(F.col("x"), 5, 5)) == [0.0]


def test_cents_half_away_from_zero(spark):
    got = column(spark, [1.005, 2.675, -1.005, 0.0, 12.344], E.cents("x"))
    assert got == [1.01, 2.68, -1.01, 0.0, 12.34]


def test_value_bucket_is_monotone(spark):
    values = sorted([0.0, -0.0, 1e-9, -1e-9, 1.0, 1.0000001, 1e6, -1e6, 5e8, -3.0, 0.2, 0.21])
    got = column(spark, values, E.value_bucket(F.col("x")))
    assert got == sorted(got)


def test_digest_uniform_in_unit_interval(spark):
    df = spark.range(2000)
    u = E.digest_uniform(E.draw_key("t", "id"))
    r = df.select(F.min(u), F.max(u), F.avg(u)).first()
    assert 0 <= r[0] and r[1] < 1 and math.isclose(r[2], 0.5, abs_tol=0.03)


def test_weighted_choice_covers_all_and_matches_weights(spark):
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    u = E.digest_uniform(E.draw_key("w", "id"))
    n = {r[0]: r[1] for r in spark.range(4000).groupBy(
        E.weighted_choice(u, w).alias("k")).count().collect()}
    assert set(n) == set(w) and all(abs(n[k] / 4000 - p) < 0.03 for k, p in w.items())
