"""Ranks, prefix sums and hash picks: hot-group routes equal the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortscope.operators import evaluate, ordering, splits


def skewed(spark, n=3000):
    """One group holds two thirds of the rows, one value a third of them."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "row_id": range(n), "g": np.where(rng.random(n) < 0.66, "hot", rng.choice(list("abc"), n)),
        "x": np.where(rng.random(n) < 0.33, 0.0, rng.normal(0, 5, n).round(2)),
        "y": rng.lognormal(0, 3, n), "label": (rng.random(n) < 0.2).astype(int)})
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return pdf, spark.createDataFrame(rows, "row_id long, g string, x double, y double, label int")


def test_percent_ranks_equal_pandas(spark):
    pdf, df = skewed(spark)
    got = (ordering.percent_ranks(df, ["g"], ["x", "y"], "row_id")
           .toPandas().sort_values("row_id").reset_index(drop=True))
    want = (pdf.groupby("g")[["x", "y"]].rank(pct=True) * 100).fillna(50.0)
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["pct_x"], want["x"], rtol=1e-12)
    np.testing.assert_allclose(got["pct_y"], want["y"], rtol=1e-12)


def test_prefix_sums(spark):
    pdf, df = skewed(spark)
    vc = df.filter("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    got = ordering.prefix_sums(vc, ["g"], "x", ["n"]).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("x")
        np.testing.assert_array_equal(part["n_before"], part["n"].cumsum() - part["n"])


def test_auc_brute_force(spark):
    pdf, df = skewed(spark)
    d = pdf.dropna(subset=["x"])
    pos, neg = d[d.label == 1].x.to_numpy(), d[d.label == 0].x.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    got = evaluate.roc_auc(df.withColumnRenamed("label", "fraud_label"), "x").first()["auc"]
    assert got == pytest.approx(want, rel=1e-12)


def test_pick_by_hash_draws_exactly_the_budget(spark):
    _, df = skewed(spark)
    budgets = spark.createDataFrame([("hot", 777), ("a", 0), ("b", 10), ("c", 10 ** 6)],
                                    "g string, n_take long")
    n = df.groupBy("g").count().toPandas().set_index("g")["count"]
    got = ordering.pick_by_hash(df, ["g"], ["row_id"], 3, budgets)
    by = got.groupBy("g").agg(F.count(F.lit(1)).alias("n"),
                              F.countDistinct("row_id").alias("d")).toPandas().set_index("g")
    assert by["n"].to_dict() == by["d"].to_dict() == {"hot": 777, "b": 10, "c": n["c"]}


def test_weighted_pick_is_a_prefix_cut(spark):
    _, df = skewed(spark, 400)
    df = df.withColumn("w", (F.col("row_id") % 7 + 1).cast("long"))
    budget = spark.createDataFrame([(300,)], "n_take long")
    got = {r[0] for r in ordering.pick_by_hash(df, [], ["row_id"], "w", budget,
                                               weight=F.col("w")).select("row_id").collect()}
    h = df.select("row_id", "w", F.md5(F.concat_ws("|", F.lit("w"), F.col("row_id").cast(
        "string"))).alias("h")).toPandas().sort_values(["h", "row_id"])
    before = h["w"].cumsum() - h["w"]
    assert got == set(h[before < 300]["row_id"])


def test_positions_are_a_permutation(spark):
    df = spark.range(1234).withColumnRenamed("id", "row_id")
    got = ordering.number_by_hash(df, [], ["row_id"], "p").toPandas()
    assert sorted(got["position"]) == list(range(1234))


def test_draw_with_replacement_from_one_row(spark):
    df = spark.createDataFrame([(1,)], "row_id long")
    got = ordering.draw_with_replacement(df, ["row_id"], "r", 50, 1)
    assert got.count() == 50 and got.select("draw").distinct().count() == 50


@pytest.mark.parametrize("target", [0.05, 0.2, 0.6])
def test_rate_enforcement(spark, target):
    _, df = skewed(spark)
    df = df.withColumnRenamed("label", "fraud_label")
    ids = ["row_id"]
    fixed = splits.fix_rate(df, target, 0.01, "t", ids)
    assert fixed.count() == df.count()
    assert abs(fixed.agg(F.avg("fraud_label")).first()[0] - target) < 0.011
    raised = splits.raise_rate(df, target, 0.01, "t", ids)
    assert abs(raised.agg(F.avg("fraud_label")).first()[0] - target) < 0.011
    assert df.join(raised.select("row_id").distinct(), "row_id", "left_anti").isEmpty()


def test_proportional_sample_sums_to_n(spark):
    _, df = skewed(spark)
    for n in (1, 10, 997, 10 ** 6):
        got = splits.proportional_sample(df, n, "g", "s", ["row_id"]).count()
        assert got == min(n, df.count())
