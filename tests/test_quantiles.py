"""Distributed exact quantiles against numpy, on both the direct and the refined route."""

import numpy as np
import pandas as pd
import pytest

from cohortscope.operators import quantiles as Q

PROBS = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p95": 0.95, "p100": 1.0}


def data():
    rng = np.random.default_rng(5)
    parts = [
        ("hot", rng.lognormal(3, 2, 3000)), ("hot", np.zeros(1500)),      # a value holds a third
        ("narrow", 1.0 + rng.random(800) * 1e-7), ("negative", -rng.lognormal(1, 1, 301)),
        ("one", np.array([7.5])), ("two", np.array([1.0, 2.0])), ("same", np.full(50, 3.3)),
        (None, rng.normal(0, 1, 101)), ("none", np.array([np.nan, np.nan])),
    ]
    return pd.DataFrame([(k, None if np.isnan(v) else float(v), float(i))
                         for k, vs in parts for i, v in enumerate(vs)], columns=["k", "x", "y"])


@pytest.mark.parametrize("limit", [Q.REFINE_ABOVE, 20])
def test_matches_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "REFINE_ABOVE", limit)
    monkeypatch.setattr(Q, "SPLITS", 16 if limit == 20 else Q.SPLITS)
    pdf = data()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(),
                               "k string, x double, y double")
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], ["x", "y"], PROBS).collect()}
    for k, g in pdf.groupby("k", dropna=False):
        k = None if pd.isna(k) else k
        for c in ("x", "y"):
            v = g[c].dropna().to_numpy()
            for name, p in PROBS.items():
                have = got[k][f"{c}_{name}"]
                if len(v) == 0:
                    assert have is None
                else:
                    assert have == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)
    assert set(got) == {"hot", "narrow", "negative", "one", "two", "same", None, "none"}
