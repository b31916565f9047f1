"""Phase 5: forensic accounting features and the two weighted forensic scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.preprocess import present
from cohortscope.operators.quantiles import exact_quantiles

C = F.col


def benford_by_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Benford deviation of all values of a group (digit counts combine map-side)."""
    d = df.select(*keys, E.first_digit(value).alias("d"))
    counts = d.groupBy(*keys).agg(
        *[F.sum(E.flag(C("d") == k)).alias(f"d{k}") for k in range(1, 10)],
        F.count("d").alias("n_valid"))
    score = E.benford_score([C(f"d{k}") for k in range(1, 10)], C("n_valid"))
    return counts.select(*keys, "n_valid", score.alias("benford_deviation"))


def forensic_features(df: DataFrame) -> DataFrame:
    """Row features that need no table-wide knowledge."""
    sch = present(df, V.SCHEDULE_C)
    agi = C("agi")
    spend, bdr = E.nz("absolute_lifestyle_spend"), E.nz("bank_deposit_ratio")
    digits = {f"__d{i}": E.first_digit(c) for i, c in enumerate(sch)}
    df = df.withColumns(digits)
    df = df.withColumns({
        "benford_deviation_expenses": (E.row_benford(list(digits)) if len(sch) >= 3
                                       else F.lit(0.0)),
        "round_number_ratio": E.round_number_ratio(sch) if len(sch) >= 2 else F.lit(0.0),
        "net_worth_growth_proxy": E.clip(agi - E.nz("total_tax_liability") - spend, -2e6, 2e6),
        "cash_t_method_gap": E.clip(E.nz("bank_deposit_ratio", 1.0) * agi - agi, -1e6, 25e6),
        "lifestyle_asset_score": E.clip(
            0.40 * E.clip(E.nz("lifestyle_income_ratio"), 0, 5) + 0.35 * E.clip(bdr, 0, 5)
            + 0.25 * E.clip(E.nz("utility_income_ratio"), 0, 2) * 2, 0, 5),
        "unexplained_wealth_index": E.clip(
            F.greatest(F.lit(0.0), spend + bdr * agi - agi), 0, 25e6),
    })
    return df.withColumns({
        "cash_t_method_gap_ratio": E.clip(E.safe_ratio(C("cash_t_method_gap"), agi), -5, 300),
        "unexplained_wealth_ratio": E.clip(
            E.safe_ratio(C("unexplained_wealth_index"), agi), 0, 300),
    }).drop(*digits)


PROBED = sorted(set(V.DIF_WEIGHTS) | set(V.FORENSIC_WEIGHTS) | {"total_flag_count"})
FEW = 4                     # 2^4 distinct values held exactly, the least a sketch takes


def two_valued(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per year and column: does the column hold at most two distinct values?

    One pass: a theta sketch holds up to 2^FEW values exactly and counts more than two of
    any larger number, so that the rows, which may be a long plan, are computed once.
    """
    cols = present(df, cols or PROBED)
    return df.groupBy("tax_year").agg(*[
        (F.theta_sketch_estimate(F.theta_sketch_agg(E.nz(c).cast("double"), F.lit(FEW))) <= 2)
        .alias(f"two_{c}") for c in cols])


def fit_norm_bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """First and 99th percentile of the columns that have no fixed bounds: one row."""
    cols = [c for c in present(df, cols) if c not in V.NORM_BOUNDS]
    if not cols:
        return {}
    q = exact_quantiles(df, [], cols, {"lo": 0.01, "hi": 0.99}).first()
    return {c: (q[f"{c}_lo"] or 0.0, q[f"{c}_hi"] or 0.0) for c in cols}


def stable_norm(c: str, bounds: dict[str, tuple[float, float]] | None = None) -> Column:
    """Map to [0, 1] by fixed or fitted bounds; flags and two-valued columns pass through."""
    x = E.nz(c)
    if c.startswith(("flag_", "has_")):
        return x
    lo, hi = V.NORM_BOUNDS[c] if c in V.NORM_BOUNDS else bounds[c]
    return F.when(C(f"two_{c}"), x).otherwise(E.norm01(x, lo, hi))


def forensic_scores(df: DataFrame) -> DataFrame:
    """Weighted scores; expects the ``two_*`` columns of :func:`two_valued`."""
    out = {}
    for name, weights in (("dif_proxy_score", V.DIF_WEIGHTS),
                          ("forensic_risk_score", V.FORENSIC_WEIGHTS)):
        parts = {c: w for c, w in weights.items() if c in df.columns}
        score = sum((stable_norm(c) * w for c, w in parts.items()), F.lit(0.0))
        out[name] = (E.clip(score / max(sum(parts.values()), V.EPS), 0, 1) if parts
                     else F.lit(0.0))
    return df.withColumns(out)
