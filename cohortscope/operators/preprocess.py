"""Phase 1: imputation, raw signals, clipping and structural repair of a panel.

``fit_imputation`` finds the medians (distributed, exact); ``preprocess`` is then a
narrow projection plus one small join, so it streams over any number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.quantiles import long_quantiles
from cohortscope.session import stage

ANY = "*"   # the whole-year group next to the per-type groups


def present(df: DataFrame, cols) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def fill_basics(df: DataFrame) -> DataFrame:
    """NaN as NULL, unknown categories, zero-filled amounts, AGI rebuilt from its sources."""
    df = E.nan_as_null(df)
    fills = {c: F.coalesce(F.col(c), F.lit(V.UNKNOWN)) for c in ("taxpayer_type", "state")}
    fills.update({c: E.nz(c) for c in present(df, V.ZERO_FILLED + V.INCOME_SOURCES)})
    df = df.withColumns(fills)
    if "agi" in df.columns:
        rebuilt = E.total(present(df, V.INCOME_SOURCES))
        df = df.withColumns({"__agi_raw": F.col("agi"), "agi": F.coalesce(
            F.col("agi"), F.when(rebuilt != 0, rebuilt))})
    return df


def _imputed(df: DataFrame) -> list[str]:
    return present(df, ["agi", "age"] + V.SIGNALS)


def fit_imputation(panel: DataFrame) -> DataFrame:
    """Medians per (tax_year, taxpayer_type) and per tax_year (type ``*``), one row each.

    The whole-year AGI median uses AGI as reported; the per-type one also counts AGI
    rebuilt from income sources.
    """
    df = fill_basics(panel)
    cols = _imputed(df)
    cells = []
    for i, c in enumerate(cols):
        whole = "__agi_raw" if c == "agi" else c
        cells += [f"taxpayer_type, {i}, cast(`{c}` as double)",
                  f"'{ANY}', {i}, cast(`{whole}` as double)"]
    rows = (df.select("tax_year", F.expr(f"stack({len(cells)}, {', '.join(cells)}) as (grp, f, v)"))
            .filter("v is not null and not isnan(v)"))
    long = long_quantiles(rows, ["tax_year", "grp", "f"], [0.5])
    wide = long.groupBy("tax_year", "grp").agg(
        *[F.max(F.when(F.col("f") == i, F.col("value"))).alias(f"med_{c}")
          for i, c in enumerate(cols)])
    return stage(wide, "imputation")


def _attach_medians(df: DataFrame, medians: DataFrame, cols: list[str]) -> DataFrame:
    per_type = medians.filter(F.col("grp") != ANY).withColumnRenamed("grp", "taxpayer_type")
    per_year = medians.filter(F.col("grp") == ANY).drop("grp").withColumnsRenamed(
        {f"med_{c}": f"all_{c}" for c in cols})
    return (df.join(per_type, ["tax_year", "taxpayer_type"], "left")
            .join(per_year, "tax_year", "left"))


def raw_signals(df: DataFrame) -> DataFrame:
    """Signal features on unclipped values: logs of heavy tails and threshold flags."""
    out = {}
    have = set(df.columns)
    if "bank_deposit_ratio" in have:
        bdr = E.nz("bank_deposit_ratio")
        lg = E.log1p0("bank_deposit_ratio")
        out["bank_deposit_ratio_log"] = lg
        out["bank_deposit_ratio_sq_log"] = lg * lg
        out["flag_bank_deposit_extreme"] = E.flag(bdr > 100)
        out["flag_bank_deposit_high"] = E.flag(bdr > 10)
    if "irs_risk_score" in have:
        irs = E.nz("irs_risk_score")
        out["flag_irs_high"] = E.flag(irs > 67)
        out["flag_irs_very_high"] = E.flag(irs > 97.5)
        out["flag_irs_moderate"] = E.flag(irs.between(51, 67))
        out["irs_risk_score_sq"] = irs * irs / 10000
    if "federal_withheld" in have:
        fw = E.nz("federal_withheld")
        out["federal_withheld_log"] = E.log1p0("federal_withheld")
        if "agi" in have:
            agi = E.nz("agi")
            out["withholding_rate"] = E.clip(E.safe_ratio(fw, agi), -0.5, 1)
            out["flag_low_withholding"] = E.flag((fw < 500) & (agi > 20000))
        else:
            out["withholding_rate"] = F.lit(0.0)
            out["flag_low_withholding"] = F.lit(0)
    if "zone" in have:
        out["zone_risk"] = 6.0 - E.clip(F.coalesce(F.col("zone"), F.lit(3)).cast("double"), 1, 5)
    return df.withColumns(out)


def preprocess(panel: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Clean panel: imputed, with raw signals taken before clipping, then clipped."""
    if medians is None:
        medians = fit_imputation(panel)
    df = fill_basics(panel)
    fitted = _imputed(df)
    df = _attach_medians(df, medians, fitted)

    def imputed(c, last=None):
        steps = [F.col(c), F.col(f"med_{c}"), F.col(f"all_{c}")]
        return F.coalesce(*steps, *([F.lit(last)] if last is not None else []))

    have_agi = "agi" in df.columns
    if have_agi:
        df = df.withColumn("agi", imputed("agi"))
    df = raw_signals(df)
    sources = present(df, V.INCOME_SOURCES)
    df = df.withColumn("gross_reconstructed_income_sum", E.total(sources))
    if have_agi:
        gap = E.clip(F.col("gross_reconstructed_income_sum") - F.col("agi"), -1e6, 1e6)
        df = df.withColumn("gross_income_mismatch", gap)
        df = df.withColumn("gross_income_mismatch_ratio", E.clip(
            E.safe_ratio(F.abs("gross_income_mismatch"), F.col("agi")), 0, 5))
    step = {}
    if "deduction_income_ratio" not in df.columns:
        step["deduction_income_ratio"] = (
            E.clip(E.safe_ratio(E.nz("deduction_taken"), F.col("agi")), 0, 5)
            if "deduction_taken" in df.columns and have_agi else F.lit(0.0))
    if {"effective_tax_rate", "total_tax_liability"} <= set(df.columns) and have_agi:
        step["effective_tax_rate"] = F.coalesce(F.col("effective_tax_rate"), E.clip(
            E.safe_ratio(E.nz("total_tax_liability"), F.col("agi")), 0, 0.65))
    if "age" in df.columns:
        step["age"] = imputed("age", 45.0)
    step.update({c: imputed(c) for c in present(df, V.SIGNALS) if c in fitted})
    df = df.withColumns(step)
    df = df.withColumns({c: E.clip(F.col(c).cast("double"), lo, hi)
                         for c, (lo, hi) in V.CLIP_BOUNDS.items() if c in df.columns})
    last = {}
    if have_agi:
        last.update({c: F.least(E.nz(c), F.col("agi"))
                     for c in present(df, ["taxable_income", "total_tax_liability"])})
        last["expected_tax_rate"] = E.effective_rate(F.col("agi"))
    df = df.withColumns(last)
    extra = [f"{p}_{c}" for p in ("med", "all") for c in fitted] + ["__agi_raw"]
    return df.drop(*extra)


def reattach_raw(clean: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Raw columns the clean panel lacks, joined by key (rows have no position)."""
    new = [c for c in raw.columns if c not in set(clean.columns)]
    return clean.join(raw.select(*keys, *new), keys, "left") if new else clean


def null_totals(df: DataFrame) -> DataFrame:
    """Total count of NULL cells and of rows, in one pass."""
    cells = sum((E.flag(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.sum(cells).alias("null_cells"), F.count(F.lit(1)).alias("n_rows"))


def downcast(df: DataFrame) -> DataFrame:
    """Storage types for a sink: double to float, long to int where safe is declared."""
    return df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])
