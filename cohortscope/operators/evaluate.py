"""How well flags and scores separate the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.ordering import prefix_sums
from cohortscope.operators.quantiles import exact_quantiles
from cohortscope.session import stage

C = F.col


def _rows(one_row: DataFrame, names: list[str], fields: list[str], first: str) -> DataFrame:
    cells = ", ".join(f"'{n}', " + ", ".join(f"`{f}_{i}`" for f in fields)
                      for i, n in enumerate(names))
    return one_row.select("base", F.expr(
        f"stack({len(names)}, {cells}) as ({first}, {', '.join(fields)})"))


def flag_calibration(df: DataFrame, flags: list[str]) -> DataFrame:
    """Fire rate of each flag overall and by class, its lift and a verdict; one pass."""
    pos, neg = C("fraud_label") == 1, C("fraud_label") == 0
    aggs = [F.avg("fraud_label").alias("base")]
    for i, f in enumerate(flags):
        x = C(f).cast("double")
        aggs += [F.avg(x).alias(f"all_rate_{i}"), F.avg(F.when(pos, x)).alias(f"fraud_rate_{i}"),
                 F.avg(F.when(neg, x)).alias(f"clean_rate_{i}")]
    out = _rows(df.agg(*aggs), flags, ["all_rate", "fraud_rate", "clean_rate"], "flag")
    out = out.withColumn("lift", C("fraud_rate") / (C("all_rate") + F.lit(V.EPS)))
    status = (F.when(C("all_rate") > 0.60, "NOISE")
              .when(C("fraud_rate") < C("clean_rate"), "BACKWARD")
              .when(C("lift") > 1.3, "GOOD").when(C("lift") > 1.1, "OK").otherwise("WEAK"))
    return out.withColumns({
        "status": status,
        "owner": F.when(C("flag").isin(V.SIGNAL_FLAGS), "Phase1").otherwise("Phase7"),
    }).drop("base")


def score_separation(df: DataFrame, score: str) -> DataFrame:
    """Class means, their ratio, and how often positives exceed the clean p50/p75."""
    x = C(score)
    q = exact_quantiles(df.filter(C("fraud_label") == 0).withColumn("__all", F.lit(1)),
                        ["__all"], [score], {"p50": 0.5, "p75": 0.75}).first()
    p50, p75 = F.lit(q[f"{score}_p50"]), F.lit(q[f"{score}_p75"])
    pos = C("fraud_label") == 1
    out = df.agg(F.avg(F.when(pos, x)).alias("fraud_mean"),
                 F.avg(F.when(C("fraud_label") == 0, x)).alias("clean_mean"),
                 F.avg(F.when(pos, E.flag(x > p50))).alias("fraud_above_p50"),
                 F.avg(F.when(pos, E.flag(x > p75))).alias("fraud_above_p75"))
    return out.withColumns({
        "clean_p50": p50, "clean_p75": p75,
        "ratio": C("fraud_mean") / F.greatest(C("clean_mean"), F.lit(V.EPS))})


def ks_statistic(df: DataFrame, score: str, points: int = 500) -> DataFrame:
    """Largest gap between the class distributions on an even grid from min to max.

    Each score falls on the first grid point at or above it, so only the counts of at
    most ``points`` grid cells are accumulated; no score meets every threshold.
    """
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = F.lit(ends["lo"]), F.lit(ends["hi"])
    cell = F.when(hi > lo, F.ceil((C(score) - lo) / (hi - lo) * (points - 1))).otherwise(0)
    n = (df.filter(C(score).isNotNull()).groupBy(cell.cast("int").alias("cell"))
         .agg(F.sum(E.flag(C("fraud_label") == 1)).alias("pos"),
              F.sum(E.flag(C("fraud_label") == 0)).alias("neg")))
    run = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    gap = F.abs(F.sum("pos").over(run) / F.sum("pos").over(whole)
                - F.sum("neg").over(run) / F.sum("neg").over(whole))
    return n.withColumn("gap", gap).agg(F.max("gap").alias("ks"))


def block_means(df: DataFrame, blocks: list[str]) -> DataFrame:
    """Class means of each block score and their ratio."""
    aggs = [F.avg("fraud_label").alias("base")]
    for i, b in enumerate(blocks):
        aggs += [F.avg(F.when(C("fraud_label") == 1, C(b))).alias(f"fraud_mean_{i}"),
                 F.avg(F.when(C("fraud_label") == 0, C(b))).alias(f"clean_mean_{i}")]
    out = _rows(df.agg(*aggs), blocks, ["fraud_mean", "clean_mean"], "block").drop("base")
    return out.withColumn("ratio", C("fraud_mean") / F.greatest(C("clean_mean"), F.lit(V.EPS)))


def flag_combinations(df: DataFrame, combos: dict[str, Column]) -> DataFrame:
    """Rows, label rate and lift under each condition; one pass for all of them."""
    aggs = [F.avg("fraud_label").alias("base")]
    for i, cond in enumerate(combos.values()):
        hit = F.coalesce(cond, F.lit(False))
        aggs += [F.count(F.when(hit, 1)).alias(f"n_{i}"),
                 F.avg(F.when(hit, C("fraud_label"))).alias(f"rate_{i}")]
    out = _rows(df.agg(*aggs), list(combos), ["n", "rate"], "combo").filter("n > 0")
    return out.select("combo", "n", "rate", (C("rate") / C("base")).alias("lift"))


def standard_combinations() -> dict[str, Column]:
    """The weak-on-strong flag pairs and triples of the diagnostic report."""
    def on(c):
        return C(c) == 1

    def off(c):
        return C(c) == 0

    irs, low, zero = "flag_irs_high", "flag_low_withholding", "flag_zero_tax_with_income"
    prog, ded = "flag_progressive_anomaly", "flag_impossible_deductions"
    extreme, high = "flag_bank_deposit_extreme", "flag_bank_deposit_high"
    out = {}
    for short, f in (("zero_tax", zero), ("progressive", prog), ("low_wh", low)):
        out[f"irs_high=1, {short}=1"] = on(irs) & on(f)
        out[f"irs_high=1, {short}=0"] = on(irs) & off(f)
    out["bdr_extreme=1, impossible_ded=1"] = on(extreme) & on(ded)
    out["bdr_extreme=1, impossible_ded=0"] = on(extreme) & off(ded)
    out["irs_high=1, bdr_extreme=1, low_wh=1"] = on(irs) & on(extreme) & on(low)
    out["irs_high=1, bdr_high=1, zero_tax=1"] = on(irs) & on(high) & on(zero)
    return out


def flag_count_distribution(df: DataFrame, col: str = "total_flag_count") -> DataFrame:
    """Rows, share, label rate and lift per flag count."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.sum("fraud_label").alias("pos"))
    whole = Window.partitionBy(F.lit(0))     # over a few counts, not over rows
    rate = C("pos") / C("n")
    base = F.sum("pos").over(whole) / F.sum("n").over(whole)
    return g.select(col, "n", (C("n") / F.sum("n").over(whole) * 100).alias("pct"),
                    rate.alias("rate"), (rate / base).alias("lift"))


def roc_auc(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Tie-aware area under the ROC curve (and its mirrored maximum) per group.

    Positives and negatives are counted per distinct score, then accumulated by
    bucketed prefix sums, so neither a hot score nor a whole group meets one task.  The
    counts are staged: the sums read them several times, the rows are computed once.
    """
    by = by or []
    d = df.select(*by, C(score).cast("double").alias("v"), "fraud_label").filter(
        "v is not null and not isnan(v)")
    n = stage(d.groupBy(*by, "v").agg(F.sum(E.flag(C("fraud_label") == 1)).alias("pos"),
                                      F.sum(E.flag(C("fraud_label") == 0)).alias("neg")),
              "score-counts")
    run = prefix_sums(n, by, "v", ["neg"])
    won = C("pos") * (C("neg_before") + C("neg") / 2.0)
    auc = F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg"))
    out = run.groupBy(*by).agg(auc.alias("auc"))
    return out.withColumn("auc_either_way", F.greatest(C("auc"), 1 - C("auc")))
