"""Leakage-safe splits, exact-size stratified samples and label-rate enforcement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.ordering import draw_with_replacement, pick_by_hash
from cohortscope.session import stage

C = F.col
ROW = ["person_id", "tax_year"]


def fix_contradictions(df: DataFrame) -> DataFrame:
    """Positive label with type 'none' becomes a clean row with no amounts."""
    bad = F.coalesce((C("fraud_label") == 1) & (C("fraud_type") == "none"), F.lit(False))
    out = {"fraud_label": F.when(bad, 0).otherwise(C("fraud_label"))}
    if "fraud_category" in df.columns:
        out["fraud_category"] = F.when(bad, "none").otherwise(C("fraud_category"))
    for c in ("evasion_amount", "evasion_rate", "tax_gap_amount", "true_tax_liability"):
        if c in df.columns:
            out[c] = F.when(~bad, C(c))
    return df.withColumns(out)


def split_by_year(df: DataFrame, train: list[int] = V.TRAIN_YEARS, val: int = V.VALIDATION_YEAR,
                  test: int = V.TEST_YEAR) -> DataFrame:
    """Use case A: train / validation / test by year (a pruning-friendly column rule).

    Rows of other years, or without one, have a NULL split; ``outside_splits`` counts them.
    """
    y = C("tax_year")
    return df.withColumn("split", F.when(y.isin(train), "train")
                         .when(y == val, "val").when(y == test, "test"))


def outside_splits(tagged: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Per use case: rows, and rows that fall in no split, with their years' range."""
    parts = [d.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(C(tag).isNull(), 1))
                   .alias("n_outside"), F.min(F.when(C(tag).isNull(), C("tax_year"))).alias("first_year"),
                   F.max(F.when(C(tag).isNull(), C("tax_year"))).alias("last_year"))
             .select(F.lit(name).alias("use_case"), "*") for name, d in tagged.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def year_subsets(train: DataFrame) -> dict[str, DataFrame]:
    """Training subsets: employees, self-employed, itemizers."""
    out = {"employees": train.filter(C("taxpayer_type").isin(V.W2_TYPES)),
           "self_employed": train.filter(C("taxpayer_type").isin(V.SE_TYPES))}
    if "uses_itemized" in train.columns:
        out["itemizers"] = train.filter("uses_itemized = 1")
    return out


def split_by_person(df: DataFrame, train: list[int] = V.TRAIN_YEARS,
                    val: int = V.VALIDATION_YEAR, test: int = V.TEST_YEAR) -> DataFrame:
    """Use case B: validation and test hold unseen persons only.

    Later rows of persons seen in training move to train.  Known persons come from one
    combining aggregate and one join, not from an id set on the driver.
    """
    seen = (df.filter(C("tax_year").isin(train)).select("person_id").distinct()
            .withColumn("__seen", F.lit(1)))
    d = split_by_year(df, train, val, test).join(seen, "person_id", "left")
    split = F.when(C("__seen") == 1, "train").otherwise(C("split"))
    return d.withColumn("split", split).drop("__seen")


def set_overlap(sets: dict[str, DataFrame], key: str = "person_id") -> DataFrame:
    """Distinct keys shared by each pair of row sets, from one grouped pass."""
    tagged = None
    for name, d in sets.items():
        part = d.select(key, F.lit(name).alias("tag"))
        tagged = part if tagged is None else tagged.unionByName(part)
    per_key = tagged.groupBy(key).agg(*[F.max(E.flag(C("tag") == n)).alias(f"in_{n}")
                                        for n in sets])
    names = list(sets)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    one = per_key.agg(*[F.sum(C(f"in_{a}") * C(f"in_{b}")).alias(f"o{i}")
                        for i, (a, b) in enumerate(pairs)])
    cells = ", ".join(f"'{a}', '{b}', o{i}" for i, (a, b) in enumerate(pairs))
    return one.select(F.expr(f"stack({len(pairs)}, {cells}) as (left_set, right_set, shared)"))


# ------------------------------------------------------------------ exact samples
def proportional_sample(df: DataFrame, n: int, stratify: str, seed=V.SEED,
                        ids: list[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows in proportion to ``stratify``; leftovers to the largest strata."""
    sizes = df.groupBy(stratify).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))      # over strata, a handful of rows
    s = sizes.withColumn("total", F.sum("n").over(whole))
    s = s.withColumn("base", F.floor(C("n") / C("total") * n).cast("long"))
    order = whole.orderBy(C("n").desc(), C(stratify))
    extra = E.flag(F.row_number().over(order) <= n - F.sum("base").over(whole))
    take = F.when(C("total") <= n, C("n")).otherwise(F.least(C("base") + extra, C("n")))
    return pick_by_hash(df, [stratify], ids or ROW, seed, s.withColumn("n_take", take))


def sample_rows(df: DataFrame, n: int, seed=V.SEED, ids: list[str] | None = None) -> DataFrame:
    """``n`` rows without replacement, by hash order."""
    budget = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n_take"))
    return pick_by_hash(df, [], ids or ROW, seed, budget)


def class_counts(df: DataFrame) -> tuple[int, int]:
    """(positives, negatives): one aggregate row."""
    r = df.agg(F.sum(E.flag(C("fraud_label") == 1)).alias("p"),
               F.sum(E.flag(C("fraud_label") == 0)).alias("n")).first()
    return r["p"] or 0, r["n"] or 0


def raise_rate(df: DataFrame, target: float, tolerance: float, seed=V.SEED,
               ids: list[str] | None = None) -> DataFrame:
    """Bring the label rate into its band by adding rows only.

    The short class gets extra rows drawn with replacement; no row is dropped.
    """
    pos, neg = class_counts(df)
    rate = pos / max(pos + neg, 1)
    if target - tolerance <= rate <= target + tolerance:
        return df
    if rate < target - tolerance:
        label, have, need = 1, pos, math.ceil(target * neg / (1 - target))
    else:
        label, have, need = 0, neg, math.ceil((1 - target) * pos / target)
    if need <= have or have == 0:
        return df
    extra = draw_with_replacement(df.filter(C("fraud_label") == label), ids or ROW, seed,
                                  need - have, have)
    return df.unionByName(extra.drop("draw"))


def fix_rate(df: DataFrame, target: float, tolerance: float, seed=V.SEED,
             ids: list[str] | None = None) -> DataFrame:
    """Bring the label rate to target at constant row count, class by class."""
    ids = ids or ROW
    pos, neg = class_counts(df)
    n = pos + neg
    if abs(pos / max(n, 1) - target) <= tolerance:
        return df
    want_pos = round(n * target)
    parts = []
    for label, have, want in ((1, pos, want_pos), (0, neg, n - want_pos)):
        rows = df.filter(C("fraud_label") == label)
        if have >= want:
            parts.append(sample_rows(rows, want, f"{seed}-{label}", ids))
        else:
            parts.append(draw_with_replacement(rows, ids, f"{seed}-{label}", want, have)
                         .drop("draw"))
    return parts[0].unionByName(parts[1])


def seed_panels(train: DataFrame, n: int = V.SEED_ROWS, seed=V.SEED) -> dict[str, DataFrame]:
    """Stratified seeds per subset, all positives, and negatives at most 4 : 1."""
    out = {f"seed_{k}": proportional_sample(d, n, "taxpayer_type", f"{seed}-{k}")
           for k, d in year_subsets(train).items()}
    pos, neg = class_counts(train)
    out["seed_evaders"] = train.filter("fraud_label = 1")
    out["seed_compliant"] = sample_rows(train.filter("fraud_label = 0"), min(4 * pos, neg),
                                        f"{seed}-compliant")
    return out


def build_splits(panel: DataFrame, seed=V.SEED) -> dict[str, DataFrame]:
    """Use cases A and B with enforced training rates, plus the seed panels."""
    fixed = fix_contradictions(panel)
    a, b = split_by_year(fixed), stage(split_by_person(fixed), "person-split")
    train_a = stage(raise_rate(a.filter("split = 'train'").drop("split"), V.RATE_OVERALL,
                               V.RATE_TOLERANCE, f"{seed}-a"), "train-a")
    out = {"train": train_a, "val": a.filter("split = 'val'").drop("split"),
           "test": a.filter("split = 'test'").drop("split"),
           "person_train": raise_rate(b.filter("split = 'train'").drop("split"),
                                      V.RATE_OVERALL, V.RATE_TOLERANCE, f"{seed}-b"),
           "person_val": b.filter("split = 'val'").drop("split"),
           "person_test": b.filter("split = 'test'").drop("split")}
    out.update({f"train_{k}": d for k, d in year_subsets(train_a).items()})
    out.update(seed_panels(train_a, seed=seed))
    return out


def split_metrics(parts: dict[str, DataFrame], target: float, tolerance: float) -> DataFrame:
    """Rows, rate, band verdict, persons and persons known from training, per split.

    ``parts`` holds ``train``/``val``/``test`` and the same with ``person_``; a split's
    persons are known if they are in the training split of the same use case.  One pass
    groups all splits by person; nothing is collected.
    """
    tagged = None
    for name, d in parts.items():
        case = "person" if name.startswith("person_") else "year"
        part = d.select("person_id", "fraud_label", F.lit(name).alias("split"),
                        F.lit(case).alias("case"))
        tagged = part if tagged is None else tagged.unionByName(part)
    cells = tagged.groupBy("case", "person_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fraud_label").alias("s"))
    trained = (cells.filter(C("split").endswith("train")).select("case", "person_id")
               .withColumn("known", F.lit(1)))
    g = cells.join(trained, ["case", "person_id"], "left").groupBy("split").agg(
        F.sum("n").alias("n_rows"), (F.sum("s") / F.sum("n")).alias("rate"),
        F.count(F.lit(1)).alias("n_persons"), F.sum(E.nz("known", 0)).alias("n_known"))
    return g.select("split", "n_rows", "rate", F.lit(target).alias("target"),
                    E.flag(F.abs(C("rate") - target) <= tolerance).alias("ok"),
                    "n_persons", "n_known", (C("n_persons") - C("n_known")).alias("n_new"))
