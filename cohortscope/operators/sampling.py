"""Lifecycle-preserving stratified sampling of whole person histories.

All states are sampled in one job.  Draws are hash-ordered, so a sample is the same
in any engine and after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.ordering import pick_by_hash, shuffle_rows
from cohortscope.operators.profile import person_index, value_counts
from cohortscope.session import stage

C = F.col
CELL = ["state", "lifecycle", "fraud_pattern"]


def target_rates() -> Column:
    return E.lookup("state", V.STATE_TARGET_RATE)


def cell_targets(index: DataFrame, target_rows: int = V.TARGET_ROWS_PER_STATE) -> DataFrame:
    """Persons to draw per (state, lifecycle, pattern).

    Row and rate targets become person counts through the mean history length of
    positive and clean persons, then split by pattern and lifecycle shares.  Only the
    aggregated cells (a few dozen per state) enter the arithmetic.
    """
    cells = index.groupBy(*CELL).agg(F.count(F.lit(1)).alias("cell_size"),
                                     F.sum("n_rows").alias("cell_rows"))
    dirty = C("fraud_pattern") != "clean"
    whole = Window.partitionBy("state")

    def mean_rows(cond):
        return (F.sum(F.when(cond, C("cell_rows"))).over(whole)
                / F.sum(F.when(cond, C("cell_size"))).over(whole))

    rate = target_rates()
    n_fraud = F.bround(F.lit(float(target_rows)) * rate / mean_rows(dirty))
    n_clean = F.bround(F.lit(float(target_rows)) * (1 - rate) / mean_rows(~dirty)
                       * V.CLEAN_BUFFER)
    cells = cells.withColumns({"n_fraud": n_fraud, "n_clean": n_clean})
    share = E.lookup("lifecycle", V.LIFECYCLE_SHARE)
    per_pattern = F.when(dirty, F.bround(C("n_fraud") * E.lookup("fraud_pattern",
                                                               V.PATTERN_SHARE)))
    wanted = F.bround(F.when(dirty, per_pattern).otherwise(C("n_clean")) * share).cast("long")
    return cells.select(*CELL, "cell_size", F.least(wanted, C("cell_size")).alias("n_target"))


def largest_remainder(cells: DataFrame, group: list[str], label: str) -> DataFrame:
    """Split ``n_target`` of a group over its strata sizes ``n``; remainders biggest first.

    ``cells`` holds one row per stratum, so the windows see a handful of rows.
    """
    whole = Window.partitionBy(*group)
    exact = C("n_target") * C("n") / F.sum("n").over(whole)
    d = cells.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    order = whole.orderBy((C("exact") - C("base")).desc(), C(label))
    short = C("n_target") - F.sum("base").over(whole)
    d = d.withColumn("extra", E.flag(F.row_number().over(order) <= short))
    return d.withColumn("n_take", F.least(C("base") + C("extra"), C("n"))).drop(
        "exact", "base", "extra")


def sampled_persons(index: DataFrame, targets: DataFrame, seed=V.SEED) -> DataFrame:
    """Persons drawn per cell, keeping each cell's mix of taxpayer types."""
    strata = CELL + ["taxpayer_type"]
    sizes = index.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    budgets = largest_remainder(sizes.join(targets.filter("n_target > 0"), CELL), CELL,
                                "taxpayer_type")
    return pick_by_hash(index, strata, ["person_id"], seed, budgets)


def pull_rows(df: DataFrame, persons: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whole histories of the given persons."""
    keys = keys or ["person_id"]
    return df.join(persons.select(*keys), keys, "left_semi")


def trim_persons(persons: DataFrame, target_rows: int, seed=V.SEED) -> DataFrame:
    """Clean persons to remove, whole, in hash order, until the target is nearly met.

    A person goes while the rows left before it still exceed target + slack, which is
    a weighted prefix cut; states within tolerance lose nobody.
    """
    rows = persons.groupBy("state").agg(F.sum("n_rows").alias("rows"))
    over = F.when(C("rows") > target_rows * (1 + V.TRIM_TOLERANCE),
                  C("rows") - target_rows - V.TRIM_SLACK).otherwise(0)
    budgets = rows.select("state", over.alias("n_take"))
    return pick_by_hash(persons.filter("fraud_pattern = 'clean'"), ["state"], ["person_id"],
                        f"{seed}-trim", budgets, weight=C("n_rows"))


def sample_states(df: DataFrame, target_rows: int = V.TARGET_ROWS_PER_STATE, seed=V.SEED,
                  drop: list[str] | None = None, shuffled: bool = False) -> DataFrame:
    """End-to-end: index, targets, draw, trim, pull whole histories, for all states."""
    df = df.drop(*(drop or []))
    index = stage(person_index(df, ["state", "person_id"]), "person-index")
    targets = stage(cell_targets(index, target_rows), "cell-targets")
    drawn = stage(sampled_persons(index, targets, seed), "drawn")
    gone = trim_persons(drawn, target_rows, seed).select("state", "person_id")
    kept = drawn.join(gone, ["state", "person_id"], "left_anti")
    out = pull_rows(df, kept, ["state", "person_id"])
    return shuffle_rows(out, ["person_id", "tax_year"], seed) if shuffled else out


def sample_report(sample: DataFrame) -> DataFrame:
    """Rows, persons, rate, lifecycle shares, trajectory counts, rows per year (long form)."""
    index = person_index(sample, ["state", "person_id"])
    head = index.groupBy("state").agg(
        F.sum("n_rows").cast("double").alias("rows"), F.count(F.lit(1)).cast("double").alias(
            "persons"), (F.sum("fraud_sum") / F.sum("n_rows")).alias("rate"))
    parts = [head.select("state", F.expr(
        "stack(3, 'rows', 'all', rows, 'persons', 'all', persons, 'rate', 'all', rate) "
        "as (item, value, amount)"))]
    life = value_counts(index, "lifecycle", ["state"])
    parts.append(life.select("state", F.lit("lifecycle").alias("item"), C("lifecycle").alias(
        "value"), C("share").alias("amount")))
    detail = index.filter("fraud_ever = 1").groupBy("state", "fraud_detail").count()
    parts.append(detail.select("state", F.lit("detail").alias("item"), C("fraud_detail").alias(
        "value"), C("count").cast("double").alias("amount")))
    years = sample.groupBy("state", "tax_year").count()
    parts.append(years.select("state", F.lit("year").alias("item"), C("tax_year").cast(
        "string").alias("value"), C("count").cast("double").alias("amount")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
