"""Schema alignment, null policy, priority de-duplication and the multi-source merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.ordering import shuffle_rows
from cohortscope.operators.splits import fix_rate
from cohortscope.session import stage

C = F.col


# ------------------------------------------------------------------- projections
def feature_columns(cols: list[str]) -> list[str]:
    """Training features that exist, in catalogue order."""
    have = set(cols)
    return [c for c in V.FEATURES if c in have]


def column_roles(cols: list[str]) -> dict[str, list[str]]:
    have = set(cols)
    return {"numeric": [c for c in V.NUMERIC_FEATURES if c in have],
            "categorical": [c for c in V.CATEGORICAL_FEATURES if c in have],
            "binary": [c for c in V.BINARY_FEATURES if c in have]}


def training_frame(df: DataFrame) -> DataFrame:
    """Features plus the target; audit-only columns are never read."""
    return df.select(*feature_columns(df.columns), V.TARGET)


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*V.LEAKAGE)


# -------------------------------------------------------------- schema alignment
def align(df: DataFrame, tag: str, seed=V.SEED) -> DataFrame:
    """Canonical columns, order and types; source tag, unique ids, filled years."""
    have = set(df.columns)
    if "person_id" not in have:
        df = df.withColumn("person_id", F.format_string("%08d", F.monotonically_increasing_id()))
    u = E.digest_uniform(E.draw_key(f"{seed}-{tag}", "person_id"))
    drawn = E.weighted_choice(u, V.TRAIN_YEAR_WEIGHTS)
    year = F.coalesce(C("tax_year").cast("int"), drawn) if "tax_year" in have else drawn
    df = df.withColumns({
        "tax_year": year, "data_source": F.lit(tag),
        "person_id": F.concat_ws("_", F.lit(V.SOURCE_PREFIX.get(tag, "XX")), "person_id")})
    have = set(df.columns)

    def typed(c):
        if c == "tax_year":
            kind = "int"
        elif c in V.CANONICAL_INT:
            kind = "bigint"
        else:
            kind = "string" if c in V.CANONICAL_STRING else "double"
        if c not in have:
            return F.lit(None).cast(kind).alias(c)
        x = C(c)
        if c in V.CANONICAL_INT:
            x = F.bround(x.try_cast("double"))
        return x.try_cast(kind).alias(c)

    return df.select(*[typed(c) for c in V.CANONICAL])


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns a source lacks become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ de-duplication
def keep_best(df: DataFrame, keys: list[str], source: str = "data_source") -> DataFrame:
    """One row per key: best source, then the smallest row in column order.

    ``min`` over (priority, row) combines map-side, so a key with very many copies
    shrinks before the shuffle instead of being ranked in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = E.lookup(source, V.SOURCE_PRIORITY, 9)
    best = df.groupBy(*keys).agg(F.min(F.struct(rank.alias("__rank"), *rest)).alias("__row"))
    return best.select(*[C(c) if c in keys else C(f"__row.{c}").alias(c) for c in df.columns])


# --------------------------------------------------------------------- null policy
def null_policy(df: DataFrame) -> DataFrame:
    """NULL where a value cannot exist: wrong type, flag off, too young, no wages.

    Text columns outside the known ones become numbers (bad text -> NULL) and flags
    become whole numbers with NULL as 0.
    """
    have, kinds, out = set(df.columns), dict(df.dtypes), {}

    def gate(cols, keep):
        for c in cols:
            if c in have:
                out[c] = F.when(keep, out.get(c, C(c)))

    if "taxpayer_type" in have:
        gate(V.SE_COLUMNS, F.coalesce(C("taxpayer_type").isin(V.SE_INCOME_TYPES), F.lit(False)))
    for f, cols in V.NULL_WHEN_FLAG_OFF.items():
        if f in have:
            gate(cols, F.coalesce(C(f) != 0, F.lit(True)))
    if "age" in have:
        gate(["social_security_income"],
             F.coalesce(C("age") >= V.SOCIAL_SECURITY_AGE, F.lit(True)))
    if {"w2_wages", "taxpayer_type"} <= have:
        no_wage = C("taxpayer_type").isin(V.W2_TYPES) & (E.nz("w2_wages") == 0)
        gate(V.WAGE_COLUMNS, ~F.coalesce(no_wage, F.lit(False)))
    for c in df.columns:
        if kinds[c] == "string" and c not in V.STRING_COLUMNS and c != "tax_year":
            out[c] = out.get(c, C(c)).try_cast("double")
        if c in V.INT_FLAGS:
            out[c] = F.coalesce(out.get(c, C(c)), F.lit(0)).cast("bigint")
    return df.withColumns(out)


def clean_labels(df: DataFrame) -> DataFrame:
    """Rows with label 0 (or none) carry type and category 'none' and no amounts."""
    clean = F.coalesce(C("fraud_label"), F.lit(0)) == 0
    out = {c: F.when(clean, "none").otherwise(C(c))
           for c in ("fraud_type", "fraud_category") if c in df.columns}
    out.update({c: F.when(~clean, C(c)) for c in ("evasion_amount", "evasion_rate")
                if c in df.columns})
    return df.withColumns(out)


# ---------------------------------------------------------------- model tables
def fill_for_model(df: DataFrame, drop: list[str]) -> DataFrame:
    """Numbers -> 0, fraud type/category -> 'none', other text -> its most common value."""
    df = df.drop(*[c for c in drop if c in df.columns])
    kinds = dict(df.dtypes)
    text = [c for c in df.columns if kinds[c] == "string"]
    out = {c: F.coalesce(C(c), F.lit(0).cast(kinds[c])) for c in df.columns if c not in text}
    fixed = [c for c in ("fraud_type", "fraud_category") if c in text]
    out.update({c: F.coalesce(C(c), F.lit("none")) for c in fixed})
    others = [c for c in text if c not in fixed]
    if others:
        common = most_common(df, others)
        out.update({c: F.coalesce(C(c), F.lit(common.get(c, "unknown"))) for c in others})
    return df.withColumns(out)


def most_common(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most common value per column, ties to the smallest; one small row per column.

    Counted through (column, value) cells, so high-cardinality text stays distributed.
    """
    cells = ", ".join(f"'{c}', `{c}`" for c in cols)
    n = (df.select(F.expr(f"stack({len(cols)}, {cells}) as (column, value)"))
         .filter("value is not null").groupBy("column", "value")
         .agg(F.count(F.lit(1)).alias("n")))
    top = n.groupBy("column").agg(F.min(F.struct((-C("n")).alias("n"), "value")).alias("t"))
    return {r["column"]: r["value"] for r in top.select("column", "t.value").collect()}


def repair_generated(df: DataFrame, model: str) -> DataFrame:
    """Hard constraints on model-made rows (``w2``, ``se`` or ``itemizers``)."""
    have, out = set(df.columns), {}
    if "agi" in have:
        out["agi"] = E.clip("agi", 0)
    if "taxable_income" in have:
        out["taxable_income"] = E.clip("taxable_income", 0)
        if "agi" in have:   # the row minimum skips NULL on either side
            out["taxable_income"] = F.least(out["taxable_income"], out["agi"])
    if "effective_tax_rate" in have:
        out["effective_tax_rate"] = E.clip("effective_tax_rate", 0, 0.37)
    if "age" in have:
        out["age"] = F.bround(E.clip(C("age").cast("double"), 18, 85)).cast("int")
    if model == "w2":
        if "w2_wages" in have:
            out["w2_wages"] = E.clip("w2_wages", 0)
        if {"social_security_income", "age"} <= have:
            out["social_security_income"] = F.when(
                F.coalesce(out["age"] >= V.SOCIAL_SECURITY_AGE, F.lit(True)),
                C("social_security_income"))
    if model == "se":
        for c in ("gross_receipts", "cogs", "total_expenses"):
            if c in have:
                out[c] = E.clip(c, 0)
        if {"gross_receipts", "cogs"} <= have:
            out["cogs"] = F.least(out["cogs"], out["gross_receipts"])
        if {"gross_receipts", "cogs", "total_expenses", "net_se_income"} <= have:
            out["net_se_income"] = E.clip(out["gross_receipts"] - E.nz(out["cogs"])
                                          - E.nz(out["total_expenses"]), -200_000)
    if model == "itemizers":
        if "itemized_salt" in have:
            out["itemized_salt"] = E.clip("itemized_salt", 0, 10_000)
        if "uses_itemized" in have:
            out["uses_itemized"] = F.lit(1)
    if "fraud_label" in have:
        label = F.bround(E.clip(C("fraud_label").cast("double"), 0, 1)).cast("int")
        out["fraud_label"] = label
        for c in ("fraud_type", "fraud_category"):
            if c in have:
                out[c] = F.when(label == 0, "none").otherwise(C(c))
    if "total_tax_liability" in have:
        out["total_tax_liability"] = E.clip("total_tax_liability", 0)
    return df.withColumns(out)


# --------------------------------------------------------------------------- merge
def merge_sources(parts: dict[str, DataFrame], target: float = V.RATE_OVERALL,
                  tolerance: float = V.RATE_TOLERANCE, seed=V.SEED,
                  shuffled: bool = True) -> DataFrame:
    """Align, union, de-duplicate, apply null policy, fix labels and rate, shuffle."""
    merged = keep_best(union_sources([align(d, tag, seed) for tag, d in parts.items()]),
                       ["person_id", "tax_year"])
    merged = stage(clean_labels(null_policy(merged)), "merged")
    merged = fix_rate(merged, target, tolerance, seed)
    return shuffle_rows(merged, ["person_id", "tax_year"], seed) if shuffled else merged


def with_state(df: DataFrame) -> DataFrame:
    """State name of a zone (output map; the fitting map is a different one)."""
    return df.withColumn("state", E.lookup("zone", V.ZONE_TO_STATE))


# --------------------------------------------------------------- incremental merge
BUCKETS = 64


def merge_batch(spark, path: str, parts: dict[str, DataFrame], buckets: int = BUCKETS,
                seed=V.SEED) -> DataFrame:
    """Merge arriving sources into the table at ``path``; returns the buckets rewritten.

    Rows lie in partitions by a hash of the person.  Only partitions of arriving persons are
    read, merged and replaced; the best row per person-year is kept as it came, since the
    smallest of smallest rows is the same in whatever batches they arrive.  ``merged_rows``
    applies policy and label cleaning on reading.
    """
    new = union_sources([align(d, tag, seed) for tag, d in parts.items()])
    new = stage(new.withColumn("bucket", F.pmod(F.xxhash64("person_id"), F.lit(buckets))
                               .cast("int")), "arrived")
    touched = stage(new.select("bucket").distinct(), "touched")
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    if base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base):
        # at most ``buckets`` numbers: as a literal list they prune the folders that are read
        wanted = [r["bucket"] for r in touched.collect()]
        new = new.unionByName(spark.read.schema(new.schema).parquet(path)
                              .filter(C("bucket").isin(wanted)))
    best = stage(keep_best(new, ["person_id", "tax_year", "bucket"]), "merged-batch")
    (best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    return touched


def merged_rows(spark, path: str) -> DataFrame:
    """The merged table under null policy and with clean labels."""
    return clean_labels(null_policy(spark.read.parquet(path).drop("bucket")))
