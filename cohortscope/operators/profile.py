"""Person index, distributions, rate tables and column profiles.

Everything is a combining aggregate: hot persons, types or values shrink map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.quantiles import exact_quantiles, same_keys

C = F.col


def percent_change(now: Column, before: Column) -> Column:
    """Change relative to the size of the value before; NULL from nothing or from zero."""
    return F.when(before != 0, (now - before) / F.abs(before))


# ---------------------------------------------------------------- person index
def lifecycle(n: Column) -> Column:
    out = None
    for name, (lo, hi) in V.LIFECYCLES.items():
        out = F.when(n.between(lo, hi), name) if out is None else out.when(n.between(lo, hi), name)
    return out.otherwise("persistent")


def cohort_band(year: Column) -> Column:
    return E.ladder(year, [2018, 2019, 2021, 2025], ["early", "mid", "late"], right_closed=True)


def person_index(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per person: extent, label statistics, lifecycle, pattern, trajectory.

    A single shuffle: the distinct (year, label) pairs of a person are bounded by the
    number of years, so the trajectory is read from a short sorted array instead of a
    window over the person's rows.
    """
    keys = keys or ["person_id"]
    pair = F.struct(C("tax_year").alias("y"), C("fraud_label").alias("l"))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("fraud_label").alias("fraud_ever"),
        F.min("fraud_label").alias("fraud_always"), F.avg("fraud_label").alias("fraud_mean"),
        F.sum("fraud_label").alias("fraud_sum"),
        F.mode("taxpayer_type", True).alias("taxpayer_type"),
        F.min("tax_year").alias("year_min"), F.max("tax_year").alias("year_max"),
        F.array_sort(F.collect_set(pair)).alias("__s"))
    s = C("__s")
    before = lambda i: F.get(s, i - 1)["l"]                       # noqa: E731
    onset = F.size(F.filter(s, lambda x, i: (before(i) == 0) & (x["l"] == 1)))
    exits = F.size(F.filter(s, lambda x, i: (before(i) == 1) & (x["l"] == 0)))
    g = g.withColumns({
        "n_years": F.size(F.array_distinct(F.transform(s, lambda x: x["y"]))),
        "__on": onset, "__off": exits,
        "fraud_pattern": F.when((C("fraud_ever") == 1) & (C("fraud_always") == 1), "chronic")
        .when((C("fraud_ever") == 1) & (C("fraud_always") == 0), "mixed").otherwise("clean")})
    detail = (F.when((C("__on") >= 1) & (C("__off") == 0), "escalator")
              .when((C("__off") >= 1) & (C("__on") == 0), "reformed").otherwise("sporadic"))
    return g.withColumns({
        "lifecycle": lifecycle(C("n_years")),
        "fraud_detail": F.when(C("fraud_pattern") == "mixed", detail)
        .otherwise(C("fraud_pattern")),
        "cohort_band": cohort_band(C("year_min"))}).drop("__s", "__on", "__off")


# ----------------------------------------------------------------- distributions
def value_counts(df: DataFrame, col: str, by: list[str] | None = None,
                 dropna: bool = True) -> DataFrame:
    """Count and share of every value (within ``by``).

    Totals come from their own aggregate: a window over all distinct values would put
    a high-cardinality column into one task.
    """
    d = df.filter(C(col).isNotNull()) if dropna else df
    n = d.groupBy(*(by or []), col).agg(F.count(F.lit(1)).alias("n"))
    if by:
        whole = n.groupBy(*by).agg(F.sum("n").alias("__whole"))
        return same_keys(n, whole, by, "inner").withColumn(
            "share", C("n") / C("__whole")).drop("__whole")
    return n.withColumn("share", C("n") / F.lit(d.count()))


def years_per_person(index: DataFrame) -> DataFrame:
    return index.groupBy("n_years").agg(F.count(F.lit(1)).alias("persons"))


def rate_table(df: DataFrame, by: list[str]) -> DataFrame:
    """Label rate, positives and rows per group."""
    label = F.coalesce(C("fraud_label"), F.lit(0))
    return df.groupBy(*by).agg(F.avg(label).alias("rate"), F.sum(label).alias("positives"),
                               F.count(F.lit(1)).alias("n_rows"))


def person_consistency(index: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Persons always clean, always positive or mixed, and the rates of the mixed ones."""
    mixed = C("fraud_always") != C("fraud_ever")
    rate = F.when(mixed, C("fraud_mean"))
    return index.groupBy(*(by or [])).agg(
        F.sum(E.flag(C("fraud_ever") == 0)).alias("always_clean"),
        F.sum(E.flag(C("fraud_always") == 1)).alias("always_fraud"),
        F.sum(E.flag(mixed)).alias("mixed"), F.avg(rate).alias("mixed_rate_mean"),
        F.min(rate).alias("mixed_rate_min"), F.max(rate).alias("mixed_rate_max"))


def state_profiles(df: DataFrame) -> DataFrame:
    """One row per state: rows, persons, rates, fraud persons and label consistency."""
    p = person_index(df, ["state", "person_id"])
    return p.groupBy("state").agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_persons"),
        (F.sum("fraud_sum") / F.sum("n_rows")).alias("fraud_rate"),
        (F.sum("n_rows") / F.count(F.lit(1))).alias("years_per_person"),
        F.sum("fraud_ever").alias("fraud_persons"),
        F.sum(E.flag(C("fraud_pattern") == "mixed")).alias("mixed_fraud"),
        F.sum(E.flag(C("fraud_pattern") == "chronic")).alias("always_fraud"),
        F.sum(E.flag(C("fraud_pattern") == "clean")).alias("always_clean"))


def cell_counts(index: DataFrame, by: list[str] | None = None) -> DataFrame:
    return index.groupBy(*(by or []), "lifecycle", "fraud_pattern").agg(
        F.count(F.lit(1)).alias("persons"))


def filer_comparison(df: DataFrame) -> DataFrame:
    """One-year against multi-year filers: rows, rate, and counts per cohort, year, type."""
    years = df.groupBy("person_id").agg(
        F.when(F.min("tax_year") == F.max("tax_year"), "one_year").otherwise("multi_year")
        .alias("filer"))
    d = df.join(years, "person_id")
    dims = ["entry_cohort", "tax_year", "taxpayer_type"]
    cells = d.groupBy("filer", *dims).agg(F.count(F.lit(1)).alias("n"),
                                          F.sum("fraud_label").alias("s"))
    parts = ", ".join(f"'{c}', cast(`{c}` as string)" for c in dims)
    long = cells.select("filer", "n", "s", F.expr(
        f"stack({len(dims) + 1}, 'all', 'all', {parts}) as (dim, value)"))
    out = long.groupBy("filer", "dim", "value").agg(F.sum("n").alias("n_rows"),
                                                    F.sum("s").alias("positives"))
    whole = Window.partitionBy("filer", "dim")
    return out.withColumns({"rate": C("positives") / C("n_rows"),
                            "share": C("n_rows") / F.sum("n_rows").over(whole)})


# ---------------------------------------------------------------- column profiles
def _stack(one_row: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn ``{field}_{name}`` columns of a one-row table into a row per name."""
    cells = ", ".join(f"'{n}', " + ", ".join(f"`{f}_{n}`" for f in fields) for n in names)
    return one_row.select(F.expr(
        f"stack({len(names)}, {cells}) as (column, {', '.join(fields)})"))


def null_rates(df: DataFrame) -> DataFrame:
    """Percentage of NULLs per column, one pass."""
    one = df.agg(*[(F.avg(E.flag(C(c).isNull())) * 100).alias(f"null_pct_{c}")
                   for c in df.columns])
    return _stack(one, df.columns, {"null_pct": "double"})


def high_null_columns(df: DataFrame, above: float = 80.0) -> DataFrame:
    return null_rates(df).filter(C("null_pct") > above)


def column_manifest(df: DataFrame) -> DataFrame:
    """Type, NULLs, and min/max/mean (numbers) or distinct count (text) per column.

    Text columns are counted through (column, value) cells, which combine map-side;
    a multi-distinct would copy every row once per column.
    """
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c] in
               ("double", "float", "int", "bigint", "smallint", "tinyint")]
    text = [c for c in df.columns if c not in numeric]
    aggs = []
    for c in numeric:
        aggs += [F.count(F.lit(1)).alias(f"rows_{c}"), F.count(c).alias(f"filled_{c}"),
                 F.min(c).cast("double").alias(f"low_{c}"),
                 F.max(c).cast("double").alias(f"high_{c}"),
                 F.avg(c).alias(f"mean_{c}")]
    parts = []
    if numeric:
        num = _stack(df.agg(*aggs), numeric, dict.fromkeys(
            ["rows", "filled", "low", "high", "mean"], ""))
        parts.append(num.withColumn("n_unique", F.lit(None).cast("long")))
    if text:
        cells = ", ".join(f"'{c}', cast(`{c}` as string)" for c in text)
        pairs = (df.select(F.expr(f"stack({len(text)}, {cells}) as (column, value)"))
                 .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        txt = pairs.groupBy("column").agg(
            F.sum("n").alias("rows"), F.sum(F.when(C("value").isNotNull(), C("n")).otherwise(0))
            .alias("filled"), F.count("value").alias("n_unique"))
        none = F.lit(None).cast("double")
        parts.append(txt.select("column", "rows", "filled", none.alias("low"),
                                none.alias("high"), none.alias("mean"), "n_unique"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(
        "column", E.lookup("column", kinds).alias("dtype"),
        (C("rows") - C("filled")).alias("null_count"),
        ((C("rows") - C("filled")) / F.greatest(C("rows"), F.lit(1))).alias("null_rate"),
        "low", "high", "mean", "n_unique", C("column").isin(V.CANONICAL).alias("in_canonical"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(C("n") - 1), F.lit(0)).alias("duplicate_rows"))


# ------------------------------------------------------------------ value checks
def income_sanity(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Median, mean and share of zeros of the non-NULL values."""
    by = by or []
    long = df.select(*by, F.expr("stack({}, {}) as (column, v)".format(
        len(cols), ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols))))
    long = long.filter("v is not null")
    g = long.groupBy(*by, "column").agg(F.avg("v").alias("mean"),
                                        (F.avg(E.flag(C("v") == 0)) * 100).alias("pct_zero"))
    med = exact_quantiles(long, by + ["column"], ["v"], {"median": 0.5})
    return g.join(med.withColumnRenamed("v_median", "median"), by + ["column"])


def benchmark_deviation(df: DataFrame, by: list[str] | None = None,
                        benchmarks: dict | None = None, tolerance: float = 0.40) -> DataFrame:
    """Median and mean of positive values against reference figures."""
    benchmarks = benchmarks or V.INCOME_BENCHMARKS
    cols = [c for c in benchmarks if c in df.columns]
    positive = df.select(*(by or []), *[F.when(C(c) > 0, C(c)).alias(c) for c in cols])
    out = income_sanity(positive, cols, by).drop("pct_zero")
    b_med = E.lookup("column", {c: float(benchmarks[c][0]) for c in cols})
    b_mean = E.lookup("column", {c: float(benchmarks[c][1]) for c in cols})
    out = out.withColumns({"median_dev": (C("median") - b_med) / b_med,
                           "mean_dev": (C("mean") - b_mean) / b_mean})
    return out.withColumn("ok", E.flag((F.abs("median_dev") < tolerance)
                                       & (F.abs("mean_dev") < tolerance)))


def positive_distribution(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Median, mean and 99th percentile of the positive values."""
    pos = df.filter(C(col) > 0).withColumn("__all", F.lit(1))
    keys = by or ["__all"]
    q = exact_quantiles(pos, keys, [col], {"median": 0.5, "p99": 0.99})
    g = pos.groupBy(*keys).agg(F.avg(col).alias("mean"), F.count(F.lit(1)).alias("n"))
    return (g.join(q, keys).drop("__all")
            .withColumnsRenamed({f"{col}_median": "median", f"{col}_p99": "p99"}))


def yearly_median_change(df: DataFrame, col: str, limit: float = 20.0) -> DataFrame:
    """Median per year, its change in percent on the year before, and whether it holds."""
    med = exact_quantiles(df, ["tax_year"], [col], {"median": 0.5})
    prev = F.lag(f"{col}_median").over(Window.partitionBy(F.lit(0)).orderBy("tax_year"))
    out = med.select("tax_year", C(f"{col}_median").alias("median"),
                     ((C(f"{col}_median") / prev - 1) * 100).alias("change_pct"))
    return out.withColumn("ok", F.abs("change_pct") < limit)


def rate_drift(df: DataFrame) -> DataFrame:
    """Largest minus smallest yearly label rate."""
    return (rate_table(df, ["tax_year"])
            .agg((F.max("rate") - F.min("rate")).alias("drift")))


def label_correlation(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Pearson correlation of a score with a condition."""
    return df.agg(F.corr(C(score).cast("double"), E.flag(positive).cast("double"))
                  .alias("correlation"))


def known_vs_new(df: DataFrame, train: DataFrame) -> DataFrame:
    """Rows and rate of persons seen in training and of new ones, with shares."""
    seen = train.select("person_id").distinct().withColumn("known", F.lit(1))
    d = df.join(seen, "person_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    n = d.groupBy("known").agg(F.count(F.lit(1)).alias("n_rows"),
                               F.avg("fraud_label").alias("rate"))
    return n.withColumn("share", C("n_rows") / F.sum("n_rows").over(
        Window.partitionBy(F.lit(0))))


def link_coverage(persons: DataFrame, links: DataFrame, types: list[str]) -> DataFrame:
    """Eligible persons with at least one link, per zone and overall (zone NULL)."""
    linked = links.select("person_id").distinct().withColumn("linked", F.lit(1))
    d = persons.filter(C("taxpayer_type").isin(types)).join(linked, "person_id", "left")
    return d.rollup("zone").agg(
        F.count(F.lit(1)).alias("eligible"), F.count("linked").alias("covered"),
        (F.count("linked") / F.count(F.lit(1))).alias("coverage"))
