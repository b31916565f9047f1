"""Exact interpolated quantiles of any group size.

``percentile`` keeps a value map of a whole group in one task.  Here a group is
first reduced to counts per order-preserving bucket (bounded, combined map-side);
only rows of the buckets that hold a wanted rank are looked at again.  A bucket that
is still large is split linearly between its own minimum and maximum, so no task
ever sorts a whole group and nothing is dropped or estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope.functions import exprs as E
from cohortscope.session import stage

REFINE_ABOVE = 2_000_000   # rows of one bucket that one task may order
SPLITS = 4096


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL, as in grouping; keeps left keys."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k)
                       for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = left.join(r, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def unpivot(df: DataFrame, keys: list[str], cols: list[str], value: str = "v",
            feature: str = "f") -> DataFrame:
    """One row per (row, column): the column's position and its value as double."""
    parts = ", ".join(f"{i}, cast(`{c}` as double)" for i, c in enumerate(cols))
    return (df.select(*keys, F.expr(f"stack({len(cols)}, {parts}) as ({feature}, {value})"))
            .filter(F.col(value).isNotNull() & ~F.isnan(value)))


def _bucket_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                   F.max("v").alias("hi"))


def _locate(buckets: DataFrame, group: list[str], order: Column, ranks: DataFrame | None,
            probs: list[float]) -> DataFrame:
    """Buckets that hold a wanted rank.

    ``ranks`` carries the wanted ranks inside each group; without it they follow from
    the group size and ``probs``.  The window runs over bucket totals, not over rows.
    """
    w = Window.partitionBy(*group)
    cum = buckets.withColumn("before", F.sum("n").over(
        w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    if ranks is None:
        cum = cum.withColumn("total", F.sum("n").over(w))
        wanted = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p"))
                           for i, p in enumerate(probs)])
        cum = cum.withColumn("w", F.explode(wanted))
        pos = F.col("w.p") * (F.col("total") - 1)
        cum = (cum.withColumn("q", F.col("w.q")).withColumn("pos", pos)
               .withColumn("lower", F.floor("pos").cast("long"))
               .withColumn("frac", F.col("pos") - F.floor("pos")))
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("lower").alias("rank")),
                        F.struct(F.lit(1).alias("side"),
                                 F.least(F.col("lower") + 1, F.col("total") - 1).alias("rank")))
        cum = (cum.withColumn("s", F.explode(sides)).withColumn("side", F.col("s.side"))
               .withColumn("rank", F.col("s.rank")).drop("w", "s", "pos", "lower", "total"))
    else:
        cum = same_keys(cum, ranks, group, "inner")
    return (cum.filter((F.col("rank") >= F.col("before"))
                       & (F.col("rank") < F.col("before") + F.col("n")))
            .withColumn("rank", F.col("rank") - F.col("before")))


def _settled() -> Column:
    """Value of a wanted rank that its bucket's ends already give."""
    return (F.when(F.col("rank") == 0, F.col("lo"))
            .when((F.col("rank") == F.col("n") - 1) | (F.col("lo") == F.col("hi")), F.col("hi")))


def long_quantiles(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of column ``v`` per ``keys``: one row per (keys, q) with ``value``.

    Equal to linear interpolation between order statistics.
    """
    rows = rows.withColumn("b", E.value_bucket(F.col("v")))
    found = _locate(_bucket_counts(rows, keys + ["b"]), keys, F.col("b"), None, probs)
    found = stage(found.withColumn("value", _settled()), "quantile-buckets")
    cell = keys + ["b"]
    settled = [found.filter("value is not null")]
    open_ = found.filter("value is null")
    while True:
        largest = open_.agg(F.max("n")).first()[0]
        if largest is None:
            break
        cells = open_.select(*cell, "lo", "hi").distinct()
        ranks = open_.select(*cell, "q", "side", "rank", "frac")
        inside = same_keys(rows, cells, cell, "inner")
        if largest <= REFINE_ABOVE:
            values = _bucket_counts(inside, cell + ["v"])
            last = _locate(values, cell, F.col("v"), ranks, probs)
            settled.append(last.withColumn("value", F.col("v")))
            break
        rows = inside.withColumn("b2", E.linear_split(F.col("v"), F.col("lo"), F.col("hi"),
                                                      SPLITS))
        rows = rows.drop("lo", "hi")
        found = _locate(_bucket_counts(rows, cell + ["b2"]), cell, F.col("b2"), ranks, probs)
        rows = rows.withColumn("b", F.concat_ws(".", F.col("b").cast("string"), "b2")).drop("b2")
        found = found.withColumn("b", F.concat_ws(".", F.col("b").cast("string"), "b2"))
        found = stage(found.withColumn("value", _settled()), "quantile-buckets")
        settled.append(found.filter("value is not null"))
        open_ = found.filter("value is null")
    out = None
    for part in settled:
        part = part.select(*keys, "q", "side", "frac", "value")
        out = part if out is None else out.unionByName(part)
    ends = out.groupBy(*keys, "q").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("value"))).alias("z"),
        F.max("frac").alias("frac"))
    between = F.col("a") + (F.col("z") - F.col("a")) * F.col("frac")
    return ends.select(*keys, "q", F.when((F.col("frac") == 0) | (F.col("a") == F.col("z")),
                                          F.col("a")).otherwise(between).alias("value"))


def exact_quantiles(df: DataFrame, keys: list[str], cols: list[str],
                    probs: dict[str, float]) -> DataFrame:
    """Wide form: one row per group with ``{col}_{name}`` for every prob name.

    Groups whose every value is NULL are absent; join them left where they matter.
    """
    rows = unpivot(df, keys, cols)
    long = long_quantiles(rows, keys + ["f"], list(probs.values()))
    wide = [F.max(F.when((F.col("f") == i) & (F.col("q") == j), F.col("value")))
            .alias(f"{c}_{name}" if name else c)
            for i, c in enumerate(cols) for j, name in enumerate(probs)]
    return long.groupBy(*keys).agg(*wide) if keys else long.agg(*wide)
