"""Ordering without one-task groups: prefix sums, ranks, hash-ordered picks.

A group may hold a third of all rows, so no window here runs over a whole group of
rows.  Rows fall into order-preserving buckets; bucket totals (bounded, combined
map-side) give each bucket's offset, and the window runs inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope.functions import exprs as E
from cohortscope.operators.quantiles import same_keys, unpivot
from cohortscope.session import stage

HEX = 4          # digest prefix: 65 536 buckets per stratum
FINE = 4096      # linear splits of a value bucket


# ----------------------------------------------------------------- prefix sums
def prefix_sums(values: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Add ``{s}_before``: the sum of ``s`` over smaller values of the same group.

    ``values`` holds one row per (keys, value), as an aggregate by value gives.
    """
    v = F.col(value)
    coarse = values.withColumn("__b", E.value_bucket(v))
    cell = keys + ["__b"]
    span = coarse.groupBy(*cell).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    fine = same_keys(coarse, span, cell, "inner").withColumn(
        "__c", E.linear_split(v, F.col("__lo"), F.col("__hi"), FINE)).drop("__lo", "__hi")
    cell = cell + ["__c"]
    totals = fine.groupBy(*cell).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b", "__c").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*cell, *[(F.sum(f"__t_{s}").over(order) - F.col(f"__t_{s}"))
                                     .alias(f"__o_{s}") for s in sums])
    inside = Window.partitionBy(*cell).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = same_keys(fine, offsets, cell, "inner")
    for s in sums:
        out = out.withColumn(f"{s}_before",
                             F.sum(s).over(inside) - F.col(s) + F.col(f"__o_{s}"))
    return out.drop("__b", "__c", *[f"__o_{s}" for s in sums])


_COMBINE = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
            "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(values: DataFrame, keys: list[str], value: str, aggs: dict[str, tuple[str, str]],
            descending: bool = False) -> DataFrame:
    """Add running aggregates over the values of a group up to each row's, its own included.

    ``aggs`` names, per new column, ``sum``, ``min`` or ``max`` and the column it runs over.
    ``values`` holds one row per (keys, value); windows run inside one bucket, and over one
    row per bucket.
    """
    v = F.col(value)
    coarse = values.withColumn("__b", E.value_bucket(v))
    cell = keys + ["__b"]
    span = coarse.groupBy(*cell).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    fine = same_keys(coarse, span, cell, "inner").withColumn(
        "__c", E.linear_split(v, F.col("__lo"), F.col("__hi"), FINE)).drop("__lo", "__hi")
    cell = cell + ["__c"]
    turn = F.desc if descending else F.asc
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(turn("__b"), turn("__c"))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*cell).orderBy(turn(value)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = fine.groupBy(*cell).agg(*[_COMBINE[f][0](c).alias(f"__t_{n}")
                                       for n, (f, c) in aggs.items()])
    offsets = totals.select(*cell, *[_COMBINE[f][0](f"__t_{n}").over(before).alias(f"__o_{n}")
                                     for n, (f, _) in aggs.items()])
    out = same_keys(fine, offsets, cell, "inner")
    for n, (f, c) in aggs.items():
        fold, both = _COMBINE[f]
        out = out.withColumn(n, both(fold(c).over(inside), F.col(f"__o_{n}")))
    return out.drop("__b", "__c", *[f"__o_{n}" for n in aggs])


# ------------------------------------------------------------- percentile ranks
def percent_ranks(df: DataFrame, keys: list[str], cols: list[str], row_id: str,
                  prefix: str = "pct_") -> DataFrame:
    """``{prefix}{col}``: 100 x average rank / known count in the group; unknown -> 50.

    Returns ``row_id``, keys, columns and ranks: rank narrow rows and join the result
    back by id, so that wide rows are never sorted once per column.  Ranks come from counts
    per distinct value, which combine map-side, for groups of any size; NaN counts as NULL.
    ``row_id`` must be a stored unique id (a staged table's), so that a retried task sees
    the same ids.  Groups and counts are staged.
    """
    narrow = df.select(row_id, *keys, *cols)
    # groups go by number: every row moves once per column, and keys may be long
    groups = stage(narrow.select(*keys).distinct().withColumn(
        "__g", F.monotonically_increasing_id()), "rank-groups")
    rows = unpivot(same_keys(narrow, groups, keys, "inner"), [row_id, "__g"], cols)
    group = ["__g", "f"]
    counts = stage(rows.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n")), "rank-counts")
    sizes = counts.groupBy(*group).agg(F.sum("n").alias("size"))
    ranked = same_keys(prefix_sums(counts, group, "v", ["n"]), sizes, group, "inner")
    ranked = ranked.select(*group, "v", (
        (F.col("n_before") + 1 + F.col("n_before") + F.col("n")) / 2.0
        / F.col("size") * 100).alias("pct"))
    wide = same_keys(rows, ranked, group + ["v"], "inner").groupBy(row_id).agg(
        *[F.max(F.when(F.col("f") == i, F.col("pct"))).alias(prefix + c)
          for i, c in enumerate(cols)])
    return narrow.join(wide, row_id, "left").withColumns(
        {prefix + c: F.coalesce(F.col(prefix + c), F.lit(50.0)) for c in cols})


# ------------------------------------------------------------ hash-ordered picks
def _hashed(df: DataFrame, seed, ids: list[str], weight: Column | None) -> DataFrame:
    digest = E.draw_key(seed, *ids)
    df = df.withColumn("__h", digest)
    return (df.withColumn("__b", F.conv(F.substring("__h", 1, HEX), 16, 10).cast("int"))
            .withColumn("__w", F.lit(1).cast("long") if weight is None else weight.cast("long")))


def _bucket_offsets(h: DataFrame, strata: list[str]) -> DataFrame:
    totals = h.groupBy(*strata, "__b").agg(F.sum("__w").alias("__t"))
    order = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return totals.withColumn("__o", F.sum("__t").over(order) - F.col("__t"))


def pick_by_hash(df: DataFrame, strata: list[str], ids: list[str], seed,
                 budgets: DataFrame, budget: str = "n_take",
                 weight: Column | None = None) -> DataFrame:
    """Rows whose preceding weight in hash order is below their stratum's budget.

    With weight 1 this draws exactly ``budget`` rows without replacement.  Whole
    buckets below the cut are kept by a filter; only the one bucket per stratum that
    the cut falls into is ordered.
    """
    h = _hashed(df, seed, ids, weight)
    offs = _bucket_offsets(h, strata)
    if strata:
        offs = same_keys(offs, budgets.select(*strata, F.col(budget).alias("__n")), strata,
                         "inner")
    else:
        offs = offs.withColumn("__n", F.lit(budgets.select(budget).first()[0]))
    cut = (offs.filter(F.col("__o") < F.col("__n")).groupBy(*strata)
           .agg(F.max("__b").alias("__cut"), F.max("__o").alias("__off"),
                F.max("__n").alias("__need")))
    if strata:   # staged, so its real size decides whether it is broadcast
        h = same_keys(h, stage(cut, "pick-cut"), strata, "inner")
    else:        # one row: literals, and the filter reaches the scan side of the hash
        one = cut.first()
        h = h.withColumns({"__cut": F.lit(one["__cut"]).cast("int"),
                           "__off": F.lit(one["__off"]).cast("long"),
                           "__need": F.lit(one["__need"]).cast("long")})
    below = h.filter(F.col("__b") < F.col("__cut"))
    edge = h.filter(F.col("__b") == F.col("__cut"))
    order = Window.partitionBy(*strata, "__b").orderBy("__h", *ids).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    edge = (edge.withColumn("__before", F.sum("__w").over(order) - F.col("__w"))
            .filter(F.col("__off") + F.col("__before") < F.col("__need")).drop("__before"))
    return below.unionByName(edge).drop("__h", "__b", "__w", "__cut", "__off", "__need")


def number_by_hash(df: DataFrame, strata: list[str], ids: list[str], seed,
                   name: str = "position") -> DataFrame:
    """0-based position of every row in hash order within its stratum."""
    h = _hashed(df, seed, ids, None)
    offs = _bucket_offsets(h, strata).select(*strata, "__b", "__o")
    order = Window.partitionBy(*strata, "__b").orderBy("__h", *ids)
    h = same_keys(h, offs, strata + ["__b"], "inner")
    return (h.withColumn(name, F.row_number().over(order) - 1 + F.col("__o"))
            .drop("__h", "__b", "__w", "__o"))


def draw_with_replacement(df: DataFrame, ids: list[str], seed, n: int, size: int) -> DataFrame:
    """``n`` rows drawn with replacement from the ``size`` rows of ``df``.

    Draw ``i`` picks position ``floor(d_i * size / 2^52)`` of the hash order, ``d_i`` being
    52 bits of a digest.
    """
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("position", E.digest_position(
        E.draw_key(f"{seed}-draw", "draw"), F.lit(size)))
    numbered = number_by_hash(df, [], ids, seed)
    return draws.join(numbered, "position").drop("position")


def shuffle_rows(df: DataFrame, ids: list[str], seed) -> DataFrame:
    """Rows in a fixed pseudo-random order (a range-partitioned sort on a digest)."""
    return df.orderBy(E.draw_key(seed, *ids), *ids)
