"""Statistics that are stored and merged: partial moments, quantile and key-set sketches.

A load (a year, a batch) is reduced to one row per group and feature and appended to a table
of partials; the statistics of any set of loads follow from these rows alone, and a new load
never reads an old one.  Replacing a load replaces its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.operators.quantiles import unpivot
from cohortscope.session import stage

C = F.col
KLL_K = 400                 # accuracy: a rank is off by under 1 % of the rows, nearly always
THETA_LG = 16               # distinct keys up to 2^16 are counted exactly


# ------------------------------------------------------------ moments and quantiles
def partial_statistics(df: DataFrame, keys: list[str], feats: list[str],
                       label: str = "fraud_label") -> DataFrame:
    """Per group and feature: count, mean and squared deviations, a KLL sketch; per group,
    as feature NULL, count and sum of the label.  NULL and NaN values are left out."""
    name = F.get(F.array(*[F.lit(f) for f in feats]), C("f"))
    rows = unpivot(df, keys, feats)
    values = rows.groupBy(*keys, name.alias("feature")).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"),
        (F.var_pop("v") * F.count("v")).alias("m2"),
        F.kll_sketch_agg_double("v", F.lit(KLL_K)).alias("sketch"))
    labels = df.groupBy(*keys).agg(
        F.count(label).alias("n"), F.avg(C(label).cast("double")).alias("mean"),
        (F.var_pop(C(label).cast("double")) * F.count(label)).alias("m2"))
    return values.unionByName(labels.withColumn("feature", F.lit(None).cast("string")),
                              allowMissingColumns=True)


def store_load(partials: DataFrame, path: str, load) -> None:
    """Write the partials of one load as its partition; other loads keep their files."""
    (partials.withColumn("load", F.lit(load)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path))


def stored_loads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_statistics(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics per group and feature over all the given loads: n, mean, std, sketch.

    Moments are merged pair by pair (count, mean, squared deviations), which loses nothing to
    cancellation; a group has as many rows here as it has loads.
    """
    def join(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    part = F.struct(C("n").cast("double").alias("n"), "mean", "m2")
    merged = partials.filter("n > 0").groupBy(*keys, "feature").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.kll_merge_agg_double("sketch").alias("sketch"))
    total = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), join)
    out = merged.withColumn("t", total)
    return out.select(*keys, "feature", C("t.n").cast("long").alias("n"), C("t.mean").alias("mean"),
                      F.when(C("t.n") > 1, F.sqrt(C("t.m2") / (C("t.n") - 1))).alias("std"), "sketch")


def sketch_quantiles(stats: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles of merged statistics, as columns; NULL for the label's rows."""
    return stats.withColumns({n: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
                              for n, p in probs.items()}).drop("sketch")


def rank_errors(stats: DataFrame, df: DataFrame, keys: list[str], feats: list[str],
                probs: dict[str, float]) -> DataFrame:
    """How far, as a share of the group's rows, each sketched quantile's rank is off: the
    distance from the wanted share to the ranks that the value has among the rows."""
    name = F.get(F.array(*[F.lit(f) for f in feats]), C("f"))
    rows = unpivot(df, keys, feats).withColumn("feature", name)
    q = sketch_quantiles(stats.filter("feature IS NOT NULL"), probs)
    r = q.select(*[C(k).alias(f"__{k}") for k in keys], C("feature").alias("__f"), *probs)
    met = [C(k).eqNullSafe(C(f"__{k}")) for k in keys] + [C("feature") == C("__f")]
    counts = rows.join(r, met).groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((C("v") < C(n)).cast("long")).alias(f"{n}_below") for n in probs],
        *[F.sum((C("v") <= C(n)).cast("long")).alias(f"{n}_upto") for n in probs])
    return counts.select(*keys, "feature", "n", *[
        F.greatest(F.lit(0.0), C(f"{n}_below") / C("n") - p, p - C(f"{n}_upto") / C("n"))
        .alias(n) for n, p in probs.items()])


# ------------------------------------------------------------------------- key sets
def key_sketches(df: DataFrame, by: str, key: str, lg: int = THETA_LG) -> DataFrame:
    """One theta sketch of the distinct keys per value of ``by``: (name, sketch)."""
    return df.groupBy(C(by).cast("string").alias("name")).agg(
        F.theta_sketch_agg(C(key), F.lit(lg)).alias("sketch"))


def exact_overlaps(df: DataFrame, by: str, key: str, lg: int = THETA_LG) -> DataFrame:
    """The counts of :func:`sketch_overlaps`, exact for sets of any size.

    Keys are dealt by hash to bins of about a quarter of 2^lg keys, counted over all sets, so
    that no sketch of a bin leaves its exact range; a set's counts are sums over the bins.
    """
    keys = df.select(C(by).cast("string").alias("name"), C(key).alias("key")).filter(
        "name IS NOT NULL AND key IS NOT NULL")
    about = keys.agg(F.approx_count_distinct("key")).first()[0]
    bins = 1 + int(about * 1.25) // 2 ** (lg - 2)
    cells = keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), "name").agg(
        F.theta_sketch_agg("key", F.lit(lg)).alias("sketch"))
    cells = stage(cells, "key-sketches")
    sizes = cells.groupBy("name").agg(F.sum(F.theta_sketch_estimate("sketch")).alias("n"))
    shared = cells.alias("a").join(cells.alias("b"), (C("a.bin") == C("b.bin"))
                                   & (C("a.name") < C("b.name"))).groupBy(
        C("a.name").alias("set_a"), C("b.name").alias("set_b")).agg(F.sum(
            F.theta_sketch_estimate(F.theta_intersection("a.sketch", "b.sketch"))).alias("n_both"))
    a = sizes.select(C("name").alias("set_a"), C("n").alias("n_a"))
    b = sizes.select(C("name").alias("set_b"), C("n").alias("n_b"))
    out = a.join(b, C("set_a") < C("set_b")).join(shared, ["set_a", "set_b"], "left")
    both = F.coalesce("n_both", F.lit(0))
    return out.select("set_a", "set_b", "n_a", "n_b", both.alias("n_both"),
                      (C("n_a") - both).alias("n_only_a"),
                      (C("n_a") + C("n_b") - both).alias("n_union"))


def sketch_overlaps(sketches: DataFrame, lg: int = THETA_LG) -> DataFrame:
    """Sizes of every two sets, of what they share and of their union, from their sketches.

    There is one row per set, a handful; they are paired with each other as one array.
    Estimates are exact while sets are below 2^lg keys, and off by about 2^-(lg/2) above.
    """
    held = sketches.groupBy().agg(F.sort_array(F.collect_list(F.struct("name", "sketch"))).alias("s"))
    first = held.select("s", F.explode("s").alias("a"))
    pairs = first.select("a", F.explode(F.filter("s", lambda x: x["name"] > C("a.name"))).alias("b"))
    a, b = C("a.sketch"), C("b.sketch")
    return pairs.select(
        C("a.name").alias("set_a"), C("b.name").alias("set_b"),
        F.theta_sketch_estimate(a).alias("n_a"), F.theta_sketch_estimate(b).alias("n_b"),
        F.theta_sketch_estimate(F.theta_intersection(a, b)).alias("n_both"),
        F.theta_sketch_estimate(F.theta_difference(a, b)).alias("n_only_a"),
        F.theta_sketch_estimate(F.theta_union(a, b, F.lit(lg))).alias("n_union"))
