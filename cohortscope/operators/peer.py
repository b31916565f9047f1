"""Peer-group and employer statistics, z-scores, percentile ranks, target encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E
from cohortscope.operators.ordering import percent_ranks, running
from cohortscope.operators.preprocess import present
from cohortscope.operators.quantiles import exact_quantiles, same_keys, unpivot
from cohortscope.session import stage

C = F.col


def smoothed(n: Column, raw: Column, mean: Column, m: float = V.SMOOTHING_WEIGHT) -> Column:
    """M-estimate: a group's rate pulled toward the global mean with weight ``m``."""
    return (n * raw + F.lit(m) * mean) / (n + F.lit(m))


def training_rows(core: DataFrame) -> DataFrame:
    """Years statistics may be learned from (prunes partitions when split by year)."""
    return core.filter(C("tax_year").isin(V.TRAIN_YEARS))


def global_rate(train: DataFrame) -> DataFrame:
    """One row: the mean label."""
    return train.agg(F.avg("fraud_label").alias("global_mean"))


def group_rates(train: DataFrame) -> DataFrame:
    """Long table (dim, key, n, rate) of smoothed rates plus the global row.

    One aggregate to the (state, type, band, year) cells; the dimensions are then
    rolled up from those few cells.
    """
    dims = list(V.RATE_DIMS)
    cells = stage(train.groupBy(*dims).agg(
        F.count("fraud_label").alias("n"), F.count(F.lit(1)).alias("n_all"),
        F.sum("fraud_label").alias("s")), "rate-cells")
    mean = cells.agg(F.sum("s") / F.sum("n")).first()[0]
    parts = ", ".join(f"'{d}', cast(`{d}` as string)" for d in dims)
    long = (cells.select("n", "n_all", "s",
                         F.expr(f"stack({len(dims) + 1}, {parts}, 'global', 'all') as (dim, key)"))
            .filter("key is not null").groupBy("dim", "key")
            .agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"), F.sum("s").alias("s")))
    rate = F.when(C("dim") == "global", F.lit(mean)).otherwise(
        smoothed(C("n_all"), C("s") / C("n"), F.lit(mean)))
    return long.select("dim", "key", C("n_all").alias("n"), rate.alias("rate"))


def peer_moments(train: DataFrame, mean: float) -> DataFrame:
    """Per (income band, type, state): size, rates and mean/std per feature; one aggregate.

    Spreads undefined for one-member groups take the whole training spread (else 1).
    """
    feats = present(train, V.PEER_FEATURES)
    aggs = [F.count("fraud_label").alias("peer_group_size"),
            F.avg("fraud_label").alias("raw_peer_fraud_rate")]
    for f in feats:
        x = C(f).cast("double")
        aggs += [F.avg(x).alias(f"{f}_mean"), F.stddev_samp(x).alias(f"{f}_std")]
    base = train.groupBy(*V.PEER_KEYS).agg(*aggs)
    spread = train.agg(*[F.stddev_samp(C(f).cast("double")).alias(f) for f in feats]).first()
    out = base.withColumns({f"{f}_std": F.coalesce(
        C(f"{f}_std"), F.lit(spread[f] if spread[f] is not None else 1.0)) for f in feats})
    return out.withColumn("peer_fraud_rate", smoothed(
        C("peer_group_size"), C("raw_peer_fraud_rate"), F.lit(mean)))


def peer_stats(train: DataFrame, mean: float) -> DataFrame:
    """The moments of :func:`peer_moments` with the median and p95 of every feature."""
    q = exact_quantiles(train, V.PEER_KEYS, present(train, V.PEER_FEATURES),
                        {"median": 0.5, "p95": 0.95})
    return same_keys(peer_moments(train, mean), q, V.PEER_KEYS, "left")


def employer_stats(train: DataFrame, mean: float) -> DataFrame:
    """Per employer (NULL excluded): raw and smoothed rate, head-count."""
    return (train.filter(C("employer_id").isNotNull()).groupBy("employer_id")
            .agg(F.avg("fraud_label").alias("raw_employer_fraud_rate"),
                 F.count("fraud_label").alias("employer_n_employees"))
            .withColumn("employer_fraud_rate", smoothed(
                C("employer_n_employees"), C("raw_employer_fraud_rate"), F.lit(mean))))


def employer_distribution(employers: DataFrame) -> DataFrame:
    """One row: unweighted mean and spread of employer rates (spread floor -> 1)."""
    return employers.agg(
        F.avg("employer_fraud_rate").alias("mu"),
        F.stddev_samp("employer_fraud_rate").alias("sd")).select(
        "mu", F.when(C("sd") > V.EPS, C("sd")).otherwise(1.0).alias("sigma"))


def z_scores(df: DataFrame) -> DataFrame:
    """z columns and their summaries, given the peer mean/std columns on the row."""
    feats = [f for f in present(df, V.Z_FEATURES)
             if {f"{f}_mean", f"{f}_std"} <= set(df.columns)]
    std = {f: F.coalesce(F.when(C(f"{f}_std") != 0, C(f"{f}_std")), F.lit(1.0)) for f in feats}
    df = df.withColumns({f"z_{f}": E.clip((C(f) - C(f"{f}_mean")) / std[f], -5, 5)
                         for f in feats})
    if not feats:
        return df
    zs = [C(f"z_{f}") for f in feats]
    mags = [F.abs(z) for z in zs]
    n = sum((E.flag(z.isNotNull()) for z in zs), F.lit(0))
    weights = {f: w for f, w in V.Z_WEIGHTS.items() if f in feats}
    out = {
        "n_z_above_2": sum((E.flag(m > 2) for m in mags), F.lit(0)),
        "n_z_above_3": sum((E.flag(m > 3) for m in mags), F.lit(0)),
        "max_z_score": F.greatest(*mags) if len(mags) > 1 else mags[0],
        "mean_abs_z": F.when(n > 0, sum((E.nz(m) for m in mags), F.lit(0.0)) / n),
    }
    comp = sum((E.nz(f"z_{f}") * w for f, w in weights.items()), F.lit(0.0))
    out["composite_z_score"] = E.clip(comp / max(sum(weights.values()), V.EPS), -5, 5)
    return df.withColumns(out)


def encode_rates(df: DataFrame, rates: DataFrame, mean: float) -> DataFrame:
    """Smoothed group rates as columns; unseen keys take the global mean."""
    for dim, name in V.RATE_DIMS.items():
        one = rates.filter(C("dim") == dim).select(
            C("key").cast("int" if dim == "tax_year" else "string").alias(dim),
            C("rate").alias(name))
        df = df.join(one, dim, "left").withColumn(name, F.coalesce(C(name), F.lit(mean)))
    return df.withColumn("peer_fraud_rate", F.coalesce(C("peer_fraud_rate"), F.lit(mean)))


def peer_scores(core: DataFrame, stats: DataFrame, rates: DataFrame, mean: float,
                row_id: str = "row_id", ranked: list[str] | None = None) -> DataFrame:
    """Phase 4: ranks inside (year, peer group), z-scores, target encoding.

    Statistics and rates are small staged tables that meet the rows where they are; only
    ranks (of the ``ranked`` columns, all by default) take narrow rows through a shuffle and
    need ``row_id``.
    """
    owned = ([f"z_{f}" for f in V.Z_FEATURES] + [f"pct_{f}" for f in V.RANKED]
             + ["n_z_above_2", "n_z_above_3", "max_z_score", "mean_abs_z", "composite_z_score",
                "peer_group_size", "raw_peer_fraud_rate", "peer_fraud_rate"]
             + list(V.RATE_DIMS.values()))
    core = core.drop(*owned)
    ranked = present(core, V.RANKED if ranked is None else ranked)
    needed = [f"{f}_{s}" for f in V.Z_FEATURES for s in ("mean", "std")]
    keep = [c for c in V.PEER_KEYS + ["peer_group_size", "raw_peer_fraud_rate",
                                      "peer_fraud_rate"] + needed if c in stats.columns]
    df = core.drop(*needed).join(stats.select(*keep), V.PEER_KEYS, "left")
    df = encode_rates(z_scores(df), rates, mean)
    if ranked:
        pct = percent_ranks(core, ["tax_year"] + V.PEER_KEYS, ranked, row_id)
        df = df.join(pct.select(row_id, *[f"pct_{f}" for f in ranked]), row_id)
    return df.select(*core.columns, *[c for c in owned if c in df.columns])


def fit_statistics(core: DataFrame) -> dict:
    """All learned tables of the training years, staged; ``mean`` is a plain number."""
    train = training_rows(core)
    rates = stage(group_rates(train), "group-rates")
    mean = rates.filter("dim = 'global'").select("rate").first()[0]
    out = {"rates": rates, "mean": mean,
           "peers": stage(peer_stats(train, mean), "peer-stats")}
    if "employer_id" in core.columns:
        out["employers"] = stage(employer_stats(train, mean), "employer-stats")
    return out


# ------------------------------------------------------- ranks of arriving rows
def rank_breakpoints(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Stored once: per group and feature, every value with its count, as (*keys, f, v, n)."""
    return unpivot(df, keys, cols).groupBy(*keys, "f", "v").agg(F.count(F.lit(1)).alias("n"))


def ranks_of_arriving(new: DataFrame, points: DataFrame, keys: list[str], cols: list[str],
                      row_id: str, prefix: str = "pct_") -> DataFrame:
    """Percentile ranks of rows that arrive later, among the stored ones.

    A stored value has the rank that it has among the stored rows; another falls half-way
    between its neighbours'; below or above all of them it goes towards 0 or 100; unknown
    values, and groups that nobody has stored, rank 50.  Both sides meet in value buckets:
    no join by range, no group in one task.
    """
    group = [*keys, "f"]
    rows = unpivot(new.select(row_id, *keys, *cols), [row_id, *keys], cols)
    asked = rows.select(*group, "v").distinct().withColumn("n", F.lit(0).cast("long"))
    counts = points.unionByName(asked).groupBy(*group, "v").agg(F.sum("n").alias("n"))
    sizes = points.groupBy(*group).agg(F.sum("n").alias("size"))
    swept = running(counts, group, "v", {"upto": ("sum", "n")})
    ranked = same_keys(swept, sizes, group, "inner").select(*group, "v", F.when(
        C("n") > 0, (C("upto") - C("n") + 1 + C("upto")) / 2.0 / C("size") * 100).otherwise(
        (C("upto") + 0.5) / C("size") * 100).alias("pct"))
    ranked = ranked.withColumn("pct", F.least("pct", F.lit(100.0)))
    wide = same_keys(rows, ranked, [*group, "v"], "left").groupBy(row_id).agg(
        *[F.max(F.when(C("f") == i, C("pct"))).alias(prefix + c) for i, c in enumerate(cols)])
    return new.select(row_id, *keys, *cols).join(wide, row_id, "left").withColumns(
        {prefix + c: F.coalesce(C(prefix + c), F.lit(50.0)) for c in cols})
