"""Fixed-length yearly sequences per person, their scaling, and back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscope import vocab as V
from cohortscope.functions import exprs as E

C = F.col


def build_sequences(df: DataFrame, features: list[str] | None = None,
                    min_years: int = 3, length: int = V.SEQUENCE_LENGTH) -> DataFrame:
    """One row per person with at least ``min_years`` rows: the first ``length`` steps by
    year, zero-padded.

    Any year counts, and all rows count toward the minimum.  Taking the first rows by rank
    lets Spark cut every person to ``length`` rows in each task before the shuffle, so a
    person's state is bounded however many rows there are.
    """
    feats = [f for f in (features or V.SEQUENCE_FEATURES) if f in df.columns]
    statics = [s for s in V.SEQUENCE_STATICS if s in df.columns]
    values = F.array(*[E.nz(C(f).cast("double")) for f in feats]).alias("x")
    step = F.struct(C("tax_year").alias("y"), values,
                    *[C(s).alias(f"s_{s}") for s in statics])
    by_year = Window.partitionBy("person_id").orderBy("step")
    first = (df.select("person_id", step.alias("step"))
             .withColumn("rank", F.row_number().over(by_year)).filter(C("rank") <= length)
             .groupBy("person_id").agg(F.array_sort(F.collect_list("step")).alias("steps")))
    counts = df.groupBy("person_id").agg(F.count(F.lit(1)).cast("int").alias("n_years"))
    g = first.join(counts.filter(C("n_years") >= min_years), "person_id")
    zero = F.array(*[F.lit(0.0) for _ in feats])
    pad = F.array_repeat(zero, F.lit(length) - F.size("steps"))
    seq = F.slice(F.concat(F.transform("steps", lambda s: s["x"]), pad), 1, length)
    return g.select("person_id", "n_years", seq.alias("sequence"),
                    *[F.get(C("steps"), F.lit(0))[f"s_{s}"].alias(s) for s in statics])


def flatten_sequences(seqs: DataFrame, features: list[str]) -> DataFrame:
    """Person-year rows again: step i is year 2019 + i."""
    keep = [c for c in seqs.columns if c != "sequence"]
    d = seqs.select(*keep, F.posexplode("sequence").alias("pos", "x"))
    return d.select(*keep, (C("pos") + V.YEARS[0]).alias("tax_year"),
                    *[F.get(C("x"), F.lit(i)).alias(f) for i, f in enumerate(features)])


def fit_range(seqs: DataFrame, n: int) -> list[tuple[float, float]]:
    """(min, max) of every feature over all persons and steps: one aggregate row."""
    d = seqs.select(F.explode("sequence").alias("x"))
    row = d.agg(*[f(F.get(C("x"), F.lit(i))).alias(f"{p}{i}") for i in range(n)
                  for f, p in ((F.min, "a"), (F.max, "b"))]).first()
    return [(row[f"a{i}"], row[f"b{i}"]) for i in range(n)]


def _span(lo, hi):
    return F.lit((hi - lo) if hi != lo else 1.0)


def normalise(seqs: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """Min-max scaling per feature; an empty range divides by 1."""
    scaled = F.transform("sequence", lambda s: F.array(
        *[(F.get(s, F.lit(i)) - F.lit(lo)) / _span(lo, hi)
          for i, (lo, hi) in enumerate(ranges)]))
    return seqs.withColumn("sequence", scaled)


def denormalise(seqs: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    back = F.transform("sequence", lambda s: F.array(
        *[F.get(s, F.lit(i)) * _span(lo, hi) + F.lit(lo) for i, (lo, hi) in enumerate(ranges)]))
    return seqs.withColumn("sequence", back)
