"""Overlap of two sets of intervals inside groups, without forming pairs.

What overlaps [s, e] is everything that starts by e, less what ended before s.  Both counts
are running sums over end points; the same sweep, with a running minimum and maximum, names
the earliest start and the latest end among the overlapping ones.  Intervals meet a table of
end points on (group, point), never on the group alone, so a group with a third of all rows
costs its end points, not its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.operators.ordering import running
from cohortscope.session import stage

C = F.col


def end_points(right: DataFrame, id_col: str, by: list[str], start: str, end: str,
               asked: DataFrame) -> DataFrame:
    """Per (group, point): how many intervals have started by it and ended before it, the
    latest end of those that started, the earliest start of those that have not ended."""
    s, e, name = C(start).cast("double"), C(end).cast("double"), C(id_col)
    valid = right.filter(s <= e)
    none = F.lit(None)
    first, last = F.struct(s.alias("at"), name.alias("id")), F.struct(e.alias("at"), name.alias("id"))
    sides = valid.select(*by, F.explode(F.array(
        F.struct(s.alias("point"), F.lit(1).alias("started"), F.lit(0).alias("ended"),
                 none.cast("struct<at:double,id:string>").alias("first"),
                 last.cast("struct<at:double,id:string>").alias("last")),
        F.struct(e.alias("point"), F.lit(0).alias("started"), F.lit(1).alias("ended"),
                 first.cast("struct<at:double,id:string>").alias("first"),
                 none.cast("struct<at:double,id:string>").alias("last")))).alias("x")
    ).select(*by, "x.*")
    points = sides.unionByName(asked, allowMissingColumns=True).groupBy(*by, "point").agg(
        F.sum(F.coalesce("started", F.lit(0))).alias("started"),
        F.sum(F.coalesce("ended", F.lit(0))).alias("ended"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    up = running(points, by, "point", {"n_started": ("sum", "started"), "n_ended": ("sum", "ended"),
                                       "latest": ("max", "last")})
    both = running(up, by, "point", {"earliest": ("min", "first")}, descending=True)
    return both.select(*by, "point", "n_started", (C("n_ended") - C("ended")).alias("n_gone"),
                       "latest", "earliest")


def count_overlaps(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str],
                   right_span: tuple[str, str], right_id: str) -> DataFrame:
    """``left`` with n_overlaps, and ids of the overlapping interval that starts earliest and
    of the one that ends latest (ties: smallest, greatest id).

    Ends belong to intervals.  Intervals that end before they start, or lack an end or a
    group, overlap nothing.  Group and end columns of ``left`` are kept as they are.
    """
    s, e = (C(c).cast("double") for c in left_span)
    fine = (s <= e) & F.lit(True)
    for c in by:
        fine = fine & C(c).isNotNull()
    rows = left.withColumns({"__s": F.when(fine, s), "__e": F.when(fine, e)})
    asked = rows.filter("__s IS NOT NULL").select(
        *by, F.explode(F.array("__s", "__e")).alias("point")).distinct()
    table = stage(end_points(right.dropna(subset=by), right_id, by, *right_span, asked), "end-points")
    at_start = table.select(*by, C("point").alias("__s"), "n_gone", "earliest")
    at_end = table.select(*by, C("point").alias("__e"), "n_started", "latest")
    out = rows.join(at_start, [*by, "__s"], "left").join(at_end, [*by, "__e"], "left")
    n = F.coalesce(C("n_started") - C("n_gone"), F.lit(0)).cast("long")
    return out.withColumns({
        "n_overlaps": n,
        "earliest_id": F.when(C("earliest.at") <= C("__e"), C("earliest.id")),
        "latest_id": F.when(C("latest.at") >= C("__s"), C("latest.id")),
    }).select(*left.columns, "n_overlaps", "earliest_id", "latest_id")
