"""Mixing sources to target weights.

Words are summed per source; targets share the total by weight, none above ``MOST`` times
its source; each document is emitted floor(rate) times, plus once more where a number drawn
by hash from the seed, the id and the text is below the remaining fraction.  Reruns agree.

Defined cases: NULL texts have size 0 and are taken 0 words; a source of size 0 has target
0; the NULL source comes last; repeated rows draw the same number; an empty table gives an
empty result; other columns are kept by ``mix`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.common import SPACE, settle, table, whole_row

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", 0).otherwise(
        F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def draw(seed: str, *cols: Column) -> Column:
    """Uniform number in [0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *cols))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def targets(sizes: DataFrame) -> DataFrame:
    """Target of every source, from one row per source (``source``, ``source_size``).

    Resharing the excess of capped sources until none is above its cap ends at the largest
    of the levels (total - caps so far) / (weights left), sources taken by cap per weight:
    the level rises while sources are capped and falls afterwards.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), place)
    rows = (sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
            .withColumn("ratio", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / left
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least(
        F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, and the whole row as ``row``.

    The given row travels as one struct, so that no column of it meets a name used here.
    Only the table of targets, one row per source, meets all documents; it is written
    first, so that Spark knows its size and joins it by that.
    """
    sized = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"),
                        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"),
                        whole_row(docs))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = settle(targets(sums), "mix-targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest"))
    return (sized.join(aims, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("rate", rate).select(
                "doc_id", "size", "source_size", "target", (
                    F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
                ).cast("long").alias("copies"), "row"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as many times as it is taken."""
    out = plan(docs, seed).select("row", F.explode(F.expr(
        "IF(copies > 0, sequence(1L, copies), array())")).alias("copy"))
    return out.select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select("doc_id", "size", "source_size", "target",
                             (F.col("size") * F.col("copies")).alias("taken"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sums),
capped AS (SELECT *, {MOST} * source_size AS cap, {MOST} * source_size / weight AS ratio
           FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
aims AS (SELECT source, source_size,
                least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|'
                             || md5(body)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM rated
"""

QUERIES = {"op9_mixing": op9_mixing}
ORACLE = {"op9_mixing": SQL}
