"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only.

A fingerprint is the ascending array of the ``k`` smallest distinct hashes of a text's
word shingles.  Fingerprints merge across parts (``merge``) and estimate resemblance,
containment and the number of distinct shingles.

Defined cases: NULL and blank texts have the empty fingerprint; a text with fewer than
``width`` words is one shingle; two empty fingerprints resemble each other fully (1.0), an
empty and a filled one not at all (0.0); repeated rows have equal fingerprints; rows whose
id is NULL come before all others, rows of equal id are ordered by their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.common import SPACE, partitions, table

K = 128
WIDTH = 5
BUCKETS = 8                 # id ranges per partition: enough to even out partitions
LOWEST = -(2 ** 63)


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the words of ``text`` as an array column; [''] for a text without any."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    return df.withColumn(name, F.split(bare, r"[\x20\x09-\x0D]+"))


def sketch(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """The ``k`` smallest distinct hashes of the word shingles of an array of words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    # a word past the end is NULL, which the hash skips: a short text is one shingle
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j)
                                                        for j in range(width)]))
    lowest = F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)
    return F.when(F.get(words, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(lowest)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of the union of what two fingerprints were made from."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes in both."""
    low = merge(a, b, k)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    n = F.size(low)
    return F.when(n == 0, 1.0).otherwise(both / n)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") - float(LOWEST) + 1.0) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has too.

    Inclusion and exclusion over the estimated sizes: |A and B| is the resemblance times
    |A or B|.
    """
    union = distinct_shingles(merge(a, b, k), k)
    n = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(
        F.least(F.lit(1.0), resemblance(a, b, k) * union / n))


def as_text(a: Column) -> Column:
    """Hashes as hexadecimal digits, 16 each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _bucket(key: Column, cuts: list[int]) -> Column:
    """Number of cut points at or below ``key``, found in two steps of about sqrt(n) each."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    heads = F.array(*[F.lit(c) for c in cuts[::step]])
    tails = F.array(*[F.array(*[F.lit(c) for c in cuts[i:i + step]])
                      for i in range(0, len(cuts), step)])
    g = F.size(F.filter(heads, lambda c: c <= key))
    inner = F.size(F.filter(F.get(tails, g - 1), lambda c: c <= key))
    return F.when(g == 0, 0).otherwise((g - 1) * step + inner).cast("int")


def in_id_buckets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Deal rows out by ranges of the id, so that each row's successor is in its bucket.

    Adds ``_key``, ``_bucket`` and ``_guest``: the first row of the next bucket visits the
    one before it (``_guest`` 1), and the very first row ends the last bucket (2).  The
    driver sees one id per bucket.
    """
    n = BUCKETS * partitions(df.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    cuts = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)
                     ).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    keyed = df.withColumn("_key", key).withColumn("_bucket", _bucket(F.col("_key"), cuts))
    low = df.select(key.alias("_key")).groupBy(_bucket(F.col("_key"), cuts).alias("_bucket")).agg(
        F.min("_key").alias("first"))
    firsts = sorted((r["first"], r["_bucket"]) for r in low.collect())
    out = keyed.withColumn("_guest", F.lit(0))
    if not firsts:
        return out
    hosts = {f: firsts[i - 1][1] for i, (f, _) in enumerate(firsts)}    # first -> last
    host = F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv])[F.col("_key")]
    guests = (keyed.filter(F.col("_key").isin(list(hosts))).withColumn("_bucket", host)
              .withColumn("_guest", F.when(F.col("_key") == firsts[0][0], 2).otherwise(1)))
    return out.unionByName(guests)


def edited(text: Column, n: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the next text's first ones."""
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - q).cast("int")),
                    F.substring(following, F.lit(1), q))


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = WIDTH,
                          id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    One exchange of the texts, by ranges of the id; every document meets its successor in
    its own bucket.  Input columns other than the id and the text are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = in_id_buckets(rows, "doc_id", "text").repartition(
        partitions(docs.sparkSession), "_bucket")
    rows = with_words(rows, "text", "words").withColumn("print", sketch(F.col("words"), k, width))
    order = Window.partitionBy("_bucket").orderBy(F.col("_guest") == 2, "_key", "text")
    rows = (rows.drop("words")
            .withColumn("next_text", F.lead("text").over(order))
            .withColumn("next_print", F.lead("print").over(order))
            .filter(F.col("_guest") == 0)
            .withColumn("n_chars", F.length("text").cast("long")))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    rows = with_words(rows, "edited", "words").withColumn(
        "edited_print", sketch(F.col("words"), k, width))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "print", "edited_print", "next_print")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fingerprint_documents(table(spark, sf_dir, "documents"))
    return p.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print")).cast("double").alias("near_edited"),
        resemblance(F.col("print"), F.col("next_print")).cast("double").alias("near_next"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE: dict[str, str] = {}
