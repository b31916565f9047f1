"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three, words
bounded by blanks).  A document's own list is compared to each profile: every n-gram adds
how far out of place it is, a missing one the length of a profile.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0, as is every
text when no row can be learned from; texts are used whole; ties go to the first language
by code point; a NULL doc_id counts as the empty text for the fold; repeated rows get equal
predictions; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.common import table

LENGTH = 300                # n-grams of a profile
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
FLUSH = 4_000_000           # n-grams counted together when learning


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """All letter n-grams of a text as numbers: three code points of 21 bits each."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, codes, 32)
    codes = np.r_[32, codes[letter | np.r_[True, letter[:-1]]], 32].astype(np.uint64)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    two = codes[:-1] | codes[1:] << np.uint64(21)
    three = two[:-1] | codes[2:] << np.uint64(42)
    return np.concatenate([codes[codes != 32], two, three])


def top(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    if len(keys) > length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:length]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted():
        for lang, parts in waiting.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)),
                 pa.array(n)], ["lang", "gram", "n"])

    waiting, held = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = grams(text.as_py())
            waiting.setdefault(lang, []).append(found)
            held += len(found)
            if held >= FLUSH:
                yield from counted()
                waiting, held = {}, 0
    yield from counted()


def learn(rows: DataFrame, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Profiles from all rows (``lang``, ``text``): ``length`` n-grams a language.

    Counts combine in the tasks and again before the exchange; the driver receives the
    profiles only.
    """
    counts = (rows.filter(F.col("lang").isNotNull()).select("lang", "text")
              .mapInArrow(_count, "lang string, gram bigint, n bigint")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).filter(F.col("place") <= length)
    out: dict[str, list] = {}
    for r in best.select("lang", "place", "gram").orderBy("lang", "place").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


class Profiles:
    """Profiles as one sorted list of n-grams with a row of places each."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int = LENGTH):
        self.langs, self.length = sorted(profiles), length
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.uint64)]))
        self.places = np.full((len(self.keys), len(self.langs)), -1)
        for col, lang in enumerate(self.langs):
            at = np.searchsorted(self.keys, profiles[lang])
            self.places[at, col] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        own = top(*np.unique(found, return_counts=True), self.length)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        places = np.where((self.keys[at] == own)[:, None], self.places[at], -1)
        out = np.abs(places - np.arange(len(own))[:, None])
        distance = np.where(places < 0, self.length, out).sum(0)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.length * len(own)))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Language and score of every document (``doc_id``, ``held_out``, ``text``)."""
    def run(batches):
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return predict(docs, Profiles(learn(docs.filter("NOT held_out"))))


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
