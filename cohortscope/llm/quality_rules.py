"""Quality rules: repetition by suffix array, and counts of words, symbols and lines.

Per text, a suffix array over its words with the lengths that neighbours share gives
common-prefix intervals; those whose occurrences differ on the left are the maximal repeated
substrings, of ``WINDOW`` words and more; the union of their spans and the longest of them are
limited.

Defined cases: NULL is an empty text, which has no words and fails; texts are used whole, and
one text's suffix array, about 100 bytes a word and 4 more for each doubling of its longest
repeat, has to fit a worker;
repeated rows get the same verdict, each its own row; an empty table gives an empty one;
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.common import WORD, table
from cohortscope.llm.suffixes import covered, maximal_repeats, suffix_array

MIN_WORDS = 10
WINDOW = 5                  # words of a window that counts as repeated
MAX_REPEAT_PERCENT = 20
REPEAT_WORDS = 20           # shortest repeated substring that the suffix rules look at
MAX_COVERED = 0.15          # of a text's words in such substrings
MAX_LONGEST = 0.10          # of a text's words in the longest of them
BATCH_WORDS = 300_000

SYMBOLS = "#*$%&|<>"
SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
          "n_dup_lines bigint, n_repeat_words bigint, covered_words bigint, "
          "longest_repeat bigint, base_failed boolean, kept boolean")
_WORDS = re.compile(WORD)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(lines) - len(set(lines))


def repetition(docs: list[list[str]]) -> np.ndarray:
    """Repeated-window words, covered words and longest repeat of each list of words."""
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.zeros((len(docs), 3), np.int64)
    n = int(sizes.sum())
    if not n:
        return out
    ids: dict[str, int] = {}
    tokens = np.fromiter((ids.setdefault(w, len(ids)) for d in docs for w in d), np.int64, n)
    owner = np.repeat(np.arange(len(docs)), sizes)
    # words in repeated windows are those of maximal repeats at least a window long
    order, common = suffix_array(tokens, owner)
    longest = maximal_repeats(tokens, owner, order, common, WINDOW)
    for col, least in enumerate((WINDOW, REPEAT_WORDS)):
        at = np.flatnonzero(longest >= least)
        out[:, col] = np.bincount(owner[covered(at, longest[at], n)], minlength=len(docs))
    np.maximum.at(out[:, 2], owner[order], common)      # of any length
    return out


def verdict(n_words, repetition_) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the number of words and the repetition of each text."""
    windows, inside, longest = repetition_.T
    failed = (n_words < MIN_WORDS) | (100 * windows > MAX_REPEAT_PERCENT * n_words)
    fine = (inside <= MAX_COVERED * n_words) & (
        (longest < REPEAT_WORDS) | (longest <= MAX_LONGEST * n_words))
    return failed, ~failed & fine


def _portions(batches: Iterator[pa.RecordBatch], at: int):
    """Rows of the batches, a bounded number of words at a time, with their words."""
    for batch in batches:
        words, first, held = [], 0, 0
        for i, text in enumerate(batch.column(at)):
            words.append(_WORDS.findall(text.as_py() or ""))
            held += len(words[-1])
            if held >= BATCH_WORDS or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), words
                words, first, held = [], i + 1, 0


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for rows, words in _portions(batches, 1):
        texts = [t or "" for t in rows.column(1).to_pylist()]
        n, rep = np.array([len(w) for w in words]), repetition(words)
        counts = [n, [sum(map(len, w)) for w in words],
                  [sum(map(t.count, SYMBOLS)) for t in texts], [*map(duplicate_lines, texts)]]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), *[pa.array(c, pa.int64()) for c in (*counts, *rep.T)],
             *[pa.array(v) for v in verdict(n, rep)]], names)


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts that the rules use and the verdict, one row per document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInArrow(_measure, SCHEMA)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text)

    def run(batches):
        for rows, words in _portions(batches, at):
            kept = verdict(np.array([len(w) for w in words]), repetition(words))[1]
            yield rows.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE: dict[str, str] = {}
