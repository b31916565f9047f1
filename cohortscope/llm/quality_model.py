"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a bounded sample of labelled documents come to the driver, where trees
of a fixed depth are grown on histograms of quantile bins.  The forest is flattened into
arrays; all trees of a batch of documents are walked together, level by level.

Defined cases: NULL is an empty text and is scored like any other; without rows to learn
from the score is 0.5; of repeated labels of a document the smallest counts; a NULL doc_id
counts as the empty text for the fold and is never learned from; texts are used whole;
repeated rows get equal scores; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.common import SPACE, WORD, table
from cohortscope.llm.language import fold

FOLDS, HELD_OUT = 4, 2
SAMPLE = 20_000             # labelled rows that the trees are grown on, at most
CUT = 0.7
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
MIN_HESSIAN, RIDGE = 3.0, 2.0
BATCH = 256

_WORDS = re.compile(WORD)
STATISTICS = ("log_chars", "log_words", "mean_word", "sd_word", "longest_word", "letters",
              "upper", "digits", "blanks", "symbols", "other_marks", "not_ascii", "distinct",
              "lines", "repeated_lines", "words_a_line", "ends_line", "ends_word", "capital",
              "all_capital", "with_mark", "with_digit", "short", "packed", "entropy",
              "inner_capital", "repeated_pairs", "top_word")
LOWER, UPPER, DIGIT, BLANK, SYMBOL, END, MARK = range(1, 8)


@cache
def _classes() -> np.ndarray:
    """Class of every code point; 0 for what belongs to none."""
    out = np.fromiter((UPPER if c.isupper() else LOWER if c.isalpha() else 0
                       for c in map(chr, range(0x110000))), np.int8, 0x110000)
    for kind, chars in ((DIGIT, "0123456789"), (BLANK, SPACE), (SYMBOL, "#*$%&|<>"),
                        (END, ".!?,;:"), (MARK, "\"'()+-/=@[\\]^_`{}~")):
        out[[ord(c) for c in chars]] = kind
    return out


def _one_of(kind: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
    out = kind == kinds[0]
    for k in kinds[1:]:
        out |= kind == k
    return out


def statistics(text: str | None) -> list[float]:
    """The document statistics, in the order of ``STATISTICS``.

    What concerns characters and words is counted over the array of code points, words
    being its runs without ASCII white space.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    blank = np.r_[True, kind == BLANK, True]
    starts = np.flatnonzero(blank[:-2] & ~blank[1:-1])
    ends = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
    n, size = max(1, len(starts)), max(1, len(codes))
    share = np.bincount(kind, minlength=8) / size
    lengths = ends - starts if len(starts) else np.zeros(1, np.int64)

    def inside(*kinds):
        """Per word, the number of its characters of the given classes."""
        return np.add.reduceat(_one_of(kind, kinds), starts, dtype=np.int64) if len(
            starts) else np.zeros(1, np.int64)

    upper, first = inside(UPPER), kind[starts] == UPPER
    marked = inside(SYMBOL, MARK)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    seen = Counter(words := _WORDS.findall(text))
    frequent = np.bincount(np.frombuffer(raw, np.uint8), minlength=1)
    parts = frequent[frequent > 0] / max(1, len(raw))
    return [
        np.log1p(len(text)), np.log1p(len(starts)), lengths.mean(), lengths.std(),
        lengths.max(), share[LOWER], share[UPPER], share[DIGIT], share[BLANK], share[SYMBOL],
        share[END] + share[MARK], (codes > 127).mean() if len(codes) else 0,
        len(seen) / n, np.log1p(k), 1 - len(set(lines)) / k, len(words) / k,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / k,
        (kind[ends - 1] == END).sum() / n, first.sum() / n,
        ((upper > 0) & (inside(LOWER) == 0)).sum() / n, (marked > 0).sum() / n,
        (inside(DIGIT) > 0).sum() / n, (lengths <= 3).mean(),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        -(parts * np.log2(parts)).sum() if len(raw) else 0,
        (upper[:len(first)] > first).sum() / n,
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        max(seen.values(), default=0) / n]


@dataclass
class Forest:
    """Complete trees of one depth, flattened: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray         # trees x inner nodes
    border: np.ndarray          # a value up to this goes left
    leaf: np.ndarray            # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of statistics."""
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        tree, row = np.arange(len(self.leaf)), np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0):
            right = x[row, self.feature[tree, node]] > self.border[tree, node]
            node = 2 * node + 1 + right
        value = self.start + self.leaf[tree, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-value))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost trees on log loss; every level takes its histograms from one count per feature."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature = np.zeros((trees, inner), np.int64)
    border = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Forest(feature[:0], border[:0], leaf[:0], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    value = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-value))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, wide = 2 ** level - 1, 2 ** level
            best = np.full(wide, 1e-9)
            for f, c in enumerate(cuts):
                at = (node - base) * BINS + bins[:, f]
                gs = np.bincount(at, g, wide * BINS).reshape(wide, BINS).cumsum(1)
                hs = np.bincount(at, h, wide * BINS).reshape(wide, BINS).cumsum(1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = (gl ** 2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE)
                        - ga ** 2 / (ha + RIDGE))
                gain[(hl < MIN_HESSIAN) | (ha - hl < MIN_HESSIAN)] = -1
                gain[:, len(c):] = -1
                cut = gain.argmax(1)
                value_of = gain[np.arange(wide), cut]
                for k in np.flatnonzero(value_of > best):
                    best[k] = value_of[k]
                    feature[t, base + k], border[t, base + k] = f, c[cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > border[t, node])
        node -= inner
        leaf[t] = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
        value += leaf[t, node]
    return Forest(feature, border, leaf, start)


def _batches(batches, size):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _measure(batches):
    for batch in _batches(batches, BATCH):
        rows = [statistics(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Grow the forest on at most ``sample`` labelled rows outside the held-out fold.

    The rows are those whose ids have the smallest digests: the same on every run.
    """
    picked = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .select("text", "quality").mapInArrow(_measure, "x array<double>, y int")
            .toArrow())
    if not rows.num_rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))                   # whatever order the tasks ended in
    return grow(x[order], y[order])


def score(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """Score and prediction of every document (``doc_id``, ``held_out``, ``text``)."""
    def run(batches):
        for batch in _batches(batches, BATCH):
            s = forest.score(np.array([statistics(t.as_py()) for t in batch.column(2)],
                                      float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s),
                 pa.array((s >= cut).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict[str, str] = {}
