"""Hard-negative mining by exact scores from a residue number system.

Vectors become integers.  A block of anchors and a chunk of rows are multiplied modulo
several small primes, each product in float32: residues are balanced and columns are added
in panels so short that no sum leaves the whole numbers that float32 holds.  Chinese
remaindering in balanced mixed radix then gives the signed scores, as many primes as twice
the largest possible score (a product of norms) asks for.  Windows over the best of every
task select positives, and, in a second pass that knows the positives' scores, negatives.

Rows are packed into chunks and anchors into blocks, once; every block meets every chunk, a
stated set of queries against all rows.  No task holds more than a block, a chunk and the best
few per anchor, whatever rows share a label or a vector; Spark sends the blocks along by
itself where their table is small and otherwise pairs partitions of files, without a shuffle.
The work is anchors times rows, as a search against all rows has to be.

Defined cases: rows with a NULL id, label or vector, or with any NULL or non-finite component,
take no part, nor do rows whose squared norm is 2^60 or more, as their scores may not fit a
long; an empty vector scores 0, and of vectors of different length the common components
count; rows are told apart by id, so rows with an anchor's own id are not its partners, and
repeated rows are each a row, as anchor and as partner; ties go to the smaller id; anchors
without positives, and positives without negatives in range, give no rows; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscope.llm.common import forget, settle, table

SCALE = 256.0
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100             # a negative's score in percent of its positive's
CHUNK_VALUES = 1 << 20          # components of a chunk: 16 384 rows of 64
BLOCK_VALUES = 1 << 18          # components of a block of anchors
TILE = 1 << 21                  # scores that are worked on at once
LIMIT = 1 << 60                 # squared norms stay below
HELD = 1 << 20                  # best rows a task keeps before it passes them on
FLOAT32_WHOLE = 1 << 24
PRIMES = [p for p in range(1021, 500, -2) if all(p % q for q in range(3, isqrt(p) + 1, 2))]


# ------------------------------------------------------------------- exact scores
def n_primes(bound: int) -> int:
    """How many primes tell all whole numbers from -bound to bound apart."""
    n, product = 0, 1
    while product <= 2 * bound:
        product *= PRIMES[n]
        n += 1
    return max(n, 1)


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues, as float32."""
    r = np.mod(values.astype(np.int64), p)
    r[r > p // 2] -= p
    return r.astype(np.float32)


def _balance(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers in float32 to balanced residues.  The quotient may be one off where it
    is near a half; the comparisons put that right."""
    q = x * np.float32(1 / p)
    np.rint(q, out=q)
    q *= np.float32(p)
    x -= q
    x[x > p // 2] -= p
    x[x < -(p // 2)] += p
    return x


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues of the inner products of all rows of ``a`` with all of ``b``."""
    panel = (FLOAT32_WHOLE - 1) // (p // 2) ** 2
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], panel):
        part = _balance(a[:, at:at + panel] @ b[:, at:at + panel].T, p)
        out = part if at == 0 else _balance(out + part, p)
    return out


def remainder(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers that have these balanced residues, as longs."""
    out, radix = parts[0].astype(np.int64), primes[0]
    for x, p in zip(parts[1:], primes[1:]):
        digit = np.mod((x.astype(np.int64) - out) % p * pow(radix, -1, p), p)
        digit[digit > p // 2] -= p
        # the radix may pass 2^63; the number itself does not, so wrapping is harmless
        wrapped = np.uint64(radix % (1 << 64))
        out = (out.view(np.uint64) + digit.view(np.uint64) * wrapped).view(np.int64)
        radix *= p
    return out


class Matrix:
    """Whole vectors with ids, labels and, as needed, residues."""

    def __init__(self, ids, labels, values, norm):
        self.ids = np.frombuffer(ids, np.int64)
        self.labels = np.frombuffer(labels, np.int64)
        width, n = len(values), len(self.ids)
        self.values = _unpacked(values, n) if width else np.zeros((n, 0), np.int64)
        self.norm, self._residues = norm, {}

    def residues(self, p: int) -> np.ndarray:
        if p not in self._residues:
            self._residues[p] = residues(self.values, p)
        return self._residues[p]


def scores(a: Matrix, rows_a: slice, b: Matrix, rows_b: slice) -> np.ndarray:
    """Exact inner products of some rows of both."""
    primes = PRIMES[:n_primes(isqrt(a.norm * b.norm) + 1)]
    d = min(a.values.shape[1], b.values.shape[1])
    return remainder([product_modulo(a.residues(p)[rows_a, :d], b.residues(p)[rows_b, :d], p)
                      for p in primes], primes)


# ------------------------------------------------------------------------ packing
def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need; the first byte says how many."""
    top = int(np.abs(values).max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(n, -1 if n else 0)


PACKED = "ids binary, labels binary, packed binary, norm bigint"


def _chunk(parts) -> pa.RecordBatch:
    """One row of all vectors, by label and id, shorter vectors filled with 0."""
    ids, labels, norms = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
    width = max(p[2].shape[1] for p in parts)
    values = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
    order = np.lexsort((ids, labels))
    return pa.RecordBatch.from_arrays(
        [pa.array([x], k) for x, k in [
            (ids[order].tobytes(), pa.binary()), (labels[order].tobytes(), pa.binary()),
            (_packed(values[order]), pa.binary()), (int(norms.max()), pa.int64())]],
        ["ids", "labels", "packed", "norm"])


def _whole(batch: pa.RecordBatch, scale: float):
    """(ids, labels, whole vectors, squared norms) of the rows that take part."""
    vectors = batch.column(2)
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)   # NULL is NaN
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(scale * flat)
        square = np.where(np.isfinite(flat), flat * flat, np.inf)
    out = np.zeros((len(size), int(size.max(initial=0))))
    filled = np.arange(out.shape[1]) < size[:, None]
    squares = out.copy()
    out[filled], squares[filled] = flat, square
    norm = squares.sum(axis=1)
    fit = norm < LIMIT
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False)[fit].astype(np.int64) for i in (0, 1))
    values = out[fit].astype(np.int64)
    return ids, labels, values, (values * values).sum(axis=1)


def pack(rows: DataFrame, values: int, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, vector) rows as few rows of about ``values`` components each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            part = _whole(batch, scale)
            step = max(1, values // max(1, part[2].shape[1]))
            for at in range(0, len(part[0]), step):
                held.append(tuple(x[at:at + step] for x in part))
                size += max(held[-1][2].size, len(held[-1][0]))
                if size >= values:
                    yield _chunk(held)
                    held, size = [], 0
        if held:
            yield _chunk(held)

    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                       F.col("vector").cast("array<double>")).mapInArrow(run, PACKED)


# ---------------------------------------------------------------------- selection
def _first(k: int, groups: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each group, by score and id."""
    order = np.lexsort((ids, -score, groups))
    g = groups[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


def _positives(chunk: Matrix, block: Matrix, k: int, _) -> list[np.ndarray]:
    """(anchor, slot, score, id) of each anchor's best rows of its label."""
    out = []
    for label in np.intersect1d(block.labels, chunk.labels):
        rows = slice(*np.searchsorted(chunk.labels, [label, label + 1]))
        first, last = np.searchsorted(block.labels, [label, label + 1])
        ids = chunk.ids[rows]
        step = max(1, TILE // len(ids))
        for at in range(first, last, step):
            anchors = slice(at, min(at + step, last))
            s = scores(block, anchors, chunk, rows)
            other = block.ids[anchors, None] != ids[None, :]
            s[~other] = -LIMIT - 1
            if s.shape[1] > k:
                least = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                a, j = np.nonzero(other & (s >= least[:, None]))
            else:
                a, j = np.nonzero(other)
            got = s[a, j]
            keep = _first(k, a, got, ids[j])
            out.append(np.stack([a[keep] + at, np.zeros(len(keep), np.int64), got[keep], ids[j][keep]]))
    return out


def _negatives(chunk: Matrix, block: Matrix, k: int, wanted) -> list[np.ndarray]:
    """(anchor, slot, score, id) of the best rows of other labels in range of each positive."""
    out, (anchor, slot, positive) = [], wanted
    step = max(1, TILE // max(1, len(chunk.ids)))
    order = np.argsort(anchor, kind="stable")
    anchor, slot, positive = anchor[order], slot[order], positive[order]
    floor = -((-LOW * positive) // HIGH)        # least score in range
    for at in range(0, len(block.ids), step):
        mine = slice(*np.searchsorted(anchor, [at, at + step]))
        if mine.start == mine.stop:
            continue
        anchors = slice(at, min(at + step, len(block.ids)))
        low = np.full(anchors.stop - at, LIMIT)
        high = np.full(anchors.stop - at, -LIMIT)
        np.minimum.at(low, anchor[mine] - at, floor[mine])
        np.maximum.at(high, anchor[mine] - at, positive[mine])
        s = scores(block, anchors, chunk, slice(None))
        a, j = np.nonzero((s >= low[:, None]) & (s <= high[:, None])
                          & (block.labels[anchors, None] != chunk.labels[None, :]))
        got, ids = s[a, j], chunk.ids[j]
        for n in np.unique(slot[mine]):
            of = mine.start + np.flatnonzero(slot[mine] == n)
            p_low, p_high = np.full(len(low), LIMIT), np.full(len(low), -LIMIT)
            p_low[anchor[of] - at], p_high[anchor[of] - at] = floor[of], positive[of]
            fit = np.flatnonzero((got >= p_low[a]) & (got <= p_high[a]))
            keep = fit[_first(k, a[fit], got[fit], ids[fit])]
            out.append(np.stack([a[keep] + at, np.full(len(keep), n), got[keep], ids[keep]]))
    return out


BEST = "block bigint, anchor bigint, slot bigint, score bigint, vec_id bigint"


def _best(pairs: DataFrame, k: int, find) -> DataFrame:
    """The best of every task: (block, anchor, slot, score, vec_id)."""
    def rows(block, best):
        for at in range(0, best.shape[1], 50_000):
            part = best[:, at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(part.shape[1], block)), *[pa.array(x) for x in part]],
                [c.split()[0] for c in BEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lru_cache(8)(Matrix)
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for n, block in enumerate(get["block"]):
                chunk = matrix(*[get[c][n] for c in ("ids", "labels", "packed", "norm")])
                anchors = matrix(*[get[c][n] for c in ("b_ids", "b_labels", "b_packed", "b_norm")])
                wanted = [np.array(get[c][n], np.int64) for c in ("anchors", "slots", "scores")
                          ] if "slots" in get else None
                new = find(chunk, anchors, k, wanted)
                old = [held[block]] if block in held else []
                if new or old:
                    x = np.concatenate(old + new, axis=1)
                    held[block] = x[:, _first(k, x[0] << 8 | x[1], x[2], x[3])]
                if sum(x.shape[1] for x in held.values()) > HELD:
                    for key, x in held.items():
                        yield from rows(key, x)
                    held = {}
        for key, x in held.items():
            yield from rows(key, x)

    return pairs.mapInArrow(run, BEST)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """The windowed selection: the first ``k`` of every anchor and slot, with their rank."""
    by = Window.partitionBy("block", "anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES,
         negatives: int = NEGATIVES, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score,
    negative_score; ``rows`` and ``anchors`` have vec_id, label and vector.

    At most 256 positives an anchor.
    """
    chunks = settle(pack(rows, CHUNK_VALUES, scale), "negatives-rows")
    # anchors are spread by id, about a block to a partition
    size = anchors.agg(F.sum(F.size("vector"))).first()[0] or 0
    blocks = pack(anchors.repartition(max(1, -(-size // BLOCK_VALUES)), "vec_id"), BLOCK_VALUES, scale)
    blocks = settle(blocks.select(F.monotonically_increasing_id().alias("block"), *[
        F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "packed", "norm")]), "negatives-anchors")
    # block by block against chunk by chunk: packed rows, not vectors, are paired
    found = settle(_ranked(_best(chunks.crossJoin(blocks), positives, _positives), positives)
                   .select("block", "anchor", (F.col("rank") - 1).cast("long").alias("slot"),
                           "score", "vec_id"), "negatives-positives")
    wanted = found.groupBy("block").agg(*[F.collect_list(c).alias(n) for c, n in (
        ("anchor", "anchors"), ("slot", "slots"), ("score", "scores"))])
    best = _best(chunks.crossJoin(blocks.join(wanted, "block")), negatives, _negatives)
    chosen = settle(_ranked(best, negatives).withColumnsRenamed(
        {"score": "negative_score", "vec_id": "negative_id"}), "negatives-chosen")
    names = blocks.select("block", "b_ids").mapInArrow(
        _anchor_ids, "block bigint, anchor bigint, anchor_id bigint")
    out = (found.withColumnsRenamed({"score": "positive_score", "vec_id": "positive_id"})
           .join(chosen, ["block", "anchor", "slot"]).join(names, ["block", "anchor"]))
    forget(chunks)
    return out.select("anchor_id", "positive_id", (F.col("slot") + 1).cast("int").alias("positive_rank"),
                      "rank", "negative_id", "positive_score", "negative_score")


def _anchor_ids(batches):
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids)],
                ["block", "anchor", "anchor_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, rows.filter("vec_id % 100 = 0"))


SQL = f"""
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, o.vec_id, o.label = a.label AS same,
         list_inner_product(a.v, o.v)::BIGINT AS score
  FROM given a JOIN given o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
positive AS (
  SELECT * FROM (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS positive_rank
    FROM scored WHERE same) WHERE positive_rank <= {POSITIVES})
SELECT anchor_id, positive_id, positive_rank::INT AS positive_rank, rank::INT AS rank, negative_id,
       positive_score, negative_score
FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positive p JOIN scored s ON s.r = p.r AND NOT s.same
    AND {LOW} * positive_score <= {HIGH} * s.score AND s.score <= positive_score)
WHERE rank <= {NEGATIVES}
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE = {"op11_hard_negatives": SQL}
