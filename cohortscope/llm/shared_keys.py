"""Keys that occur in more than one document, found through one exchange of packed records.

Tasks pack the records of a chunk of documents by bucket of the key and combine first: of a
key that two documents of the chunk share, one record goes to its bucket and the others are
already known to be shared.  A key that every document has therefore costs its bucket one
record per chunk, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.common import partitions

CHUNK_BYTES = 1 << 23               # text that is combined before it is packed
BUCKET_BYTES = 1 << 25              # text whose records a task of the exchange gets, about
PER_TASK = 8                        # buckets of such a task: it holds one at a time
RECORD = np.dtype([("key", "<u8"), ("id", "<i8"), ("a", "<i4"), ("b", "<i4"), ("many", "u1")])
SCHEMA = "key bigint, id bigint, a int, b int"


def n_buckets(docs: DataFrame, text: str = "text") -> int:
    """Buckets for what ``docs`` has: ``PER_TASK`` for every ``BUCKET_BYTES``."""
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return PER_TASK * max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES):
    """(ids, texts as bytes) of portions of the (id, text) rows; NULL is empty."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
            held += len(texts[-1])
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def blocks(texts: list[bytes], size: int = 1 << 20):
    """(first, last) of runs of texts that numpy works on at once: arrays stay small."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i + 1 == len(texts):
            yield first, i + 1
            first, held = i + 1, 0


def records(key, id_, a, b) -> np.ndarray:
    out = np.zeros(len(key), RECORD)
    out["key"], out["id"], out["a"], out["b"] = key, id_, a, b
    return out


def _grouped(r: np.ndarray):
    """Records by key and id, the starts of equal keys, and which keys have several ids."""
    r = r[np.lexsort((r["id"], r["key"]))]
    new = np.r_[True, r["key"][1:] != r["key"][:-1]]
    start = np.flatnonzero(new)
    last = np.r_[start[1:], len(r)] - 1
    return r, start, r["id"][start] != r["id"][last]


def combine(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records to send, records already known to be shared) of a chunk."""
    if not len(r):
        return r, r
    r, start, several = _grouped(r)
    size = np.diff(np.r_[start, len(r)])
    known = np.repeat(several, size)
    first = np.zeros(len(r), bool)
    first[start] = True
    r["many"] = known & first
    return r[~known | first], r[known & ~first]


def decide(r: np.ndarray) -> np.ndarray:
    """The records of shared keys among all that reached a bucket."""
    if not len(r):
        return r
    r, start, several = _grouped(r)
    shared = several | np.maximum.reduceat(r["many"], start).astype(bool)
    return r[np.repeat(shared, np.diff(np.r_[start, len(r)]))]


def _pack(r: np.ndarray) -> bytes:
    planes = b"".join(np.ascontiguousarray(r[n]).tobytes() for n in RECORD.names)
    return zstandard.compress(planes, 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    n, at = len(raw) // RECORD.itemsize, 0
    out = np.zeros(n, RECORD)
    for name in RECORD.names:
        kind = RECORD[name]
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return out


def _batch(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(r["key"]).view(np.int64)),
         *[pa.array(np.ascontiguousarray(r[n])) for n in ("id", "a", "b")]],
        ["key", "id", "a", "b"])


def shared_keys(rows: DataFrame, make: Callable[[list, list], np.ndarray],
                buckets: int) -> DataFrame:
    """All records whose key occurs under more than one id: (key, id, a, b).

    ``make`` turns the ids and texts of a chunk into records.
    """
    def send(batches):
        for ids, texts in chunks(batches):
            out, known = combine(make(ids, texts))
            place = ((out["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32))
            cuts = np.searchsorted(place, np.arange(buckets + 1))       # ascending by key
            filled = np.flatnonzero(np.diff(cuts))
            packed = [(int(b), 0, _pack(out[cuts[b]:cuts[b + 1]])) for b in filled]
            for i, part in enumerate(np.array_split(known, max(1, len(known) // 100_000))):
                if len(part):
                    packed.append(((len(ids) + 31 * i) % buckets, 1, _pack(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in packed], pa.int32()),
                 pa.array([p[1] for p in packed], pa.int8()),
                 pa.array([p[2] for p in packed], pa.binary())], ["bucket", "known", "data"])

    def settle(batches):
        def ended():
            shared = decide(np.concatenate(held)) if held else np.zeros(0, RECORD)
            for at in range(0, len(shared), 100_000):
                yield _batch(shared[at:at + 100_000])

        held, now = [], None
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in (0, 1)], batch.column(2))
            for bucket, known, data in rows:
                if bucket != now:
                    yield from ended()
                    held, now = [], bucket
                part = _unpack(data.as_buffer())
                if known:
                    yield _batch(part)
                else:
                    held.append(part)
        yield from ended()

    return (rows.mapInArrow(send, "bucket int, known byte, data binary")
            .repartition(max(1, buckets // PER_TASK), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(settle, SCHEMA))
