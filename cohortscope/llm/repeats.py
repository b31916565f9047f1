"""Suffix-array deduplication of repeated byte strings across documents.

1. *Anchors.*  Equal texts are one, with the smallest document; the others go whole.  Of every window of ``LEAST`` bytes the smallest of its k-mer hashes is an
   anchor: equal windows have equal anchors at equal places.  Keys that several documents
   share are found through one exchange of packed records.
2. *Contexts.*  Around a shared anchor, the bytes that any window anchored there can cover.
   Equal contexts are one, with the smallest document that has it, before anything meets in
   a task.
3. *Suffix arrays.*  Per group of anchors, an enhanced suffix array over the contexts; a scan
   of its common prefixes with a stack visits the intervals of the tree, and those whose
   occurrences differ on the left are the maximal repeat groups, with all occurrences.  In a
   group, what an occurrence covers goes if a smaller document is among the occurrences.
   An anchor with too many contexts for one array (``HOT``) has its windows grouped through
   an exchange, which is the tree's cut at depth ``LEAST``; results are the same.
4. *Spans.*  Covered bytes are carried back to every document that has the context and
   united.

Defined cases: NULL is an empty text; texts are used whole; rows of equal doc_id are not
"smaller" than each other, so repeated rows keep all that no other document has; rows
without a doc_id take no part and keep everything; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.common import forget, partitions, settle, table
from cohortscope.llm.shared_keys import blocks, n_buckets, records, shared_keys

LEAST = 50                  # bytes of a repeat
KMER = 24
SPAN = LEAST - KMER         # how far before an anchor a window can begin
WIDTH = SPAN + LEAST        # longest context
HOT = 20_000                # contexts of an anchor that still share one suffix array
BATCH = 12_000              # contexts of a suffix array, about
WHOLE = 2 ** 31 - 1         # bytes of a mark that covers a text to its end
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of_8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, the first one highest."""
    x = buf.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def kmer_hashes(buf: np.ndarray) -> np.ndarray:
    w = words_of_8(buf)
    n = len(w) - KMER + 8
    h = _mix(w[:n] + np.uint64(KMER))
    for at in range(8, KMER, 8):
        h = _mix(h ^ w[at:at + n])
    return h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, key) of the anchors of all windows, texts apart."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < LEAST:
        return none, none, none.view(np.uint64)
    h = kmer_hashes(buf)
    n = len(h) - SPAN                                       # windows in the whole buffer
    bits = np.uint64(max(1, int(len(buf)).bit_length()))
    low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)    # ties: leftmost
    width, wide = SPAN + 1, 1
    while 2 * wide <= width:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    low = np.minimum(low[:n], low[width - wide:width - wide + n])
    end = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(np.arange(LEAST, n + LEAST) <= end[owner[:n]])
    at = (low[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    own = owner[at]
    return own, at - (end - sizes)[own], h[at]


def _records(ids, texts):
    """Anchors of the distinct texts of a chunk; of equal ones the smallest id has them."""
    least: dict[bytes, int] = {}
    for i, t in zip(ids, texts):
        if i is not None and i <= least.get(t, i):
            least[t] = i
    ids, texts = list(least.values()), list(least)
    if not ids:
        return records([], [], [], [])
    found = [(own + a, at, key) for a, b in blocks(texts)
             for own, at, key in [anchors(texts[a:b])]]
    own, at, key = map(np.concatenate, zip(*found))
    id_ = np.array(ids, np.int64)
    crc = np.array([zlib.crc32(t) for t in texts], np.uint32).view(np.int32)
    return records(key, id_[own], at, crc[own])


def string_hashes(words: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int):
    """64-bit hashes of the strings of the given places, from words of eight bytes."""
    h = _mix(size.astype(np.uint64) + np.uint64(seed))
    for at in range(0, int(size.max()) if len(size) else 0, 8):
        keep = np.clip(size - at, 0, 8)
        w = words[np.minimum(begin + at, len(words) - 1)]
        cut = (8 * np.maximum(8 - keep, 0)).astype(np.uint64)
        w = np.where(keep > 0, w >> np.minimum(cut, np.uint64(63)), np.uint64(0))
        h = _mix(h ^ w) + w
    return h


def strings(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of the given places as one array."""
    edge = np.r_[0, np.cumsum(size)]
    at = np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])
    return pa.Array.from_buffers(pa.binary(), len(begin), [
        None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(buf[at])])


def digests(words: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray) -> pa.Array:
    """128 bits that stand for a context: its bytes and where its anchor is."""
    both = np.stack([string_hashes(words, begin, size, seed) + left.astype(np.uint64)
                     for seed in (1, 2)], 1)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(
        np.arange(0, 16 * len(begin) + 1, 16, np.int32)), pa.py_buffer(both)])


def digests_of(parts: list[bytes], left: list[int]) -> pa.Array:
    size = np.array([len(p) for p in parts], np.int64)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    return digests(words_of_8(np.r_[buf, np.zeros(8, np.uint8)]), np.cumsum(size) - size, size,
                   np.array(left, np.int64))


def _contexts(batches):
    """Rows of every shared anchor: key, digest and bytes of the context, where it is."""
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
        for first, last in blocks(texts):
            part = batch.slice(first, last - first)
            spots = part.column(3)
            count = np.array([len(x) for x in spots], np.int64)
            at = np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in spots])
            size = np.array([len(t) for t in texts[first:last]], np.int64)
            base = np.repeat(np.cumsum(size) - size, count)
            buf = np.frombuffer(b"".join(texts[first:last]), np.uint8)
            words = words_of_8(np.r_[buf, np.zeros(8, np.uint8)])
            begin = np.maximum(at - SPAN, 0)
            wide = np.minimum(at + LEAST, np.repeat(size, count)) - begin
            place = base + begin
            left = at - begin
            docs = np.repeat(np.arange(len(size)), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kmer_hashes(buf)[base + at].view(np.int64)),
                 pa.array(left.astype(np.int32)), digests(words, place, wide, left),
                 strings(buf, place, wide), part.column(0).take(pa.array(docs)),
                 part.column(1).take(pa.array(docs)), pa.array(begin.astype(np.int32))],
                ["key", "left", "digest", "part", "doc", "crc", "begin"])


def suffix_array(parts: list[bytes], least: int = LEAST):
    """Suffixes that share ``least`` bytes with another one, and their common prefixes.

    Only the tree below depth ``least`` is asked for: suffixes are ordered by the hash of
    their first ``least`` bytes, which drops those that are alone, and then by the bytes
    that follow.  Returns (part, offset, common with the one before) as arrays; 0 between
    suffixes that share less.
    """
    size = np.array([len(p) for p in parts], np.int64)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    words = words_of_8(np.r_[buf, np.zeros(8, np.uint8)])
    count = np.maximum(size - least + 1, 0)
    part = np.repeat(np.arange(len(parts)), count)
    off = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    place = (np.cumsum(size) - size)[part] + off
    head = string_hashes(words, place, np.full(len(place), least), 3)
    order = np.argsort(head, kind="stable")
    head = head[order]
    alone = np.r_[True, head[1:] != head[:-1], True]
    tied = ~(alone[:-1] & alone[1:])[:len(head)]
    order, group = order[tied], head[tied]
    part, off, place = part[order], off[order], place[order]
    rest = size[part] - off - least                         # bytes that follow
    cols = []
    for at in range(0, int(rest.max()) if len(rest) else 0, 8):
        keep = np.clip(rest - at, 0, 8)
        w = words[np.minimum(place + least + at, len(words) - 1)]
        cut = (8 * np.minimum(8 - keep, 7)).astype(np.uint64)
        cols.append(np.where(keep > 0, (w >> cut) << cut, np.uint64(0)))
    order = np.lexsort([rest, *cols[::-1], group])
    part, off, rest, group = part[order], off[order], rest[order], group[order]
    more, open_ = np.zeros(max(0, len(part) - 1), np.int64), np.ones(max(0, len(part) - 1), bool)
    for w in cols:
        w = w[order]
        x = w[1:] ^ w[:-1]
        lead = np.full(len(x), 8)
        for k in range(7, -1, -1):                          # equal leading bytes
            lead[(x >> np.uint64(8 * (7 - k))) != 0] = k
        more[open_] += lead[open_]
        open_ &= x == 0
    common = np.zeros(len(part), np.int64)
    if len(part):
        more = np.minimum(more, np.minimum(rest[1:], rest[:-1]))
        common[1:] = np.where(group[1:] == group[:-1], least + more, 0)
    return part, off, common


def repeat_groups(left: np.ndarray, common: np.ndarray, value: np.ndarray, least: int = LEAST):
    """Maximal repeats by a scan of the suffix array with a stack of open intervals.

    ``left`` is the byte before each suffix, negative where it is unknown.  Yields arrays
    (first, last, length, smallest value) of the intervals of the tree whose occurrences do
    not all continue to the left with the same byte.
    """
    n = len(common)
    change = np.zeros(n, np.int64)
    change[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
    seen = np.cumsum(change).tolist()
    out = []
    heads = np.flatnonzero((common[1:] >= least) & (common[:-1] < least)) if n > 1 else []
    low, val = common.tolist(), value.tolist()
    for head in (heads.tolist() if len(heads) else []):
        stack = []                      # [length, first, smallest value]
        i = head + 1
        while True:
            here = low[i] if i < n else 0
            if here < least:
                here = 0
            first, small = i - 1, val[i - 1]
            while stack and stack[-1][0] > here:
                length, first, best = stack.pop()
                small = best if best < small else small
                if seen[i - 1] > seen[first]:
                    out.append((first, i - 1, length, small))
                if stack and stack[-1][2] > small:
                    stack[-1][2] = small
            if not here:
                break
            if not stack or stack[-1][0] < here:
                stack.append([here, first, small])
            elif stack[-1][2] > small:
                stack[-1][2] = small
            i += 1
    return np.array(out, np.int64).reshape(-1, 4).T


def covered(parts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Per context and byte, whether a repeat with a smaller document covers it."""
    part, off, common = suffix_array(parts)
    size = max(map(len, parts))
    change = np.zeros((len(parts), size + 1), np.int64)
    if len(part):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        begin = np.cumsum([0, *map(len, parts)])[part]
        left = np.where(off > 0, raw[begin + off - 1].astype(np.int64), -1)
        first, last, length, small = repeat_groups(left, common, docs[part])
        size_of = last - first + 1
        which = np.repeat(np.arange(len(first)), size_of)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size_of) - size_of, size_of) + first[which]
        later = docs[part[at]] > small[which]
        at, which = at[later], which[later]
        np.add.at(change, (part[at], off[at]), 1)
        np.add.at(change, (part[at], off[at] + length[which]), -1)
    return np.cumsum(change[:, :-1], 1) > 0


def _arrays(batches):
    """Covered bytes of contexts that come sorted by key, a few groups at a time."""
    def flush(rows):
        mask = covered([r[2] for r in rows], np.array([r[3] for r in rows], np.int64))
        wide = np.zeros((len(rows), mask.shape[1] + 2), np.int8)
        wide[:, 1:-1] = mask
        row, edge = np.nonzero(np.diff(wide, axis=1))       # begins and ends by turns
        runs = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), pa.int32()),
            pa.array(edge, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [digests_of([r[2] for r in rows], [r[1] for r in rows]),
             pa.array([r[3] for r in rows], pa.int64()), runs], ["digest", "least", "runs"])

    rows = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if len(rows) >= BATCH and rows[-1][0] != row[0]:
                yield flush(rows)
                rows = []
            rows.append(row)
    if rows:
        yield flush(rows)


def _windows(batches):
    for batch in batches:
        out = [(hashlib.blake2b(part[o:o + LEAST], digest_size=16).digest(), digest, o, least)
               for digest, part, least in zip(
                   digests_of(batch.column(2).to_pylist(), batch.column(1).to_pylist()).to_pylist()
                   if batch.num_rows else [], *[batch.column(i).to_pylist() for i in (2, 3)])
               for o in range(len(part) - LEAST + 1)]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(),
                                                   pa.int64()))],
            ["window", "digest", "offset", "least"])


def verdicts(contexts: DataFrame, hot: int = HOT) -> DataFrame:
    """(digest, least, runs): smallest document of each context, and what of it a repeat
    with a smaller one covers, as begins and ends by turns."""
    one = settle(contexts.groupBy("key", "left", "part").agg(F.min("doc").alias("least")),
                 "contexts")
    many = settle(one.groupBy("key").count().filter(F.col("count") > hot).select("key"), "hot")
    n = partitions(contexts.sparkSession)
    plain = (one.join(many, "key", "left_anti").repartition(n, "key").sortWithinPartitions(
        "key", "left").mapInArrow(_arrays, "digest binary, least bigint, runs array<int>"))
    windows = one.join(many, "key", "left_semi").mapInArrow(
        _windows, "window binary, digest binary, offset int, least bigint")
    first = windows.groupBy("window").agg(F.min("least").alias("first"))
    found = windows.join(first, "window").groupBy("digest", "least").agg(
        F.collect_set(F.when(F.col("first") < F.col("least"), F.col("offset"))).alias("starts"))
    runs = F.flatten(F.transform("starts", lambda o: F.array(o, o + LEAST)))
    out = settle(plain.unionByName(found.select("digest", "least", runs.alias("runs"))),
                 "verdicts")
    forget(one, many)
    return out


def _remove(batches):
    """Texts with their covered spans: digest of what is left, and the spans."""
    for batch in batches:
        rows = []
        for text, spots in zip(batch.column(2), batch.column(3)):
            data = text.as_buffer().to_pybytes()
            change = np.zeros(len(data) + 1, np.int64)
            if spots.is_valid:
                ends = np.minimum(spots.values.to_numpy(zero_copy_only=False), len(data))
                change += np.bincount(ends[::2], minlength=len(change))
                change -= np.bincount(ends[1::2], minlength=len(change))
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
            spans = edge.reshape(-1, 2)
            kept, at = [], 0
            for a, b in spans.tolist():
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            rows.append((len(data), int(gone.sum()), len(spans),
                         hashlib.sha256(kept).hexdigest(), spans.ravel().tolist(), kept))
        cols = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]],
             pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.int64())),
             pa.array(cols[5], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def remove_repeats(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Remove every byte covered by a string that also starts in a smaller document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    keyed = rows.withColumn("crc", F.crc32("text"))
    mine = rows.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= LEAST)).select(
        "doc", F.xxhash64("text").alias("hash"), F.crc32("text").alias("crc"))
    least = mine.groupBy("hash", "crc").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    copies = settle(mine.join(least.filter("low < high").select("hash", "crc", "low"),
                              ["hash", "crc"]).filter("doc > low").select("doc", "crc").distinct(),
                    "copies")
    shared = settle(shared_keys(rows.filter(F.octet_length("text") >= LEAST), _records,
                                n_buckets(rows)), "anchors")
    spots = shared.groupBy(F.col("id").alias("doc"), F.col("b").cast("long").bitwiseAND(0xFFFFFFFF).alias("crc")).agg(
        F.collect_list("a").alias("spots")).join(copies, ["doc", "crc"], "left_anti")
    contexts = settle(
        keyed.join(spots, ["doc", "crc"]).select("doc", "crc", "text", "spots").mapInArrow(
            _contexts, "key bigint, left int, digest binary, part binary, doc bigint, crc bigint, "
                       "begin int"),
        "occurrences")
    forget(shared)
    judged = verdicts(contexts, hot)
    begin, size = F.col("begin"), F.col("size")
    runs = F.when(F.col("doc") == F.col("least"), F.transform("runs", lambda x: x + F.col("begin"))
                  ).when(size >= LEAST, F.array(begin, begin + size))
    marks = settle(
        contexts.withColumn("size", F.length("part"))
        .select("digest", "doc", "crc", "begin", "size").join(judged, "digest")
        .select("doc", "crc", runs.alias("runs")).filter(F.size("runs") > 0)
        .groupBy("doc", "crc").agg(F.flatten(F.collect_list("runs")).alias("marks")), "marks")
    forget(contexts, judged)
    marks = marks.unionByName(copies.withColumn("marks", F.array(F.lit(0), F.lit(WHOLE))))
    return keyed.join(marks, ["doc", "crc"], "left").select("doc", "crc", "text", "marks"
                                                            ).mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
                 "kept_sha256 string, spans array<bigint>, kept binary")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


QUERIES = {"op2_repeats": op2_repeats}
ORACLE: dict[str, str] = {}
