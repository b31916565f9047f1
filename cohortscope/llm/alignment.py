"""Cross-tokenizer alignment.

Two vocabularies cut the bytes of a text differently.  A text's tokens of each are listed in
a dictionary from cumulative end, in bytes, to index; the keys that both have, sorted, slice
both lists of ids into groups that cover the same bytes, and the tokens at the end of a slice
are linked.  Links are counted over all texts, and each text is scored by those counts.

A task keeps a text's distinct linked pairs only.  Two linked tokens end at the same byte, so
one's bytes are a suffix of the other's: ``most_pairs`` counts the pairs for which that can
hold, about a million for the given vocabularies, however many texts there are.  The table of
counts is therefore bounded by the vocabularies, and is the only one that is sent to every task.

Texts are encoded with a blank in front, without special tokens; tokens' bytes are the
byte-level decoded token of A, and the piece of B with its blank sign as a blank and <0xHH> as
a byte.  Vocabulary A is a byte-level BPE file.  Where its merges are numbered in order of
rank, as given, ``tiktoken`` merges by these ranks, four times as fast as ``tokenizers``; other
files, and texts with runs beyond ``LONG_RUN``, go through ``tokenizers``.

Defined cases: NULL and empty texts, and texts of which A's or B's bytes do not join to the
text, have no tokens and no groups; very long texts are used whole, their dictionaries cover
``WINDOW`` bytes at a time; repeated rows count once each; tokens without bytes belong to the
slice that ends where they do, and all tokens that end together are linked; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm.common import forget, settle, table

FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 2_000_000
WINDOW = 1 << 20            # bytes of a text whose ends are in dictionaries at once
JOINED = 1 << 16            # tokens whose bytes are joined at once
LONG_RUN = 5_000            # characters without a change between blank and other
#: How byte-level BPE of this kind splits a text before merging (fixed value).
PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


def _byte_of_sign() -> dict[str, int]:
    """The bytes that signs of a byte-level vocabulary stand for: printable ones for
    themselves, the others, in order, are numbered from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Encoder and token bytes of a byte-level BPE file."""

    def __init__(self, data: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(data.decode())
        self.slow.encode_special_tokens = True
        sign, model = _byte_of_sign(), json.loads(data)["model"]
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        vocab = self.slow.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = (token.encode() if token in special
                             else bytes(sign[c] for c in token))
        ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        by_rank = (all(vocab[t] == 256 + k for k, t in enumerate(merged))
                   and all(len(self.bytes[i]) == 1 for i in range(256)))
        self.fast = by_rank and tiktoken.Encoding(
            "a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and (len(text) < LONG_RUN or not _RUN.search(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Encoder and token bytes of a SentencePiece file; it puts a blank in front itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                              else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """Byte lengths of a vocabulary's tokens, and their numbers as written in groups."""

    def __init__(self, token_bytes: list[bytes], last: str):
        self.bytes = token_bytes
        self.length = np.array([len(b) for b in token_bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.spelled = np.frombuffer(b"".join(token_bytes), np.uint8)
        names = [str(i) for i in range(len(token_bytes))]
        self.written = np.array([n + "," for n in names] + [n + last for n in names], "S")

    def text(self, ids) -> bytes:
        """Bytes of tokens that follow each other, ``JOINED`` tokens at a time."""
        return b"".join(self._text(ids[k:k + JOINED]) for k in range(0, len(ids), JOINED))

    def _text(self, ids) -> bytes:
        size = self.length[ids]
        end = np.cumsum(size)
        at = np.repeat(self.start[ids] - (end - size), size)
        at += np.arange(len(at))
        return self.spelled[at].tobytes()


@lru_cache(2)
def loaded(data_a: bytes, data_b: bytes) -> tuple[ByteLevel, Pieces, Side, Side]:
    a, b = ByteLevel(data_a), Pieces(data_b)
    return a, b, Side(a.bytes, "|"), Side(b.bytes, ";")


def slices(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either list up to each end that both have, ascending."""
    cut_a, cut_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edges = np.arange(0, int(end_a[-1]) + WINDOW, WINDOW) if len(end_a) else np.zeros(0)
    first_a = np.searchsorted(end_a, edges, "right")
    first_b = np.searchsorted(end_b, edges, "right")
    for k in range(len(edges) - 1):
        a = slice(0 if k == 0 else first_a[k], first_a[k + 1])
        b = slice(0 if k == 0 else first_b[k], first_b[k + 1])
        index_a = dict(zip(end_a[a].tolist(), range(a.start + 1, a.stop + 1)))
        index_b = dict(zip(end_b[b].tolist(), range(b.start + 1, b.stop + 1)))
        # ends ascend, and dictionaries keep their order: the common keys come out sorted
        found = list(map(index_a.get, index_b))                 # no index is 0
        cut_a.append(np.fromiter(filter(None, found), np.int64))
        cut_b.append(np.fromiter(compress(index_b.values(), found), np.int64))
    return np.concatenate(cut_a), np.concatenate(cut_b)


def links(ids_a, ids_b, end_a, end_b, cut_a, cut_b) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all A-B pairs that end together, slice by slice."""
    end = end_a[cut_a - 1]
    n_a = cut_a - np.searchsorted(end_a, end, "left")       # more than one only where tokens
    n_b = cut_b - np.searchsorted(end_b, end, "left")       # have no bytes
    n = n_a * n_b
    if len(n) == n.sum():
        return ids_a[cut_a - 1], ids_b[cut_b - 1]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    of = np.repeat(np.arange(len(n)), n)
    return (ids_a[(cut_a - n_a)[of] + place // n_b[of]],
            ids_b[(cut_b - n_b)[of] + place % n_b[of]])


def written(ids_a, ids_b, cut_a, cut_b, a: Side, b: Side) -> str:
    """The groups: ``a1,a2|b1;a3|b2,b3``, in order."""
    if not len(cut_a):
        return ""
    out = np.empty(len(ids_a) + len(ids_b), max(a.written.dtype, b.written.dtype))
    before_b, before_a = np.r_[0, cut_b[:-1]], cut_a
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[cut_a - 1], last_b[cut_b - 1] = len(a.length), len(b.length)
    out[np.arange(len(ids_a)) + np.repeat(before_b, np.diff(cut_a, prepend=0))] = (
        a.written[ids_a + last_a])
    out[np.arange(len(ids_b)) + np.repeat(before_a, np.diff(cut_b, prepend=0))] = (
        b.written[ids_b + last_b])
    signs = out.view(np.uint8)
    return signs[signs != 0].tobytes()[:-1].decode()            # numbers are filled up with zeros


NONE = np.zeros(0, np.int64)


def aligned(texts: list[str | None], v) -> Iterator[tuple]:
    """(ids of A, ids of B, ends of A, ends of B, cuts of A, cuts of B) of every text."""
    enc_a, enc_b, a, b = v
    for text, ids_b in zip(texts, enc_b.encode([t or "" for t in texts])):
        ids_a = enc_a.encode(" " + text) if text else []
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        whole = (" " + text).encode() if text else b""
        if not text or a.text(ids_a) != whole or b.text(ids_b) != whole:
            yield (NONE,) * 6
            continue
        end_a, end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
        yield ids_a, ids_b, end_a, end_b, *slices(end_a, end_b)


def _portions(batches: Iterator[pa.RecordBatch]):
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(key)
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= BATCH_BYTES:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    edge = np.r_[0, np.cumsum([len(x) for x in arrays])]
    flat = np.concatenate(arrays) if arrays else NONE
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat.astype(np.int32)))


def _files(file_a: str, file_b: str) -> tuple[bytes, bytes]:
    with open(file_a, "rb") as a, open(file_b, "rb") as b:
        return a.read(), b.read()


def align(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """doc_id, the ids of either vocabulary, and for each group how many ids of either list
    lie up to its end (``cut_a``, ``cut_b``)."""
    data = _files(file_a, file_b)

    def run(batches):
        v = loaded(*data)
        for keys, texts in _portions(batches):
            made = list(zip(*[(x[0], x[1], x[4], x[5]) for x in aligned(texts, v)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[_lists(list(m)) for m in made]],
                ["doc_id", "ids_a", "ids_b", "cut_a", "cut_b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, ids_a array<int>, ids_b array<int>, cut_a array<int>, "
             "cut_b array<int>")


LINKED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
          "groups_sha256 string, a array<int>, b array<int>, n array<int>")


def linked(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """Per document the numbers of its alignment, the digest of its groups, and its distinct
    linked pairs (``a``, ``b``) with how often each occurs (``n``)."""
    data = _files(file_a, file_b)

    def run(batches):
        v = loaded(*data)
        for keys, texts in _portions(batches):
            rows, pairs = [], []
            for ids_a, ids_b, end_a, end_b, cut_a, cut_b in aligned(texts, v):
                link_a, link_b = links(ids_a, ids_b, end_a, end_b, cut_a, cut_b)
                groups = written(ids_a, ids_b, cut_a, cut_b, v[2], v[3])
                digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                rows.append((len(ids_a), len(ids_b), len(cut_a), len(link_a), digest))
                key, n = np.unique(link_a << 32 | link_b, return_counts=True)
                pairs.append((key >> 32, key & 0xFFFFFFFF, n))
            numbers = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *numbers, *[_lists(list(p)) for p in zip(*pairs)]],
                [c.split()[0] for c in LINKED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKED)


def _flat(batch: pa.RecordBatch, names=("a", "b", "n")):
    return [batch.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for n in names]


def pair_counts(links: DataFrame) -> DataFrame:
    """How many links of all documents hold each pair: a, b, n, and whether that is the most
    of any pair of its ``b``.  Tasks add up what they read first."""
    def add(parts):
        key = np.concatenate([k for k, _ in parts])
        at, place = np.unique(key, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, place, np.concatenate([n for _, n in parts]))
        return at, total

    def run(batches):
        parts, held = [(NONE, NONE)], 0
        for batch in batches:
            a, b, n = _flat(batch)
            parts.append((a << 32 | b, n))
            held += len(a)
            if held > 2_000_000:
                parts, held = [add(parts)], 0
        key, n = add(parts)
        for at in range(0, len(key), 50_000):
            k = key[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(n[at:at + 50_000])],
                ["a", "b", "n"])

    n = (links.select("a", "b", "n").mapInArrow(run, "a bigint, b bigint, n bigint")
         .groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def most_pairs(bytes_a: list[bytes], bytes_b: list[bytes]) -> int:
    """Upper bound of the number of distinct linked pairs: one's bytes end the other's."""
    n_b: dict[bytes, int] = {}
    n_a: dict[bytes, int] = {}
    for x in bytes_b:
        n_b[x] = n_b.get(x, 0) + 1
    for x in bytes_a:
        n_a[x] = n_a.get(x, 0) + 1
    return (sum(n_b.get(x[k:], 0) for x in bytes_a for k in range(len(x) + 1))
            + sum(n_a.get(x[k:], 0) for x in bytes_b for k in range(1, len(x) + 1)))


def score(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Add n_best and count_sum to the documents of ``linked``; see the module's docstring for
    the bound of ``counts``."""
    spark = links.sparkSession
    t = counts.toArrow()
    a, b, n = (t.column(c).to_numpy() for c in ("a", "b", "n"))
    order = np.argsort(a << 32 | b)
    sent = spark.sparkContext.broadcast(((a << 32 | b)[order], n[order],
                                         t.column("best").to_numpy().astype(bool)[order]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        key, count, best = sent.value
        for batch in batches:
            a, b, n = _flat(batch)
            at = np.searchsorted(key, a << 32 | b)
            edge = np.r_[0, np.cumsum([len(x) for x in batch.column("a")])]
            total, top = (np.diff(np.r_[0, np.cumsum(n * x[at])][edge]) for x in (count, best))
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(top.astype(np.int64)), pa.array(total.astype(np.int64))],
                [*names, "n_best", "count_sum"])

    kinds = ", ".join(LINKED.split(", ")[:6])
    return links.mapInArrow(run, f"{kinds}, n_best bigint, count_sum bigint")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = settle(linked(table(spark, sf_dir, "documents")), "align-links")
    counts = settle(pair_counts(links), "align-counts")
    out = score(links, counts)
    forget(counts)
    return out


QUERIES = {"op13_alignment": op13_alignment}
ORACLE: dict[str, str] = {}
