"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.llm import alignment as A
from tests.llm.helpers import table

NASTY = ["", None, " ", "a", "naïve café ", "日本語のテキスト", "😀😀 👩‍👩‍👧", "tab\tand\r\nlines\n\n",
         "<|endoftext|> </s> <s> <unk> <0x41>", "the ▁ sign itself", "  two  blanks  ", " 　",
         "'s 'll I've", "12345 67.89", "\x00\x01", "é", "ﬁ ligature", "x" * 3000, "the the the"]


@pytest.fixture(scope="module")
def v():
    return A.loaded(*A._files(A.FILE_A, A.FILE_B))


def brute(docs, v):
    """Occurrences one by one, with the slow encoder and plain lists."""
    enc_a, enc_b, a, b = v
    got, count = {}, Counter()
    for i, text in docs:
        ids_a = enc_a.slow.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = enc_b.model.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        ends = []
        if b"".join(a.bytes[x] for x in ids_a) != whole or b"".join(b.bytes[x] for x in ids_b) != whole:
            ids_a, ids_b = [], []
        for ids, side in ((ids_a, a), (ids_b, b)):
            at, e = 0, []
            for x in ids:
                at += len(side.bytes[x])
                e.append(at)
            ends.append(e)
        pairs = [(x, y) for x, p in zip(ids_a, ends[0]) for y, q in zip(ids_b, ends[1]) if p == q]
        groups, begin = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            part = [",".join(str(x) for x, p in zip(ids, z) if begin < p <= e)
                    for ids, z in zip((ids_a, ids_b), ends)]
            groups.append("|".join(part))
            begin = e
        got[i] = [len(ids_a), len(ids_b), len(groups), len(pairs), ";".join(groups), pairs]
        count.update(pairs)
    most = {}
    for (x, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    for r in got.values():
        pairs = r.pop()
        r[4] = hashlib.sha256(r[4].encode()).hexdigest() if r[4] else ""
        r += [sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs)]
    return {i: tuple(r) for i, r in got.items()}


def run(spark, df):
    links = A.linked(df).cache()
    out = A.score(links, A.pair_counts(links)).collect()
    return {r["doc_id"]: tuple(r)[1:] for r in out}


def test_equals_brute_force(spark, sf, v):
    given = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    rnd = random.Random(2)
    made = ["".join(rnd.choice(NASTY) or " " for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    docs = [(r["doc_id"], (r["text"] or "")[:1500]) for r in given.collect()]
    docs += [(10_000 + k, t) for k, t in enumerate(NASTY + made + made[:5])]
    assert run(spark, table(spark, docs).repartition(5)) == brute(docs, v)


def test_fast_encoder_equals_slow_one_and_runs_go_the_slow_way(v):
    for text in [t for t in NASTY if t] + [" " * 40_000, "a" * 40_000, "é" * 20_000 + " b"]:
        assert v[0].encode(text) == v[0].slow.encode(text, add_special_tokens=False).ids


def test_pairs_are_bounded_by_the_vocabularies(spark, sf, v):
    bound = A.most_pairs(v[2].bytes, v[3].bytes)
    assert bound < 1_200_000
    pairs = A.pair_counts(A.linked(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert 0 < len(pairs) <= bound
    for r in pairs:
        x, y = v[2].bytes[r["a"]], v[3].bytes[r["b"]]
        assert x.endswith(y) or y.endswith(x)


def test_tokens_without_bytes_are_linked_and_windows_do_not_matter(monkeypatch):
    ids_a, ids_b = np.array([1, 2, 3, 4]), np.array([5, 6, 7])
    end_a, end_b = np.array([2, 4, 4, 7]), np.array([4, 4, 7])
    cut = A.slices(end_a, end_b)
    assert [c.tolist() for c in cut] == [[3, 4], [2, 3]]
    pairs = list(zip(*[x.tolist() for x in A.links(ids_a, ids_b, end_a, end_b, *cut)]))
    assert pairs == [(2, 5), (2, 6), (3, 5), (3, 6), (4, 7)]
    monkeypatch.setattr(A, "WINDOW", 2)
    assert [c.tolist() for c in A.slices(end_a, end_b)] == [[3, 4], [2, 3]]


def test_alignment_itself_empty_table_and_other_columns(spark, v):
    out = A.align(table(spark, [(1, "naïve words"), (2, None)])).collect()
    one = out[0]
    assert v[2].text(one["ids_a"][:one["cut_a"][0]]) == v[3].text(one["ids_b"][:one["cut_b"][0]])
    assert one["cut_a"][-1] == len(one["ids_a"]) and out[1]["ids_a"] == []
    empty = table(spark, [(1, "a")]).limit(0)
    assert run(spark, empty) == {}
    clash = table(spark, [(1, "some words")]).withColumns(
        {c: F.lit("clash") for c in ("a", "b", "n", "n_a", "best", "count_sum")})
    assert run(spark, clash)[1][0] > 0


def test_groups_are_written_and_texts_joined_without_python_objects(v, monkeypatch):
    """op13 was over its CPU budget: objects a token, and a set and a sort a text."""
    text = "some words, naïve 東京 words \t and 12345 words "
    one = next(A.aligned([text], v))
    ids_a, ids_b, _, _, cut_a, cut_b = one
    groups = [",".join(map(str, ids_a[i:j])) + "|" + ",".join(map(str, ids_b[k:m])) for i, j, k, m
              in zip(np.r_[0, cut_a], cut_a, np.r_[0, cut_b], cut_b)]
    assert A.written(ids_a, ids_b, cut_a, cut_b, v[2], v[3]) == ";".join(groups)
    assert v[2].written.dtype.kind == v[3].written.dtype.kind == "S"
    monkeypatch.setattr(A, "JOINED", 3)
    assert v[2].text(ids_a) == v[3].text(ids_b.tolist()) == (" " + text).encode()
    assert v[2].text([]) == b""
