"""Exact scores and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from cohortscope.llm import hard_negatives as H

COLUMNS = "vec_id long, label int, vector array<double>"


def matrix(values, ids=None):
    v = np.array(values, np.int64).reshape(len(values), -1)
    n = len(v)
    norm = max(sum(int(x) ** 2 for x in r) for r in v)
    return H.Matrix(np.arange(n).tobytes() if ids is None else ids, np.zeros(n, np.int64).tobytes(),
                    H._packed(v), norm)


@pytest.mark.parametrize("top,width", [(3, 1), (200, 64), (500, 300), (10 ** 4, 70), (10 ** 8, 40),
                                       (10 ** 8, 115)])
def test_scores_are_exact(top, width):
    rnd = random.Random(top)
    a, b = [[[rnd.choice([rnd.randint(-top, top), top, -top]) for _ in range(width)]
             for _ in range(9)] for _ in range(2)]
    b[0], b[1] = a[0], [-x for x in a[0]]
    got = H.scores(matrix(a), slice(None), matrix(b), slice(None))
    assert got.tolist() == [[sum(x * y for x, y in zip(r, s)) for s in b] for r in a]


def test_scores_near_the_limit_and_number_of_primes():
    top = math.isqrt(H.LIMIT - 1)
    got = H.scores(matrix([[top], [-top], [1]]), slice(None), matrix([[top], [1 - top]]), slice(None))
    assert got.tolist() == [[top * top, top * (1 - top)], [-top * top, top * (top - 1)], [top, 1 - top]]
    assert [H.n_primes(b) for b in (0, 510, 511, 500_000)] == [1, 1, 2, 2]


def whole(row):
    i, label, v = row
    if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    w = [math.floor(H.SCALE * x) for x in v]
    return None if sum(x * x for x in w) >= H.LIMIT else (i, label, w)


def brute(rows, anchor):
    rows = [w for w in map(whole, rows) if w]
    out = []
    for i, label, v in rows:
        if not anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m == label) for j, m, w in rows if j != i]
        positives = sorted(s[:2] for s in scored if s[2])[:H.POSITIVES]
        for n, (p, j) in enumerate(positives):
            fit = sorted(s[:2] for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)
            out += [(i, j, n + 1, k + 1, q, -p, -s) for k, (s, q) in enumerate(fit[:H.NEGATIVES])]
    return sorted(out)


def run(spark, rows, anchor, columns=COLUMNS):
    df = spark.createDataFrame(rows, columns) if isinstance(rows, list) else rows
    return sorted(tuple(r) for r in H.mine(df, df.filter(anchor)).collect())


def random_rows(n, labels, spread, seed=1, width=5):
    rnd = random.Random(seed)
    out = [(k, rnd.randrange(labels), [rnd.choice([-1, 1]) * rnd.randint(0, spread) / 64
                                       for _ in range(width)]) for k in range(n)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("labels,spread", [(3, 4), (2, 1), (1, 9), (40, 100)])
def test_equals_brute_force_with_many_ties(spark, monkeypatch, labels, spread):
    rows = random_rows(300, labels, spread)
    monkeypatch.setattr(H, "CHUNK_VALUES", 200)      # many chunks, blocks and tiles
    monkeypatch.setattr(H, "BLOCK_VALUES", 20)
    monkeypatch.setattr(H, "TILE", 90)
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0)


def test_files_paired_without_broadcast_and_early_passing_on(spark, monkeypatch):
    rows = random_rows(200, 3, 5, seed=4)
    for name, value in (("CHUNK_VALUES", 100), ("BLOCK_VALUES", 20)):
        monkeypatch.setattr(H, name, value)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run(spark, rows, "vec_id % 9 = 0") == brute(rows, lambda i: i % 9 == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0]),
            (3, 2, [1.0, 2.0]), (4, 2, [1.0, 2.0]), (5, 2, [0.9, 1.9]), (5, 2, [0.9, 1.9]),
            (6, 1, []), (7, 2, []), (8, 1, [1.0]), (9, 2, [1.0, 2.0, 5.0]), (10, None, [1.0]),
            (None, 1, [1.0]), (11, 1, None), (12, 2, [nan, 1.0]), (13, 2, [inf]), (14, 2, [None, 1.0]),
            (15, 2, [1e30, 0.0]), (20, 2, [-1.0, -2.0]), (30, 3, [0.5, 0.5]), (-10, 2, [1.0, 2.0])]
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and run(spark, rows, "vec_id % 10 = 0") == want
    clash = spark.createDataFrame(rows, COLUMNS).withColumns(
        {c: F.lit("clash") for c in ("block", "anchor", "score", "ids", "norm", "rank", "slot")})
    assert run(spark, clash, "vec_id % 10 = 0") == want
    assert run(spark, [], "vec_id % 10 = 0") == []
    assert run(spark, [(0, 1, [1.0])], "vec_id % 10 = 0") == []
    assert run(spark, rows, "vec_id = 1 and vec_id = 2") == []


def test_query_equals_sql(spark, sf):
    assert compare(H.op11_hard_negatives(spark, sf), connect(sf), H.SQL) is None
