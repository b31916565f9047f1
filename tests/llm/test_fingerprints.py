import hashlib

import pytest
from pyspark.sql import functions as F

from cohortscope.llm import fingerprints as P
from tests.llm.helpers import clashing, shingles, table


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_edited_text_and_likeness(spark):
    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 211}" for k in range(i * 3))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, docs[30][1]), (43, "é b"), (44, "a b c d e f g " * 2000)]
    got = rows_of(P.fingerprint_documents(clashing(table(spark, docs)).repartition(5)).select(
        "*", P.resemblance(F.col("print"), F.col("edited_print")).alias("near_edited"),
        P.resemblance(F.col("print"), F.col("next_print")).alias("near_next")))
    assert set(got) == {d[0] for d in docs}
    for n, (i, t) in enumerate(docs):
        t, follow = t or "", docs[(n + 1) % len(docs)][1] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + follow[:q]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles_exact(t), shingles_exact(edited), shingles_exact(follow)
        for want, have in ((b, got[i].near_edited), (c, got[i].near_next)):
            exact = len(a & want) / len(a | want) if a | want else 1.0
            small = len(a | want) <= P.K
            assert have == pytest.approx(exact, abs=1e-9 if small else 0.15)
    assert got[30].print == got[42].print and got[40].print == got[41].print == []


def shingles_exact(text):
    w = [x for x in text.replace("\n", " ").split(" ") if x]
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_merge_containment_and_count(spark):
    docs = [(0, " ".join(f"a{k}" for k in range(600))), (1, " ".join(f"a{k}" for k in range(300)))]
    df = P.with_words(table(spark, docs), "text", "w").select("doc_id", P.sketch(F.col("w")).alias("p"))
    a, b = (r.p for r in df.orderBy("doc_id").collect())
    one = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(
        P.merge(F.col("a"), F.col("b")).alias("m"), P.containment(F.col("b"), F.col("a")).alias("ba"),
        P.containment(F.col("a"), F.col("b")).alias("ab"),
        P.distinct_shingles(F.col("a")).alias("n")).first()
    assert one.m == sorted(set(a) | set(b))[:P.K]
    assert one.ba > 0.8 and one.ab == pytest.approx(0.5, abs=0.15)
    assert one.n == pytest.approx(596, rel=0.3)
    assert len(shingles(docs[0][1])) == 596


def test_empty_single_and_missing_ids(spark):
    assert P.fingerprint_documents(table(spark, [])).count() == 0
    one = P.fingerprint_documents(table(spark, [(5, "abcd efgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd efab"[:7] + b"ab").hexdigest()
    odd = P.fingerprint_documents(table(spark, [(None, "a b"), (1, "c"), (1, "c"), (2, None)]))
    assert odd.count() == 4
