import zlib

import numpy as np

from cohortscope.llm import language as L
from tests.llm import helpers as H


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in L.op7_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    test = [d for d in docs if rows[d.doc_id].held_out and d.lang]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in test) / len(test) > 0.97


def test_grams_and_distance():
    got = sorted(L.grams("Ab, b"))
    a, b, s = ord("a"), ord("b"), 32
    want = [a, b, b, s | a << 21, a | b << 21, b | s << 21, s | b << 21, b | s << 21,
            s | a << 21 | b << 42, a | b << 21 | s << 42, b | s << 21 | b << 42,
            s | b << 21 | s << 42]
    assert got == sorted(want)
    p = L.Profiles({k: L.top(*np.unique(L.grams(t), return_counts=True), 3)
                    for k, t in (("x", "a"), ("y", "b"))}, 3)
    assert p.predict("a") == ("x", 1.0) and p.predict("b")[0] == "y"
    assert p.predict("12 !") == p.predict(None) == ("und", 0.0)
    assert L.Profiles({}).predict("a") == ("und", 0.0)


def test_edges(spark):
    docs = H.clashing(H.table(spark, [(1, "aa bb", "x", "s", 1), (2, None, "x", "s", 1),
                                      (3, "zz zz", None, "s", 1), (None, "aa", "x", "s", 0)]))
    docs = docs.selectExpr("*", "false AS held_out")
    profiles = L.learn(docs)
    assert set(profiles) == {"x"}
    assert L.predict(docs, L.Profiles(profiles)).count() == 4
    assert L.learn(docs.limit(0)) == {}


def out_of_place(text, profiles, length):
    """Rank-order distance over plain lists, and the nearest language."""
    from collections import Counter

    def ranked(t, most):
        seen = Counter(L.grams(t).tolist())
        return [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))][:most]

    own = ranked(text, length)
    if not own:
        return "und", 0.0
    distance = {}
    for lang, profile in profiles.items():
        place = {g: k for k, g in enumerate(profile)}
        distance[lang] = sum(abs(place[g] - k) if g in place else length for k, g in enumerate(own))
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (length * len(own))


def test_distance_over_long_profiles_equals_brute_force():
    import random
    rnd = random.Random(7)
    words = {k: ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(80)]
             for k, letters in {"a": "abcdefgh", "b": "efghijklé", "c": "abcxyzß"}.items()}

    def text(k, n):
        return " ".join(rnd.choice(words[k]) for _ in range(n))

    for length in (5, 40, 300):
        profiles = {k: L.top(*np.unique(L.grams(text(k, 3000)), return_counts=True), length)
                    for k in words}
        fast = L.Profiles(profiles, length)
        lists = {k: v.tolist() for k, v in profiles.items()}
        for n in (0, 1, 3, 20, 400):
            for k in [*words, *words]:
                t = text(k, n) + rnd.choice(["", " 12!", " ZZ"])
                lang, score = fast.predict(t)
                want = out_of_place(t, lists, length)
                assert lang == want[0] and abs(score - want[1]) < 1e-12
