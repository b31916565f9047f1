import random
import zlib

import numpy as np

from cohortscope.llm import quality_model as M
from cohortscope.llm import quality_rules as Q
from cohortscope.llm.suffixes import maximal_repeats, suffix_array
from tests.llm import helpers as H


def test_rules_equal_brute_force(spark):
    rnd = random.Random(5)
    docs = [(i, "".join(rnd.choice(["ab", "cd", "#e", "\n", " ", "\t", "é "])
                        for _ in range(rnd.randint(0, 90)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, "a b c d e f g h i j " * 3000), (1, docs[1][1])]
    df = H.clashing(H.table(spark, docs))
    got = Q.measure(df).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == H.quality(text[r.doc_id])
        assert not (r.base_failed and r.kept)
    kept = Q.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert Q.measure(H.table(spark, [])).count() == 0


def test_repetition_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        d = [rnd.choice("abc") for _ in range(rnd.randint(0, 90))]

        def inside(m):
            seen = [tuple(d[i:i + m]) for i in range(len(d) - m + 1)]
            return {j for i, s in enumerate(seen) if seen.count(s) > 1 for j in range(i, i + m)}

        longest = max([m for m in range(1, len(d) + 1) if inside(m)], default=0)
        got = Q.repetition([d, ["x"] * 7, []])
        assert tuple(got[0]) == (len(inside(5)), len(inside(Q.REPEAT_WORDS)), longest)
        assert tuple(got[2]) == (0, 0, 0)


def test_maximal_repeats_equal_brute_force():
    rnd = random.Random(2)
    for n in range(300):
        docs = [[rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 40))]
                for _ in range(2)]
        least = rnd.choice([1, 2, 5])
        tokens = np.array([t for d in docs for t in d], np.int64)
        owner = np.repeat([0, 1], [len(d) for d in docs])
        if not len(tokens):
            continue
        want = np.zeros(len(tokens), np.int64)
        for k, d in enumerate(docs):
            base = 0 if k == 0 else len(docs[0])
            for m in range(least, len(d)):
                starts = {}
                for i in range(len(d) - m + 1):
                    starts.setdefault(tuple(d[i:i + m]), []).append(i)
                for at in starts.values():
                    left = {d[i - 1] if i else None for i in at}
                    right = {d[i + m] if i + m < len(d) else (None, i) for i in at}
                    if len(at) > 1 and len(left) > 1 and len(right) > 1:
                        for i in at:
                            want[base + i] = max(want[base + i], m)
        got = maximal_repeats(tokens, owner, *suffix_array(tokens, owner), least)
        assert got.tolist() == want.tolist(), (docs, least)


def test_method_rejects_a_long_repeat_that_the_base_lets_pass():
    rnd = random.Random(1)
    body = [f"w{rnd.randrange(10 ** 6)}" for _ in range(600)]
    again = body[:52] + body[:200] + body[200:]
    failed, kept = Q.verdict(np.array([len(body), len(again)]), Q.repetition([body, again]))
    assert list(failed) == [False, False] and list(kept) == [True, False]


def test_forest_learns_and_flattening_is_right():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = M.grow(x[:1500], y[:1500], trees=40)
    s = f.score(x)
    assert ((s[1500:] > 0.5) == (y[1500:] == 1)).mean() > 0.95
    value = np.full(3, f.start)
    for t in range(len(f.leaf)):
        for i in range(3):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + 1 + (x[i, f.feature[t, node]] > f.border[t, node])
            value[i] += f.leaf[t, node - f.feature.shape[1]]
    assert np.allclose(s[:3], 1 / (1 + np.exp(-value)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = M.op5_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_model_edges(spark):
    docs = H.clashing(H.table(spark, [(i, None if i % 3 else "a b") for i in range(12)])
                      ).selectExpr("*", "false AS held_out")
    none = spark.createDataFrame([], "doc_id long, quality int")
    f = M.learn(docs, none)
    assert {r.score for r in M.score(docs, f).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (None, 0), (2, None)],
                                "doc_id long, quality int")
    assert all(r.score > 0.9 for r in M.score(docs, M.learn(docs, one)).collect())
    assert M.score(docs.limit(0), f).count() == 0


def plain_statistics(text):
    """Some of the statistics by name, character by character and word by word."""
    import re
    text = text or ""
    words = re.findall(H.WORD, text)
    n, size = max(1, len(words)), max(1, len(text))
    lengths = [len(w) for w in words] or [0]

    def lower(c):
        return c.isalpha() and not c.isupper()

    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    return {
        "log_chars": np.log1p(len(text)), "log_words": np.log1p(len(words)),
        "mean_word": np.mean(lengths), "sd_word": np.std(lengths), "longest_word": max(lengths),
        "letters": sum(map(lower, text)) / size, "upper": sum(c.isupper() for c in text) / size,
        "digits": sum(c in "0123456789" for c in text) / size,
        "blanks": sum(c in " \t\n\x0b\x0c\r" for c in text) / size,
        "symbols": sum(c in "#*$%&|<>" for c in text) / size,
        "not_ascii": sum(ord(c) > 127 for c in text) / size, "distinct": len(set(words)) / n,
        "lines": np.log1p(max(1, len(lines))),
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "ends_word": sum(w[-1] in ".!?,;:" for w in words) / n,
        "capital": sum(w[0].isupper() for w in words) / n,
        "all_capital": sum(any(c.isupper() for c in w) and not any(map(lower, w)) for w in words) / n,
        "with_digit": sum(any(c in "0123456789" for c in w) for w in words) / n,
        "short": np.mean([x <= 3 for x in lengths]),
        "repeated_pairs": 1 - len(set(pairs)) / max(1, len(words) - 1),
        "top_word": max([words.count(w) for w in set(words)], default=0) / n}


def test_statistics_equal_plain_counts():
    rnd = random.Random(9)
    pieces = ["a", "B", "é", "Ä", "7", " ", " ", "\n", "\t", ".", "!", "#", "<|", "(", "ab", "Cd", "日", "😀", " word"]
    texts = [None, "", " \n ", "x"] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 120)))
                                       for _ in range(300)]
    for t in texts:
        got = dict(zip(M.STATISTICS, M.statistics(t)))
        for name, value in plain_statistics(t).items():
            assert abs(got[name] - value) < 1e-9, (name, t)


def test_grown_split_is_the_best_of_all():
    """One tree of depth 1 against every border of every feature."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(400) < 0.1)).astype(float)
    f = M.grow(x, y, trees=1, depth=1)
    p = y.mean()
    gain = {}
    for k in range(3):
        for b in range(12):
            left = x[:, k] <= b
            parts = [y[left] - p, y[~left] - p]
            if all(len(g) * p * (1 - p) >= M.MIN_HESSIAN for g in parts):
                gain[k, b] = sum(g.sum() ** 2 / (len(g) * p * (1 - p) + M.RIDGE) for g in parts)
    best = max(gain, key=gain.get)
    k, border = int(f.feature[0, 0]), float(f.border[0, 0])
    assert k == best[0] and np.array_equal(x[:, k] <= border, x[:, k] <= best[1])
