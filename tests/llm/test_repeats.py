import os
import random
from collections import Counter

import numpy as np

from cohortscope.llm import repeats as R
from tests.llm import helpers as H


def test_suffix_array_and_groups():
    rnd = random.Random(2)
    for n in range(20):
        parts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(50, 76)))
                 for _ in range(5)]
        if n % 2:
            parts += [parts[0][:60], b"a" * 76, b"a" * 70]
        part, off, common = R.suffix_array(parts)
        suffixes = [parts[p][o:] for p, o in zip(part, off)]
        heads = Counter(p[o:o + 50] for p in parts for o in range(len(p) - 49))
        assert sorted(zip(part, off)) == [(i, o) for i, p in enumerate(parts) for o in
                                          range(len(p) - 49) if heads[p[o:o + 50]] > 1]
        groups = [s[:50] for s in suffixes]
        assert sum(a != b for a, b in zip(groups, groups[1:])) == max(0, len(set(groups)) - 1)
        for i in range(1, len(suffixes)):
            a, b = suffixes[i - 1:i + 1]
            k = len(os.path.commonprefix([a, b]))
            assert common[i] == (k if k >= 50 else 0)
            assert k < 50 or a <= b


def test_groups_have_all_occurrences_and_differ_on_the_left():
    parts = [b"x" + b"r" * 10 + bytes(range(60)), b"y" + b"r" * 10 + bytes(range(60)),
             b"z" + bytes(range(60))]
    part, off, common = R.suffix_array(parts)
    raw = [p[o - 1] if o else -1 for p, o in zip((parts[i] for i in part), off)]
    first, last, length, small = R.repeat_groups(np.array(raw), common, np.array([3, 1, 2])[part])
    found = {(n, tuple(sorted(part[a:b + 1]))) for a, b, n in zip(first, last, length)}
    assert (70, (0, 1)) in found and (60, (0, 1, 2)) in found and len(found) == 2
    assert set(small) == {1}


def check(spark, docs, hot=R.HOT):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in R.remove_repeats(H.clashing(H.table(spark, docs)).repartition(3), hot).collect()}
    assert got == H.repeats(docs)


def mixed_docs():
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab ") for _ in range(200)) for _ in range(6)]
    docs = []
    for i in range(60):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randint(0, 150)
            t += rnd.choice(base)[a:a + rnd.randint(20, 120)] + rnd.choice(
                ["", "x", "é", "\n" * rnd.randint(0, 60)])
        docs.append((i * 7 % 61, t))
    return docs + [(100, ""), (101, None), (102, "a" * 500), (103, "a" * 300), (104, docs[5][1]),
                   (105, base[0] * 300)]


def test_equals_brute_force(spark):
    check(spark, mixed_docs())


def test_windows_of_hot_anchors_give_the_same(spark):
    check(spark, mixed_docs(), hot=2)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    assert R.remove_repeats(H.table(spark, [])).count() == 0
    t = "the same long passage of more than fifty bytes in all of these rows"
    rows = R.remove_repeats(H.table(spark, [(1, t), (1, t), (2, t), (None, t)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [
        ("1", 0), ("1", 0), ("2", len(t)), ("None", 0)]
