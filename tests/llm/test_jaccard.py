import random

from cohortscope.llm import jaccard as J
from cohortscope.llm.components import components
from tests.llm import helpers as H

ODD = [(2000, ""), (2001, None), (2002, " \n"), (2003, "a b"), (2004, "A b"),
       (2005, "a b c d e"), (2006, "É a b c d e"), (2007, "é a b c d e"),
       (2008, "q r s t u v " * 4000)]


def test_equals_brute_force(spark):
    docs = H.near_copies() + ODD
    df = H.clashing(H.table(spark, docs)).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == H.jaccard_components(docs)


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    base = [f"w{k}" for k in range(60)]
    other = [f"v{k}" for k in range(60)]
    near = other[:50] + ["x", "y"] + other[50:]
    docs = [(3, " ".join(base)), (7, " ".join(base)), (7, " ".join(other)), (9, " ".join(near)),
            (7, " ".join(other)), (9, " ".join(near)), (11, "else " * 30), (11, None)]
    rnd = random.Random(5)
    many = [(rnd.randrange(40), t) for _, t in H.near_copies(seed=8, clusters=6)]
    for rows in (docs, many, docs + many + docs):
        df = H.table(spark, rows).repartition(3)
        want = H.jaccard_components(rows)
        got = {(r.doc_id, r.component_id) for r in J.near_duplicates(df).collect()}
        assert got == {(i, c) for i, (_, c) in want.items()}
    assert H.jaccard_components(docs)[9][1] == 3


def test_keeps_one_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    docs = [(3, text), (1, text.upper()), (1, text), (2, "else " + text * 3), (None, text),
            (None, text), (5, None)]
    df = H.clashing(H.table(spark, docs))
    out = J.keep_one(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "5", "None", "None"]
    assert J.near_duplicates(H.table(spark, [])).count() == 0


def test_prefix_and_overlap_bounds():
    for n in range(1, 200):
        for m in range(n, 200):
            least = next(o for o in range(n + 1) if 100 * o >= 80 * (n + m - o)
                         ) if 100 * n >= 80 * m else None
            if least is not None:
                assert J.needed(n, m) == least
                assert J.prefix(n) > n - least and J.prefix(m) > m - least


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(40)}}


def _lists(spark, sets):
    """Index lists of the given sets (ascending tokens): each is a component of its own."""
    rows = [(t, i, len(s), p, i) for i, s in enumerate(sets)
            for p, t in enumerate(s[:J.prefix(len(s))])]
    return spark.createDataFrame(rows, "key long, node long, n long, place long, component long")


def test_sets_that_share_the_end_of_their_prefix_form_no_pairs(spark):
    """op8, pipeline: such sets came out of every list that they shared, each with each."""
    alike = [[1000 * i + p for p in range(20)] + [10 ** 6 + p for p in range(126)]
             for i in range(30)]
    assert J.meetings(_lists(spark, alike)).count() == 0
    assert J.candidates(_lists(spark, alike)).count() == 0


def test_every_linked_pair_is_a_candidate(spark):
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(24), rng.randint(3, 22))) for _ in range(150)]
    sets = [list(s) for s in dict.fromkeys(map(tuple, sets))]
    got = {tuple(r) for r in J.candidates(_lists(spark, sets)).select("x", "y").collect()}
    pairs = [(i, j) if (len(a), i) < (len(b), j) else (j, i) for i, a in enumerate(sets)
             for j, b in enumerate(sets) if i < j and
             100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))]
    assert len(pairs) > 5 and set(pairs) <= got
