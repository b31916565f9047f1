import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from cohortscope.llm import pieces as S
from tests.llm import helpers as H

DATA = open(S.MODEL, "rb").read()
V = S.vocabulary(DATA, S.ALPHA)
SP = sentencepiece.SentencePieceProcessor(model_proto=DATA)


def every(text):
    """Log probability of every segmentation, by trying all."""
    s, out = " " + text, {}

    def go(i, ids, w):
        if i == len(s):
            out[tuple(ids)] = w
            return
        for n in range(1, 17):
            part = s[i:i + n]
            k = SP.piece_to_id(part.replace(" ", "▁"))
            if len(part) == n and k > 2 and SP.id_to_piece(k) == part.replace(" ", "▁"):
                go(i + n, [*ids, k], w + V.weight[k])
            elif n == 1:
                data = part.encode()
                go(i + 1, [*ids, *(int(V.byte_id[b]) for b in data)],
                   w + V.byte_weight * len(data))
    go(0, [], 0.0)
    z = math.log(sum(map(math.exp, out.values())))
    return {k: x - z for k, x in out.items()}


def test_samples_follow_the_distribution_without_replacement():
    exact, n = every("the cat"), 8000
    rows = S._rows(list(range(n)), ["the cat"] * n, V, 3, 5)
    got = [[tuple(x) for x in b.column(2).to_pylist()] for b in rows]
    for b, ids in zip(rows, got):
        assert np.allclose(b.column(3).to_pylist(), [exact[i] for i in ids])
    assert all(len(set(x)) == 3 for x in zip(*got))
    likely = sorted(exact, key=exact.get)[-4:]
    first, pairs = Counter(got[0]), Counter(zip(*got[:2]))
    for a in likely:
        p = math.exp(exact[a])
        assert first[a] / n == pytest.approx(p, abs=4 * math.sqrt(p / n))
        for b in likely:
            if a != b:
                q = p * math.exp(exact[b]) / (1 - p)
                assert pairs[a, b] / n == pytest.approx(q, abs=4 * math.sqrt(q / n) + 1e-3)
    ratio = [np.exp(np.array(b.column(3)) - np.array(b.column(5))) for b in rows]
    assert np.mean(sum(ratio)) == pytest.approx(1, abs=0.03)      # inclusion scores are right


def test_few_segmentations_give_as_many_samples():
    for text in ("", "a", "\n", "ab"):
        exact = every(text) if text else {(): 0.0}
        rows = S._rows([1], [text], V, 9, 3)
        assert {tuple(b.column(2)[0].as_py()) for b in rows if b.num_rows} == set(exact) or len(
            exact) > 9
        assert sum(b.num_rows for b in rows) == min(9, len(exact))


def test_round_trip_and_keys(spark):
    docs = [(1, "Hello  world\n\tx"), (2, None), (3, ""), (4, "▁x é中😀\x00"), (5, "a" * 30_000),
            (6, " lead"), (6, " lead"), (None, "no id")]
    df = H.clashing(H.table(spark, docs))
    coded = S.encode(df.repartition(3), check=True)
    rows = S.decode(coded).collect()
    text = {i: t or "" for i, t in docs}
    assert all(r.decoded == text[r.doc_id] for r in rows)
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in rows)
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2, 6: 4, None: 2}
    for r in rows:
        if r.doc_id in (1, 6, None):
            assert SP.decode(r.ids) == r.decoded
    same = {(r.doc_id, r.sample): (r.ids, r.log_prob) for r in S.encode(df.coalesce(1)).collect()}
    assert all(same[r.doc_id, r.sample] == (r.ids, r.log_prob) for r in rows)
    assert S.encode(H.table(spark, [])).count() == 0


def test_pieces_are_found_among_hashes_that_begin_alike():
    """op4 was over its CPU budget: every hash was searched in the whole sorted list."""
    assert V.held.max() > 1 and V.held.sum() == len(V.hashes)
    for h in (V.hashes, V.hashes + np.uint64(1), V.hashes ^ np.uint64(1 << 43), V.hashes[:0]):
        want = dict(zip(V.hashes.tolist(), V.ids.tolist()))
        assert V.find(h).tolist() == [want.get(x, -1) for x in h.tolist()]


def test_characters_that_are_no_piece_are_spelled_in_bytes():
    text = "a\x01é\U0001F9FF▁\U0001F9FF z ͸ b"
    rows = S._rows([1, 2], [text, "\U0001F9FF"], V, 2, 1, True)
    for batch in rows:
        for r in batch.to_pylist():
            want = text if r["doc_id"] == 1 else "\U0001F9FF"
            assert r["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest()
