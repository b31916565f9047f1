import hashlib
import math
from collections import Counter

import corpus_pipeline as C
from cohortscope.llm import mixing, pieces, pii, quality_rules
from tests.llm import helpers as H
from tests.llm.test_mixing import brute


def corpus():
    long = [f"token{i * i % 9973} of text number {i}" for i in range(30)]
    docs = [(i, " ".join(long[(i * 3 + k) % 30] for k in range(12)), "en", f"s{i % 4}", 5)
            for i in range(30)]
    docs += [(100, docs[3][1] + " tail", "en", "s1", 5), (101, docs[3][1], "en", None, 5),
             (102, "too short", "en", "s1", 5), (103, None, None, None, None),
             (104, docs[8][1] + " mail ann@example.org", "en", "s2", 5),
             (105, "the same words over and over again " * 30, "en", "s2", 5)]
    return docs


def mixed(rows):
    """How often every row is taken: targets by resharing, draws by hash, one by one."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(H.words(r.text))
    aims, out = brute(dict(sizes)), Counter()
    for r in rows:
        rate = aims[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        body = hashlib.md5((r.text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}|{body}".encode()).hexdigest()[:13], 16) / 2 ** 52
        n = math.floor(rate) + (u < rate - math.floor(rate))
        if n:
            out[str(r)] += n
    return out


def segmented(rows):
    """Documents, from the pieces' bytes; probabilities are checked against all ways."""
    v = pieces.vocabulary(open(pieces.MODEL, "rb").read(), pieces.ALPHA)
    known = {v.bytes[i].decode(): i for i in v.ids}
    out, seen = Counter(), {}
    for r in rows:
        text = b"".join(v.bytes[i] for i in r.ids).decode()
        assert text.startswith(" ")
        seen.setdefault((r.doc_id, text), []).append(r)
        out[r.doc_id, text[1:]] += 1
    for (_, text), samples in seen.items():
        total = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            ways = [total[i] + v.weight[known[text[i:j]]] for i in range(max(0, j - v.longest), j)
                    if text[i:j] in known]
            if text[j - 1] not in known:
                ways.append(total[j - 1] + v.byte_weight * len(text[j - 1].encode()))
            top = max(ways)
            total[j] = top + math.log(sum(math.exp(w - top) for w in ways))
        for r in samples:
            byte_ids = set(v.byte_id.tolist())
            weight = sum(v.byte_weight if i in byte_ids else v.weight[i] for i in r.ids)
            assert abs(r.log_prob - (weight - total[-1])) < 1e-6
        assert len({tuple(r.ids) for r in samples}) >= min(2, len(samples))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs = corpus()
    sf = str(tmp_path)
    H.table(spark, docs).write.parquet(f"{sf}/documents.parquet")
    at, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in C.STAGES:
        at = stage(spark, at, sf)
        at.write.parquet(f"{sf}/{name}")
        at = spark.read.parquet(f"{sf}/{name}")
        kept.append(at.collect())
    passed = {i: t for i, t, *_ in docs if not H.quality(t)[5] and quality_rules.verdict(
        *[f([t.split()]) for f in (lambda w: len(w[0]), quality_rules.repetition)])[1][0]}
    assert {r.doc_id for r in kept[0]} == set(passed)
    part = H.jaccard_components(list(passed.items()))
    assert {r.doc_id for r in kept[1]} == {i for i, (_, c) in part.items() if i == c}
    assert all(c == H.COLUMNS.split(", ")[i].split()[0]
               for i, c in enumerate(spark.read.parquet(f"{sf}/mixing").columns))
    for r in kept[2]:
        assert r.text == pii.replace(passed[r.doc_id], [
            (*s[:2], s[2], 1.0) for s in H.base_spans(passed[r.doc_id])])
        assert "@" not in r.text
    assert Counter(map(str, kept[3])) == mixed(kept[2])
    assert segmented(kept[4]) == Counter(
        {(r.doc_id, r.text): 2 * n for r, n in Counter(kept[3]).items()})
    rows = C.run(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, kept[4]))


def test_empty_corpus(spark, tmp_path):
    H.table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stage_list():
    assert [n for n, _ in C.STAGES][1] == "near duplicates" and len(C.STAGES) == 5
