import pytest

from checks.compare import compare, connect
from cohortscope.llm import mixing as X
from tests.llm import helpers as H


def test_equals_sql(spark, sf):
    assert compare(X.op9_mixing(spark, sf), connect(sf), X.SQL) is None


def brute(sizes):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: left * weight[s] / w for s in open_}}
        fixed.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, "c": 1}, {"a": 1, "b": 1, "c": 1000, "d": 2, None: 5}, {"a": 0, "b": 7},
    {"a": 0}, {f"s{i}": (i * i) % 17 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in X.targets(df).collect()}
    assert got == pytest.approx(brute(sizes))


def test_mix_repeats_rows_and_meets_targets(spark):
    docs = [(i, "w " * (1 + i % 9), "en", ["a", "b", None][i % 3], 0) for i in range(3000)]
    docs += [(9000, None, "en", "a", 0), (9001, "", None, "b", 0), (5, docs[5][1], "en", None, 0)]
    df = H.clashing(H.table(spark, docs))
    plan = X.plan(df).collect()
    assert len(plan) == len(docs)
    for source in ("a", "b", None):
        rows = [r for r in plan if r.row.source == source]
        taken = sum(r["size"] * r.copies for r in rows)
        assert taken == pytest.approx(rows[0].target, rel=0.1)
        assert all(r.copies <= 3 for r in rows)
    mixed = X.mix(df)
    assert mixed.columns == df.columns and mixed.schema == df.schema
    assert {r.target for r in mixed.collect()} == {"clash"}
    assert mixed.count() == sum(r.copies for r in plan)
    assert X.mix(H.table(spark, [])).count() == 0
