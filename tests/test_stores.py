"""Interval sweeps, stored statistics, sketches and stores: brute force, plans and files."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import store_checks as S
from checks.compare import compare, connect
from cohortscope.operators import (intervals, links, merge, ordering, peer, preprocess, sequences,
                                   sketches)
from cohortscope.sources import fixtures, readers, stores

C = F.col
HEAVY = {"j13_link_overlaps", "w8_m16_incremental_merge"}      # compared at scale by checks.compare


@pytest.mark.parametrize("name", sorted(set(S.QUERIES) - HEAVY))
def test_query_equals_sql(spark, sf, name):
    diff = compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
    assert diff is None, diff


# -------------------------------------------------------------------- intervals
def spans(rnd, n, groups, width, prefix):
    return [(f"{prefix}{k}", rnd.choice(groups), rnd.choice([None, *range(width)]) if k % 11 == 0 else
             rnd.randrange(width), rnd.randrange(-2, width + 5)) for k in range(n)]


@pytest.mark.parametrize("groups,width", [([1], 3), ([1, 2, None], 40), ([1], 1000)])
def test_overlaps_equal_pairs(spark, groups, width):
    rnd = random.Random(width)
    left, right = spans(rnd, 120, groups, width, "p"), spans(rnd, 90, groups, width, "b")
    cols = "id string, g int, s int, e int"
    got = intervals.count_overlaps(
        spark.createDataFrame(left, cols).withColumn("point", F.lit("clash")),
        spark.createDataFrame(right, cols), ["g"], ("s", "e"), ("s", "e"), "id").collect()
    assert len(got) == len(left)

    def valid(x):
        return x[1] is not None and x[2] is not None and x[2] <= x[3]

    want = {}
    for p in left:
        met = [b for b in right if valid(p) and valid(b) and p[1] == b[1] and b[2] <= p[3] and b[3] >= p[2]]
        want[p[0]] = (len(met), min([(b[2], b[0]) for b in met], default=(0, None))[1],
                      max([(b[3], b[0]) for b in met], default=(0, None))[1])
    assert {r.id: (r.n_overlaps, r.earliest_id, r.latest_id) for r in got} == want


def test_overlaps_never_join_on_the_group_alone(spark, sf):
    plan = S.q_zone_overlaps(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join .*", plan)
    assert joins and all("zone" in j and j.count("=") >= 2 for j in joins)


def test_running_minimum_maximum_and_sum(spark):
    rnd = random.Random(1)
    rows = [(g, float(v), rnd.randrange(100)) for g in (1, 2) for v in rnd.sample(range(-500, 500), 200)]
    df = spark.createDataFrame(rows, "g int, v double, x int")
    aggs = {"total": ("sum", "x"), "low": ("min", "x"), "high": ("max", "x")}
    for down in (False, True):
        for r in ordering.running(df, ["g"], "v", aggs, down).collect():
            upto = [x for g, v, x in rows if g == r.g and (v >= r.v if down else v <= r.v)]
            assert (r.total, r.low, r.high) == (sum(upto), min(upto), max(upto))


# ------------------------------------------------------------ stored statistics
def test_statistics_of_loads_equal_one_computation(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k % 3 if k % 10 else None, 1e9 + rnd.random() if k % 7 else None, rnd.choice([0.0, 1.0, 5.0, float("nan")]),
             k % 2, k % 4) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double, y double, fraud_label int, part int")
    path = str(tmp_path / "partials")
    for part in (0, 1, 2, 3, 1):                    # one load arrives again
        sketches.store_load(sketches.partial_statistics(
            df.filter(C("part") == part), ["g"], ["x", "y"]), path, part)
    got = {(r.g, r.feature): r for r in sketches.merge_statistics(
        sketches.stored_loads(spark, path), ["g"]).drop("sketch").collect()}
    want = df.groupBy("g").agg(*[f(F.when(~F.isnan(c), C(c))).alias(f"{n}_{c}") for c in ("x", "y")
                                 for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]).collect()
    for w in want:
        for c in ("x", "y"):
            r = got[(w.g, c)]
            assert r.n == w[f"n_{c}"] and r["mean"] == pytest.approx(w[f"m_{c}"], rel=1e-12)
            assert r["std"] == pytest.approx(w[f"s_{c}"], rel=1e-6)
        assert got[(w.g, None)].n == sum(x[0] == w.g for x in rows)


def test_a_new_load_reads_and_rewrites_no_old_one(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 2 as g", "cast(id as double) as x", "1 as fraud_label")
    path = str(tmp_path / "partials")
    sketches.store_load(sketches.partial_statistics(df, ["g"], ["x"]), path, 1)
    before = {f: os.stat(f"{path}/load=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/load=1")}
    sketches.store_load(sketches.partial_statistics(df, ["g"], ["x"]), path, 2)
    assert before == {f: os.stat(f"{path}/load=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/load=1")}


def test_quantile_ranks_of_merged_sketches_are_close(spark):
    df = spark.range(0, 60_000, 1, 6).selectExpr(
        "id % 2 as g", "pow(cast(hash(id) % 1000 as double), 3) as x", "0 as fraud_label", "id % 6 as part")
    parts = [sketches.partial_statistics(df.filter(C("part") == p), ["g"], ["x"]) for p in range(6)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    probs = {"low": 0.05, "median": 0.5, "p95": 0.95}
    off = sketches.rank_errors(sketches.merge_statistics(every, ["g"]), df, ["g"], ["x"], probs).collect()
    assert len(off) == 2 and all(0 <= r[n] < 0.01 for r in off for n in probs)


def test_theta_overlaps_are_exact_below_and_close_above_the_size(spark):
    a = spark.range(0, 20_000).selectExpr("'a' as s", "id as k")
    b = spark.range(15_000, 40_000).selectExpr("'b' as s", "id as k")
    both = a.unionByName(b).unionByName(b)
    exact = sketches.sketch_overlaps(sketches.key_sketches(both, "s", "k")).first()
    assert tuple(exact)[2:] == (20_000, 25_000, 5_000, 15_000, 40_000)
    rough = sketches.sketch_overlaps(sketches.key_sketches(both, "s", "k", 10)).first()
    assert all(abs(x - y) <= 4 * 40_000 / 2 ** 5 for x, y in zip(tuple(rough)[2:], tuple(exact)[2:]))
    assert tuple(rough)[2:] != tuple(exact)[2:]


# ------------------------------------------------------------------------ stores
def test_observed_write_is_one_scan_and_leaves_other_partitions(spark, ws, tmp_path):
    path = str(tmp_path / "years")
    panel = ws.panel.select("person_id", "tax_year", "fraud_label", "agi")
    metrics = stores.summary_metrics(years=[2019, 2020], nullable=["agi"])
    seen = stores.write_observed(panel, path, ["tax_year"], metrics)
    back = spark.read.parquet(path)
    assert seen["rows"] == back.count() and seen["nulls_agi"] == back.filter("agi IS NULL").count()
    assert seen["rows_2019"] + seen["rows_2020"] + seen["rows_other"] == seen["rows"]
    files = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("tax_year")}
    stores.write_observed(panel.filter("tax_year = 2020").limit(5), path, ["tax_year"], metrics)
    now = {d: sorted(os.listdir(f"{path}/{d}")) for d in files}
    assert {d for d in files if files[d] != now[d]} == {"tax_year=2020"}
    assert spark.read.parquet(path).filter("tax_year = 2020").count() == 5


def test_bucketed_tables_join_without_an_exchange(spark, sf, ws):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = S.bucketed(spark, sf, 4)
        seq = sequences.build_sequences(t["clean"], ["agi", "gross_receipts"])
        for name, d in {"reattach": preprocess.reattach_raw(t["clean"], t["raw"], ["person_id", "tax_year"]),
                        "prior": links.prior_year(t["clean"], "gross_receipts", "prior"),
                        "sequences": seq}.items():
            assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString(), name
        want = sequences.build_sequences(ws.panel.select("person_id", "tax_year", "agi", "gross_receipts"),
                                         ["agi", "gross_receipts"])
        assert sorted(map(tuple, seq.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_read(df):
    """Rows that the scans of an executed plan returned, before filters."""
    plan = df._jdf.queryExecution().executedPlan()
    adaptive = plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec"
    leaves = (plan.executedPlan() if adaptive else plan).collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    df = spark.range(0, 60_000, 1, 1).selectExpr("id as person", "hash(id) * 2L as employer", "id * 7 as x")
    path = str(tmp_path / "ids")
    stores.write_lookup(df.coalesce(1), path, ["person", "employer"], 60_000, 64 * 1024)
    ids = [r.employer for r in df.filter("person in (5, 40000)").collect()]
    for wanted, most in (([*ids], 30_000), ([i + 1 for i in range(ids[0], ids[0] + 60, 2)], 20_000)):
        got = stores.lookup(spark, path, "employer", wanted)
        rows = got.collect()
        assert len(rows) == (2 if wanted == ids else 0)
        assert rows_read(got) < most


def test_batches_merge_like_one_and_leave_other_buckets(spark, ws, tmp_path):
    parts = fixtures.sources(ws.panel.filter("CAST(person_id AS BIGINT) % 3 = 0"))
    names, path = list(parts), str(tmp_path / "merged")
    for batch in (names[4:], names[2:4], names[:2]):
        merge.merge_batch(spark, path, {n: parts[n] for n in batch}, 8)
    once = merge.clean_labels(merge.null_policy(merge.keep_best(merge.union_sources(
        [merge.align(d, t) for t, d in parts.items()]), ["person_id", "tax_year"])))
    assert sorted(map(str, merge.merged_rows(spark, path).select(*once.columns).collect())) == sorted(
        map(str, once.collect()))
    files = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket")}
    one = parts["real"].limit(1)
    touched = [r.bucket for r in merge.merge_batch(spark, path, {"real": one}, 8).collect()]
    now = {d: sorted(os.listdir(f"{path}/{d}")) for d in files}
    assert len(touched) == 1 and {d for d in files if files[d] != now[d]} == {f"bucket={touched[0]}"}


def test_ranks_of_stored_rows_equal_percent_ranks(spark):
    rnd = random.Random(4)
    rows = [(k, k % 3, float(rnd.randrange(30)), rnd.choice([None, 1.0, 2.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, x double, y double")
    points = peer.rank_breakpoints(df, ["g"], ["x", "y"])
    want = {r.id: (r.pct_x, r.pct_y) for r in ordering.percent_ranks(df, ["g"], ["x", "y"], "id").collect()}
    got = {r.id: (r.pct_x, r.pct_y) for r in peer.ranks_of_arriving(
        df, points, ["g"], ["x", "y"], "id").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    new = spark.createDataFrame([(1, 0, -9.0, 1.5), (2, 0, 99.0, None), (3, 0, 7.5, 9.0), (4, 77, 1.0, 1.0)],
                                "id int, g int, x double, y double")
    r = {x.id: x for x in peer.ranks_of_arriving(new, points, ["g"], ["x", "y"], "id").collect()}
    at = {v: want[k][0] for k, g, v, _ in rows if g == 0}
    assert 0 < r[1].pct_x < min(at.values()) and r[2].pct_x == 100 and r[4].pct_x == 50
    assert at[7.0] < r[3].pct_x < at[8.0] and r[2].pct_y == 50


def test_variant_fields_of_uneven_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_note": 1, "x": {"n": 3, "deep": {"list": [{"r": 0.5}]}}, "y": 7, "z": null}')
    (tmp_path / "b.json").write_text('{"w": {"n": "three", "deep": {"list": []}}}')
    (tmp_path / "c.json").write_text('not json')
    values = readers.read_variant(spark, str(tmp_path), "key")
    fields = {"n": ("$.n", "int"), "r": ("$.deep.list[0].r", "double")}
    got = {r.key: (r.n, r.r) for r in readers.variant_fields(values, fields).collect()}
    assert got == {"x": (3, 0.5), "y": (None, None), "z": (None, None), "w": (None, None)}
    problems = {(r.key, r.field, r.problem) for r in readers.variant_problems(values, fields).collect()}
    assert problems == {("w", "n", "wrong type"), ("w", "r", "missing"), ("y", "n", "missing"),
                        ("y", "r", "missing"), ("z", "n", "missing"), ("z", "r", "missing")}
