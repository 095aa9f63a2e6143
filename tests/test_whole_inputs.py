"""Queries that take their whole input, against their SQL without its cuts."""

import datetime
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import analytics, relational
from loomwork.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "benchmark", "embeddings")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same_without(spark, name, *cuts):
    """The query's rows equal those of its registered SQL without the given texts."""
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = registry.oracle_sql()[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name,cut", [("bm25_topk", "[1:8]"), ("hybrid_search", "[1:8]"), ("abstention_gate", "[1:8]"), ("keyword_coverage", "[1:6]")])
def test_questions_are_whole(spark, name, cut):
    same_without(spark, name, cut)


def test_interval_links_take_all_events(spark):
    same_without(spark, "interval_links", "magnitude >= 95 AND ")


def test_interval_strongest_equals_pairs(spark):
    """Bounds to the microsecond, repeated keys and times, rows without a time, times before 1970."""
    r = random.Random(3)
    at = lambda base, us: None if us is None else base + datetime.timedelta(microseconds=us)
    hour = 3_600_000_000
    for base in (datetime.datetime(2024, 1, 5), datetime.datetime(1969, 12, 31)):
        left = [(i % 30, at(base, r.choice([None, 0, r.randrange(10 * hour), hour * r.randrange(20)]))) for i in range(40)]
        times = [base, *(x[1] for x in left if x[1])]
        edge = [r.choice(times) + datetime.timedelta(microseconds=r.choice([-3 * hour, 2 * hour]) + r.choice([-1, 0, 1])) for _ in range(60)]
        right = [(j, t, r.choice([1.0, 2.0, 3.0])) for j, t in enumerate([*edge, *(at(base, r.randrange(-5 * hour, 20 * hour)) for _ in range(60)), None])]
        a, b = spark.createDataFrame(left, "id long, at timestamp_ntz"), spark.createDataFrame(right, "q long, t timestamp_ntz, m double")
        order = F.struct((-F.col("m")).alias("m"), "t", "q")
        got = {x["id"]: (x["n"], x["best"]["q"]) for x in relational.interval_strongest(a, b, "id", "at", "t", 3, 2, order).collect()}
        want = {}
        for i, t in left:
            for q, when, m in right:
                if t and when and t - datetime.timedelta(hours=3) <= when <= t + datetime.timedelta(hours=2):
                    want.setdefault(i, []).append((-m, when, q))
        assert got == {i: (len(v), min(v)[2]) for i, v in want.items()}


def test_nearest_neighbours_have_no_floor(spark):
    same_without(spark, "nearest_neighbours", " WHERE cosine >= 0.3")


def test_nearest_rows_equal_brute_force(spark):
    """Many equal vectors, blocks of fewer rows than neighbours, pruning at every step."""
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(60, 4)), 1)
    v[20:35] = v[3]
    d = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i, x in enumerate(np.round(u @ u.T, 9)):
        want[3 * i] = sorted((-c, 3 * j) for j, c in enumerate(x) if j != i)[:5]
    for block in (4, 16, 1024):
        rows = analytics.nearest_rows(d, "id", "v", 5, block, 10).collect()
        assert {i: [x["b"] for x in sorted(rows, key=lambda x: x["rank"]) if x["a"] == i] for i in want} == {i: [j for _, j in w] for i, w in want.items()}


def test_blocks_are_even_whatever_the_keys(spark):
    """One key far from all others, and rows that all lack a date."""
    r = np.random.default_rng(5)
    v = r.normal(size=(90, 4))
    keys = [*range(89), 10**15]
    d = spark.createDataFrame([(k, None, x.tolist()) for k, x in zip(keys, v, strict=True)], "id long, hours double, v array<double>")
    sizes = [len(x["k"]) for x in analytics._block_pairs(d, "id", "v", 10).where("b = c").collect()]
    assert max(sizes) < 30 and sum(sizes) == 90
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(keys[i], keys[j]) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= 0.8}
    for got in (analytics.similar_pairs(d, "id", "v", 0.8, 10), analytics.pairs_in_time(d, "id", "v", "hours", 0.8, 72, 10)):
        assert {(x["a"], x["b"]) for x in got.collect()} == want


def test_blocks_are_not_shuffled_against_each_other(spark):
    """Pairs of blocks are read from the written blocks: no exchange, whose size would grow as the pairs do."""
    d = spark.createDataFrame([(i, float(i % 50), [1.0, i / 7]) for i in range(64)], "id long, hours double, v array<double>")
    for met in (analytics._block_pairs(d, "id", "v", 4), analytics.pairs_in_time(d, "id", "v", "hours", 0.8, 5, 4)):
        plan = met._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        assert "Exchange" not in plan and ("NestedLoop" in plan or "CartesianProduct" in plan)


def test_equal_keys_of_two_blocks_make_no_pair(spark):
    d = spark.createDataFrame([(i // 2, None, [1.0, 0.0]) for i in range(24)], "id long, hours double, v array<double>")
    for got in (analytics.similar_pairs(d, "id", "v", 0.8, 5), analytics.pairs_in_time(d, "id", "v", "hours", 0.8, 5, 5)):
        rows = [(r["a"], r["b"]) for r in got.collect()]
        assert all(a < b for a, b in rows) and len(rows) == 4 * 12 * 11 // 2


def test_components_of_a_long_chain_take_few_jobs(spark):
    """The driver's memory goes by the plans it has made: a chain is not walked in rounds; cut into forests it gives the same."""
    chain = [(i + 1, i) for i in range(600)]
    random.Random(3).shuffle(chain)
    e = spark.createDataFrame(chain + [(1000, 1001), (7, 7), (2000, 2000)], "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("chain", "components")
    got = {tuple(r) for r in analytics.components(e).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "")
    assert got == {(i, 0) for i in range(601)} | {(1000, 1000), (1001, 1000)}
    assert jobs <= 8, jobs
    assert {tuple(r) for r in analytics.components(e, most=40).collect()} == got


def test_the_best_of_tasks_hold_the_best_of_all(spark):
    r = random.Random(5)
    rows = [(q, d, r.choice([1.0, 2.0, 3.0, 3.0000000001, 2.0000000004]) if d % 7 else r.random()) for q in range(4) for d in range(500)]
    s = spark.createDataFrame(rows, "query long, doc long, score double").repartition(3)
    few = analytics.first_of_tasks(s, 5, held=64)
    best = lambda df: sorted((x["query"], x["rank"], x["doc"]) for x in analytics.top_k(df, 5).collect())
    assert best(few) == best(s) and analytics.first_of_tasks(s.limit(0), 5).collect() == []
