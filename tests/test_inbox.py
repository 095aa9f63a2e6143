"""Operators over grouped topics, answers and clusters, against plain versions."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import analytics as A
from loomwork.operators import clusters as C
from loomwork.operators import evaluation as X
from loomwork.operators import inbox as I


def vectors(n=60, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, 5))
    rows = []
    for i in range(n):
        v = centre[r.integers(6)] + r.normal(size=5) * 0.4
        rows.append((i * 3 + 1, None if i % 7 == 0 else float(r.integers(0, 300)), (v / np.linalg.norm(v)).tolist()))
    return rows


def close(rows, least, window):
    out = []
    for (a, h, v), (b, g, w) in itertools.combinations(rows, 2):
        c = float(np.dot(v, w))
        if c >= least and (h is None or g is None or abs(h - g) <= window):
            out.append((a, b, c))
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_pairs_in_time(spark, block):
    rows = vectors()
    d = spark.createDataFrame(rows, "key long, hours double, v array<double>")
    got = sorted((r["a"], r["b"], round(r["cosine"], 9)) for r in A.pairs_in_time(d, "key", "v", "hours", 0.6, 72, block).collect())
    assert got == sorted((a, b, round(c, 9)) for a, b, c in close(rows, 0.6, 72))
    assert A.pairs_in_time(d.limit(0), "key", "v", "hours", 0.6, 72).collect() == []


def test_clusters_equal_pair_by_pair_merging(spark):
    """Groups as sets of members, looked at afresh for every pair."""
    for seed, most in ((1, 40), (2, 6), (3, 3)):
        rows = vectors(80, seed)
        pairs = close(rows, 0.6, 72)
        known = {k: (h, np.array(v)) for k, h, v in rows}
        group = {k: frozenset([k]) for k in known}
        for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            both = group[a] | group[b]
            times = [known[k][0] for k in both if known[k][0] is not None]
            cross = np.mean([known[x][1] @ known[y][1] for x in group[a] for y in group[b]])
            if group[a] != group[b] and len(both) <= most and (not times or max(times) - min(times) <= 168) and cross >= 0.55:
                for k in both:
                    group[k] = both
        d = spark.createDataFrame(rows, "key long, hours double, v array<double>")
        p = spark.createDataFrame(pairs, "a long, b long, cosine double")
        got = {r["key"]: r["group"] for r in C.clusters(d, p, 0.6, 0.05, most, 168).groups.collect()}
        assert got == {k: min(g) for k, g in group.items()}


def test_topics_by_words_and_phrases(spark):
    rules = {"a": ("red", "blue sky"), "b": ("red", "green"), "c": ("c++",)}
    texts = {"red green": "b", "red": "a", "a blue sky, red green": "a", "blue  sky": "other", "use c++ now": "c", "": "other", "redgreen": "other", None: "other"}
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["x"] for r in d.select("t", A.topic_of(F.col("t"), rules).alias("x")).collect()} == texts


def test_topic_states_and_overrides(spark):
    rows = [
        (1, 1, "A", "one story about the harbour", "x", True, "2024-01-01 00:00:00", None), (1, 2, "a", "quite another one", "y", False, None, "2024-01-05 00:00:00"),
        (2, 3, "B", "b", "y", False, None, None), (3, 4, "C", "c", None, None, None, None), (4, 5, "D", "one more about the bridge", "z", False, None, "2023-12-20 00:00:00"),
        (4, 6, "E", "and the reply of the port", "z", False, "2024-01-05 06:00:00", None),
    ]
    d = spark.createDataFrame(rows, "group long, id long, outlet string, title string, topic string, local boolean, pub_ts string, det_ts string")
    for c in ("pub_ts", "det_ts"):
        d = d.withColumn(c, F.col(c).cast("timestamp_ntz"))
    new = spark.createDataFrame([(2, 1, None, 3)], "group long, relevance long, impact long, urgency long")
    links = spark.createDataFrame([(2, "linked"), (2, "pending"), (4, "pending"), (4, "pending")], "group long, status string")
    w = {"relevance": 30, "impact": 25, "urgency": 20, "novelty": 15, "evidence": 10}
    at = F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")
    got = {r["group"]: r for r in I.topics(d, at, w, {"x": 9000, "y": 100}, ("x",), new, I.context(links)).collect()}
    assert (got[1]["state"], got[1]["n_sources"], got[1]["pending"], got[1]["topic"], got[1]["recirculated"]) == ("insufficient", 1, 0, "x", True)
    # 96 hours between the dates: (720 - 96) / (720 - 72)
    assert (got[1]["relevance"], got[1]["urgency"], got[1]["novelty"], got[1]["evidence"]) == (10_000, 10_000, 9630, 1667)
    assert (got[2]["state"], got[2]["relevance"], got[2]["impact"], got[2]["urgency"], got[2]["evidence"], got[2]["pending"]) == ("partial", 1, 100, 3, 6667, 1)
    assert (got[3]["topic"], got[3]["impact"], got[3]["urgency"], got[3]["novelty"], got[3]["state"]) == (None, 3000, 0, 0, "insufficient")
    assert (got[4]["impact"], got[4]["state"], got[4]["pending"], got[4]["n_sources"]) == (3000, "partial", 2, 2)
    strict = {r["group"]: r for r in I.topics(d, at, w, {}, (), criteria=I.Criteria(urgency=(1, 2), base_impact=7, enough_sources=1)).collect()}
    assert (strict[1]["urgency"], strict[1]["impact"], strict[4]["state"], strict[4]["urgency"]) == (0, 7, "sufficient", 0)
    kept = I.keep(I.topics(d, at, w, {}, ()), topic_names=("unclassified", "y")).collect()
    assert {r["group"] for r in kept} == {2, 3}
    assert [I.adaptive_unit(n) for n in (45, 46, 210, 211)] == ["day", "week", "week", "month"]


def test_answers_fall_back_and_abstain(spark):
    top = [(1, 1, 10, 0.9, 5.0, 0.0), (1, 2, 11, 0.5, 4.0, 0.9), (2, 1, 10, 0.9, 5.0, 0.7), (3, 1, 12, 0.1, 5.0, 1.0), (4, 1, 10, 0.5, 0.0, 1.0), (4, 2, 11, 0.45, 0.0, 1.0), (5, 1, 10, 0.9, 5.0, 0.2)]
    t = spark.createDataFrame(top, "query long, rank int, doc long, cosine double, lexical double, coverage double")
    decided = spark.createDataFrame([(1, 10, 0.59), (1, 11, 0.6)], "query long, doc long, p double")
    corpus = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b")], "doc long, outlet string")
    got = {r["query"]: (r["outcome"], r["path"], r["n_cited"], r["best"], r["n_corpus"], r["n_outlets"]) for r in X.answers(t, decided, corpus).collect()}
    assert got == {1: ("answer", "decision", 1, 11, 3, 2), 2: ("answer", "lexical", 1, 10, 3, 2), 3: ("below_floor", "gate", 0, None, 3, 2), 4: ("no_margin", "gate", 0, None, 3, 2), 5: ("no_evidence", "lexical", 0, None, 3, 2)}
    runs = X.compared({"bm25": t, "hybrid": t.where("rank = 1")})
    assert runs.groupBy("method").count().collect() and runs.count() == len(top) + 5
    levels = spark.createDataFrame([(3, 5), (4, 5), (9, 5), (0, 1)], "v int, n int").select(X.normalised(F.col("v"), F.col("n")).alias("s"), X.nearest_level(F.lit(0.6), F.col("n")).alias("l")).collect()
    assert [(r["s"], r["l"]) for r in levels] == [(0.75, 2), (1.0, 2), (1.0, 2), (None, 0)]


def test_problems_of_answers(spark):
    q = spark.createDataFrame([(1, "choice", ["a", "b"], None), (2, "score", None, 4), (3, "yes_no", None, None), (4, "score", None, 4), (5, "choice", ["a"], None), (6, "yes_no", None, None)], "id long, kind string, options array<string>, levels int")
    g = spark.createDataFrame([(1, "c"), (2, "4"), (3, "1.5"), (4, "0.5"), (6, "maybe"), (9, "a")], "id long, value string")
    got = {r["id"]: r["problems"] for r in X.answer_problems(q, g).collect()}
    assert got == {1: ["unknown_option"], 2: ["range"], 3: ["range"], 4: ["type"], 5: ["missing"], 6: ["type"], 9: ["extra"]}


def test_written_index_answers_like_bm25(spark, tmp_path):
    texts = [(i, None if i == 3 else "" if i == 4 else " ".join(f"w{(i * j) % 11}" for j in range(1, 3 + i % 5)) + " common") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc long, text string")
    asked = spark.createDataFrame([(1, "w1 W1 common"), (2, "w7 unheard"), (3, ""), (4, None)], "query long, text string")
    A.write_index(docs, str(tmp_path / "index"))
    got, want = ({(r["query"], r["doc"]): round(r["score"], 9) for r in x.collect()} for x in (A.bm25_indexed(spark, str(tmp_path / "index"), asked), A.bm25(docs, asked)))
    assert got == want and {q for q, _ in got} == {1, 2}
    assert A.bm25_indexed(spark, str(tmp_path / "index"), asked.where("query = 3")).collect() == []


def test_chosen_topics_and_schema(spark):
    words = spark.createDataFrame([(k, "w") for k in range(4)], "key long, topic string")
    decided = spark.createDataFrame([(0, "d", 0.8, None), (1, None, None, "budget"), (2, None, 0.1, None)], "key long, option string, confidence double, reason string")
    got = [tuple(r) for r in X.chosen_topics(words, decided).orderBy("key").collect()]
    assert got == [(0, "d", "decision", 0.8, None), (1, "w", "words", None, "budget"), (2, "w", "words", None, "no_answer"), (3, "w", "words", None, None)]
    schema = X.answer_schema({"t": ("a", "b"), "s": 3, "y": None})
    assert schema["required"] == ["t", "s", "y"] and schema["properties"]["s"] == {"type": "integer", "enum": [0, 1, 2]} and schema["properties"]["y"] == {"type": "boolean"}


SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_slots_do_not_deal_all_news_to_few_tasks(spark):
    """News meet official series by five slots: a shuffle by slot would put all of them into five tasks."""
    from loomwork.plans import analytics, inbox

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (analytics.scored(spark, SF), inbox.series_links(spark, SF)):
            assert not re.search("SortMergeJoin .*LeftOuter", plan(df)) and re.search("BroadcastHashJoin .*LeftOuter", plan(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    links, values = spark.range(40).selectExpr("id", "id % 5 AS slot"), spark.createDataFrame([(s, y, s * y) for s in range(4) for y in (2000, 2003)], "slot long, year int, value long")
    want = {tuple(r) for r in I.series_links(links, values, "slot").collect()}
    assert len(want) == 40 and {r[-1] for r in want} == {"linked", "pending"}


def test_topics_read_orders_once(spark):
    from loomwork.plans import inbox

    assert "orders.parquet" not in plan(inbox.topic_scores(spark, SF))


def test_keys_beyond_the_limit_are_joined_without_broadcast(spark):
    from loomwork.operators.shared import near

    few = spark.range(4)
    assert "BroadcastHashJoin" in plan(spark.range(100).join(near(few, 4), "id")) and near(few, 3) is few
