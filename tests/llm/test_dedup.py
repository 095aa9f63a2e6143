import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import jaccard, substring
from loomwork.llm._common import components
from loomwork.llm._words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- words -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.lists(st.text(alphabet="ab \t\né\xa0\x1c日", max_size=30), max_size=6))
def test_words_equal_the_pattern(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    w = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    want = [WORD.findall(t) for t in texts]
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == want
    flat = [x for words in want for x in words]
    for k in (1, 2, 3):
        runs = w.runs(k)
        by = {}
        for i, h in enumerate(runs):
            by.setdefault(tuple(flat[i : i + k]), set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


# ---- substring dedup -------------------------------------------------------------------------------------------


def brute(rows):
    """(id, text) -> n_words, n_removed, kept, with windows judged on the input."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus(seed=0):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    shared, rows = [say(n) for n in (50, 51, 80, 400)], []
    for i in r.sample(range(1000), 60):
        t = say(r.randrange(0, 120))
        for p in r.sample(shared, r.randrange(0, 3)):
            a = r.randrange(0, max(1, len(p) - 49))
            t += p[a : a + r.randrange(49, 90)] + say(r.randrange(0, 20))
        rows.append((i, r.choice([" ", "\n", "  "]).join(t)))
    rows += [(rows[3][0] + 2000, rows[3][1]), (rows[3][0], rows[3][1]), (5000, "z " * 300), (4000, "z " * 200), (3000, " ".join(["p q r"] * 90)), (3001, " ".join(["q r p"] * 60))]
    return rows


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_collide_in_polynomials_differ(spark):
    """The two words hash alike under every polynomial with an odd base modulo 2**64."""
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    shared = ["w%d" % i for i in range(49)]
    rows = [(1, " ".join([*shared, one])), (2, " ".join([*shared, two])), (3, " ".join([*shared, one, "tail"]))]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 50}


def test_batches_of_the_query_are_compacted(spark):
    rows = corpus(9)
    index = substring.FingerprintIndex(spark, 4)
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), index=index).collect()
    assert index.compactions == substring.BATCHES - 2 > 0 and not index.runs
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == brute(rows)


def test_common_passages_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring, "HEAVY", 3)
    rows = corpus(3)
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (2, 2), (5, 2)])
def test_substring_equals_brute_force(spark, batches, fanout):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.dedup(d, batches, fanout).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_places_inside_one_text(spark, batches):
    """A text that repeats passages inside itself, of which earlier texts hold parts; two texts under one doc_id."""
    r = random.Random(11)
    say = lambda n: ["w%d" % r.randrange(300) for _ in range(n)]
    rows = []
    for k in range(12):
        p, q = say(90), say(70)
        a = r.randrange(0, 30)
        rows += [(10 * k, " ".join(p[a : a + 58] + say(9))), (10 * k + 1, " ".join(say(5) + q[3:60])), (10 * k + 5, " ".join((p + q) * 4)), (10 * k + 5, " ".join(say(20) + p + q + p))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.dedup(d, batches).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == brute(rows)


def test_substring_long_text_in_chunks(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(substring, "_CHUNK", 64)
    batch_rows = list(rows)
    import pyarrow as pa

    def segments(chunk):
        monkeypatch.setattr(substring, "_CHUNK", chunk)
        b = pa.RecordBatch.from_arrays([pa.array([i for i, _ in batch_rows]), pa.array(range(len(batch_rows))), pa.array([t for _, t in batch_rows])], names=["doc_id", "tk", "text"])
        out = pa.Table.from_batches(list(substring._scan(iter([b])))).to_pylist()
        return {(r["tk"], s, r["anchor"]) for r in out for s in range(r["s"], r["s"] + r["m"])}

    assert segments(64) == segments(1 << 23)


def test_substring_awkward_rows(awkward, nothing):
    d = awkward.withColumn("tk", F.lit("clash")).withColumn("kept_text", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = substring.dedup(d)
    assert "tk" in got.columns
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()), key=repr) == brute(rows)
    same = {(r["doc_id"], r["kept_text"]) for r in substring.dedup(awkward, respace=False).where("n_removed = 0").collect()}
    assert same <= set(rows)
    assert substring.dedup(nothing).collect() == []


def test_digest_query(spark):
    got = {r["doc_id"]: r for r in substring.op5_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i, n, gone, kept in brute(rows):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


# ---- Jaccard join ----------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[bool(a) and len(a & b) * 5 >= 4 * len(a | b) for b in sets] for a in sets]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near[i][j] and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        same = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i] and rows[j][0] is not None]
        out.append((d, min(ids) if ids else None, min(same) if same else None, sum(near[i]) - 1) if sets[i] else (d, d, d, 0))
    return sorted(out, key=repr)


def near_copies(seed=2, n=90):
    r = random.Random(seed)
    say = lambda k: ["w%d" % r.randrange(500) for _ in range(k)]
    bases, rows = [say(k) for k in (60, 150, 400, 9)], []
    for i in range(n):
        t = list(r.choice(bases)) if r.random() < 0.8 else say(r.randrange(0, 80))
        for _ in range(r.randrange(0, 5)):
            if t:
                t[r.randrange(len(t))] = "x%d" % r.randrange(9)
        rows.append((i, " ".join(t)))
    return rows + [(i + 500, t) for i, t in rows[:9]]


def joined(df):
    return sorted(((r["doc_id"], r["class_id"], r["rep_id"], r["n_links"]) for r in df.collect()), key=repr)


def test_join_equals_brute_force(spark):
    rows = near_copies()
    assert joined(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_join(rows)


def test_large_buckets_and_blocks(spark, monkeypatch):
    """Leaders, deeper levels and blocks of a group take over when everything is made small."""
    rows = near_copies(7, 120)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    plain = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda cells, minimum, level=0, *a: plain(cells, minimum, level, 3, 12, 10))
    assert joined(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_join(rows)


def test_join_links_of_rows_without_an_id(spark):
    """Near copies that only rows with a null id hold link like any other, on either side."""
    r = random.Random(8)
    a, b = (["w%d" % r.randrange(500) for _ in range(200)] for _ in range(2))
    rows = [(1, a), (None, [*a[:-1], "z"]), (None, [*a[:-1], "z"]), (None, b), (None, ["y", *b[1:]]), (4, ["x", *b[1:]]), (None, [*a[:-2], "q", "z"])]
    rows = [(i, " ".join(t)) for i, t in rows]
    want = brute_join(rows)
    assert want[0] != (1, 1, 1, 0)
    assert joined(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_join_awkward_rows(awkward, nothing):
    d = awkward.withColumn("node", F.lit("clash")).withColumn("tk", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert joined(jaccard.jaccard_join(d)) == brute_join(rows)
    assert jaccard.jaccard_join(nothing).collect() == []
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns
    want = [(i, t) for i, t in rows if not WORD.findall(t or "")] + [(1, rows[0][1]), (7, rows[6][1]), (9, "one two"), *((r[0], r[1]) for r in rows[13:])]
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    near = {(i, c) for i, c, _, _ in brute_join(rows)}
    stays = {i for i, c in near if i == c}
    assert {i for i, _ in got} == stays | {None} and len(got) == len(set(got)) and set(got) <= set(want) | set(rows)


def test_recall_of_runs():
    assert jaccard.runs_for(0.9995) >= 14
    r = np.random.default_rng(0)
    hits = 0
    for _ in range(300):
        a = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = np.concatenate([a[:267], r.integers(0, 1 << 63, 33, dtype=np.uint64)])  # 267 / 333 = 0.80
        sig = jaccard._embed([np.sort(a), np.sort(b)])
        path = np.broadcast_to(jaccard.mix(np.arange(1, jaccard.runs_for(0.9995) + 1, dtype=np.uint64)), (2, jaccard.runs_for(0.9995)))
        for _ in range(jaccard.DEPTH):
            path = jaccard.step(path, sig)
        hits += (path[0] == path[1]).any()
    assert hits >= 294


def test_runs_hold_the_recall_over_sketches():
    r = np.random.default_rng(1)
    for recall, similarity in ((0.9995, 0.8), (0.99, 0.8), (0.999, 0.7)):
        runs = jaccard.runs_for(recall, similarity)
        share = r.binomial(jaccard.TOKENS, similarity, 1_000_000) / jaccard.TOKENS
        alive = np.array([jaccard.lives(m / jaccard.TOKENS) for m in range(jaccard.TOKENS + 1)])[(share * jaccard.TOKENS).astype(int)]
        lost = ((1 - share**jaccard.DEPTH * alive) ** runs).mean()
        assert lost <= (1 - recall) * 1.02
        assert abs(lost - jaccard.missed(runs, similarity)) < 0.02 * lost


def test_components_match_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
