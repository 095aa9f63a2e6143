"""Independent sources and the title join against comparing all pairs."""

import itertools
import random
import re
import unicodedata
from difflib import SequenceMatcher
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import inbox as I
from loomwork.operators import replicas


def comparable(title):
    low = "".join(c for c in unicodedata.normalize("NFKD", (title or "").lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\([^)]{1,40}\)", " ", low)).strip()


def brute(rows, least=0.9):
    """key -> smallest key of its source, looking at every pair of rows of a group in key order."""
    up = {k: k for _, k, _, _ in rows}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for (g, k, o, t), (h, m, p, u) in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        same = (o or "").strip().lower() == (p or "").strip().lower()
        if g == h and (same or SequenceMatcher(None, comparable(t), comparable(u), autojunk=False).ratio() >= least):
            a, b = sorted((top(k), top(m)))
            up[b] = a
    return {k: top(k) for k in up}


def noisy(r, title):
    chars = list(title)
    for _ in range(r.randint(0, 9)):
        at = r.randrange(len(chars) + 1)
        if r.random() < 0.5 and len(chars) > 1:
            del chars[min(at, len(chars) - 1)]
        else:
            chars.insert(at, r.choice("abcdefghij k"))
    return "".join(chars)


def headlines(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    stems = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(n // 4)]
    rows = []
    for k in range(n):
        t = noisy(r, r.choice(stems)) if r.random() < 0.8 else r.choice(["", None, "a", "ab", "abc", "(EFE)", "Ä b!"])
        rows.append((r.choice([1, 1, 2]), k * 3 + 1, r.choice([f"o{k}", f"o{k}", f" O{k % 9} "]), t + " (EFE)" if t and r.random() < 0.3 else t))
    return rows


FIELDS = "group long, key long, outlet string, title string"


@pytest.mark.parametrize("seed", [1, 2])
def test_sources_equal_comparing_all_pairs(spark, seed):
    rows = headlines(seed, 260)
    got = {r["key"]: r["source"] for r in replicas.source_of(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("small", [0, 100])
def test_groups_of_any_size_have_the_same_sources(spark, small):
    rows = headlines(3, 260)
    got = {r["key"]: r["source"] for r in replicas.source_of(spark.createDataFrame(rows, FIELDS), small=small).collect()}
    assert got == brute(rows)


def test_small_groups_are_compared_without_blocks(spark, monkeypatch):
    def blocked(*_):
        raise AssertionError("small groups are written as blocks")

    monkeypatch.setattr(replicas, "shown", blocked)
    rows = [(k // 12, k, o, t) for _, k, o, t in headlines(6, 200)]
    got = {r["key"]: r["source"] for r in replicas.source_of(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == brute(rows)


def test_few_pairs_of_small_groups_are_looked_at_one_by_one(monkeypatch):
    monkeypatch.setattr(replicas, "PAIRS", 50)
    groups = [[comparable(t) for _, _, _, t in headlines(seed, 30)] for seed in range(20)] + [["only one"], ["", ""], ["ab", "ba", "año"]]
    titles, sizes = [t for g in groups for t in g], [len(g) for g in groups]
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    got = set(replicas._possible(titles, start, np.arange(len(titles)) - start, 0.9))
    every = [(i, j) for i in range(len(titles)) for j in range(start[i], i)]
    want = {(i, j) for i, j in every if replicas.ratio(titles[j], titles[i]) >= 0.9}
    assert want and want <= got and len(got) < len(every) / 5


def test_every_similar_pair_is_a_candidate_and_few_others_are(spark):
    rows = [(1, k, f"o{k}", t) for _, k, _, t in headlines(5, 400)]
    nodes = replicas.title_nodes(spark.createDataFrame(rows, FIELDS)).withColumn("root", F.col("node"))
    titles = {r["node"]: r["title"] for r in nodes.collect()}
    got = {(r["a"], r["b"]) for r in replicas.candidates(replicas.shown(nodes), nodes).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(titles), 2) if max(replicas.ratio(titles[a], titles[b]), replicas.ratio(titles[b], titles[a])) >= 0.9}
    assert want and want <= got
    assert len(got) < 0.1 * len(titles) * (len(titles) - 1) / 2
    with pytest.raises(ValueError):
        replicas.shown(nodes, 0.7)


def test_copies_of_one_note_do_not_meet_each_other(spark, monkeypatch):
    """Three thousand slightly different copies: components come from neighbours, candidates stay few."""
    r = random.Random(7)
    stem = "the minister announces a new bridge over the river in the far north of the country"
    rows = [(1, k, f"o{k}", f"{stem} {r.randrange(10**4)}" if k % 3 else f"{r.randrange(10**4)} {stem}") for k in range(3000)] + [(1, 5000, "x", "an entirely other headline about the weather today")]
    met = []
    plain = replicas.candidates
    monkeypatch.setattr(replicas, "candidates", lambda *a: met.append(plain(*a).count()) or plain(*a))
    d = spark.createDataFrame(rows, FIELDS)
    assert {tuple(x) for x in replicas.independent_sources(d).collect()} == {(1, 2)}
    assert sum(met) < 50_000, met


def test_one_agency_text_in_five_outlets_is_one_source(spark):
    title = "El Canal de Panamá anuncia un nuevo calado para los buques"
    spelt = [title, f"(EFE) {title}", title.upper(), title + "!", title.replace("un nuevo", "nuevo")]
    items = [(1, i, f"o{i}", t, "economy", True, "2024-01-05 00:00:00") for i, t in enumerate(spelt)]
    items += [(2, 10 + i, f"o{i}", t, None, False, None) for i, t in enumerate(["one thing happened in the city", "quite another story from the harbour", "elections announced for the autumn"])]
    d = spark.createDataFrame(items, "group long, id long, outlet string, title string, topic string, local boolean, at string")
    d = d.withColumn("pub_ts", F.col("at").cast("timestamp_ntz")).withColumn("det_ts", F.lit(None).cast("timestamp_ntz"))
    at = F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")
    got = {r["group"]: r for r in I.topics(d, at, {"evidence": 100}, {"economy": 8000}, ("economy",)).collect()}
    assert (got[1]["n_outlets"], got[1]["n_sources"], got[1]["evidence"], got[1]["state"], got[1]["tenths"]) == (5, 1, 1667, "insufficient", 167)
    assert (got[2]["n_outlets"], got[2]["n_sources"], got[2]["evidence"], got[2]["state"]) == (3, 3, 5000, "sufficient")
    # three days and a half after the newest item: (168 - 96) / (168 - 24)
    assert (got[1]["urgency"], got[1]["novelty"], got[1]["impact"]) == (5000, 10_000, 8000)
    assert (got[2]["urgency"], got[2]["novelty"], got[2]["impact"]) == (0, 0, 3000)
    assert replicas.source_of(d.selectExpr("group", "id AS key", "outlet", "title").limit(0)).collect() == []


def test_disk_does_not_grow_as_the_pairs_of_titles(spark):
    """Titles of few different words share most grams; blocks of them are compared without writing or shuffling pairs."""
    r = random.Random(11)
    words = ["the", "minister", "of", "trade", "opens", "new", "canal", "bridge", "port", "today"]
    rows = [(1, k, f"o{k}", " ".join(r.choices(words, k=12)) + ("" if k % 3 else "!")) for k in range(300)] + [(2, 1000 + k, f"o{k}", f"{k // 2} note on the harbour and the {'b' if k // 2 else 'sea'}") for k in range(6)]
    d = spark.createDataFrame(rows, FIELDS)
    assert {x["key"]: x["source"] for x in replicas.source_of(d).collect()} == brute(rows)
    nodes = replicas.title_nodes(d).withColumn("root", F.col("node"))
    plan = replicas._joined(replicas.shown(nodes, block=64), 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    rebuilt = {tuple(x) for x in replicas.candidates(replicas.shown(nodes, block=64), nodes).collect()}
    assert rebuilt == {tuple(x) for x in replicas.candidates(replicas.shown(nodes), nodes).collect()}


def test_blocks_leave_only_pairs_with_characters_enough_in_common():
    """What bits leave is narrowed for many titles at once, and no pair with enough in common is lost."""
    r = random.Random(17)
    words = ["the", "minister", "of", "trade", "opens", "new", "canal", "bridge", "port", "today"]
    titles = [" ".join(r.choices(words, k=12)) for _ in range(150)]
    titles += [t.replace("canal", "channel")[r.randrange(3) :] for t in titles[:60]] + ["", "x", "ab 1" * 90, "ab 1" * 90 + "c"]
    n = len(titles)
    assert all(c == replicas._common(titles[i], titles[n - 1 - i][: replicas.LONG]) for i, c in zip(range(n - 2), replicas._commons(replicas._masks(replicas._codes(titles)), replicas._codes(titles), np.arange(n - 2), n - 1 - np.arange(n - 2)), strict=True))
    bits = replicas._bits(titles).tobytes()
    block = SimpleNamespace(b=0, b2=0, low="g", high="g", low2="g", high2="g", g=["g"] * n, g2=["g"] * n, root=list(range(n)), root2=list(range(n)), title=titles, title2=titles, bits=bits, bits2=bits)
    enough = lambda i, j: 2 * replicas._common(titles[i], titles[j]) >= 0.9 * (len(titles[i]) + len(titles[j]))
    found = set(replicas._close(block, 0.9))
    near = {(i, j) for i, j in itertools.combinations(range(n), 2) if enough(i, j)}
    similar = {(i, j) for i, j in near if min(map(len, (titles[i], titles[j]))) and max(replicas.ratio(titles[i], titles[j]), replicas.ratio(titles[j], titles[i])) >= 0.9}
    assert similar and similar <= found
    assert all(enough(i, j) for i, j in found)
