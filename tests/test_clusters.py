"""Clusters in rounds against taking pair after pair."""

import random

import numpy as np
import pytest

from loomwork.operators import clusters as C
from test_inbox import close, vectors


def greedy(rows, pairs, least, most, span):
    """Groups as sets of members, looked at afresh for every pair."""
    known = {k: (h, np.array(v)) for k, h, v in rows}
    group = {k: frozenset([k]) for k in known}
    counts = {"merged": 0, "too_large": 0, "too_long": 0, "too_far": 0}
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if group[a] == group[b]:
            continue
        both = group[a] | group[b]
        times = [known[k][0] for k in both if known[k][0] is not None]
        if len(both) > most:
            counts["too_large"] += 1
        elif times and max(times) - min(times) > span:
            counts["too_long"] += 1
        elif sum(known[x][1] for x in group[a]) @ sum(known[y][1] for y in group[b]) / (len(group[a]) * len(group[b])) < least:
            counts["too_far"] += 1
        else:
            counts["merged"] += 1
            for k in both:
                group[k] = both
    return {k: min(g) for k, g in group.items()}, counts


def run(spark, rows, pairs, least, margin, most, span, limit):
    d = spark.createDataFrame(rows, "key long, hours double, v array<double>")
    p = spark.createDataFrame(pairs, "a long, b long, cosine double")
    made = C.clusters(d, p, least, margin, most, span, limit)
    counts = made.counts.first().asDict()
    assert counts.pop("pairs") == len(pairs)
    return {r["key"]: r["group"] for r in made.groups.collect()}, counts


@pytest.mark.parametrize("seed,most,span,limit", [(1, 40, 168, C.LIMIT), (2, 6, 100, 120)])
def test_rounds_equal_the_greedy_order(spark, seed, most, span, limit):
    rows = vectors(90, seed)
    pairs = close(rows, 0.6, 72)
    assert run(spark, rows, pairs, 0.6, 0.05, most, span, limit) == greedy(rows, pairs, 0.55, most, span)


def test_a_long_chain_is_done_by_blocks(spark, monkeypatch):
    """Each pair waits for the one before: a block takes hundreds in one go."""
    n, r = 1500, random.Random(2)
    rows = [(k, None, [1.0, r.random() * 0.01]) for k in range(n)]
    pairs = [(k, k + 1, 1 - k * 1e-5) for k in range(n - 1)]
    steps = []
    plain = C._step
    monkeypatch.setattr(C, "_step", lambda *a: steps.append(1) or plain(*a))
    got = run(spark, rows, pairs, 0.6, 0.05, 7, 168, 700)
    assert got == greedy(rows, pairs, 0.55, 7, 168)
    assert len(steps) <= 7


def test_ties_undated_items_and_nothing(spark):
    rows = [(k, None if k % 3 else float(k), [1.0, 0.0]) for k in range(12)]
    pairs = [(a, b, 1.0) for a in range(12) for b in range(a + 1, 12) if (a + b) % 2]
    for limit in (C.LIMIT, 9):
        assert run(spark, rows, pairs, 0.6, 0.05, 5, 6, limit) == greedy(rows, pairs, 0.55, 5, 6)
    assert run(spark, rows, [], 0.6, 0.05, 5, 6, 9) == ({k: k for k in range(12)}, {"merged": 0, "too_large": 0, "too_long": 0, "too_far": 0})
    assert run(spark, [], [], 0.6, 0.05, 5, 6, 9)[0] == {}


def test_many_small_blocks_are_gone_through_together(spark, monkeypatch, tmp_path):
    """The kernel is called by buckets, and not once for each of hundreds of components."""
    plain = C._kernel

    def counted(*rules):
        run = plain(*rules)

        def noted(left, right):
            with open(tmp_path / "calls", "a") as f:
                f.write(".")
            return run(left, right)

        return noted

    monkeypatch.setattr(C, "_kernel", counted)
    rows = [(k, float(k % 7), [1.0, k % 3 / 10]) for k in range(900)]
    pairs = [(k, k + 1, 0.9) for k in range(0, 900, 3)] + [(k + 1, k + 2, 0.8) for k in range(0, 900, 3)]
    assert run(spark, rows, pairs, 0.6, 0.05, 2, 168, C.LIMIT) == greedy(rows, pairs, 0.55, 2, 168)
    assert len((tmp_path / "calls").read_text()) <= C.BUCKETS
