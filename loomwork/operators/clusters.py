"""Greedy average-link clusters along similar pairs, with the reasons for which pairs did not merge.

Pairs are taken by (-cosine, a, b); the two groups of a pair merge unless they would be too large, span too long, or their mean
cross-similarity, read off the sums of their vectors, is too low. What a pair does depends on its two groups alone, and a
group only changes by pairs that touch it. So a pair's turn has come as soon as no earlier pair that touches either of its
groups is left, wherever other pairs stand, and any order that keeps to this gives the greedy result.

Components of the pair graph are independent; those of up to `limit` pairs are done by one task each, many small ones
by one together. A larger one is done
in rounds. Every group points to the partner of its first pair; the components of these pointers are the blocks, and each
block goes through the pairs inside it, stopping at groups that an earlier pair leads out of. A group's first pair is inside
its block, and so is whatever it waits for: each round does the first pair of every group, at least. Of a block of more than
`limit` pairs, such as a chain where each pair waits for the one before, only the earlier first pairs make blocks in this
round; what they wait for is earlier still. Once at most `limit` pairs are left, one task does them. Groups only grow, so pairs of groups that are too large together are counted and dropped without waiting.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.analytics import components
from loomwork.operators.shared import drop, written

#: Pairs that one task goes through.
LIMIT = 2_000_000
#: Blocks go to tasks by buckets, at least so many, of about so many groups or pairs: one call of the kernel for each bucket.
BUCKETS, BUCKET = 32, 50_000
REFUSALS = ("too_large", "too_long", "too_far")


class Clusters(NamedTuple):
    """groups: (key, group), the group named by its smallest key; counts: one row of pairs, merged and the refusals."""

    groups: DataFrame
    counts: DataFrame


class _State(NamedTuple):
    groups: DataFrame  # g, size, total, early, late
    edges: DataFrame  # x, y, cosine, a, b: pairs left, between two groups
    members: DataFrame  # key, g
    counts: DataFrame | None  # merged and refusals of every task


_OUT = "kind string, g long, top long, size long, total array<double>, early double, late double, x long, y long, cosine double, a long, b long, " + ", ".join(f"{c} long" for c in ("merged", *REFUSALS))
_COUNTS = ("merged", *REFUSALS)


def _rows(*columns, chunk: int = 50_000):
    """Rows of columns as plain values, of which only a chunk is held at a time."""
    for at in range(0, len(columns[0]), chunk):
        yield from zip(*[c[at : at + chunk].tolist() for c in columns], strict=True)


def _kernel(least: float, most: int, span_hours: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("g")
        keys, n = left["g"].to_numpy(), len(left)
        # what is known of a group stands at its smallest member; `up` leads there
        up, size, total = list(range(n)), left["size"].tolist(), [np.array(t, dtype=float) for t in left["total"]]
        early, late = left["early"].tolist(), left["late"].tolist()
        wait = [(c, int(a), int(b)) if a == a and a is not None else None for c, a, b in zip(left["wc"], left["wa"], left["wb"], strict=True)]
        counts, rest = dict.fromkeys(_COUNTS, 0), []

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        order = np.lexsort((right["b"], right["a"], -right["cosine"]))
        right = right.iloc[order]
        ends = np.searchsorted(keys, right[["x", "y"]].to_numpy()) if len(right) else np.empty((0, 2), dtype=int)
        for (i, j), cosine, a, b in _rows(ends, right["cosine"], right["a"], right["b"]):
            x, y = sorted((top(i), top(j)))
            if x == y:
                continue
            rank = (-cosine, a, b)
            if size[x] + size[y] > most:
                # groups only grow: this pair need not wait for its turn
                counts["too_large"] += 1
            elif (wait[x] is not None and wait[x] < rank) or (wait[y] is not None and wait[y] < rank):
                # an earlier pair leads out of the block: whatever comes after waits too
                wait[x], wait[y] = (rank if w is None else min(w, rank) for w in (wait[x], wait[y]))
                rest.append((x, y, cosine, a, b))
            elif max(late[x], late[y]) - min(early[x], early[y]) > span_hours:
                counts["too_long"] += 1
            elif float(total[x] @ total[y]) < least * size[x] * size[y]:
                counts["too_far"] += 1
            else:
                counts["merged"] += 1
                up[y], size[x], total[x] = x, size[x] + size[y], total[x] + total[y]
                early[x], late[x] = min(early[x], early[y]), max(late[x], late[y])
                wait[x] = min((w for w in (wait[x], wait[y]) if w is not None), default=None)
        tops = [top(i) for i in range(n)]
        names = [c.split()[0] for c in _OUT.split(", ")]
        lead = [i if i == t else None for i, t in enumerate(tops)]
        at = lambda values: [None if i is None else values[i] for i in lead]
        groups = pd.DataFrame({"kind": "g", "g": keys, "top": keys[tops], "size": pd.array(at(size), "Int64"), "total": at(total), "early": at(early), "late": at(late)})
        left_over = [(top(x), top(y), c, a, b) for x, y, c, a, b in rest]
        edges = pd.DataFrame([(int(keys[x]), int(keys[y]), c, a, b) for x, y, c, a, b in left_over if x != y], columns=["x", "y", "cosine", "a", "b"]).assign(kind="e")
        done = pd.DataFrame([{"kind": "c", **counts}])
        out = pd.concat([f for f in (groups, edges, done) if len(f)]).reindex(columns=names)
        out["total"] = [t if isinstance(t, np.ndarray) else None for t in out["total"]]
        whole = ["g", "top", "size", "x", "y", "a", "b", *_COUNTS]
        return out.astype(dict.fromkeys(whole, "Int64"))

    return run


def _step(s: _State, block: DataFrame, rules: tuple) -> _State:
    """Goes through the pairs inside blocks of groups, (g, block); groups that are in none stay as they are."""
    most = rules[1]
    placed = s.groups.join(block, "g", "left")
    side = lambda c: block.select(F.col("g").alias(c), F.col("block").alias(f"b{c}"))
    edges = s.edges.join(side("x"), "x", "left").join(side("y"), "y", "left")
    inside = edges.where("bx = by").select(F.col("bx").alias("block"), "x", "y", "cosine", "a", "b")
    outside = edges.where("NOT coalesce(bx = by, false)").select("x", "y", "cosine", "a", "b")
    rank = F.struct((-F.col("cosine")).alias("c"), "a", "b")
    ends = outside.select(F.col("x").alias("g"), rank.alias("r")).union(outside.select(F.col("y").alias("g"), rank.alias("r")))
    first = ends.groupBy("g").agg(F.min("r").alias("r")).select("g", F.col("r.c").alias("wc"), F.col("r.a").alias("wa"), F.col("r.b").alias("wb"))
    left = placed.where("block IS NOT NULL").join(first, "g", "left")
    # blocks know nothing of each other, so any number of them is gone through together as if it were one
    n = max(BUCKETS, -(-max(block.count(), s.edges.count()) // BUCKET))
    bucket = F.pmod(F.xxhash64("block"), F.lit(n)).alias("bucket")
    out = written(left.groupBy(bucket).cogroup(inside.groupBy(bucket)).applyInPandas(_kernel(*rules), _OUT), "clusters")
    led = out.where("kind = 'g'").select("g", "top")
    to = lambda df, c: df.join(led.select(F.col("g").alias(c), F.col("top").alias("_top")), c, "left").withColumn(c, F.coalesce("_top", c)).drop("_top")
    names = ["g", "size", "total", "early", "late"]
    groups = out.where("kind = 'g' AND g = top").select(*names).union(placed.where("block IS NULL").select(*names))
    more = out.where("kind = 'e'").select("x", "y", "cosine", "a", "b").union(to(to(outside, "x"), "y").select("x", "y", "cosine", "a", "b"))
    counts = out.where("kind = 'c'").select(*_COUNTS)
    groups = written(groups, "clusters")
    size = lambda c: groups.select(F.col("g").alias(c), F.col("size").alias(f"s{c}"))
    left_over = written(more.where("x <> y").join(size("x"), "x").join(size("y"), "y"), "clusters")
    hopeless = F.col("sx") + F.col("sy") > most
    counts = counts.union(left_over.where(hopeless).agg(F.count(F.lit(1)).alias("n")).select(*[F.col("n") if c == "too_large" else F.lit(0).cast("long") for c in _COUNTS]))
    counts = counts if s.counts is None else s.counts.union(counts)
    edges = left_over.where(~hopeless).select("x", "y", "cosine", "a", "b")
    done = _State(groups, *(written(df, "clusters") for df in (edges, to(s.members, "g").select("key", "g"), counts)))
    drop(left_over)
    drop(out, *[df for df in s if df is not None])
    return done


def _first_choices(edges: DataFrame) -> DataFrame:
    """(g, r, other): each group's first pair and its partner there."""
    rank = F.struct((-F.col("cosine")).alias("c"), "a", "b")
    ends = edges.select(F.col("x").alias("g"), F.col("y").alias("other"), rank.alias("r")).union(edges.select(F.col("y").alias("g"), F.col("x").alias("other"), rank.alias("r")))
    return ends.groupBy("g").agg(F.min(F.struct("r", "other")).alias("f")).select("g", "f.r", "f.other")


def _blocks(edges: DataFrame, limit: int) -> DataFrame:
    """(g, block) by components of first choices, of which those with more than `limit` pairs are made of earlier choices."""
    choices, done = written(_first_choices(edges), "clusters"), []
    while True:
        roots = written(components(choices.select(F.col("g").alias("a"), F.col("other").alias("b"))), "clusters")
        side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        sizes = edges.join(side("x"), "x").join(side("y"), "y").where("rx = ry").groupBy(F.col("rx").alias("root")).agg(F.count(F.lit(1)).alias("n"))
        large = written(sizes.where(F.col("n") > limit), "clusters")
        blocks = lambda kind: roots.join(large, "root", kind).select(F.col("node").alias("g"), F.col("root").alias("block"))
        done.append(blocks("left_anti"))
        if not (most := large.agg(F.max("n")).first()[0]):
            return reduce(DataFrame.union, done)
        cut = choices.join(roots.join(large, "root", "left_semi").select(F.col("node").alias("g")), "g", "left_semi")
        c = cut.agg(F.percentile_approx("r.c", min(0.5, limit / most), 1_000_000)).first()[0]
        a = cut.where(F.col("r.c") == c).agg(F.percentile_approx("r.a", 0.5, 1_000_000)).first()[0]
        kept = written(cut.where((F.col("r.c") < c) | (F.col("r.c") == c) & (F.col("r.a") <= a)), "clusters")
        if kept.count() == cut.count():  # equal pairs of one item: they stay together
            return reduce(DataFrame.union, [*done, blocks("left_semi")])
        choices = kept


def clusters(items: DataFrame, pairs: DataFrame, least: float, margin: float, most: int, span_hours: int, limit: int = LIMIT) -> Clusters:
    """Groups of items (key, hours or null, v), keys unique, along pairs (a, b, cosine) of different keys.

    Items without pairs are groups of their own; undated items count in no span; an empty table gives no groups.
    """
    rules = (least - margin, most, span_hours)
    none, ever = F.lit(float("inf")), F.lit(float("-inf"))
    vector = F.transform("v", lambda x: x.cast("double"))
    groups = written(items.select(F.col("key").cast("long").alias("g"), F.lit(1).cast("long").alias("size"), vector.alias("total"), F.coalesce(F.col("hours").cast("double"), none).alias("early"), F.coalesce(F.col("hours").cast("double"), ever).alias("late")), "clusters")
    edges = written(pairs.select(F.col("a").cast("long").alias("x"), F.col("b").cast("long").alias("y"), F.col("cosine").cast("double").alias("cosine"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "clusters")
    n_pairs = edges.count()
    roots = components(edges.select("a", "b"))
    small = edges.join(roots, edges["x"] == roots["node"]).groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit).select("root")
    block = roots.join(small, "root").select(F.col("node").alias("g"), F.col("root").alias("block"))
    state = _step(_State(groups, edges, written(groups.select(F.col("g").alias("key"), "g"), "clusters"), None), written(block, "clusters"), rules)
    while left := state.edges.count():
        if left <= limit:
            block = state.edges.select(F.explode(F.array("x", "y")).alias("g")).distinct().withColumn("block", F.lit(0).cast("long"))
        else:
            block = _blocks(state.edges, limit)
        state = _step(state, written(block, "clusters"), rules)
    totals = state.counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS])
    return Clusters(state.members.select("key", F.col("g").alias("group")), totals.select(F.lit(n_pairs).cast("long").alias("pairs"), *_COUNTS))


def summary(grouped: DataFrame, counts: DataFrame, largest: int = 20) -> tuple[DataFrame, DataFrame]:
    """(runs, top) of groups (key, group, outlet): one row of the counts with groups, groups of several outlets and rows in
    groups of two or more; and the `largest` groups by size, then group."""
    g = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.count_distinct(F.lower("outlet")).alias("n_outlets"))
    run = g.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n_outlets") > 1).alias("n_multi_outlet"), F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).alias("n_covered"))
    return run.crossJoin(F.broadcast(counts)), g.orderBy(F.desc("size"), "group").limit(largest)
