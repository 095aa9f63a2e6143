"""Jaccard similarity join of word-shingle sets by chosen paths.

Each text becomes the set of its shingles (five words each; a text of one to four words is one shingle).
Equal sets collapse into one node first. A set is embedded as `TOKENS` min-hash tokens, of which two sets share
a share equal to their Jaccard similarity in expectation. A run walks down from a root: a tree node samples one
token place, and every set moves to the child named by its token there, so only sets that share all sampled
tokens stay together. `runs` roots repeat this until the target recall: after `depth` steps a pair of
similarity s that shares a part q of its tokens is together in a run with probability q**depth, and stays so through
any number of further splits with probability `lives(q)`; `runs_for` takes the least runs that reach the recall over
the binomial spread of q.

Buckets of at most `SMALL` sets are brute-forced on the embedded tokens. In larger ones, near-identical sets
first collapse onto leaders, chunk by chunk, each set joined to every leader within reach (Jaccard distance is a
metric, so sets of similarity s have leaders at least s - 0.16 alike; the estimate must reach s - 0.3); the leaders are
then brute-forced, or, if there are still more than `LARGE`, go down `BRANCHES` paths by two more tokens each. What this
yields is a forest of candidate groups, not pairs. Inside a candidate group all sets are compared exactly, in blocks of `BLOCK` sets,
so links come out whole and a group of any size is many bounded tasks.

Defined cases: null or empty text has no shingles, is linked to nothing and is its own class; a null doc_id
never names a class (a group of such rows alone has a null one), its text is linked like any other; repeated rows and
equal sets are linked copies; extra columns are ignored, and none clashes in `one_of_each`; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import components, discard, free_names, materialize, table, tidy
from loomwork.llm._words import Words, mix, signed, slices

SHINGLE = 5
TOKENS = 128
DEPTH = 4
SMALL, LARGE, CHUNK, BLOCK = 32, 4096, 2048, 256
#: Paths that a set of a large bucket goes on along; equal tokens from which on a set is its leader's follower.
BRANCHES, LEADER = 3, 118

_A = np.array([(0x9E3779B1 * (2 * i + 1) ^ (i * 0x85EBCA77)) & 0xFFFFFFFF | 1 for i in range(TOKENS)], dtype=np.uint32)
_B = (np.arange(TOKENS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)


def lives(q: float) -> float:
    """Probability that two sets sharing a part q of their tokens stay together down to any depth of further splits."""
    x = 1.0
    for _ in range(200):  # a branching process: each of BRANCHES paths keeps both with probability q * q
        x = 1 - (1 - q * q * x) ** BRANCHES
    return x


def missed(runs: int, similarity: float = 0.8, depth: int = DEPTH) -> float:
    """Probability that a pair of the given similarity never meets; its share of equal tokens is binomial, not exact."""
    share = ((m, math.comb(TOKENS, m) * similarity**m * (1 - similarity) ** (TOKENS - m)) for m in range(TOKENS + 1))
    return sum(p * (1 - (m / TOKENS) ** depth * lives(m / TOKENS)) ** runs for m, p in share)


def reach(minimum: tuple[int, int]) -> int:
    """Equal tokens that make a candidate: a pair at the least similarity, or its leaders, has fewer once in 10**4 or less."""
    return max(1, math.floor(TOKENS * (minimum[0] / minimum[1] - 0.3)))


def runs_for(recall: float, similarity: float = 0.8, depth: int = DEPTH) -> int:
    """Runs after which a pair of the given similarity has met with the given probability."""
    runs = math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))
    while missed(runs, similarity, depth) > 1 - recall:
        runs += 1
    return runs


def step(path: np.ndarray, tokens: np.ndarray, salt: int = 0) -> np.ndarray:
    """One step down: the tree node (path, sets x runs) samples a token place; the set's token there names the child."""
    at = (mix(path ^ np.uint64(salt * 2 + 1)) % np.uint64(TOKENS)).astype(np.int64)
    value = tokens[np.arange(len(tokens))[:, None], at].astype(np.uint64)
    return mix(path * np.uint64(0x9E3779B97F4A7C15) + (at.astype(np.uint64) << np.uint64(16)) + value + np.uint64(1))


def shingle_sets(w: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, out = w.runs(SHINGLE), []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(w.runs(int(b - a))[a : a + 1] + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each set."""
    return np.array([int(np.add.reduce(mix(s))) for s in sets], dtype=np.uint64)


def _embed(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens (16 bits of each minimum) of non-empty sets."""
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), TOKENS), dtype=np.uint16)
    for i in range(TOKENS):
        least = np.minimum.reduceat(low * _A[i] + _B[i], at)
        out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sketch(runs: int):
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                sets = shingle_sets(Words(data, offsets))
                some = [i for i, s in enumerate(sets) if len(s)]
                tokens, paths, sig = [None] * len(sets), [[]] * len(sets), None
                if some:
                    sig = _embed([sets[i] for i in some])
                    path = np.broadcast_to(roots, (len(some), runs))
                    for _ in range(DEPTH):
                        path = step(path, sig)
                    for k, i in enumerate(some):
                        tokens[i], paths[i] = sig[k].tobytes(), signed(path[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(signed(fingerprints(sets))),
                        pa.array([len(s) for s in sets], pa.int32()), pa.array(tokens, pa.binary()), pa.array(paths, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "tk", "node", "n", "sig", "paths"],
                )

    return kernel


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups, in tables of one or more, from batches sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        last = np.ones(batch.num_rows, dtype=bool)
        for c in cols:
            last &= c == c[-1]
        cut = int(np.argmax(last))
        if held and cut == 0 and all(held[0].column(i)[0].as_py() == batch.column(i)[0].as_py() for i in range(keys)):
            held.append(batch)
            continue
        if held and (cut == 0 or any(held[0].column(i)[0].as_py() != batch.column(i)[0].as_py() for i in range(keys))):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _tokens(column) -> np.ndarray:
    raw = b"".join(x for x in column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint16).reshape(-1, TOKENS)


def _alike(n1: np.ndarray, n2: np.ndarray, minimum: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes can be as similar as that."""
    return minimum[1] * np.minimum(n1, n2).astype(np.int64) >= minimum[0] * np.maximum(n1, n2).astype(np.int64)


_EDGES = "a long, b long"


def _forest(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """The same connections in fewer rows: each node with the smallest node that the pairs connect it to."""
    e = np.concatenate(pairs) if pairs else np.empty((0, 2), dtype=np.int64)
    nodes, at = np.unique(e, return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[at[:, 0]], root[at[:, 1]])
        new = root.copy()
        np.minimum.at(new, at[:, 0], least)
        np.minimum.at(new, at[:, 1], least)
        np.minimum.at(new, root[at[:, 0]], least)
        np.minimum.at(new, root[at[:, 1]], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[root[own]]), pa.array(nodes[own])], names=["a", "b"])


def _brute(minimum: tuple[int, int]):
    least = reach(minimum)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidate edges within small buckets: rows (bucket, node, n, sig) sorted by bucket."""
        for t in _groups(batches, 1):
            bucket, node, n = (t.column(i).to_numpy() for i in range(3))
            sig, pairs = _tokens(t.column(3)), []
            for lag in range(1, SMALL):
                i = np.flatnonzero(bucket[lag:] == bucket[:-lag])
                if not len(i):
                    break
                i = i[(node[i] != node[i + lag]) & _alike(n[i], n[i + lag], minimum)]
                for c in range(0, len(i), 8192):
                    k = i[c : c + 8192]
                    k = k[(sig[k] == sig[k + lag]).sum(axis=1) >= least]
                    pairs.append(np.stack([np.minimum(node[k], node[k + lag]), np.maximum(node[k], node[k + lag])], axis=1))
            if pairs:
                yield _forest(pairs)

    return kernel


_LEADERS = "bucket long, a long, b long, n int, sig binary"


def _lead(minimum: tuple[int, int]):
    least = reach(minimum)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, chunk, node, n, sig) by (bucket, chunk): edges to leaders, and leaders (a = b, with their tokens)."""
        for t in _groups(batches, 2):
            bucket, chunk = t.column(0).to_numpy(), t.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
                part = t.slice(lo, hi - lo)
                node, n, sig = part.column(2).to_numpy(), part.column(3).to_numpy(), _tokens(part.column(4))
                order = np.argsort(node, kind="stable")
                lead, rows = [], []
                tokens = np.empty((hi - lo, TOKENS), dtype=np.uint16)
                for k in order:
                    near = (tokens[: len(lead)] == sig[k]).sum(axis=1)
                    met = np.flatnonzero(near >= least)
                    rows += [(int(node[lead[j]]), int(node[k])) for j in met if node[lead[j]] != node[k]]
                    if not len(met) or near.max() < LEADER:
                        tokens[len(lead)] = sig[k]
                        lead.append(k)
                tree = _forest([np.array(rows, dtype=np.int64).reshape(-1, 2)])
                a = tree.column(0).to_pylist() + [int(node[k]) for k in lead]
                b = tree.column(1).to_pylist() + [int(node[k]) for k in lead]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(a), bucket[lo])), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                        pa.array([0] * tree.num_rows + [int(n[k]) for k in lead], pa.int32()), pa.array([None] * tree.num_rows + [sig[k].tobytes() for k in lead], pa.binary()),
                    ],
                    names=["bucket", "a", "b", "n", "sig"],
                )

    return kernel


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders of large buckets, each along `BRANCHES` paths of two more tokens."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column(0).to_numpy().view(np.uint64)[:, None]
        sig = _tokens(batch.column(3))
        for branch in range(BRANCHES):
            child = step(step(path, sig, branch + 1), sig)
            yield pa.RecordBatch.from_arrays([pa.array(signed(child[:, 0])), *batch.columns[1:]], names=batch.schema.names)


def _candidates(cells: DataFrame, minimum: tuple[int, int], level: int = 0, small: int = SMALL, large: int = LARGE, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between sets of a bucket that may be similar; cells are (bucket, node, n, sig) or lack n and sig."""
    spark = cells.sparkSession
    sizes = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialize(sizes, "buckets")
    met = cells.join(sizes, "bucket")
    few = met.where(F.col("size") <= small).select("bucket", "node", "n", "sig")
    edges = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_brute(minimum)), _EDGES)
    if sizes.where(F.col("size") > small).isEmpty():
        return materialize(edges, "candidates")
    split = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / chunk)).cast("int")
    many = met.where(F.col("size") > small).select("bucket", split.alias("chunk"), "node", "n", "sig")
    led = materialize(many.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(_lead(minimum)), _LEADERS), "leaders")
    edges = edges.union(led.where("a <> b").select("a", "b"))
    leaders = led.where("a = b").select("bucket", F.col("a").alias("node"), "n", "sig")
    left = materialize(leaders.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).join(sizes.where(F.col("size") > chunk).select("bucket"), "bucket", "left_semi"), "left")
    again = leaders.join(left.where((F.col("size") > 1) & (F.col("size") <= large)), "bucket").select("bucket", F.lit(0).alias("chunk"), "node", "n", "sig")
    edges = edges.union(again.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(_lead(minimum)), _LEADERS).where("a <> b").select("a", "b"))
    edges = materialize(edges, "candidates")
    rest = left.where(F.col("size") > large)
    if rest.isEmpty():
        return edges
    rest = leaders.join(rest, "bucket")
    if level < 8:
        return edges.union(_candidates(rest.select("bucket", "node", "n", "sig").mapInArrow(tidy(_deeper), "bucket long, node long, n int, sig binary"), minimum, level + 1, small, large, chunk))
    blocks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = rest.select("bucket", "node", "n", "sig", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    pairs = pairs.select(F.xxhash64("bucket", F.least("own", "other")).alias("bucket"), F.greatest("own", "other").alias("chunk"), "node", "n", "sig")
    return edges.union(pairs.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(_lead(minimum)), _LEADERS).where("a <> b").select("a", "b"))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the asked representatives; rows of another text under the same doc_id go."""
    for batch in batches:
        node = batch.column(2).to_numpy()
        for lo, hi, data, offsets in slices(batch, "text"):
            sets = shingle_sets(Words(data, offsets))
            same = np.flatnonzero(signed(fingerprints(sets)) == node[lo:hi])
            own = batch.take(pa.array(lo + same))
            yield pa.RecordBatch.from_arrays(
                [own.column(2), own.column(3), own.column(4), own.column(5), pa.array([sets[i].tobytes() for i in same], pa.binary())],
                names=["node", "grp", "blocks", "copies", "shingles"],
            )


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shingles that several sets have."""
    words, seen = np.unique(np.concatenate(sets), return_counts=True)
    words = words[seen > 1]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    at = []
    for s in sets:
        p = np.searchsorted(words, s)
        own = p < len(words)
        own[own] = words[p[own]] == s[own]
        at.append(p[own])
    for c in range(0, len(words), width):
        m = np.zeros((len(sets), min(width, len(words) - c)), dtype=np.float32)
        for k, p in enumerate(at):
            a, b = np.searchsorted(p, [c, c + width])
            m[k, p[a:b] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(minimum: tuple[int, int]):
    """Exact links within blocks: rows (grp, i, j, own, node, copies, shingles) sorted by (grp, i, j)."""
    up, down = minimum

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            keys = [t.column(i).to_numpy() for i in range(3)]
            change = np.zeros(len(keys[0]) - 1, dtype=bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            cut = np.append(0, np.flatnonzero(change) + 1)
            nodes, links, roots = [], [], []
            for lo, hi in zip(cut, np.append(cut[1:], len(keys[0])), strict=True):
                part = t.slice(lo, hi - lo)
                own, node, copies = (part.column(c).to_numpy() for c in (3, 4, 5))
                node, at = np.unique(node, return_index=True)
                own, copies = own[at], copies[at]
                raw = part.column(6).take(pa.array(at)).to_pylist()
                sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
                size = np.array([len(s) for s in sets])
                if len(sets) == 2:
                    common = len(np.intersect1d(*sets, assume_unique=True))
                    both = np.array([[size[0], common], [common, size[1]]])
                else:
                    both = intersections(sets)
                link = (down + up) * both >= up * (size[:, None] + size[None])
                np.fill_diagonal(link, False)
                if keys[1][lo] != keys[2][lo]:
                    link &= own[:, None] != own[None]
                root = np.arange(len(node))
                while True:
                    least = np.where(link, root[None], len(node)).min(axis=1)
                    new = np.minimum(root, least)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                nodes.append(node)
                links.append(link @ copies)
                roots.append(node[root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (nodes, links, roots)], names=["node", "links", "root"])

    return kernel


def jaccard_join(docs: DataFrame, recall: float = 0.9995, minimum: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, rep_id, n_links, tk (hash of the text), stays, shared.

    Links hold between documents whose shingle sets have Jaccard similarity of at least minimum (a fraction).
    class_id: smallest doc_id of the linked group; rep_id: smallest doc_id with an equal set; n_links: other
    documents linked to this one, copies included. stays: whether the row is, or equals, the one that stands for its group;
    shared: whether it has words, so that equal rows are one group.
    """
    runs = runs_for(recall, minimum[0] / minimum[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    rows = materialize(texts.mapInArrow(tidy(_sketch(runs)), "doc_id long, tk long, node long, n int, sig binary, paths array<long>"), "sketches")
    some = rows.where("n > 0")
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.min(head).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    nodes = materialize(nodes, "nodes")
    slim = nodes.select("node", F.explode("paths").alias("bucket"))
    sizes = materialize(slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "met")
    met = slim.join(sizes, "bucket").select("bucket", "node")
    cells = materialize(met.join(nodes.select("node", "n", "sig"), "node").select("bucket", "node", "n", "sig"), "cells")
    edges = _candidates(cells, minimum)
    groups = materialize(components(edges, "groups"), "groups")
    discard(cells, sizes)

    counts = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = groups.join(counts, "root").join(nodes.select("node", "head", "copies"), "node")
    asked = asked.select("head.doc_id", "head.tk", "node", F.col("root").alias("grp"), "blocks", "copies")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    # rows without an id: one of those with a text is enough, and copies go before the shuffle
    nameless = keyed.where("doc_id is null").groupBy("tk").agg(F.first("text").alias("text"))
    texts = keyed.join(asked, ["doc_id", "tk"]).select("doc_id", "text", "node", "grp", "blocks", "copies")
    texts = texts.unionByName(nameless.join(asked.where("doc_id is null"), "tk").select("doc_id", "text", "node", "grp", "blocks", "copies"))
    sets = texts.mapInArrow(tidy(_resolve), "node long, grp long, blocks int, copies long, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.select("grp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "node", "copies", "shingles")
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "shingles")
    dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = materialize(dealt.mapInArrow(tidy(_verify(minimum)), "node long, links long, root long"), "links")
    classes = materialize(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "classes"), "classes")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "rep_id", "head", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    info = materialize(info, "info")
    heads = info.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.min("head").alias("first"))
    info = materialize(info.join(heads, "root").select("node", "rep_id", "class_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "info")
    bare = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), "tk", F.lit(True).alias("stays"), F.lit(False).alias("shared"))
    linked = some.select("doc_id", "tk", "node").join(info, "node")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk"))
    return linked.select("doc_id", "class_id", "rep_id", "n_links", "tk", stays.alias("stays"), F.lit(True).alias("shared")).union(bare)


def one_of_each(docs: DataFrame, recall: float = 0.9995, minimum: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stay when one document of each linked group does: the smallest doc_id.

    Texts without words are groups of their own. All columns are kept.
    """
    own_id, own_key, row, d, t, shared = free_names(docs.columns, "_id", "_tk", "_twin", "_d", "_t", "_s")
    kept = jaccard_join(docs.select("doc_id", "text"), recall, minimum).where("stays").select(F.col("doc_id").alias(d), F.col("tk").alias(t), F.col("shared").alias(shared)).distinct()
    keyed = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_key, F.xxhash64("text"))
    found = keyed.join(kept, keyed[own_id].eqNullSafe(kept[d]) & (keyed[own_key] == kept[t]))
    twin = F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(own_id))
    return found.withColumn(row, twin).where((F.col(row) == 1) | ~F.col(shared)).select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep_id", "n_links")


QUERIES = {"op4_jaccard_join": op4_jaccard_join}

#: All pairs of distinct shingle lists through an inverted index: exact on the small tables.
ORACLE = {
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END)) AS sh FROM w
), r AS (
  SELECT min(doc_id) AS rep, count(*) AS copies, len(sh) AS n, sh FROM s WHERE len(sh) > 0 GROUP BY sh
), e AS (
  SELECT rep, n, copies, md5(unnest(sh)) AS t FROM r
), p AS (
  SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, any_value(b.copies) AS cy, count(*) AS common
  FROM e a JOIN e b ON a.t = b.t AND a.rep <> b.rep GROUP BY a.rep, b.rep
), l AS (
  SELECT x, y, cy FROM p WHERE 9 * common >= 4 * (nx + ny)
), c AS (
  SELECT rep AS x, rep AS root FROM r UNION SELECT l.y, c.root FROM c JOIN l ON c.x = l.x
), k AS (
  SELECT x, min(root) AS class_id FROM c GROUP BY x
), n AS (
  SELECT x, sum(cy) AS links FROM l GROUP BY x
)
SELECT s.doc_id, coalesce(k.class_id, s.doc_id) AS class_id, coalesce(r.rep, s.doc_id) AS rep_id,
  CAST(coalesce(n.links, 0) + coalesce(r.copies, 1) - 1 AS BIGINT) AS n_links
FROM s LEFT JOIN r ON r.sh = s.sh LEFT JOIN k ON k.x = r.rep LEFT JOIN n ON n.x = r.rep
"""
}
