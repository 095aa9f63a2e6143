"""Independent sources: outlets of a group that neither share a name nor a nearly identical title.

Titles are compared in a comparable form (text.comparable_title) by the Ratcliff-Obershelp ratio 2M/(|a|+|b|), M being the
characters in matching blocks. The blocks keep their order, so a ratio of r leaves at most (1-r)(|a|+|b|) characters
outside; each takes at most q grams of its own text or q-1 of the other along, so both titles share at least
((2q-1)r/2 - (q-1))(|a|+|b|) - (q-1) grams, and |b| lies between r/(2-r) and (2-r)/r times |a|. So they differ in few grams, and in no
more bits, where a title's characters (q = 1) and pairs of characters (q = 2) are set as bits: that is looked at for all titles of a
group, block against block, and the ratio of what is left is computed in the same task. No pairs are shuffled or written. The
work grows as the square of a group's titles, memory and disk grow as the titles.

Groups of few rows lie each in one task, which compares them at once; what follows is for the others.

What comes of it are components, so titles that are known to belong together need no comparison. Equal titles are one node,
nodes of one outlet hang on one of them, and near copies mostly stand side by side when titles are sorted, from either end:
these links are found first, by one pass over ranges of the sorted titles, and blocks are compared between components only. So thousands
of copies of one note do not meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import analytics
from loomwork.operators.analytics import components
from loomwork.operators.grams import few, spread
from loomwork.operators.shared import drop, in_small_batches, written

#: Grams of three characters; the least ratio for which every two unequal titles must share one.
Q, LEAST = 3, 0.9


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, which the matching blocks of two titles do not exceed."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def _shared_grams(lengths: Column, least: float) -> Column:
    """Grams that two titles of these lengths together share at least."""
    return F.ceil(F.lit((2 * Q - 1) * least / 2 - (Q - 1)) * lengths - (Q - 1) - 1e-9).cast("int")


def _similar(a: str, b: str, a_first: int, a_last: int, b_first: int, b_last: int, least: float) -> bool:
    """Whether any row of one title is followed by one of the other that is nearly identical: the ratio depends on the order."""
    if 2 * _common(a, b) < least * (len(a) + len(b)):
        return False
    return (a_first < b_last and ratio(a, b) >= least) or (b_first < a_last and ratio(b, a) >= least)


def _alike(first: str, then: str, least: float) -> bool:
    """Whether two titles in this order are nearly identical."""
    both = least * (len(first) + len(then))
    return 2 * min(len(first), len(then)) >= both and 2 * _common(first, then) >= both and ratio(first, then) >= least


def title_nodes(members: DataFrame) -> DataFrame:
    """(group, title, node, last) of members (group, key, title): distinct comparable titles by their first and last key."""
    own = members.select("group", "key", T.comparable_title(F.coalesce("title", F.lit(""))).alias("title"))
    return own.groupBy("group", "title").agg(F.min("key").alias("node"), F.max("key").alias("last"))


_EDGE = "a long, b long"


def _neighbours(nodes: DataFrame, least: float, backwards: bool) -> DataFrame:
    """Edges between similar titles that are neighbours in sorted order. Those at the borders of ranges are left out."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, 0
        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                similar = False
                if last is not None and last[0] == row[0]:
                    (_, t, n, z), (_, u, m, y) = last, row
                    similar = len(t) + len(u) > 0 and 2 * min(len(t), len(u)) >= least * (len(t) + len(u)) and _similar(t, u, n, z, m, y, least)
                if similar:
                    # a run of similar neighbours hangs on its first: no long chains
                    out.append((head, row[2]))
                else:
                    head = row[2]
                last = row
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])

    order = F.reverse("title") if backwards else F.col("title")
    ranged = nodes.select("group", "title", "node", "last").repartitionByRange("group", F.substring(order, 1, 40)).sortWithinPartitions("group", order, "node")
    return ranged.mapInArrow(kernel, _EDGE)


def grams(title: Column) -> Column:
    """The grams of a title, the k-th occurrence of one marked by k, so that common ones are counted as often as they stand."""
    plain = F.sort_array(F.transform(F.sequence(F.lit(1), F.length(title) - (Q - 1)), lambda i: F.substring(title, i, F.lit(Q))))
    mark = lambda p: F.transform(p, lambda x, i: F.concat(x, F.lit("#"), (i + 2 - F.array_position(p, x)).cast("string")))
    # bound to a name, so that the sorted grams are made once and not for every one of them
    marked = F.transform(F.array(plain), mark)[0]
    return F.when(F.length(title) >= Q, marked).otherwise(F.array().cast("array<string>"))


def _bits(titles: list[str]) -> np.ndarray:
    """(titles, 16) words: 512 bits for the characters of a title and 512 for its pairs of characters, k-th occurrences marked by k."""
    rows, cols = [], []
    for i, t in enumerate(titles):
        code = [(c - 96 if c > 96 else c - 21 if c > 47 else 0) % 37 for c in map(ord, t)]
        k: dict[int, int] = {}
        for c in code:
            n = k[c] = k.get(c, -1) + 1
            cols.append(c * 13 + n if n < 13 else 481 + (c + n) % 31)
        for c in map(lambda x, y: 40 + 37 * x + y, code, code[1:]):
            n = k[c] = k.get(c, -1) + 1
            cols.append(512 + (c * 0x9E3779B1 + n * 0x85EBCA6B >> 7) % 512)
        rows += [i] * (len(cols) - len(rows))
    every = np.zeros((len(titles), 1024), bool)
    every[rows, cols] = True
    return np.packbits(every, axis=1).view(np.uint64)


def _apart(la: np.ndarray, lb: np.ndarray, q: int, least: float) -> np.ndarray:
    """Grams of q characters that titles of these lengths have at most in one and not in the other, if they are nearly identical."""
    shared = np.ceil(((2 * q - 1) * least / 2 - (q - 1)) * (la + lb) - (q - 1) - 1e-9)
    return np.maximum(la - q + 1, 0) + np.maximum(lb - q + 1, 0) - 2 * np.maximum(shared, 0)


#: Titles of a block, those that are compared with a block at a time, and characters up to which many titles are compared at once.
BLOCK, _STRIP, LONG = 4096, 16, 256
_BLOCKS = "b long, low string, high string, short long, long long, g array<string>, node array<long>, last array<long>, root array<long>, title array<string>, bits binary"


def shown(nodes: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Blocks of nodes (group, title, node, last, root) that stand side by side by group and length, with their bits, written once."""
    if (2 * Q - 1) * least / 2 - (Q - 1) <= 0 or least < LEAST:
        raise ValueError(f"titles are compared by grams from a ratio of {LEAST} on")
    own = nodes.select(F.col("group").cast("string").alias("g"), "node", "last", "root", "title").where("g is not null")
    n = own.count()
    parts = max(1, min(-(-n // block), analytics.PARTS), -(-n // (analytics.PART * block)))
    order = ["g", F.length("title"), "title"]
    ranged = own.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else own.coalesce(1).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                cols = batch.slice(at, block).to_pydict()
                sizes = [len(t) for t in cols["title"]]
                row = {"b": (part << 33) + place, "low": min(cols["g"]), "high": max(cols["g"]), "short": min(sizes), "long": max(sizes), **cols, "bits": _bits(cols["title"]).tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in shape], schema=shape)
                place += 1

    shape = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in _BLOCKS.split(", ")])
    return in_small_batches(written(ranged.mapInArrow(pack, _BLOCKS), "replica-blocks"))


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def _met(blocks: DataFrame, least: float) -> DataFrame:
    """Every two blocks b <= c that may hold nearly identical titles of one group. Tasks read written blocks against each other."""
    other = blocks.select(*[F.col(c).alias(f"{c}2") for c in blocks.columns])
    ratio_ = F.lit(least / (2 - least) - 1e-9)
    near = (F.col("low") <= F.col("high2")) & (F.col("low2") <= F.col("high")) & (F.col("long") >= F.col("short2") * ratio_) & (F.col("long2") >= F.col("short") * ratio_)
    return blocks.crossJoin(other).where((F.col("b") <= F.col("b2")) & near)


def _codes(titles: list[str]) -> np.ndarray:
    """A row of codes for each title: 1 to 26 letters, 27 to 36 digits, 0 a space, 37 after its end. Titles over LONG characters are cut."""
    cut = [t[:LONG] for t in titles]
    length = np.fromiter(map(len, cut), np.int64, len(cut))
    c = np.frombuffer("".join(cut).encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.full((len(cut), length.max(initial=0)), 37, np.uint8)
    out[np.repeat(np.arange(len(cut)), length), spread(np.zeros(len(cut), np.int64), length)] = np.where(c > 96, c - 96, np.where(c > 47, c - 21, 0)) % 37
    return out


def _masks(codes: np.ndarray) -> np.ndarray:
    """(words, titles * 38): the places of each code in each title as bits."""
    n, longest = codes.shape
    out = np.zeros((max(1, -(-longest // 64)), n, 38), np.uint64)
    for p in range(longest):
        out[p >> 6, np.arange(n), codes[:, p]] |= np.uint64(1 << (p & 63))
    out[:, :, 37] = 0
    return out.reshape(len(out), n * 38)


def _commons(masks: np.ndarray, codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_common() of many titles at once: i of _masks(), j of _codes(). Codes that stand for more than one character can only make it larger."""
    v = np.full((len(masks), len(i)), np.iinfo(np.uint64).max, np.uint64)
    for p in range(codes.shape[1]):
        at = i * 38 + codes[j, p]
        carry = np.zeros(len(i), np.uint64)
        for w, m in enumerate(masks):
            here = m[at]
            u = v[w] & here
            first = v[w] + u
            whole = first + carry
            carry = ((first < u) | (whole < carry)).astype(np.uint64)
            v[w] = whole | (v[w] & ~here)
    return np.bitwise_count(~v).sum(axis=0, dtype=np.int64)


def _close(r, least: float) -> Iterator[tuple[int, int]]:
    """Places of the titles of a pair of blocks that are of one group, differ in few enough bits and have characters enough in common in
    one order; their roots differ.

    What most pairs differ in are few bits: the 64 characters' bits in which the block's titles vary most are looked at for all pairs, the others for
    what these leave. Every title's bits are among its 512, so no pair is lost.
    """
    x, y = (np.frombuffer(z, np.uint64).reshape(-1, 16) for z in (r.bits, r.bits2))
    la, lb = (np.array([len(t) for t in z]) for z in (r.title, r.title2))
    one = r.low == r.high == r.low2 == r.high2
    codes = np.zeros(len(la) + len(lb)) if one else np.unique([*r.g, *r.g2], return_inverse=True)[1]
    ga, gb = codes[: len(x)], codes[len(x) :]
    ra, rb = np.asarray(r.root), np.asarray(r.root2)
    most = _apart(np.arange(la.max() + lb.max() + 1.0), 0.0, 1, least)
    # by lengths up to these: what may differ jumps by parity and is not monotonic
    upto = np.minimum(np.maximum.accumulate(most), 64).astype(np.uint8)
    most_chars, most_pairs = lambda i, j: most[la[i] + lb[j]], lambda i, j: _apart(la[i], lb[j], 2, least)
    words, words2 = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    every, every2 = (np.unpackbits(np.ascontiguousarray(z[:, :8]).view(np.uint8).reshape(len(z), -1), axis=1) for z in (x, y))
    share = every.mean(axis=0)
    chosen = np.argsort(-share * (1 - share), kind="stable")[:64]
    p, q = (np.packbits(np.ascontiguousarray(z[:, chosen]), axis=1).view(np.uint64)[:, 0] for z in (every, every2))
    differ, far = np.empty((_STRIP, len(q)), np.uint64), np.empty((_STRIP, len(q)), np.uint8)
    masks, codes2 = _masks(_codes(r.title)), _codes(r.title2)

    def kept(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        keep = (ra[i] != rb[j]) & (2 * np.minimum(la[i], lb[j]) >= least * (la[i] + lb[j])) & ((i < j) if r.b == r.b2 else True) & (True if one else ga[i] == gb[j])
        i, j = i[keep], j[keep]
        for at, most in ((0, most_chars), (8, most_pairs)):
            apart = np.zeros(len(i), np.uint16)
            for w in range(at, at + 8):
                apart += np.bitwise_count(words[w][i] ^ words2[w][j])
            keep = apart <= most(i, j)
            i, j = i[keep], j[keep]
        # longer titles are compared one by one only
        keep = (la[i] > LONG) | (lb[j] > LONG)
        keep[~keep] = 2 * _commons(masks, codes2, i[~keep], j[~keep]) >= least * (la[i] + lb[j])[~keep]
        yield from zip(i[keep].tolist(), j[keep].tolist(), strict=True)

    held, n = [], 0
    for at in range(0, len(x), _STRIP):
        k = min(_STRIP, len(x) - at)
        np.bitwise_xor(p[at : at + k, None], q[None, :], out=differ[:k])
        np.bitwise_count(differ[:k], out=far[:k])
        limit = upto[la[at : at + k].max() + lb]
        i, j = np.divmod(np.flatnonzero(far[:k] <= limit), len(q))
        held.append((i + at, j))
        n += len(i)
        if n > PAIRS or at + k == len(x):
            yield from kept(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0


def candidates(blocks: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b), a < b, of shown() nodes (group, title, node, root): pairs with different roots whose lengths and grams allow the
    ratio. Every pair that has it is among them."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                yield pd.DataFrame([sorted((r.node[i], r.node2[j])) for i, j in _close(r, least)], columns=["a", "b"], dtype="int64")

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("title").alias(f"t{c}"))
    both = _met(blocks, least).mapInPandas(kernel, _EDGE).join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect(grams(F.col("ta")), grams(F.col("tb")))) >= _shared_grams(F.length("ta") + F.length("tb"), least)).select("a", "b")


def _joined(blocks: DataFrame, least: float) -> DataFrame:
    """(a, b): roots that nearly identical titles join. A task compares no titles whose roots it has joined already."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        for f in frames:
            for r in f.itertuples(index=False):
                out = []
                for i, j in _close(r, least):
                    a, b = top(int(r.root[i])), top(int(r.root2[j]))
                    if a != b and _similar(r.title[i], r.title2[j], r.node[i], r.last[i], r.node2[j], r.last2[j], least):
                        up[max(a, b)] = min(a, b)
                        out.append((a, b))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _met(blocks, least).mapInPandas(kernel, _EDGE)


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    return nodes.join(roots, "node", "left").select("group", "title", "node", "last", F.coalesce("root", "node").alias("root"))


#: Rows of a group that one task compares by itself; rows of groups, and pairs of them, that it holds at a time, about.
SMALL, ROWS, PAIRS = 256, 1 << 15, 1 << 16


def _possible(titles: list[str], start: np.ndarray, before: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """(i, j): rows i and j < i of the `before` rows from start[i] on that share characters enough to be nearly identical."""
    n, length = len(titles), np.fromiter(map(len, titles), np.int64, len(titles))
    c = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where(c > 96, c - 96, np.where(c > 47, c - 21, 0)) % 37
    held = np.bincount(np.repeat(np.arange(n), length) * 37 + code, minlength=37 * n).reshape(n, 37).astype(np.int32)
    ends, at = np.cumsum(before), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        i, j = np.repeat(np.arange(at, to), before[at:to]), spread(start[at:to], before[at:to])
        both = least * (length[i] + length[j])
        some = 2 * np.minimum(length[i], length[j]) >= both
        i, j, both = i[some], j[some], both[some]
        some = 2 * np.minimum(held[i], held[j]).sum(axis=1) >= both
        yield from zip(i[some].tolist(), j[some].tolist(), strict=True)
        at = to


def _small(own: DataFrame, least: float) -> DataFrame:
    """(group, key, source) of own (group, key, outlet, title), title comparable, of groups of up to SMALL rows: a group lies in one task.

    Titles are counted by characters and compared as arrays first: pairs that share too few are not looked at one by one.
    """

    def sources(held: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
        size, rows = pc.list_value_length(held).to_numpy().astype(np.int64), held.flatten()
        group = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((rows.field("key").to_numpy(), group))
        key, outlet, title = (rows.field(c).take(pa.array(order)) for c in ("key", "outlet", "title"))
        start, place, up = (np.cumsum(size) - size)[group], np.arange(len(order)), list(range(len(order)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def join(x: int, y: int) -> None:
            up[max(x, y)] = min(x, y)

        for same in (outlet, title):
            coded = same.dictionary_encode()
            _, first, back = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(), return_index=True, return_inverse=True)
            for i in np.flatnonzero(first[back] != place).tolist():
                join(top(i), top(int(first[back[i]])))
        titles = title.to_pylist()
        # the ratio depends on the order: the row that comes first stands first
        for i, j in _possible(titles, start, place - start, least):
            x, y = top(i), top(j)
            if x != y and _alike(titles[j], titles[i], least):
                join(x, y)
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        tops = pa.array(np.fromiter(map(top, range(len(up))), np.int64, len(up)))
        return pa.ListArray.from_arrays(ends, key), pa.ListArray.from_arrays(ends, key.take(tops))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for held in few(batch.column(1), ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), *sources(held)], names=["group", "key", "source"])
                at += len(held)

    kind = own.schema["group"].dataType.simpleString()
    held = own.groupBy("group").agg(F.collect_list(F.struct("key", "outlet", "title")).alias("rows"))
    each = held.mapInArrow(kernel, f"group {kind}, key array<long>, source array<long>")
    return each.select("group", F.explode(F.arrays_zip("key", "source")).alias("x")).select("group", "x.key", "x.source")


def source_of(members: DataFrame, least: float = LEAST, small: int = SMALL) -> DataFrame:
    """(group, key, source) of members (group, key, outlet, title), keys unique: rows of one outlet or with nearly identical
    titles, directly or by others, have one source, named by its smallest key.

    A null outlet is an outlet; a null title is empty; case and outer spaces of outlets do not count. Groups of up to `small`
    rows are compared each by one task, the others block against block.
    """
    own = members.select("group", F.col("key").cast("long").alias("key"), F.lower(F.trim(F.coalesce("outlet", F.lit("")))).alias("outlet"), T.comparable_title(F.coalesce("title", F.lit(""))).alias("title"))
    own = written(own.where("group is not null"), "replica-rows")
    large = written(own.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("group"), "replica-large")
    if large.isEmpty():
        return _small(own, least)
    rest = _small(own.join(large, "group", "left_anti"), least)
    return rest.unionByName(_sources(own.join(large, "group", "left_semi"), least))


def _sources(titled: DataFrame, least: float) -> DataFrame:
    """source_of() of rows (group, key, outlet, title), title comparable, of groups of any size."""
    nodes = written(titled.groupBy("group", "title").agg(F.min("key").alias("node"), F.max("key").alias("last")), "replica-titles")
    held = written(titled.join(nodes, ["group", "title"]).select("group", "key", "outlet", "node"), "replica-members")
    named = held.groupBy("group", "outlet", "node").agg(F.count(F.lit(1)).alias("n"))
    star = named.groupBy("group", "outlet").agg(F.min("node").alias("b"))
    outlets = named.join(star, ["group", "outlet"]).where("node <> b").select(F.col("node").alias("a"), "b")
    near = _neighbours(nodes, least, False).union(_neighbours(nodes, least, True))
    edges = written(outlets.union(near), "replica-edges")
    rooted = written(_rooted(nodes, edges), "replica-roots")
    drop(edges)
    blocks = shown(rooted, least)
    # only roots are joined anew
    again = components(_joined(blocks, least)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    drop(blocks)
    rooted = rooted.join(again, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # a source's name is its smallest key: that of its first title
    return held.join(rooted, "node").select("group", "key", F.col("root").alias("source"))


def independent_sources(members: DataFrame, least: float = LEAST) -> DataFrame:
    """(group, n): the number of independent sources of each group."""
    return source_of(members, least).groupBy("group").agg(F.count_distinct("source").alias("n"))
