"""Approximate nearest neighbours by shifted Hilbert curves.

Equal vectors collapse first: only their smallest ids can be among anyone's k nearest. Each of `CURVES` orderings
rotates the vectors at random, keeps `DIMS` coordinates, levels them on quantiles fitted on a sample of at most
`SAMPLE` vectors of each length, shifts the levels by a random part of a cell and takes the Hilbert index, made
unique by a hash. Spark range-partitions and sorts the keys of every ordering - keys only, no vectors - and marks
are read off at even ranks. A query's window in an ordering reaches `reach` ranks to either side, out to the next
mark. Windows merge in blocks of vectors: a vector travels once for a block of queries with its keys of all
orderings, whoever lies in one of a query's windows is its candidate once, and candidates are reranked by exact
double-precision distance.

One rule sets the reach: `SHARE` of the vectors of that length, and `LEAST` ranks at least. Close to isotropic vectors,
as in the test tables, have no order that keeps neighbours within a constant window, so constant recall takes
windows in proportion; for vectors that have one, a smaller `share` does. The README has the recall at 10.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of
different lengths are never compared; repeated vectors are neighbours at distance 0; a null id takes no part; an id
that asks with several vectors asks with one of them; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import discard, materialize, table, tidy
from loomwork.llm._grid import grid, matrix, numbered, packed, unpacked
from loomwork.llm.topk import valid

CURVES, DIMS, BITS = 48, 8, 3
SHARE, LEAST = 0.007, 64
SAMPLE = 4096
#: Marks within a reach; vectors a block; queries a block; queries that are reranked at once.
MARKS, BLOCK, QUERIES_A_BLOCK, AT_ONCE = 8, 2048, 256, 32


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with integer coordinates (n x dims) below 2**bits (Skilling's transform, 2004)."""
    x = levels.T.astype(np.int64)
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _axes(width: int, curve: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, width, curve])
    return np.linalg.qr(rng.normal(size=(width, width)))[0][:, : min(DIMS, width)], rng.uniform(size=min(DIMS, width))


class Curves:
    """The orderings of vectors of one length: axes, and the cuts of every coordinate fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int):
        cells = 1 << BITS
        self.axes, self.cuts = [], []
        for c in range(curves):
            axes, shift = _axes(sample.shape[1], c, seed)
            p = sample @ axes
            self.axes.append(axes)
            self.cuts.append([np.quantile(p[:, i], np.clip((np.arange(1, cells) - s) / (cells - 1), 0, 1)) for i, s in enumerate(shift)])

    def keys(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """(curves x vectors): the Hilbert index, then bits of the vector's hash, so that no window is all of a cell."""
        low = 62 - BITS * DIMS
        tie = (g.astype(np.int64).view(np.uint64) >> np.uint64(64 - low)).astype(np.int64)
        out = np.empty((len(self.axes), len(x)), dtype=np.int64)
        for c, (axes, cuts) in enumerate(zip(self.axes, self.cuts, strict=True)):
            p = x @ axes
            level = np.stack([np.searchsorted(cut, p[:, i]) for i, cut in enumerate(cuts)], axis=1)
            out[c] = (hilbert(np.minimum(level, (1 << BITS) - 1), BITS) << low) | tie
        return out


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch (g, embedding, ...) whose vectors have one length."""
    size = np.diff(batch.column(1).offsets.to_numpy())
    for width in np.unique(size):
        yield int(width), batch.filter(pa.array(size == width))


def _keys(curves: dict[int, Curves]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (space, key) of every vector (g, embedding) in every ordering."""
        for whole in batches:
            for width, batch in _by_width(whole):
                keys = curves[width].keys(matrix(batch.column(1)), batch.column(0).to_numpy())
                space = np.repeat(width * len(keys) + np.arange(len(keys)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(space), pa.array(keys.ravel())], names=["space", "key"])

    return kernel


def _marks(step: dict[int, int], curves: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows (space, key): the first of each space here, then every `step`-th; `n` counts them up to the mark."""
        part, now, seen, last = TaskContext.get().partitionId(), None, 0, 0
        names = ["part", "space", "n", "key"]

        def rows(space, n, key):
            size = len(n)
            cols = [np.full(size, part, dtype=np.int32), np.full(size, space, dtype=np.int64), np.asarray(n, dtype=np.int64), np.asarray(key, dtype=np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        for batch in batches:
            spaces, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, spaces[1:] != spaces[:-1])) if len(spaces) else []
            for lo, hi in zip(cut, np.append(cut[1:], len(spaces)) if len(spaces) else [], strict=True):
                if spaces[lo] != now:
                    if now is not None:
                        yield rows(now, [seen], [last])
                    now, seen = spaces[lo], 0
                place = seen + np.arange(hi - lo)
                some = place % step[int(now) // curves] == 0
                yield rows(now, place[some], keys[lo:hi][some])
                seen, last = seen + int(hi - lo), keys[hi - 1]
        if now is not None:
            yield rows(now, [seen], [last])

    return kernel


class Marks:
    """Keys at known ranks of one ordering; windows in keys [low, high)."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        """rows (part, n, key): of each part, keys with the number of rows before; the last of a part has all its rows."""
        rank, key, before = [], [], 0
        for part in sorted({r[0] for r in rows}):
            own = sorted((n, k) for p, n, k in rows if p == part)
            rank += [before + n for n, _ in own[:-1]]
            key += [k for _, k in own[:-1]]
            before += own[-1][0]
        self.rank, self.key, self.n = np.array(rank), np.array(key, dtype=np.int64), before

    def window(self, keys: np.ndarray, reach: int) -> np.ndarray:
        """(2 x keys): from the mark at or before the rank less reach to the mark at or after the rank plus reach."""
        at = np.searchsorted(self.key, keys, side="right") - 1
        low = np.searchsorted(self.rank, self.rank[np.maximum(at, 0)] - reach, side="right") - 1
        after = np.append(self.rank, self.n)[at + 1]
        high = np.searchsorted(self.rank, after + reach, side="left")
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        return np.stack([np.where(low < 0, least, self.key[np.maximum(low, 0)]), np.append(self.key, most)[high]])


def _blocks(curves: dict[int, Curves], size: int, windows: dict[int, tuple[list[Marks], int]] | None = None):
    """Vectors (g, embedding) as packed blocks of one length with their keys, or with windows in place of keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(width: int) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            t = pa.Table.from_batches(held[width]).combine_chunks()
            held[width] = t.slice(size).to_batches()
            t = t.slice(0, size)
            g, x = t.column(0).to_numpy(), matrix(t.column(1).combine_chunks())
            places = curves[width].keys(x, g)
            if windows:
                marks, reach = windows[width]
                places = np.concatenate([m.window(k, reach) for m, k in zip(marks, places, strict=True)])
            cols = [pa.array([width], pa.int32()), pa.array([(part << 32) + seq]), pa.array([len(g)], pa.int32()), *(pa.array([packed(a)], pa.binary()) for a in (g, x, places))]
            return pa.RecordBatch.from_arrays(cols, names=["width", "id", "n", "g", "v", "places"])

        for whole in batches:
            for width, batch in _by_width(whole):
                held.setdefault(width, []).append(batch)
                while sum(b.num_rows for b in held[width]) >= size:
                    yield block(width)
        for width in list(held):
            if held[width]:
                yield block(width)

    return kernel


_BLOCKS = "width int, id long, n int, g binary, v binary, places binary"


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k rows of x nearest to q."""
    d = ((x - q) ** 2).sum(axis=1)
    o = np.lexsort((ids, d))[:k]
    return ids[o], d[o]


def _met(places: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(queries x vectors): who lies in one of a query's windows. places: curves x vectors; windows: 2 curves x queries."""
    out = np.zeros((windows.shape[1], places.shape[1]), dtype=bool)
    for c, keys in enumerate(places):
        order = np.argsort(keys)
        low, high = np.searchsorted(keys[order], windows[2 * c : 2 * c + 2])
        for q in np.flatnonzero(low < high):
            out[q, order[low[q] : high[q]]] = True
    return out


def _rerank(k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a query block and a vector block each, in any order: the k nearest met of every query in this task."""
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                key, n, m = (batch.column("width")[r].as_py(), batch.column("block")[r].as_py()), batch.column("n")[r].as_py(), batch.column("q_n")[r].as_py()
                ids, own = (unpacked(batch.column(c)[r].as_py(), s)[:, 0].astype(np.int64) for c, s in (("g", n), ("q_g", m)))
                x, qs = (unpacked(batch.column(c)[r].as_py(), s).astype(np.float64) for c, s in (("v", n), ("q_v", m)))
                met = _met(*(unpacked(batch.column(c)[r].as_py(), 1).reshape(-1, s) for c, s in (("places", n), ("windows", m))))
                if key not in best:
                    best[key] = [own, [(np.empty(0, dtype=np.int64), np.empty(0))] * m]
                found, length = best[key][1], (x**2).sum(axis=1)
                for lo in range(0, m, AT_ONCE):
                    # rough distances by products pick whom the exact ones are made for
                    rough = np.where(met[lo : lo + AT_ONCE], length[None] - 2 * qs[lo : lo + AT_ONCE] @ x.T, np.inf)
                    kth = np.partition(rough, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
                    slack = 1e-9 * (1 + length.max(initial=0.0) + (qs[lo : lo + AT_ONCE] ** 2).sum(axis=1))
                    for j, (line, edge) in enumerate(zip(rough, kth + slack, strict=True), lo):
                        near = np.flatnonzero((line <= edge) & np.isfinite(line))
                        if len(near):
                            i, d = nearest(x[near], ids[near], qs[j], k)
                            i, d = np.concatenate([found[j][0], i]), np.concatenate([found[j][1], d])
                            o = np.lexsort((i, d))[:k]
                            found[j] = (i[o], d[o])
        for own, found in best.values():
            size = [len(i) for i, _ in found]
            cols = [np.repeat(own, size), np.concatenate([i for i, _ in found]), np.sqrt(np.concatenate([d for _, d in found]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q_g", "g", "score"])

    return kernel


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES, share: float = SHARE, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found other rows of `vectors` (vec_id, embedding array)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(valid(F.col("embedding"), nonzero=True)).where("vec_id is not null")
    rows = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.xxhash64(v).alias("g"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    by_id = Window.partitionBy("g").orderBy("vec_id")
    least = rows.select("g", "vec_id").distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    least = materialize(least.select("g", "vec_id"), "least")
    # combined before the shuffle: a group of copies of any size is one row by then
    distinct = rows.groupBy("g").agg(F.min("vec_id").alias("first"), F.first("embedding").alias("embedding"), F.max("asks").alias("asks"))
    distinct = materialize(distinct, "distinct")
    counts = dict(distinct.groupBy(F.size("embedding")).count().collect())
    fitted = {}
    for width in counts:
        own = distinct.where(F.size("embedding") == width).orderBy(F.xxhash64("first", "g"), "g").limit(SAMPLE)
        fitted[width] = Curves(np.array([r[0] for r in own.select("embedding").collect()]), curves, seed)
    reach = {w: max(LEAST, int(np.ceil(share * n))) for w, n in counts.items()}
    keys = distinct.select("g", "embedding").mapInArrow(tidy(_keys(fitted)), "space long, key long")
    keys = keys.repartitionByRange("space", "key").sortWithinPartitions("space", "key")
    step = {w: max(1, r // MARKS) for w, r in reach.items()}
    # MARKS / share marks of an ordering, and two more for each partition that it crosses: no more on more vectors
    marks: dict[int, list] = {}
    for part, space, n, key in keys.mapInArrow(tidy(_marks(step, curves)), "part int, space long, n long, key long").collect():
        marks.setdefault(space, []).append((part, n, key))
    windows = {w: ([Marks(marks[w * curves + c]) for c in range(curves)], reach[w]) for w in counts}

    held = materialize(distinct.select("g", "embedding").mapInArrow(tidy(_blocks(fitted, BLOCK)), _BLOCKS), "held")
    held = numbered(held, "id", "no")
    asked = distinct.where("asks").select("g", "embedding").coalesce(max(1, sum(counts.values()) // 100_000))
    asked = materialize(asked.mapInArrow(tidy(_blocks(fitted, QUERIES_A_BLOCK, windows)), _BLOCKS), "asked")
    asked = numbered(asked, "id", "block").select("width", "block", F.col("n").alias("q_n"), F.col("g").alias("q_g"), F.col("v").alias("q_v"), F.col("places").alias("windows"))
    found = materialize(grid(asked, held, ["width"]).mapInArrow(tidy(_rerank(k + 1)), "q_g long, g long, score double"), "found")
    found = found.join(distinct.select("g", "first"), "g")
    best = F.row_number().over(Window.partitionBy("q_g").orderBy("score", "first"))
    found = found.withColumn("n", best).where(F.col("n") <= k + 1).select("q_g", "g", "score")
    asks = rows.where("asks").select(F.col("vec_id").alias("query_id"), "g").groupBy("query_id").agg(F.min("g").alias("q_g"))
    pairs = found.join(least, "g").join(asks, "q_g").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    done = pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    done = materialize(done, "neighbours")
    discard(rows, least, distinct, held, asked)
    return done


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


QUERIES = {"op9_hilbert_neighbours": op9_hilbert_neighbours}
ORACLE: dict[str, str] = {}
