"""Exact top-k search by MaxScore over shards.

Rows are integer vectors: term (dimension) to weight. Candidates are dealt into shards of at most `SHARD` rows, longest
vectors first; in a shard the postings of a term are one contiguous column, with the bounds of its weights, and every
row has its length (norm). Queries are dealt into blocks, and tasks share out the grid of both.

A query's terms are ordered by score bound, the largest product a term can make in the shard. What any set of terms
can add to a row is bounded twice: by the sum of their bounds, and by the product of the query's length on these terms
with the row's (Cauchy-Schwarz); the smaller one holds. Against the query's threshold (its k-th best score so far):

* a shard whose bound over all terms is under the threshold is skipped;
* the terms at the end that together stay under `EDGE` times the threshold are non-essential: only the postings of the
  others are traversed;
* rows whose partial score plus the bound of the rest reaches the threshold are competitive, and are probed in the other
  terms, `STEP` at a time, while they stay so.

Any value of `EDGE` gives the same rows; it weighs traversal against probing. Thresholds start at the k-th best score of
the first shard, which all queries meet beforehand, and rise from shard to shard of a task; the tasks' results
merge by score, ties to the smaller id.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of different
lengths share the terms that both have; empty vectors score 0 with everything; rows with equal ids are separate
candidates, but not of queries with that id, and ask once (with the least of their vectors); a null id takes no part;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import discard, materialize, table, tidy
from loomwork.llm._grid import grid, matrix, numbered, packed, unpacked

SHARD, QUERIES_A_BLOCK = 8192, 512
EDGE, STEP = 0.5, 8


def valid(vector: Column, nonzero: bool = False) -> Column:
    """Not null, and every component is a finite number (and not all are zero)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = vector.isNotNull() & F.coalesce(finite, F.lit(False))
    return ok & F.exists(vector, lambda x: x != 0) if nonzero else ok


class Shard:
    """Postings of some rows: `post[t]` holds every row's weight in term t."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.post = ids, np.ascontiguousarray(weights.T)
        self.low, self.high = (f(axis=1) if len(ids) else np.zeros(len(self.post)) for f in (self.post.min, self.post.max))
        self.norm = np.sqrt((self.post.astype(np.float64) ** 2).sum(axis=0))
        self.most = int(max(np.abs(self.low.astype(object)).max(initial=0), np.abs(self.high.astype(object)).max(initial=0)))


@dataclass
class Work:
    """Products made while traversing and probing, and those of comparing everything."""

    traversed: int = 0
    probed: int = 0
    skipped: int = 0
    everything: int = 0


@dataclass
class Search:
    """The k best rows so far of each query; `theta` is its threshold, -inf before there is one."""

    own: np.ndarray
    queries: np.ndarray
    theta: np.ndarray
    k: int
    work: Work = field(default_factory=Work)

    def __post_init__(self):
        self.theta = self.theta.astype(np.float64)
        none = np.empty(0, dtype=np.int64)
        self.best = [(none, none) for _ in self.own]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = ids != self.own[q]
        i, s = np.concatenate([self.best[q][0], ids[keep]]), np.concatenate([self.best[q][1], scores[keep].astype(np.int64)])
        if len(s) > 4 * self.k:
            some = s >= np.partition(s, -self.k)[-self.k]
            i, s = i[some], s[some]
        o = np.lexsort((i, -s))[: self.k]
        self.best[q] = (i[o], s[o])
        if len(o) == self.k:
            self.theta[q] = max(self.theta[q], float(s[o[-1]]))

    def visit(self, shard: Shard) -> None:
        terms = min(self.queries.shape[1], len(shard.post))
        queries, post = self.queries[:, :terms], shard.post[:terms]
        most = int(np.abs(queries.astype(object)).max(initial=0)) * shard.most * max(terms, 1)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object  # sums are exact in it
        queries, post = queries.astype(kind), post.astype(kind)
        self.work.everything += len(queries) * post.size
        fresh = np.isneginf(self.theta)
        if fresh.any():
            every = queries[fresh] @ post if terms else np.zeros((int(fresh.sum()), len(shard.ids)))
            self.work.traversed += int(fresh.sum()) * post.size
            for q, scores in zip(np.flatnonzero(fresh), every, strict=True):
                self.add(q, shard.ids, scores)
        q64 = queries.astype(np.float64)
        bound = np.maximum(np.maximum(q64 * shard.high[:terms].astype(np.float64), q64 * shard.low[:terms].astype(np.float64)), 0)
        order = np.argsort(-bound, axis=1, kind="stable")
        none = np.zeros((len(queries), 1))
        # by place j in the order: what the terms from j on can add, as a sum and as a length
        rest = np.hstack([np.cumsum(np.take_along_axis(bound, order, axis=1)[:, ::-1], axis=1)[:, ::-1], none]) * (1 + 1e-9)
        length = np.sqrt(np.hstack([np.cumsum((np.take_along_axis(q64, order, axis=1) ** 2)[:, ::-1], axis=1)[:, ::-1], none])) * (1 + 1e-9)
        longest = shard.norm.max(initial=0.0)
        both = np.minimum(rest, length * longest)
        essential = (both > np.maximum(EDGE * self.theta, 0)[:, None]).sum(axis=1)
        for q in np.flatnonzero(~fresh):
            theta = self.theta[q] - 1e-9 * abs(self.theta[q]) - 1e-6
            if both[q, 0] < theta:
                self.work.skipped += 1
                continue
            at, own = int(essential[q]), queries[q]
            t = order[q, :at]
            score = own[t] @ post[t] if at else np.zeros(len(shard.ids))
            self.work.traversed += at * len(shard.ids)
            row = np.flatnonzero(score >= theta - np.minimum(rest[q, at], length[q, at] * shard.norm))
            score = score[row]
            while at < terms and len(row):
                t = order[q, at : at + STEP]
                score = score + own[t] @ post[t[:, None], row]
                self.work.probed += len(t) * len(row)
                at += len(t)
                keep = score >= theta - np.minimum(rest[q, at], length[q, at] * shard.norm[row])
                row, score = row[keep], score[keep]
            if len(row):
                self.add(q, shard.ids[row], score)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, weights) as shards of at most SHARD rows, in their order."""
    part, seq, held = TaskContext.get().partitionId(), 0, []
    names = ["shard", "n", "ids", "weights"]

    def shard() -> pa.RecordBatch:
        nonlocal seq, held
        t = pa.Table.from_batches(held).combine_chunks()
        whole, rest = t.slice(0, SHARD), t.slice(SHARD)
        held = rest.to_batches()
        seq += 1
        ids, weights = whole.column(0).to_numpy(), matrix(whole.column(1).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([len(ids)], pa.int32()), pa.array([packed(ids)]), pa.array([packed(weights)])], names=names)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        while sum(b.num_rows for b in held) >= SHARD:
            yield shard()
    if held:
        yield shard()


def _meet(k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, ids, weights, q_ids, q_weights, q_theta): a query block and a shard each, in any order."""
        searches: dict[int, Search] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column("block")[r].as_py()
                if block not in searches:
                    own = batch.column("q_ids")[r].values.to_numpy(zero_copy_only=False)
                    theta = batch.column("q_theta")[r].values.to_numpy(zero_copy_only=False)
                    searches[block] = Search(own, matrix(batch.column("q_weights")[r].values), theta, k)
                n = batch.column("n")[r].as_py()
                ids = unpacked(batch.column("ids")[r].as_py(), n)[:, 0].astype(np.int64)
                searches[block].visit(Shard(ids, unpacked(batch.column("weights")[r].as_py(), n)))
        for s in searches.values():
            size = [len(i) for i, _ in s.best]
            cols = [np.repeat(s.own, size), *(np.concatenate([b[j] for b in s.best]) for j in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])

    return kernel


def topk(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of `vectors` (vec_id, weights array<long>)."""
    rows = vectors.where("vec_id is not null and weights is not null").select("vec_id", "weights", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(rows, "vectors")
    norm = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    order = [F.desc("norm"), F.col("vec_id"), F.xxhash64("weights")]
    sorted_rows = rows.withColumn("norm", norm).repartitionByRange(max(1, -(-rows.count() // SHARD)), *order).sortWithinPartitions(*order)
    shards = materialize(sorted_rows.select("vec_id", "weights").mapInArrow(tidy(_shards), "shard long, n int, ids binary, weights binary"), "shards")
    shards = numbered(shards, "shard", "no")
    asked = materialize(rows.where("asks").groupBy("vec_id").agg(F.min("weights").alias("weights")), "asked")
    blocks = max(1, -(-asked.count() // QUERIES_A_BLOCK))

    def meet(queries: DataFrame, held: DataFrame) -> DataFrame:
        """The k best of each query (vec_id, weights, theta) among the held shards."""
        one = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        one = one.groupBy("block").agg(*[F.collect_list(c).alias(f"q_{o}") for c, o in (("vec_id", "ids"), ("weights", "weights"), ("theta", "theta"))])
        met = grid(one, held).select("block", "q_ids", "q_weights", "q_theta", "n", "ids", "weights")
        return met.mapInArrow(tidy(_meet(k)), "query_id long, vec_id long, score long")

    none = F.lit(float("-inf"))
    first = materialize(meet(asked.withColumn("theta", none), shards.where("no = 0")), "first")
    theta = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("theta"))
    later = shards.where("no > 0").withColumn("no", F.col("no") - 1)
    rest = materialize(meet(asked.join(theta, "vec_id", "left").withColumn("theta", F.coalesce("theta", none)), later), "rest")
    discard(rows, shards, asked)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.union(rest).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of each component of the valid vectors."""
    ok = embeddings.where(valid(F.col("embedding")))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("weights"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op3_exact_topk": op3_exact_topk}
ORACLE = {
    "op3_exact_topk": """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter([coalesce(isfinite(x), false) FOR x IN embedding], lambda b: NOT b)) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
