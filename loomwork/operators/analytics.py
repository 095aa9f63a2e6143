"""Topics, links, scores, retrieval, vectors, graphs and evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.shared import folder, written

# ---- topics ----------------------------------------------------------------------------------------------------


def topic_of(text: Column, rules: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """The topic with most distinct keywords in the folded text; ties to the topic listed first.

    Single words meet the text's words in one intersection of arrays; only phrases are searched for.
    """
    single = {t: [w for w in ws if re.fullmatch("[a-z0-9_]+", w)] for t, ws in rules.items()}
    every = sorted({w for ws in single.values() for w in ws})
    # one pass over the text: its distinct words among the rules'
    held = F.array_intersect(F.array(*map(F.lit, every)), F.regexp_extract_all(text, F.lit(r"[a-z0-9_]+"), F.lit(0))) if every else F.array()

    def best(found: Column) -> Column:
        hits = []
        for i, (topic, words) in enumerate(rules.items()):
            own = F.size(F.array_intersect(found, F.array(*map(F.lit, single[topic])))) if single[topic] else F.lit(0)
            phrases = [F.when(T.whole_word(text, w), 1).otherwise(0) for w in words if w not in single[topic]]
            hits.append(F.struct(sum(phrases, own).alias("n"), F.lit(-i).alias("i"), F.lit(topic).alias("topic")))
        return F.array_max(F.array(*hits))

    top = F.transform(F.array(held), best)[0]
    return F.when(top["n"] > 0, top["topic"]).otherwise(F.lit(other))


def local_relation(text: Column, host: Column, words: tuple[str, ...], domains: tuple[str, ...]) -> Column:
    """Why an item is local: word:..., domain:..., or null."""
    by_word = F.concat(F.lit("word:"), T.first_keyword(text, words))
    by_domain = F.coalesce(*[F.when(T.domain_matches(host, d), F.lit(f"domain:{d}")) for d in domains])
    return F.coalesce(by_word, by_domain)


# ---- vectors ---------------------------------------------------------------------------------------------------


#: Vectors of a block; blocks of a part, and the least number of parts. A task holds two parts, whatever the input's size.
BLOCK, PART, PARTS = 4096, 32, 16
_BLOCKS = "b long, early double, late double, k array<long>, h array<double>, v array<double>"


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(b, early, late, k, h, v) of rows (k, h, v): blocks of up to `block` rows that stand side by side in time, written once.

    v holds the vectors one after the other. A block with an undated row has no bounds: early and late are infinite.
    """
    n = rows.count()
    parts = max(1, min(-(-n // block), PARTS), -(-n // (PART * block)))
    # a hot moment, and all rows without a date, are dealt by the keys' hash
    order = ["h", F.xxhash64("k")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else rows.coalesce(1).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                k, h, v = batch.slice(at, block).columns
                flat, hours = v.flatten(), h.to_numpy(zero_copy_only=False).astype(float)
                if len(flat) % len(k) or pc.count_distinct(pc.list_value_length(v)).as_py() > 1:
                    raise ValueError("vectors differ in length")
                open_ended = np.isnan(hours).any()
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                ends = [pa.array([-np.inf if open_ended else hours.min()]), pa.array([np.inf if open_ended else hours.max()])]
                yield pa.RecordBatch.from_arrays([pa.array([(part << 33) + place]), *ends, one(k), one(h), one(flat)], names=["b", "early", "late", "k", "h", "v"])
                place += 1

    return written(ranged.select("k", "h", "v").mapInArrow(pack, _BLOCKS), "vector-blocks")


def _met(blocks: DataFrame, window: float = float("inf")) -> DataFrame:
    """(b, c, k, h, v, k2, h2, v2): every two blocks b <= c that may hold rows within `window` hours of each other.

    Tasks read parts of the written blocks against each other: nothing is shuffled, so that only reading grows as the pairs.
    """
    other = blocks.select(F.col("b").alias("c"), F.col("early").alias("early2"), F.col("late").alias("late2"), *[F.col(x).alias(f"{x}2") for x in "khv"])
    near = (F.col("early") <= F.col("late2") + F.lit(window)) & (F.col("early2") <= F.col("late") + F.lit(window))
    return blocks.crossJoin(other).where((F.col("b") <= F.col("c")) & near).select("b", "c", *"khv", "k2", "h2", "v2")


def _block_pairs(vectors: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """_met() of all vectors, dealt by a hash of the key, so that blocks are even whatever the keys."""
    v = vectors.select(F.col(key).cast("long").alias("k"), F.lit(None).cast("double").alias("h"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return _met(_blocks(v.where("v is not null"), block))


#: Rows of a block that are compared at a time.
_STRIP = 512


def _units(r) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a pair of blocks, of unit length."""
    both = (np.asarray(x, dtype=float).reshape(len(k), -1) for x, k in ((r.v, r.k), (r.v2, r.k2)))
    return tuple(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in both)


def _pairs_of(met: DataFrame, least: float, window: float = float("inf")) -> DataFrame:
    """(a, b, cosine), a < b, of at least `least` in pairs of blocks, rows within `window` hours or undated.

    Products in single precision leave out what is too far by more than their error; the others are computed in double.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                u, w = _units(r)
                x, y = u.astype(np.float32), w.astype(np.float32).T
                floor = np.float32(least - (u.shape[1] + 8) * 2.0**-22)
                h, h2, k, k2 = np.asarray(r.h, dtype=float), np.asarray(r.h2, dtype=float), np.asarray(r.k), np.asarray(r.k2)
                for at in range(0, len(x), _STRIP):
                    # what is not a number is not near
                    i, j = np.divmod(np.flatnonzero(x[at : at + _STRIP] @ y >= floor), len(w))
                    i += at
                    cosine = np.einsum("ij,ij->i", u[i], w[j])
                    a, b = k[i], k2[j]
                    keep = (cosine >= least) & ~(np.abs(h[i] - h2[j]) > window) & (a < b if r.b == r.c else a != b)
                    yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": cosine[keep]})

    return met.mapInPandas(compare, "a long, b long, cosine double")


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """Exact pairs (a < b, cosine) of at least `least`, computed block against block."""
    return _pairs_of(_block_pairs(vectors, key, vector, block), least)


def _first_k(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each a by (-s, b)."""
    o = np.lexsort((b, -s, a))
    a, b, s = a[o], b[o], s[o]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k], s[place < k]


def nearest_rows(vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK, buffer: int = 1 << 20) -> DataFrame:
    """(a, b, cosine, rank): the k most similar other rows of every row, without a floor.

    Cosines count to 9 places, ties go to the smaller key. A task keeps k partners of each row that it has met.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            for r in f.itertuples(index=False):
                (u, w), ka, kb = _units(r), np.asarray(r.k), np.asarray(r.k2)
                for at in range(0, len(u), _STRIP):
                    rows = slice(at, at + _STRIP)
                    s = np.round(u[rows] @ w.T, 9)
                    for t, x, y in ((s, ka[rows], kb), (s.T, kb, ka[rows]))[: 1 if r.b == r.c else 2]:
                        t = np.where(x[:, None] == y[None, :], -np.inf, t)
                        last = np.partition(t, -k, axis=1)[:, -k] if t.shape[1] > k else np.full(len(x), -2.0)
                        i, j = np.nonzero((t >= last[:, None]) & (t >= -2))
                        held.append(_first_k(x[i], y[j], t[i, j], k))
                        n += len(held[-1][0])
                if n > buffer:
                    held = [_first_k(*map(np.concatenate, zip(*held, strict=True)), k)]
                    n = min(len(held[0][0]), buffer // 2)
        if held:
            a, b, c = _first_k(*map(np.concatenate, zip(*held, strict=True)), k)
            yield pd.DataFrame({"a": a, "b": b, "cosine": c})

    return _ranked(_block_pairs(vectors, key, vector, block).mapInPandas(compare, "a long, b long, cosine double"), k)


def _ranked(directed: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b")
    return directed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar partners of every row among the given pairs (a, b, cosine)."""
    return _ranked(pairs.select("a", "b", "cosine").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")), k)


def char_tfidf(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): character 3- to 5-grams within words, 1+ln(tf), smooth idf, unit length."""
    words = texts.select(F.col(key), F.explode(T.tokens(F.col(text))).alias("w")).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))

    def grams_of(n: int) -> Column:
        # a word as long as n gives itself, and no longer grams after that
        every = F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring(F.col("w"), i, F.lit(n)))
        return F.when(F.length("w") > n, every).when(F.length("w") == n, F.array("w")).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[grams_of(n) for n in (3, 4, 5)])
    tf = words.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = texts.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


# ---- graphs ----------------------------------------------------------------------------------------------------


#: Edges that a task joins at a time; a graph of no more is solved by one task, without rounds.
FOREST = 250_000


def _forest(edges: DataFrame, most: int) -> DataFrame:
    """(node, root) of edges (a, b), for every `most` edges that a task reads: roots are the smallest nodes, roots' own rows included.

    As edges the rows connect what the given ones connect, and are no more than these and the roots.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def made() -> pa.RecordBatch:
            roots = [top(x) for x in up]
            return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n + part.num_rows > most:
                    yield made()
                    up.clear()
                    n = 0
                n += part.num_rows
                for a, b in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    a, b = top(a), top(b)
                    if a != b:
                        up[max(a, b)] = min(a, b)
        yield made()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(kernel, "node long, root long")


def components(edges: DataFrame, shared: str | None = None, most: int = FOREST) -> DataFrame:
    """(node, root) of edges (a, b). Up to `most` edges are joined by one task. Of more, tasks first make forests of their own edges;
    then the smallest label is spread by joins with pointer jumping, cut by reliable checkpoints."""
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared or folder(spark))
    held = edges.select("a", "b").where("a <> b").checkpoint()
    if held.limit(most + 1).count() <= most:
        return _forest(held.coalesce(1), most).checkpoint()
    held = _forest(held, most).select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).checkpoint()
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        new = labels.join(spread, labels["node"] == spread["a"]).select("node", "root", F.least("root", "r").alias("new"))
        up = new.select(F.col("node").alias("new"), F.col("new").alias("top"))
        new = new.join(up, "new", "left").select("node", "root", F.least("new", F.coalesce("top", "new")).alias("new")).checkpoint()
        changed = new.where("new <> root").limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if not changed:
            return labels


def pairs_in_time(vectors: DataFrame, key: str, vector: str, hours: str, least: float, window: int, block: int = BLOCK) -> DataFrame:
    """similar_pairs() of rows whose `hours` lie within `window` of each other, or are missing for one.

    Rows are blocked in the order of time, so a block meets those up to `window` hours away only; blocks with rows
    without a date meet everything.
    """
    v = vectors.select(F.col(key).cast("long").alias("k"), F.col(hours).cast("double").alias("h"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v is not null")
    return _pairs_of(_met(_blocks(v, block), window), least, window)


# ---- retrieval -------------------------------------------------------------------------------------------------


#: Documents that a task of bm25() scores, about.
DOCS = 2048
#: Folders of a written index; a term's folder is its hash, so that a question opens those of its terms only.
FOLDERS = 64


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc, tf, dl): the postings of docs (doc, text) over folded white-space tokens, with the documents' lengths."""
    words = docs.select("doc", T.tokens(F.col("text")).alias("w"))
    return words.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(docs: DataFrame, df: DataFrame, floor: float = 0.25) -> DataFrame:
    """(term, idf, avgdl) of docs and their document frequencies (term, df); negative idf values become `floor` times the mean idf."""
    total = docs.select(F.size(T.tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    raw = df.join(F.broadcast(total)).select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))


def _scored(index: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    gain = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return index.join(asked, "term").groupBy("query", "doc").agg(F.sum(gain).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, small: int = 200_000) -> DataFrame:
    """(query, doc, score) of all hits: Okapi BM25 of queries (query, text) against docs (doc, text), one row a doc.

    Texts are dealt by doc once; term counts and scores then need no exchange, since a document's postings lie together.
    Only tokens that are asked for are counted; the asked terms are broadcast up to `small` of them, and joined by
    shuffles beyond. Document frequencies are counted before they are shuffled. A repeated query token counts each time.
    """
    asked = _asked(queries)
    near = F.broadcast if asked.limit(small + 1).count() <= small else lambda df: df
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a task counts and scores so many documents, whatever the input's size
    parts = max(-(-docs.count() // DOCS), docs.sparkSession.sparkContext.defaultParallelism)
    words = docs.select("doc", "text").repartition(parts, "doc").select("doc", T.tokens(F.col("text")).alias("w"))
    tokens = words.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).join(near(asked.select("term").distinct()), "term", "left_semi")
    index = tokens.groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return _scored(index, near(term_weights(docs, df, floor).join(near(asked), "term")), k1, b)


def _folder(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def write_index(docs: DataFrame, path: str, floor: float = 0.25) -> None:
    """The postings and weights of docs as tables by folders of terms, for any number of bm25_indexed() calls.

    Postings are dealt by ranges of (folder, doc), so that a very common term is spread over several tasks and files.
    """
    spark = docs.sparkSession
    rows = postings(docs).withColumn("folder", _folder("term"))
    rows.repartitionByRange("folder", "doc").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/postings")
    index = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = term_weights(docs, df, floor).withColumn("folder", _folder("term"))
    weights.repartition("folder").write.partitionBy("folder").parquet(f"{path}/weights")


def bm25_indexed(spark: SparkSession, path: str, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """bm25() from a written index: reads the folders of the queries' terms only (at most FOLDERS numbers come to the driver)."""
    asked = _asked(queries)
    met = [r[0] for r in asked.select(_folder("term")).distinct().collect()]
    read = lambda name, shape: spark.read.schema(f"{shape}, folder int").parquet(f"{path}/{name}").where(F.col("folder").isin(met)).drop("folder")
    doc = spark.read.parquet(f"{path}/postings").schema["doc"].dataType.simpleString()
    weights = read("weights", "term string, idf double, avgdl double")
    return _scored(read("postings", f"term string, doc {doc}, dl int, tf long"), asked.join(weights, "term"), k1, b)


def fuse(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.6) -> DataFrame:
    """(query, doc, score, cosine, lexical): alpha * semantic / max + (1 - alpha) * lexical / max, maxima by query."""
    both = semantic.join(lexical.withColumnRenamed("score", "lex"), ["query", "doc"], "full_outer").select("query", "doc", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("lex", F.lit(0.0)).alias("lex"))
    tops = both.groupBy("query").agg(F.max("cosine").alias("_s"), F.max("lex").alias("_l"))
    part = lambda x, m: F.when(m > 0, x / m).otherwise(0.0)
    score = alpha * part(F.col("cosine"), F.col("_s")) + (1 - alpha) * part(F.col("lex"), F.col("_l"))
    return both.join(tops, "query").select("query", "doc", score.alias("score"), "cosine", F.col("lex").alias("lexical"))


def first_of_tasks(scored: DataFrame, k: int, held: int = 1 << 18) -> DataFrame:
    """Rows (query, doc, score) of which top_k() keeps the same as of all: each task's k best of every query.

    Rows stream through a task, which holds `held` of them, or the k best of its queries if these are more, and sorts no others.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, most = [], 0, held
        for batch in batches:
            kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                kept = [_best(kept, k)]
                n = len(kept[0][0])
                most = max(held, 2 * n)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(_best(kept, k), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "doc", "score"])

    return scored.select(F.col("query").cast("long"), F.col("doc").cast("long"), F.col("score").cast("double")).mapInArrow(kernel, "query long, doc long, score double")


def _best(parts: list, k: int) -> list[np.ndarray]:
    """The k rows (query, doc, score) of each query that top_k() puts first, and those that may be equal to the last by rounding."""
    q, d, s = map(np.concatenate, zip(*parts, strict=True))
    o = np.lexsort((d, -s, q))
    q, d, s = q[o], d[o], s[o]
    first = np.searchsorted(q, q)
    ends = np.minimum(first + k, np.searchsorted(q, q, side="right")) - 1
    # scores count to nine places: those within a place of the k-th stay for top_k() to order
    keep = s >= s[ends] - 2e-9
    return [q[keep], d[keep], s[keep]]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def abstention(top: DataFrame, floor: float = 0.15, margin: float = 0.08) -> DataFrame:
    """(query, decision): below_floor, no_margin or answer, from the ranked rows (query, rank, cosine, lexical)."""
    g = top.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cosine"))).alias("c1"), F.max(F.when(F.col("rank") == 2, F.col("cosine"))).alias("c2"), F.max("lexical").alias("lex")
    )
    unsure = (F.col("lex") <= 0) & (F.col("c1") - F.coalesce("c2", F.lit(0.0)) < margin)
    return g.select("query", F.when(F.col("c1") < floor, "below_floor").when(unsure, "no_margin").otherwise("answer").alias("decision"))


# ---- decisions and claims --------------------------------------------------------------------------------------


def decide(asked: DataFrame, cache: DataFrame, provider=None) -> DataFrame:
    """(key, answer, origin): cached answers; the others from provider(DataFrame) -> (key, answer), or abstention."""
    hit = asked.join(cache, "key", "left")
    known = hit.where("answer is not null").select("key", "answer", F.lit("cache").alias("origin"))
    rest = hit.where("answer is null").drop("answer")
    if provider is None:
        new = rest.select("key", F.lit(None).cast("double").alias("answer"), F.lit("abstain").alias("origin"))
    else:
        new = provider(rest).select("key", "answer", F.lit("provider").alias("origin"))
    return known.unionByName(new)


def verdict(p: Column) -> Column:
    return F.when(p.isNull(), "pending").when(p >= 0.7, "supported").when(p < 0.4, "unsupported").otherwise("doubtful")


# ---- evaluation ------------------------------------------------------------------------------------------------


def confusion_scores(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, f1) of rows (truth, predicted), for labels that the truth has."""
    counts = pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    t = counts.groupBy(F.col("truth").alias("label")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("n_true"))
    p = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    x = t.join(p, "label", "left").withColumn("n_predicted", F.coalesce("n_predicted", F.lit(0)))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_true") + F.col("n_predicted"))).otherwise(0.0)
    return x.select("label", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), f1.alias("f1"))
