"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts (shares of character classes, word and line shapes, repetition) come from one
vectorised pass. Trees are grown on the driver from a sample of at most `SAMPLE` labelled documents (in hash
order, outside the held-out fold): features are cut into at most `BINS` quantile bins, split gains come from
gradient and curvature histograms. The trees are then flattened into arrays (feature, cut, left, right, value)
that executors traverse for all rows of a batch at once, level by level.

Defined cases: null or empty text has all statistics 0 and is scored; without labelled documents of both kinds
every score is the share of label 1 in the training fold (0.5 if it is empty); null labels are not learned from;
documents with several labels count as 1 if one says so; rows with a null doc_id are scored, not held out, never
learned from; repeated rows are scored each; extra columns pass through `score`, those named like its results are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import free_names, materialize, table, tidy
from loomwork.llm._words import Words, slices
from loomwork.llm.toxicity import fold, sample_of

SAMPLE = 20_000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 64, 80, 4, 0.15, 15, 1.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
    "stop": map(ord, ".!?"), "comma": map(ord, ",;:"), "bar": (124,), "mark": map(ord, "!"), "sign": map(ord, "#$%&*+=<>@^_~\\/"),
    "brace": map(ord, "{}[]()"), "quote": map(ord, "\"'`"), "high": range(128, 256),
}
_MEMBER = np.zeros((len(_CLASSES), 256), dtype=bool)
for _i, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[_i, list(_bytes)] = True

FEATURES = [
    "log_bytes", "log_words", *(f"share_{c}" for c in _CLASSES), "word_length", "word_spread", "long_words", "distinct_words",
    "top_word", "echo", "words_a_line", "distinct_lines", "signed_ends", "upper_starts",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a slice."""
    n, size = len(offsets) - 1, np.diff(offsets)
    w = Words(data, offsets)
    words = np.diff(w.first)
    out = np.zeros((n, len(FEATURES)))
    safe, safe_words = np.maximum(size, 1), np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)

    def per_text(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[w.first[1:]] - total[w.first[:-1]]

    for i, member in enumerate(_MEMBER):
        total = np.concatenate([[0], np.cumsum(member[data])])
        out[:, 2 + i] = (total[offsets[1:]] - total[offsets[:-1]]) / safe
    k = 2 + len(_CLASSES)
    length = w.end - w.start
    mean = per_text(length) / safe_words
    out[:, k], out[:, k + 1] = mean, np.sqrt(np.maximum(per_text(length**2) / safe_words - mean**2, 0))
    out[:, k + 2] = per_text(length > 12) / safe_words
    text = np.repeat(np.arange(n), words)
    if len(text):
        order = np.lexsort((w.hash, text))
        h, t = w.hash[order], text[order]
        new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        own = t[new]
        out[:, k + 3] = np.bincount(own, minlength=n) / safe_words
        top = np.zeros(n)
        np.maximum.at(top, own, run)
        out[:, k + 4] = top / safe_words
        same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1]))
        out[:, k + 5] = per_text(same) / safe_words
        out[:, k + 8] = per_text(_MEMBER[9][data[w.end - 1]] | (data[w.end - 1] == 33)) / safe_words
        out[:, k + 9] = per_text(_MEMBER[0][data[w.start]]) / safe_words
        # lines: words of a line are hashed together
        line = np.concatenate([[0], np.cumsum(data == 10)])[w.start] + text * 1
        first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])))
        lines = np.bincount(text[first], minlength=n)
        out[:, k + 6] = words / np.maximum(lines, 1)
        place = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
        whole = np.add.reduceat(w.hash * (2 * place.astype(np.uint64) + np.uint64(1)), first)
        order = np.lexsort((whole, text[first]))
        h, t = whole[order], text[first][order]
        new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))
        out[:, k + 7] = np.bincount(t[new], minlength=n) / np.maximum(lines, 1)
    return out


def _scan(text: str, out: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            keep = [j for j in range(batch.num_columns) if j != i]
            for lo, hi, data, offsets in slices(batch, text):
                x = statistics(data, offsets)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(lo, hi - lo) for j in keep), rows], names=[*(batch.schema.names[j] for j in keep), out])

    return kernel


def with_statistics(docs: DataFrame, out: str) -> DataFrame:
    """docs without text, with `out`, a name that docs lack: array<double> of FEATURES."""
    own = [f for f in docs.schema.fields if f.name != "text"]
    [text] = free_names([*docs.columns, out], "_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), f"`{out}` array<double>"])
    return docs.select(*(f.name for f in own), F.col("text").alias(text)).mapInArrow(tidy(_scan(text, out)), schema)


class Trees:
    """Boosted trees in flat arrays; a leaf points to itself."""

    def __init__(self, base: float):
        self.base = base
        self.roots: list[int] = []
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        for a, v in ((self.feature, 0), (self.cut, np.inf), (self.value, 0.0)):
            a.append(v)
        self.left.append(len(self.value) - 1)
        self.right.append(len(self.value) - 1)
        return len(self.value) - 1

    def freeze(self) -> Trees:
        self.feature, self.left, self.right, self.roots = (np.array(a, dtype=np.int32) for a in (self.feature, self.left, self.right, self.roots))
        self.cut, self.value = np.array(self.cut), np.array(self.value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all trees and rows take one step at a time."""
        z = np.full(len(x), self.base)
        if len(self.roots):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            z += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Gradient boosting for the logistic loss on binned features."""
    share = min(max(y.mean(), 1e-6), 1 - 1e-6) if len(y) else 0.5
    out = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return out.freeze()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    z = np.full(len(y), out.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        root = out.node()
        out.roots.append(root)
        level = [(root, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            after = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None, None)
                if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
                    for f in range(len(cuts)):
                        if not len(cuts[f]):
                            continue
                        b = binned[f, rows]
                        m = len(cuts[f]) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=m))[:-1] for v in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                        gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, k)
                if best[1] is None:
                    out.value[node] = float(RATE * gs / (hs + RIDGE))
                    z[rows] += out.value[node]
                    continue
                _, f, k = best
                low = binned[f, rows] <= k
                out.feature[node], out.cut[node] = f, float(cuts[f][k])
                out.left[node], out.right[node] = out.node(), out.node()
                after += [(out.left[node], rows[low]), (out.right[node], rows[~low])]
            level = after
    return out.freeze()


def _apply(trees: Trees, column: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            x = batch.column(i).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES)) if batch.num_rows else np.zeros((0, len(FEATURES)))
            keep = [j for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in keep), pa.array(trees.predict(x))], names=[*(batch.schema.names[j] for j in keep), "score"])

    return kernel


def score(docs: DataFrame, labels: DataFrame, held_out_parts: int = 5, held_out_part: int = 0, limit: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, ...) without text, with held_out, score, predicted."""
    spark = docs.sparkSession
    results = ["held_out", "score", "predicted"]
    own = [c for c in docs.columns if c not in ("text", *results)]
    held = F.coalesce(fold(F.col("doc_id"), held_out_parts) == held_out_part, F.lit(False))
    rows = sample_of(labels, "quality", held, limit).collect()
    known = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in rows], "_id long, _y int"))
    [x_name] = free_names([*docs.columns, *results], "_x")
    seen = materialize(with_statistics(docs.select(*own, "text"), x_name), "statistics")
    # a document of the sample is learned from once, whatever rows have its id
    learn = seen.select(F.col("doc_id").cast("long").alias("_id"), F.col(x_name).alias("_x")).join(known, "_id").groupBy("_id", "_y").agg(F.min("_x").alias("_x"))
    learn = learn.orderBy("_id").select("_y", "_x").toPandas()
    x = np.array(learn["_x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    trees = grow(x, learn["_y"].to_numpy(dtype=float))
    fields = [docs.schema[c] for c in own]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])
    out = seen.mapInArrow(tidy(_apply(trees, x_name)), schema).withColumn("held_out", held)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select(*own, *results)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
