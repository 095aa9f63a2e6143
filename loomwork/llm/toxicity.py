"""Toxicity scoring behind a noisy-channel deobfuscator.

1. A character trigram model is counted over every text (letters folded to a-z, one sign for other letters, one
   for anything else): 28**3 counts, whatever the corpus's size.
2. Suspicious spans (look-alike signs among letters, spaced-out or dotted letters, stretched letters) become
   lattices: each sign may stand for the letters it looks like, a separator or repeated letter may stand for
   nothing. Viterbi finds the spelling of the least cost under the trigram model and the channel's costs; it
   replaces the span.
3. The restored text's words, and their first 4 to 7 bytes, once and repeated, are looked up among the signs of toxicity: those
   which a sample of at most `SAMPLE` labelled documents (in hash order) ties to the label, by G-test, with
   their log odds as weights; the `most_signs` most telling ones, a parameter of the model's size like the sample's. A logistic model over the strongest weight and the weights' sum gives the score.

Defined cases: null or empty text scores like a text without signs; without labelled documents of both kinds in
the training fold every score is the share of toxic labels there (0 if none); null labels and labels of unknown
documents are not learned from; documents with several labels count as toxic if one says so; rows with a null
doc_id are scored, not held out, never learned from; repeated rows are scored each; extra columns pass through
`score`, those named like its results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import free_names, materialize, table, tidy
from loomwork.llm._words import byte_hashes, mix, slices

SAMPLE = 20_000
THRESHOLD = 0.3
CODES = 1 << 22
#: Least G statistic and log odds of a sign. All signs that have both are kept; there are CODES codes at most.
LEAST_G, LEAST_ODDS = 25.0, 1.5
#: Spans that a task remembers the spelling of.
SPANS = 50_000
PREFIXES = (4, 5, 6, 7)

# What each sign can stand for. Common look-alikes.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
_SIGNS = re.escape("".join(LOOKS))
_GAP = r"[ .\-_*~'·]"
SUSPECT = re.compile(
    rf"(?<![^\W_])[a-z]*(?:[{_SIGNS}*]+[a-z]+)+[{_SIGNS}]*"  # look-alikes among letters
    rf"|(?<![^\W_])[a-z{_SIGNS}](?:{_GAP}{{1,2}}[a-z{_SIGNS}]){{3,}}(?![^\W_])"  # single letters with gaps
    r"|(?<![^\W_])[a-z]*([a-z])\1\1[a-z]*",  # stretched letters
    re.I,
)


# ---- character model -------------------------------------------------------------------------------------------

_FOLD = np.zeros(256, dtype=np.int64)
_FOLD[ord("a") : ord("z") + 1] = np.arange(1, 27)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_FOLD[0xC3:0xF5] = 27  # first bytes of other letters; the bytes that follow are skipped
_SKIP = np.zeros(256, dtype=bool)
_SKIP[0x80:0xC0] = True


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(28**3, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch, "text"):
            borders = np.zeros(len(data) + 1, dtype=bool)
            borders[offsets] = True
            own = ~_SKIP[data]
            code = _FOLD[data[own]]
            # two blank signs before each text and after the last, so that counts do not depend on how texts are dealt
            at = np.flatnonzero(borders[:-1][own])
            code = np.concatenate([np.insert(code, np.repeat(at, 2), 0), [0, 0]])
            total += np.bincount(code[:-2] * 784 + code[1:-1] * 28 + code[2:], minlength=28**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])


def char_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [previous two, next] over 28 signs, counted over all texts."""
    counts = docs.select("text").mapInArrow(tidy(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(28**3)
    n[[r[0] for r in counts]] = [r[1] for r in counts]
    n = n.reshape(28, 28, 28)
    two = n.sum(axis=0) + 0.5
    back = two / two.sum(axis=1, keepdims=True)
    return np.log((n + 8 * back[None]) / (n.sum(axis=2, keepdims=True) + 8))


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest letters behind a span: Viterbi over (previous two letters), one column per sign."""
    signs = span.lower()
    # a path is its last letter and the path before: spans of any length take time in proportion
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, c in enumerate(signs):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        letters = [(c, 0.0)] if "a" <= c <= "z" else [(x, 0.7) for x in LOOKS.get(c, "")]
        for (a, b), (cost, path) in beam.items():
            drop = None
            if not letters or c == "*" or not c.isalnum() and c not in LOOKS:
                drop = 0.1
            elif path and letters[0][0] == path[1]:
                drop = 1.0 if i > 1 and signs[i - 1] == c and signs[i - 2] == c or i + 1 < len(signs) and signs[i - 1] == c and signs[i + 1] == c else 3.0
            elif letters[0][1]:
                drop = 9.0
            if drop is not None and new.get((a, b), (math.inf,))[0] > cost + drop:
                new[a, b] = (cost + drop, path)
            for x, extra in letters:
                k = ord(x) - 96
                to = cost + extra - model[a, b, k]
                if new.get((b, k), (math.inf,))[0] > to:
                    new[b, k] = (to, (path, x))
        beam = new
    ends = [(cost - model[a, b, 0], path) for (a, b), (cost, path) in beam.items()]
    least = min((cost for cost, _ in ends), default=0)
    return min((_spelt(path) for cost, path in ends if cost == least), default="")


def _spelt(path: tuple | None) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def restore(text: str, model: np.ndarray, known: dict[str, str] | None = None) -> str:
    """The text with every suspicious span spelled out; `known` remembers spans of this model."""
    known = {} if known is None else known

    def spell(m: re.Match) -> str:
        span = m.group(0).lower()
        if (out := known.get(span)) is None:
            if len(known) >= SPANS:
                known.clear()
            out = known[span] = decode(span, model)
        return out

    return SUSPECT.sub(spell, text)


# ---- signs -----------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, code) of the words of each text and of their first bytes; several arrays."""
    data = _LOWER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[upper] += 32
    n, letter = len(data), _LETTER[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) & ~border[:-1] if n else np.zeros(0, dtype=bool)
    after = np.concatenate([letter[1:], [False]]) & ~border[1:] if n else np.zeros(0, dtype=bool)
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    size = end - start
    yield text, ((byte_hashes(data, start, size) + np.uint64(1000)) % np.uint64(CODES)).astype(np.int64)
    for k in PREFIXES:
        long = size >= k
        yield text[long], (byte_hashes(data, start[long], np.full(int(long.sum()), k)) % np.uint64(CODES)).astype(np.int64)


def _again(pairs: np.ndarray) -> np.ndarray:
    """Distinct (text, code) pairs, with further codes for those that a text has twice and three times."""
    once, n = np.unique(pairs, return_counts=True)
    more = []
    for k in (2, 3):
        some = once[n >= k]
        more.append(some - some % CODES + (mix((some % CODES).astype(np.uint64) + np.uint64(k << 40)) % np.uint64(CODES)).astype(np.int64))
    return np.unique(np.concatenate([once, *more]))


def _restored(batch: pa.RecordBatch, column: str, model: np.ndarray, known: dict[str, str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    i = batch.schema.get_field_index(column)
    for lo in range(0, batch.num_rows, 256):
        texts = [restore(t or "", model, known) for t in batch.column(i).slice(lo, 256).to_pylist()]
        for a, b, data, offsets in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]), "t"):
            yield lo + a, lo + b, data, offsets


def _count(model: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of either label by code: rows (toxic, text)."""
        known: dict[str, str] = {}
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in _restored(batch, "text", model, known):
                pairs = _again(np.concatenate([t * CODES + c for t, c in codes(data, offsets)]))
                bad = toxic[lo + pairs // CODES] > 0
                code, at = np.unique(pairs % CODES, return_inverse=True)
                pos = np.bincount(at, weights=bad, minlength=len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(pos), pa.array(np.bincount(at, minlength=len(code)) - pos)], names=["code", "pos", "neg"])

    return kernel


def _evidence(model: np.ndarray, weights: dict[int, float], text: str):
    """Appends (strongest, total, signs) to each row's columns but `text`."""
    keys = np.fromiter(weights.keys(), dtype=np.int64, count=len(weights))
    values = np.fromiter(weights.values(), dtype=np.float32, count=len(weights))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(CODES, dtype=np.float32)
        w[keys] = values
        lead, known = w > 0, {}
        for lo in range(0, CODES, 1 << 16):
            some = np.arange(lo, lo + (1 << 16), dtype=np.uint64)
            for k in (2, 3):
                lead[lo : lo + (1 << 16)] |= w[(mix(some + np.uint64(k << 40)) % np.uint64(CODES)).astype(np.int64)] > 0
        for batch in batches:
            n = batch.num_rows
            top, total, signs = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
            for lo, _, data, offsets in _restored(batch, text, model, known):
                # only codes that lead to a sign, alone or repeated, are sorted
                found = [t[lead[c]] * CODES + c[lead[c]] for t, c in codes(data, offsets)]
                pairs = _again(np.concatenate(found))
                pairs = pairs[w[pairs % CODES] > 0]
                row, weight = lo + pairs // CODES, w[pairs % CODES]
                np.maximum.at(top, row, weight)
                np.add.at(total, row, weight)
                np.add.at(signs, row, 1)
            i = batch.schema.get_field_index(text)
            keep = [j for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j) for j in keep), pa.array(top), pa.array(total), pa.array(signs)],
                names=[*(batch.schema.names[j] for j in keep), "strongest", "total", "signs"],
            )

    return kernel


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and slopes by Newton's method, slopes shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample_of(labels: DataFrame, label: str, held_out, limit: int = SAMPLE) -> DataFrame:
    """At most `limit` labelled ids (id, y) outside the held-out fold, in hash order: bounded, so it may be broadcast."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    one = one.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def score(docs: DataFrame, labels: DataFrame, held_out_parts: int = 4, held_out_part: int = 2, limit: int = SAMPLE, keep_text: bool = False, most_signs: int = CODES) -> DataFrame:
    """docs (doc_id, text, ...), without text unless asked, with held_out, score, predicted, strongest, total and signs."""
    spark = docs.sparkSession
    results = ["held_out", "score", "predicted", "strongest", "total", "signs"]
    own = [c for c in docs.columns if (keep_text or c != "text") and c not in results]
    model = char_model(docs)
    held = F.coalesce(fold(F.col("doc_id"), held_out_parts) == held_out_part, F.lit(False))
    rows = sample_of(labels, "toxic", held, limit).collect()
    known = spark.createDataFrame([(r[0], r[1]) for r in rows], "_id long, _y int")
    learn = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(known), "_id").select("_y", "text", "_id")
    counts = learn.select("_y", "text").mapInArrow(tidy(_count(model)), "code long, pos long, neg long").groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n_pos = sum(r[1] for r in rows)
    n_neg = len(rows) - n_pos
    weights: dict[int, float] = {}
    if n_pos and n_neg:
        p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
        share = F.lit(n_pos / (n_pos + n_neg))
        part = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
        g = 2 * (part(p, (p + q) * share) + part(q, (p + q) * (1 - share)))
        odds = F.log(((p + 0.5) / (n_pos + 1.0)) / ((q + 0.5) / (n_neg + 1.0)))
        found = counts.select("code", g.alias("g"), odds.alias("w")).where((F.col("g") >= LEAST_G) & (F.col("w") >= LEAST_ODDS))
        weights = {r[0]: r[2] for r in found.orderBy(F.desc("g"), "code").limit(most_signs).collect()}
    [text] = free_names([*docs.columns, *results], "_text")
    kernel, shape = tidy(_evidence(model, weights, text)), "strongest double, total double, signs long"
    w = None
    if weights:
        seen = learn.select("_y", F.col("text").alias(text)).mapInArrow(kernel, f"_y int, {shape}").select("_y", "strongest", "total")
        x = np.array(seen.groupBy("_y", "strongest", "total").count().orderBy("_y", "strongest", "total").collect(), dtype=float).reshape(-1, 4)
        x = np.repeat(x, x[:, 3].astype(int), axis=0)
        w = logistic(np.column_stack([x[:, 1], np.log1p(x[:, 2])]), x[:, 0])
    fields = [docs.schema[c] for c in own]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), shape])
    out = docs.select(*own, F.col("text").alias(text)).mapInArrow(kernel, schema)
    if w is None:
        z = F.lit(float(n_pos / len(rows)) if rows else 0.0)
    else:
        z = 1 / (1 + F.exp(-(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("strongest") + F.lit(float(w[2])) * F.log1p("total"))))
    out = out.withColumn("held_out", held).withColumn("score", z)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select(*own, *results)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
