"""Substring deduplication with a log-structured fingerprint index.

Every text is cut into words; a window is `WINDOW` consecutive words. Windows are grouped into segments: the
consecutive windows of a text that share the smallest 8-word hash (their anchor). Equal windows have equal anchors, so
whatever two texts share in windows, they share under one anchor. The index holds sorted immutable runs of (anchor,
segment, first document): tables bucketed and sorted by anchor, so that a batch meets them by a merge join without
their being dealt out again. A new batch goes through it like this:

1. its segments become a run of their own: one row for each distinct segment, with the smallest document;
2. that run is merge-joined with every older run: segments that an earlier document has as a whole are repeats;
3. where one anchor leads different segments (the ends of shared passages), the texts holding them are read again and
   compared window by window;
4. `fanout` runs are compacted into one, when the next batch comes.

Hashes only pick the anchors. Whether segments or windows are equal is verified on their words, by 128-bit BLAKE2b
digests of the words' bytes; no two different texts with equal digests are known.

Only digests and places are shuffled for the search (about one row for 22 words), and minima are combined before
shuffling. A segment or window with a thousandth of all rows or more (there are a thousand of them at most) is joined
by broadcast, so no task gets all places of a common passage. No window is sampled away: each belongs to one segment.

Defined cases: null or empty text has no words; texts under `WINDOW` words are kept whole; a null doc_id is
neither before nor after any other, its text is kept whole; rows with equal doc_id never remove each other's
words (neither is smaller), each is judged alone; extra columns pass through `dedup`, a column named like an
output one is replaced, other names never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import discard, drop_path, free_names, materialize, setting, table, table_path, tidy
from loomwork.llm._words import Words, signed, slices

WINDOW = 50
ANCHOR = 8
#: Batches of the query and the stage: with two runs compacted into one, two compactions happen.
BATCHES, FANOUT = 4, 2
#: Rows of a segment or window, as a part of all, from which on it is joined by broadcast; bytes of text a bucket.
HEAVY, BUCKET_BYTES = 1000, 32 << 20
_SPAN = WINDOW - ANCHOR + 1
_PLACE = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 20

_SEGMENTS = "anchor long, d1 long, d2 long, doc_id long, tk long, s int, m int"
_WINDOWS = "d1 long, d2 long, doc_id long, tk long, s int"


def _chain_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _segments(anchors: np.ndarray, text: np.ndarray, valid: np.ndarray):
    """(anchor, first window, windows) of each segment of the valid windows."""
    packed = (anchors & ~_PLACE) | np.arange(len(anchors), dtype=np.uint64)
    at = (_chain_min(packed, _SPAN) & _PLACE).astype(np.int64)
    v = np.flatnonzero(valid)
    cut = np.ones(len(v), dtype=bool)
    cut[1:] = (at[v[1:]] != at[v[:-1]]) | (text[v[1:]] != text[v[:-1]])
    b = np.flatnonzero(cut)
    first = v[b]
    return anchors[at[first]], first, np.diff(np.append(b, len(v)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in slices(batch, "text"):
            w = Words(data, offsets)
            anchors = w.runs(ANCHOR)
            windows = max(0, len(w.hash) - WINDOW + 1)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
            parts = []
            for c in range(0, windows, _CHUNK):
                n = min(_CHUNK, windows - c)
                own = text[c : c + n]
                valid = np.arange(c, c + n) + WINDOW <= w.first[own + 1]
                if valid.any():
                    a, first, count = _segments(anchors[c : c + n + _SPAN - 1], own, valid)
                    parts.append((a, first + c, count))
            if parts:
                a, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
                row, digest = text[first], w.digests(first, count + WINDOW - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(a)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids[lo + row]), pa.array(keys[lo + row]),
                        pa.array((first - w.first[row]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    names=["anchor", "d1", "d2", "doc_id", "tk", "s", "m"],
                )


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of the asked segments of each text."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        asked = batch.column(3)
        place = asked.offsets.to_numpy()
        fields = {f: asked.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("s", "m")}
        for lo, hi, data, offsets in slices(batch, "text"):
            w = Words(data, offsets)
            a, b = place[lo], place[hi]
            s, m = fields["s"][a:b], fields["m"][a:b]
            one = np.repeat(np.arange(len(m)), m)
            local = s[one] + np.arange(len(one)) - np.repeat(np.cumsum(m) - m, m)
            row = np.repeat(np.arange(lo, hi), np.diff(place[lo : hi + 1]))[one]
            digest = w.digests(w.first[row - lo] + local, np.full(len(local), WINDOW))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids[row]), pa.array(keys[row]), pa.array(local.astype(np.int32))],
                names=["d1", "d2", "doc_id", "tk", "s"],
            )


def _cut(text: str, spans: str, respace: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes `text` and `spans`, the repeated (s, m) of the text, for kept_text, n_words and n_removed."""
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts, marked = (batch.column(batch.schema.get_field_index(c)) for c in (text, spans))
                place, present = marked.offsets.to_numpy(), marked.is_valid().to_numpy(zero_copy_only=False)
                s, m = (marked.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("s", "m"))
                kept, words, removed = [], [], []
                for i, t in enumerate(texts):
                    w = (t.as_py() or "").encode().split()
                    n = len(w)
                    if present[i] and place[i] < place[i + 1]:
                        edge = np.zeros(n + 1, dtype=np.int64)
                        at = slice(place[i], place[i + 1])
                        np.add.at(edge, s[at], 1)
                        np.add.at(edge, s[at] + m[at] - 1 + WINDOW, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        w = [w[j] for j in np.flatnonzero(keep)]
                    kept.append(b" ".join(w).decode() if respace or len(w) < n else t.as_py())
                    words.append(n)
                    removed.append(n - len(w))
                names = [x for x in batch.schema.names if x not in (text, spans)]
                cols = [batch.column(batch.schema.get_field_index(x)) for x in names]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(kept, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())],
                    names=[*names, "kept_text", "n_words", "n_removed"],
                )

    return kernel


def split_join(rows: DataFrame, found: DataFrame, keys: list[str], heavy) -> DataFrame:
    """Inner join of rows with a written table that is unique by `keys`; its `heavy` rows, few by a bound, are broadcast."""
    light = rows.join(found.where(~heavy), keys)
    return light.unionByName(rows.join(F.broadcast(found.where(heavy)), keys))


SEGMENT = ["anchor", "d1", "d2"]


class FingerprintIndex:
    """Sorted immutable runs of the segments seen so far: tables bucketed and sorted by anchor."""

    def __init__(self, spark: SparkSession, buckets: int = 8, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.runs: list[str] = []
        self.compactions = 0
        self._paths: dict[str, str] = {}

    def _run(self, rows: DataFrame) -> str:
        """Writes rows (anchor, d1, d2, doc_id, tk, s, m, n) as a run, one row a segment: its smallest place, its count."""
        least = rows.groupBy(*SEGMENT).agg(F.min(F.struct("doc_id", "tk", "s", "m")).alias("at"), F.sum("n").alias("n"))
        name = f"loomwork_run_{uuid.uuid4().hex}"
        self._paths[name] = table_path(self.spark, "run")
        dealt = least.select(*SEGMENT, "at.*", "n").repartition(self.buckets, "anchor").sortWithinPartitions(*SEGMENT)
        dealt.write.bucketBy(self.buckets, "anchor").sortBy(*SEGMENT).option("path", self._paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self._paths.pop(name))

    def drop(self) -> None:
        """Deletes the index."""
        while self.runs:
            self._drop(self.runs.pop())

    def compact(self) -> None:
        """Merges all runs into one; a segment keeps its smallest document."""
        if len(self.runs) > 1:
            old, union = self.runs, self.spark.table(self.runs[0])
            for r in old[1:]:
                union = union.unionByName(self.spark.table(r))
            self.runs = [self._run(union)]
            self.compactions += 1
            for r in old:
                self._drop(r)

    def ingest(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Adds batch (doc_id, tk, text) to the index. Returns its repeated windows: doc_id, tk, s, m.

        `history` holds the texts of all documents of the index and of the batch, with the same columns.
        """
        if len(self.runs) >= self.fanout:
            self.compact()
        segments = materialize(batch.where("doc_id is not null").select("doc_id", "tk", "text").mapInArrow(tidy(_scan), _SEGMENTS), "segments")
        name = self._run(segments.withColumn("n", F.lit(1).cast("long")))
        own, older = self.spark.table(name), [self.spark.table(r) for r in self.runs]
        self.runs.append(name)
        # joins by more columns may use tables dealt out by the anchor alone, and runs are read in the order they were written in
        with setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"), setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            led, firsts = own.select(*SEGMENT, F.col("doc_id").alias("f"), "n"), [F.col("f")]
            for i, r in enumerate(older):
                led = led.join(r.select(*SEGMENT, F.col("doc_id").alias(f"f{i}")), SEGMENT, "left")
                firsts.append(F.col(f"f{i}"))
            first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
            led = materialize(led.select(*SEGMENT, first.alias("f"), "n"), "led")
            # anchors of the batch that lead different segments, here or in older runs
            edges = [f"{f}{c}" for f in ("min", "max") for c in (1, 2)]
            ends = lambda t, i: t.groupBy("anchor").agg(*[getattr(F, e[:3])(f"d{e[3]}").alias(f"{e}_{i}") for e in edges], F.sum("n").alias(f"n_{i}"))
            several = ends(own, 0)
            for i, r in enumerate(older, 1):
                several = several.join(ends(r, i).drop(f"n_{i}"), "anchor", "left")
            every = {e: [F.col(f"{e}_{i}") for i in range(len(older) + 1)] for e in edges}
            least, most = ([f(*every[f"{e}{c}"]) if older else every[f"{e}{c}"][0] for c in (1, 2)] for e, f in (("min", F.least), ("max", F.greatest)))
            several = several.where((least[0] != most[0]) | (least[1] != most[1])).select("anchor", F.col("n_0").alias("n"))
            several = materialize(several, "several")
            held = [materialize(r.join(several, "anchor", "left_semi").select("anchor", "doc_id", "tk", "s", "m"), "held") for r in older]
        bar = max(HEAVY, segments.count() // HEAVY)
        found = split_join(segments, led, SEGMENT, F.col("n") >= bar).select("anchor", "doc_id", "tk", "s", "m", (F.col("f") < F.col("doc_id")).alias("whole"))
        found = materialize(found, "found")
        whole = found.where("whole").select("doc_id", "tk", "s", "m")

        # a text can hold a segment that is no whole repeat at several places, so each is asked; of older runs the first place is enough
        places = split_join(found.where("not whole"), several, ["anchor"], F.col("n") >= bar).select("doc_id", "tk", "s", "m")
        for r in held:
            places = places.union(r.select("doc_id", "tk", "s", "m"))
        asked = places.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("s", "m")).alias("asked"))
        windows = history.select("doc_id", "tk", "text").join(asked, ["doc_id", "tk"]).mapInArrow(tidy(_spell), _WINDOWS)
        windows = materialize(windows, "windows")
        shared = windows.groupBy("d1", "d2").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("l"), F.count(F.lit(1)).alias("n")).where("f < l")
        shared = materialize(shared.select("d1", "d2", "f", "n"), "shared")
        bar = max(HEAVY, windows.count() // HEAVY)
        single = split_join(windows, shared, ["d1", "d2"], F.col("n") >= bar).where("f < doc_id").select("doc_id", "tk", "s", F.lit(1).alias("m"))
        # written before a later compaction deletes the runs that it was found in
        spans = materialize(whole.union(single), "spans")
        discard(segments, led, several, *held, found, windows, shared)
        return spans


def dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, respace: bool = True, index: FingerprintIndex | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with kept_text, n_words and n_removed added; every row stays.

    kept_text is the words that stay, joined by one space; unless respace, texts that lose none stay as they are.
    The rows go through the index in `batches` ranges of doc_id, as they would arrive day by day.
    """
    spark = docs.sparkSession
    outputs = ("text", "kept_text", "n_words", "n_removed")
    extra = [c for c in docs.columns if c not in outputs]
    wanted = [i / max(2, batches) for i in range(1, max(2, batches))]
    cuts, size = docs.agg(F.percentile_approx("doc_id", wanted, 10000), F.sum(F.octet_length("text"))).first()
    cuts = sorted(set(cuts or []))[: batches - 1]
    index = index or FingerprintIndex(spark, max(4, (size or 0) // BUCKET_BYTES), fanout)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").where("doc_id is not null")
    spans = []
    for i in range(len(cuts) + 1):
        past = keyed.where(F.col("doc_id") <= cuts[i]) if i < len(cuts) else keyed
        spans.append(index.ingest(past.where(F.col("doc_id") > cuts[i - 1]) if i else past, past))
    index.drop()
    repeats = spans[0]
    for s in spans[1:]:
        repeats = repeats.union(s)
    text, marked, d, t = free_names([*docs.columns, *outputs], "_text", "_spans", "_doc", "_key")
    repeats = repeats.groupBy(F.col("doc_id").alias(d), F.col("tk").alias(t)).agg(F.collect_list(F.struct("s", "m")).alias(marked))
    left = docs.select(*extra, F.col("text").alias(text))
    joined = left.join(repeats, (F.col("doc_id") == F.col(d)) & (F.xxhash64(text) == F.col(t)), "left").select(*extra, text, marked)
    fields = [f for f in joined.schema.fields if f.name not in (text, marked)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "kept_text string", "n_words long", "n_removed long"])
    return joined.mapInArrow(tidy(_cut(text, marked, respace)), schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}

#: Whole windows as word lists: exact, and quick enough on the small tables.
ORACLE = {
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(0, len(ws) - 49)) AS s, ws FROM w WHERE len(ws) >= 50
), h AS (
  SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 50], ' ')) AS k FROM win
), f AS (
  SELECT k, min(doc_id) AS d FROM h GROUP BY k
), dup AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.s, h.s + 50)) AS p FROM h JOIN f USING (k) WHERE f.d < h.doc_id
), gone AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM dup GROUP BY doc_id
), each_word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t
  FROM each_word e ANTI JOIN dup d ON e.doc_id = d.doc_id AND e.p = d.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
}
