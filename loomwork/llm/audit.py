"""Audit of how text filters interact: what each filter removes at each place of each order of all filters.

Lattice-edge aggregation. A document is known by the set of filters it fails. Standing before filter f after the filters of
a set S, it is kept, removed or already gone by that set alone, whatever order S came in. So documents are counted once per
(part, failed set, labels), these few cells go to the edges (S, f) of the lattice of filter sets, 80 for five filters, and
every order is a path through the lattice: its steps join with the aggregated edges. Documents never meet the orders.

Filters, with words as maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive: A fewer than 200 words; B less than half as many
distinct words as words; C more than 3 % `[A-Z]` among the code points; D any of `#$%&*|`; E the text of a row with a smaller
doc_id. Copies are told by SHA-256 of the text and only counted: rows of one text become counts per (text, part, labels) and
doc_id before texts are compared, so a text that a third of all rows share is no hot key.

Defined cases: a null text is the empty text, fails A alone and is a copy of empty texts; a null lang is the part ''; a null
doc_id is smaller and larger than none, so it fails E never and has no labels; rows with the smallest doc_id of a text are no
copies of each other, later ones are; a document is labelled so if any of its label rows is; repeated rows count each; an
empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import WORD, table

FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bit i: fails the i-th filter), good, toxic and n, the number of such documents."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in text_failures(F.col("text")).items()]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    slim = slim.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), reduce(Column.__add__, bits).alias("failed"))
    rows = slim.groupBy("doc_id", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id match no label: dealt by their text, they are no hot key of the join
    spread = F.coalesce("doc_id", F.xxhash64("digest", "part"))
    rows = rows.withColumn("key", spread).withColumn("known", F.col("doc_id").isNotNull())
    marks = marks.select(F.col("id").alias("key"), F.lit(True).alias("known"), "good", "toxic")
    marked = rows.join(marks, ["key", "known"], "left")
    none = F.lit(False)
    cells = marked.groupBy("digest", "part", "failed", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
    )
    first = cells.groupBy("digest").agg(F.min("least").alias("first"))
    cells = cells.join(first, "digest")
    own = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("failed"), own.alias("n")), F.struct((F.col("failed") + copy).alias("failed"), (F.col("n") - own).alias("n")))
    kinds = cells.select("part", "good", "toxic", F.explode(split).alias("x")).groupBy("part", F.col("x.failed").alias("failed"), "good", "toxic")
    return kinds.agg(F.sum("x.n").alias("n")).where("n > 0")


def edge_list(k: int = len(FILTERS)) -> list[tuple[int, int]]:
    """(applied set, next filter) of the lattice: k * 2^(k-1) edges."""
    return [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def edges(kinds: DataFrame, k: int = len(FILTERS)) -> DataFrame:
    """part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost; edges that no document changes
    are there as well, for every part."""
    every = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in edge_list(k)]))
    at = kinds.select("part", "failed", "good", "toxic", "n", every.alias("e")).select("*", "e.applied", "e.next").drop("e")
    fails = F.expr("(failed >> next) & 1 = 1")
    gone = F.expr("failed & applied <> 0")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return at.groupBy("part", "applied", "next").agg(
        count(~gone & ~fails).alias("kept"), count(~gone & fails).alias("removed"), count(gone & fails).alias("redundant"),
        count(F.expr("failed = 1 << next")).alias("unique_fails"), count(~gone & fails & F.col("good")).alias("good_lost"), count(~gone & fails & F.col("toxic")).alias("toxic_lost"),
    )


def paths(spark: SparkSession, names: str = FILTERS) -> DataFrame:
    """filter_order, step, applied, next: k * k! rows."""
    rows = []
    for order in permutations(range(len(names))):
        label, applied = "".join(names[f] for f in order), 0
        for i, f in enumerate(order):
            rows.append((label, i + 1, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: what the filter of that step keeps and removes, and what it would alone."""
    spark, k = docs.sparkSession, len(FILTERS)
    lattice = edges(failed_sets(docs, labels))
    # an edge lies on |S|! (k - 1 - |S|)! orders
    weight = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), F.bit_count("applied") + 1)
    share = lattice.groupBy("part", "next").agg(F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
    lattice = lattice.join(share, ["part", "next"])
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    # the paths are k * k! rows
    return lattice.join(F.broadcast(paths(spark)), ["applied", "next"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLE = {
    "op13_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), m AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
  FROM w
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), c AS (
  SELECT part, failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INT) AS step, left(filter_order, step - 1) AS applied, filter_order[step] AS nxt FROM o, range(1, 6) r(step)
), j AS (
  SELECT *, contains(failed, nxt) AS fails, length(translate(failed, applied, '')) < length(failed) AS gone FROM c, s
), g AS (
  SELECT part, filter_order, step, nxt, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (failed = nxt), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, nxt) AS BIGINT) AS shapley FROM g
"""
}
