"""Mixing sources to target weights by systematic sampling.

Within a source every document's expected number of copies is the source's target over its size. Documents are
ordered by (size, doc_id); the prefix sum of expected copies, shifted by one offset per source that a hash of the
source and the seed gives, is cut at the integers: a document is emitted once for each boundary crossed within
its step. Ordering by size makes the sample systematic in size too, so a source's taken words end within about
one longest document of its target. Ranks come from counted cells (source, size, doc_id range), never from one
task holding a source.

Sources are ordered by code point, null last, and weigh `weights` in turn; targets share `budget` times all
words, stop at `limit` times their source's words, and the excess is shared again by weight: the level that
weights are multiplied with is found in closed form from the sources ordered by the level at which they stop.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source of its own; a null
doc_id sorts first and is mixed like any other; repeated rows count each time; a source without words has target
0; extra columns pass through `mix`, those named like its results are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import WORD, free_names, materialize, ranked, table

WEIGHTS = (3, 1, 2)
BUDGET, LIMIT = 1.5, 2.0


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row per source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("stop", F.lit(limit) * F.col("source_size"))
    # sources stop one after the other as the level rises: the level is the first that the remaining ones can hold
    rise = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").isNull(), "source")
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    spent = F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("level", (F.lit(budget) * F.sum("source_size").over(everything) - spent) / weight)
    by = by.withColumn("level", F.max(F.when(F.col("level") <= F.col("stop") / F.col("w"), F.col("level"))).over(everything))
    return by.select("source", "source_size", F.least("stop", F.coalesce(F.col("level") * F.col("w"), F.col("stop"))).alias("target"))


def offset(source, seed: int):
    """The random offset of a source in [0, 1): 48 bits of a hash."""
    key = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


_OUT = ["size", "source_size", "target", "copies", "taken"]


def copies_of(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT, seed: int = 7) -> DataFrame:
    """One row per row of docs (doc_id, text, source) without its text: doc_id, tk (hash of the text), source, size,
    source_size, target, copies, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64("text").alias("tk")), "sizes")
    goal = materialize(targets(slim, weights, budget, limit), "targets")
    n, low, high = slim.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    wide = max(1, ((high or 0) - (low or 0) + 1) // max(1, n // 50_000))
    cells = slim.select(
        "doc_id", "tk", "size", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no"),
        F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(wide)), F.lit(-1)).alias("span"),
    )
    order = ranked(cells, ["no", "s"], ["size", "span"], [F.col("doc_id"), F.col("tk")])
    goal = goal.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no"), "source_size", "target", offset(F.col("source"), seed).alias("u"))
    placed = order.join(goal, ["no", "s"])
    step = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(F.lit(0.0))
    copies = (F.floor((F.col("rank") + 1) * step + F.col("u")) - F.floor(F.col("rank") * step + F.col("u"))).cast("long")
    placed = placed.select("doc_id", "tk", "size", F.when(F.col("no"), F.lit(None)).otherwise(F.col("s")).alias("source"), "source_size", "target", copies.alias("copies"))
    return placed.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies and taken; every row stays."""
    own = [c for c in docs.columns if c not in _OUT]
    placed = copies_of(docs, weights, budget, limit, seed)
    own_id, key, twin = free_names([*docs.columns, *_OUT], "_id", "_key", "_twin")
    there = dict(zip([*placed.columns, "k"], free_names([*docs.columns, own_id, key, twin, *_OUT], *(f"_{c}" for c in [*placed.columns, "k"])), strict=True))
    # repeated rows differ in nothing: the k-th of them takes the k-th of their results
    placed = placed.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "source", "tk").orderBy("copies")))
    placed = placed.select(*[F.col(c).alias(n) for c, n in there.items()])
    keyed = docs.select(*own).withColumn(own_id, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64("text"))
    keyed = keyed.withColumn(twin, F.row_number().over(Window.partitionBy(own_id, "source", key).orderBy(own_id)))
    on = keyed[own_id].eqNullSafe(placed[there["doc_id"]]) & keyed["source"].eqNullSafe(placed[there["source"]])
    on = on & (keyed[key] == placed[there["tk"]]) & (keyed[twin] == placed[there["k"]])
    return keyed.join(placed, on).select(*own, *[F.col(there[c]).alias(c) for c in _OUT])


def emit(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row of mix() as often as it has copies."""
    [each] = free_names(mixed.columns, "_copy")
    return mixed.where("copies > 0").withColumn(each, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(each)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies_of(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": op8_mixing}

ORACLE = {
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, (ARRAY[3.0, 1.0, 2.0])[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)]::DOUBLE AS w,
    2.0::DOUBLE * source_size AS stop FROM g
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY stop / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(stop, w * (SELECT max(level) FROM l WHERE level <= stop / w)) AS target,
    CAST(('0x' || left(md5('7:' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS step FROM r
)
SELECT doc_id, size, source_size, target, CAST(floor((rank + 1) * step + u) - floor(rank * step + u) AS BIGINT) * size AS taken FROM e
"""
}
