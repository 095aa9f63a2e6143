"""Rules as tables: phrases that are looked for in texts, what they say about a text, and checks of the tables themselves.

A rule table has rows (rule, phrase). Texts and phrases are folded to words; every word of a text meets the phrases that begin
with it, once, whatever the number of rules, and the words that follow decide. Rules may be many: the join is by the first
word. Up to SMALL phrases are broadcast, so that the words of the texts are not shuffled; beyond, the join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T


#: Phrases that are broadcast.
SMALL = 200_000


def prepared(rules: DataFrame) -> DataFrame:
    """(rule, head, phrase, size) of rules (rule, phrase): folded phrases by their first word, each once a rule; without words: none."""
    words = rules.select("rule", T.words(F.coalesce("phrase", F.lit(""))).alias("w")).where(F.size("w") > 0)
    return words.select("rule", F.col("w")[0].alias("head"), F.array_join("w", " ").alias("phrase"), F.size("w").alias("size")).distinct()


def matches(texts: DataFrame, rules: DataFrame, longest: int = 8, small: int = SMALL) -> DataFrame:
    """(key, rule, phrase, at) of texts (key, text): every place, counted in words from 0, where a phrase of up to `longest` words stands."""
    p = prepared(rules).where(F.col("size") <= longest)
    if p.limit(small + 1).count() <= small:
        p = F.broadcast(p)
    every = T.words(F.coalesce("text", F.lit("")))
    words = texts.select("key", every.alias("w")).select("key", "w", F.posexplode("w").alias("at", "head"))
    # what follows is cut to the longest phrase before the join, so that no row carries a whole text
    near = words.select("key", "at", "head", F.array_join(F.slice("w", F.col("at") + 1, longest), " ").alias("next"))
    met = near.join(p, "head")
    return met.where((F.col("next") == F.col("phrase")) | F.startswith("next", F.concat("phrase", F.lit(" ")))).select("key", "rule", "phrase", "at")


def topics(texts: DataFrame, rules: DataFrame, order: DataFrame, other: str = "other") -> DataFrame:
    """(key, topic): the rule with most distinct phrases in the text, of equals the one with the smaller place in order (rule, place)."""
    hits = matches(texts, rules).groupBy("key", "rule").agg(F.count_distinct("phrase").alias("n")).join(order, "rule")
    best = hits.groupBy("key").agg(F.max_by("rule", F.struct("n", -F.col("place"))).alias("topic"))
    return texts.select("key").join(best, "key", "left").withColumn("topic", F.coalesce("topic", F.lit(other)))


def links(texts: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, target, phrase): texts with the targets (rule, target) of their rules and the phrase that stands first for it."""
    met = matches(texts, rules).join(targets, "rule")
    return met.groupBy("key", "target").agg(F.min_by("phrase", F.struct("at", "phrase")).alias("phrase"))


def problems(rules: DataFrame, weights: DataFrame, bands: DataFrame) -> DataFrame:
    """(table, problem, detail) of rule tables: rules (rule, phrase), weights (name, weight), bands (band, low, high).

    Phrases must have words and belong to one rule, weights must sum to 100 and none be negative, names must be unique, and bands
    must follow each other from 0 to 1000 without a gap.
    """
    row = lambda df, table, problem, detail: df.select(F.lit(table).alias("table"), F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    p = prepared(rules)
    shared = p.groupBy("phrase").agg(F.count_distinct("rule").alias("n")).where("n > 1")
    empty = rules.where(F.size(T.words(F.coalesce("phrase", F.lit("")))) == 0)
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total")).where("total <> 100")
    twice = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # bands are a handful of rows: each must begin where another one ends
    ends = bands.select(F.col("high").alias("low"), F.lit(True).alias("met")).distinct()
    begins = bands.select(F.col("low").alias("high"), F.lit(True).alias("met")).distinct()
    return (
        row(shared, "rules", "shared_phrase", F.col("phrase")).union(row(empty, "rules", "no_words", F.col("rule")))
        .union(row(total, "weights", "sum", F.col("total"))).union(row(weights.where("weight < 0"), "weights", "negative", F.col("name"))).union(row(twice(weights, "name"), "weights", "repeated", F.col("name")))
        .union(row(twice(bands, "band"), "bands", "repeated", F.col("band"))).union(row(bands.where("low >= high"), "bands", "empty", F.col("band")))
        .union(row(bands.join(ends, "low", "left").where("met IS NULL AND low <> 0"), "bands", "gap_before", F.col("band")))
        .union(row(bands.join(begins, "high", "left").where("met IS NULL AND high <> 1000"), "bands", "gap_after", F.col("band")))
    )
