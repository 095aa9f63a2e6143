"""Checks of drafted claims, recommended actions, display names, verdict roll-ups and samples for labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T


def claim_checks(claims: DataFrame, evidence: DataFrame, max_words: int = 80) -> DataFrame:
    """(case, claim, reasons) of claims (case, claim, text, factual, cites array<struct<id, field>>).

    evidence: (case, id, field, value). Reasons: duplicate, uncited, unknown_cite, unseen_figure, too_long.
    """
    rows = claims.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("case", "claim")))
    cited = claims.select("case", "claim", F.explode_outer("cites").alias("c")).select("case", "claim", "c.id", "c.field")
    known = evidence.select("case", "id", "field", "value").dropDuplicates(["case", "id", "field"])
    met = cited.join(known, ["case", "id", "field"], "left").groupBy("case", "claim").agg(
        F.count_if(F.col("id").isNotNull() & F.col("value").isNull()).alias("n_unknown"), F.array_distinct(F.flatten(F.collect_list(T.figures(F.coalesce("value", F.lit("")))))).alias("seen")
    )
    x = rows.join(met, ["case", "claim"], "left")
    new = F.filter(F.array_except(T.figures(F.col("text")), F.coalesce("seen", F.array().cast("array<string>"))), lambda v: F.length(v) > 1)
    rules = {
        "duplicate": F.col("n") > 1, "uncited": F.col("factual") & (F.coalesce(F.size("cites"), F.lit(0)) == 0), "unknown_cite": F.col("n_unknown") > 0,
        "unseen_figure": F.size(new) > 0, "too_long": T.word_count(F.col("text")) > max_words,
    }
    reasons = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]), lambda r: r.isNotNull())
    return x.select("case", "claim", reasons.alias("reasons"))


def actions(band: Column, state: Column, pending: Column, recirculated: Column) -> Column:
    """What to do next with a topic, as codes."""
    rules = {
        "review_first": band == "high", "find_second_source": state == "insufficient", "request_official_data": pending > 0,
        "check_original_date": recirculated, "watch": (band == "low") & (state != "sufficient"), "draft": (band != "low") & (state == "sufficient"),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())


def display_names(df: DataFrame, name: str, ordinal: str) -> DataFrame:
    """(key, shown): the first spelling of every name that differs in case only."""
    return df.groupBy(F.lower(name).alias("key")).agg(F.min_by(name, ordinal).alias("shown"))


def verdicts(results: DataFrame) -> DataFrame:
    """(case, verdict, n_passed, n) of rows (case, passed, partial): fails, untested, partial or complete."""
    g = results.groupBy("case").agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.max("partial").alias("partial"))
    v = F.when(F.col("n_failed") > 0, "fails").when(F.col("n_passed") == 0, "untested").when(F.col("partial"), "partial").otherwise("complete")
    return g.select("case", v.alias("verdict"), "n_passed", (F.col("n_passed") + F.col("n_failed")).alias("n"))


def pair_strata(pairs: DataFrame, quota: int, seed: int = 7) -> DataFrame:
    """A sample of pairs (a, b, stratum): `quota` of each stratum in hash order; what one lacks others fill, in the same order.

    The back-fill is drawn over all strata by rank, so the sample has quota * strata pairs whenever there are as many.
    """
    key = F.md5(F.concat_ws(":", F.col("a"), F.col("b"), F.lit(seed)))
    ranked = pairs.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy("_k", "a", "b")))
    n = ranked.select("stratum").distinct().count() * quota
    return ranked.orderBy(F.col("_r") > quota, F.when(F.col("_r") > quota, F.col("_r")), "_k", "a", "b").limit(n).select("a", "b", "stratum")


def recirculating(df: DataFrame, key: str, dates: list[str], hours: int = 72) -> DataFrame:
    """(key, span_hours, recirculated): span over all kinds of dates of a group."""
    ends = df.groupBy(key).agg(F.min(F.least(*dates)).alias("a"), F.max(F.greatest(*dates)).alias("b"))
    span = F.floor((F.unix_seconds(F.col("b").cast("timestamp")) - F.unix_seconds(F.col("a").cast("timestamp"))) / 3600)
    return ends.select(key, span.alias("span_hours"), F.coalesce(span > hours, F.lit(False)).alias("recirculated"))


def adaptive_chunks(start: int, end: int, count, most: int = 250, least: int = 6, first: int = 360) -> list[tuple[int, int]]:
    """Hour ranges for a source that returns at most `most` rows a call: a full one is halved down to `least` hours.

    Later ranges keep the size that worked and grow again where fewer than half of `most` rows came.
    """
    out, at, size = [], start, first
    while at < end:
        stop = min(end, at + size)
        n = count(at, stop)
        if n >= most and stop - at > least:
            size = max(least, (stop - at) // 2)
            continue
        out.append((at, stop))
        at = stop
        if n < most // 2:
            size = min(first, size * 2)
    return out


def evidence_fields(names: dict[str, Column]) -> Column:
    """A map of the fields that may be cited, without those that are null or blank."""
    every = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[c.cast("string") for c in names.values()]))
    return F.map_filter(every, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def claim_pairs(claims: DataFrame, evidence: DataFrame, seed: int = 7) -> DataFrame:
    """(pair, case, claim, text, evidence_id, evidence): one row for each citation of a claim, for blind labelling.

    claims: (case, claim, text, cited array), evidence: (id, evidence). No verdict is carried; `pair` is a hash of the
    citation and the seed, and the order to label in. Citations of unknown evidence have a null text; repeated ones count once.
    """
    one = claims.select("case", "claim", "text", F.explode(F.array_distinct("cited")).alias("evidence_id"))
    pair = F.md5(F.concat_ws("|", F.lit(seed), "case", "claim", "evidence_id"))
    return one.join(evidence.withColumnRenamed("id", "evidence_id"), "evidence_id", "left").select(pair.alias("pair"), "case", "claim", "text", "evidence_id", "evidence")


def editor_sample(ranked: DataFrame, n: int = 15, seed: int = 7) -> DataFrame:
    """(place, key, title) of the n first rows (key, title, rank) in an order that tells nothing of rank or score."""
    top = ranked.orderBy("rank", "key").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "key")), "key")).alias("place"), "key", "title")


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """Tables of measures as one, with a column `section`; columns that a section lacks are null."""
    out = None
    for name, df in sections.items():
        one = df.withColumn("section", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
