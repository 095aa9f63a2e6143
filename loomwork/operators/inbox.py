"""Topics made of grouped items: effective topic, evidence, score, order, filters and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.operators import relational as R
from loomwork.operators.replicas import independent_sources
from loomwork.operators.shared import near

COMPONENTS = ("relevance", "impact", "urgency", "novelty", "evidence")


@dataclass(frozen=True)
class Criteria:
    """How components are measured. Hours up to which a value is full and from which it is none; basis points.

    urgency: since the newest date; novelty: between the first and the last date of either kind; base_impact: of topics that
    are not listed or missing; full_sources: independent sources that give all of their half of the evidence; enough_sources:
    those that make it sufficient; replica: ratio from which titles count as one text.
    """

    urgency: tuple[int, int] = (24, 168)
    novelty: tuple[int, int] = (72, 720)
    base_impact: int = 3000
    full_sources: int = 3
    enough_sources: int = 2
    replica: float = 0.9


def seconds(a: Column, b: Column) -> Column:
    return F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))


def fading(lasted: Column, hours: tuple[int, int]) -> Column:
    """Basis points of a time in seconds: full up to the first number of hours, none from the second; none without a time."""
    return F.when(lasted.isNull(), 0).otherwise(N.ramp(lasted, hours[0] * 3600, hours[1] * 3600)).cast("long")


def evidence_points(sources: Column, official: Column, full: int) -> Column:
    return N.ratio_half_up(5000 * F.least(sources, F.lit(full)), full) + F.when(official, 5000).otherwise(0)


def evidence_state(sources: Column, official: Column, pending: Column, enough: int = 2) -> Column:
    """insufficient: one source and nothing official; sufficient: enough sources and no official data pending; else partial."""
    return F.when((sources < 2) & ~official, "insufficient").when((sources >= enough) & (pending == 0), "sufficient").otherwise("partial")


def context(links: DataFrame) -> DataFrame:
    """(group, official, pending) of official links (group, status): whether any is linked, and how many wait for a value."""
    return links.groupBy("group").agg(F.bool_or(F.col("status") == "linked").alias("official"), F.count_if(F.col("status") == "pending").alias("pending"))


def topics(
    items: DataFrame, reference: Column, weights: dict[str, int], impact: dict[str, int], editorial: tuple[str, ...],
    overrides: DataFrame | None = None, official: DataFrame | None = None, criteria: Criteria = Criteria(),
) -> DataFrame:
    """One row a group of items (group, id, outlet, title, topic, local, pub_ts, det_ts), scored.

    The topic is the most frequent one, of equals the first seen. Evidence counts independent sources: outlets that share
    no nearly identical title. `official` (group, official, pending) is what official series and events say, see context().
    `overrides` (group, relevance, impact, urgency), of an outside evaluator, replaces what it has. Values are basis points.
    """
    c, dated = criteria, F.coalesce("pub_ts", "det_ts")
    g = items.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct(F.lower(F.trim(F.coalesce("outlet", F.lit(""))))).alias("n_outlets"), F.bool_or("local").alias("local"),
        F.max(dated).alias("newest"), F.min(F.least("pub_ts", "det_ts")).alias("a"), F.max(F.greatest("pub_ts", "det_ts")).alias("b"),
    )
    sources = independent_sources(items.select("group", F.col("id").alias("key"), "outlet", "title"), c.replica).withColumnRenamed("n", "n_sources")
    g = g.join(sources, "group").join(R.mode_first_seen(items, "group", "topic", "id").select("group", "topic"), "group", "left")
    if official is None:
        g = g.withColumn("official", F.lit(False)).withColumn("pending", F.lit(0).cast("long"))
    else:
        g = g.join(official.select("group", "official", "pending"), "group", "left")
        g = g.withColumn("official", F.coalesce("official", F.lit(False))).withColumn("pending", F.coalesce("pending", F.lit(0)))
    g = g.withColumn("span", seconds(F.col("a"), F.col("b")))
    half = lambda x: F.when(F.coalesce(x, F.lit(False)), 5000).otherwise(0)
    by_topic = F.create_map(*[F.lit(x) for kv in impact.items() for x in kv]).cast("map<string,int>")
    own = {
        "relevance": half(F.col("local")) + half(F.col("topic").isin(*editorial)), "impact": F.coalesce(by_topic[F.col("topic")], F.lit(c.base_impact)),
        "urgency": fading(F.when(F.col("newest").isNotNull(), F.greatest(F.lit(0), seconds(F.col("newest"), reference))), c.urgency),
        "novelty": fading(F.col("span"), c.novelty), "evidence": evidence_points(F.col("n_sources"), F.col("official"), c.full_sources),
    }
    if overrides is not None:
        renamed = overrides.select("group", *[F.col(x).alias(f"new_{x}") for x in COMPONENTS[:3]])
        g = g.join(renamed, "group", "left")
        own = {x: F.coalesce(f"new_{x}", e) if x in COMPONENTS[:3] else e for x, e in own.items()}
    g = g.select("*", *[e.cast("long").alias(x) for x, e in own.items()])
    total = sum((N.contribution(F.col(k), w) for k, w in weights.items()), F.lit(0))
    g = g.withColumn("tenths", N.ratio_half_up(total, 10))
    state = evidence_state(F.col("n_sources"), F.col("official"), F.col("pending"), c.enough_sources)
    return g.select(
        "group", "topic", "n_items", "n_outlets", "n_sources", "official", "pending", state.alias("state"), F.coalesce(F.col("span") > c.novelty[0] * 3600, F.lit(False)).alias("recirculated"),
        *COMPONENTS, "tenths", N.band(F.col("tenths")).alias("band"),
    )


def inbox(scored: DataFrame, n: int) -> DataFrame:
    """The first `n` topics: score, urgency, then group; `place` from 1."""
    order = [F.desc("tenths"), F.desc("urgency"), F.asc("group")]
    return scored.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def keep(scored: DataFrame, bands: tuple[str, ...] = (), states: tuple[str, ...] = (), topic_names: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the wanted bands, states and topics; nothing wanted is everything, no topic is `unclassified`."""
    for column, wanted in ((F.col("band"), bands), (F.col("state"), states), (F.coalesce("topic", F.lit("unclassified")), topic_names)):
        if wanted:
            scored = scored.where(column.isin(*wanted))
    return scored


def group_summary(items: DataFrame) -> DataFrame:
    """(size, n_groups, n_multi_outlet, n_items) of groups of items (group, outlet), by size."""
    g = items.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.count_distinct(F.lower("outlet")).alias("outlets"))
    return g.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("outlets") > 1).alias("n_multi_outlet"), F.sum("size").alias("n_items"))


def series_links(links: DataFrame, values: DataFrame, key: str, years: int = 5) -> DataFrame:
    """links with year, value, series and status: the latest year that has a value, and the values of `years` years up to it.

    values: (key, year, value), one row a key and year. Links without any value are `pending`.
    """
    known = values.where("value is not null")
    last = known.groupBy(key).agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))
    recent = known.withColumnRenamed("year", "y").join(last.select(key, "year"), key).where(F.col("y") > F.col("year") - years)
    text = F.concat(F.col("y").cast("string"), F.lit(":"), F.col("value").cast("string"))
    series = recent.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(text)), " ").alias("series"))
    status = F.when(F.col("year").isNull(), "pending").otherwise("linked")
    return links.join(near(last), key, "left").join(near(series), key, "left").withColumn("status", status)


def adaptive_unit(days: int) -> str:
    """The calendar unit for a span of days."""
    return "day" if days <= 45 else "week" if days <= 210 else "month"


def adaptive_timeline(df: DataFrame, time: str) -> DataFrame:
    """(period, n) by day, week or month, as the span of all dates asks for, with zeros where nothing was."""
    a, b = df.agg(F.min(F.to_date(time)), F.max(F.to_date(time))).first()
    unit = adaptive_unit((b - a).days if a else 0)
    counts = df.where(F.col(time).isNotNull()).groupBy(F.date_trunc(unit, time).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return R.zero_filled(counts, R.calendar(df, time, unit), ["period"], "n")
