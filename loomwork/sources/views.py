"""Views that bind the library's operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """id, title (first 12 words), outlet, lang, pub_ts, det_ts of documents, or of a stream of them; some dates are missing by rule."""
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id * 37 % 720 {} as int), 0, 0)"
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return documents.select(
        F.col("doc_id").alias("id"),
        # a text is split up to its thirteenth word only; white space before the first leaves an empty piece
        F.array_join(F.slice(F.filter(F.slice(F.split("text", r"\s+", 14), 1, 13), lambda w: w != ""), 1, 12), " ").alias("title"),
        F.col("source").alias("outlet"),
        "lang",
        F.expr(f"if(doc_id % 11 = 0, null, {at.format('')})").alias("pub_ts"),
        F.expr(f"if(doc_id % 7 = 0, null, {at.format('+ doc_id % 5')})").alias("det_ts"),
    )


def web_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, title, lang of pages."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url",
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
    )


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("quake_id"), F.col("ts").alias("t"), F.col("value").alias("magnitude"), F.col("event_type").alias("status"))


def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x year: orders and their total in cents, as exact numbers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return j.groupBy(F.col("c_nationkey").alias("nation"), "year").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("cents").alias("cents"))


#: The same views for DuckDB.
SQL = {
    "news": r"""news AS (
  SELECT doc_id AS id, array_to_string(regexp_extract_all(text, '\S+')[1:12], ' ') AS title, source AS outlet, lang,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 37 % 720 AS INT)) END AS pub_ts,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 37 % 720 + doc_id % 5 AS INT)) END AS det_ts
  FROM documents)""",
    "web_news": r"""web_news AS (
  SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)""",
    "quakes": "quakes AS (SELECT event_id AS quake_id, ts AS t, value AS magnitude, event_type AS status FROM events)",
    "indicator": """indicator AS (
  SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    "url": r"""url AS (
  SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.')
      AND NOT regexp_matches(lower(p), '^utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'cmpid'))) AS params
  FROM pages), keyed AS (
  SELECT *, 'https://' || host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key FROM url)""",
}
