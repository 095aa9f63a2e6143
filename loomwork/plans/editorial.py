"""Queries of the editorial operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import editorial as E
from loomwork.operators import rules
from loomwork.plans.analytics import _SCORED_SQL, _TOPIC_SQL, TOPICS, cosine_pairs, scored
from loomwork.plans.analytics import ORACLE as _A
from loomwork.sources import views as V


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def rule_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of whole documents by a table of rules."""
    order = spark.createDataFrame([(t, i) for i, t in enumerate(TOPICS)], "rule string, place int")
    return rules.topics(_texts(spark, sf_dir), spark.createDataFrame([(t, w) for t, ws in TOPICS.items() for w in ws], "rule string, phrase string"), order)


def _openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each benchmark item: its first four words."""
    first = F.slice(T.words(F.col("text")), 1, 4)
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule"), F.array_join(first, " ").alias("phrase"))


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which benchmark items begin, with the first place and the number of places."""
    met = rules.matches(_texts(spark, sf_dir), _openings(spark, sf_dir))
    return met.groupBy("key", "rule").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))


def rule_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the nations that their rules stand for."""
    targets = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("rule"), F.col("n_name").alias("target"))
    return rules.links(_texts(spark, sf_dir), _openings(spark, sf_dir), targets)


def rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that several benchmark items share, and what is wrong with tables read off the data."""
    bands = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("band"), (F.col("n_nationkey") * 40).alias("low"), (F.col("n_nationkey") * 40 + F.when(F.col("n_nationkey") == 7, 39).otherwise(40)).alias("high"))
    weights = V.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") * 10).alias("weight"))
    two = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule"), F.array_join(F.slice(T.words(F.col("text")), 1, 2), " ").alias("phrase"))
    return rules.problems(two, weights, bands)


def outlet_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.upper("outlet")).otherwise(F.initcap("outlet")).alias("outlet"))
    return E.display_names(n, "outlet", "id")


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("case"), (F.col("o_totalprice") > 3000).alias("passed"), (F.col("o_custkey") % 7 == 0).alias("partial"))
    return E.verdicts(o)


def news_by_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).where("pub_ts is not null")
    local = F.to_date(F.from_utc_timestamp(F.col("pub_ts").cast("timestamp"), "America/Panama"))
    return s.groupBy(local.alias("day"), "band").agg(F.count(F.lit(1)).alias("n"))


def reference_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir)
    return n.groupBy("lang").agg(F.coalesce(F.max(F.coalesce("pub_ts", "det_ts")), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("reference"))


def recirculated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir).withColumn("event", F.floor(F.col("id") / 3))
    return E.recirculating(n, "event", ["pub_ts", "det_ts"])


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cosine_pairs(spark, sf_dir)
    return E.pair_strata(p.select("a", "b", F.when(F.col("cosine") > 0.9, "same").when((F.col("a") + F.col("b")) % 2 == 0, "near").otherwise("far").alias("stratum")), 4)


def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations")
    cites = F.array(F.struct((F.col("turn") - 1).alias("id"), F.lit("text").alias("field")))
    claims = c.where("role = 'assistant'").select(F.col("conv_id").alias("case"), F.col("turn").alias("claim"), "text", F.lit(True).alias("factual"), F.when(F.col("turn") % 4 == 3, cites.cast("array<struct<id: bigint, field: string>>")).otherwise(F.when(F.col("turn") % 4 == 1, cites)).alias("cites"))
    evidence = c.where("role = 'user'").select(F.col("conv_id").alias("case"), F.col("turn").alias("id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    done = E.claim_checks(claims, evidence)
    return done.select("case", "claim", F.array_join("reasons", ",").alias("reasons"))


def news_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir).select("id", "outlet", "pub_ts")
    order = Window.partitionBy("outlet").orderBy(F.desc_nulls_last("pub_ts"), "id")
    first = Window.partitionBy("outlet").orderBy(F.asc_nulls_first("pub_ts"), "id")
    return n.select("id", F.row_number().over(order).alias("newest_first"), F.row_number().over(first).alias("undated_first"))


def claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of conversations with the two benchmark items they cite."""
    c = V.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    claims = c.select(F.col("conv_id").alias("case"), F.col("turn").alias("claim"), "text", F.array(F.col("conv_id") % 40, F.col("turn") % 40).alias("cited")).distinct()
    items = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("evidence"))
    return E.claim_pairs(claims, items)


def editor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 longest titles, in an order that hides their lengths; the limit is the feature."""
    n = V.news(spark, sf_dir).where("title is not null").select(F.col("id").alias("key"), "title", (-F.length("title")).alias("rank"))
    return E.editor_sample(n, 15)


def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be cited of pages, and its key."""
    e = V.table(spark, sf_dir, "pages").select("page_id", E.evidence_fields({"url": F.col("url"), "even": F.when(F.col("page_id") % 2 == 0, F.lit("yes")), "blank": F.lit(" ")}).alias("f"))
    return e.select("page_id", F.size("f").alias("n"), T.canonical_key(F.col("f")).alias("key"))


QUERIES = {f.__name__: f for f in (rule_topics, phrase_rules, rule_links, rule_problems, outlet_display_names, case_verdicts, news_by_local_day, reference_instant, recirculated_groups, label_pairs, claim_checks, news_order, claim_pairs, editor_sample, citation_fields)}

_FIG = r"list_sort(list_distinct(list_transform(regexp_extract_all({}, '\d+(?:[.,]\d+)*'), lambda x: CASE WHEN ltrim(regexp_replace(x, '[.,]', '', 'g'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(x, '[.,]', '', 'g'), '0') END)))"
_WORDS = "regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+')"
_PLACES = f"""op AS (SELECT item_id AS rule, {_WORDS}[1:4] AS p FROM benchmark), dw AS (SELECT doc_id AS key, {_WORDS} AS w FROM documents), pl AS (
  SELECT key, w, unnest(range(len(w))) AS i FROM dw), mt AS (
  SELECT key, rule, array_to_string(p, ' ') AS phrase, CAST(i AS INT) AS pos FROM pl JOIN op ON w[i + 1] = p[1] WHERE len(p) > 0 AND w[i + 1 : i + len(p)] = p)"""
ORACLE = {
    "rule_topics": f"WITH f AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents) SELECT doc_id AS key, {_TOPIC_SQL} AS topic FROM f",
    "phrase_rules": f"WITH {_PLACES} SELECT key, rule, min(pos) AS first, count(*) AS n FROM mt GROUP BY ALL",
    "rule_links": f"WITH {_PLACES} SELECT key, n_name AS target, arg_min(phrase, pos) AS phrase FROM mt JOIN nation ON n_nationkey = rule GROUP BY ALL",
    "rule_problems": f"""WITH p AS (SELECT item_id, array_to_string({_WORDS}[1:2], ' ') AS phrase FROM benchmark)
SELECT 'rules' AS "table", 'shared_phrase' AS problem, phrase AS detail FROM p WHERE phrase <> '' GROUP BY phrase HAVING count(DISTINCT item_id) > 1
UNION ALL SELECT 'rules', 'no_words', CAST(item_id AS VARCHAR) FROM p WHERE phrase = ''
UNION ALL SELECT 'weights', 'sum', CAST(sum(r_regionkey * 10) AS VARCHAR) FROM region HAVING sum(r_regionkey * 10) <> 100
UNION ALL SELECT 'bands', 'gap_after', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'bands', 'gap_before', n_name FROM nation WHERE n_nationkey = 8""",
    "outlet_display_names": f"""WITH {V.SQL["news"]}, n AS (SELECT id, CASE WHEN id % 2 = 0 THEN upper(outlet) ELSE upper(outlet[1]) || lower(outlet[2:]) END AS outlet FROM news)
SELECT lower(outlet) AS key, arg_min(outlet, id) AS shown FROM n GROUP BY 1""",
    "case_verdicts": """WITH r AS (SELECT o_custkey % 50 AS "case", count(*) FILTER (o_totalprice > 3000) AS p, count(*) FILTER (NOT o_totalprice > 3000) AS f, bool_or(o_custkey % 7 = 0) AS partial FROM orders GROUP BY 1)
SELECT "case", CASE WHEN f > 0 THEN 'fails' WHEN p = 0 THEN 'untested' WHEN partial THEN 'partial' ELSE 'complete' END AS verdict, p AS n_passed, p + f AS n FROM r""",
    "news_by_local_day": f"WITH {_SCORED_SQL} SELECT CAST(pub_ts - INTERVAL 5 HOUR AS DATE) AS day, band, count(*) AS n FROM b WHERE pub_ts IS NOT NULL GROUP BY ALL",
    "reference_instant": f"WITH {V.SQL['news']} SELECT lang, coalesce(max(coalesce(pub_ts, det_ts)), TIMESTAMP '2024-01-01') AS reference FROM news GROUP BY lang",
    "recirculated_groups": f"""WITH {V.SQL["news"]}, g AS (SELECT id // 3 AS event, min(least(pub_ts, det_ts)) AS a, max(greatest(pub_ts, det_ts)) AS z FROM news GROUP BY 1)
SELECT event, CAST(date_diff('hour', a, z) AS BIGINT) AS span_hours, coalesce(date_diff('hour', a, z) > 72, false) AS recirculated FROM g""",
    "label_pairs": f"""WITH c AS ({_A["cosine_pairs"]}), s AS (SELECT a, b, CASE WHEN cosine > 0.9 THEN 'same' WHEN (a + b) % 2 = 0 THEN 'near' ELSE 'far' END AS stratum FROM c), k AS (
  SELECT *, md5(a || ':' || b || ':7') AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, a, b) AS r FROM k)
SELECT a, b, stratum FROM r ORDER BY r > 4, CASE WHEN r > 4 THEN r END NULLS FIRST, k, a, b LIMIT (SELECT 4 * count(DISTINCT stratum) FROM s)""",
    "claim_checks": rf"""WITH c AS (SELECT conv_id AS "case", turn AS claim, text, turn % 2 = 1 AS cited FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL), j AS (
  SELECT c.*, e.text AS seen, count(*) OVER (PARTITION BY "case", claim) AS n FROM c LEFT JOIN e ON c.cited AND e.conv_id = c."case" AND e.turn = c.claim - 1)
SELECT "case", claim, array_to_string(list_filter([CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN NOT cited THEN 'uncited' END, CASE WHEN cited AND seen IS NULL THEN 'unknown_cite' END,
  CASE WHEN len(list_filter({_FIG.format("text")}, lambda f: length(f) > 1 AND NOT list_contains({_FIG.format("coalesce(seen, '')")}, f))) > 0 THEN 'unseen_figure' END,
  CASE WHEN len(regexp_extract_all(regexp_replace(lower(strip_accents(text)), '\[a\d+\]', ' ', 'g'), '[a-z0-9_]+')) > 80 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j""",
    "news_order": f"""WITH {V.SQL["news"]} SELECT id, CAST(row_number() OVER (PARTITION BY outlet ORDER BY pub_ts DESC NULLS LAST, id) AS INT) AS newest_first,
  CAST(row_number() OVER (PARTITION BY outlet ORDER BY pub_ts ASC NULLS FIRST, id) AS INT) AS undated_first FROM news""",
    "claim_pairs": """WITH c AS (SELECT DISTINCT conv_id AS "case", turn AS claim, text, unnest(list_distinct([conv_id % 40, turn % 40])) AS evidence_id FROM conversations WHERE role = 'assistant')
SELECT md5('7|' || "case" || '|' || claim || '|' || evidence_id) AS pair, "case", claim, c.text, evidence_id, b.text AS evidence FROM c LEFT JOIN benchmark b ON b.item_id = c.evidence_id""",
    "editor_sample": f"""WITH {V.SQL["news"]}, t AS (SELECT id, title FROM news WHERE title IS NOT NULL ORDER BY length(title) DESC, id LIMIT 15)
SELECT CAST(row_number() OVER (ORDER BY md5('7|' || id), id) AS INT) AS place, id AS key, title FROM t""",
    "citation_fields": """SELECT page_id, CAST((url IS NOT NULL AND trim(url) <> '')::INT + (page_id % 2 = 0)::INT AS INT) AS n,
  sha256('{' || array_to_string(list_filter([CASE WHEN page_id % 2 = 0 THEN '"even":"yes"' END, CASE WHEN trim(url) <> '' THEN '"url":' || CAST(to_json(url) AS VARCHAR) END], lambda x: x IS NOT NULL), ',') || '}') AS key FROM pages""",
}
