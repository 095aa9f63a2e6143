"""Queries of the snapshot, merge, review and timeline operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.functions import text as T
from loomwork.operators import relational as R
from loomwork.sources import views as V

STATES = ("system", "user", "assistant", "discarded")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.web_news(spark, sf_dir)
    rules = {"title": T.is_null_token(F.col("title")), "url": ~T.valid_url(F.col("url")), "language": ~F.col("lang").isin("en", "de", "es")}
    keyed = p.withColumn("key", T.url_key(F.col("url")))
    return R.quality_report(R.validate(keyed, rules, ["key"], F.col("page_id")))


def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), "event_type")
    return R.null_counts(e, ["k", "missing", "event_type"])


def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    kept = e.where(R.in_window(F.col("ts"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


def url_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "pages").select("page_id", T.url_key(F.col("url")).alias("key"))
    return p.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", T.host(F.col("url")).alias("host"), T.news_id(F.col("url")).alias("news_id"))


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.web_news(spark, sf_dir)
    rows = w.select("page_id", T.url_key(F.col("url")).alias("key"), "title", F.when(F.col("page_id") % 3 == 0, None).otherwise(F.col("lang")).alias("lang"), (F.col("page_id") % 4).alias("priority"))
    return R.merge_by_key(rows, "key", [F.col("priority")], "page_id", ["lang"], ["page_id", "title"])


def anti_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = V.table(spark, sf_dir, "documents").select("doc_id", "source"), V.table(spark, sf_dir, "labels").select("doc_id")
    alone = d.join(labels, "doc_id", "left_anti")
    return alone.select("doc_id", T.group_id(F.array(F.col("doc_id").cast("string"))).alias("group_id"))


def semi_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = V.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), V.table(spark, sf_dir, "labels").select("doc_id")
    return d.join(labels, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return R.latest_by_key(c, ["conv_id"], ["turn"])


def state_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest_state(spark, sf_dir).groupBy(F.col("role").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    domain = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in STATES])).alias("state"))
    return R.zero_filled(last, domain, ["state"], "n")


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations")
    seen = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("h"))
    return seen.select("conv_id", F.array_join(F.transform("h", lambda x: x["role"]), ">").alias("history"), F.size("h").alias("n_turns"))


def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir)
    date = F.coalesce("pub_ts", "det_ts")
    return n.groupBy("outlet").agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first_ts"), F.max(date).alias("last_ts"), F.count_distinct("lang").alias("n_langs"),
        F.count_if(F.col("pub_ts").isNull()).alias("n_unpublished"), F.count_if(date.isNull()).alias("n_undated"),
    )


def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_first_seen(V.table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


def grid_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = V.indicator(spark, sf_dir)
    nations = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    years = spark.range(1994, 2003).select(F.col("id").cast("int").alias("year"))
    return R.complete_grid(i, nations, years)


def latest_non_null_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_completion(spark, sf_dir)
    last = F.max(F.when(F.col("cents").isNotNull(), F.col("year"))).over(Window.partitionBy("nation"))
    x = g.withColumn("last_year", last)
    series = F.array_sort(F.collect_list(F.when((F.col("year") > F.col("last_year") - 5) & (F.col("year") <= F.col("last_year")), F.concat_ws(":", "year", F.coalesce(F.col("cents").cast("string"), F.lit("null"))))))
    out = x.groupBy("nation").agg(F.max("last_year").alias("last_year"), F.max(F.when(F.col("year") == F.col("last_year"), F.col("cents"))).alias("cents"), series.alias("s"), F.count_if(F.col("year") > F.col("last_year")).alias("n_later"))
    return out.select("nation", "last_year", "cents", F.array_join("s", "|").alias("series"), "n_later")


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir).where("pub_ts is not null").withColumn("day", F.to_date("pub_ts"))
    return R.round_robin(n.select("id", "outlet", "pub_ts", "day"), "day", "outlet", "pub_ts", "id", 120).select("id", "outlet", "day", "turn")


def stratified_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(T.fold(F.col("text"))).alias("key"))
    first = d.groupBy("key").agg(F.min(F.struct("doc_id", "lang")).alias("x")).select("x.*")
    return R.stratified_rounds(first, "lang", "doc_id", 7, 15)


def timeline_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").where("event_type = 'purchase' or value > 90")
    counts = e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    days = R.calendar(V.table(spark, sf_dir, "events"), "ts", "day").select(F.col("period").cast("timestamp_ntz").alias("period"))
    return R.zero_filled(counts, days, ["period"], "n").select(F.to_date("period").alias("period"), "n")


def timeline_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    return e.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = V.table(spark, sf_dir, "documents").select("doc_id", "lang"), V.table(spark, sf_dir, "labels")
    g = labels.join(d, "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = N.wilson(F.col("k"), F.col("n"))
    return g.select("lang", F.col("k").cast("long").alias("k"), "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("n"))


def precision_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    by_price = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    by_date = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    a = o.withColumn("r", F.row_number().over(by_price)).where("r <= 5").select("o_orderpriority", "o_orderkey")
    b = o.withColumn("r", F.row_number().over(by_date)).where("r <= 5").select("o_orderpriority", "o_orderkey")
    both = a.join(b, ["o_orderpriority", "o_orderkey"], "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_both"))
    return a.select("o_orderpriority").distinct().join(both, "o_orderpriority", "left").select("o_orderpriority", F.coalesce("n_both", F.lit(0)).alias("n_both"))


def integrity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    found = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    expected = d.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.sha2("text", 256)).alias("sha256"))
    return R.integrity(expected, found)


def html_title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.web_news(spark, sf_dir)
    return w.select("page_id", T.clean_html(F.col("title")).alias("title"), T.shorten(T.clean_html(F.col("title")), 40).alias("short"))


def unique_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("g-"), F.substring(F.md5("text"), 1, 3)).alias("g"))
    return R.unique_ids(d, "g", "doc_id", "unique_id").select("doc_id", "unique_id")


def price_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = V.table(spark, sf_dir, "lineitem")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    return line.cube("l_returnflag", "l_linestatus").agg(cents, F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("last_value")).groupBy("user_id", "seen").agg(F.max("last_value").alias("last_value"))
    rest = e.where("event_type <> 'view'").select("event_id", "user_id", "ts")
    return R.as_of_join(rest, views, "user_id", "ts", "seen", "last_value").select("event_id", "last_value")


QUERIES = {f.__name__: f for f in (
    quality_report, null_tokens, window_filter, first_dedup, url_key_dedup, stable_ids, merge_sources, anti_singletons, semi_labelled,
    latest_state, state_counts_zero_filled, review_history, coverage_by_source, mode_first_seen, grid_completion, latest_non_null_series,
    round_robin_sample, stratified_rounds, timeline_zero_fill, timeline_weeks, wilson_by_group, latency_percentiles, precision_at_5,
    integrity_join, html_title_clean, unique_group_ids, price_cube, as_of_orders,
)}

_FOLD = "lower(strip_accents({}))"
ORACLE = {
    "quality_report": f"""WITH {V.SQL["url"]}, {V.SQL["web_news"]}, r AS (
  SELECT w.page_id, k.key, list_filter([CASE WHEN lower(trim(w.title)) IN ('', 'na', 'n/a', 'nan', 'null', 'none') THEN 'title' END,
    CASE WHEN NOT regexp_matches(w.url, '^https?://[^/?#\\s]+') THEN 'url' END, CASE WHEN w.lang NOT IN ('en', 'de', 'es') THEN 'language' END], lambda x: x IS NOT NULL) AS reasons
  FROM web_news w JOIN keyed k USING (page_id)
), v AS (
  SELECT page_id, CASE WHEN len(reasons) = 0 AND row_number() OVER (PARTITION BY key, len(reasons) = 0 ORDER BY page_id) > 1 THEN ['duplicate'] ELSE reasons END AS reasons FROM r
), e AS (
  SELECT unnest(list_concat(reasons, ['read', CASE WHEN len(reasons) = 0 THEN 'valid' ELSE 'rejected' END])) AS reason FROM v
) SELECT reason, count(*) AS n_rows FROM e GROUP BY reason""",
    "null_tokens": """WITH e AS (SELECT json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing, event_type FROM events)
SELECT 'k' AS "column", count(*) FILTER (k IS NULL OR lower(trim(k)) IN ('', 'na', 'n/a', 'nan', 'null', 'none')) AS n_null FROM e
UNION ALL SELECT 'missing', count(*) FILTER (missing IS NULL) FROM e
UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL OR lower(trim(event_type)) IN ('', 'na', 'n/a', 'nan', 'null', 'none')) FROM e""",
    "window_filter": """SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events
WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') GROUP BY event_type""",
    "first_dedup": f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY {_FOLD.format('text')}",
    "url_key_dedup": f"WITH {V.SQL['url']} SELECT key, min(page_id) AS page_id, count(*) AS n FROM keyed GROUP BY key",
    "stable_ids": f"""WITH {V.SQL["url"]} SELECT page_id, host,
  left(regexp_replace(split_part(host, '.', 1), '[^a-z0-9]', '', 'g'), 12) || '-' || left(sha256(key), 12) AS news_id FROM keyed""",
    "merge_sources": f"""WITH {V.SQL["url"]}, {V.SQL["web_news"]}, r AS (
  SELECT w.page_id, k.key, w.title, CASE WHEN w.page_id % 3 = 0 THEN NULL ELSE w.lang END AS lang, w.page_id % 4 AS priority FROM web_news w JOIN keyed k USING (page_id))
SELECT key, arg_min(page_id, (priority, page_id)) AS page_id, arg_min(title, (priority, page_id)) AS title,
  arg_min(lang, page_id) FILTER (lang IS NOT NULL) AS lang, count(*) - 1 AS n_merged FROM r GROUP BY key""",
    "anti_singletons": "SELECT doc_id, 'g-' || left(sha256(doc_id::VARCHAR), 12) AS group_id FROM documents d ANTI JOIN labels l USING (doc_id)",
    "semi_labelled": "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents d SEMI JOIN labels l USING (doc_id) GROUP BY lang",
    "latest_state": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id",
    "state_counts_zero_filled": """WITH l AS (SELECT conv_id, arg_max(role, turn) AS state FROM conversations GROUP BY conv_id), s AS (SELECT unnest(['system', 'user', 'assistant', 'discarded']) AS state)
SELECT s.state, count(l.conv_id) AS n FROM s LEFT JOIN l USING (state) GROUP BY s.state""",
    "review_history": "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS history, CAST(count(*) AS INT) AS n_turns FROM conversations GROUP BY conv_id",
    "coverage_by_source": f"""WITH {V.SQL["news"]} SELECT outlet, count(*) AS n, min(coalesce(pub_ts, det_ts)) AS first_ts, max(coalesce(pub_ts, det_ts)) AS last_ts, count(DISTINCT lang) AS n_langs,
  count(*) FILTER (pub_ts IS NULL) AS n_unpublished, count(*) FILTER (coalesce(pub_ts, det_ts) IS NULL) AS n_undated FROM news GROUP BY outlet""",
    "mode_first_seen": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, arg_max(event_type, (n, -f)) AS event_type, max(n) AS n FROM c GROUP BY user_id""",
    "grid_completion": f"""WITH {V.SQL["indicator"]}, g AS (SELECT n_nationkey AS nation, CAST(y AS INT) AS year FROM nation, range(1994, 2003) t(y))
SELECT g.nation, g.year, i.n_orders, i.cents FROM g LEFT JOIN indicator i USING (nation, year)""",
    "latest_non_null_series": f"""WITH {V.SQL["indicator"]}, g AS (SELECT n_nationkey AS nation, CAST(y AS INT) AS year FROM nation, range(1994, 2003) t(y)), x AS (
  SELECT g.nation, g.year, i.cents, max(g.year) FILTER (i.cents IS NOT NULL) OVER (PARTITION BY g.nation) AS last_year FROM g LEFT JOIN indicator i USING (nation, year))
SELECT nation, max(last_year) AS last_year, max(cents) FILTER (year = last_year) AS cents,
  coalesce(string_agg(year || ':' || coalesce(cents::VARCHAR, 'null'), '|' ORDER BY year) FILTER (year > last_year - 5 AND year <= last_year), '') AS series, count(*) FILTER (year > last_year) AS n_later FROM x GROUP BY nation""",
    "round_robin_sample": f"""WITH {V.SQL["news"]}, d AS (SELECT id, outlet, pub_ts, CAST(pub_ts AS DATE) AS day FROM news WHERE pub_ts IS NOT NULL), p AS (
  SELECT *, row_number() OVER (PARTITION BY day, outlet ORDER BY pub_ts DESC, id DESC) AS r, row_number() OVER (PARTITION BY day ORDER BY pub_ts DESC, id DESC) AS p FROM d), c AS (
  SELECT *, count(*) OVER (PARTITION BY day, outlet) AS c, min(p) OVER (PARTITION BY day, outlet) AS f FROM p), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY r, c DESC, f) AS INT) AS turn FROM c)
SELECT id, outlet, day, turn FROM k ORDER BY turn, day DESC LIMIT 120""",
    "stratified_rounds": f"""WITH f AS (SELECT min((doc_id, lang)) AS x FROM (SELECT doc_id, lang, {_FOLD.format("text")} AS key FROM documents) GROUP BY key), r AS (
  SELECT x[1] AS doc_id, x[2] AS lang FROM f), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) AS INT) AS round FROM r)
SELECT doc_id, lang, round FROM k WHERE round <= 15""",
    "timeline_zero_fill": """WITH d AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS DATE) AS period FROM events)
SELECT d.period, count(e.event_id) AS n FROM d LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase' OR value > 90) e ON CAST(e.ts AS DATE) = d.period GROUP BY d.period""",
    "timeline_weeks": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL",
    "wilson_by_group": """WITH g AS (SELECT lang, sum(quality)::BIGINT AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang), p AS (
  SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM g)
SELECT lang, k, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n)), 6) AS low,
  round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n)), 6) AS high FROM p""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type",
    "precision_at_5": """WITH a AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS s FROM orders)
SELECT o_orderpriority, count(*) FILTER (r <= 5 AND s <= 5) AS n_both FROM a GROUP BY o_orderpriority""",
    "integrity_join": """WITH f AS (SELECT doc_id AS name, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), e AS (
  SELECT doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 4 <> 1)
SELECT coalesce(e.name, f.name) AS name, CASE WHEN f.name IS NULL THEN 'absent' WHEN e.name IS NULL THEN 'undeclared' WHEN e.h = f.h THEN 'ok' ELSE 'different' END AS status FROM e FULL JOIN f ON e.name = f.name""",
    "html_title_clean": f"""WITH {V.SQL["web_news"]}, d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM web_news), e AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM d), c AS (
  SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM e)
SELECT page_id, title, CASE WHEN length(title) > 40 THEN rtrim(left(title, 39)) || '…' ELSE title END AS short FROM c""",
    "unique_group_ids": """WITH g AS (SELECT doc_id, 'g-' || left(md5(text), 3) AS g, row_number() OVER (PARTITION BY left(md5(text), 3) ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 1 THEN g ELSE g || '-' || n END AS unique_id FROM g""",
    "price_cube": """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "as_of_orders": """WITH v AS (SELECT user_id, ts AS seen, max(value) AS last_value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, v.last_value FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.seen""",
}
