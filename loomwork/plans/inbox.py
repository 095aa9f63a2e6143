"""Queries over grouped topics, answers and evaluations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import analytics as A
from loomwork.operators import editorial as E
from loomwork.operators import evaluation as X
from loomwork.operators import inbox as I
from loomwork.operators import replicas
from loomwork.operators.shared import written
from loomwork.plans.analytics import _BM25_NEWS, _SCORED_SQL, EDITORIAL, IMPACT, REFERENCE, WEIGHTS, official_values, scored
from loomwork.sources import views as V

# ---- topics ----------------------------------------------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str, values: DataFrame | None = None) -> DataFrame:
    s = scored(spark, sf_dir, values)
    return s.select(F.floor(F.col("id") / 4).alias("group"), "id", "outlet", "title", "topic", F.col("local").isNotNull().alias("local"), "pub_ts", "det_ts")


def _linked(spark: SparkSession, sf_dir: str, values: DataFrame | None = None) -> DataFrame:
    """id, slot, year, value, series, status: news with the official series of its slot."""
    news = V.news(spark, sf_dir).select("id", (F.col("id") % 5).alias("slot"))
    return I.series_links(news, official_values(spark, sf_dir) if values is None else values, "slot")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are read once, and orders: what follows reads items and official values
    values = official_values(spark, sf_dir)
    items = written(_items(spark, sf_dir, values), "items")
    outside = items.where("id % 28 = 0").select("group", F.lit(None).cast("long").alias("relevance"), F.lit(10_000).cast("long").alias("impact"), F.lit(2500).cast("long").alias("urgency"))
    official = I.context(_linked(spark, sf_dir, values).select(F.floor(F.col("id") / 4).alias("group"), "status"))
    return I.topics(items, F.lit(REFERENCE).cast("timestamp_ntz"), WEIGHTS, IMPACT, EDITORIAL, outside, official)


def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all headlines of a language: outlets count once however many of them carry nearly the same text."""
    return replicas.independent_sources(V.news(spark, sf_dir).select(F.col("lang").alias("group"), F.col("id").alias("key"), "outlet", "title"))


def replica_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of a language by their source where every headline is an outlet of its own: families of near copies."""
    n = V.news(spark, sf_dir).select(F.col("lang").alias("group"), F.col("id").alias("key"), F.col("id").cast("string").alias("outlet"), "title")
    by = replicas.source_of(n).groupBy("group", "source").agg(F.count(F.lit(1)).alias("n"))
    return by.where("n > 1").select("group", F.col("source").alias("first"), "n")


def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of evidence of every topic, from its independent sources and official series."""
    return _topics(spark, sf_dir).select("group", "n_outlets", "n_sources", "official", "pending", "state")


def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = E.actions(F.col("band"), F.col("state"), F.col("pending"), F.col("recirculated"))
    return _topics(spark, sf_dir).select("group", F.array_join(todo, ",").alias("actions"))


def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir)


def topic_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which topics deserve attention first: grouped items with their score, evidence and place."""
    return I.inbox(_topics(spark, sf_dir), 20).select("place", "group", "topic", "band", "state", "tenths", "n_items", "n_sources")


def filtered_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.keep(_topics(spark, sf_dir), bands=("mid", "high"), states=("partial", "sufficient")).select("group", "band", "state", "topic")


def topics_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir)
    return I.group_summary(n.select(F.floor(F.col("id") / 4).alias("group"), "outlet"))


def series_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("id", "slot", "year", "value", "series", "status")


def adaptive_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at"))
    return I.adaptive_timeline(o, "at").select(F.col("period").cast("date").alias("period"), "n")


# ---- answers ---------------------------------------------------------------------------------------------------


def _lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best titles of each question by BM25, its share of the best in place of a cosine, and coverage."""
    news = V.news(spark, sf_dir).select(F.col("id").alias("doc"), F.col("title").alias("text"))
    q = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    top = A.top_k(A.bm25(news, q), 5)
    best = top.where("rank = 1").select("query", F.col("score").alias("best"))
    top = top.join(best, "query").withColumn("cosine", F.col("score") / F.col("best")).withColumnRenamed("score", "lexical")
    top = top.join(news.select("doc", F.col("text").alias("title")), "doc").join(q.select("query", T.keywords(F.col("text")).alias("k")), "query")
    return top.select("query", "rank", "doc", "cosine", "lexical", T.coverage(F.col("k"), F.col("title")).alias("coverage"))


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _lexical_top(spark, sf_dir)
    decided = top.where("query % 3 <> 0").select("query", "doc", (F.pmod(F.col("query") * 7 + F.col("doc") * 13, F.lit(100)) / 100).alias("p")).where("p >= 0.2")
    return X.answers(top, decided, V.news(spark, sf_dir).select(F.col("id").alias("doc"), "outlet"), least_coverage=0.1)


def answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.length("text").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    kind = F.when(F.col("id") % 3 == 0, "choice").when(F.col("id") % 3 == 1, "score").otherwise("yes_no")
    q = c.where("n % 11 <> 0").select("id", kind.alias("kind"), F.array(F.lit("0"), F.lit("1"), F.lit("2")).alias("options"), F.lit(4).alias("levels"))
    value = F.when(F.col("n") % 7 == 0, F.lit("x")).when(F.col("n") % 5 == 0, (F.col("n") % 8 / 4).cast("string")).otherwise((F.col("n") % 6).cast("string"))
    return X.answer_problems(q, c.where("n % 13 <> 0").select("id", value.alias("value"))).select("id", F.array_join("problems", ",").alias("problems"))


# ---- evaluation ------------------------------------------------------------------------------------------------


def abstention_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"))
    return X.abstention_measures(b.select((F.col("item_id") % 2 == 0).alias("answerable"), (F.col("item_id") % 5 == 0).alias("hard"), (F.col("n") % 3 != 0).alias("answered"), (F.col("n") % 4 != 0).alias("hit")))


def support_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case"), F.col("turn").alias("claim"), F.length("text").alias("n")).groupBy("case", "claim").agg(F.max("n").alias("n"))
    human = c.select("case", "claim", F.when(F.col("n") % 9 != 0, F.col("n") % 4 != 0).alias("supported"))
    return X.support_measures(human, c.where("n % 5 <> 0").select("case", "claim", A.verdict((F.col("n") % 100) / 100).alias("verdict")))


def classifier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "labels")
    a = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    b = V.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").contains("|"), 0).otherwise(1).alias("label"))
    return X.agreement(a, b, "doc_id", "label")


def time_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations").select("turn", F.length("text").alias("n"))
    minutes = F.when(F.col("n") % 4 == 0, F.concat((F.col("n") % 50).cast("string"), F.lit(",5"))).otherwise((F.col("n") % 50).cast("string"))
    mode = F.when(F.col("turn") % 2 == 0, "manual").otherwise("assisted")
    return X.time_saving(c.select(mode.alias("mode"), minutes.alias("minutes"), (F.col("n") % 6 != 0).alias("done")), "manual", "assisted")


def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir).select("id", F.when(F.col("id") % 17 != 0, F.col("outlet")).alias("origin"), F.concat("outlet", F.lit("-"), F.col("id") % 3).alias("outlet"), "pub_ts", "title")
    bad = F.when(F.col("id") % 7 == 0, "no_date").when(F.col("id") % 5 == 0, "too_short")
    n = n.withColumn("reason", bad)
    valid = n.where("reason is null").select("origin", "outlet", F.col("pub_ts").alias("at"))
    documented = spark.createDataFrame([("src0",), ("src1",), ("nobody",)], "origin string")
    return X.catalogue(valid, n.where("reason is not null").select("origin", "reason"), documented)


def subset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.news(spark, sf_dir).where("id % 3 = 0").select("outlet", F.to_date("pub_ts").alias("day"))
    return X.subset_coverage(n, "day", "outlet", 5)


def extraction_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    return X.window_counts(V.news(spark, sf_dir), F.coalesce("pub_ts", "det_ts"), day("05"), day("20"))


def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey % 50 = 0")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "event").when(F.col("o_orderkey") % 3 == 1, "news").otherwise("memo")
    wanted = o.select(F.concat(kind, F.lit(":"), F.col("o_orderkey").cast("string")).alias("id"))
    kinds = {"event": V.quakes(spark, sf_dir).select(F.col("quake_id").alias("key"), F.col("status").alias("detail")), "news": V.news(spark, sf_dir).select(F.col("id").alias("key"), F.col("outlet").alias("detail"))}
    return X.evidence_by_id(wanted, kinds)


QUERIES = {f.__name__: f for f in (
    topic_scores, topic_inbox, filtered_inbox, evidence_state, recommended_actions, independent_sources, replica_families, topics_by_state, group_summary, series_links, adaptive_timeline, answered_questions, answer_problems,
    abstention_measures, support_measures, classifier_agreement, time_saving, source_catalogue, subset_coverage, extraction_window, evidence_lookup,
)}

_RAMP = "CASE WHEN {x} <= {a} THEN 10000 WHEN {x} >= {b} THEN 0 ELSE (2 * ({b} - {x}) * 10000 + {d}) // (2 * {d}) END"
_LONGEST = (
    "list_max(list_transform(range(1, length({a}) + 1), lambda i: coalesce(list_max(list_filter(range(1, length({a}) - i + 2), "
    "lambda l: contains({b}, substring({a}, i, l)))), 0) * 100000 + 99999 - i))"
)
#: CTEs over mem (g, key, outlet, title): comp (g, key, src), the source of each row. The longest common block of two titles,
#: of equals the first, is taken out again and again; one that has fewer edits than the ratio allows is looked at only.
_SOURCES_SQL = rf"""ti AS (SELECT g, key, lower(trim(coalesce(outlet, ''))) AS o,
    trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(title, ''))), '\([^)]{{1,40}}\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t FROM mem), nd AS (
  SELECT g, t, min(key) AS a, max(key) AS z FROM ti GROUP BY ALL), ca AS (
  SELECT x.g, x.a AS na, y.a AS nb, x.t AS p, y.t AS q, x.a < y.z AS fw, y.a < x.z AS bw FROM nd x JOIN nd y ON x.g IS NOT DISTINCT FROM y.g AND x.a < y.a
    AND 20 * least(length(x.t), length(y.t)) >= 9 * (length(x.t) + length(y.t)) WHERE 10 * levenshtein(x.t, y.t) <= length(x.t) + length(y.t)), od AS (
  SELECT DISTINCT p, q FROM (SELECT p, q FROM ca WHERE fw UNION ALL SELECT q, p FROM ca WHERE bw)), ro AS (
  SELECT p, q, p AS a, q AS b, {_LONGEST.format(a="p", b="q")} AS best FROM od
  UNION ALL
  SELECT p, q, s.a, s.b, {_LONGEST.format(a="s.a", b="s.b")} FROM (
    SELECT p, q, unnest([{{'a': left(a, i - 1), 'b': left(b, j - 1)}}, {{'a': substring(a, i + l), 'b': substring(b, j + l)}}]) AS s
    FROM (SELECT *, instr(b, substring(a, i, l)) AS j FROM (SELECT *, best // 100000 AS l, 99999 - best % 100000 AS i FROM ro WHERE best >= 100000))) WHERE length(s.a) > 0 AND length(s.b) > 0), sm AS (
  SELECT p, q FROM ro GROUP BY ALL HAVING 20 * sum(best // 100000) >= 9 * (length(p) + length(q))), ou AS (
  SELECT DISTINCT ti.g, ti.o, nd.a FROM ti JOIN nd ON ti.g IS NOT DISTINCT FROM nd.g AND ti.t = nd.t), ed AS (
  SELECT g, a AS x, min(a) OVER (PARTITION BY g, o) AS y FROM ou
  UNION SELECT g, na, nb FROM ca WHERE (fw AND EXISTS (FROM sm WHERE sm.p = ca.p AND sm.q = ca.q)) OR (bw AND EXISTS (FROM sm WHERE sm.p = ca.q AND sm.q = ca.p))), es AS (
  SELECT g, x, y FROM ed UNION SELECT g, y, x FROM ed), cc AS (
  SELECT g, a AS n, a AS r FROM nd UNION SELECT cc.g, es.y, cc.r FROM cc JOIN es ON es.g IS NOT DISTINCT FROM cc.g AND es.x = cc.n), rt AS (
  SELECT g, n, min(r) AS r FROM cc GROUP BY ALL), comp AS (
  SELECT ti.g, ti.key, rt.r AS src FROM ti JOIN nd ON ti.g IS NOT DISTINCT FROM nd.g AND ti.t = nd.t JOIN rt ON rt.g IS NOT DISTINCT FROM nd.g AND rt.n = nd.a)"""
_TOPICS_SQL = f"""WITH RECURSIVE {_SCORED_SQL}, it AS (SELECT id // 4 AS g, id, outlet, title, topic, local IS NOT NULL AS loc, pub_ts, det_ts FROM b), mem AS (
  SELECT g, id AS key, outlet, title FROM it), {_SOURCES_SQL}, sr AS (SELECT g, count(DISTINCT src) AS n_sources FROM comp GROUP BY g), tc AS (
  SELECT g, topic, count(*) AS n, min(id) AS f FROM it GROUP BY ALL), tt AS (SELECT g, arg_max(topic, n * 1000000000 - f) AS topic FROM tc GROUP BY g), ct AS (
  SELECT id // 4 AS g, bool_or(official.slot IS NOT NULL) AS off, count(*) FILTER (official.slot IS NULL) AS pending FROM news LEFT JOIN official ON slot = id % 5 GROUP BY 1), gr AS (
  SELECT g, count(*) AS n_items, count(DISTINCT lower(trim(coalesce(outlet, '')))) AS n_outlets, bool_or(loc) AS loc, bool_or(id % 28 = 0) AS outside,
    max(coalesce(pub_ts, det_ts)) AS newest, date_diff('hour', min(least(pub_ts, det_ts)), max(greatest(pub_ts, det_ts))) AS span FROM it GROUP BY g), ag AS (
  SELECT *, greatest(0, date_diff('hour', newest, TIMESTAMP '{REFERENCE}')) AS age FROM gr JOIN tt USING (g) JOIN sr USING (g) JOIN ct USING (g)), co AS (
  SELECT *, CAST(CASE WHEN loc THEN 5000 ELSE 0 END + CASE WHEN topic IN ('politics', 'economy') THEN 5000 ELSE 0 END AS BIGINT) AS relevance,
    CAST(CASE WHEN outside THEN 10000 ELSE CASE topic {" ".join(f"WHEN '{k}' THEN {v}" for k, v in IMPACT.items())} ELSE 3000 END END AS BIGINT) AS impact,
    CAST(CASE WHEN outside THEN 2500 WHEN newest IS NULL THEN 0 ELSE {_RAMP.format(x="age", a=24, b=168, d=144)} END AS BIGINT) AS urgency,
    CAST(CASE WHEN span IS NULL THEN 0 ELSE {_RAMP.format(x="span", a=72, b=720, d=648)} END AS BIGINT) AS novelty,
    CAST((2 * 5000 * least(n_sources, 3) + 3) // 6 + CASE WHEN off THEN 5000 ELSE 0 END AS BIGINT) AS evidence FROM ag), sc AS (
  SELECT *, CAST(({" + ".join(f"(2 * {k} * {w} + 100) // 200" for k, w in WEIGHTS.items())} + 5) // 10 AS BIGINT) AS tenths FROM co), tp AS (
  SELECT g AS "group", topic, n_items, n_outlets, n_sources, off AS official, pending, CASE WHEN n_sources < 2 AND NOT off THEN 'insufficient' WHEN n_sources >= 2 AND pending = 0 THEN 'sufficient' ELSE 'partial' END AS state,
    coalesce(span > 72, false) AS recirculated, relevance, impact, urgency, novelty, evidence, tenths, CASE WHEN tenths < 400 THEN 'low' WHEN tenths < 700 THEN 'mid' ELSE 'high' END AS band FROM sc)"""


def _measures_sql(parts: dict[str, tuple[str, str]], source: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS measure, count(*) FILTER (({c}) AND ({of})) AS n, count(*) FILTER ({of}) AS o FROM x" for k, (c, of) in parts.items())
    spread = lambda f, s, o: f"CASE WHEN o > 0 THEN round({f}({s}, (n / o + 1.96::DOUBLE * 1.96 / (2 * o) {o} 1.96::DOUBLE * sqrt(n / o * (1 - n / o) / o + 1.96::DOUBLE * 1.96 / (4 * o * o))) / (1 + 1.96::DOUBLE * 1.96 / o)), 4) END"
    return f"WITH x AS ({source}), m AS ({each}) SELECT measure, n, o AS \"of\", round(CASE WHEN o > 0 THEN n / o END, 4) AS share, {spread('greatest', '0.0::DOUBLE', '-')} AS low, {spread('least', '1.0::DOUBLE', '+')} AS high FROM m"


ORACLE = {
    "topic_scores": f"{_TOPICS_SQL} SELECT * FROM tp",
    "topic_inbox": f"""{_TOPICS_SQL}, r AS (SELECT CAST(row_number() OVER (ORDER BY tenths DESC, urgency DESC, "group") AS INT) AS place, * FROM tp)
SELECT place, "group", topic, band, state, tenths, n_items, n_sources FROM r WHERE place <= 20""",
    "filtered_inbox": f"""{_TOPICS_SQL} SELECT "group", band, state, topic FROM tp WHERE band IN ('mid', 'high') AND state IN ('partial', 'sufficient')""",
    "evidence_state": f'{_TOPICS_SQL} SELECT "group", n_outlets, n_sources, official, pending, state FROM tp',
    "recommended_actions": f"""{_TOPICS_SQL} SELECT "group", array_to_string(list_filter([CASE WHEN band = 'high' THEN 'review_first' END, CASE WHEN state = 'insufficient' THEN 'find_second_source' END,
  CASE WHEN pending > 0 THEN 'request_official_data' END, CASE WHEN recirculated THEN 'check_original_date' END, CASE WHEN band = 'low' AND state <> 'sufficient' THEN 'watch' END,
  CASE WHEN band <> 'low' AND state = 'sufficient' THEN 'draft' END], lambda x: x IS NOT NULL), ',') AS actions FROM tp""",
    "independent_sources": f"""WITH RECURSIVE {V.SQL["news"]}, mem AS (SELECT lang AS g, id AS key, outlet, title FROM news), {_SOURCES_SQL}
SELECT g AS "group", count(DISTINCT src) AS n FROM comp GROUP BY g""",
    "replica_families": f"""WITH RECURSIVE {V.SQL["news"]}, mem AS (SELECT lang AS g, id AS key, CAST(id AS VARCHAR) AS outlet, title FROM news), {_SOURCES_SQL}
SELECT g AS "group", src AS first, count(*) AS n FROM comp GROUP BY ALL HAVING count(*) > 1""",
    "topics_by_state": f"{_TOPICS_SQL} SELECT state, count(*) AS n FROM tp GROUP BY state",
    "group_summary": f"""WITH {V.SQL["news"]}, g AS (SELECT id // 4 AS g, count(*) AS size, count(DISTINCT lower(outlet)) AS o FROM news GROUP BY 1)
SELECT size, count(*) AS n_groups, count(*) FILTER (o > 1) AS n_multi_outlet, CAST(sum(size) AS BIGINT) AS n_items FROM g GROUP BY size""",
    "series_links": f"""WITH {V.SQL["news"]}, {V.SQL["indicator"]}, v AS (SELECT nation % 4 AS slot, year, CAST(sum(cents) AS BIGINT) AS value FROM indicator GROUP BY ALL), k AS (
  SELECT * FROM v WHERE (year + slot) % 3 <> 0), l AS (SELECT slot, max(year) AS y, arg_max(value, year) AS value FROM k GROUP BY slot), s AS (
  SELECT k.slot, string_agg(year || ':' || k.value, ' ' ORDER BY year) AS series FROM k JOIN l ON l.slot = k.slot AND year > y - 5 GROUP BY k.slot)
SELECT id, id % 5 AS slot, y AS year, l.value, series, CASE WHEN y IS NULL THEN 'pending' ELSE 'linked' END AS status FROM news LEFT JOIN l ON l.slot = id % 5 LEFT JOIN s ON s.slot = id % 5""",
    "adaptive_timeline": """WITH e AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders), u AS (
  SELECT *, CASE WHEN z - a <= 45 THEN 'day' WHEN z - a <= 210 THEN 'week' ELSE 'month' END AS unit FROM e), c AS (
  SELECT unnest(generate_series(date_trunc(unit, CAST(a AS TIMESTAMP)), date_trunc(unit, CAST(z AS TIMESTAMP)), CASE unit WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END)) AS period FROM u), n AS (
  SELECT date_trunc(unit, CAST(o_orderdate AS TIMESTAMP)) AS period, count(*) AS n FROM orders, u GROUP BY 1)
SELECT CAST(c.period AS DATE) AS period, coalesce(n.n, 0) AS n FROM c LEFT JOIN n ON n.period = c.period""",
    "answered_questions": f"""{_BM25_NEWS}, tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS INT) AS rank FROM bm), t5 AS (
  SELECT *, score / max(score) FILTER (rank = 1) OVER (PARTITION BY query) AS cosine FROM tk WHERE rank <= 5), ks AS (
  SELECT query, list_filter(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+'), lambda x: length(x) >= 4) AS ws FROM q), kd AS (SELECT query, list_distinct(ws) AS k FROM ks), st AS (
  SELECT doc, list_transform(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+'), lambda x: left(x, 5)) AS s FROM docs), t AS (
  SELECT t5.*, CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda w: list_contains(s, left(w, 5)))) / len(k) ELSE 0 END AS coverage,
    CASE WHEN query % 3 <> 0 AND (query * 7 + doc * 13) % 100 >= 20 THEN ((query * 7 + doc * 13) % 100) / 100 END AS p FROM t5 JOIN kd USING (query) JOIN st USING (doc)), ga AS (
  SELECT query, max(cosine) FILTER (rank = 1) AS c1, max(cosine) FILTER (rank = 2) AS c2, max(score) AS lex, count(p) > 0 AS bd FROM t GROUP BY query), gd AS (
  SELECT *, CASE WHEN c1 < 0.15 THEN 'below_floor' WHEN lex <= 0 AND c1 - coalesce(c2, 0) < 0.08 THEN 'no_margin' ELSE 'answer' END AS decision FROM ga), ok AS (
  SELECT query, doc, rank FROM t JOIN gd USING (query) WHERE decision = 'answer' AND CASE WHEN bd THEN coalesce(p >= 0.6, false) ELSE coverage >= 0.1 END), fo AS (
  SELECT query, count(*) AS n_cited, arg_min(doc, rank) AS best FROM ok GROUP BY query)
SELECT gd.query, CASE WHEN decision <> 'answer' THEN decision WHEN n_cited > 0 THEN 'answer' ELSE 'no_evidence' END AS outcome, CASE WHEN decision <> 'answer' THEN 'gate' WHEN bd THEN 'decision' ELSE 'lexical' END AS path,
  coalesce(n_cited, 0) AS n_cited, best, (SELECT count(*) FROM news) AS n_corpus, (SELECT count(DISTINCT outlet) FROM news) AS n_outlets FROM gd LEFT JOIN fo ON fo.query = gd.query""",
    "answer_problems": """WITH c AS (SELECT conv_id * 100 + turn AS id, max(length(text)) AS n FROM conversations GROUP BY 1), q AS (
  SELECT id, CASE id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'yes_no' END AS kind FROM c WHERE n % 11 <> 0), g AS (
  SELECT id, CASE WHEN n % 7 = 0 THEN 'x' WHEN n % 5 = 0 THEN CAST((n % 8) / 4 AS VARCHAR) ELSE CAST(n % 6 AS VARCHAR) END AS v FROM c WHERE n % 13 <> 0), j AS (
  SELECT coalesce(q.id, g.id) AS id, kind, v, TRY_CAST(v AS DOUBLE) AS x, q.id IS NOT NULL AS asked FROM q FULL JOIN g ON q.id = g.id), t AS (
  SELECT *, CASE kind WHEN 'choice' THEN true WHEN 'score' THEN coalesce(x = floor(x), false) ELSE x IS NOT NULL END AS typed FROM j)
SELECT id, array_to_string(list_filter([CASE WHEN asked AND v IS NULL THEN 'missing' END, CASE WHEN asked AND v IS NOT NULL AND NOT typed THEN 'type' END,
  CASE WHEN kind = 'choice' AND v IS NOT NULL AND v NOT IN ('0', '1', '2') THEN 'unknown_option' END,
  CASE WHEN v IS NOT NULL AND typed AND ((kind = 'score' AND NOT x BETWEEN 0 AND 3) OR (kind = 'yes_no' AND NOT x BETWEEN 0 AND 1)) THEN 'range' END, CASE WHEN NOT asked THEN 'extra' END], lambda y: y IS NOT NULL), ',') AS problems FROM t""",
    "abstention_measures": _measures_sql(
        {"correct_abstention": ("NOT answered", "NOT can"), "hard_rejected": ("NOT answered", "NOT can AND hard"), "wrong_abstention": ("NOT answered", "can"), "evidence_cited": ("answered AND hit", "can")},
        "SELECT item_id % 2 = 0 AS can, item_id % 5 = 0 AS hard, length(text) % 3 <> 0 AS answered, length(text) % 4 <> 0 AS hit FROM benchmark",
    ),
    "support_measures": _measures_sql(
        {"supported": ("s", "s IS NOT NULL"), "agreement": ("s = (v = 'supported')", "s IS NOT NULL AND coalesce(v IN ('supported', 'unsupported'), false)")},
        """SELECT CASE WHEN n % 9 <> 0 THEN n % 4 <> 0 END AS s, CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 100 >= 70 THEN 'supported' WHEN n % 100 < 40 THEN 'unsupported' ELSE 'doubtful' END END AS v
  FROM (SELECT conv_id, turn, max(length(text)) AS n FROM conversations GROUP BY ALL)""",
    ),
    "classifier_agreement": """WITH x AS (SELECT quality AS a, CASE WHEN contains(text, '|') THEN 0 ELSE 1 END AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (a = b) AS same, round(avg(CAST(a = b AS INT)), 6) AS share FROM x""",
    "time_saving": """WITH g AS (SELECT CASE WHEN turn % 2 = 0 THEN 'manual' ELSE 'assisted' END AS mode, count(*) AS n, median(n % 50 + CASE WHEN n % 4 = 0 THEN 0.5::DOUBLE ELSE 0 END) AS m
  FROM (SELECT turn, length(text) AS n FROM conversations) WHERE n % 6 <> 0 GROUP BY 1)
SELECT mode, n, round(m, 6) AS median, CASE WHEN mode = 'assisted' THEN round(1 - m / (SELECT m FROM g WHERE mode = 'manual'), 6) END AS saving FROM g""",
    "source_catalogue": f"""WITH {V.SQL["news"]}, n AS (SELECT CASE WHEN id % 17 <> 0 THEN outlet END AS origin, outlet || '-' || (id % 3) AS outlet, pub_ts, CASE WHEN id % 7 = 0 THEN 'no_date' WHEN id % 5 = 0 THEN 'too_short' END AS reason FROM news), r AS (
  SELECT origin, count(*) AS n_rows, count(DISTINCT outlet) AS n_outlets, min(pub_ts) AS first, max(pub_ts) AS last, count(*) FILTER (pub_ts IS NULL) AS n_undated FROM n WHERE reason IS NULL GROUP BY origin), x AS (
  SELECT origin, CAST(sum(c) AS BIGINT) AS n_excluded, string_agg(reason || '=' || c, ' ' ORDER BY reason || '=' || c) AS reasons FROM (SELECT origin, reason, count(*) AS c FROM n WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY origin), d AS (
  SELECT unnest(['src0', 'src1', 'nobody']) AS origin), o AS (SELECT origin FROM r UNION SELECT origin FROM x UNION SELECT origin FROM d)
SELECT o.origin, coalesce(n_rows, 0) AS n_rows, coalesce(n_outlets, 0) AS n_outlets, first, last, coalesce(n_undated, 0) AS n_undated, coalesce(n_excluded, 0) AS n_excluded, reasons, d.origin IS NOT NULL AS documented
FROM o LEFT JOIN r ON o.origin IS NOT DISTINCT FROM r.origin LEFT JOIN x ON o.origin IS NOT DISTINCT FROM x.origin LEFT JOIN d ON o.origin IS NOT DISTINCT FROM d.origin""",
    "subset_coverage": f"WITH {V.SQL['news']} SELECT outlet, count(*) AS n, count(DISTINCT CAST(pub_ts AS DATE)) AS n_days, count(*) >= 5 AS enough FROM news WHERE id % 3 = 0 GROUP BY outlet",
    "extraction_window": f"""WITH {V.SQL["news"]}, x AS (SELECT coalesce(pub_ts, det_ts) AS t FROM news)
SELECT count(*) FILTER (t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-20') AS kept, count(*) FILTER (t < TIMESTAMP '2024-01-05' OR t >= TIMESTAMP '2024-01-20') AS outside, count(*) FILTER (t IS NULL) AS undated FROM x""",
    "evidence_lookup": f"""WITH {V.SQL["news"]}, w AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'news' ELSE 'memo' END AS p FROM orders WHERE o_orderkey % 50 = 0)
SELECT p || ':' || k AS id, CASE WHEN p = 'memo' THEN 'unknown' ELSE p END AS kind, coalesce(e.event_type, n.outlet) IS NOT NULL AS found, coalesce(e.event_type, n.outlet) AS detail
FROM w LEFT JOIN events e ON p = 'event' AND e.event_id = k LEFT JOIN news n ON p = 'news' AND n.id = k""",
}
