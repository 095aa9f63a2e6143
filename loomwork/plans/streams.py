"""Streaming queries: each drains its source and must equal its batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources import views as V
from loomwork.streaming import streams as S


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read(spark, f"{sf_dir}/{name}.parquet", V.table(spark, sf_dir, name).schema)


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.tumbling(_stream(spark, sf_dir, "events"), "ts", "72 hours", "1 day", "event_type")
    flat = counts.select(F.to_date("w.start").alias("day"), "event_type", "n")
    return S.drain(flat, "update", ["day", "event_type"])


def stream_weekly_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.sliding(_stream(spark, sf_dir, "events"), "ts", "72 hours", "7 days", "1 day")
    return S.drain(counts.select(F.to_date("w.start").alias("day"), "n"), "update", ["day"])


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of a user by gaps of 12 hours, those still open too: no watermark closes them, so the stream runs in complete mode."""
    s = S.sessions(_stream(spark, sf_dir, "events").select("user_id", "ts"), "ts", None, "12 hours", "user_id")
    return S.drain(s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of a stream of headlines that are split by how long after their date they were found."""
    n = V.news(spark, sf_dir, _stream(spark, sf_dir, "documents")).select("id", "pub_ts", "det_ts")
    current, late = S.split_late(n, "pub_ts", "det_ts", 3)
    return S.drain(current.select("id", F.lit("current").alias("route"))).union(S.drain(late.select("id", F.lit("late").alias("route"))))


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return S.drain(S.latest_state(c, "conv_id", "turn", "role"), "update", ["conv_id"])


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, type) pairs as they are first seen; the state forgets a pair once the watermark, a year behind, is past it."""
    seen = S.first_seen(_stream(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "ts", "365 days", ["user_id", "event_type"])
    return S.drain(seen.select("user_id", "event_type"))


def stream_cached_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = V.table(spark, sf_dir, "conversations").where("length(text) % 3 = 0").select(F.sha2("text", 256).alias("key"), (F.length("text") % 100).alias("answer")).distinct()
    asked = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("key"))
    return S.drain(S.cached(asked, cache).select("conv_id", "turn", "origin", "answer"))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_weekly_sliding, stream_sessions, stream_late_rows, stream_latest_state, stream_first_seen, stream_cached_decisions)}

ORACLE = {
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_weekly_sliding": "SELECT CAST(CAST(ts AS DATE) - CAST(k AS INT) AS DATE) AS day, count(*) AS n FROM events, range(0, 7) t(k) GROUP BY 1",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_late_rows": f"WITH {V.SQL['news']} SELECT id, CASE WHEN date_diff('second', pub_ts, det_ts) > 3 * 3600 THEN 'late' ELSE 'current' END AS route FROM news",
    "stream_latest_state": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_cached_decisions": """SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'cache' ELSE 'open' END AS origin, CAST(CASE WHEN length(text) % 3 = 0 THEN length(text) % 100 END AS INT) AS answer
FROM conversations""",
}
