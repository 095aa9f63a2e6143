"""Streams over several triggers: late rows, forgotten keys, closed sessions, growing logs."""

import datetime

from pyspark.sql import functions as F

from loomwork.plans import streams as plans
from loomwork.sources import sinks
from loomwork.streaming import streams as S

DAY = datetime.datetime(2024, 1, 1)
SHAPE = "user long, kind string, at timestamp_ntz, found timestamp_ntz"


def batch(spark, path, rows):
    """Another file of the source; one file is one trigger."""
    at = lambda h: None if h is None else DAY + datetime.timedelta(hours=h)
    spark.createDataFrame([(u, k, at(a), at(f)) for u, k, a, f in rows], SHAPE).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_first_seen_forgets_what_is_past_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    batch(spark, path, [(1, "a", 0, None), (1, "a", 1, None), (2, "b", 2, None)])
    batch(spark, path, [(1, "a", 3, None), (3, "c", 100, None)])
    batch(spark, path, [(3, "c", 101, None), (2, "b", 1, None)])
    batch(spark, path, [(1, "a", 103, None)])
    seen = S.first_seen(source(spark, path), "at", "10 hours", ["user", "kind"]).select("user", F.hour("at").alias("h"))
    rows = sorted(tuple(r) for r in S.drain(seen).collect())
    # the pair of user 1 is new again after it was forgotten; what is behind the watermark is dropped
    assert [u for u, _ in rows] == [1, 1, 2, 3]


def test_sessions_close_by_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    batch(spark, path, [(1, "a", 0, None), (1, "a", 2, None), (2, "b", 1, None)])
    batch(spark, path, [(1, "a", 4, None), (1, "a", 30, None)])
    batch(spark, path, [(2, "b", 60, None)])
    rows = sorted(tuple(r) for r in S.drain(S.sessions(source(spark, path), "at", "5 hours", "3 hours", "user").select("user", "n")).collect())
    # the session of hour 60 is still open
    assert rows == [(1, 1), (1, 3), (2, 1)]


def test_late_rows_are_routed_and_not_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    batch(spark, path, [(1, "a", 0, 3), (2, "a", 0, 4)])
    batch(spark, path, [(3, "a", None, 4), (4, "a", 9, None), (5, "a", 1, 90)])
    current, late = S.split_late(source(spark, path), "at", "found", 3)
    assert sorted(r["user"] for r in S.drain(current.select("user")).collect()) == [1, 3, 4]
    assert sorted(r["user"] for r in S.drain(late.select("user")).collect()) == [2, 5]


def test_a_growing_log_is_read_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    log = lambda *rows: sinks.append_log(spark.createDataFrame(list(rows), "case long, state string"), path)
    log((1, "new"), (2, "new"))
    log((1, "approved"))
    (tmp_path / "log" / "part-x.json").write_text("{broken\n")
    rows = S.drain(S.read_log(spark, path, "case long, state string")).collect()
    assert sorted((r["case"] or 0, r["state"] or "") for r in rows) == [(0, ""), (1, "approved"), (1, "new"), (2, "new")]


def test_sessions_that_are_still_open_are_given_out(spark, tmp_path):
    """Every event of the table is in a session of the query, also those that no watermark would have closed."""
    at = lambda h: DAY + datetime.timedelta(hours=h)
    rows = [(1, at(0)), (1, at(5)), (1, at(40)), (2, at(41)), (2, at(100)), (2, at(101))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in plans.stream_sessions(spark, str(tmp_path)).collect())
    assert got == [(1, at(0), 2), (1, at(40), 1), (2, at(41), 1), (2, at(100), 2)]
