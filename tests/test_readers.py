import json

import pytest
from pyspark.sql import functions as F

from loomwork.sources import readers, sinks

NEWS = """﻿news_id,title,url,outlet,language,published,detected,extracted,topic,origin,scope
a,One,https://x.org/1,X,es,2026-09-20T12:00:00Z,,2026-09-21T00:00:00Z,,feed,
b,"Quoted, comma",https://x.org/2,X,es,"Sun, 20 Sep 2026 10:00:00 +0000",null,2026-09-21T00:00:00Z,,feed,
c,,https://x.org/3,X,es,,,2026-09-21T00:00:00Z,,feed,
d,Bad url,ftp//x,X,es,,,2026-09-21T00:00:00Z,,feed,
a,Again,https://x.org/4,X,es,,,2026-09-21T00:00:00Z,,feed,
e,Bad date,https://x.org/5,X,es,2026-13-40T00:00:00Z,,2026-09-21T00:00:00Z,,feed,
f,Late,https://x.org/6,X,es,2026-09-25T00:00:00Z,,2026-09-21T00:00:00Z,,feed,
g,Compact,https://x.org/7,X,es,20260920T010203Z,,2026-09-21T00:00:00Z,,feed,
h,Short row,https://x.org/8,X,es,,,2026-09-21T00:00:00Z
i,Long row,https://x.org/9,X,es,,,2026-09-21T00:00:00Z,,feed,,extra
"""


def reasons(df, key):
    return {(r[key], tuple(r["reasons"])) for r in df.select(key, "reasons").collect()}


def test_news_contract(spark, tmp_path):
    (tmp_path / "news.csv").write_text(NEWS)
    rows = readers.contract_csv(spark, str(tmp_path / "news.csv"), readers.NEWS)
    got = readers.validated_news(rows)
    assert reasons(got, "news_id") == {
        ("a", ()), ("b", ()), ("c", ("title",)), ("d", ("url",)), ("a", ("duplicate",)), ("e", ("published",)), ("f", ("after_extraction",)), ("g", ()), ("h", ()), ("i", ("surplus",)),
    }
    window = readers.validated_news(rows, F.lit("2026-09-20 11:00:00").cast("timestamp"), F.lit("2026-09-21 00:00:00").cast("timestamp"))
    assert ("b", ("outside_window",)) in reasons(window, "news_id") and ("h", ()) in reasons(window, "news_id")
    sinks.rejects(got, str(tmp_path / "rejects"), "news.csv", "news_id")
    assert spark.read.json(str(tmp_path / "rejects")).count() == 6


def test_indicators_keep_zero_and_null_apart(spark, tmp_path):
    (tmp_path / "i.csv").write_text(
        "country,indicator,year,value,unit,source_url,extracted,licence\n"
        "PAN,GDP,2020,0,usd,https://w.org,2026-01-01T00:00:00Z,cc\nPAN,GDP,2021,,usd,https://w.org,2026-01-01T00:00:00Z,cc\n"
        "pan,GDP,2020,1,usd,https://w.org,2026-01-01T00:00:00Z,cc\nPAN,GDP,x,1,usd,https://w.org,2026-01-01T00:00:00Z,cc\nPAN,GDP,2022,7d,usd,https://w.org,2026-01-01T00:00:00Z,cc\n"
    )
    got = readers.validated_indicators(readers.contract_csv(spark, str(tmp_path / "i.csv"), readers.INDICATORS)).orderBy("line").collect()
    assert [list(r["reasons"]) for r in got] == [[], [], ["country"], ["year"], ["value"]]
    assert got[0]["value_n"] == 0.0 and got[1]["value_n"] is None


def test_geojson(spark, tmp_path):
    def feature(i, mag, lon, lat, *depth):
        return {"id": i, "properties": {"mag": mag, "place": "p", "time": 1700000000000, "updated": None, "status": "ok", "url": "https://u.org/x"}, "geometry": {"coordinates": [lon, lat, *depth]}}

    good = [feature("a", 5.0, -80.0, 8.0, 10.0), feature("b", None, 1.0, 1.0, 1.0), feature("c", 4.0, 1.0, 200.0, 1.0), feature("d", 3.0, 2.0, 2.0)]
    (tmp_path / "q.json").write_text(json.dumps({"features": good}))
    got = {r["id"]: r for r in readers.validated_quakes(readers.geojson(spark, str(tmp_path / "q.json"))).collect()}
    assert [list(got[k]["reasons"]) for k in "abcd"] == [[], ["magnitude"], ["latitude"], []]
    assert got["d"]["depth"] is None and got["a"]["depth"] == 10.0
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.geojson(spark, str(tmp_path / "bad.json")).first()["file_error"]


def test_feeds(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(
        "<rss><channel><item><title>A &amp;amp; B</title><link>https://x.org/a</link><pubDate>Sun, 20 Sep 2026 10:00:00 +0000</pubDate></item>"
        "<item><title>Guid</title><guid>https://x.org/tv/b</guid></item><item><link>https://x.org/c</link></item></channel></rss>"
    )
    got = readers.feed(spark, str(tmp_path / "rss.xml"), "X", excluded=("/tv/",)).orderBy("url").collect()
    assert [(r["title"], r["url"], r["excluded"]) for r in got] == [("A & B", "https://x.org/a", False), ("Guid", "https://x.org/tv/b", True)]
    assert str(got[0]["published_ts"]) == "2026-09-20 10:00:00"
    (tmp_path / "map.xml").write_text(
        '<urlset xmlns:news="n" xmlns:image="i"><url><loc>https://x.org/1</loc><news:news><news:title>N</news:title><news:publication_date>2026-09-20T00:00:00Z</news:publication_date></news:news></url>'
        "<url><loc>https://x.org/2</loc><image:image><image:title>I</image:title></image:image></url><url><loc>https://x.org/3</loc></url></urlset>"
    )
    assert [(r["title"], r["url"]) for r in readers.feed(spark, str(tmp_path / "map.xml"), "X", "url").orderBy("url").collect()] == [("N", "https://x.org/1"), ("I", "https://x.org/2")]
    (tmp_path / "atom.xml").write_text('<feed><entry><title>T</title><link rel="self" href="https://x.org/s"/><link rel="alternate" href="https://x.org/t"/><updated>2026-09-20T00:00:00Z</updated></entry></feed>')
    assert readers.feed(spark, str(tmp_path / "atom.xml"), "X", "entry").first()["url"] == "https://x.org/t"


def test_groups_labels_reports(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"group_id": "g1", "ids": ["1", "2"]}\n\nnot json\n{"group_id": "g2", "ids": ["2", "9"]}\n')
    known = spark.range(1, 4)
    members, warnings = readers.groups(spark, str(tmp_path / "g.jsonl"), known)
    assert {(r["group_id"], r["id"]) for r in members.collect()} == {("g1", "1"), ("g1", "2")}
    assert {(r["warning"], r["id"]) for r in warnings.collect()} == {("invalid", None), ("unknown", "9"), ("assigned", "2")}
    (tmp_path / "l.csv").write_text("id;label\n1;a,b\n")
    assert readers.labels(spark, str(tmp_path / "l.csv"), ["id", "label"]).first()["label"] == "a,b"
    (tmp_path / "j.xml").write_text('<testsuite><testcase classname="t" name="ok"/><testcase classname="t" name="bad"><failure>x</failure></testcase></testsuite>')
    assert {tuple(r) for r in readers.junit(spark, str(tmp_path / "j.xml")).collect()} == {("t::ok", "passed"), ("t::bad", "failed")}


def test_upsert_and_redaction(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.upsert(old, spark.createDataFrame([("b", 3)], "k string, v int"), "k", str(tmp_path / "t"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 3)}
    raw = spark.createDataFrame([("x", {"v": "1", "w": "2"})], "k string, raw map<string,string>")
    assert sinks.redacted(raw, ("v",), "raw").first()["raw"] == {"w": "2"}


def test_sitemap_dates(spark, tmp_path):
    url = "<url><loc>https://x.org/{0}</loc>{1}<image:image><image:title>T {0}</image:title></image:image></url>"
    rows = [url.format("a", "<lastmod>2026-09-30T12:00:00Z</lastmod>"), url.format("b", "<lastmod>2026-08-30T23:00:00Z</lastmod>"), url.format("c", "<lastmod>2026-10-01T12:00:00Z</lastmod>"), url.format("d", "")]
    head = '<urlset xmlns="http://s" xmlns:image="http://i">'
    (tmp_path / "s.xml").write_text(head + "".join(rows) + "</urlset>")
    got = {r["url"][-1]: (r["from_lastmod"], str(r["published_ts"])) for r in readers.sitemap(spark, str(tmp_path / "s.xml"), "X", month="2026-09").collect()}
    assert got == {"a": (True, "2026-09-30 12:00:00"), "b": (False, "None"), "c": (True, "2026-10-01 12:00:00"), "d": (False, "None")}
    (tmp_path / "i.xml").write_text('<sitemapindex xmlns="http://s"><sitemap><loc>https://x.org/s.xml</loc></sitemap></sitemapindex>')
    with pytest.raises(ValueError):
        readers.sitemap(spark, str(tmp_path / "i.xml"), "X")


def test_language_of_feeds(spark, tmp_path):
    item = "<item><title>One</title><link>https://x.org/1</link></item>"
    (tmp_path / "a.xml").write_text(f"<rss><channel><language>es-PA</language>{item}</channel></rss>")
    (tmp_path / "b.xml").write_text(f'<rdf:RDF xmlns:rdf="http://r" xml:lang="en"><channel><title>c</title></channel>{item}</rdf:RDF>')
    (tmp_path / "c.xml").write_text(f"<rss><channel>{item}</channel></rss>")
    assert [readers.language(spark, str(tmp_path / f"{k}.xml"), "fr") for k in "abc"] == ["es-PA", "en", "fr"]
    assert [r["title"] for r in readers.feed(spark, str(tmp_path / "b.xml"), "X").collect()] == ["One"]


def test_months(spark):
    w = spark.sql("select timestamp'2026-07-31 10:00:00' as start, timestamp'2026-10-01 00:00:00' as end")
    assert [r[0] for r in readers.months(w, 9).collect()] == ["2026-09", "2026-08", "2026-07"]
    assert [r[0] for r in readers.months(w, 2).collect()] == ["2026-09", "2026-08"]


def test_decision_store(spark, tmp_path):
    path = str(tmp_path / "store")
    for answer, at in ((0.2, "2026-01-01"), (0.7, "2026-01-02")):
        sinks.store_decisions(spark.sql(f"select 'a' as key, double({answer}) as answer, timestamp'{at}' as at"), path)
    (tmp_path / "store" / "broken.json").write_text('{"key": "b", "ans\n{"key": "c"}\n')
    assert [tuple(r) for r in readers.decisions(spark, path).collect()] == [("a", 0.7)]
