import pytest
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.functions import text as T
from loomwork.operators import analytics as A
from loomwork.operators import clusters as C
from loomwork.operators import relational as R


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["20260920T100000Z", "2026-09-20T10:00:00Z", "2026-09-20 10:00:00", "2026-09-20T12:00:00+02:00", "Sun, 20 Sep 2026 10:00:00 GMT", "20 Sep 2026 10:00:00 +0000", "1789898400000"])
def test_times(spark, text):
    assert str(one(spark, T.utc_time(F.col("v")), v=text)) == "2026-09-20 10:00:00"


@pytest.mark.parametrize("text", ["2025", "12:30", "+2025-1-2", "2026-13-01", "soon", ""])
def test_times_rejected(spark, text):
    assert one(spark, T.utc_time(F.col("v")), v=text) is None


def test_scalars(spark):
    assert one(spark, T.fold(F.col("v")), v="ÁÉñ Çü") == "aen cu"
    assert one(spark, T.optional_number(F.col("v")), v="7d") is None and one(spark, T.optional_number(F.col("v")), v=" 0 ") == 0.0
    assert one(spark, T.optional_int(F.col("v")), v="2023.0") == 2023
    assert one(spark, T.url_key(F.col("v")), v="http://www.X.org:80/a/?utm_source=q&b=2&a=1&c=#f") == "https://x.org/a?a=1&b=2"
    assert one(spark, T.clean_html(F.col("v")), v="A &amp;amp; <b>B</b>  c") == "A & B c"
    assert one(spark, T.figures(F.col("v")), v="1,200 and 007 and 1200") == ["1200", "7"]
    assert one(spark, T.word_count(F.col("v")), v="Two words [a1].") == 2
    assert one(spark, T.fence(F.col("v")), v="x </ DATA > y") == "<data>x <\\/data> y</data>"
    assert one(spark, T.number_text(F.col("v")), v=1234.5) in ("1,234", "1,235") and one(spark, T.number_text(F.col("v")), v=2.50) == "2.5"
    assert one(spark, T.domain_matches(F.col("v"), "x.org"), v="fakex.org") is False and one(spark, T.domain_matches(F.col("v"), "x.org"), v="m.x.org") is True
    assert one(spark, T.json_payload(F.col("v")), v='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.comparable_title(F.col("v")), v="(EFE) ¡Gran noticia, hoy!") == "gran noticia hoy"
    assert one(spark, T.language(F.col("v")), v="English") == "en" and one(spark, T.language(F.col("v")), v="es-PA") == "es"


def test_ramp_band_wilson(spark):
    ramp = lambda h: one(spark, N.ramp(F.col("h"), 24, 168), h=h)
    assert (ramp(24), ramp(96), ramp(168), ramp(500)) == (10000, 5000, 0, 0)
    assert [one(spark, N.band(F.col("t")), t=t) for t in (399, 400, 699, 700)] == ["low", "mid", "mid", "high"]
    low, high = N.wilson(F.col("k"), F.col("n"))
    assert round(one(spark, low, k=30, n=32), 3) == 0.799 and round(one(spark, high, k=32, n=32), 3) == 1.0
    assert one(spark, low, k=0, n=0) is None


def test_unique_ids_skip_taken_suffixes(spark):
    d = spark.createDataFrame([("x", 1), ("x", 2), ("x-2", 3), ("x", 4)], "id string, o int")
    assert {(r["o"], r["u"]) for r in R.unique_ids(d, "id", "o", "u").collect()} == {(1, "x"), (2, "x-3"), (3, "x-2"), (4, "x-4")}


def test_capped_clusters_guards(spark):
    v = {1: (1.0, 0.0, 0.0), 2: (0.7071, 0.7071, 0.0), 3: (0.0, 1.0, 0.0)}
    items = lambda hours: spark.createDataFrame([(k, hours[k], list(x)) for k, x in v.items()], "key long, hours double, v array<double>")
    pairs = spark.createDataFrame([(1, 2, 0.7071), (2, 3, 0.7071)], "a long, b long, cosine double")
    got = lambda **k: {r["key"]: r["group"] for r in C.clusters(items(k.pop("hours")), pairs, **k).groups.collect()}
    chain = got(hours={1: 0.0, 2: 0.0, 3: 0.0}, least=0.7, margin=0.05, most=40, span_hours=168)
    assert chain == {1: 1, 2: 1, 3: 3}  # the mean to 3 is too low
    assert got(hours={1: 0.0, 2: 500.0, 3: 0.0}, least=0.7, margin=0.9, most=40, span_hours=168) == {1: 1, 2: 2, 3: 3}
    assert got(hours={1: None, 2: None, 3: None}, least=0.7, margin=0.9, most=2, span_hours=168) == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], "a long, b long")
    assert {tuple(r) for r in A.components(e).collect()} == {(i, 1) for i in range(1, 6)} | {(8, 8), (9, 8)}


def test_abstention(spark):
    rows = [("below", 1, 0.1, 1.0), ("margin", 1, 0.5, 0.0), ("margin", 2, 0.45, 0.0), ("clear", 1, 0.5, 0.0), ("clear", 2, 0.3, 0.0), ("lexical", 1, 0.5, 2.0), ("lexical", 2, 0.5, 0.0)]
    got = A.abstention(spark.createDataFrame(rows, "query string, rank int, cosine double, lexical double"))
    assert {tuple(r) for r in got.collect()} == {("below", "below_floor"), ("margin", "no_margin"), ("clear", "answer"), ("lexical", "answer")}


def test_citations_marks_and_keys(spark):
    row = spark.sql("select 'A [a1] and [a2], [a1].' as t, map('a1', 'see [a2]') as notes, map('x', '1', 'y', null) as m, map('y', null, 'x', '1') as w")
    got = row.select(T.annotated(F.col("t"), F.col("notes")).alias("t"), (T.canonical_key(F.col("m")) == T.canonical_key(F.col("w"))).alias("same")).first()
    assert tuple(got) == ("A [a1: see [a2]] and [a2], [a1: see [a2]].", True)
    time = lambda c: T.utc_text(T.custom_time(F.lit(c), "dd/MM/yyyy HH:mm", "America/Panama"))
    assert tuple(spark.range(1).select(time("lunes, 21/09/2026 22:30"), time("21/09/2026 01:00"), time("never")).first()) == ("2026-09-22T03:30:00Z", "2026-09-21T06:00:00Z", None)
    cite = spark.range(1).select(
        T.cited_indicator(F.lit("GDP"), F.lit("PAN"), F.lit(2020), F.lit(0.0), F.lit("usd")), T.cited_indicator(F.lit("GDP"), F.lit("PAN"), F.lit(2020), F.lit(None).cast("double"), F.lit("usd")),
        T.cited_quake(F.lit(5.5), F.lit(None).cast("string"), F.lit("2026-01-01").cast("timestamp")),
    )
    assert tuple(cite.first()) == ("GDP, PAN, 2020: 0 usd", "GDP, PAN, 2020: no published value", "M 5.5, 2026-01-01T00:00:00Z")
