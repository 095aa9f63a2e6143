"""Readers of snapshots, feeds, labels, logs and test reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomwork.functions import text as T
from loomwork.operators.relational import in_window, validate

NEWS = ["news_id", "title", "url", "outlet", "language", "published", "detected", "extracted", "topic", "origin", "scope", "description"]
INDICATORS = ["country", "indicator", "year", "value", "unit", "source_url", "extracted", "licence"]


def contract_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """All cells as text, quoted as in RFC 4180, a byte order mark allowed; `surplus` marks rows with too many cells.

    Missing columns of the header are null. Types come from validation, never from inference. `line` orders rows
    of a file by their place; files are read whole, one task each, because quoted cells may hold line ends.
    """
    header = spark.read.text(path).limit(1).select(F.regexp_replace("value", "^﻿", "").alias("value")).first()
    names = [h.strip().strip('"') for h in (header[0].split(sep) if header else [])]
    schema = StructType([StructField(n, StringType()) for n in names] + [StructField("_corrupt", StringType())])
    rows = spark.read.csv(path, header=True, schema=schema, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    unquoted = F.regexp_replace(F.coalesce("_corrupt", F.lit("")), '"(?:[^"]|"")*"', "q")
    surplus = F.size(F.split(unquoted, sep)) > len(names)
    out = rows.withColumn("surplus", F.col("_corrupt").isNotNull() & surplus).withColumn("line", F.monotonically_increasing_id())
    return out.select(*[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns], "surplus", "line")


def validated_news(rows: DataFrame, start=None, end=None) -> DataFrame:
    """News rows with parsed times and `reasons`: bad fields, then window, then repeated ids."""
    t = rows
    for c in ("published", "detected", "extracted"):
        t = t.withColumn(f"{c}_ts", T.utc_time(F.col(c)))
    bad_time = lambda c: ~T.is_null_token(F.col(c)) & F.col(f"{c}_ts").isNull()
    rules = {
        "surplus": F.col("surplus"), "news_id": T.is_null_token(F.col("news_id")), "title": T.is_null_token(F.col("title")), "outlet": T.is_null_token(F.col("outlet")),
        "url": ~T.valid_url(F.col("url")), "published": bad_time("published"), "detected": bad_time("detected"),
        "extracted": F.col("extracted_ts").isNull(), "after_extraction": F.greatest("published_ts", "detected_ts") > F.col("extracted_ts"),
    }
    date = F.coalesce("published_ts", "detected_ts")
    window = in_window(date, start, end) if start is not None else None
    return validate(t, rules, ["news_id"], F.col("line"), window)


def validated_indicators(rows: DataFrame) -> DataFrame:
    t = rows.withColumn("year_n", T.optional_int(F.col("year"))).withColumn("value_n", T.optional_number(F.col("value"))).withColumn("extracted_ts", T.utc_time(F.col("extracted")))
    rules = {
        "surplus": F.col("surplus"), "country": ~F.coalesce(F.col("country").rlike("^[A-Z]{3}$"), F.lit(False)), "indicator": T.is_null_token(F.col("indicator")),
        "year": F.col("year_n").isNull() | ~F.col("year_n").between(1900, 2100), "value": ~T.is_null_token(F.col("value")) & F.col("value_n").isNull(),
        "source_url": ~T.valid_url(F.col("source_url")), "extracted": F.col("extracted_ts").isNull(),
    }
    return validate(t, rules, ["country", "indicator", "year"], F.col("line"))


_FEATURE = """struct<features: array<struct<id: string,
  properties: struct<mag: double, time: bigint, updated: bigint, place: string, status: string, url: string>,
  geometry: struct<coordinates: array<double>>>>>"""


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features flattened, missing coordinates null; an unreadable file is one row with `file_error`."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", _FEATURE.replace("\n", " ")).alias("j"))
    one = whole.select(F.col("j.features").isNull().alias("file_error"), F.posexplode_outer("j.features").alias("line", "f"))
    at = lambda i: F.try_element_at("f.geometry.coordinates", F.lit(i))
    p = "f.properties."
    out = one.select(
        "file_error", "line", F.col("f.id").alias("id"), F.col(p + "mag").alias("magnitude"), F.timestamp_millis(F.col(p + "time")).alias("t"),
        F.timestamp_millis(F.col(p + "updated")).alias("updated"), at(1).alias("longitude"), at(2).alias("latitude"), at(3).alias("depth"),
        F.col(p + "place").alias("place"), F.col(p + "status").alias("status"), F.col(p + "url").alias("url"),
    )
    return out


def validated_quakes(rows: DataFrame) -> DataFrame:
    rules = {
        "file": F.col("file_error"), "id": T.is_null_token(F.col("id")), "magnitude": F.col("magnitude").isNull(), "time": F.col("t").isNull(),
        "longitude": F.col("longitude").isNull() | ~F.col("longitude").between(-180, 180), "latitude": F.col("latitude").isNull() | ~F.col("latitude").between(-90, 90),
        "url": F.col("url").isNotNull() & ~T.valid_url(F.col("url")),
    }
    return validate(rows, rules, ["id"], F.col("line"))


def feed(spark: SparkSession, path: str, outlet: str, kind: str = "item", excluded: tuple[str, ...] = ()) -> DataFrame:
    """Items of RSS (kind item), Atom (entry) or sitemaps (url): title, url, published, summary, excluded.

    Items without title or address are dropped; paths that begin with an excluded prefix are marked.
    """
    schema = """title string, link string, guid string, pubDate string, description string, `content:encoded` string, `dc:date` string,
      published string, updated string, summary string, loc string, lastmod string,
      `news:news` struct<`news:title`: string, `news:publication_date`: string>, `image:image` struct<`image:title`: string>"""
    if kind == "entry":
        schema = schema.replace("link string", "link array<struct<_rel: string, _href: string, _VALUE: string>>")
    raw = spark.read.format("xml").option("rowTag", kind).option("ignoreNamespace", "false").schema(schema.replace("\n", " ")).load(path)
    if kind == "entry":
        alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        link = F.coalesce(F.try_element_at(alternate, F.lit(1))["_href"], F.try_element_at(F.col("link"), F.lit(1))["_VALUE"])
    else:
        link = F.coalesce(F.col("link"), F.col("loc"), F.when(F.col("guid").rlike("^https?://"), F.col("guid")))
    title = F.coalesce(F.col("title"), F.col("`news:news`.`news:title`"), F.col("`image:image`.`image:title`"))
    date = F.coalesce("pubDate", "published", F.col("`dc:date`"), "updated", F.col("`news:news`.`news:publication_date`"))
    rows = raw.select(
        T.clean_html(title).alias("title"), T.strip(link).alias("url"), date.alias("published"),
        T.shorten(T.clean_html(F.coalesce("description", "summary", F.col("`content:encoded`")))).alias("description"), F.col("lastmod"), F.lit(outlet).alias("outlet"),
    )
    path_of = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    skip = F.lit(False)
    for prefix in excluded:
        skip = skip | path_of.startswith(prefix)
    return rows.where(~T.is_null_token(F.col("title")) & ~T.is_null_token(F.col("url"))).withColumn("excluded", skip).withColumn("published_ts", T.utc_time(F.col("published")))


def language(spark: SparkSession, path: str, default: str) -> str:
    """The language a feed states of itself: its channel's element, else the attribute of its root, else `default`."""
    said = spark.read.format("xml").option("rowTag", "channel").schema("language string").load(path).where("trim(language) <> ''").first()
    if said:
        return said["language"].strip()
    for root in ("rss", "feed", "rdf:RDF"):
        own = spark.read.format("xml").option("rowTag", root).schema("`_xml:lang` string").load(path).where("`_xml:lang` <> ''").first()
        if own:
            return own[0]
    return default


def sitemap(spark: SparkSession, path: str, outlet: str, excluded: tuple[str, ...] = (), month: str | None = None) -> DataFrame:
    """feed() of a sitemap; an address without a date takes its lastmod, in `month` (yyyy-mm, a day to either side) if given.

    `from_lastmod` marks such dates. An index of sitemaps is an error: its children are what to read.
    """
    if spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).where("loc is not null").first():
        raise ValueError(f"{path} is an index of sitemaps")
    rows = feed(spark, path, outlet, "url", excluded)
    changed = T.utc_time(F.col("lastmod"))
    if month:
        first = F.lit(f"{month}-01").cast("date")
        changed = F.when((changed >= F.date_sub(first, 1).cast("timestamp")) & (changed < F.date_add(F.add_months(first, 1), 1).cast("timestamp")), changed)
    instead = F.col("published_ts").isNull() & changed.isNotNull()
    return rows.withColumn("from_lastmod", instead).withColumn("published_ts", F.coalesce("published_ts", changed))


def months(window: DataFrame, last: int) -> DataFrame:
    """(month) yyyy-mm of the months that a window (start, end), end excluded, touches; the newest `last` of them."""
    final = F.col("end") - F.expr("interval 1 microsecond")
    every = F.sequence(F.trunc("start", "month"), F.trunc(final, "month"), F.expr("interval 1 month"))
    return window.where("start < end").select(F.explode(every).alias("m")).distinct().orderBy(F.desc("m")).limit(last).select(F.date_format("m", "yyyy-MM").alias("month"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer): the latest stored decision of each key; damaged lines count as absent."""
    rows = spark.read.schema("key string, answer double, at timestamp").json(path).where("key is not null and answer is not null")
    return rows.groupBy("key").agg(F.max_by("answer", F.struct("at", "answer")).alias("answer"))


def groups(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, warnings) of a group file: one JSON object a line with group_id and ids; an id belongs to its first group."""
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    j = raw.withColumn("j", F.from_json("value", "group_id string, ids array<string>, topic string"))
    broken = j.where("j.ids is null").select("line", F.lit("invalid").alias("warning"), F.lit(None).cast("string").alias("id"))
    one = j.where("j.ids is not null").select("line", F.col("j.group_id").alias("group_id"), F.col("j.topic").alias("topic"), F.posexplode("j.ids").alias("pos", "id"))
    ids = known.select(F.col("id").cast("string").alias("id")).distinct()
    unknown = one.join(ids, "id", "left_anti").select("line", F.lit("unknown").alias("warning"), "id")
    claimed = one.join(ids, "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("line", "pos")))
    again = claimed.where("n > 1").select("line", F.lit("assigned").alias("warning"), "id")
    return claimed.where("n = 1").drop("n"), broken.union(unknown).union(again)


def labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A label file with either , or ; between cells."""
    first = spark.read.text(path).limit(1).first()
    sep = ";" if first and first[0].count(";") > first[0].count(",") else ","
    return contract_csv(spark, path, columns, sep)


def junit(spark: SparkSession, path: str) -> DataFrame:
    """(name, outcome) of the test cases of a report."""
    raw = spark.read.format("xml").option("rowTag", "testcase").schema("_classname string, _name string, failure string, error string, skipped string").load(path)
    outcome = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return raw.select(F.concat_ws("::", "_classname", "_name").alias("name"), outcome.alias("outcome"))


def hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
