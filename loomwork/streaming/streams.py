"""Structured Streaming forms of the library's incremental operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from loomwork.operators.shared import folder


def read(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream; a single file is watched by its name within its folder."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    return r.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name.replace('.parquet', '')}*.parquet")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines that sinks.append_log() grows, as a stream; lines that do not parse are null in every column."""
    return spark.readStream.schema(schema).json(path)


def cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """A stream of questions (key, ...) with their cached answer and its origin; `cache` (key, answer) has one row a key."""
    known = cache.select("key", "answer", F.lit(True).alias("_known"))
    return asked.join(known, "key", "left").withColumn("origin", F.when(F.col("_known"), "cache").otherwise("open")).drop("_known")


def tumbling(events: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts per window and key; rows later than `late` behind the newest are not waited for."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    return stamped.withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, time: str, late: str, width: str, slide: str, *by: str) -> DataFrame:
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    return stamped.withWatermark("_t", late).groupBy(F.window("_t", width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, late: str | None, gap: str, key: str) -> DataFrame:
    """Events of a key with gaps of at most `gap`. Without `late` no row is too late, and no session is ever closed."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark("_t", late) if late else stamped
    return stamped.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, time: str, late: str, key: list[str]) -> DataFrame:
    """Rows whose key is new within the watermark."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(key)


def split_late(events: DataFrame, time: str, detected: str, hours: int) -> tuple[DataFrame, DataFrame]:
    """(current, late): rows dated up to `hours` before their detection, and older ones, which are routed and not dropped."""
    age = F.unix_seconds(F.col(detected).cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp"))
    is_late = F.coalesce(age > hours * 3600, F.lit(False))
    return events.where(~is_late), events.where(is_late)


def latest_state(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Current state per key: a keyed store holds the greatest (order, state) and emits on change."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        best = held.get if held.exists else None
        changed = False
        for f in frames:
            row = f.sort_values([order, state]).iloc[-1]
            now = (int(row[order]), str(row[state]))
            if best is None or now > best:
                best, changed = now, True
        held.update(best)
        if changed:
            yield pd.DataFrame({key: [k[0]], order: [best[0]], state: [best[1]]})

    shape = f"{key} long, {order} long, {state} string"
    return events.groupBy(key).applyInPandasWithState(update, shape, f"{order} long, {state} string", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its rows as a table in the shared folder.

    In update mode only the last row of a key counts, in complete mode the last result.
    """
    spark = stream.sparkSession
    out = f"{folder(spark)}/loomwork/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{out}/rows").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, epoch: df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{out}/rows")).start()
    query.awaitTermination()
    fields = list(stream.schema.fields)
    if mode == "append":
        return spark.read.schema(StructType(fields)).parquet(f"{out}/rows")
    rows = spark.read.schema(StructType([*fields, StructField("_epoch", LongType())])).parquet(f"{out}/rows")
    if mode == "complete":
        last = rows.agg(F.max("_epoch").alias("_epoch"))
        return rows.join(F.broadcast(last), "_epoch").drop("_epoch")
    rest = [f.name for f in fields if f.name not in key]
    return rows.groupBy(*key).agg(F.max(F.struct("_epoch", *rest)).alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest])
