"""Writers: tables, rejects, reports, logs, keyed current state, redacted packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; an existing table is kept unless overwriting is asked for."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def rejects(validated: DataFrame, path: str, file: str, key: str) -> None:
    """One JSON line a rejected row: file, line, id, reasons and the raw row."""
    raw = F.to_json(F.struct(*[c for c in validated.columns if c not in ("reasons", "line")]))
    validated.where(F.size("reasons") > 0).select(F.lit(file).alias("file"), "line", F.col(key).alias("id"), "reasons", raw.alias("raw")).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Events appended by the job's committer, so that failed tasks leave nothing."""
    df.write.mode("append").json(path)


def store_decisions(df: DataFrame, path: str) -> None:
    """Decisions (key, answer, at) appended to a store that readers.decisions() reads; the committer leaves no halves."""
    df.select("key", "answer", "at").write.mode("append").json(path)


def upsert(current: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """The next version of a keyed table: new rows replace those of their key; the old version stays as it is."""
    kept = current.join(new.select(key), key, "left_anti")
    kept.unionByName(new).write.mode("errorifexists").parquet(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def redacted(df: DataFrame, columns: tuple[str, ...], raw: str | None = None) -> DataFrame:
    """Without the columns, and without their keys in a raw map."""
    out = df.drop(*columns)
    return out.withColumn(raw, F.map_filter(raw, lambda k, v: ~k.isin(*columns))) if raw else out


def source_counts(df: DataFrame) -> DataFrame:
    """(source, outlets): rows by outlet within each source, as a map."""
    two = df.groupBy("source", "outlet").agg(F.count(F.lit(1)).alias("n"))
    return two.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outlet", "n")))).alias("outlets"))
