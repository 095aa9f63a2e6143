"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomwork-")
    return _own[app]


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there. It goes by drop(), or with the driver's JVM."""
    path = f"{folder(df.sparkSession)}/loomwork/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _at(df.sparkSession, path)
    fs.deleteOnExit(p)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def in_small_batches(df: DataFrame, most: str = "8m") -> DataFrame:
    """A table of written(), read by a session of its own that has the caller's settings and gives Python batches of about `most`
    bytes, or of one row: rows that hold whole blocks are not gathered to larger batches."""
    own = df.sparkSession.newSession()
    for k, v in df.sparkSession.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    out = own.read.schema(df.schema).parquet(df._shared_path)
    out._shared_path = df._shared_path
    return out


def near(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, broadcast to a join while it has at most `most` rows, which are counted: few keys then deal nobody's rows to few tasks."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads again."""
    for df in frames:
        if path := getattr(df, "_shared_path", None):
            fs, p = _at(df.sparkSession, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)
