"""Shared-storage, ranking and graph helpers of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word pattern of the contracts: runs of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="loomwork-")
    return "file://" + _own_dir[app]


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomwork/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs that run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of a batch that a Python worker is sent, and that the JVM holds outside its heap meanwhile; bytes of a written
#: table that a task holds until it writes them.
BATCH, ROW_GROUP = "4m", 16 << 20


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The table goes by discard(), or else when the driver's JVM ends.
    """
    path = table_path(df.sparkSession, label)
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    fs, p = _at(df.sparkSession, path)
    fs.deleteOnExit(p)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomwork_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing will read again."""
    for df in frames:
        path = getattr(df, "_loomwork_path", None)
        if path:
            drop_path(df.sparkSession, path)


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(kernel: Kernel) -> Kernel:
    """A kernel that gives the memory it no longer uses back to the system at the end of its task: workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a GNU extension
            if trim:
                trim(0)

    return run


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of `taken` (Spark's names are case-insensitive)."""
    used = {t.lower() for t in taken}
    out = []
    for w in wanted:
        while w.lower() in used:
            w += "_"
        used.add(w.lower())
        out.append(w)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_offsets(cells: DataFrame, part: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Adds to pre-aggregated cells the sum of `amount` over the cells that come before, within `part`."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))


def ranked(df: DataFrame, part: list[str], order: list[str], tie: list[Column], out: str = "rank") -> DataFrame:
    """Adds a gapless 0-based rank within `part` by (`order`, `tie`), without bringing a part into one task.

    Rows are numbered within cells (part and order columns; the last order column should be a bucket that
    splits hot values); cells are counted and their counts prefix-summed; both numbers are then added.
    The columns of part and order must not be null.
    """
    cell = part + order
    inner = df.withColumn("_in", F.row_number().over(Window.partitionBy(*cell).orderBy(*tie)) - 1)
    cells = prefix_offsets(df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")), part, order, "_n", "_off").drop("_n")
    return inner.join(cells, cell).withColumn(out, (F.col("_off") + F.col("_in")).cast("long")).drop("_in", "_off")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, root), root the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a few joins and min-aggregations over
    the edges; a node's neighbours are never collected. Every round is written to the shared folder.
    """
    cur = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), label
    )
    while True:
        # done when every node hangs on one root and no root hangs on another
        below = cur.select(F.col("hi").alias("lo"))
        if cur.groupBy("hi").count().where("count > 1").isEmpty() and cur.join(below, "lo", "left_semi").isEmpty():
            break
        sym = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi")
        large = materialize(large, label)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("a"), F.col("lo").alias("b")).union(least.select(F.col("m").alias("a"), F.col("hi").alias("b")))
        small = materialize(small.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), label)
        discard(cur, large)
        cur = small
    roots = cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
