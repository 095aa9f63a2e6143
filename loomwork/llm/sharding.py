"""Balanced label propagation: documents with equal texts move together under exact row quotas.

Links join documents with equal texts. Such a group is a clique, so all its members in one shard see the same
neighbours, and the propagation runs on counted rows (group, shard, documents): a group of any size is at most as
many rows as there are shards. Documents without links have no edges to cut; they fill the room that is left.

Start: linked documents dealt round-robin over the shards. Each round, every (group, shard) row asks to move to
the shard where most of its group is (the label most neighbours carry). The demand between two shards is admitted
as far as it is matched by demand the other way or the receiving shard has room under its quota; the quotas are
joined to the requests, which are admitted by gain (neighbours met) through prefix sums over counted cells, the
last one in part. It ends when nobody asks, nothing moves, or no more links come to lie within shards. Loads never pass a shard's quota, so the final
counts are equal up to one row (law `rows`), exactly.

Everything is DataFrame operations; only the shards' loads and demands (shards squared numbers) reach the driver.

Defined cases: null text has no bytes, size 1, checksum 0, and is linked to other null texts; empty texts are
linked to each other; a null doc_id is placed like any other row; repeated rows are linked copies, one slot each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import discard, materialize, prefix_offsets, ranked, table

GROUP = ["g", "text_crc32", "size"]
ROWS_A_CELL = 20_000


def _global_prefix(df: DataFrame, part: list[str], order: list, bucket, amount: str, out: str) -> DataFrame:
    """Sum of `amount` over the rows before, within part, by (bucket, order); buckets are summed before they meet."""
    keyed = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*part, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    sums = df.withColumn("_b", bucket).groupBy(*part, "_b").agg(F.sum(amount).alias("_n"))
    whole = part or [F.lit(1)]
    sums = prefix_offsets(sums, whole, ["_b"], "_n", "_off").drop("_n")
    return keyed.join(sums, [*part, "_b"]).withColumn(out, (F.col("_off") + F.col("_in")).cast("long")).drop("_b", "_in", "_off")


def quotas(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Documents that may move from shard s to p: what p sends back to s, and then a fair part of p's room."""
    out = {(s, p): min(d, demand.get((p, s), 0)) for (s, p), d in demand.items()}
    for p, free in enumerate(room):
        rest = {s: d - out[s, q] for (s, q), d in demand.items() if q == p and d > out[s, q]}
        free, total = min(free, sum(rest.values())), sum(rest.values())
        for s in sorted(rest):
            own = min(rest[s], -(-free * rest[s] // total)) if total else 0
            total -= rest[s]
            out[s, p] += own
            free -= own
    return {k: v for k, v in out.items() if v > 0}


def propagate(linked: DataFrame, caps: list[int], cells: int, rounds: int | None = None) -> DataFrame:
    """Rows (group, s, n): how many documents of each linked group (group, n) go to shard s; loads stay under caps.

    Rounds go on until none brings more linked documents together (the links within shards, a whole number under a
    fixed bound, rise with every round that counts), or for `rounds` of them.
    """
    spark, k = linked.sparkSession, len(caps)
    bucket = F.pmod("g", F.lit(cells))
    start = _global_prefix(linked, [], GROUP, bucket, "n", "off")
    shard = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    share = F.floor((F.col("off") + F.col("n") - 1 - F.col("s")) / k) - F.floor((F.col("off") - 1 - F.col("s")) / k)
    state = materialize(start.withColumn("s", shard).select(*GROUP, "s", share.cast("long").alias("n")).where("n > 0"), "labels")
    # decimals: a group of a third of all rows has more links than a long counts
    together = lambda t: t.agg(F.coalesce(F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")), F.lit(0))).first()[0]
    links, done = together(state), 0
    while rounds is None or done < rounds:
        done += 1
        load = dict(state.groupBy("s").agg(F.sum("n")).collect())
        label = F.struct("n", F.pmod(F.xxhash64("g", "s"), F.lit(1 << 20)).alias("tie"), "s")
        best = F.max(label).over(Window.partitionBy(*GROUP))
        asked = state.withColumn("best", best).select(*GROUP, "s", "n", F.col("best.s").alias("p"), F.col("best.n").alias("gain"))
        asks = asked.where("s <> p")
        demand = {(r[0], r[1]): r[2] for r in asks.groupBy("s", "p").agg(F.sum("n")).collect()}
        admitted = quotas(demand, [caps[p] - load.get(p, 0) for p in range(k)])
        if not admitted:
            break
        rows = ", ".join(f"({s}, {p}, {q}L)" for (s, p), q in admitted.items())
        allowed = spark.sql(f"SELECT * FROM VALUES {rows} AS t(s, p, quota)")
        level = -F.floor(4 * F.log2("gain"))
        asks = asks.join(F.broadcast(allowed), ["s", "p"]).withColumn("lv", level)
        order = _global_prefix(asks, ["s", "p"], [F.desc("gain"), *GROUP], (F.col("lv") * cells + bucket).cast("long"), "n", "before")
        moves = order.select(*GROUP, "s", "p", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before"))).cast("long").alias("moved")).where("moved > 0")
        moves = materialize(moves, "moves")
        change = state.unionByName(moves.select(*GROUP, "s", (-F.col("moved")).alias("n"))).unionByName(moves.select(*GROUP, F.col("p").alias("s"), F.col("moved").alias("n")))
        new = materialize(change.groupBy(*GROUP, "s").agg(F.sum("n").alias("n")).where("n > 0"), "labels")
        discard(moves)
        if (more := together(new)) <= links:
            discard(new)
            break
        discard(state)
        state, links = new, more
    return state


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text)."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("g"),
    )
    slim = materialize(slim, "slim")
    n = slim.count()
    cells = max(1, n // ROWS_A_CELL)
    caps = [n // shards + (s < n % shards) for s in range(shards)]
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    parts = materialize(salted.groupBy(*GROUP, "salt").agg(F.count(F.lit(1)).alias("n")), "cells")
    groups = materialize(parts.groupBy(*GROUP).agg(F.sum("n").alias("n")), "equal")

    state = propagate(groups.where("n > 1"), caps, cells)
    load = dict(state.groupBy("s").agg(F.sum("n")).collect())
    ends = state.withColumn("hi", F.sum("n").over(Window.partitionBy(*GROUP).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("hi", "s"))).alias("ends"))
    free = _global_prefix(groups.where("n = 1"), [], GROUP, F.pmod("g", F.lit(cells)), "n", "at")
    to, upto = F.lit(shards - 1), 0
    edges = []
    for s in range(shards):
        upto += caps[s] - load.get(s, 0)
        edges.append((upto, s))
    for upto, s in reversed(edges[:-1]):
        to = F.when(F.col("at") < upto, F.lit(s)).otherwise(to)
    alone = free.select(*GROUP, F.array(F.struct(F.lit(1).cast("long").alias("hi"), to.cast("int").alias("s"))).alias("ends"))
    plan = materialize(ends.unionByName(alone), "plan")

    places = prefix_offsets(parts, GROUP, ["salt"], "n", "off").drop("n").join(plan, GROUP)
    inner = F.row_number().over(Window.partitionBy(*GROUP, "salt").orderBy("doc_id")) - 1
    at = salted.withColumn("_in", inner).join(places, [*GROUP, "salt"])
    where = F.filter("ends", lambda e: e["hi"] > F.col("off") + F.col("_in"))[0]["s"]
    dealt = at.select("doc_id", "size", "text_crc32", where.cast("int").alias("shard")).withColumn("span", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    slots = ranked(materialize(dealt, "dealt"), ["shard"], ["span"], [F.col("doc_id"), F.col("text_crc32")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLE: dict[str, str] = {}
