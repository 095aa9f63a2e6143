"""Relational building blocks: validation, deduplication, merging, links, samples, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import is_null_token


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `reasons`: the codes of all rules that a row breaks (a rule is the condition of a failure)."""
    return df.withColumn("reasons", F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]), lambda x: x.isNotNull()))


def validate(df: DataFrame, rules: dict[str, Column], key: list[str], ordinal: Column, window: Column | None = None) -> DataFrame:
    """Field rules first, then the time window, then duplicates of the key; only rows accepted so far claim a key."""
    out = with_reasons(df, rules)
    if window is not None:
        out = out.withColumn("reasons", F.when((F.size("reasons") == 0) & ~window, F.array(F.lit("outside_window"))).otherwise(F.col("reasons")))
    order = F.row_number().over(Window.partitionBy(*key, F.size("reasons") == 0).orderBy(ordinal))
    return out.withColumn("_n", order).withColumn("reasons", F.when((F.size("reasons") == 0) & (F.col("_n") > 1), F.array(F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("_n")


def quality_report(validated: DataFrame) -> DataFrame:
    """(reason, rows) with `read`, `valid` and `rejected` totals among the reasons; one pass."""
    ok = F.size("reasons") == 0
    each = validated.select(F.explode(F.array_union(F.col("reasons"), F.array(F.lit("read"), F.when(ok, F.lit("valid")).otherwise(F.lit("rejected"))))).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def in_window(date: Column, start: Column, end: Column) -> Column:
    """Half open; rows without a date pass."""
    return date.isNull() | ((date >= start) & (date < end))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null) by null token, from one aggregate."""
    one = df.agg(*[F.count_if(is_null_token(F.col(c).cast("string"))).alias(c) for c in columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("column", "n_null"))


def first_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the limit is applied before the shuffle too."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def latest_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_x"))
    return best.select(*key, *[F.col(f"_x.{c}").alias(c) for c in [*order, *rest]])


def merge_by_key(df: DataFrame, key: str, principal: list[Column], ordinal: str, fill: list[str], keep: list[str]) -> DataFrame:
    """One row a key: `keep` of the principal row, `fill` from the first row that has it, and what was merged."""
    order = F.struct(*principal, F.col(ordinal))
    aggs = [F.min_by(F.col(c), order).alias(c) for c in keep]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in fill]
    return df.groupBy(key).agg(*aggs, (F.count(F.lit(1)) - 1).alias("n_merged"))


def zero_filled(counts: DataFrame, domain: DataFrame, key: list[str], value: str) -> DataFrame:
    """Every key of the domain, with 0 where nothing was counted."""
    return domain.join(counts, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def complete_grid(values: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """All (row, column) cells; missing ones stay null. Both domains are small tables of distinct keys."""
    return rows.crossJoin(columns).join(values, rows.columns + columns.columns, "left")


def interval_join(left: DataFrame, right: DataFrame, at: str, when: str, before: int, after: int) -> DataFrame:
    """Pairs with right.when in [left.at - before, left.at + after] hours, both ends in; an equi-join on time buckets.

    A right row lies in one bucket, and a left row asks the few that its interval touches, so no pair comes twice.
    """
    width = (before + after) * 3600
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    low, high = second(at) - before * 3600, second(at) + after * 3600
    asked = left.where(F.col(at).isNotNull()).withColumn("_b", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    held = right.withColumn("_b", F.floor(second(when) / width))
    near = (F.unix_micros(F.col(when).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))).between(-before * 3_600_000_000, after * 3_600_000_000)
    return asked.join(held, "_b").where(near).drop("_b")


def interval_strongest(left: DataFrame, right: DataFrame, key: str, at: str, when: str, before: int, after: int, order: Column) -> DataFrame:
    """(key, n, best): how many pairs interval_join has for a key, and the smallest `order` (a struct) among them; no pair is made.

    Right rows are counted in time blocks of 16^0 to 16^9 microseconds. An interval is cut into at most 30 blocks a
    level, once for each distinct left.at, so the work grows with the rows of either side and not with their product.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hour, top = 3_600_000_000, 0
    while 16 ** (top + 1) <= (before + after) * hour + 1:
        top += 1
    events = right.where(F.col(when).isNotNull()).groupBy(micros(when).alias("_us")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    blocks = events.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_b", F.expr("shiftright(_us, 4 * _lv)"))
    blocks = blocks.groupBy("_lv", "_b").agg(F.sum("_n").alias("_n"), F.min("_o").alias("_o"))
    times = left.where(F.col(at).isNotNull()).select(micros(at).alias("_at")).distinct()
    # the interval as blocks [low, high) of each level; the next level takes what of them fills whole blocks
    low = [F.shiftright(F.col("_at") - before * hour + 16**k - 1, 4 * k) for k in range(top + 2)]
    high = [F.shiftright(F.col("_at") + after * hour + 1, 4 * k) for k in range(top + 2)]
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    parts = []
    for k in range(top + 1):
        inner = low[k + 1] < high[k + 1]
        own = F.when(inner, F.concat(span(low[k], low[k + 1] * 16), span(high[k + 1] * 16, high[k]))).otherwise(span(low[k], high[k]))
        parts.append(F.struct(F.lit(k).alias("_lv"), own.alias("_bs")))
    asked = times.select("_at", F.inline(F.array(*parts))).select("_at", "_lv", F.explode("_bs").alias("_b"))
    found = asked.join(blocks, ["_lv", "_b"]).groupBy("_at").agg(F.sum("_n").alias("_n"), F.min("_o").alias("_o"))
    each = left.withColumn("_at", micros(at)).join(found, "_at")
    return each.groupBy(key).agg(F.sum("_n").alias("n"), F.min("_o").alias("best"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, when: str, value: str) -> DataFrame:
    """Adds the right table's latest `value` at or before each left row's time, by one window over both tables."""
    a = left.select(key, F.col(at).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_row"))
    b = right.select(key, F.col(when).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_s"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_s = 1")
    return both.select("_row.*", F.col("_last").alias(value))


def round_robin(df: DataFrame, day: str, outlet: str, time: str, key: str, n: int) -> DataFrame:
    """Day-balanced sample: one item a day and round, newest day first; within a day outlets take turns, larger first."""
    recent = [F.desc(time), F.desc(key)]
    r = F.row_number().over(Window.partitionBy(day, outlet).orderBy(*recent))
    p = F.row_number().over(Window.partitionBy(day).orderBy(*recent))
    x = df.withColumn("_r", r).withColumn("_p", p)
    own = Window.partitionBy(day, outlet)
    x = x.withColumn("_c", F.count(F.lit(1)).over(own)).withColumn("_f", F.min("_p").over(own))
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy(day).orderBy("_r", F.desc("_c"), "_f")))
    return x.orderBy("turn", F.desc(day)).limit(n).drop("_r", "_p", "_c", "_f")


def stratified_rounds(df: DataFrame, stratum: str, key: str, seed: int, per: int) -> DataFrame:
    """`per` items of each stratum in hash order; round k holds the k-th of every stratum."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key)
    return df.withColumn("round", F.row_number().over(order)).where(F.col("round") <= per)


def mode_first_seen(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def integrity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, status): ok, different, absent or undeclared, from two tables (name, sha256)."""
    e, f = expected.withColumnRenamed("sha256", "_e"), found.withColumnRenamed("sha256", "_f")
    status = F.when(F.col("_f").isNull(), "absent").when(F.col("_e").isNull(), "undeclared").when(F.col("_e") == F.col("_f"), "ok").otherwise("different")
    return e.join(f, "name", "full_outer").select("name", status.alias("status"))


def calendar(df: DataFrame, time: str, unit: str) -> DataFrame:
    """Periods from the first to the last date of df, gaps included; two numbers reach the plan, no collect."""
    ends = df.agg(F.date_trunc(unit, F.min(time)).alias("a"), F.date_trunc(unit, F.max(time)).alias("b"))
    step = F.expr(f"interval 1 {unit}")
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b", step)).alias("period"))


def unique_ids(df: DataFrame, key: str, ordinal: str, out: str) -> DataFrame:
    """x, x-2, x-3 for repeated ids, skipping suffixed forms that are ids themselves.

    A free suffix lies within (rows of the id + literal suffixed ids of it), so ranks among free numbers suffice.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    rows = df.withColumn("_n", n)
    size = rows.groupBy(key).agg(F.max("_n").alias("_size"))
    taken = df.select(F.regexp_extract(key, r"^(.*)-(\d+)$", 1).alias("_base"), F.regexp_extract(key, r"^(.*)-(\d+)$", 2).try_cast("int").alias("_k")).where("_k >= 2").distinct()
    load = taken.groupBy("_base").agg(F.count(F.lit(1)).alias("_t"))
    free = size.where("_size > 1").join(load, size[key] == load["_base"], "left").select(key, F.explode(F.sequence(F.lit(2), F.col("_size") + F.coalesce("_t", F.lit(0)))).alias("_k"))
    free = free.join(taken.withColumnRenamed("_base", key), [key, "_k"], "left_anti")
    free = free.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_k")) + 1)
    named = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(key, F.lit("-"), F.col("_k").cast("string")))
    return rows.join(free, [key, "_n"], "left").withColumn(out, named).drop("_n", "_k")
