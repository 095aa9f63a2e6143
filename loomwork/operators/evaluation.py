"""Answers with gates and abstention, checks of decisions, and the measures of an evaluation as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.operators import analytics as A


def answers(top: DataFrame, decided: DataFrame, corpus: DataFrame, yes: float = 0.6, least_coverage: float = 0.6) -> DataFrame:
    """(query, outcome, path, n_cited, best, n_corpus, n_outlets): an answer, or a record of why there is none.

    top: ranked rows (query, rank, doc, cosine, lexical, coverage). Questions that pass the two gates of abstention() are
    answered by the documents that the decision layer, decided (query, doc, p), holds for relevant; a question of
    which it decided nothing falls back on lexical coverage. corpus: (doc, outlet).
    """
    gates = A.abstention(top)
    open_ = top.join(gates.where("decision = 'answer'").select("query"), "query", "left_semi")
    met = open_.join(decided, ["query", "doc"], "left")
    asked = met.groupBy("query").agg((F.count("p") > 0).alias("by_decision"))
    met = met.join(asked, "query").withColumn("ok", F.when(F.col("by_decision"), F.coalesce(F.col("p") >= yes, F.lit(False))).otherwise(F.col("coverage") >= least_coverage))
    found = met.groupBy("query").agg(F.bool_or("by_decision").alias("by_decision"), F.count_if("ok").alias("n_cited"), F.min(F.when(F.col("ok"), F.struct("rank", "doc"))).alias("best"))
    x = gates.join(found, "query", "left")
    outcome = F.when(F.col("decision") != "answer", F.col("decision")).when(F.col("n_cited") > 0, "answer").otherwise("no_evidence")
    path = F.when(F.col("decision") != "answer", "gate").when(F.col("by_decision"), "decision").otherwise("lexical")
    size = corpus.agg(F.count(F.lit(1)).alias("n_corpus"), F.count_distinct("outlet").alias("n_outlets"))
    return x.join(F.broadcast(size)).select("query", outcome.alias("outcome"), path.alias("path"), F.coalesce("n_cited", F.lit(0)).alias("n_cited"), F.col("best.doc").alias("best"), "n_corpus", "n_outlets")


def compared(runs: dict[str, DataFrame]) -> DataFrame:
    """Runs of several methods (query, rank, doc) as one table with a column `method`."""
    out = None
    for name, run in runs.items():
        one = run.select(F.lit(name).alias("method"), "query", "rank", "doc")
        out = one if out is None else out.unionByName(one)
    return out


def answer_problems(questions: DataFrame, given: DataFrame) -> DataFrame:
    """(id, problems): codes of what is wrong with the answers given to questions, in a fixed order; [] if nothing is.

    questions: (id, kind, options array<string>, levels int), kind choice, score or yes_no. given: (id, value string).
    Codes: missing, type, unknown_option, range, and extra for answers that nobody asked for.
    """
    q = questions.withColumn("asked", F.lit(True)).join(given.withColumn("has", F.lit(True)), "id", "full_outer")
    kind, value, number = F.col("kind"), F.col("value"), F.col("value").try_cast("double")
    whole = F.coalesce(number == F.floor(number), F.lit(False))
    missing = F.col("asked") & (F.col("has").isNull() | value.isNull())
    typed = F.when(kind == "choice", F.lit(True)).when(kind == "score", whole).otherwise(number.isNotNull() & ~F.isnan(number))
    rules = {
        "missing": missing, "type": F.col("asked") & ~missing & ~typed, "unknown_option": ~missing & (kind == "choice") & ~F.array_contains("options", value),
        "range": ~missing & typed & (((kind == "score") & ~number.between(0, F.col("levels") - 1)) | ((kind == "yes_no") & ~number.between(0, 1))), "extra": F.col("asked").isNull(),
    }
    return q.select("id", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda p: p.isNotNull()).alias("problems"))


def answer_schema(questions: dict[str, tuple[str, ...] | int | None]) -> dict:
    """The JSON schema of answers to questions by id: options of a choice, a number of levels of a score, or None for yes or no."""
    rules = {}
    for key, allowed in questions.items():
        match allowed:
            case None:
                rules[key] = {"type": "boolean"}
            case int(levels):
                rules[key] = {"type": "integer", "enum": [*range(levels)]}
            case options:
                rules[key] = {"type": "string", "enum": [*options]}
    return {"type": "object", "properties": rules, "required": [*rules], "additionalProperties": False}


def chosen_topics(by_words: DataFrame, decided: DataFrame) -> DataFrame:
    """(key, topic, method, confidence, fallback): the decided topic, else that of the keywords and why.

    by_words: (key, topic). decided: (key, option, confidence, reason), one row for each key that was asked; a null
    option is an abstention, whose reason is `no_answer` where none is given. Keys that were not asked have no reason.
    """
    x = by_words.join(decided.withColumn("asked", F.lit(True)), "key", "left")
    given = F.col("option").isNotNull()
    return x.select(
        "key", F.coalesce("option", "topic").alias("topic"), F.when(given, "decision").otherwise("words").alias("method"), F.when(given, F.col("confidence")).alias("confidence"),
        F.when(~given & F.col("asked"), F.coalesce("reason", F.lit("no_answer"))).alias("fallback"),
    )


def decision_summary(chosen: DataFrame, reasons: int = 5) -> DataFrame:
    """(part, value, n, cost): rows and cost by topic and by method, and the commonest reasons of fallbacks."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("value")) for p, c in (("topic", "topic"), ("method", "method"), ("fallback", "fallback"))])
    g = chosen.select(F.explode(parts).alias("p"), "cost").where("p.value is not null").groupBy("p.part", "p.value").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    order = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "value"))
    return g.withColumn("_i", order).where((F.col("part") != "fallback") | (F.col("_i") <= reasons)).drop("_i")


def call_measures(calls: DataFrame) -> DataFrame:
    """(task, n, n_failed, median, mean, attempts, cost) of logged calls (task, ok, latency, attempts, cost); latencies of good ones only."""
    good = F.when(F.col("ok"), F.col("latency"))
    return calls.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("n_failed"), F.round(F.median(good), 6).alias("median"), F.round(F.avg(good), 6).alias("mean"),
        F.sum("attempts").alias("attempts"), F.sum("cost").alias("cost"),
    )


def normalised(level: Column, levels: Column) -> Column:
    """A score's level as a share of the highest, within 0 and 1."""
    return F.when(levels > 1, F.least(F.greatest(level / (levels - 1), F.lit(0.0)), F.lit(1.0)))


def nearest_level(share: Column, levels: Column) -> Column:
    """The level nearest to a share; halves go to the even one."""
    return F.rint(share * (levels - 1)).cast("int")


def measures(df: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(measure, n, of, share, low, high): for each measure how many of which rows, with the 95 % Wilson interval; one pass."""
    one = df.agg(*[F.count_if(c).alias(f"{k}_{i}") for k, pair in parts.items() for i, c in enumerate((pair[0] & pair[1], pair[1]))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"{k}_0").alias("n"), F.col(f"{k}_1").alias("of")) for k in parts])))
    low, high = N.wilson(F.col("n"), F.col("of"))
    return rows.select("measure", "n", "of", F.round(N.ratio(F.col("n"), F.col("of")), 4).alias("share"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def abstention_measures(runs: DataFrame) -> DataFrame:
    """Measures of runs (answerable, hard, answered, hit): rejections that were right, answers withheld, evidence found."""
    can, answered = F.col("answerable"), F.col("answered")
    return measures(runs, {"correct_abstention": (~answered, ~can), "hard_rejected": (~answered, ~can & F.col("hard")), "wrong_abstention": (~answered, can), "evidence_cited": (answered & F.col("hit"), can)})


def support_measures(human: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Human labels (case, claim, supported) against machine verdicts (case, claim, verdict): support, and agreement where both judge."""
    x = human.join(verdicts, ["case", "claim"], "left")
    both = F.col("supported").isNotNull() & F.coalesce(F.col("verdict").isin("supported", "unsupported"), F.lit(False))
    return measures(x, {"supported": (F.col("supported"), F.col("supported").isNotNull()), "agreement": (F.col("supported") == (F.col("verdict") == "supported"), both)})


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """(n, same, share) of two classifiers' labels on the keys that both have."""
    x = a.join(b.select(key, F.col(label).alias("other")), key)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col("other")).alias("same"), F.round(F.avg((F.col(label) == F.col("other")).cast("int")), 6).alias("share"))


def time_saving(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(mode, n, median, saving) of completed rows (mode, minutes text with a point or a comma, done); saving against `base`."""
    minutes = F.replace("minutes", F.lit(","), F.lit(".")).try_cast("double")
    g = rows.where("done").withColumn("m", minutes).where("m is not null").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.median("m").alias("median"))
    first = g.where(F.col("mode") == base).select(F.col("median").alias("base"))
    saving = F.when((F.col("mode") == other) & (F.col("base") > 0), F.round(1 - F.col("median") / F.col("base"), 6))
    return g.join(F.broadcast(first), F.lit(True), "left").select("mode", "n", F.round("median", 6).alias("median"), saving.alias("saving"))


def catalogue(valid: DataFrame, rejected: DataFrame, documented: DataFrame) -> DataFrame:
    """One row an origin: documented or not, rows, outlets, dates, and what was excluded with its reasons.

    valid: (origin, outlet, at), rejected: (origin, reason), documented: (origin); a null origin is an origin.
    """
    rows = valid.groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("outlet").alias("n_outlets"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("at").isNull()).alias("n_undated"))
    gone = rejected.groupBy("origin", "reason").agg(F.count(F.lit(1)).alias("n"))
    gone = gone.groupBy("origin").agg(F.sum("n").alias("n_excluded"), F.array_join(F.array_sort(F.collect_list(F.concat("reason", F.lit("="), F.col("n").cast("string")))), " ").alias("reasons"))
    known = documented.select("origin").distinct().withColumn("documented", F.lit(True))
    # parts of an origin's row meet in one grouping, which keeps a null origin where a join would lose it
    parts = rows.unionByName(gone, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    zero = ("n_rows", "n_outlets", "n_undated", "n_excluded")
    each = [F.coalesce(F.max(c), F.lit(0)).alias(c) if c in zero else F.max(c).alias(c) for c in parts.columns if c not in ("origin", "documented")]
    return parts.groupBy("origin").agg(*each, F.coalesce(F.bool_or("documented"), F.lit(False)).alias("documented"))


def subset_coverage(df: DataFrame, day: str, outlet: str, least: int) -> DataFrame:
    """(outlet, n, n_days, enough): how a subset covers outlets and days, against a least number of items an outlet."""
    g = df.groupBy(outlet).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("n_days"))
    return g.select(outlet, "n", "n_days", (F.col("n") >= least).alias("enough"))


def window_counts(df: DataFrame, at: Column, start: Column, end: Column) -> DataFrame:
    """(kept, outside, undated) of a half-open time window; undated rows are counted apart."""
    inside = (at >= start) & (at < end)
    return df.agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("outside"), F.count_if(at.isNull()).alias("undated"))


def evidence_by_id(wanted: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """(id, kind, found, detail) of ids `prefix:key`, looked up in the table of their prefix (key, detail): an equi-join each."""
    split = wanted.select("id", F.substring_index("id", ":", 1).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("key"))
    both = None
    for name, t in kinds.items():
        one = t.select(F.lit(name).alias("kind"), F.col("key").cast("string").alias("key"), "detail")
        both = one if both is None else both.unionByName(one)
    x = split.join(both, ["kind", "key"], "left")
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("unknown")
    return x.select("id", kind.alias("kind"), F.col("detail").isNotNull().alias("found"), "detail")
