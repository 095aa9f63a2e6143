"""Columns that have the names of anything the operators use inside."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import html, jaccard, mixing, quality, substring, toxicity
from loomwork.llm._common import free_names

HERE = Path(__file__).resolve().parents[2] / "loomwork" / "llm"
KEPT = {"doc_id", "text", "source", "lang", "n_chars", "html", "page_id", "url"}
RESULTS = {
    "held_out", "score", "predicted", "strongest", "total", "signs", "kept_text", "n_words", "n_removed", "size", "source_size", "target", "copies", "taken",
}


def helper_names(*modules):
    """Every short text of the modules that could be a column's name."""
    found = set()
    for m in modules:
        found |= set(re.findall(r"""["']([A-Za-z_][a-z_0-9]{0,11})["']""", (HERE / f"{m}.py").read_text()))
    return sorted(found - KEPT - RESULTS)


def clashing(df, *modules):
    names = [n for i, n in enumerate(helper_names(*modules)) if n.lower() not in {c.lower() for c in df.columns}]
    seen, out = set(), df
    cols = []
    for n in names:
        if n.lower() not in seen:
            seen.add(n.lower())
            cols.append(F.concat(F.lit(f"{n}:"), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("-"))).alias(n))
    return out.select("*", *cols), [c for c in df.columns], sorted(seen)


CASES = {
    "toxicity": lambda d, lab: toxicity.score(d, lab, keep_text=True), "quality": quality.score, "jaccard": lambda d, lab: jaccard.one_of_each(d),
    "substring": lambda d, lab: substring.dedup(d), "mixing": lambda d, lab: mixing.emit(mixing.mix(d)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_every_helper_name_can_be_a_column(awkward, labels, name):
    d, own, names = clashing(awkward, "_common", name)
    assert len(names) > 5
    got = CASES[name](d, labels)
    lower = {c.lower(): c for c in got.columns}
    rows = got.collect()
    plain = CASES[name](awkward, labels).collect()
    assert len(rows) == len(plain) > 0
    for r in rows:
        at = "-" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[lower[n]] == f"{n}:{at}" or r[lower[n]].lower() == f"{n}:{at}" for n in names if n in lower)
    assert all(n in lower for n in names)
    same = [c for c in plain[0].asDict() if c in lower.values()]
    assert sorted(repr([r[c] for c in same]) for r in rows) == sorted(repr([r[c] for c in same]) for r in plain)


def test_pages_pass_every_helper_name(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>One two three, four five six.</p></article>"), (2, "u", None)], "page_id long, url string, html string")
    d, own, names = clashing(pages, "_common", "html")
    rows = {r["page_id"]: r for r in html.extract(d).collect()}
    want = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in rows.items()} == {i: (r["text"], r["n_chars"]) for i, r in want.items()}
    assert all(rows[1][n].lower() == f"{n}:1" for n in names if n not in ("text", "n_chars"))


def test_stages_pass_extra_columns(spark, awkward, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d, _, names = clashing(awkward, "_common")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, d, str(tmp_path))
        assert got.columns == d.columns and got.count() > 0, name


def test_free_names():
    assert free_names(["a", "_X", "_x_"], "_x", "_x", "b") == ["_x__", "_x___", "b"]
