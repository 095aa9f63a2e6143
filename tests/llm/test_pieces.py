"""Backtracking SentencePiece encoding against the library and against merging by definition."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import pieces
from loomwork.llm.pieces import SPACE


@pytest.fixture(scope="module")
def p():
    return pieces.Pieces(pieces.default_model())


def library(p, text):
    return p.library.encode(text, add_eos=True) if text else [p.end]


def same(p, texts):
    for t in texts:
        ids = p.encode(t)
        assert ids == library(p, t), t[:80]
        [back] = p.decode(np.array(ids), np.array([0, len(ids)]))
        assert back == p.library.decode(ids) == t.replace(SPACE, " ")


def test_runs_of_spaces_and_strings_of_control_pieces(p):
    same(p, [" " * k for k in range(80)] + ["a" + " " * k + "b" for k in range(40)])
    same(p, ["<s></s><unk> <0x0A>", SPACE + "x", "\x00\n\r\n\t", "日本語 😀 á ﬁ ​　", "x" * 3000, "͸\U0010fffd é"])


def test_pieces_put_together(p):
    r = random.Random(1)
    known = [t for t in p.text.values()]
    same(p, ["".join(r.choice(known) for _ in range(r.randint(1, 12))).replace(SPACE, " ") for _ in range(4000)])
    same(p, ["".join(r.choice("aehotnrsi") for _ in range(r.randint(0, 80))) for _ in range(2000)])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60).filter(lambda t: t.isprintable() or "\n" in t))
def test_any_text(text):
    same(pieces.pieces(pieces.default_model()), [text])


def test_backtracking_equals_merging(p):
    r = random.Random(2)
    for _ in range(2000):
        t = SPACE + "".join(r.choice("thesandio'.,") for _ in range(r.randint(1, 40)))
        assert [p.text[i] for i in p.backtrack(t)] == p.merge(t)


def test_windows_of_a_long_text(p, monkeypatch):
    r = random.Random(3)
    words = ["the", "over", "ünder", "\n", "don't", "  ", "日本"]
    long = " ".join(r.choice(words) for _ in range(5000))
    want = library(p, long)
    for window in (1, 7, 1000):
        monkeypatch.setattr(pieces, "WINDOW", window)
        assert p.encode(long) == want
    monkeypatch.setattr(pieces, "CACHE", 3)
    assert p.encode(long) == p.encode(long) == want


def test_long_texts_without_a_place_to_cut(p):
    r = random.Random(4)
    same(p, ["a" * 200_000, " " * 200_000, "x\n" * 100_000, "".join(r.choice("aehotnrsi") for _ in range(200_000))])


def test_bytes_that_are_no_text_and_the_unknown_piece(p):
    cases = [[p.byte[0xE6], p.byte[0x97], 264, p.end], [p.unknown, 264], [1, 264, p.end], [p.end], [], [p.byte[0xFF]], [259, 264]]
    flat = np.array([i for c in cases for i in c], dtype=np.int64)
    assert p.decode(flat, np.cumsum([0, *map(len, cases)])) == [p.library.decode(c) for c in cases]


def test_operators_on_awkward_rows(spark, awkward, nothing, p):
    more = awkward.selectExpr("*", "'x' AS IDS", "1 AS decoded", "2 AS size")
    got = pieces.decode(pieces.encode(more))
    assert sorted(got.columns) == sorted([*awkward.columns, "size", "ids", "decoded"])
    rows = got.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["ids"] == library(p, r["text"] or "") and r["decoded"] == (r["text"] or "") and r["size"] == 2
    assert pieces.decode(pieces.encode(nothing)).count() == 0
    assert [r["decoded"] for r in pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == [None, ""]


def test_query_equals_the_library(spark, p):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op11_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        ids = library(p, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(p.library.decode(ids)))
