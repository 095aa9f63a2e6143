import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import html, html_train, mixing, packing, toxicity
from loomwork.llm.bpe import WordBpe

# ---- packing ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(packing.default_tokenizer())


def test_bpe_equals_the_library(bpe, spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " \n", "don't YOU'LL <|endoftext|>x<|startoftext|>", "İΑΣ ﬁ café x\x85y​ £5 \x1c q ２ ª º × ÷ ¿", "a" * 400, "'s''t 'RE 12,34", "日本 語 x", "\x00 \x01"]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids == bpe._whole(t)


def test_cache_turnover_changes_nothing(bpe, monkeypatch):
    import loomwork.llm.bpe as module

    monkeypatch.setattr(module, "CACHE", 3)
    texts = ["alpha beta gamma delta", "epsilon alpha zeta", "beta 日本 eta", "alpha beta 日本"]
    assert [bpe.encode([t])[0] for t in texts * 2] == [bpe._whole(t) for t in texts * 2]


def check_packing(rows, texts, bpe, capacity=4096):
    """rows of pack() against the ids of each text; texts: list of (doc_id, text)."""
    want = defaultdict(int)
    for d, t in texts:
        ids = bpe.encode([t or ""])[0] + (1).to_bytes(4, "little")
        for k in range(0, len(ids), 4 * capacity):
            part = ids[k : k + 4 * capacity]
            want[d, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing_whole_table(spark, bpe):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.op7_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    used = check_packing(rows, [(r["doc_id"], r["text"]) for r in d.collect()], bpe)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_awkward_rows(spark, awkward, nothing, bpe):
    d = awkward.withColumn("bucket", F.lit("clash")).withColumn("rank", F.lit(1))
    check_packing(packing.pack(d, capacity=64).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()], bpe, 64)
    assert packing.pack(nothing).collect() == []


def test_sequences_hold_the_ids(spark, bpe):
    d = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, None)], "doc_id long, text string")
    packed = packing.pack(d, capacity=16)
    out = packing.sequences(d, packed, capacity=16).collect()
    whole = sorted(bpe.encode([t])[0] + (1).to_bytes(4, "little") for t in ("one two three", "four five", ""))
    assert sorted(len(bytes(r["ids"])) for r in out) == sorted([sum(map(len, whole))])
    assert all(w in bytes(out[0]["ids"]) for w in whole)


def fewest(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def check_plan(found, counts, capacity):
    used = defaultdict(int)
    for times, filling in found:
        assert times > 0 and sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            used[x] += times * k
    assert dict(used) == counts
    return sum(t for t, _ in found)


def test_plans_equal_exhaustive_packing():
    r = np.random.default_rng(0)
    hard = [[56, 46, 43, 43, 43, 36, 28, 24, 21, 20, 18, 18]]
    for k in range(300):
        hard.append(sorted(r.integers(*((1, 31), (18, 60), (5, 40), (25, 51))[k % 4], r.integers(1, 13)).tolist(), reverse=True))
    for k, sizes in enumerate(hard):
        capacity = 100 if k % 4 != 1 or not k else 60
        counts = {x: sizes.count(x) for x in sizes}
        found, proved = packing.plan(counts, capacity)
        least = packing.least_sequences(counts, capacity)
        assert check_plan(found, counts, capacity) == fewest(sizes, capacity) >= least and proved


def test_plans_of_many_pieces():
    """Piece counts of corpora; a budget that is spent leaves a whole plan and says that nothing is proved."""
    r = np.random.default_rng(1)
    for low, high, n in ((1, 4097, 3000), (1400, 2100, 500), (700, 1500, 900), (1, 40, 20_000), (1366, 1400, 301)):
        x, c = np.unique(r.integers(low, high, n), return_counts=True)
        counts = dict(zip(x.tolist(), c.tolist(), strict=True))
        found, proved = packing.plan(counts, 4096)
        size = check_plan(found, counts, 4096)
        assert size >= packing.least_sequences(counts, 4096) and (proved or size > packing.least_sequences(counts, 4096))
        some, proved = packing.plan(counts, 4096, nodes=10)
        assert check_plan(some, counts, 4096) >= size
    assert packing.plan({}, 10) == ([], True)


# ---- mixing ----------------------------------------------------------------------------------------------------


def filled(sizes, weights, budget=1.5, limit=2.0):
    """Targets by repeated resharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), budget * sum(sizes.values())
    while open_ and left > 1e-9:
        share, total = left, sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * w[s] / total
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 100}, {"a": 10, "b": 1000, "c": 5, "d": 300, None: 1}, {"a": 7}, {"": 0, "b": 9, None: 0}])
def test_targets_equal_resharing(spark, sizes):
    d = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(d).collect()}
    want = filled(sizes, mixing.WEIGHTS)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mixing_whole_table(spark):
    rows = mixing.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, size, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == 0 and r["taken"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s], most[s] = r["target"], max(most[s], r["size"])
    want = filled(size, mixing.WEIGHTS)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s]) and abs(taken[s] - target[s]) <= 2 * most[s]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op8_mixing(spark, "/root/testdata/sf0.01").collect()))


def test_mixing_awkward_rows(awkward, nothing):
    d = awkward.withColumn("target", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("span", F.lit(1))
    rows = mixing.mix(d).collect()
    assert len(rows) == 17 and mixing.mix(nothing).collect() == []
    out = mixing.emit(mixing.mix(d))
    assert out.count() == sum(r["copies"] for r in rows)
    assert {(r["doc_id"], r["text"], r["source"]) for r in rows} == {(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()}


# ---- pages -----------------------------------------------------------------------------------------------------


def test_blocks_of_broken_pages():
    page = "<head><title>T</title><p>a &amp;amp; b<br>c<p>d <b>e<div>f<script>var x='</p>'</script>g</div><!-- h --><table><tr><td>i<td>j</table><ul><li>k<li>l</ul>m < n<style>o"
    assert [b[1] for b in html.blocks(page)] == ["a &amp; b c", "d e", "fg", "i", "j", "k", "l", "m < n"]
    assert [b[0] for b in html.blocks("<head><meta x><svg><p>q<head><body><p>r")][-1].path() == ("body", "p")
    assert html.blocks("") == [] and html.blocks("<p") == []


def test_unclosed_elements_take_no_longer():
    """Elements without an end are read on as text; 40,000 of them take a second or so, not minutes."""
    import time

    began = time.time()
    for name in ("svg", "object", "canvas", "math"):
        assert [b[1] for b in html.blocks(f"<p>a<{name}>" * 40_000 + "b")][-1] == "ab"
    assert [b[1] for b in html.blocks("<p>a<svg>b</SVG >c<svg>d<object>e</object>f")] == ["ac" + "d" + "f"]
    assert time.time() - began < 20


def test_recurrent_labels_equal_single_pages():
    r = html_train.examples(12, 4)
    m = html.load_model()
    together = html.label([x for x, _ in r], m)
    for (x, _), p in zip(r, together, strict=True):
        assert np.allclose(html.forward(x[:, None], np.array([len(x)]), m)[:, 0], p, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    x, y, sizes = rng.normal(size=(4, 3, html.INPUT)), rng.normal(size=(4, 3, html.HIDDEN)), None
    del sizes
    w, u, b = rng.normal(size=(html.INPUT, 4 * html.HIDDEN)) / 10, rng.normal(size=(html.HIDDEN, 4 * html.HIDDEN)) / 5, np.zeros(4 * html.HIDDEN)
    kept = []
    out = html.lstm(x, w, u, b, kept)
    gw, gu, gb = html_train._back(y, kept, out, x, w, u)
    for g, a in ((gw, w), (gu, u), (gb, b)):
        i = tuple(rng.integers(0, n) for n in a.shape)
        a[i] += 1e-5
        up = (html.lstm(x, w, u, b) * y).sum()
        a[i] -= 2e-5
        down = (html.lstm(x, w, u, b) * y).sum()
        a[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_extraction_on_unseen_layouts_and_the_table(spark):
    assert html_train.accuracy(html.load_model(), 300, 12345) > 0.985
    rows = html.op10_html_extraction(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect()
    right = sum(r["text"] == "\n".join(t for p, t, _ in html.blocks(r["html"]) if "article" in p.path()) and r["n_chars"] == len(r["text"]) for r in rows)
    assert right / len(rows) > 0.99


def test_pages_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><a>x</a></nav>"), (4, "u", "<article><p>" + "word " * 50_000 + "</article>"), (4, "u", "<article><p>" + "word " * 50_000 + "</article>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in html.extract(d).collect()))
    assert got == [(0, 0), (1, 0), (2, 0), (4, 249_999), (4, 249_999)]
    assert html.extract(d.limit(0)).collect() == []


# ---- the pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, bpe):
    from test_dedup import brute, brute_join

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(corpus_pipeline.materialize(stage(spark, outs[-1], sf), name))
    rows = [[r.asDict() for r in o.collect()] for o in outs]
    for o in outs[1:5]:
        assert o.columns == docs.columns
    bad = {r["doc_id"] for r in toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, rows[1])) == sorted(key(r) for r in rows[0] if r["doc_id"] not in bad)
    stays = {i for i, c, _, _ in brute_join([key(r) for r in rows[1]]) if i == c}
    assert sorted(map(key, rows[2])) == sorted(key(r) for r in rows[1] if r["doc_id"] in stays)
    want = {i: (gone, kept) for i, _, gone, kept in brute([key(r) for r in rows[2]])}
    assert sorted(map(key, rows[3])) == sorted((r["doc_id"], want[r["doc_id"]][1] if want[r["doc_id"]][0] else r["text"]) for r in rows[2])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(outs[3]).collect()}
    assert sorted(map(key, rows[4])) == sorted(key(r) for r in rows[3] for _ in range(copies[r["doc_id"]]))
    check_packing(rows[5], [key(r) for r in rows[4]], bpe)


def test_pipeline_awkward_rows(spark, awkward, nothing, labels, tmp_path):
    for name, docs in (("a", awkward), ("e", nothing)):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        rows = corpus_pipeline.run(spark, sf).collect()
        assert bool(rows) == (name == "a")


def test_deep_and_cut_markup_is_read_once():
    deep = html.blocks("<div>x" * 100_000 + "</p></td>" * 100_000)
    assert len(deep) == 100_000 and len(deep[0][0].path()) == 1
    vectors = html.vectors([deep[-2000:]])[0]
    assert len(vectors) == 2000
    tail = html.path_vector(deep[40][0])
    plain = np.zeros(html.PATH_SIZE, dtype=np.float32)
    steps = deep[40][0].path()
    for place, step in enumerate(steps[::-1]):
        for key in html._keys(step) + (html._keys(step, str(place)) if place < 2 else []):
            html._add(plain, key)
    for _ in range(2):
        html._add(plain, "div>div")
    assert (tail == plain).all()
    for cut in ("<" + "a" * 1_000_000, "</" * 300_000, "<a b='" * 100_000, "<p title=" + '"x' * 100_000, "<!" * 300_000, "<script" + " a" * 200_000, "<p><b " * 100_000, "</script" * 100_000):
        assert html.blocks("<p>before" + cut)[0][1].startswith("before")


def test_pages_of_very_many_blocks_are_read_by_windows(monkeypatch):
    r = np.random.default_rng(3)
    page = "".join(f"<div class='c{r.integers(9)}'><p>{'word ' * int(r.integers(1, 30))}{i}.</p></div>" for i in range(700))
    model = html.load_model()
    own = html.blocks(page)
    [whole] = html.label(html.vectors([own]), model)
    monkeypatch.setattr(html, "WINDOW", 64)
    assert np.allclose(html.label_long(own, model), whole, atol=1e-4)
    short = "<article><p>One two three, four five six.</p></article>"
    assert html.main_text([short, page, short], model)[::2] == html.main_text([short, short], model)
