import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import quality, toxicity


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module, awkward, nothing, labels):
    rows = module.score(awkward.withColumn("score", F.lit("clash")).withColumn("_y", F.lit(1)), labels).collect()
    assert len(rows) == 17 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert module.score(nothing, labels).collect() == []
    assert len(module.score(awkward, labels.limit(0)).collect()) == 17


def test_folds(spark, awkward, labels):
    import zlib

    for module, parts, part in ((quality, 5, 0), (toxicity, 4, 2)):
        for r in module.score(awkward, labels).collect():
            held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == part
            assert r["held_out"] == held


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, module, label, least):
    d, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = module.score(d.select("doc_id", "text"), known).where("held_out").join(known, "doc_id").select("predicted", label).collect()
    right = sum(r["predicted"] == r[label] for r in got)
    assert right / len(got) >= least


def test_traversal_equals_recursion():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = quality.grow(x, y, 20)

    def walk(row, node):
        return t.value[node] if t.left[node] == node else walk(row, t.left[node] if row[t.feature[node]] <= t.cut[node] else t.right[node])

    slow = [1 / (1 + np.exp(-(t.base + sum(walk(row, k) for k in t.roots)))) for row in x]
    assert np.allclose(t.predict(x), slow) and ((t.predict(x) > 0.5) == y).mean() > 0.95


def test_statistics_equal_plain_python():
    text = "One two two two.\nOne two two two.\n### THE end"
    other = "zwei"
    data = np.frombuffer((text + other).encode(), dtype=np.uint8)
    s = dict(zip(quality.FEATURES, quality.statistics(data, np.array([0, len(text), len(text) + len(other)]))[0], strict=True))
    words = text.split()
    assert s["log_words"] == pytest.approx(np.log1p(len(words)))
    assert s["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert s["distinct_lines"] == pytest.approx(2 / 3)
    assert s["echo"] == pytest.approx(2 / len(words))
    assert s["share_upper"] == pytest.approx(sum(c.isupper() for c in text) / len(text))


def test_deobfuscation(spark):
    d = spark.createDataFrame([("stupid moron idiot clown loser trash words here and there " * 20,)], "text string")
    model = toxicity.char_model(d)
    for bad, good in (("m0r0n", "moron"), ("s t u p i d", "stupid"), ("l-o-s-e-r", "loser"), ("cl0wn", "clown"), ("loooser", "loser"), ("1d10t", "idiot"), ("tr@sh", "trash")):
        assert toxicity.restore(f"you {bad} there", model) == f"you {good} there"
    assert toxicity.restore("plain words, 12 of them (really)", model) == "plain words, 12 of them (really)"


def test_viterbi_is_the_best_spelling():
    r = np.random.default_rng(1)
    model = np.log(r.dirichlet(np.ones(28), size=(28, 28)))

    def every(span):
        best = (np.inf, "")
        stack = [(0, 0, 0.0, "", 0)]
        while stack:
            a, b, cost, text, i = stack.pop()
            if i == len(span):
                best = min(best, (cost - model[a, b, 0], text))
                continue
            c = span[i]
            for x, extra in [(c, 0.0)] if c.isalpha() else [(x, 0.7) for x in toxicity.LOOKS[c]]:
                k = ord(x) - 96
                stack.append((b, k, cost + extra - model[a, b, k], text + x, i + 1))
            if not c.isalpha() and not (text and toxicity.LOOKS[c][0] == text[-1]):
                stack.append((a, b, cost + 9.0, text, i + 1))
        return best[1]

    for span in ("a1b0c", "x3y1z", "p4q5r"):
        assert toxicity.decode(span, model) == every(span)


def test_trigrams_do_not_run_across_texts(spark):
    a = toxicity.char_model(spark.createDataFrame([("ab",), ("cd",)], "text string"))
    b = toxicity.char_model(spark.createDataFrame([("cd",), ("ab",)], "text string").coalesce(1))
    assert np.allclose(a, b)


def test_spellings_belong_to_one_model():
    r = np.random.default_rng(1)
    a, b = (np.log(r.dirichlet(np.ones(28), (28, 28))) for _ in range(2))
    spans = ["he1p", "s0 1o w", "b@d w0rd", "st1ll", "c00l"]
    first = [toxicity.restore(s, a) for s in spans], [toxicity.restore(s, b) for s in spans]
    second = [toxicity.restore(s, b) for s in spans], [toxicity.restore(s, a) for s in spans]
    assert first == second[::-1]


def test_two_tables_in_one_session_score_alike_in_either_order(spark, awkward, labels):
    say = lambda d: sorted((repr(tuple(r)) for r in toxicity.score(d, labels).select("doc_id", "score").collect()))
    other = awkward.withColumn("text", F.concat(F.lit("he1p h3lp "), F.reverse("text")))
    one, two = say(awkward), say(other)
    assert (say(other), say(awkward)) == (two, one)


def test_long_spans_take_time_in_proportion():
    model = np.log(np.full((28, 28, 28), 1 / 28))
    span = "h3l0" * 25_000
    assert len(toxicity.decode(span, model)) > 50_000
