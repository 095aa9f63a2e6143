"""The filter audit against one document after the other through every order."""

from itertools import permutations

from loomwork.llm import audit


def brute(rows, labels):
    """Every order applied to every document in turn."""
    texts = [t or "" for _, t, _ in rows]
    out = {}
    marks = {}
    for i, q, x in labels:
        if i is not None:
            g, b = marks.get(i, (False, False))
            marks[i] = (g or q == 1, b or x == 1)

    def fails(i):
        doc, text = rows[i][0], texts[i]
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if doc is not None and any(d is not None and d < doc and t == text for (d, _, _), t in zip(rows, texts, strict=True)):
            bad.add("E")
        return bad

    bad = [fails(i) for i in range(len(rows))]
    parts = {lang or "" for _, _, lang in rows}
    share = dict.fromkeys(((p, f) for p in parts for f in "ABCDE"), 0)
    for order in map("".join, permutations("ABCDE")):
        left = set(range(len(rows)))
        for step, f in enumerate(order, 1):
            for p in parts:
                mine = {i for i in range(len(rows)) if (rows[i][2] or "") == p}
                cut = {i for i in left & mine if f in bad[i]}
                share[p, f] += len(cut)
                lost = [marks.get(rows[i][0], (False, False)) for i in cut]
                out[p, order, step] = (
                    len(left & mine) - len(cut), len(cut), sum(f in bad[i] for i in mine - left), sum(bad[i] == {f} for i in mine), sum(g for g, _ in lost), sum(x for _, x in lost),
                )
            left -= {i for i in left if f in bad[i]}
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_every_order_on_awkward_rows(spark, awkward, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()]
    marks = [tuple(r) for r in labels.collect()]
    got = collected(audit.audit(awkward, labels))
    assert got == brute(rows, marks)
    assert len(got) == 600 * len({x[2] or "" for x in rows})


def test_ties_of_ids_and_copies_over_parts(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(3, long, "en"), (1, long, "de"), (1, long, "de"), (None, long, "en"), (2, long, "en"), (5, "A # b", "en"), (6, "a " * 300, None), (7, "x" * 100_000, ""), (6, "A # b", "en"), (9, None, "en"), (10, "", "fr")]
    marks = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (5, None, 1), (9, 1, 1), (None, 1, 1)]
    got = collected(audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
    assert got == brute(rows, marks)


def test_no_rows_and_other_columns(spark, awkward, nothing, labels):
    assert audit.audit(nothing, labels).count() == 0
    more = awkward.selectExpr("*", "'x' AS failed", "1 AS n", "true AS good", "'p' AS part", "'k' AS digest", "7 AS next")
    assert collected(audit.audit(more, labels)) == collected(audit.audit(awkward, labels))
    assert collected(audit.audit(awkward, labels.limit(0))).keys() == collected(audit.audit(awkward, labels)).keys()


def test_lattice_has_eighty_edges_and_six_hundred_steps(spark):
    edges = audit.edge_list()
    assert len(edges) == len(set(edges)) == 80
    steps = audit.paths(spark).collect()
    assert len(steps) == 600 and {(r["applied"], r["next"]) for r in steps} == set(edges)
