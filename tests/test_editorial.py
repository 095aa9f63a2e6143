from loomwork.operators import editorial as E


def test_chunks_halve_and_grow():
    calls = []

    def count(a, b):
        calls.append((a, b))
        return (b - a) * (10 if 100 <= a < 150 else 1)

    out = E.adaptive_chunks(0, 400, count, most=250, least=6, first=200)
    assert out[0] == (0, 200) and out[-1][1] == 400
    assert all(b == c for (_, b), (c, _) in zip(out, out[1:], strict=False))
    busy = E.adaptive_chunks(100, 150, count, most=250, least=6, first=200)
    assert all((b - a) * 10 < 250 or b - a <= 6 for a, b in busy)


def test_claim_reasons(spark):
    claims = spark.createDataFrame(
        [(1, 1, "Inflation was 12 percent", True, [(7, "v")]), (1, 2, "It was 99 percent", True, [(7, "v")]), (1, 3, "No cite", True, None), (1, 4, "Bad cite", True, [(8, "v")]), (1, 5, "x " * 90, False, []), (1, 6, "a", True, [(7, "v")]), (1, 6, "b", True, [(7, "v")])],
        "case long, claim long, text string, factual boolean, cites array<struct<id: long, field: string>>",
    )
    evidence = spark.createDataFrame([(1, 7, "v", "12 percent in 2020")], "case long, id long, field string, value string")
    got = sorted((r["claim"], tuple(r["reasons"])) for r in E.claim_checks(claims, evidence).collect())
    assert got == [(1, ()), (2, ("unseen_figure",)), (3, ("uncited",)), (4, ("unknown_cite",)), (5, ("too_long",)), (6, ("duplicate",)), (6, ("duplicate",))]


def test_pair_sample_fills_from_other_strata(spark):
    pairs = spark.createDataFrame([(i, i + 1, "big") for i in range(20)] + [(100, 101, "small")], "a long, b long, stratum string")
    got = E.pair_strata(pairs, 3).collect()
    assert len(got) == 6 and sum(r["stratum"] == "small" for r in got) == 1


def test_report_keeps_sections_apart(spark):
    a, b = spark.sql("select 'x' as measure, 1 as n"), spark.sql("select 'y' as measure, 0.5D as share")
    assert sorted(map(tuple, E.report({"one": a, "two": b}).select("section", "measure", "n", "share").collect())) == [("one", "x", 1, None), ("two", "y", None, 0.5)]
