"""Rule tables: phrases, topics, links and checks."""

from loomwork.operators import rules as R


def test_phrases_topics_and_links(spark):
    texts = {1: "The Panama Canal, the panamá canal!", 2: "canal panama", 3: None, 4: "", 5: "water water of the canal zone", 6: "Wáter", 7: "panama canals"}
    t = spark.createDataFrame(list(texts.items()), "key long, text string")
    table = [("canal", "Panama Canal"), ("canal", "canal zone"), ("water", "water"), ("water", "WATER"), ("none", "..."), ("none", None), ("water", "of the canal")]
    r = spark.createDataFrame(table, "rule string, phrase string")
    got = sorted((x["key"], x["rule"], x["phrase"], x["at"]) for x in R.matches(t, r).collect())
    assert got == [
        (1, "canal", "panama canal", 1), (1, "canal", "panama canal", 4), (5, "canal", "canal zone", 4), (5, "water", "of the canal", 2), (5, "water", "water", 0), (5, "water", "water", 1),
        (6, "water", "water", 0),
    ]
    assert {x["phrase"] for x in R.matches(t, r, 1).collect()} == {"water"}
    order = spark.createDataFrame([("canal", 0), ("water", 1), ("none", 2)], "rule string, place int")
    assert {x["key"]: x["topic"] for x in R.topics(t, r, order).collect()} == {1: "canal", 2: "other", 3: "other", 4: "other", 5: "water", 6: "water", 7: "other"}
    targets = spark.createDataFrame([("canal", "ship.traffic"), ("water", "water.use"), ("water", "ship.traffic")], "rule string, target string")
    assert {(x["key"], x["target"], x["phrase"]) for x in R.links(t, r, targets).collect()} == {(1, "ship.traffic", "panama canal"), (5, "ship.traffic", "water"), (5, "water.use", "water"), (6, "ship.traffic", "water"), (6, "water.use", "water")}


def test_problems_of_tables(spark):
    r = spark.createDataFrame([("a", "one two"), ("b", "One, two"), ("c", "!"), ("d", "x")], "rule string, phrase string")
    w = spark.createDataFrame([("r", 60), ("i", 50), ("i", -20)], "name string, weight int")
    b = spark.createDataFrame([("low", 0, 400), ("mid", 400, 700), ("high", 710, 1000), ("low", 5, 5)], "band string, low int, high int")
    got = {tuple(x) for x in R.problems(r, w, b).collect()}
    assert {("rules", "shared_phrase", "one two"), ("rules", "no_words", "c"), ("weights", "sum", "90"), ("weights", "negative", "i"), ("weights", "repeated", "i"), ("bands", "repeated", "low"), ("bands", "empty", "low"), ("bands", "gap_after", "mid"), ("bands", "gap_before", "high")} <= got
    good = R.problems(r.where("rule in ('a', 'd')"), spark.createDataFrame([("r", 60), ("i", 40)], "name string, weight int"), spark.createDataFrame([("low", 0, 400), ("high", 400, 1000)], "band string, low int, high int"))
    assert good.collect() == []


def test_words_of_texts_are_not_shuffled_to_a_few_rules(spark):
    t = spark.createDataFrame([(1, "the panama canal"), (2, "water")], "key long, text string")
    r = spark.createDataFrame([("canal", "Panama Canal"), ("water", "water")], "rule string, phrase string")
    few, many = R.matches(t, r), R.matches(t, r, small=1)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(R.matches(t, r, small=1)) and "SortMergeJoin" not in plan(R.matches(t, r))
