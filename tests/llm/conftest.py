import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, equal texts."""
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b = say(120), say(3000)
    rows = [
        (1, a, "en", "s1", 1), (2, a, None, "s1", None), (3, a + " tail", "en", None, 1), (4, None, "en", "s2", 1), (5, "", "de", "s2", 0), (6, " \n\t ", "de", "s2", 3),
        (7, b, "en", "s1", 1), (7, b, "en", "s1", 1), (8, b[:9000], "en", "", 1), (9, "one two", "en", "s3", 7), (10, "one two", "en", "s3", 7), (None, a, "en", "s1", 1),
        (None, None, None, None, None), (11, "grüße 日本 \x00 <|endoftext|> it's", "xx", "s4", 2), (12, say(60), "en", "s4", 2), (13, say(49), "en", "s4", 2), (14, "x " * 500, "en", "s5", 1000),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark, awkward):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 15)] + [(None, 1, 1), (3, None, None), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
