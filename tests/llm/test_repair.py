"""Conversation repair against every edit sequence, and segments against whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from loomwork.llm import repair

ROLES = ["system", "user", "assistant", "tool", "", None]


def cheapest(rows):
    """(cost, letters, turns) by trying prefixes of edits in order of cost, then letters: rows of (role, text, must, cut)."""
    import heapq

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, shape, turns = heapq.heappop(heap)
        key = (i, shape[-1:] if shape else "", len(shape) == 0)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, letters, "\n".join(turns)
        if key in seen:
            continue
        seen.add(key)

        def go(c, letter, j, role, text):
            grown = shape if role is None else shape + role[:1]
            if re.fullmatch("s?(ua)*u?", grown) and (role is None or role[:1]):
                heapq.heappush(heap, (cost + c, letters + letter, j, grown, turns if role is None else (*turns, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(3, "I", i, role, "")
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(4, "D", i + 1, None, "")
            if not must:
                go(3 * cut, "K", i + 1, role, text)
                for other in ("user", "assistant"):
                    go(3 + 3 * cut, "R", i + 1, other, text)


def brute(raw):
    """conv_id -> result of rows (conv_id, turn, role, text) by plain Python."""
    out, convs = {}, {}
    for c, t, r, x in raw:
        r, x = " " if r is None else r, " " if x is None else x
        convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            x = ""
        if k == 2:
            x = re.sub("[.!?]", "", x)
        if k == 4:
            r = "user"
        convs[c] += [(t, r, x)] * (2 if k == 3 else 1)
    for c, rows in convs.items():
        rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        seen, marked, last = set(), [], None
        for _, r, x in rows:
            body = x.strip(" \t\n\x0b\x0c\r")
            blank, dup, cut = not body, (r, x) in seen, body[-1:] not in (".", "!", "?")
            seen.add((r, x))
            n["blank"] += blank
            n["duplicate"] += not blank and dup
            n["truncated"] += not blank and not dup and cut
            n["illegal"] += last is not None and last[:1] + r[:1] not in ("su", "ua", "au")
            last = r
            marked.append((r, x, blank or dup, cut))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, letters, said = cheapest(marked)
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, letters, hashlib.sha256(said.encode()).hexdigest())
    return out


def collected(df):
    rows = df.collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(seed, convs, turns):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Long text here!", "and so", None, "ü.", "x. "]
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, turns)):
            role = r.choice(ROLES) if r.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, None if r.random() < 0.05 else t + r.randint(0, 1), role, r.choice(texts)))
    return rows + rows[:3]


FIELDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", ["4", "61"])
def test_equals_every_edit_sequence(spark, parts):
    rows = talk(3, 120, 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = collected(repair.repaired(repair.damage(spark.createDataFrame(rows, FIELDS))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "system", "user", "assistant"]), r.choice([f"said {t}.", f"said {t}", "again."])) for t in range(700)]
    rows += [(8, 0, "user", "Hi.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = collected(repair.repaired(repair.damage(spark.createDataFrame(rows, FIELDS))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_segments_compose(monkeypatch):
    r = random.Random(4)
    for _ in range(300):
        classes = bytes(r.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8]) for _ in range(r.randint(0, 30)))
        cut = r.randint(0, len(classes))
        whole = repair.matrix(classes)
        a, b = repair.matrix(classes[:cut]), repair.matrix(classes[cut:])
        both = [[min(repair.INF, *(a[q][m] + b[m][t] for m in range(4))) for t in range(4)] for q in range(4)]
        assert both == whole
        cost, letters = repair.repair(classes)
        rows = [(("system", "user", "assistant", "x")[(c - 1) % 4] if c else "user", "t", c == 0, c > 4) for c in classes]
        assert (cost, letters) == cheapest(rows)[:2]


def test_very_long_texts_repeats_and_nothing(spark):
    rows = [(1, 0, "user", "a" * 300_000 + "."), (1, 1, "assistant", " " * 200_000), (2, None, None, None), (3, 5, "user", "Hello."), *[(4, 2, "user", "same.")] * 500, (None, 1, "assistant", "So.")]
    df = spark.createDataFrame(rows, FIELDS)
    assert collected(repair.repaired(repair.damage(df))) == brute(rows)
    assert repair.repaired(repair.damage(df.limit(0))).count() == 0
    more = df.selectExpr("*", "1 AS n", "2 AS cls", "3 AS seg", "'x' AS digest", "'y' AS k")
    assert collected(repair.repaired(repair.damage(more))) == brute(rows)
