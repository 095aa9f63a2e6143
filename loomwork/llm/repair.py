"""Repair of conversations' turn structure: cheapest edits that give (system?)(user assistant)+, the least one in letters.

Bidirectional tight-arc DAG. A node is (rows read, state of what was given out: nothing, system, user or assistant); arcs keep,
rerole or delete the next row, or insert an empty turn. Costs from the start (forward) and to an end (backward) tell which
arcs lie on a cheapest repair: forward + arc + backward = least. A walk from the start keeps the set of nodes that the letters
chosen so far can reach over such arcs, and always takes the least letter (D < I < K < R) any of them has. Two nodes of one
set have read the same rows at the same cost, and given the letters every role is fixed, so the repair is too.

No conversation is collected. Rows are range-partitioned by (conversation, turn) and sorted; a conversation that begins and
ends inside a partition is repaired there, and conversations of like structure share one walk. The first and the last of
each partition may go on elsewhere: each of their segments, at most two a partition, becomes a 4 x 4 matrix of least costs;
prefix and suffix products over a conversation's segments give each its costs from the start and to the end; then each
segment tells where a walk that enters at any optimal node leaves, which fixes where each segment is entered; then
all segments walk at once. Only the text digest of such a conversation is a stream through one task, in constant memory,
because SHA-256 is sequential.

Faults, of the first kind that holds: blank (no `[^\\x20\\x09-\\x0D]`), duplicate (role and text of an earlier row), truncated
(last such character not one of `.!?`). Blank and duplicate rows must be deleted.

Defined cases: null role or text is one space; a null turn sorts first and counts in no gap; a null conv_id is a conversation;
rows of one turn are ordered by role, then text, by code points; a role without characters has no initial and cannot be kept;
roles are told by their initial when kept; repeated rows are duplicates; a conversation whose rows are all gone has zeros,
no letters and the digest of the empty text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import materialize, table, tidy

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
INF = 1 << 40
WHITE = " \t\n\x0b\x0c\r"
_TO_USER = (START, SYSTEM, ASSISTANT)
#: insert arcs (from, to)
_INSERTS = [*((q, USER) for q in _TO_USER), (USER, ASSISTANT)]
#: Structures of short conversations whose repairs a task remembers.
MEMORY = 100_000


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, how often the row stands there (0: dropped), by crc32(`conv_id:turn`) % 20."""
    raw = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    raw = raw.withColumn("k", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20)
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 0, "").when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return raw.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def classed(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with n, blank and cls: 0 for rows to delete, else 1 + place of the initial in
    'sua' (3: none) + 4 if truncated. Only the first of n is of that class, the others are duplicates."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    dated = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"))
    first = rows.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(dated).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("at.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), F.lit(True).alias("first"))
    # the turn is part of the key: a text that stands in very many turns of a conversation is no hot key
    same = rows["conv_id"].eqNullSafe(first["c"]) & rows["turn"].eqNullSafe(first["t"]) & (rows["role"] == first["r"]) & (rows["digest"] == first["d"])
    j = rows.join(first, same, "left")
    end: Column = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = 1 + place + F.when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(4)
    blank = end == ""
    return j.select("conv_id", "turn", "role", "text", F.col("n").cast("long").alias("n"), blank.alias("blank"), F.when(blank | F.col("first").isNull(), 0).otherwise(kind).alias("cls"))


def _arcs(cls: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) over a row of a class."""
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if cls:
        cost, initial = (CUT if cls > 4 else 0), (cls - 1) % 4
        arcs += [("K", START, SYSTEM, cost)] if initial == 0 else []
        arcs += [("K", q, USER, cost) for q in _TO_USER] if initial == 1 else []
        arcs += [("K", USER, ASSISTANT, cost)] if initial == 2 else []
        arcs += [("R", q, t, cost + REROLE) for q, t in _INSERTS]
    return arcs


ARCS = [_arcs(c) for c in range(9)]


def _opened(cost: list[int]) -> list[int]:
    """Forward costs after any inserts."""
    c = list(cost)
    c[USER] = min(c[USER], min(c[q] for q in _TO_USER) + INSERT)
    c[ASSISTANT] = min(c[ASSISTANT], c[USER] + INSERT)
    return c


def _closed(cost: list[int]) -> list[int]:
    """Backward costs with any inserts before."""
    c = list(cost)
    c[USER] = min(c[USER], c[ASSISTANT] + INSERT)
    for q in _TO_USER:
        c[q] = min(c[q], c[USER] + INSERT)
    c[USER] = min(c[USER], c[ASSISTANT] + INSERT)
    return c


def forward(classes: bytes, begin: list[int]) -> list[list[int]]:
    """Costs of the nodes of every layer, inserts included; begin: costs at the first layer before its inserts."""
    layers = [_opened(begin)]
    for c in classes:
        now = [INF] * 4
        last = layers[-1]
        for _, q, t, cost in ARCS[c]:
            if last[q] + cost < now[t]:
                now[t] = last[q] + cost
        layers.append(_opened(now))
    return layers


def backward(classes: bytes, end: list[int]) -> list[list[int]]:
    """Costs to the end from the nodes of every layer; end: those of the last layer."""
    layers = [end]
    for c in reversed(classes):
        now, after = [INF] * 4, layers[-1]
        for _, q, t, cost in ARCS[c]:
            if after[t] + cost < now[q]:
                now[q] = after[t] + cost
        layers.append(_closed(now))
    return layers[::-1]


#: Costs to the end after all rows: nothing or an assistant may be last.
END = _closed([0, INF, INF, 0])
BEGIN = [0, INF, INF, INF]


def matrix(classes: bytes) -> list[list[int]]:
    """Least costs over the rows, from each state before inserts to each state right after the last row."""
    out = []
    for q in range(4):
        cost = [INF] * 4
        cost[q] = 0
        for c in classes:
            cost, now = _opened(cost), [INF] * 4
            for _, a, t, w in ARCS[c]:
                now[t] = min(now[t], cost[a] + w)
            cost = now
        out.append([min(x, INF) for x in cost])
    return out


def walk(classes: bytes, ahead: list[list[int]], behind: list[list[int]], total: int, entry: set[int], last: bool) -> tuple[str, set[int]]:
    """Letters of the least walk over tight arcs from a set of states, and the set it ends in."""
    here, letters, i = set(entry), [], 0
    while True:
        at, to = ahead[i], behind[i]
        choices: dict[str, set[int]] = {}
        if i == len(classes):
            if not last or any(to[q] == 0 for q in here):
                return "".join(letters), here
        else:
            after = behind[i + 1]
            for letter, q, t, cost in ARCS[classes[i]]:
                if q in here and at[q] + cost + after[t] == total:
                    choices.setdefault(letter, set()).add(t)
        for q, t in _INSERTS:
            if q in here and at[q] + INSERT + to[t] == total:
                choices.setdefault("I", set()).add(t)
        if not choices:  # no optimal node was among the states entered with
            return "".join(letters), set()
        letter = min(choices)
        letters.append(letter)
        here = choices[letter]
        i += letter != "I"


@lru_cache(maxsize=MEMORY)
def repair(classes: bytes) -> tuple[int, str]:
    """(cost, letters) of the least cheapest repair of rows of these classes."""
    ahead, behind = forward(classes, BEGIN), backward(classes, END)
    return behind[0][START], walk(classes, ahead, behind, behind[0][START], {START}, True)[0]


def lines(letters: str, rows: list[tuple[str, str]], entry: int = START) -> Iterator[str]:
    """The turns that letters make of (role, text) rows, after a state. K and R take a turn's text, I gives an empty one."""
    state, at = entry, 0
    for letter in letters:
        if letter != "D":
            role, text = rows[at] if letter != "I" else ("", "")
            if letter != "K":
                role = "assistant" if state == USER else "user"
            state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
            yield f"{role}:{text}"
        at += letter != "I"


_ROW = "conv_id long, turn long, role string, text string, n long, blank boolean, cls int"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}
#: A result, a segment's summary, or a segment's row.
_PARTS = f"kind int, {_RESULT}, seg int, pos long, seen array<long>, first string, final string, costs array<long>, cls binary, role string, text string"
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Segment:
    """Rows of one conversation within one partition."""

    def __init__(self, conv):
        self.conv, self.classes, self.rows = conv, bytearray(), []
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.final = None

    def add(self, turn, role, text, n, blank, cls):
        self.rows.append((role, text, n, cls))
        if not n:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        if blank:
            self.blank += n
        else:
            self.duplicate += n if cls == 0 else n - 1
            self.truncated += cls > 4
        initial = role[:1]
        self.illegal += n - 1 + (self.final is not None and self.final + initial not in _LEGAL)
        self.first, self.final = (initial if self.first is None else self.first), initial
        self.classes.append(cls)
        self.classes.extend(bytes(n - 1))

    def turns(self) -> list[tuple[str, str]]:
        """(role, text) of each row as often as it stands there."""
        return [(r, t) for r, t, n, _ in self.rows for _ in range(n)]

    def result(self) -> dict:
        cost, letters = repair(bytes(self.classes)) if len(self.classes) <= 64 else repair.__wrapped__(bytes(self.classes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        digest = hashlib.sha256("\n".join(lines(letters, self.turns())).encode()).hexdigest()
        return {
            "kind": 0, "conv_id": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "audit": letters, "repaired_sha256": digest,
        }

    def parts(self, seg: int) -> Iterator[dict]:
        seen = [self.low, self.high, self.distinct, self.blank, self.duplicate, self.truncated, self.illegal]
        costs = [x for line in matrix(bytes(self.classes)) for x in line]
        yield {"kind": 1, "conv_id": self.conv, "seg": seg, "seen": seen, "first": self.first, "final": self.final, "costs": costs}
        for i, (role, text, n, cls) in enumerate(self.rows):
            yield {"kind": 2, "conv_id": self.conv, "seg": seg, "pos": i, "cls": bytes([cls][:n]) + bytes(max(0, n - 1)), "role": role, "text": text}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows by batches of about `size` characters."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 100 + sum(len(v) for v in r.values() if isinstance(v, (str, bytes)))
        if weight > size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations inside the partition repaired, those at its borders as segments."""
    from pyspark import TaskContext

    seg = TaskContext.get().partitionId()

    def out() -> Iterator[dict]:
        now, n_before = None, 0
        for conv, *row in _rows(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from [now.result()] if n_before else now.parts(seg)
                    n_before += 1
                now = _Segment(conv)
            now.add(*row)
        if now is not None:
            yield from now.parts(seg)

    yield from _batches(out(), _arrow(_PARTS))


_PLACED = "conv_id long, seg int, ahead array<long>, behind array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _place(summaries: pa.Table) -> pa.Table:
    """Costs from the start and to the end of each segment of a conversation; its counts on the last one."""
    segs = sorted(summaries.to_pylist(), key=lambda r: r["seg"])
    cost, end = BEGIN, END
    for s in segs:
        m, s["ahead"] = s["costs"], cost
        cost = [min(INF, *(cost[q] + m[4 * q + t] for q in range(4))) for t in range(4)]
    total = min(c + e for c, e in zip(cost, END, strict=True))
    for s in reversed(segs):
        m, s["behind"] = s["costs"], end
        end = _closed([min(INF, *(m[4 * q + t] + end[t] for t in range(4))) for q in range(4)])
    low = high = final = None
    counts = dict.fromkeys(_COUNTS, 0) | {"cost": total}
    distinct = 0
    for s in segs:
        a, b, d, *faults = s["seen"]
        if a is not None:
            distinct += d - (a == high)
            low, high = (a if low is None else low), b
        for name, x in zip(("blank", "duplicate", "truncated", "illegal"), faults, strict=True):
            counts[name] += x
        if s["first"] is not None:
            counts["illegal"] += final is not None and final + s["first"] not in _LEGAL
            final = s["final"]
    counts["gaps"] = 0 if low is None else high - low + 1 - distinct
    rows = [{k: s[k] for k in ("conv_id", "seg", "ahead", "behind")} | counts | {"last": s is segs[-1]} for s in segs]
    return pa.Table.from_pylist(rows, _arrow(_PLACED))


_LEFT = "conv_id long, seg int, leave array<int>"


def _joined(rows: pa.Table, placed: pa.Table) -> tuple[dict, list[dict], bytes, list[list[int]], list[list[int]]]:
    [state] = placed.to_pylist()
    own = sorted(rows.to_pylist(), key=lambda r: r["pos"])
    classes = b"".join(r["cls"] for r in own)
    return state, own, classes, forward(classes, state["ahead"]), backward(classes, state["behind"])


def _leave(rows: pa.Table, placed: pa.Table) -> pa.Table:
    """Where a walk leaves the segment, for each optimal state that it may enter with. A letter leads from a state to one
    state, so sets between segments, which begin with the single start, hold one state each; -1: none."""
    state, _, classes, ahead, behind = _joined(rows, placed)
    total, leave = state["cost"], [-1] * 4
    for q in range(4):
        if state["ahead"][q] + behind[0][q] == total:
            [leave[q]] = walk(classes, ahead, behind, total, {q}, state["last"])[1]
    return pa.Table.from_pylist([{"conv_id": state["conv_id"], "seg": state["seg"], "leave": leave}], _arrow(_LEFT))


_ENTER = "conv_id long, seg int, enter int"


def _enter(left: pa.Table) -> pa.Table:
    """The state that the walk enters each segment of a conversation with."""
    state, rows = START, []
    for s in sorted(left.to_pylist(), key=lambda r: r["seg"]):
        rows.append({"conv_id": s["conv_id"], "seg": s["seg"], "enter": state})
        state = s["leave"][state]
    return pa.Table.from_pylist(rows, _arrow(_ENTER))


_WALKED = "conv_id long, seg int, part int, letters string, turns string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
#: Characters of repaired turns in one row between the walk and the digest.
CHUNK = 1 << 20


def _walked(rows: pa.Table, placed: pa.Table) -> pa.Table:
    """Letters and repaired turns of a segment, by chunks; the counts stand on the last segment's first chunk."""
    state, own, classes, ahead, behind = _joined(rows, placed)
    entry = state["enter"]
    letters, _ = walk(classes, ahead, behind, state["cost"], {entry}, state["last"])
    turns = [(r["role"], r["text"]) for r in own for _ in r["cls"]]
    chunks, held, weight = [], [], 0
    for line in lines(letters, turns, entry):
        held.append(line)
        weight += len(line)
        if weight > CHUNK:
            chunks.append("\n".join(held))
            held, weight = [], 0
    chunks.append("\n".join(held))
    out = [{"conv_id": state["conv_id"], "seg": state["seg"], "part": i, "turns": c, "letters": letters if i == 0 else ""} for i, c in enumerate(chunks)]
    if state["last"]:
        out[0] |= {c: state[c] for c in _COUNTS}
    return pa.Table.from_pylist(out, _arrow(_WALKED))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of conversations to results, one chunk held at a time."""

    def out() -> Iterator[dict]:
        now: dict | None = None
        for conv, _, _, letters, turns, *counts in _rows(batches):
            if now is None or conv != now["conv_id"]:
                if now is not None:
                    yield now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                now, audit, digest, some = {"conv_id": conv}, [], hashlib.sha256(), False
            audit.append(letters)
            if turns:
                digest.update((("\n" if some else "") + turns).encode())
                some = True
            if counts[0] is not None:
                now |= dict(zip(_COUNTS, counts, strict=True))
        if now is not None:
            yield now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _batches(out(), _arrow(_RESULT))


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, n): its faults, cheapest repair and the repaired turns' digest."""
    near = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 16), F.substring("text", 1, 32)]
    # prefixes decide the range, whole values the order within: together they order as the whole values do
    ordered = classed(rows).repartitionByRange(*near).sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = materialize(ordered.mapInArrow(tidy(_within), _PARTS), "conversations")
    inside = parts.where("kind = 0").select(*[n.split()[0] for n in _RESULT.split(", ")])
    border = parts.where("kind = 2").select("conv_id", "seg", "pos", "cls", "role", "text")
    placed = materialize(parts.where("kind = 1").select("conv_id", "seg", "seen", "first", "final", "costs").groupBy("conv_id").applyInArrow(_place, _PLACED), "segments")
    slim, key = border.select("conv_id", "seg", "pos", "cls"), ["conv_id", "seg"]
    left = slim.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(_leave, _LEFT)
    enter = materialize(left.groupBy("conv_id").applyInArrow(_enter, _ENTER), "entries")
    known = placed.join(enter.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), "enter"), F.expr("conv_id <=> c AND seg = s")).drop("c", "s")
    walked = border.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(_walked, _WALKED)
    crossing = walked.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "part").mapInArrow(tidy(_digested), _RESULT)
    return inside.unionByName(crossing)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damage(table(spark, sf_dir, "conversations")))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}

_MIN = "list_sort([{}])[1]"


def _oracle() -> str:
    """The same by letters and costs of every prefix: for one state and cost no repair's letters begin with another's."""
    add = lambda p, cost, letter: f"{{'c': {p}.c + {cost}, 's': {p}.s || '{letter}'}}"
    best = lambda *xs: _MIN.format(", ".join(xs))
    none = "{'c': 1000000000, 's': ''}"
    given = lambda cond, x: f"CASE WHEN {cond} THEN {x} ELSE {none} END"
    open_u = best("u", add("n", 3, "I"), add("s", 3, "I"), add("a", 3, "I"))
    keep = "CASE WHEN cut THEN 3 ELSE 0 END"
    to_u = lambda letter, cost: [add(p, cost, letter) for p in ("n", "s", "a")]
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS k FROM raw, tab
), dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS twin
  FROM hashed WHERE k <> 0
), ord AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, twin) AS nth,
    lag(role) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, twin)
), cl AS (
  SELECT *, left(role, 1) AS ini, trimmed = '' AS blank, trimmed <> '' AND nth > 1 AS dup, NOT regexp_matches(trimmed, '[.!?]$') AS cut,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM ord
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 's': ''}} AS n, {none} AS s, {none} AS u, {none} AS a FROM ids
  UNION ALL
  SELECT conv_id, i, {add("n", 4, "D")} AS n, {best(add("s", 4, "D"), given("NOT must AND ini = 's'", add("n", keep, "K")))} AS s,
    {best(add("u", 4, "D"), *[given("NOT must AND ini = 'u'", x) for x in to_u("K", keep)], *[given("NOT must", x) for x in to_u("R", f"3 + {keep}")])} AS u,
    {best(add("a", 4, "D"), given("NOT must AND ini = 'a'", add("u", keep, "K")), given("NOT must", add("u", f"3 + {keep}", "R")))} AS a
  FROM (SELECT c.conv_id, c.i, c.ini, c.cut, c.blank OR c.dup AS must, o.n, o.s, o.u, {best("o.a", add("o.u", 3, "I"))} AS a
    FROM (SELECT conv_id, i, n, s, a, {open_u} AS u FROM walk) o JOIN cl c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.i = o.i + 1)
), done AS (
  SELECT conv_id, {best("n", "a", add("u", 3, "I"))} AS r
  FROM (SELECT conv_id, i, n, s, a, {open_u} AS u FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
), letter AS (
  SELECT conv_id, r.s AS audit, unnest(range(1, length(r.s) + 1)) AS j FROM done
), pos AS (
  SELECT *, audit[j] AS x, length(replace(left(audit, j), 'I', '')) AS i, length(replace(left(audit, j), 'D', '')) AS p FROM letter
), made AS (
  SELECT pos.*, cl.role, cl.text, first_value(x = 'K' AND cl.ini = 's') OVER (PARTITION BY pos.conv_id ORDER BY p, x = 'D', j) AS lead
  FROM pos LEFT JOIN cl ON x <> 'I' AND cl.conv_id IS NOT DISTINCT FROM pos.conv_id AND cl.i = pos.i WHERE x <> 'D'
), said AS (
  SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (p - CAST(lead AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM made GROUP BY conv_id
), cnt AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (NOT blank AND NOT dup AND cut) AS truncated, count(*) FILTER (bad) AS illegal FROM cl GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(done.r.c AS BIGINT) AS cost, done.r.s AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE = {"op12_conversation_repair": _oracle()}
