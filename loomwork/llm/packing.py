"""Best-fit packing of token sequences by bin completion.

Texts are tokenised and cut into pieces of at most `capacity` tokens. What matters for packing is only how many
pieces there are of each length, a table of at most `capacity` rows at any scale; the driver solves that, and the
solution is dealt back to the pieces by their rank among pieces of their length.

The solver is bin completion (Korf 2002). Incumbents are best fit and least-waste completion: one filling at a time
around the longest remaining piece, repeated as often as lengths allow, so a plan has fewer rows than lengths. Where the
better one has more sequences than the lower bound, its most wasteful sequences are taken apart and packed anew by
branch and bound over the undominated fillings of the longest piece left, with backtracking across sequences; branches
end where their waste or the bound of what is left allows no fewer sequences. Budgets of branches are parameters, and
`proved` tells whether the number of sequences is known to be the least; where a budget is spent it is false, and the
packing is still whole.

Defined cases: null or empty text is the closing id alone; repeated rows are packed as often as they come; a null
doc_id is packed like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import materialize, ranked, table, tidy
from loomwork.llm.bpe import encoder

CAPACITY = 4096
END = 1
#: Branches that one completion of an incumbent may try, and all searches of branch and bound together; sequences taken apart.
COMPLETE, NODES, DEEPEST = 4000, 200_000, 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, with_ids: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(path), np.array([END], dtype="<u4").tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                coded = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, raw in zip(batch.column(0).to_pylist(), coded, strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        doc.append(d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        bpe.forget()

    return kernel


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked, ids (uint32 bytes)."""
    kernel = _cut(tokenizer or default_tokenizer(), capacity, with_ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(kernel), _PIECES + (", ids binary" if with_ids else ""))


Filling = list[tuple[int, int]]


class Budget:
    """Branches that a search may still try; `spent` tells that it had to stop."""

    def __init__(self, nodes: int):
        self.left = nodes

    @property
    def spent(self) -> bool:
        return self.left <= 0

    def take(self) -> bool:
        self.left -= 1
        return self.left > 0


def complete(room: int, lengths: list[int], left: dict[int, int], budget: Budget) -> Filling:
    """Least-waste filling of `room` from the remaining lengths (ascending), as (length, count), longest first."""
    best: list = [room, []]
    chosen: list[tuple[int, int]] = []
    below = [0]  # all copies of the lengths before each
    for x in lengths:
        below.append(below[-1] + x * left[x])

    def search(room: int, top: int) -> bool:
        """Tries pieces of lengths[:top]; True ends the whole search."""
        if room < best[0]:
            best[0], best[1] = room, list(chosen)
            if not room:
                return True
        for i in range(bisect_right(lengths, room, 0, top) - 1, -1, -1):
            if room - below[i + 1] >= best[0]:
                return False  # everything from here down leaves no less waste
            x = lengths[i]
            for k in range(min(left[x], room // x), 0, -1):
                if not budget.take():
                    return True
                chosen.append((x, k))
                if search(room - k * x, i):
                    return True
                chosen.pop()
        return False

    search(room, len(lengths))
    return best[1]


def _repeat(counts: dict[int, int], capacity: int, fill) -> list[tuple[int, Filling]]:
    """A plan by one filling at a time around the longest piece, each as often as lengths allow."""
    left, lengths, plan = dict(counts), sorted(counts), []
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        own = lengths if left[top] else lengths[:-1]
        filling: dict[int, int] = {top: 1}
        for x, k in fill(capacity - top, own, left):
            filling[x] = filling.get(x, 0) + k
        left[top] += 1
        times = min(left[x] // k for x, k in filling.items())
        for x, k in filling.items():
            left[x] -= k * times
            if not left[x]:
                lengths.remove(x)
        plan.append((times, sorted(filling.items(), reverse=True)))
    return plan


def _best_fit(room: int, lengths: list[int], left: dict[int, int]) -> Filling:
    out, i = [], len(lengths)
    while room:
        i = bisect_right(lengths, room, 0, i) - 1
        if i < 0:
            break
        k = min(left[lengths[i]], room // lengths[i])
        out.append((lengths[i], k))
        room -= k * lengths[i]
    return out


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences that no plan can do with less (Martello and Toth's second bound)."""
    if not counts:
        return 0
    x = np.array(sorted(counts))
    n = np.array([counts[k] for k in x.tolist()])
    number, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * x))
    half = int(np.searchsorted(x, capacity // 2, side="right"))  # pieces before share with another of their length
    edge = np.append(0, x[:half])
    # pieces over capacity - edge are alone but for pieces under edge; of the others, those over half do not meet
    alone = np.searchsorted(x, capacity - edge, side="right")
    met = np.maximum(alone, half)
    room = capacity * (number[met] - number[half]) - (total[met] - total[half])
    small = total[half] - total[np.searchsorted(x, edge)]
    found = number[-1] - number[half] + np.maximum(0, -(-(small - room) // capacity))
    return int(max(found.max(), -(-total[-1] // capacity)))


def undominated(room: int, lengths: list[int], left: dict[int, int], most_waste: int, budget: Budget) -> list[tuple[int, Filling]]:
    """(waste, filling) of `room` by the remaining lengths (ascending), least waste first, at most `most_waste` of it.

    A filling is dominated if a piece left out could replace some of its pieces, or one shorter piece, and still fit: the
    others are at least as easy to place elsewhere.
    """
    found: list[tuple[int, Filling]] = []
    chosen: list[tuple[int, int]] = []
    below = [0]
    for x in lengths:
        below.append(below[-1] + x * left[x])

    def dominated(waste: int) -> bool:
        used = dict(chosen)
        out = [x for x in lengths if left[x] > used.get(x, 0) and x <= room]
        sums, several = 1, 0  # bit t: some pieces, or two and more, add up to t
        for x, k in chosen:
            for _ in range(k):
                several |= (several << x) | (sums >> 1 << (1 + x))
                sums |= sums << x
        for x in out:
            if x <= waste:
                return True
            low = max(1, x - waste)
            if any(low <= y < x for y in used) or several >> low & ((1 << (x - low + 1)) - 1):
                return True
        return False

    def search(room: int, top: int) -> None:
        if room <= most_waste and not dominated(room):
            found.append((room, list(chosen)))
        for i in range(bisect_right(lengths, room, 0, top) - 1, -1, -1):
            if room - below[i + 1] > most_waste:
                return
            x = lengths[i]
            for k in range(min(left[x], room // x), 0, -1):
                if not budget.take():
                    return
                chosen.append((x, k))
                search(room - k * x, i)
                chosen.pop()

    search(room, len(lengths))
    return sorted(found, key=lambda f: (f[0], [(-x, -k) for x, k in f[1]]))


def branch_and_bound(counts: dict[int, int], capacity: int, fewer_than: int, least: int, budget: Budget) -> list[Filling] | None:
    """A plan of less than `fewer_than` sequences, as few as there can be unless the budget is spent; None if there is none.

    The longest piece left is completed by every undominated filling in turn; the waste so far and that of the filling must
    leave fewer sequences possible than the best plan has, and states met before with no more sequences are not met again.
    """
    total = sum(x * n for x, n in counts.items())
    best: list = [fewer_than, None]
    seen: dict[tuple, int] = {}
    path: list[Filling] = []

    def go(left: dict[int, int], waste: int) -> None:
        if not left:
            best[0], best[1] = len(path), list(path)
            return
        state = tuple(sorted(left.items()))
        if seen.get(state, fewer_than) <= len(path) or len(path) + least_sequences(left, capacity) >= best[0]:
            return
        seen[state] = len(path)
        budget.left -= len(left)
        top = max(left)
        rest = {x: n - (x == top) for x, n in left.items() if n > (x == top)}
        spare = (best[0] - 1) * capacity - total - waste
        for w, filling in undominated(capacity - top, sorted(rest), rest, min(spare, capacity), budget):
            if best[0] <= least or budget.spent or waste + w > (best[0] - 1) * capacity - total:
                return
            own = {top: 1}
            for x, k in filling:
                own[x] = own.get(x, 0) + k
            after = {x: n - own.get(x, 0) for x, n in left.items() if n > own.get(x, 0)}
            path.append(sorted(own.items(), reverse=True))
            go(after, waste + w)
            path.pop()

    if total:
        go(dict(counts), 0)
    return best[1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[int, Filling]], bool]:
    """(times, filling) rows that use every piece exactly once, and whether no plan can have fewer sequences.

    counts gives the pieces of each length. The incumbent is the better of best fit and least-waste completion. While it
    has more sequences than the lower bound, its most wasteful sequences are taken apart, twice as many each time, and
    packed anew by branch and bound, up to all of them. `nodes` bounds the branches of each search; the flag tells
    if it ever cut one short of a proof.
    """
    size = lambda p: sum(t for t, _ in p)
    best = min((_repeat(counts, capacity, f) for f in (lambda *a: complete(*a, Budget(COMPLETE)), _best_fit)), key=size)
    least, budget = least_sequences(counts, capacity), Budget(nodes)
    window = 8
    while size(best) > least and not budget.spent:
        best.sort(key=lambda row: -(capacity - sum(x * k for x, k in row[1])))
        apart: dict[int, int] = {}
        kept, opened = [], 0
        for times, filling in best:
            n = min(times, window - opened)
            opened += n
            for x, k in filling:
                if n:
                    apart[x] = apart.get(x, 0) + k * n
            if times > n:
                kept.append((times - n, filling))
        again = branch_and_bound(apart, capacity, opened, max(least_sequences(apart, capacity), least - size(kept)), budget)
        if again is not None:
            best = kept + [(1, f) for f in again]
        elif not kept:
            return best, not budget.spent
        elif window > DEEPEST:
            break
        else:
            window *= 2
    return best, size(best) == least


def _deal(solution: list[tuple[int, Filling]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: rows (length, first rank, first sequence, copies in a sequence, first offset)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, filling in solution:
        offset = 0
        for x, k in filling:
            rows.append((x, used.get(x, 0), base, k, offset))
            used[x] = used.get(x, 0) + k * times
            offset += k * x
        base += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "copies", "offset"), cols, strict=True))


def _place(dealt: dict[str, np.ndarray]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = dealt["length"] << 40 if len(dealt["length"]) else np.empty(0, dtype=np.int64)
        first = np.searchsorted(dealt["length"], dealt["length"])
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(lead + dealt["rank"], (length << 40) + rank, side="right") - 1
            assert (at >= first[at]).all()
            k = rank - dealt["rank"][at]
            n = dealt["copies"][at]
            cols = [c for c, x in zip(batch.columns, batch.schema.names, strict=True) if x != "rank"]
            names = [x for x in batch.schema.names if x != "rank"]
            sequence, offset = dealt["base"][at] + k // n, dealt["offset"][at] + k % n * length
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return kernel


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text), and proved."""
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    solution, proved = plan(counts, capacity)
    dealt = _deal(solution)
    buckets = max(1, sum(counts.values()) // 50_000)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    order = ranked(keyed, ["length"], ["bucket"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = order.select(*names, "rank").mapInArrow(tidy(_place(dealt)), _PIECES + ", sequence_id long, offset long")
    return placed.withColumn("proved", F.lit(proved))


def sequences(docs: DataFrame, packing: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (at most `capacity` ids, uint32 bytes)."""
    own = pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    same = [own[c].eqNullSafe(packing[c]) for c in ("doc_id", "piece", "ids_crc32")]
    joined = packing.join(own, same).select("sequence_id", "offset", "ids")
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE: dict[str, str] = {}
