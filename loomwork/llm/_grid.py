"""Queries against all rows, in blocks: packed matrices, and the grid of (query block, row block) that tasks share out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm._common import discard, materialize

#: Row blocks that one task compares with a query block.
A_CELL = 8


def packed(a: np.ndarray) -> bytes:
    """A matrix's bytes, in the smallest type that holds its values exactly; `unpacked` reads them."""
    if a.dtype.kind in "iu":
        low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
        kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    else:
        kind = "f4" if (a == a.astype(np.float32)).all() else "f8"
    return kind.encode() + np.ascontiguousarray(a).astype("<" + kind).tobytes()


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    a = np.frombuffer(raw, dtype="<" + raw[:2].decode(), offset=2)
    return a.reshape(rows, -1) if rows else a.reshape(0, 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of numbers; shorter ones end in zeros."""
    place = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[place[0] : place[-1]]
    size = np.diff(place)
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def numbered(blocks: DataFrame, key: str, out: str) -> DataFrame:
    """A written table of blocks (a row holds a thousand rows or so) with 0-based numbers in place of its unique key."""
    number = materialize(blocks.select(key).withColumn(out, (F.row_number().over(Window.orderBy(key)) - 1).cast("int")), "numbers")
    done = materialize(blocks.join(number, key).drop(key), "numbered")
    discard(blocks, number)
    return done


def grid(asked: DataFrame, held: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Each row of asked (block, ...) with each row of held (no, ...) that agrees in `on`: packed blocks, numbered from 0.

    A task gets cells of one query block and `A_CELL` row blocks, so rows travel once for each query block and
    queries once for each cell, whatever the number of either.
    """
    on = on or []
    wide, high = (asked.agg(F.max("block")).first()[0] or 0) + 1, (held.agg(F.max("no")).first()[0] or 0) + 1
    cells = -(-high // A_CELL)
    a = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    h = held.withColumn("cell", F.pmod("no", F.lit(cells)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    key = [*on, "block", "cell"]
    return a.repartition(wide * cells, *key).join(h.repartition(wide * cells, *key), key)
