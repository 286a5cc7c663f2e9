"""Groups of any size compared in bounded blocks.

A group of n rows is dealt by hash into ceil(n / chunk) chunks; each unordered pair
of chunks is a block of its own, so neither a task nor a worker ever holds a whole
large group, and no pair of rows leaves a block as a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = ["vl_lo", "vl_hi"]


def dealt(rows: DataFrame, key: list[str], size: str, item: str, chunk: int, extra: list[str]) -> DataFrame:
    """rows as blocks: sorted by key, vl_lo, vl_hi; then vl_own (the row's chunk) and the extra columns."""
    n = F.ceil(F.col(size) / chunk).cast("int")
    rows = rows.withColumn("vl_own", F.pmod(F.xxhash64(item, F.lit(7)), n).cast("int")).withColumn("vl_with", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.select(*key, F.least("vl_own", "vl_with").alias("vl_lo"), F.greatest("vl_own", "vl_with").alias("vl_hi"), "vl_own", *extra)
    return rows.repartition(*key, *BLOCK).sortWithinPartitions(*key, *BLOCK)


def groups(batches, n_keys: int):
    """Arrow tables of the consecutive rows that agree in the first n_keys integer columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if held and (keys[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            held.append(batch.slice(a, b - a))
            if k < len(edges) - 2:
                yield pa.Table.from_batches(held)
                held = []
        last = keys[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    """A column of equally long binaries as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def stars(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """(node, least): every node that a true cell of near links, and the smallest id that it's connected to.

    Not every link leaves the block, only an edge for each node of it, and blocks that
    share nodes mostly name the same smallest one.
    """
    left, right = near.shape
    out, seen_r, seen_c = [], np.zeros(left, bool), np.zeros(right, bool)
    for first in np.flatnonzero(near.any(axis=1)).tolist():
        if seen_r[first]:
            continue
        seen_r[first] = True
        todo, in_r, in_c = [first], [first], []
        while todo:
            r = todo.pop()
            for c in np.flatnonzero(near[r] & ~seen_c).tolist():
                seen_c[c] = True
                in_c.append(c)
                more = np.flatnonzero(near[:, c] & ~seen_r).tolist()
                seen_r[more] = True
                in_r += more
                todo += more
        nodes = sorted({*rows[in_r].tolist(), *columns[in_c].tolist()})
        out += [(x, nodes[0]) for x in nodes[1:]]
    return out
