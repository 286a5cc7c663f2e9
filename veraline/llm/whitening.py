"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed: each pass over the distinct vectors multiplies it with a
block of directions (centre, project, project back, sum), and a block tridiagonal
matrix of the passes' results gives eigenvalues and eigenvectors.  New blocks are made
orthogonal to all earlier ones, twice.  Where a block breaks down (the space found so far
is closed, or directions coincide) random directions orthogonal to all others take the
place of those that are missing.  Passes end when the residual of each wanted pair is a
rounding error, or when the directions fill the space.

Integer sums, counts and deviations are exact; the trace is a sum of deviations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.llm.common import one_blas_thread, tidy
from veraline.plans.store import discard, materialize

COMPONENTS, SCALE, BLOCK, SEED = 4, 256, 8, 12
#: Residual of a pair, and smallest eigenvalue of a direction that varies, as shares of the largest eigenvalue.
CLOSE, FLAT = 1e-14, 1e-12
#: Rows that a task turns into a matrix at once.
AT_ONCE = 4096
_LIMIT = 1 << 62


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pieces(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(a, AT_ONCE)


def quantized(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, width, x): rows whose vectors are not null and hold no null and no non-finite entry, x = floor(scale * entry) as whole numbers (held within 2^62)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.clip(np.floor(scale * values), -_LIMIT, _LIMIT).astype(np.int64)
            sizes = lists.value_lengths()
            ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["vec_id", "width", "x"])

    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    used = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    return used.mapInArrow(tidy(run), "vec_id long, width int, x array<long>")


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, None
        for batch in _pieces(batches):
            x = _matrix(batch.column(0))
            # halves of 32 bits: no sum of a batch leaves 64 bits
            part = [int(h) * 2**32 + int(lo) for h, lo in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
            n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total])], names=["n", "k", "s"])

    parts = fit.select("x").mapInArrow(tidy(run), "n long, k int, s string")
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()  # a row per dimension
    return found[0]["n"], [int(r["s"]) for r in found]


def _added(fit: DataFrame, of, columns: int) -> np.ndarray:
    """The sum over all rows of of(matrix of a batch), a matrix of `columns` columns; added up in the JVM, so that a row of it alone comes to the driver."""

    def run(batches):
        total = None
        for batch in _pieces(batches):
            part = of(_matrix(batch.column(0)))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(c) for c in total.T)], names=["k", *(f"c{j}" for j in range(columns))])

    parts = fit.select("x").mapInArrow(tidy(run), "k int, " + ", ".join(f"c{j} double" for j in range(columns)))
    rows = parts.groupBy("k").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(columns))).orderBy("k").collect()
    return np.array([r[1:] for r in rows], np.float64)


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(q, r): the block with its parts along basis taken out, as q @ r with orthonormal q.

    Directions of the block that are missing are drawn anew, as long as the space has any; r says nothing of those.
    """
    d, width = block.shape
    scale = np.linalg.norm(block, axis=0).max(initial=0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, vt = np.linalg.svd(block, full_matrices=False)
    held = s > max(scale, np.finfo(float).tiny) * 1e-13
    q, r = u[:, held], s[held, None] * vt[held]
    more = min(width, d - basis.shape[1]) - q.shape[1]
    whole = np.hstack([basis, q])
    for _ in range(max(more, 0)):
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= whole @ (whole.T @ v)
            v /= np.linalg.norm(v)
        whole = np.hstack([whole, v[:, None]])
    q = whole[:, basis.shape[1] :]
    for _ in range(2):
        q -= basis @ (basis.T @ q)
    return q, np.vstack([r, np.zeros((q.shape[1] - len(r), width))])


def leading_pairs(multiply, d: int, k: int, block: int = BLOCK, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(the k largest eigenvalues, falling; eigenvectors as columns; passes) of a symmetric operator on d dimensions.

    multiply(q) gives the product with a matrix of directions; each call is a pass.
    """
    one_blas_thread()
    rng = np.random.default_rng(seed)
    k = min(k, d)
    block = min(max(block, k), d)
    q, _ = _orthogonal(rng.standard_normal((d, block)), np.zeros((d, 0)), rng)
    basis, images, passes = q, np.zeros((d, 0)), 0
    while True:
        images = np.hstack([images, multiply(q)])
        passes += 1
        projected = basis.T @ images
        values, vectors = np.linalg.eigh((projected + projected.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        residual = np.linalg.norm(images @ vectors - basis @ vectors * values, axis=0)
        if basis.shape[1] >= d or (residual <= CLOSE * max(abs(values[0]), np.finfo(float).tiny)).all():
            return values, basis @ vectors, passes
        # the image of the last block leaves the space that it was found in by the next one
        q, _ = _orthogonal(images[:, -q.shape[1] :], basis, rng)
        basis = np.hstack([basis, q])


def _fitted(fit: DataFrame, components: int) -> dict:
    """What rows are whitened by: n, sums, unit directions, eigenvalues, shares and the error of the identity."""
    n, sums = _sums(fit)
    d = len(sums)
    mean = np.array([s / n for s in sums])
    centred = lambda x: x - mean

    def multiply(q: np.ndarray) -> np.ndarray:
        def of(x):
            c = centred(x)
            return c.T @ (c @ q)

        return _added(fit, of, q.shape[1]) / n

    values, vectors, _ = leading_pairs(multiply, d, components)
    # the exact deviations of a batch are added up as whole numbers, its total as a double
    deviation = _added(fit, lambda x: np.array([[float(sum(_deviations(x, n, sums, wide=True)))]]), 1)[0, 0]
    trace = deviation / n / n / n
    held = values > FLAT * max(values[0], 0)
    values, vectors = values[held], vectors[:, held]
    out = {"n": n, "sums": sums, "mean": mean, "vectors": vectors / np.linalg.norm(vectors, axis=0), "values": values, "trace": trace, "error": 0.0}
    if len(values):
        white = lambda x: centred(x) @ out["vectors"] / np.sqrt(values)
        k = len(values)
        means = _added(fit, lambda x: white(x).sum(axis=0, keepdims=True), k)[0] / n
        covariance = _added(fit, lambda x: (white(x) - means).T @ (white(x) - means), k) / n
        out["error"] = float(np.abs(covariance - np.eye(k)).max())
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int], wide: bool = False) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)^2; None where it is no 64-bit number, unless `wide`."""
    bound = (n * float(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)) ** 2 * x.shape[1]
    if bound < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if wide or v < 2**63 else None for v in found]


def _applied(rows: DataFrame, width: int, fitted: dict) -> DataFrame:
    """The rows of one width by component."""
    k, model = len(fitted["values"]), rows.sparkSession.sparkContext.broadcast(fitted)  # a few directions

    def run(batches):
        m = model.value
        for batch in _pieces(batches):
            x = _matrix(batch.column(1))
            c = x - m["mean"]
            white = c @ m["vectors"] / np.sqrt(m["values"])
            deviation = _deviations(x, m["n"], m["sums"])
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            each = len(x) * k
            arrays = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(each, m["n"], np.int64)),
                pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                pa.array(white.ravel()),
                pa.array(np.tile(m["values"] / m["trace"], len(x))),
                pa.array(np.full(each, m["error"])),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.where(F.col("width") == width).select("vec_id", "x").mapInArrow(tidy(run), WHITENED)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out.  Entries
    become x = floor(256 * entry); each distinct x counts once for the n vectors, sums S
    and covariance (divisor n) that all rows are whitened by.  Components are the unit
    eigenvectors of the covariance, numbered by falling eigenvalue, as many as there are
    up to `components`: directions without variance have none, so one distinct vector, or vectors of
    no entries, give no rows.  deviation is the exact sum of (n * x - S)^2, null where
    that is no 64-bit number.  Vectors of different lengths are whitened among their own.
    Repeated and null vec_ids are rows like others; other columns are left out.
    """
    spark = rows.sparkSession
    table = materialize(quantized(rows), "quantized")
    out = spark.createDataFrame([], WHITENED)
    for width in [r["width"] for r in table.where("width > 0").select("width").distinct().orderBy("width").collect()]:  # lengths, not rows
        fit = materialize(table.where(F.col("width") == width).select("x").distinct(), "distinct-vectors")
        fitted = _fitted(fit, components)
        discard(fit)
        if len(fitted["values"]):
            out = out.unionByName(_applied(table, width, fitted))
    return out
