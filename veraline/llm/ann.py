"""Approximate nearest neighbours by multi-index hashing.

Binary codes come from learned rotations: principal directions of a bounded sample,
turned by iterative quantization from several seeded starts.  Vectors get one more
component that makes all norms equal, so that the largest inner product is the
smallest angle.  Codes are cut into substrings; a block of rows has posting lists for
each substring and key.  If two codes differ in at most r bits, some substring differs
in at most r // substrings: a query reads the lists of its own keys, then those of the
keys one bit away, and so on, and after p steps has met every code within
substrings * (p + 1) - 1 bits.  It stops when that radius holds the codes that the block
owes it, and ranks their vectors in double precision.

Queries are a stated set that is compared with all rows in blocks of bounded size.
Rows are dealt to blocks by hash, so a block owes a query its share of the codes that
are wanted of the whole table, and four standard deviations more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.llm.blocks import groups
from veraline.llm.common import one_blas_thread, tidy
from veraline.llm.vectors import usable
from veraline.plans.store import materialize

BITS, SUBSTRINGS = 256, 32
#: Rows that the rotations are learned from; rows and queries of a block.
SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 4096, 8192, 1024
#: Nearest codes that are ranked for a query: this many, or this many times the root of all rows if that's more.
WITHIN, WITHIN_ROOT = 400, 4.0

_KEYS = np.arange(256, dtype=np.uint8)
#: The keys at each distance from 0; xor with a key gives those at that distance from it.
_AT_DISTANCE = [_KEYS[np.bitwise_count(_KEYS) == p] for p in range(9)]


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(mean, width x bits projection) whose signs are the code."""
    one_blas_thread()
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[: min(64, len(axes))].T
    v = x @ axes
    rng, out = np.random.default_rng(11), []
    while sum(p.shape[1] for p in out) < bits:
        turn, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (left @ right).T
        out.append(axes @ turn)
    return mean, np.concatenate(out, axis=1)[:, :bits]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """rows x bits / 8 bytes; each byte is a substring."""
    return np.packbits((x - mean) @ projection > 0, axis=1)


class Index:
    """Posting lists of a block of codes: for each substring, the rows of each key."""

    def __init__(self, coded: np.ndarray):
        self.n = len(coded)
        self.words = np.ascontiguousarray(coded).view(np.uint64)
        self.rows = np.concatenate([np.argsort(coded[:, s], kind="stable") for s in range(coded.shape[1])])
        counts = np.stack([np.bincount(coded[:, s], minlength=256) for s in range(coded.shape[1])])
        self.sizes = counts.ravel()
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bases = np.arange(coded.shape[1]) * 256

    def within(self, query: np.ndarray, least: int) -> tuple[np.ndarray, int]:
        """(rows of the smallest radius that holds at least `least` codes, or all rows; rows whose codes were met)."""
        asked, least = query.view(np.uint64), min(least, self.n)
        met = np.zeros(self.n, bool)
        rows, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in range(9):
            lists = (self.bases[:, None] + (query[:, None] ^ _AT_DISTANCE[p][None, :])).ravel()
            sizes = self.sizes[lists]
            ends = np.cumsum(sizes)
            found = self.rows[np.repeat(self.first[lists] - (ends - sizes), sizes) + np.arange(ends[-1])]
            before = met.copy()
            met[found] = True
            new = np.flatnonzero(met & ~before)
            rows = np.concatenate([rows, new])
            distance = np.concatenate([distance, np.bitwise_count(self.words[new] ^ asked).sum(axis=1, dtype=np.int64)])
            radius = len(query) * (p + 1) - 1
            if p == 8 or int((distance <= radius).sum()) >= least:
                break
        limit = np.partition(distance, least - 1)[least - 1] if least else -1
        return np.sort(rows[distance <= limit]), len(rows)


def owed(rows: int, total: int, k: int) -> int:
    """Nearest codes that a block of that many rows owes a query."""
    share = max(WITHIN, WITHIN_ROOT * total**0.5) * rows / max(total, 1)
    return max(k + 1 if rows == total else 0, math.ceil(share + 4 * share**0.5) + 1)


def _searched(k: int, mean: np.ndarray, projection: np.ndarray, top: float, total: int):
    def run(batches):
        for t in groups(batches, 2):
            query, ids = t.column("is_query").to_numpy(), t.column("vec_id").to_numpy(zero_copy_only=False)
            v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in t.column("v").chunks]).reshape(len(ids), -1)
            q, x = np.flatnonzero(query), np.flatnonzero(~query)
            if not len(q) or not len(x):
                continue
            lift = np.sqrt(np.maximum(top**2 - (v[x] ** 2).sum(axis=1), 0))
            index = Index(codes(np.column_stack([v[x], lift]), mean, projection))
            # a query's length doesn't change its ranking; scaled to `top` it is coded like the rows
            size = np.linalg.norm(v[q], axis=1)
            asked = codes(np.column_stack([v[q] * (top / size)[:, None], np.zeros(len(q))]), mean, projection)
            out: tuple[list, list, list] = ([], [], [])
            row_ids, floats, least = ids[x], v[x], owed(len(x), total, k)
            for i, row in enumerate(q):
                found, _ = index.within(asked[i], least)
                found = found[row_ids[found] != ids[row]]
                # summed row by row in one order, so that equal vectors have equal scores wherever they lie
                scores = (floats[found] * v[row]).sum(axis=1)
                best = np.lexsort((row_ids[found], -scores))[:k]
                out[0].extend([ids[row]] * len(best))
                out[1].extend(row_ids[found][best].tolist())
                out[2].extend(scores[best].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a number that no other row has, written down."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((np.int64(part) << 33) + np.arange(done, done + n))], names=["vec_id", "v", "row"])
            done += n

    return materialize(rows.mapInArrow(tidy(run), f"vec_id long, v {kind}, row long"), "numbered")


def nearest_of(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query.

    Ranks begin with 1; ties go to the smaller vec_id; a row of the query's own id isn't
    a candidate.  Vectors that aren't usable(), null ids, and lengths other than the
    commonest take no part.  A query of a repeated id is asked once, by its least
    vector; a repeated row of candidates counts once per vec_id, by its best score.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))

    spark = rows.sparkSession
    base = clean(rows)
    width = base.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = _numbered(base.where(F.size("v") == width["w"]))
    asked = _numbered(clean(queries).where(F.size("v") == width["w"]).groupBy("vec_id").agg(F.min("v").alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, top = table.agg(F.count("*"), F.max(norm)).first()
    n_asked = asked.count()
    first = table.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
    sample = np.array([r["v"] for r in first], dtype=np.float64)
    lift = np.sqrt(np.maximum(top**2 - (sample**2).sum(axis=1), 0))
    mean, projection = learn(np.column_stack([sample, lift]))
    row_blocks, query_blocks = -(-n // BLOCK_ROWS), max(1, -(-n_asked // BLOCK_QUERIES))

    def spread(df: DataFrame, is_query: bool) -> DataFrame:
        own, other = ("vl_q", "vl_x") if is_query else ("vl_x", "vl_q")
        mine, others = (query_blocks, row_blocks) if is_query else (row_blocks, query_blocks)
        out = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return out.select("vl_q", "vl_x", F.lit(is_query).alias("is_query"), "vec_id", "v")

    both = spread(table, False).unionByName(spread(asked, True)).repartition("vl_q", "vl_x").sortWithinPartitions("vl_q", "vl_x")
    found = both.mapInArrow(tidy(_searched(k, mean, projection, float(top), n)), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
