"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are vectors of the table; their number grows with it.  Each
vector is described by its NEAREST pivots in order.  Inverted lists are kept for every
SHARED pivots of these, within a label: two vectors meet in a list only if they share at
least that many, so what shares fewer never travels, and the lists stay short as the
table grows.  They are verified by cosine in the list of their lowest shared pivots
alone, so a link counts once.  Equal vectors of a label are one node with a count.

In 64 dimensions, two vectors with a cosine of just 0.98 share 3 of 6 with a chance of
0.9995 among 64 pivots and 0.987 among 1,024 (measured on random directions).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.llm.blocks import dealt, groups, stars
from veraline.llm.common import one_blas_thread, tidy
from veraline.operators.graph import connected_components
from veraline.plans.store import discard, materialize

COSINE, NEAREST, SHARED, CHUNK = 0.98, 6, 3, 512
#: Pivots: at least, and at most, what driver and workers hold; between them the cube root of the vectors.
FEWEST, MOST = 64, 1024
#: Vectors that pivots are chosen from, for each pivot, and the cosine above which two are too near to be both pivots.
SAMPLE, APART = 32, 0.8


def pivots_for(vectors: int) -> int:
    return int(min(MOST, max(FEWEST, math.ceil(vectors ** (1 / 3)))))


def usable(v: Column) -> Column:
    """True for a vector that is not null, has no null or non-finite component and isn't zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` vectors of the sample, each the farthest from those before and none near one: a large group of near copies gives one."""
    if not len(sample):
        return sample
    one_blas_thread()
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < most:
        k = int(np.argmin(nearest))
        if nearest[k] > APART:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, x @ x[k])
    return sample[chosen]


def _unit_pivots(width: int, given: np.ndarray, count: int) -> np.ndarray:
    """Unit pivots: the given ones of this width, and seeded directions for the rest."""
    own = np.random.default_rng(width).standard_normal((count, width))
    if given.size and given.shape[1] == width:
        own[: len(given)] = given
    return own / np.linalg.norm(own, axis=1, keepdims=True)


def _described(nodes: DataFrame, pivots: np.ndarray, count: int) -> DataFrame:
    """Each node with its NEAREST pivots, ascending, and a key for every SHARED of them."""
    groups_of = np.array(list(itertools.combinations(range(NEAREST), SHARED)))
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # MOST pivots at most

    def run(batches):
        unit: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            widths = np.diff(offsets)
            near, keys = np.zeros((len(widths), NEAREST), np.int32), np.zeros((len(widths), len(groups_of)), np.int64)
            for width in np.unique(widths).tolist():
                if width not in unit:
                    unit[width] = _unit_pivots(width, shared.value, count)
                at = np.flatnonzero(widths == width)
                x = values[(offsets[at][:, None] + np.arange(width)[None, :])]
                near[at] = np.sort(np.argsort(-(x @ unit[width].T), axis=1, kind="stable")[:, :NEAREST], axis=1)
            for k in range(SHARED):
                keys = keys * count + near[:, groups_of[:, k]]
            as_lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]).astype(np.int32)), pa.array(m.ravel(), kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), as_lists(near, pa.int32()), as_lists(keys, pa.int64())], names=["label", "node", "copies", "v", "near", "keys"])

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select("label", "node", "copies", "v").mapInArrow(tidy(run), f"label long, node long, copies long, v {kind}, near array<int>, keys array<long>")


def _lowest_key(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The key of the SHARED lowest pivots that the rows of a and b, ascending, have in common; -1 if there are fewer."""
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    place = np.cumsum(common, axis=1)
    key = np.zeros(len(a), np.int64)
    for k in range(1, SHARED + 1):
        key = key * count + np.where(common & (place == k), a, 0).sum(axis=1)
    return np.where(place[:, -1] >= SHARED, key, -1)


def _verified(cosine: float, count: int):
    def run(batches):
        for t in groups(batches, 5):
            key, own = t.column("key")[0].as_py(), t.column("vl_own").to_numpy()
            lo, hi = t.column("vl_lo")[0].as_py(), t.column("vl_hi")[0].as_py()
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(a) or not len(b) or (lo == hi and len(a) < 2):
                continue
            ids, copies = (t.column(c).to_numpy() for c in ("node", "copies"))
            pivots = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("near").chunks]).reshape(-1, NEAREST)
            width = t.column("width")[0].as_py()
            x = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in t.column("v").chunks]).reshape(-1, width)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = x[a] @ x[b].T >= cosine
            if lo == hi:
                np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            for k in range(0, len(i), 50_000):
                elsewhere = _lowest_key(pivots[a[i[k : k + 50_000]]], pivots[b[j[k : k + 50_000]]], count) != key
                near[i[k : k + 50_000][elsewhere], j[k : k + 50_000][elsewhere]] = False
            if not near.any():
                continue
            links = [(ids[a], near @ copies[b])] + ([(ids[b], copies[a] @ near)] if lo != hi else [])
            pairs = stars(near, ids[a], ids[b])
            node = np.concatenate([n for n, _ in links] + [np.array([p[0] for p in pairs], np.int64)])
            n = np.concatenate([c for _, c in links] + [np.zeros(len(pairs), np.int64)])
            other = pa.array([None] * (len(node) - len(pairs)) + [p[1] for p in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node), other, pa.array(n.astype(np.int64))], names=["src", "dst", "links"])

    return run


def near_duplicate_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Links join rows of one non-null label and one length whose cosine, in doubles, is at
    least `cosine`; equal rows link too.  Vectors that aren't usable() and null labels
    link with nothing.  component_id is the smallest vec_id reachable, so the row's own
    where there is none; a null vec_id counts as a link but names nothing unless alone.
    Pivots: pivots_for() the number of nodes, of SAMPLE times as many nodes of the commonest
    length that come first by hash, far from each other; seeded directions take the place
    of those that are missing.
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    base = base.withColumn("node", F.when(F.col("label").isNotNull() & usable(F.col("v")), F.xxhash64("label", "v")))
    nodes = base.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = materialize(nodes.withColumn("width", F.size("v")), "vectors")
    widths = nodes.groupBy("width").agg(F.count("*").alias("n"))
    common, total = widths.orderBy(F.desc("n"), "width").first(), widths.agg(F.sum("n")).first()[0] or 0
    count = pivots_for(total)
    given = nodes.where(F.col("width") == (common["width"] if common else 0)).orderBy(F.xxhash64("node", F.lit(1)), "node").limit(SAMPLE * count).select("v").collect()  # SAMPLE * MOST at most
    described = materialize(_described(nodes, spread_out(np.array([r["v"] for r in given], dtype=np.float64), count), count), "described")
    listed = described.select("label", "node", F.size("v").alias("width"), F.explode("keys").alias("key"))
    sizes = materialize(listed.groupBy("label", "width", "key").agg(F.count("*").alias("n")).where("n > 1"), "list-sizes")
    members = listed.join(sizes, ["label", "width", "key"]).join(described.select("node", "copies", "near", "v"), "node")
    blocks = dealt(members, ["label", "width", "key"], "n", "node", CHUNK, ["node", "copies", "near", "v"])
    checked = materialize(blocks.mapInArrow(tidy(_verified(cosine, count)), "src long, dst long, links long"), "vector-links")
    discard(described, sizes)
    links = checked.where("dst is null").groupBy("src").agg(F.sum("links").alias("links")).withColumnRenamed("src", "node")
    classes = connected_components(checked.where("dst is not null").select("src", "dst"))
    named = classes.join(nodes.select("node", "least"), "node")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("name")), "component").select("node", "name")
    told = nodes.select("node", "copies", "least").join(named, "node", "left").join(links, "node", "left").select(
        "node", F.coalesce("name", "least").alias("name"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")
    )
    # a table of its own, so that the rows of a vector that a third of all are copies of are split among tasks
    out = base.select("vec_id", "node").join(materialize(told, "told"), "node", "left")
    component = F.coalesce("name", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


