"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles.  At each level a set chooses those of
its tokens whose hash falls below c / size: sets that overlap by 0.8 choose a common
token unless chance fails all of them, and follow it into one bucket.  Small buckets
are brute-forced; large ones are split again, up to the last level.  Below the first
level the hash is of the path and the token, so each path of a set chooses anew, from
those of its tokens that one more hash puts below SAMPLED / size: two sets agree on
these as they do on all, and a long document travels as a few hundred bytes.  Runs
with fresh hashes are repeated until the missed share is below 1 - target recall.
In the buckets, 16-bit min-hash sketches tell which sets may be near; the groups so
found are then verified exactly, whole set against whole set, in blocks of bounded
size.

Equal sets are one set with a count, from the first step on.  Sets and tokens are
32-bit hashes of shingles: that two different shingles meet in one hash changes a
similarity with a chance of about 2e-5 for each pair of 300-word texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.llm.blocks import dealt, groups, matrix, stars
from veraline.llm.common import WORD, Recent, small_batches, tidy
from veraline.operators.graph import connected_components
from veraline.plans.store import discard, fresh, materialize

WORDS, SIMILARITY, TARGET_RECALL = 5, 0.8, 0.9995
#: Expected choices of a set at the first level and at later ones; levels; rows of a bucket that is brute-forced at once.
FIRST, LATER, LEVELS, LEAF = 5.5, 2.0, 4, 400
#: Expected tokens of a set that later levels choose from.
SAMPLED = 192
SKETCH, MAYBE = 64, 0.55
#: One-bit sketch positions that tell a bucket's mean similarity, and the mean from which it isn't split further.
SIGNS, ALIKE = 32, 0.5
CHUNK = 192

_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)
_SLOT = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


def runs_needed(target: float = TARGET_RECALL, similarity: float = SIMILARITY) -> int:
    """Repeats until a pair at the threshold is missed by all with at most 1 - target.

    A run misses when the branching process of common choices dies out; later levels
    only count for pairs in large buckets, so their chance is the bound.  How many of
    the SAMPLED tokens a pair shares is one draw for all runs: the bound is its mean.
    """
    shared = SAMPLED * similarity  # |x & y| / max(|x|, |y|) is no less than the Jaccard similarity
    counts = np.arange(max(0, int(shared - 6 * math.sqrt(shared))), int(shared + 6 * math.sqrt(shared)))
    weights = np.exp(counts * math.log(shared) - shared - np.array([math.lgamma(k + 1) for k in counts]))
    dies = np.zeros(len(counts))
    for _ in range(500):
        dies = np.exp(-LATER * counts / SAMPLED * (1 - dies))
    for runs in range(1, 100):
        if weights @ np.exp(-runs * FIRST * similarity * (1 - dies)) <= (1 - target) * weights.sum():
            return runs
    raise ValueError("no number of runs reaches the target recall")


RUNS = runs_needed()
_RUN_MUL = _rng.integers(1, 2**32, (RUNS, 1), dtype=np.uint32) | np.uint32(1)
_RUN_ADD = _rng.integers(0, 2**32, (RUNS, 1), dtype=np.uint32)
_SAMPLE_MUL, _SAMPLE_ADD = _rng.integers(1, 2**32, 2, dtype=np.uint32) | np.uint32(1)
_TOKEN_MUL, _NEXT = _rng.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Recent:
    return Recent(lambda w: xxhash.xxh3_64_intdigest(w).to_bytes(8, "little"), 60_000)


def shingles(text: str | None, kept: Recent, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of runs of `words` lower-case words; all words if there are fewer; none of none."""
    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.uint32)
    h = _mix(np.frombuffer(b"".join(map(kept.__getitem__, found)), dtype="<u8"))
    n = min(words, len(h))
    total = h[: len(h) - n + 1] * _SLOT[0] + np.uint64(n)
    for k in range(1, n):
        total += h[k : len(h) - n + 1 + k] * _SLOT[k]
    out = (_mix(total) >> np.uint64(32)).astype(np.uint32)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _sketch(x: np.ndarray) -> bytes:
    least = np.full(SKETCH, np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 2048):
        least = np.minimum(least, (x[a : a + 2048, None] * _MUL + _ADD).min(axis=0))
    return (_mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _chosen(x: np.ndarray) -> np.ndarray:
    """The paths of the first level, int64 of run * 2**32 + token."""
    k, i = np.nonzero(x[None, :] * _RUN_MUL + _RUN_ADD <= np.uint32(min(FIRST / len(x), 1) * (2**32 - 1)))
    return x[i].astype(np.int64) + (k << 32)


def _sample(x: np.ndarray) -> np.ndarray:
    """The tokens that later levels choose from: all of a small set, about SAMPLED of a larger one."""
    return x if len(x) <= SAMPLED else x[x * _SAMPLE_MUL + _SAMPLE_ADD <= np.uint32(SAMPLED / len(x) * (2**32 - 1))]


def _further(x: np.ndarray, size: int, paths: np.ndarray) -> np.ndarray:
    """The paths that the paths of a set of that size lead to: each chooses from the set's sample x by a hash of its own."""
    limit = np.uint64(min(LATER / min(size, SAMPLED), 1) * (2**32 - 1))
    h = _mix(_mix(paths.view(np.uint64) + _NEXT)[:, None] + (x.astype(np.uint64) * _TOKEN_MUL)[None, :])
    return _mix(h[(h >> np.uint64(32)) <= limit] ^ _NEXT).view(np.int64)


def _signs(sketch: bytes) -> int:
    """The lowest bits of the first SIGNS positions of a sketch."""
    return int((np.frombuffer(sketch, "<u2")[:SIGNS] & np.uint16(1)).astype(np.int64) @ (1 << np.arange(SIGNS, dtype=np.int64)))


def _packed(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane: the upper planes are nearly all zero."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


PROFILE = "doc_id long, text_hash long, set_hash long, size int, chosen array<long>, signs long, sketch binary, sample binary, shingles binary"
_KINDS = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def profiles(docs: DataFrame) -> DataFrame:
    """PROFILE of each row; a text without words has a null set_hash.

    A set that its partition has shown before comes as its hash alone, so thousands of
    copies don't travel: the first row of a set in a partition has the rest.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        kept = word_hashes()
        shown: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                x = shingles(text, kept)
                if not len(x):
                    rows.append((None,) * 7)
                    continue
                h = xxhash.xxh3_64_intdigest(x.tobytes())
                h = h - 2**64 if h >= 2**63 else h
                if h in shown:
                    rows.append((h, *(None,) * 6))
                    continue
                sketch = _sketch(x)
                rows.append((h, len(x), _chosen(x), _signs(sketch), sketch, _packed(_sample(x)), _packed(x)))
                if len(shown) < 1_000_000:
                    shown.add(h)
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], names=[x.split()[0] for x in PROFILE.split(", ")])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(tidy(run), PROFILE)


def _sized(members: DataFrame, label: str) -> DataFrame:
    """Members of buckets with two sets or more, and the bucket's size.

    The sizes are a table of their own: a bucket that holds a third of all rows is then
    split among tasks when its members meet its size.
    """
    sizes = materialize(members.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{label}")
    out = materialize(members.join(sizes, "path"), f"paths-{label}")
    discard(sizes)
    return out


def _alike(large: DataFrame) -> DataFrame:
    """(path, dst) of large buckets whose sets are near to each other on the whole: no token tells them apart.

    Two members agree in a one-bit position with a chance of a half and half their
    similarity, so the shares of ones tell the bucket's mean similarity; its members
    are only summed.  dst: the bucket's smallest set.
    """
    bits = [F.sum(F.col("signs").bitwiseAND(F.lit(1 << k)) / F.lit(1 << k)).alias(f"b{k}") for k in range(SIGNS)]
    summed = large.groupBy("path").agg(F.count("*").alias("m"), F.min("set_hash").alias("dst"), *bits)
    mean = sum((F.pow(2 * F.col(f"b{k}") / F.col("m") - 1, F.lit(2)) for k in range(SIGNS)), F.lit(0.0)) / SIGNS
    return summed.where(mean >= ALIKE).select("path", "dst")


def _split(batches):
    for batch in batches:
        ids, sizes, signs, samples, paths = (batch.column(k) for k in range(5))
        found = [_further(_unpacked(x), n, np.array(p, np.int64)) for n, x, p in zip(sizes.to_pylist(), samples.to_pylist(), paths.to_pylist(), strict=True)]
        if found:
            times = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(pa.array(np.repeat(c.to_numpy(), times)) for c in (ids, signs))], names=["path", "set_hash", "signs"])


def _buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(leaves, edges): (path, n, set_hash) of the small and the last buckets; (src, dst) of those whose sets are alike.

    All of an alike bucket is named as one group, each set by one edge; verification
    looks at whole sets anyway, so no comparison of all its pairs comes before that.
    """
    members = _sized(sets.select(F.explode("chosen").alias("path"), "set_hash", "signs"), "0")
    leaves, edges = [], None
    for level in range(1, LEVELS):
        large = members.where(F.col("n") > LEAF)
        leaves.append(members.where(F.col("n") <= LEAF))
        if large.limit(1).count() == 0:
            return _all(leaves), edges
        alike = materialize(_alike(large), f"alike-{level}")
        named = large.join(alike, "path").select(F.col("set_hash").alias("src"), "dst").distinct()
        edges = named if edges is None else edges.union(named)
        # a set's paths are a list of its own: some dozens, whatever the size of their buckets
        paths = large.join(alike, "path", "left_anti").groupBy("set_hash").agg(F.collect_list("path").alias("paths"))
        each = paths.join(sets, "set_hash").select("set_hash", "size", "signs", "sample", "paths")
        split = materialize(each.mapInArrow(tidy(_split), "path long, set_hash long, signs long"), f"split-{level}")
        members = _sized(split, str(level))
        discard(split)
    leaves.append(members)
    return _all(leaves), edges


def _all(leaves: list[DataFrame]) -> DataFrame:
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out.select("path", "n", "set_hash")


def _near_by_sketch(batches):
    told: set[tuple[int, int]] = set()
    for t in groups(batches, 3):
        own, ids = t.column("vl_own").to_numpy(), t.column("set_hash").to_numpy()
        lo, hi = t.column("vl_lo")[0].as_py(), t.column("vl_hi")[0].as_py()
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(a) or not len(b):
            continue
        x = matrix(t.column("sketch"), SKETCH, "<u2")
        near = np.zeros((len(a), len(b)), bool)
        for k in range(0, len(a), 64):
            near[k : k + 64] = (x[a[k : k + 64], None, :] == x[None, b, :]).sum(axis=2, dtype=np.uint8) >= MAYBE * SKETCH
        if lo == hi:
            np.fill_diagonal(near, False)
        pairs = [p for p in stars(near, ids[a], ids[b]) if p not in told]
        if len(told) < 500_000:
            told.update(pairs)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a x sets b."""
    if len(a) * len(b) <= 9:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in b] for i in a], dtype=np.int64).reshape(len(a), len(b))
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    # tokens of one set alone are in no intersection
    owner = np.repeat(np.arange(len(sets)), sizes)[times[at] > 1]
    place = (np.cumsum(times > 1) - 1)[at[times[at] > 1]]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width, k = 4096, 0
    while k < len(place):
        end = int(np.searchsorted(place, place[k] + width))
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[k:end], place[k:end] - place[k]] = 1
        out += dense[a] @ dense[b].T
        k = end
    return out.astype(np.int64)


def _verified(similarity: float):
    def run(batches):
        for t in groups(batches, 3):
            own, ids, mult = t.column("vl_own").to_numpy(), t.column("set_hash").to_numpy(), t.column("copies").to_numpy()
            lo, hi = t.column("vl_lo")[0].as_py(), t.column("vl_hi")[0].as_py()
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(a) or not len(b):
                continue
            sets = [_unpacked(x) for x in t.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            both = overlaps(sets, a, b)
            near = both >= similarity * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-9
            if lo == hi:
                np.fill_diagonal(near, False)
            links = [(ids[a], near @ mult[b])] + ([(ids[b], mult[a] @ near)] if lo != hi else [])
            pairs = stars(near, ids[a], ids[b])
            node = np.concatenate([x for x, _ in links] + [np.array([p[0] for p in pairs], np.int64)])
            n = np.concatenate([x for _, x in links] + [np.zeros(len(pairs), np.int64)])
            other = pa.array([None] * (len(node) - len(pairs)) + [p[1] for p in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node), other, pa.array(n.astype(np.int64))], names=["src", "dst", "links"])

    return run


def _linked(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, counted, classes, checked): doc_id, text_hash and set_hash of each row; sets with copies and least id; component of linked sets; what verification says."""
    profile = materialize(profiles(docs), "profiles")
    rows = materialize(profile.select("doc_id", "text_hash", "set_hash"), "rows")
    counted = materialize(rows.where("set_hash is not null").groupBy("set_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "sets")
    shown = profile.where("sketch is not null")
    sets = materialize(shown.drop("doc_id", "text_hash", "shingles").dropDuplicates(["set_hash"]), "choices")
    leaves, alike = _buckets(sets)
    maybe = dealt(leaves.join(sets.select("set_hash", "sketch"), "set_hash"), ["path"], "n", "set_hash", LEAF, ["set_hash", "sketch"])
    edges = materialize(maybe.mapInArrow(tidy(_near_by_sketch), "src long, dst long"), "maybe-edges")
    found = materialize(connected_components(edges if alike is None else edges.union(alike)).withColumnRenamed("node", "set_hash"), "maybe")
    discard(sets, edges)
    sizes = materialize(found.groupBy("component").agg(F.count("*").alias("n")), "maybe-sizes")
    active = found.join(sizes, "component").join(counted.select("set_hash", "copies"), "set_hash")
    whole = materialize(active.join(shown.select("set_hash", "shingles"), "set_hash").dropDuplicates(["set_hash"]), "whole-sets")
    discard(profile, found, sizes)
    blocks = dealt(whole, ["component"], "n", "set_hash", CHUNK, ["set_hash", "copies", "shingles"])
    checked = materialize(blocks.mapInArrow(tidy(_verified(similarity)), "src long, dst long, links long"), "verified")
    discard(whole)
    classes = materialize(connected_components(checked.where("dst is not null").select("src", "dst")).withColumnRenamed("node", "set_hash"), "classes")
    return rows, counted, classes, checked


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links.

    n_links: other rows whose shingle sets have a Jaccard similarity of at least
    `similarity`, equal ones included.  class_id: the smallest doc_id reachable by
    links, its own included.  Null, empty and wordless texts link with nothing and
    are their own class.  Null doc_ids have a row and count as links, but no class
    is named after them unless all its ids are null.  Repeated rows link with each
    other.
    """
    rows, counted, classes, checked = _linked(docs, similarity)
    links = checked.where("dst is null").groupBy("src").agg(F.sum("links").alias("links")).where("links > 0").withColumnRenamed("src", "set_hash")
    named = classes.join(counted.select("set_hash", "least"), "set_hash")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("class_id")), "component").select("set_hash", "class_id")
    told = counted.join(named, "set_hash", "left").join(links, "set_hash", "left").select(
        "set_hash", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    # a table of its own, so that the rows of a set that holds a third of all are split among tasks
    out = rows.select("doc_id", "set_hash").join(materialize(told, "told"), "set_hash", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without all but one of each class; wordless texts stay.

    A class is what links connect, whatever the doc_ids of its rows.  The row with its
    smallest doc_id stays, nulls last; of several the one with the smallest hash of its
    text, and one of equal ones.
    """
    rows, _, classes, _ = _linked(docs, similarity)
    same = rows.where("set_hash is not null").groupBy("set_hash", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("kept")
    least = same.groupBy("set_hash").agg(first).join(classes, "set_hash", "left").select(F.coalesce("component", "set_hash").alias("class"), "kept.*")
    own_id, own_text, several = fresh(docs, "id"), fresh(docs, "text"), fresh(docs, "several")
    kept = least.groupBy("class").agg(first).select(F.col("kept.doc_id").alias(own_id), F.col("kept.text_hash").alias(own_text), (F.col("kept.n") > 1).alias(several))
    wordless = rows.where("set_hash is null").select("doc_id", "text_hash", F.lit(False)).distinct()
    keep = materialize(kept.union(wordless), "kept")

    def of(some: DataFrame) -> DataFrame:
        # as many rows as there are classes: dealt by id and text at any size, never sent to all
        return docs.join(some.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_text)), "left_semi")

    out = of(keep.where(~F.col(several)))
    many = keep.where(several)
    if many.limit(1).count():
        out = out.unionByName(of(many).dropDuplicates(["doc_id", "text"]))
    return out
