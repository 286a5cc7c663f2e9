"""Overlap of training records with evaluation records, and what must go with them.

A pair matches only if at least 87 % of the smaller one's n-grams are in the other (a
Jaccard similarity of 77 % implies that).  So of the evaluation record's rarest n-grams a
stated number must be met: only these are looked up, and what passes is counted in full.
Evaluation records up to a checked size are counted inside the scan of the training
records, without any shuffle; larger sets are joined on hashes of the rare n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.functions.text import char_ngrams, ngrams, ppm_half_even, sha, words
from veraline.operators.graph import connected_components
from veraline.plans.store import small_batches, tidy

# N-gram sizes, least lengths and thresholds of the decision.
CHAR_SIZE, TOKEN_SIZE = 5, 3
MIN_EXACT, MIN_FUZZY = 16, 32
JACCARD, CONTAINMENT, MARGIN = 820_000, 920_000, 50_000
KIND_ORDER = ("exact", "fuzzy", "review")
#: Characters of evaluation records that driver and workers hold; the share of n-grams that a match may lack, rounding included, and the further share that is looked up.
HELD_CHARS, LACK, LOOK = 4_000_000, 0.1301, 0.2
#: What a worker holds at most, whatever the texts are: tokens whose hash it remembers, characters of such a token, pairs it gives out at once (and those of one more record).
KNOWN, KNOWN_CHARS, PAIRS = 200_000, 32, 20_000

_rng = np.random.default_rng(41)
_SLOT = _rng.integers(1, 2**63, max(CHAR_SIZE, TOKEN_SIZE), dtype=np.uint64) | np.uint64(1)


def fingerprints(rows: DataFrame, key: str, text: str, normal=None) -> DataFrame:
    """(key, norm, norm_sha, norm_chars, char_grams, token_grams) of each row with a non-empty normal form.

    normal: a column function to the normal form; default: words joined by a space.
    """
    norm = (normal or (lambda c: F.array_join(words(c), " ")))(F.col(text))
    base = rows.select(key, norm.alias("norm")).where(F.col("norm") != "")
    return base.select(
        key, "norm", sha(F.col("norm")).alias("norm_sha"), F.length("norm").alias("norm_chars"), char_ngrams(F.replace("norm", F.lit(" "), F.lit("")), CHAR_SIZE).alias("char_grams"), ngrams(F.split("norm", " "), TOKEN_SIZE).alias("token_grams")
    )


def _mixed(units: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of n units; one of all units if there are fewer."""
    n = min(n, len(units))
    h = np.full(len(units) - n + 1, np.uint64(n))
    for k in range(n):
        h += units[k : len(units) - n + 1 + k] * _SLOT[k]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(29)))


def _hashed(token: str, known: dict[str, int]) -> int:
    """The hash of a token, remembered if the token is short; long ones (scripts without spaces, encoded data) would fill the memory."""
    h = xxhash.xxh3_64_intdigest(token)
    if len(token) <= KNOWN_CHARS:
        if len(known) >= KNOWN:
            known.clear()
        known[token] = h
    return h


def hashed_grams(norm: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(character n-grams, token n-grams) of a normal form as hashes.  known: tokens met before."""
    tokens = np.array([known.get(t) or _hashed(t, known) for t in norm.split(" ")], np.uint64)
    chars = np.frombuffer(norm.replace(" ", "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    # a code point spread over all bits, so that sums of few of them don't meet
    chars = (chars + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return _mixed(chars ^ (chars >> np.uint64(27)), CHAR_SIZE), _mixed(tokens, TOKEN_SIZE)


def _lists(owner: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, where the list of each begins, its length, owners list by list)."""
    order = np.argsort(gram, kind="stable")
    grams, first, sizes = np.unique(gram[order], return_index=True, return_counts=True)
    return grams, first, sizes, owner[order]


def _met(lists: tuple, grams: np.ndarray, owners: int) -> np.ndarray:
    """How many of the grams each owner lists."""
    known, first, sizes, owner = lists
    at = np.searchsorted(known, grams)
    at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == grams)]
    n = sizes[at]
    ends = np.cumsum(n)
    return np.bincount(owner[np.repeat(first[at] - (ends - n), n) + np.arange(n.sum())], minlength=owners)


class Held:
    """The evaluation records' n-grams of one kind: their lists, and those of each record's rarest."""

    def __init__(self, grams: list[np.ndarray]):
        self.grams = grams
        self.sizes = np.array([len(g) for g in grams])
        owner, flat = np.repeat(np.arange(len(grams)), self.sizes), np.concatenate(grams)
        self.every = _lists(owner, flat)
        known, _, counts, _ = self.every
        rare = []
        lack = np.floor(LACK * self.sizes).astype(int)
        looked = np.minimum(self.sizes, lack + np.maximum(1, np.ceil(LOOK * self.sizes).astype(int)))
        for g, n in zip(grams, looked, strict=True):
            rare.append(g[np.lexsort((g, counts[np.searchsorted(known, g)]))[:n]])
        self.rare, self.least = _lists(np.repeat(np.arange(len(grams)), looked), np.concatenate(rare)), looked - lack

    def candidates(self, grams: np.ndarray) -> np.ndarray:
        """Records of which enough is met; a training record with fewer n-grams than some of them is counted in full for these."""
        found = (_met(self.rare, grams, len(self.sizes)) >= self.least) & (self.sizes <= len(grams))
        larger = self.sizes > len(grams)
        if larger.any():
            found |= larger & (_met(self.every, grams, len(self.sizes)) >= (1 - LACK) * len(grams))
        return np.flatnonzero(found)


def _counted_in_scan(train: DataFrame, evaluation: DataFrame, train_key: str, eval_key: str) -> DataFrame:
    """Pairs of equal normal forms (same = 1) and those that may match, with counts; the evaluation records are held by every worker."""
    spark = train.sparkSession
    table = evaluation.where(F.col("norm_chars") >= MIN_EXACT).select(eval_key, "norm", "norm_chars").toArrow()  # HELD_CHARS characters at most
    schema = T.StructType([T.StructField(train_key, train.schema[train_key].dataType), T.StructField(eval_key, evaluation.schema[eval_key].dataType), T.StructField("same", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in COUNTS)])
    norms = table.column("norm").to_pylist()
    if not norms:
        return spark.createDataFrame([], schema)
    equal: dict[str, list[int]] = {}
    for j, norm in enumerate(norms):
        equal.setdefault(norm, []).append(j)
    long = np.flatnonzero(table.column("norm_chars").to_numpy() >= MIN_FUZZY)
    known: dict[str, int] = {}
    grams = [hashed_grams(norms[j], known) for j in long]
    held = spark.sparkContext.broadcast((table.column(0).combine_chunks(), equal, long, [Held([g[k] for g in grams]) for k in (0, 1)] if grams else None))

    def run(batches):
        keys, equal, long, kinds = held.value
        met: dict[str, int] = {}

        def told(batch, rows, owners, counts):
            columns = list(zip(*counts, strict=True)) if counts else [[]] * 7
            arrays = [pa.array(columns[0], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[1:])]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), keys.take(pa.array(owners, pa.int64())), *arrays], names=schema.names)

        for batch in batches:
            rows, owners, counts = [], [], []
            for i, (norm, chars) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if len(rows) >= PAIRS:
                    yield told(batch, rows, owners, counts)
                    rows, owners, counts = [], [], []
                same = equal.get(norm, ())
                for j in same:
                    rows.append(i)
                    owners.append(j)
                    counts.append((1, 0, 0, 0, 0, 0, 0))
                if chars < MIN_FUZZY or not kinds:
                    continue
                own = hashed_grams(norm, met)
                for k in np.union1d(*(kind.candidates(g) for kind, g in zip(kinds, own, strict=True))).tolist():
                    if long[k] not in same:
                        rows.append(i)
                        owners.append(int(long[k]))
                        both = [len(np.intersect1d(g, kind.grams[k], assume_unique=True)) for g, kind in zip(own, kinds, strict=True)]
                        counts.append((0, *both, len(own[0]), len(own[1]), *(int(kind.sizes[k]) for kind in kinds)))
            yield told(batch, rows, owners, counts)

    return train.where(F.col("norm_chars") >= MIN_EXACT).select(train_key, "norm", "norm_chars").mapInArrow(tidy(run), schema)


COUNTS = ("char_both", "token_both", "c1", "t1", "c2", "t2")


def shared_grams(train: DataFrame, evaluation: DataFrame, train_key: str, eval_key: str) -> DataFrame:
    """What _counted_in_scan() gives, for evaluation records of any size: a join on hashes of rare n-grams, then counts of the candidates.

    Rare is what few evaluation records have.  The side with fewer n-grams of a pair looks
    its rarest up in the other.
    """

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("norm_chars") >= MIN_FUZZY).withColumns({k: F.transform(f"{k}_grams", lambda g: F.xxhash64(g)) for k in ("char", "token")})

    def exploded(rows: DataFrame, key: str, n: str) -> DataFrame:
        kinds = [rows.select(key, F.lit(i).alias("kind"), F.size(k).alias(n), F.explode(k).alias("gram")) for i, k in enumerate(("char", "token"))]
        return kinds[0].unionByName(kinds[1])

    a, b = hashed(train), hashed(evaluation)
    own, other = exploded(a, train_key, "n1"), exploded(b, eval_key, "n2")
    spread = other.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    lack = lambda n: F.floor(F.lit(LACK) * F.col(n))
    looked: Column = lambda n: F.least(F.col(n).cast("long"), lack(n) + F.greatest(F.lit(1), F.ceil(F.lit(LOOK) * F.col(n))))

    def rarest(rows: DataFrame, key: str, n: str) -> DataFrame:
        ranked = rows.join(spread, ["kind", "gram"], "left").withColumn("r", F.expr(f"row_number() over (partition by {key}, kind order by coalesce(df, 0), gram)"))
        return ranked.where(F.col("r") <= looked(n)).select(key, "kind", n, "gram")

    def enough(pairs: DataFrame, n: str) -> DataFrame:
        met = pairs.groupBy(train_key, eval_key, "kind", n).agg(F.count("*").alias("met"))
        return met.where(F.col("met") >= looked(n) - lack(n)).select(train_key, eval_key)

    down = enough(rarest(other, eval_key, "n2").join(own, ["kind", "gram"]).where("n2 <= n1"), "n2")
    up = enough(rarest(own, train_key, "n1").join(other, ["kind", "gram"]).where("n1 < n2"), "n1")
    both = down.union(up).distinct().join(a.select(train_key, F.col("char").alias("ca"), F.col("token").alias("ta")), train_key).join(b.select(eval_key, F.col("char").alias("cb"), F.col("token").alias("tb")), eval_key)
    sizes = (F.size(F.array_intersect("ca", "cb")), F.size(F.array_intersect("ta", "tb")), F.size("ca"), F.size("ta"), F.size("cb"), F.size("tb"))
    return both.select(train_key, eval_key, *(n.cast("long").alias(x) for n, x in zip(sizes, COUNTS, strict=True)))


def scan(train: DataFrame, evaluation: DataFrame, train_key: str, eval_key: str) -> DataFrame:
    """One row per matching pair of fingerprints(): kind and the four scores in ppm.

    Workers that normalise and count get small batches of texts, whatever the table's size.
    """
    held = evaluation.agg(F.coalesce(F.sum("norm_chars"), F.lit(0))).first()[0] <= HELD_CHARS
    small_batches(train.sparkSession)
    if held:
        scored = _counted_in_scan(train, evaluation, train_key, eval_key)
    else:
        exact = train.where(F.col("norm_chars") >= MIN_EXACT).select(train_key, "norm_sha").join(evaluation.select(eval_key, "norm_sha"), "norm_sha").select(train_key, eval_key, F.lit(1).alias("same"))
        scored = shared_grams(train, evaluation, train_key, eval_key).join(exact, [train_key, eval_key], "full").na.fill(0, ["same", *COUNTS])
    score = {}
    for k in ("character", "token"):
        both, a, b = F.col("char_both" if k == "character" else "token_both"), F.col(f"{k[0]}1"), F.col(f"{k[0]}2")
        score[f"{k}_jaccard_ppm"] = ppm_half_even(both, a + b - both)
        score[f"{k}_containment_ppm"] = ppm_half_even(both, F.least(a, b))
    for name, value in score.items():
        scored = scored.withColumn(name, F.when(F.col("same") == 1, F.lit(1_000_000).cast("long")).otherwise(value))
    jaccard, containment = F.greatest("character_jaccard_ppm", "token_jaccard_ppm"), F.greatest("character_containment_ppm", "token_containment_ppm")
    near = lambda less: (jaccard >= JACCARD - less) | (containment >= CONTAINMENT - less)
    kind = F.when(F.col("same") == 1, "exact").when(near(0), "fuzzy").when(near(MARGIN), "review")
    return scored.withColumn("kind", kind).where("kind is not null").select(train_key, eval_key, "kind", *score)


def best_match(matches: DataFrame, train_key: str, eval_key: str) -> DataFrame:
    """The strongest match of each training record: by kind, then score, then evaluation id."""
    strongest = F.greatest("character_jaccard_ppm", "token_jaccard_ppm", "character_containment_ppm", "token_containment_ppm")
    order = F.struct(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")).alias("k"), (-strongest).alias("s"), F.col(eval_key).alias("e"))
    return matches.groupBy(train_key).agg(F.min_by(F.struct(eval_key, "kind", strongest.alias("strongest_ppm")), order).alias("m")).select(train_key, "m.*")


def family_components(records: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """(key, component): records that share a family in any dimension, transitively; component is the smallest key.

    Each record is linked to the smallest key of its family, so a family of any size
    gives one edge per record.
    """
    edges = None
    for d in dimensions:
        least = records.groupBy(d).agg(F.min(key).alias("least"))
        own = records.join(least, d).select(F.col(key).alias("src"), F.col("least").alias("dst"))
        edges = own if edges is None else edges.union(own)
    return connected_components(edges).withColumnRenamed("node", key)


def quarantine(components: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Keys of all records whose component holds a match."""
    seeds = components.join(matches.select(key).distinct(), key, "left_semi").select("component").distinct()
    return components.join(seeds, "component", "left_semi").select(key, "component")
