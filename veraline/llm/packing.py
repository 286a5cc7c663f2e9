"""Packing by cutting-stock column generation.

Documents are cut into full sequences and one rest of fewer than `size` tokens.  The
rests' histogram, in classes of 16 tokens, is the demand of a cutting-stock linear
program: Gilmore-Gomory column generation, in which an unbounded knapsack over the
dual prices finds the next pattern.  The rounded-down patterns, and first-fit bins of
the bounded remainder, are dealt to the documents by their rank within their class.
What rounding to classes leaves open in a sequence is filled, to the token, from the
first documents of the order, which the program leaves out for that purpose; what's
left of them makes full sequences and one last that is cut at powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.llm.common import encoder, one_blas_thread, small_batches, tidy, tokenizer_path
from veraline.operators.ordering import running_totals
from veraline.plans.store import materialize, new_path

SIZE, GRAIN, END = 2048, 16, 1
STORED = (
    "part int, start_in_part long, doc_id long, n_tokens long, class int, rank_in_part long, blocks_in_part long, "
    "crcs array<long>, ids array<int>"
)


# --- the linear program: a histogram of at most SIZE / GRAIN classes, on the driver ---


def _knapsack(prices: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of items that may repeat, by dynamic programming over the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(widths, np.arange(room + 1), side="right").tolist()  # widths ascend
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if fitting[w]:
            values = best[w - widths[: fitting[w]]] + prices[: fitting[w]]
            k = int(values.argmax())
            if values[k] > best[w] + 1e-12:
                best[w], last[w] = values[k], k
    pattern, w = np.zeros(len(widths), np.int64), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= widths[last[w]]
    return float(best[room]), pattern


def _fullest(widths: np.ndarray, counts: np.ndarray, room: int) -> list[int]:
    """Items, each as often as there are of it, that fill the room as far as any do; wide ones first."""
    made: dict[int, tuple[int, int]] = {0: (-1, 0)}  # filled: (last item, filled before it)
    for j in np.flatnonzero(counts)[::-1].tolist():
        w = int(widths[j])
        for _ in range(min(int(counts[j]), room // w)):
            new = {s + w: (j, s) for s in made if s + w <= room and s + w not in made}
            if not new:
                break
            made |= new
        if room in made:
            break
    out, s = [], max(made)
    while s:
        j, s = made[s]
        out.append(j)
    return out


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row pivots.

    Not numpy's: its threads were seen to wait for ever in a driver beside a JVM.
    """
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        work -= np.outer(others, work[k])
    return work[:, n:]


def cutting_stock(widths: np.ndarray, demand: np.ndarray, room: int, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns (items per width) and their whole-number uses, which meet the demand exactly."""
    m = len(widths)
    if not m:
        return []
    one_blas_thread()
    basis = np.diag((room // widths).astype(np.float64))
    inverse = np.diag(1 / np.diag(basis))
    for r in range(rounds):
        x = inverse @ demand
        value, pattern = _knapsack(np.maximum(inverse.sum(axis=0), 0), widths, room)
        # the dual prices over `value` are feasible, so x.sum() / value bounds any solution from below
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) < max(0.5, 1e-4 * x.sum()):
            break
        way = inverse @ pattern
        limits = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        k = int(np.argmin(limits))
        if not np.isfinite(limits[k]):
            break
        basis[:, k] = pattern
        if r % 50 == 49:
            inverse = _inverted(basis)
        else:
            row = inverse[k] / way[k]
            inverse -= np.outer(way, row)
            inverse[k] = row
    x = np.floor(np.maximum(inverse @ demand, 0) + 1e-7).astype(np.int64)
    columns = basis.astype(np.int64)
    for k in range(m):  # rounding may not use more than there is
        short = demand - columns @ x
        while (short < 0).any() and x[k] and (columns[short < 0, k] > 0).any():
            x[k] -= 1
            short = demand - columns @ x
    uses = {tuple(columns[:, k]): 0 for k in range(m)}
    for k in range(m):
        uses[tuple(columns[:, k])] += int(x[k])
    rest = demand - columns @ x
    while rest.any():  # at most m patterns' worth of items: the widest, and what fills the room beside it best
        pattern = np.zeros(m, np.int64)
        i = int(np.flatnonzero(rest)[-1])
        pattern[i], rest[i] = 1, rest[i] - 1
        for j in _fullest(widths, rest, room - int(widths[i])):
            pattern[j], rest[j] = pattern[j] + 1, rest[j] - 1
        uses[tuple(pattern)] = uses.get(tuple(pattern), 0) + 1
    return [(np.array(p), n) for p, n in uses.items() if n and any(p)]


# --- tokens ---


def encode(docs: DataFrame, tokenizer: str | None = None) -> str:
    """Token files in the order of doc_id and text hash; returns their folder."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or tokenizer_path()
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches):
        own, part = encoder(path), TaskContext.get().partitionId()
        done, blocks, ranks = 0, 0, np.zeros(SIZE // GRAIN + 1, np.int64)
        for batch in batches:
            flat, sizes = own.encode(batch.column(1), END)
            n = len(sizes)
            classes = -(-(sizes % SIZE) // GRAIN)
            rank = np.zeros(n, np.int64)
            for i, c in enumerate(classes.tolist()):
                rank[i] = ranks[c]
                ranks[c] += 1
            ends, full = np.cumsum(sizes), np.cumsum(sizes // SIZE)
            whole = memoryview(flat.astype("<u4").tobytes())
            crcs = [[zlib.crc32(whole[4 * a : 4 * min(a + SIZE, z)]) for a in range(z - k, z, SIZE)] for k, z in zip(sizes.tolist(), ends.tolist(), strict=True)]
            arrays = [
                pa.array(np.full(n, part, np.int32)), pa.array(done + ends - sizes), batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(classes.astype(np.int32)),
                pa.array(rank), pa.array(blocks + full - sizes // SIZE), pa.array(crcs, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))),
            ]
            done += int(ends[-1]) if n else 0
            blocks += int(full[-1]) if n else 0
            yield pa.RecordBatch.from_arrays(arrays, schema=_arrow(STORED))

    target = new_path(spark, "packed-tokens")
    rows.mapInArrow(tidy(run), STORED).write.options(compression="zstd").orc(target)
    return target


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """PIECES of all documents; see pack_files() for the token files too."""
    return pack_files(docs, tokenizer)[0]


def pack_files(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, str]:
    """(pieces, folder of the token files).

    Null and empty texts are their end id alone.  Null or repeated doc_ids are packed
    like any other row.  An empty table gives no pieces.
    """
    spark = docs.sparkSession
    target = encode(docs, tokenizer)
    stored = spark.read.schema(STORED).orc(target)
    totals = stored.groupBy("part").agg(F.sum("n_tokens"), F.sum(F.floor(F.col("n_tokens") / SIZE))).orderBy("part").collect()  # a row per written partition
    if not totals:
        return spark.createDataFrame([], PIECES), target
    bases, tokens, blocks = [], 0, 0
    for part, n, b in totals:
        bases.append((part, tokens, blocks))
        tokens, blocks = tokens + n, blocks + b
    base = F.broadcast(spark.createDataFrame(bases, "part int, tokens_before long, blocks_before long"))
    meta = stored.join(base, "part").withColumn("stream", F.col("tokens_before") + F.col("start_in_part"))

    # all classes once, to learn what the patterns leave open
    all_counts = {r["class"]: r["n"] for r in stored.where("class > 0").groupBy("class").agg(F.count("*").alias("n")).collect()}  # SIZE / GRAIN rows at most
    all_widths = np.array(sorted(all_counts), dtype=np.int64)
    open_grains = sum(n * (SIZE // GRAIN - int(p @ all_widths)) for p, n in cutting_stock(all_widths, np.array([all_counts[w] for w in all_widths], dtype=np.int64), SIZE // GRAIN))
    # the filler: documents from the front of the order that hold what the classes' rounding and the patterns leave open
    slack = stored.agg(F.sum(F.col("class") * GRAIN - F.col("n_tokens") % SIZE)).first()[0]
    need = min(tokens, slack + open_grains * GRAIN + 2 * SIZE)
    last_part, before = max(((p, t) for p, t, _ in bases if t < need), key=lambda x: x[1])
    is_filler = (F.col("part") < last_part) | ((F.col("part") == last_part) & (F.col("start_in_part") < need - before))
    filler, normal = meta.where(is_filler), meta.where(~is_filler)
    used_up = filler.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.floor(F.col("n_tokens") / SIZE)), F.lit(0))).first()
    counts = {r["class"]: r["n"] for r in normal.where("class > 0").groupBy("class").agg(F.count("*").alias("n")).collect()}  # SIZE / GRAIN rows at most
    widths = np.array(sorted(counts), dtype=np.int64)
    patterns = cutting_stock(widths, np.array([counts[w] for w in widths], dtype=np.int64), SIZE // GRAIN)

    # where each class's ranks go; a pattern's sequences are consecutive
    slots, taken, sequences = [], dict.fromkeys(counts, 0), 0
    for pattern, n in patterns:
        for w, a in zip(widths.tolist(), pattern.tolist(), strict=True):
            if a:
                slots.append((w, taken[w], taken[w] + a * n, a, sequences))
                taken[w] += a * n
        sequences += n
    slot = F.broadcast(spark.createDataFrame(slots, "class int, first long, past long, each long, at long"))  # bounded by classes x patterns
    ranks = _ranks(stored, filler)
    placed = normal.where("class > 0").join(ranks, ["part", "class"]).withColumn("rank", F.col("rank_before") + F.col("rank_in_part"))
    placed = placed.join(slot, "class").where("rank >= first and rank < past")
    rests = placed.select(
        "doc_id", (F.col("n_tokens") - F.col("n_tokens") % SIZE).alias("start"), (F.col("n_tokens") % SIZE).alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), (F.col("at") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("sequence_id"), "stream",
    )
    rests = materialize(rests, "rests")
    within = "sum(length) over (partition by sequence_id order by length desc, stream rows between unbounded preceding and 1 preceding)"
    placed_rests = rests.withColumn("offset", F.coalesce(F.expr(within), F.lit(0))).drop("stream")

    full = normal.where(F.col("n_tokens") >= SIZE).select(
        "doc_id", "n_tokens", F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("n_tokens") / SIZE).cast("int"))).alias("k", "ids_crc32"),
        (F.col("blocks_before") + F.col("blocks_in_part") - used_up[1] + sequences).alias("block"),
    )
    full = full.select("doc_id", (F.col("k") * F.lit(SIZE).cast("long")).alias("start"), F.lit(SIZE).cast("long").alias("length"), "ids_crc32", F.col("n_tokens").alias("doc_tokens"), (F.col("block") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    next_id = sequences + blocks - used_up[1]

    gaps = rests.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("gap", SIZE - F.col("used"))
    gaps = running_totals(gaps.where("gap > 0"), ["sequence_id"], {"gap_start": "gap"}, "gaps").select("sequence_id", F.col("used").alias("at"), "gap_start", "gap")
    open_room = rests.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    open_room = sequences * SIZE - open_room
    tail, left, at = [], used_up[0] - open_room, open_room
    while left > 0:
        n = min(SIZE, 1 << (left.bit_length() - 1))
        tail.append((next_id, 0, at, n))
        next_id, left, at = next_id + 1, left - n, at + n
    gaps = gaps.unionByName(spark.createDataFrame(tail, "sequence_id long, at long, gap_start long, gap long"))
    filled = _fill(filler.select("doc_id", "n_tokens", "stream", "ids"), gaps)
    return rests_union(placed_rests, full, filled), target


def rests_union(*parts: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in PIECES.split(", ")]
    out = parts[0].select(names)
    for p in parts[1:]:
        out = out.unionByName(p.select(names))
    return out


def _ranks(stored: DataFrame, filler: DataFrame) -> DataFrame:
    """(part, class, rank_before): a row for each written partition and class."""
    own = stored.where("class > 0").groupBy("part", "class").agg(F.count("*").alias("n"))
    out_of = filler.where("class > 0").groupBy("class").agg(F.count("*").alias("gone"))
    earlier = F.coalesce(F.expr("sum(n) over (partition by class order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    return own.withColumn("earlier", earlier).join(out_of, "class", "left").select("part", "class", (F.col("earlier") - F.coalesce("gone", F.lit(0))).alias("rank_before"))


def _fill(filler: DataFrame, gaps: DataFrame) -> DataFrame:
    """The filler's stream of tokens cut where the stream of gaps is."""
    docs = filler.select("doc_id", "n_tokens", "stream")
    spans = docs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("stream") / SIZE), F.floor((F.col("stream") + F.col("n_tokens") - 1) / SIZE))))
    rooms = gaps.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("gap_start") / SIZE), F.floor((F.col("gap_start") + F.col("gap") - 1) / SIZE))))
    begin, end = F.greatest("stream", "gap_start"), F.least(F.col("stream") + F.col("n_tokens"), F.col("gap_start") + F.col("gap"))
    cuts = spans.join(rooms, "bucket").where((begin < end) & (F.col("bucket") == F.floor(begin / SIZE)))
    cuts = cuts.groupBy("stream").agg(F.collect_list(F.struct((begin - F.col("stream")).alias("start"), (end - begin).alias("length"), "sequence_id", (F.col("at") + begin - F.col("gap_start")).alias("offset"))).alias("cuts"))
    whole = filler.join(cuts, "stream").select("doc_id", "n_tokens", "cuts", "ids")

    def run(batches):
        for batch in batches:
            rows = []
            for i, n, cuts_of, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                all_ids = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
                rows += [(i, c["start"], c["length"], zlib.crc32(all_ids[c["start"] : c["start"] + c["length"]].tobytes()), n, c["sequence_id"], c["offset"]) for c in cuts_of]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return whole.mapInArrow(tidy(run), PIECES)


def sequences_of(pieces: DataFrame, target: str) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, unpadded, for tables of distinct doc_ids."""
    ids = pieces.sparkSession.read.schema(STORED).orc(target).select("doc_id", "ids")
    cut = pieces.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    rows = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten(F.col("rows")["ids"]).alias("ids"))


