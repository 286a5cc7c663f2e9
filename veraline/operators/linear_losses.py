"""Cross entropy and reverse divergence from hidden states, without whole logits or a whole head.

A head is a table with a row of weights for each token of the vocabulary.  Positions are
dealt into blocks, and the head's rows into slabs.  A task holds the hidden states of one block, lets
the slab's rows pass by in chunks, and keeps for each position what sums of exponentials
need: the largest logit so far and the sums relative to it.  States of a position from
several slabs are merged.  Positions travel once a slab and the head once a block, so large blocks
suit many positions, and several slabs suit few positions and a large vocabulary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.functions.text import let
from veraline.operators.checks import ContractError, named, repeated, require_none, union
from veraline.plans.store import materialize

#: Positions of a block, tokens of a chunk.
BLOCK, CHUNK = 8192, 2048


@dataclass(frozen=True)
class Transform:
    """What logits go through: scaled, softly capped, divided by the temperature."""

    scale: float = 1.0
    cap: float | None = None
    temperature: float = 1.0

    def __post_init__(self):
        for name in ("scale", "cap", "temperature"):
            value = getattr(self, name)
            if value is None and name == "cap":
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
                raise ContractError(f"{name} must be finite and positive")

    def of(self, logits: np.ndarray) -> np.ndarray:
        """Logits that aren't finite are refused before a cap could hide them."""
        out = logits * self.scale
        if not np.isfinite(out).all():
            raise ContractError("logits must be finite")
        if self.cap is not None:
            out = self.cap * np.tanh(out / self.cap)
        return out / self.temperature


def selected_positions(sequences: DataFrame, hidden: str = "hidden", labels: str = "labels", mask: str = "loss_mask", *keep: str) -> DataFrame:
    """(keep..., position, hidden, target) of each selected target: hidden is that of the position before.

    A selected first position, for which nothing predicts, a selected negative label and
    lists of different lengths raise.
    """
    n = F.size(labels)
    told = sequences.withColumn("vl_wrong", F.when((F.size(mask) != n) | (F.size(hidden) != n), F.lit("lengths")).when(F.get(mask, F.lit(0)), F.lit("first_position")).when(F.exists(F.zip_with(mask, labels, lambda m, y: m & (y < 0)), lambda x: x), F.lit("ignored_label")))
    require_none(named(told.where("vl_wrong is not null"), "selected_positions", "vl_wrong"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.coalesce(F.get(mask, k), F.lit(False)))
    rows = sequences.where(n > 0).withColumn("position", F.explode(at))
    return rows.select(*keep, "position", F.get(hidden, F.col("position") - 1).alias("hidden"), F.get(labels, F.col("position")).alias("target"))


def head_violations(head: DataFrame) -> DataFrame:
    """Tokens that aren't numbered from 0 on without gaps, or have several rows."""
    spread = head.agg(F.min("token").alias("a"), F.max("token").alias("z"), F.count_distinct("token").alias("n"))
    gaps = spread.where("n = 0 or a <> 0 or z <> n - 1 or a is null")
    return union(repeated(head, "repeated_token", "token"), named(gaps, "consecutive_tokens", "z"))


def aligned_heads(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """(token, weight, bias, teacher_weight, teacher_bias) of two heads (token, weight, bias) of one vocabulary; widths may differ."""
    a, b = student.select("token"), teacher.select("token")
    require_none(union(repeated(student, "repeated_token", "token"), repeated(teacher, "repeated_token", "token"), named(a.join(b, "token", "left_anti"), "no_teacher_token", "token"), named(b.join(a, "token", "left_anti"), "no_student_token", "token")))
    return student.select("token", "weight", "bias").join(teacher.select("token", F.col("weight").alias("teacher_weight"), F.col("bias").alias("teacher_bias")), "token")


class _Sums:
    """Per position, over the tokens met so far, relative to the largest logit m: z = sum of e^(x - m), and the sums of e^(x - m) times each further value."""

    def __init__(self, n: int, further: int):
        self.m, self.z, self.more = np.full(n, -np.inf), np.zeros(n), np.zeros((further, n))

    def add(self, x: np.ndarray, *values: np.ndarray) -> None:
        top = np.maximum(self.m, x.max(axis=1))
        kept, e = np.exp(self.m - top), np.exp(x - top[:, None])
        self.m, self.z = top, self.z * kept + e.sum(axis=1)
        for k, v in enumerate(values):
            self.more[k] = self.more[k] * kept + (e * v).sum(axis=1)


def _matrix(column, what: str) -> np.ndarray:
    width = pa.compute.unique(column.value_lengths()).to_pylist()
    if len(width) != 1 or not width[0]:
        raise ContractError(f"{what} must all have one length, and some entries")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width[0])


def _project(hidden: np.ndarray, weight: np.ndarray, bias: np.ndarray, to: Transform) -> np.ndarray:
    if hidden.shape[1] != weight.shape[1]:
        raise ContractError(f"weights of width {weight.shape[1]} don't fit hidden states of width {hidden.shape[1]}")
    return to.of(hidden @ weight.T + bias)


STATE = "vl_row long, m double, z double, zx double, target_logit double, zd double, tm double, tz double"


def _passed(chunk: int, own: Transform, other: Transform | None):
    """STATE rows of (block, slab)s: rows of hidden states come first, then the slab's rows of the head."""

    class Block:
        def __init__(self):
            self.parts, self.ready = [], False

        def hold(self, batch):
            self.parts.append(batch)

        def start(self):
            held = pa.Table.from_batches(self.parts).combine_chunks()
            self.row, self.target = (held.column(c).to_numpy(zero_copy_only=False) for c in ("vl_row", "target"))
            self.x = _matrix(held.column("vector").chunk(0), "hidden states")
            self.y = _matrix(held.column("other").chunk(0), "hidden states of the teacher") if other else None
            n = len(self.row)
            self.sums, self.other, self.said = _Sums(n, 2 if other else 1), _Sums(n, 0), np.full(n, np.nan)
            self.parts, self.ready = [], True

        def take(self, batch):
            if not self.ready:
                self.start()
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                token, bias, other_bias = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("vl_row", "bias", "other_bias"))
                x = _project(self.x, _matrix(part.column(part.schema.get_field_index("vector")), "weights"), bias, own)
                if other:
                    y = _project(self.y, _matrix(part.column(part.schema.get_field_index("other")), "weights of the teacher"), other_bias, other)
                    self.sums.add(x, x, x - y)
                    self.other.add(y)
                else:
                    self.sums.add(x, x)
                order = np.argsort(token)
                place = np.minimum(np.searchsorted(token[order], self.target), len(token) - 1)
                met = np.flatnonzero(token[order][place] == self.target)
                self.said[met] = x[met, order[place[met]]]

        def told(self) -> pa.RecordBatch | None:
            if not self.ready or not len(self.row):
                return None
            further = self.sums.more[1] if other else np.zeros(len(self.row))
            said = pa.array(self.said, mask=np.isnan(self.said))
            return pa.RecordBatch.from_arrays([pa.array(self.row), *map(pa.array, (self.sums.m, self.sums.z, self.sums.more[0])), said, *map(pa.array, (further, self.other.m, self.other.z))], names=["vl_row", "m", "z", "zx", "target_logit", "zd", "tm", "tz"])

    def run(batches):
        key, block = None, Block()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if key != tuple(keys[:2, a].tolist()):
                    if (out := block.told()) is not None:
                        yield out
                    key, block = tuple(keys[:2, a].tolist()), Block()
                (block.take if keys[2, a] else block.hold)(batch.slice(a, b - a))
        if (out := block.told()) is not None:
            yield out

    return run


def _states(rows: DataFrame, head: DataFrame, own: Transform, other: Transform | None, block: int, slabs: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(rows with vl_row, STATE by vl_row): rows (target, vector, other) against a head (token, vector, bias, other, other_bias)."""
    require_none(head_violations(head))
    placed = materialize(rows.withColumn("vl_row", F.monotonically_increasing_id()), "positions")
    blocks = max(1, -(-placed.count() // block))
    doubles = lambda c: F.col(c).cast("array<double>").alias(c)
    of_slab = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long")))
    no = lambda kind: F.lit(None).cast(kind)
    names = ["block", "slab", "kind", "vl_row", "target", "vector", "other", "bias", "other_bias"]
    left = placed.select(F.pmod(F.xxhash64("vl_row"), F.lit(blocks)).alias("block"), of_slab.alias("slab"), F.lit(0).cast("long").alias("kind"), "vl_row", F.col("target").cast("long").alias("target"), doubles("vector"), doubles("other"), F.lit(0.0).alias("bias"), F.lit(0.0).alias("other_bias"))
    bias = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    right = head.select(F.col("token").cast("long").alias("vl_row"), doubles("vector"), doubles("other"), bias("bias"), bias("other_bias"), F.pmod("token", F.lit(slabs)).cast("long").alias("slab"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("kind", F.lit(1).cast("long")).withColumn("target", no("long"))
    both = left.select(*names).unionByName(right.select(*names))
    order = ["block", "slab", "kind", "vl_row"]
    states = both.repartition("block", "slab").sortWithinPartitions(*order).mapInArrow(_passed(chunk, own, other), STATE)
    return placed, states


def _merged(states: DataFrame) -> DataFrame:
    """One state a position, from its slabs' (as many as there are slabs)."""
    cols = ["m", "z", "zx", "target_logit", "zd", "tm", "tz"]
    held = states.groupBy("vl_row").agg(F.collect_list(F.struct(*cols)).alias("s"), F.max("m").alias("m"), F.max("tm").alias("tm"), F.max("target_logit").alias("target_logit"))

    def total(name: str, top: str) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda a, x: a + x[name] * F.exp(x[{"m": "m", "tm": "tm"}[top]] - F.col(top))).alias(name)

    return held.select("vl_row", "m", "tm", "target_logit", total("z", "m"), total("zx", "m"), total("zd", "m"), total("tz", "tm"))


def linear_cross_entropy(rows: DataFrame, head: DataFrame, transform: Transform | None = None, block: int = BLOCK, slabs: int = 1, chunk: int = CHUNK) -> DataFrame:
    """rows (hidden, target, any others) with nll and entropy, under a head (token, weight, bias; a null bias counts 0).

    Targets outside the vocabulary, heads with gaps or repeated tokens, widths that differ
    and logits that aren't finite raise.  No rows: no rows.
    """
    shaped = rows.withColumns({"vector": F.col("hidden"), "other": F.lit(None).cast("array<double>")})
    given = head.select("token", F.col("weight").alias("vector"), "bias", F.lit(None).cast("array<double>").alias("other"), F.lit(0.0).alias("other_bias"))
    placed, states = _states(shaped, given, transform or Transform(), None, block, slabs, chunk)
    log_z = F.col("m") + F.log("z")
    outside = F.raise_error(F.lit("a target is no token of the vocabulary")).cast("double")
    told = _merged(states).select("vl_row", F.when(F.col("target_logit").isNull(), outside).otherwise(log_z - F.col("target_logit")).alias("nll"), (log_z - F.col("zx") / F.col("z")).alias("entropy"))
    return placed.join(told, "vl_row").select(*rows.columns, "nll", "entropy")


def linear_reverse_kl(rows: DataFrame, heads: DataFrame, student: Transform | None = None, teacher: Transform | None = None, block: int = BLOCK, slabs: int = 1, chunk: int = CHUNK) -> DataFrame:
    """rows (hidden, teacher_hidden, any others) with kl, the student's expectation of the log ratio, and the student's entropy.

    heads: aligned_heads() of both.  Raises as linear_cross_entropy() does; there are no targets.
    """
    shaped = rows.withColumns({"vector": F.col("hidden"), "other": F.col("teacher_hidden"), "target": F.lit(-1)})
    given = heads.select("token", F.col("weight").alias("vector"), "bias", F.col("teacher_weight").alias("other"), F.col("teacher_bias").alias("other_bias"))
    placed, states = _states(shaped, given, student or Transform(), teacher or Transform(), block, slabs, chunk)
    log_z, teacher_log_z = F.col("m") + F.log("z"), F.col("tm") + F.log("tz")
    told = _merged(states).select("vl_row", (F.col("zd") / F.col("z") - log_z + teacher_log_z).alias("kl"), (log_z - F.col("zx") / F.col("z")).alias("entropy"))
    return placed.join(told, "vl_row").select(*rows.columns, "kl", "entropy")


def loss_of(values: DataFrame, loss: str, world: int = 1, tokens: int | None = None) -> DataFrame:
    """One row: loss_sum, entropy_sum, token_count, normalization_count and loss = loss_sum * world / normalization_count (0 without tokens).

    tokens: the count over all shards of an update, this one's if not given.
    """
    total = values.agg(F.coalesce(F.sum(loss), F.lit(0.0)).alias("loss_sum"), F.coalesce(F.sum("entropy"), F.lit(0.0)).alias("entropy_sum"), F.count("*").alias("token_count"))
    n = F.col("token_count") if tokens is None else F.lit(tokens).cast("long")
    return total.withColumn("normalization_count", n).withColumn("loss", let(F.col("normalization_count"), lambda k: F.when(k > 0, F.col("loss_sum") * world / k).otherwise(0.0)))
