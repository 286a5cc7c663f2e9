"""The token budget applied to masks: one optimizer update's rows, cut to what its stage has left.

The canonical order is by sample, generation and place in the row.  It has two levels: totals
over rows come from range partitions, and where the budget ends inside a row, that row's mask is cut.  The
selection's digest is over the keys and both masks, row after row, so whoever commits can show
that the masks applied are those that were planned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.functions import predicates as P
from veraline.functions.canonical import joined, json_string, serial_sha256
from veraline.operators import budget
from veraline.operators.checks import ContractError, named, repeated, require_none, union, violations
from veraline.operators.ordering import running_totals
from veraline.plans.store import materialize

KEY = ["sample_id", "generation_index"]
#: Cells of an update's masks at most: its digest is serial, so the update passes through one task.
MOST_CELLS = 1 << 32


def binary(mask: Column) -> Column:
    """A mask of booleans, or of 0 and 1, as booleans; null for any other entry."""
    return F.transform(mask, lambda x: F.when(x.cast("int").isin(0, 1), x.cast("int") == 1))


def mask_violations(rows: DataFrame) -> DataFrame:
    """Rows (sample_id, generation_index, mask) without a key, with a mask that isn't binary or of another length than most, and repeated keys."""
    name = F.concat_ws("|", "sample_id", F.col("generation_index").cast("string"))
    told = rows.withColumn("vl_key", name)
    lengths = told.groupBy(F.size("mask").alias("n")).agg(F.count("*").alias("rows"), F.min("vl_key").alias("vl_key")).orderBy(F.desc("rows"), "n")
    rules = {
        "sample_id": F.length("sample_id") > 0, "generation_index": F.col("generation_index") >= 0,
        "mask": F.col("mask").isNotNull() & F.forall(binary(F.col("mask")), lambda x: x.isNotNull()),
    }
    return union(violations(told, "vl_key", rules), named(lengths.offset(1), "mask_length", "vl_key"), repeated(rows, "repeated_row", *KEY))


def cut(mask: Column, kept: Column) -> Column:
    """The mask without its true places after the first `kept`."""
    true = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    last = F.when(kept <= 0, F.lit(-1)).otherwise(F.coalesce(F.get(true, (F.least(kept, F.size(true)) - 1).cast("int")), F.lit(-1)))
    return F.transform(F.arrays_zip(mask.alias("m"), F.transform(mask, lambda m, i: i).alias("i"), F.array_repeat(last, F.size(mask)).alias("last")), lambda x: x["m"] & (x["i"] <= x["last"]))


def _bits(mask: Column) -> Column:
    """A byte of 0 or 1 a place, as hex."""
    return F.array_join(F.transform(mask, lambda m: F.when(m, "01").otherwise("00")), "")


def content_sha256(selection: DataFrame, width: int) -> str:
    """The digest of a selection (position, key, candidate_mask, loss_mask): its keys and shape, then all rows of one mask, then of the other.

    Rows are sorted and joined in range partitions; one task hashes these pieces, and none sorts all rows.
    """
    rows = selection.count()
    if rows * width > MOST_CELLS:
        raise ContractError(f"an update has more than {MOST_CELLS} cells")
    key = F.concat(F.lit("["), json_string(F.col("sample_id")), F.lit(","), F.col("generation_index").cast("string"), F.lit("]"))
    text = F.when(F.col("position") > 0, F.concat(F.lit(","), key)).otherwise(key)
    parts = selection.select("position", F.encode(text, "UTF-8").alias("keys"), F.unhex(_bits(F.col("candidate_mask"))).alias("candidates"), F.unhex(_bits(F.col("loss_mask"))).alias("losses"))
    heads = [b'{"row_keys":[', f'],"schema_version":1,"shape":[{rows},{width}]}}'.encode() + b"\x00candidate-mask\x00", b"\x00selected-mask\x00"]
    return serial_sha256(joined(parts, ["position"], ["keys", "candidates", "losses"]), heads)[0]


@dataclass(frozen=True)
class Selection:
    """An update's rows with position, candidate_mask and loss_mask, what it may use, and the digest over both masks."""

    rows: DataFrame
    width: int
    candidate_tokens: int
    selected_tokens: int
    content_digest: str


def select(rows: DataFrame, remaining: int) -> Selection:
    """The first `remaining` candidate tokens of an update in canonical order; rows keep their other columns.

    Masks that aren't binary or of one length, and keys that are missing or repeated, raise.
    """
    if remaining < 0:
        raise ContractError("a budget has no less than nothing left")
    clash = {c.lower() for c in rows.columns} & {"candidate_mask", "loss_mask", "position", "vl_tokens", "vl_before"}
    if clash:
        raise ContractError(f"rows already have {', '.join(sorted(clash))}")
    require_none(mask_violations(rows))
    told = rows.withColumn("candidate_mask", binary(F.col("mask"))).withColumn("vl_tokens", F.size(F.filter("candidate_mask", lambda x: x)).cast("long"))
    placed = running_totals(told, KEY, {"vl_before": "vl_tokens"}, "masks")
    total = placed.agg(F.coalesce(F.sum("vl_tokens"), F.lit(0)), F.max(F.size("candidate_mask"))).first()
    kept = placed.withColumn("loss_mask", cut(F.col("candidate_mask"), F.lit(remaining) - F.col("vl_before"))).drop("vl_tokens", "vl_before")
    made = materialize(kept, "selection")
    return Selection(made, total[1] or 0, total[0], min(total[0], remaining), content_sha256(made, total[1] or 0))


def plan(rows: DataFrame, states: DataFrame, stage: int) -> tuple[Selection, DataFrame]:
    """(selection, its reservation) of an update under the stage's state of `states` (budget.STATE)."""
    state = states.where(F.col("stage") == stage).limit(2).collect()
    if len(state) != 1:
        raise ContractError(f"{len(state)} states of stage {stage} where one is wanted")
    chosen = select(rows, state[0]["target_tokens"] - state[0]["consumed_tokens"])
    asked = rows.sparkSession.createDataFrame([(stage, chosen.candidate_tokens, chosen.content_digest)], "stage long, candidate_tokens long, content_digest string")
    return chosen, budget.reserve(asked, states)


def selection_violations(applied: DataFrame, reservation: DataFrame, width: int) -> DataFrame:
    """What a commit must refuse: masks (key, candidate_mask, loss_mask) that aren't the reservation's canonical prefix, or not those of its digest."""
    told = reservation.limit(2).collect()
    if len(told) != 1:
        raise ContractError(f"{len(told)} reservations where one is wanted")
    spark, state = applied.sparkSession, told[0]
    tokens = applied.select(*KEY, "candidate_mask", "loss_mask", F.size(F.filter("candidate_mask", lambda x: x)).cast("long").alias("vl_tokens"))
    placed = running_totals(tokens, KEY, {"vl_before": "vl_tokens"}, "applied")
    name = F.concat_ws("|", "sample_id", F.col("generation_index").cast("string"))
    wrong = placed.where(~F.col("loss_mask").eqNullSafe(cut(F.col("candidate_mask"), F.lit(state["selected_tokens"]) - F.col("vl_before")))).withColumn("vl_key", name)
    faults = union(named(wrong, "canonical_prefix", "vl_key"), repeated(applied, "repeated_row", *KEY))
    total = placed.agg(F.coalesce(F.sum("vl_tokens"), F.lit(0))).first()[0]
    seen = [r for r, ok in (("candidate_tokens", total == state["candidate_tokens"]), ("content_digest", content_sha256(placed, width) == state["content_digest"])) if not ok]
    return faults.unionByName(spark.createDataFrame([(r, state["selection_id"]) for r in seen], "rule string, key string"))


def commit(applied: DataFrame, reservation: DataFrame, outcome: DataFrame, states: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(records, new states) once the applied masks are those of the reservation and its state is still the stage's."""
    require_none(union(selection_violations(applied, reservation, width), budget.reservation_violations(reservation, states)))
    require_none(violations(outcome, "stage", {"step_id": P.is_identifier(F.col("step_id")), "executed": F.col("executed").isNotNull()}))
    return budget.committed(reservation, outcome, states)
