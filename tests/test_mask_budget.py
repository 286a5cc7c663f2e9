"""Mask selections against a plain version: prefixes, digests, gates, commits."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from veraline.operators import mask_budget as mb
from veraline.operators.checks import ContractError
from veraline.plans.store import setting

ROWS = "sample_id string, generation_index long, mask array<int>, note string"


def plain(rows, remaining):
    """(kept masks by key, candidate, selected, digest) with lists."""
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    left, kept = remaining, []
    for r in order:
        own = []
        for m in r[2]:
            own.append(int(bool(m) and left > 0))
            left -= own[-1]
        kept.append(own)
    head = json.dumps({"schema_version": 1, "shape": [len(rows), len(order[0][2]) if order else 0], "row_keys": [[r[0], r[1]] for r in order]}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    data = head.encode() + b"\x00candidate-mask\x00" + b"".join(bytes(r[2]) for r in order) + b"\x00selected-mask\x00" + b"".join(map(bytes, kept))
    return {(r[0], r[1]): k for r, k in zip(order, kept)}, sum(map(sum, (r[2] for r in rows))), sum(map(sum, kept)), hashlib.sha256(data).hexdigest()


def made(n, width, seed):
    rng = random.Random(seed)
    return [(f"s{rng.choice('aéZ🙂')}{k // 3}\"", k % 3 + 3 * (k % 2), [rng.randrange(2) for _ in range(width)], f"n{k}") for k in range(n)]


@pytest.mark.parametrize(("n", "width", "remaining"), [(40, 9, 77), (40, 9, 0), (40, 9, 10_000), (1, 1, 1), (25, 0, 5)])
def test_prefix_and_digest(spark, n, width, remaining):
    rows = made(n, width, n + remaining)
    got = mb.select(spark.createDataFrame(rows, ROWS), remaining)
    masks, candidate, selected, digest = plain(rows, remaining)
    assert {(r.sample_id, r.generation_index): list(map(int, r.loss_mask)) for r in got.rows.collect()} == masks
    assert (got.candidate_tokens, got.selected_tokens, got.content_digest, got.width) == (candidate, selected, digest, width)
    assert {r.note for r in got.rows.collect()} == {r[3] for r in rows}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_pieces_go_to_the_task_that_hashes(spark, monkeypatch, batch):
    seen, rows, real = [], made(600, 9, 5), mb.serial_sha256
    monkeypatch.setattr(mb, "serial_sha256", lambda pieces, heads: (seen.append(pieces.count()), real(pieces, heads))[1])
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)):
        assert mb.select(spark.createDataFrame(rows, ROWS), 300).content_digest == plain(rows, 300)[3]
    assert seen[0] < 600 and (batch == 7 or seen[0] <= 3 * 4)


def test_no_rows(spark):
    got = mb.select(spark.createDataFrame([], ROWS), 5)
    assert (got.rows.count(), got.candidate_tokens, got.selected_tokens, got.content_digest) == (0, 0, 0, plain([], 5)[3])


def test_plan_and_commit(spark):
    rows = made(30, 7, 3)
    states = spark.createDataFrame([(1, 100, 40, 6), (2, 10, 0, 0)], "stage long, target_tokens long, consumed_tokens long, version long")
    chosen, reservation = mb.plan(spark.createDataFrame(rows, ROWS), states, 1)
    told = reservation.first()
    assert (told.selected_tokens, told.truncated, told.content_digest) == (60, True, plain(rows, 60)[3])
    ran = spark.createDataFrame([(1, "step-1", "sft", True)], "stage long, step_id string, objective string, executed boolean")
    applied = chosen.rows.select(*mb.KEY, "candidate_mask", "loss_mask")
    records, after = mb.commit(applied.orderBy(F.rand(1)), reservation, ran, states, 7)
    assert records.first().counted_tokens == 60 and {r.stage: (r.consumed_tokens, r.version) for r in after.collect()} == {1: (100, 7), 2: (0, 0)}
    skipped, same = mb.commit(applied, reservation, ran.withColumn("executed", F.lit(False)), states, 7)
    assert skipped.first().counted_tokens == 0 and {r.stage: r.version for r in same.collect()} == {1: 6, 2: 0}
    with pytest.raises(ContractError, match="stale_version"):
        mb.commit(applied, reservation, ran, after.where("stage = 2").union(states.where("stage = 1").withColumn("version", F.lit(9).cast("long"))), 7)
    first = F.col("sample_id") == rows[0][0]
    broken = {
        "canonical_prefix": applied.withColumn("loss_mask", F.when(first, F.transform("candidate_mask", lambda x: F.lit(False))).otherwise(F.col("loss_mask"))),
        "content_digest": applied.withColumn("sample_id", F.when(first, F.concat(F.lit(rows[0][0]), F.lit("x"))).otherwise(F.col("sample_id"))),
        "candidate_tokens": applied.where(~first),
    }
    for rule, frame in broken.items():
        assert rule in {r.rule for r in mb.selection_violations(frame, reservation, 7).collect()}, rule
    with pytest.raises(ContractError):
        mb.commit(broken["canonical_prefix"], reservation, ran, states, 7)
    with pytest.raises(ContractError, match="0 states"):
        mb.plan(spark.createDataFrame(rows, ROWS), states, 5)


def test_gates(spark):
    good = [("a", 0, [1, 0], None), ("a", 1, [0, 1], None)]
    for bad, rule in ((("a", 1, [1, 1], None), "repeated_row"), (("b", 0, [1], None), "mask_length"), (("b", 0, [1, 2], None), "mask"), (("b", 0, None, None), "mask"), (("", 0, [1, 1], None), "sample_id"), (("b", -1, [1, 1], None), "generation_index"), (("b", 0, [1, None], None), "mask")):
        assert rule in {r.rule for r in mb.mask_violations(spark.createDataFrame([*good, bad], ROWS)).collect()}, rule
    frame = spark.createDataFrame(good, ROWS)
    for broken in (lambda: mb.select(frame, -1), lambda: mb.select(frame.withColumn("Loss_Mask", F.lit(1)), 1)):
        with pytest.raises(ContractError):
            broken()
    flags = mb.select(frame.withColumn("mask", F.transform("mask", lambda x: x == 1)), 1)
    assert flags.content_digest == mb.select(frame, 1).content_digest
