"""A caller's model, scorer and reward: batches, failures, runs taken up again."""

import pytest
from pyspark.sql import functions as F

from tests.scorers import CHECKPOINT, PROMPTS, PROTOCOLS
from veraline.operators import backend
from veraline.operators import evaluation as ev
from veraline.operators.checks import ContractError

SAMPLING = PROTOCOLS["sampling"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("b", "4" * 40, f"i:{k}", k, p, {}) for k, p in enumerate(PROMPTS)], ev.ITEM)


def done(r, text):
    return {"request_id": r["request_id"], "status": "completed", "generated_text": text, "output_token_ids": [*text.encode(), 2], "finish_reason": "eos", "error_code": None}


def echo():
    def answer(asked):
        assert 0 < len(asked) <= 5
        return [done(r, f"{r['item_id']}/{r['sample_index']}/{r['seed']}") for r in reversed(asked)]

    return answer


def test_every_request_is_answered_under_its_own_id(spark, items):
    records = backend.run_generation(items, SAMPLING, CHECKPOINT, echo, batch=5, partitions=3)
    assert records.count() == 48
    assert records.where("generated_text <> concat_ws('/', item_id, sample_index, seed)").count() == 0
    assert ev.record_violations(records, items, SAMPLING, CHECKPOINT).count() == 0
    again = backend.run_generation(items, SAMPLING, CHECKPOINT, echo, batch=2, partitions=7)
    assert ev.record_set_sha256(again) == ev.record_set_sha256(records)


def test_failed_requests_are_rows_and_are_asked_again(spark, items):
    def shaky():
        def answer(asked):
            if any(r["item_index"] == 2 for r in asked):
                raise MemoryError
            return [done(r, "x") for r in asked]

        return answer

    grid = ev.requests(items, SAMPLING, CHECKPOINT).cache()
    first = backend.respond(grid, shaky, batch=6).cache()
    counts = {r.status: (r.n, r.codes) for r in first.groupBy("status").agg(F.count("*").alias("n"), F.collect_set("error_code").alias("codes")).collect()}
    assert counts == {"completed": (40, []), "failed": (8, ["backend_error"])}
    assert {r.item_index for r in backend.unanswered(grid, first).collect()} == {2}
    whole = backend.run_generation(items, SAMPLING, CHECKPOINT, echo, earlier=first, batch=5)
    assert whole.where("status = 'failed'").count() == 0 and whole.where("generated_text = 'x'").count() == 40 and whole.count() == 48


@pytest.mark.parametrize("fault", ["missing", "twice", "strange"])
def test_responses_that_do_not_fit_the_grid_are_refused(spark, items, fault):
    def make():
        def answer(asked):
            out = [done(r, "x") for r in asked]
            return {"missing": out[1:], "twice": [*out, out[0]], "strange": [*out[1:], {**out[0], "request_id": "other"}]}[fault]

        return answer

    with pytest.raises(ContractError, match={"missing": "missing_response", "twice": "repeated_response", "strange": "extra_response"}[fault]):
        backend.run_generation(items, SAMPLING, CHECKPOINT, make)


def test_a_model_is_made_once_in_a_worker(spark, items):
    def make():
        import itertools
        import os

        counter, me = itertools.count(1), os.getpid()
        return lambda asked: [done(r, f"{me}:{next(counter)}") for r in asked]

    rows = backend.respond(ev.requests(items, SAMPLING, CHECKPOINT), make, batch=1, partitions=6).select("generated_text").collect()
    assert len({r.generated_text for r in rows}) == 48  # a second model in a worker would count from 1 again


def test_shapes_and_empty_grids(spark, items):
    assert backend.run_generation(items.where("item_index < 0"), SAMPLING, CHECKPOINT, echo).count() == 0
    with pytest.raises(ContractError):
        backend.respond(items, echo, batch=0)
    with pytest.raises(Exception, match="fields of RESPONSE"):
        backend.respond(ev.requests(items, SAMPLING, CHECKPOINT), lambda: lambda asked: [{"request_id": r["request_id"]} for r in asked]).collect()


def test_rewards_are_whole(spark):
    rows = spark.createDataFrame([(1, "42", "42"), (2, "42", "41"), (3, None, "42"), (4, "1", "1")], "id int, reference string, said string")

    def make():
        return lambda asked: [None if a["reference"] is None else int(a["reference"] == a["said"]) for a in asked]

    got = {r.id: r.reward for r in backend.rewarded(rows, make, ["reference", "said"], batch=2).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: 1.0}
    for bad in (lambda: lambda asked: [0.5] * len(asked), lambda: lambda asked: [1] * (len(asked) + 1), lambda: lambda asked: [True] * len(asked)):
        with pytest.raises(Exception, match="a reward is"):
            backend.rewarded(rows, bad, ["said"]).collect()
    with pytest.raises(ContractError):
        backend.rewarded(rows.withColumn("REWARD", F.lit(1)), make, ["said"])


def test_announced_answers_and_plain_numbers(spark):
    said = [r"\boxed{3} then \boxed{ 6/2 }", "the answer is 3\nmore", "<answer>3</answer> Answer: 4", r"\boxed{3", "3", "", None, "answer: three"]
    frame = spark.createDataFrame([(k, "3", t) for k, t in enumerate(said)], "k int, reference string, said string")
    got = {r.k: (r.v.verification_status, r.v.extraction_status, r.v.marker_count) for r in frame.select("k", ev.plain_number(F.col("reference"), F.col("said")).alias("v")).collect()}
    assert got == {0: ("match", "extracted", 2), 1: ("match", "extracted", 1), 2: ("mismatch", "extracted", 2), 3: ("prediction_not_extracted", "malformed_final_answer", 1), 4: ("prediction_not_extracted", "no_final_answer", 0), 5: ("prediction_not_extracted", "no_final_answer", 0), 6: ("prediction_not_extracted", "no_final_answer", 0), 7: ("prediction_unparseable", "extracted", 1)}
    label = spark.createDataFrame([("é", "é")], "a string, b string").select(ev.strict_label(F.col("a"), F.col("b")).alias("v")).first().v
    assert label.extraction_status == "strict_label_not_extracted"
