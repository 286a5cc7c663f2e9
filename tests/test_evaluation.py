"""A sealed evaluation from items to reports, whose digests and counts are known."""

import pytest
from pyspark.sql import functions as F

from tests.scorers import CHECKPOINT, COMMON, GREEDY, PROMPTS, PROTOCOLS, REFERENCES, SAMPLED, WANT, make
from veraline.operators import evaluation as ev
from veraline.operators import paired
from veraline.operators.backend import scored_by
from veraline.operators.checks import ContractError, require_none
from veraline.sources.documents import write_document

@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([("synthetic/math-eval", "4" * 40, f"math:{k:03}", k, PROMPTS[k], {"difficulty": "easy", "level": str(k % 2 + 1)}) for k in range(6)], ev.ITEM)
    return items, spark.createDataFrame([("synthetic/math-eval", "4" * 40, f"math:{k:03}", r) for k, r in enumerate(REFERENCES)], ev.REFERENCE)


def answered(spark, items, mode):
    grid = ev.requests(items, PROTOCOLS[mode], CHECKPOINT).cache()
    rows = []
    for r in grid.collect():
        said = GREEDY[r.item_index] if mode == "greedy" else SAMPLED[r.item_index][r.sample_index]
        cut = r.item_index == 3 and r.sample_index == (0 if mode == "greedy" else 4)
        rows.append((r.request_id, "completed", said, [1] * 64 if cut else [*said.encode(), 2], "length" if cut else "eos", None))
    return grid, spark.createDataFrame(rows[::-1], ev.RESPONSE)


@pytest.mark.parametrize("mode", ["greedy", "sampling"])
def test_runs_from_items_to_reports(spark, tables, tmp_path, mode):
    items, references = tables
    protocol = PROTOCOLS[mode]
    assert protocol.sha256 == WANT[mode][0]
    require_none(ev.item_violations(items))
    require_none(ev.sealed_violations(items, references))
    grid, responses = answered(spark, items, mode)
    require_none(ev.response_violations(grid, responses))
    records = ev.generation_records(grid, responses).cache()
    require_none(ev.record_violations(records, items, protocol, CHECKPOINT))
    scores = ev.sample_scores(records, references, scored_by(make)).cache()
    assert not {"generated_text", "reference", "prompt"} & set(scores.columns)
    ks = tuple(int(k) for k in WANT[mode][1]["pass_at_k_ppm"])
    assert ev.golden_violations(WANT[mode][1], {"generation_record_set_sha256": ev.record_set_sha256(records), "protocol_sha256": protocol.sha256, **ev.report(scores, ks)}) == []
    assert ev.item_scores(scores).where("item_index = 0").first().correct_count == protocol.samples_per_item
    digest = ev.write_bundle(records, str(tmp_path / "bundle"), "run", protocol, CHECKPOINT)
    assert digest == WANT[mode][1]["generation_record_set_sha256"]
    again = ev.read_bundle(spark, str(tmp_path / "bundle"), items, protocol)
    assert ev.record_set_sha256(again) == digest and again.count() == records.count()
    with pytest.raises(ContractError, match="missing_record"):
        ev.read_bundle(spark, str(tmp_path / "bundle"), items.withColumn("prompt", F.concat("prompt", F.lit("!"))), protocol)


def test_known_identities(spark):
    """The digest of a known run's records, whose prompts are known for three items only, is checked by its parts."""
    item = spark.createDataFrame([("b", "4" * 40, "i", 0, "p", {})], ev.ITEM)
    r = ev.requests(item, PROTOCOLS["sampling"], CHECKPOINT).where("sample_index = 3").first()
    seed = ev.canonical_sha256({"schema_version": "d07-paired-generation-seed-v1", "protocol_sha256": PROTOCOLS["sampling"].sha256, "benchmark_id": "b", "benchmark_revision": "4" * 40, "item_id": "i", "sample_index": 3})
    assert r.seed == int(seed[:16], 16) & (2**63 - 1)
    import hashlib

    own = {"benchmark_id": "b", "benchmark_revision": "4" * 40, "item_id": "i", "item_index": 0, "sample_index": 3, "prompt_sha256": hashlib.sha256(b"p").hexdigest(), "checkpoint_sha256": CHECKPOINT, "protocol_sha256": PROTOCOLS["sampling"].sha256, "seed": r.seed}
    assert r.request_id == ev.canonical_sha256({"schema_version": "d07-generation-request-id-v1", **own})


def test_faults_are_named(spark, tables, tmp_path):
    items, references = tables
    rules = lambda df: {r.rule for r in df.collect()}
    assert rules(ev.item_violations(items.where("item_index <> 2"))) == {"consecutive_indexes"}
    assert rules(ev.item_violations(items.unionByName(items.limit(1)))) == {"consecutive_indexes", "repeated_item_id"}
    assert rules(ev.sealed_violations(items.where("item_index > 0"), references.where("item_id <> 'math:003'"))) == {"no_item", "no_reference"}
    grid, responses = answered(spark, items, "greedy")
    assert rules(ev.response_violations(grid, responses.limit(4))) == {"missing_response"}
    assert rules(ev.response_violations(grid, responses.unionByName(responses.limit(1)))) == {"repeated_response"}
    assert rules(ev.response_violations(grid, responses.withColumn("request_id", F.lit("x")))) == {"missing_response", "extra_response", "repeated_response"}
    assert rules(ev.response_violations(grid, responses.withColumn("finish_reason", F.lit(None).cast("string")))) == {"completed"}
    records = ev.generation_records(grid, responses)
    assert rules(ev.record_violations(records.withColumn("generated_text", F.lit("z")), items, PROTOCOLS["greedy"], CHECKPOINT)) == {"record_sha256"}
    for reason, rule in (("length", "length_finish"), ("stop_sequence", "stop_sequence_finish")):
        assert rule in rules(ev.record_violations(records.withColumn("finish_reason", F.lit(reason)), items, PROTOCOLS["greedy"], CHECKPOINT))
    failed = responses.withColumns({"status": F.lit("failed"), "generated_text": F.lit(None).cast("string"), "output_token_ids": F.lit(None).cast("array<int>"), "finish_reason": F.lit(None).cast("string"), "error_code": F.lit("oom")})
    require_none(ev.response_violations(grid, failed))
    with pytest.raises(ContractError, match="failed_generation"):
        ev.sample_scores(ev.generation_records(grid, failed), references, scored_by(make))
    with pytest.raises(Exception, match="no meaning"):
        ev.sample_scores(records, references.withColumn("reference", F.lit("not a mathematical reference")), scored_by(make)).collect()
    with pytest.raises(ContractError, match="greedy"):
        ev.Protocol("greedy", 2, **COMMON)
    labels = ev.sample_scores(records, references.withColumn("reference", F.lit("B")), ev.strict_label)
    assert labels.where("correct").count() == 0 and labels.where("extraction_status = 'strict_label_extracted'").count() == 0
    plain = ev.sample_scores(records.withColumn("generated_text", F.lit("  B ")), references.withColumn("reference", F.lit("B")), ev.strict_label)
    assert plain.where("correct").count() == 6
    path = str(tmp_path / "p.json")
    write_document(path, {**ev.asdict(PROTOCOLS["greedy"])})
    assert ev.read_protocol(spark, path) == PROTOCOLS["greedy"]
    assert ev.golden_violations({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3}, "d": None}) == ["a.c", "d"]


def test_panels_come_from_scores(spark, tables):
    items, references = tables
    grid, responses = answered(spark, items, "greedy")
    scores = ev.sample_scores(ev.generation_records(grid, responses), references, scored_by(make)).cache()
    panel = ev.panel_of({(arm, seed): scores for arm in paired.ARMS for seed in (101, 202, 303)}, items, "level")
    require_none(paired.panel_violations(panel, paired.Protocol()))
    assert panel.count() == 6 * 15 and len(ev.item_set_sha256(items)) == 64
