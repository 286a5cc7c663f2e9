"""The evaluator's own audit: stated predictions run through the sealed evaluation in both modes, against an expected summary.

Each mode makes the grid, answers it from a document of predictions, checks the responses,
builds and checks records, scores and reports them.  Items and references are JSON lines
bound by their raw digests to a descriptor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veraline.functions import versions
from veraline.operators import evaluation as ev
from veraline.operators.checks import ContractError, named, repeated, require_none, union, violations
from veraline.plans.store import materialize
from veraline.sources.documents import exact_keys, read_document
from veraline.sources.jsonl import Limits, file_sha256, read_records

DESCRIPTOR = {"schema_version", "benchmark_id", "benchmark_revision", "revision_kind", "split_name", "task", "item_count", "public_items_sha256", "sealed_references_sha256", "source_registry_sha256", "data_manifest_sha256"}
PREDICTION = "item_id string, mode string, sample_index long, text string"
TRUNCATION = "mode string, item_id string, sample_index long"
MODES, MOST_CHARS = ("greedy", "sampling"), 32_768
LINES = Limits(most_bytes=16 << 20)


def read_descriptor(spark: SparkSession, path: str) -> tuple[dict, str]:
    """(the benchmark's descriptor, the digest of its raw bytes)."""
    return read_document(spark, path, DESCRIPTOR, versions.BENCHMARK_DESCRIPTOR), file_sha256(spark, path)


def _lines(spark: SparkSession, path: str, fields: str, version: str, digest: str, descriptor: dict) -> DataFrame:
    if file_sha256(spark, path) != digest:
        raise ContractError("a file's bytes aren't those of the descriptor")
    schema = spark.createDataFrame([], f"{fields}, schema_version string").schema
    rows, broken = read_records(spark, path, schema, "item_id", LINES)
    require_none(broken.select("rule", F.concat_ws(":", "file", "line").alias("key")))
    own = {"schema_version": F.col("schema_version") == version, "benchmark_id": F.col("benchmark_id") == descriptor["benchmark_id"], "benchmark_revision": F.col("benchmark_revision") == descriptor["benchmark_revision"]}
    require_none(violations(rows, "item_id", own))
    return rows.drop("schema_version")


def read_items(spark: SparkSession, path: str, descriptor: dict) -> DataFrame:
    """The public items that a descriptor binds."""
    items = _lines(spark, path, ev.ITEM, versions.PUBLIC_BENCHMARK_ITEM, descriptor["public_items_sha256"], descriptor)
    require_none(ev.item_violations(items))
    if items.count() != descriptor["item_count"]:
        raise ContractError("there aren't as many items as the descriptor says")
    return items


def read_references(spark: SparkSession, path: str, descriptor: dict, items: DataFrame) -> DataFrame:
    """The sealed references that a descriptor binds, one for each item."""
    references = _lines(spark, path, ev.REFERENCE, versions.SEALED_REFERENCE, descriptor["sealed_references_sha256"], descriptor)
    require_none(ev.sealed_violations(items, references))
    return references


def read_predictions(spark: SparkSession, path: str, items: DataFrame, protocols: dict[str, ev.Protocol]) -> tuple[DataFrame, DataFrame]:
    """(PREDICTION, TRUNCATION) of a document of a driver's size: for each item one greedy text and the protocol's samples, and which of them were cut at the most tokens."""
    whole = read_document(spark, path, {"schema_version", "items", "truncations"}, versions.EVALUATOR_PREDICTIONS)
    rows = []
    for item in whole["items"]:
        exact_keys(item, {"item_id", "greedy", "sampling"}, "prediction")
        rows.append((item["item_id"], "greedy", 0, item["greedy"]))
        rows += [(item["item_id"], "sampling", k, text) for k, text in enumerate(item["sampling"])]
    cut = []
    for entry in whole["truncations"]:
        exact_keys(entry, {"mode", "item_id", "sample_index"}, "truncation")
        cut.append((entry["mode"], entry["item_id"], entry["sample_index"]))
    said, cuts = spark.createDataFrame(rows, PREDICTION), spark.createDataFrame(cut, TRUNCATION)
    wanted = F.array(*(F.struct(F.lit(m).alias("mode"), F.sequence(F.lit(0).cast("long"), F.lit(p.samples_per_item - 1).cast("long")).alias("samples")) for m, p in protocols.items()))
    grid = items.select("item_id", F.explode(wanted).alias("g")).select("item_id", "g.mode", F.explode("g.samples").alias("sample_index"))
    key = ["item_id", "mode", "sample_index"]
    require_none(union(
        named(grid.join(said, key, "left_anti"), "no_prediction", "item_id"), named(said.join(grid, key, "left_anti"), "extra_prediction", "item_id"), repeated(said, "repeated_prediction", *key),
        violations(said, "item_id", {"text": F.col("text").isNotNull() & (F.length("text") <= MOST_CHARS)}), named(cuts.join(grid, key, "left_anti"), "truncation_of_nothing", "item_id"), repeated(cuts, "repeated_truncation", *key),
    ))
    return said, cuts


def token_bytes(text: Column) -> Column:
    """The bytes of a text's UTF-8 as ids."""
    octets = F.encode(text, "UTF-8")
    return F.when(F.length(octets) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(octets)), lambda k: F.conv(F.hex(F.substring(octets, k, F.lit(1))), 16, 10).cast("int")))


def stated_responses(grid: DataFrame, said: DataFrame, cuts: DataFrame, mode: str, protocol: ev.Protocol) -> DataFrame:
    """RESPONSE of each request from the stated texts: their bytes and the end token as ids, or, where cut, the most tokens of id 1."""
    key = ["item_id", "sample_index"]
    own = said.where(F.col("mode") == mode).select(*key, "text")
    ended = cuts.where(F.col("mode") == mode).select(*key, F.lit(True).alias("cut"))
    rows = grid.select("request_id", *key).join(own, key).join(ended, key, "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    ids = F.when(F.col("cut"), F.array_repeat(F.lit(1), protocol.max_new_tokens)).otherwise(F.concat(token_bytes(F.col("text")), F.array(F.lit(protocol.eos_token_id))))
    return rows.select("request_id", F.lit("completed").alias("status"), F.col("text").alias("generated_text"), ids.alias("output_token_ids"), F.when(F.col("cut"), "length").otherwise("eos").alias("finish_reason"), F.lit(None).cast("string").alias("error_code"))


def run_mode(items: DataFrame, references: DataFrame, said: DataFrame, cuts: DataFrame, mode: str, protocol: ev.Protocol, checkpoint_sha256: str, scorer: Callable[[Column, Column], Column]) -> dict[str, object]:
    """The summary of a mode's run: the digests of its protocol and records, and its report."""
    grid = materialize(ev.requests(items, protocol, checkpoint_sha256), "requests")
    responses = stated_responses(grid, said, cuts, mode, protocol)
    require_none(ev.response_violations(grid, responses))
    records = materialize(ev.generation_records(grid, responses), "records")
    require_none(ev.record_violations(records, items, protocol, checkpoint_sha256))
    scores = materialize(ev.sample_scores(records, references, scorer), "scores")
    told = ev.report(scores, tuple(sorted({1, protocol.samples_per_item})))
    return {"protocol_sha256": protocol.sha256, "generation_record_set_sha256": ev.record_set_sha256(records), **told}


def evaluator_audit(spark: SparkSession, paths: dict[str, str], checkpoint_sha256: str, scorer: Callable[[Column, Column], Column]) -> dict[str, object]:
    """{passed, digests of the files, runs by mode, failures}: failures name the fields that differ from the expectation.

    paths: descriptor, items, references, greedy, sampling, predictions, expectation.
    Fields that the expectation has and a run doesn't are failures; what only a run has isn't looked at.
    """
    descriptor, descriptor_sha = read_descriptor(spark, paths["descriptor"])
    items = materialize(read_items(spark, paths["items"], descriptor), "items")
    references = read_references(spark, paths["references"], descriptor, items)
    protocols = {m: ev.read_protocol(spark, paths[m]) for m in MODES}
    wrong = [m for m, p in protocols.items() if p.mode != m]
    if wrong:
        raise ContractError(f"a protocol of another mode: {', '.join(wrong)}")
    said, cuts = read_predictions(spark, paths["predictions"], items, protocols)
    told = {
        "benchmark_descriptor_sha256": descriptor_sha, "public_items_sha256": descriptor["public_items_sha256"], "sealed_references_sha256": descriptor["sealed_references_sha256"], "fixture_predictions_sha256": file_sha256(spark, paths["predictions"]),
        "runs": {m: run_mode(items, references, said, cuts, m, p, checkpoint_sha256, scorer) for m, p in protocols.items()},
    }
    expected = read_document(spark, paths["expectation"], None, versions.EVALUATOR_EXPECTATION)
    wanted = {k: v for k, v in expected.items() if k != "schema_version"}
    seen = {k: {m: {f: run[f] for f in wanted[k].get(m, {}) if f in run} for m, run in v.items()} if k == "runs" else v for k, v in told.items() if k in wanted}
    failures = ev.golden_violations(wanted, seen)
    return {"schema_version": versions.EVALUATOR_REPORT, "passed": not failures, **told, "failures": failures}
