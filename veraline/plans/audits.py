"""Whole audits: data trust, evaluator, paired statistics, verifier; their reports and golden comparison.

    python -m veraline.plans.audits data-trust --sources S --transforms T --policy P --candidates C --evaluation E --out O [--golden G]
    python -m veraline.plans.audits statistics --panel P --out O [--golden G]
    python -m veraline.plans.audits verifier --corpus C --scorer S --out O
    python -m veraline.plans.audits evaluator --descriptor D --items I --references R --greedy G --sampling S --predictions P --expectation E --checkpoint SHA --scorer S --out O

A scorer is plain_number, strict_label, or module:name of a factory as backend.scored_by() takes it.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.functions import versions
from veraline.functions.canonical import canonical_json, json_string, list_digest, ordered_sha256, set_digest
from veraline.operators import contamination as C
from veraline.operators import evaluation, paired, trust
from veraline.operators.backend import scored_by
from veraline.operators.checks import require_none
from veraline.operators.evaluation import golden_violations
from veraline.plans.evaluator import evaluator_audit
from veraline.plans.store import materialize
from veraline.sources import documents
from veraline.sources.jsonl import Limits, read_records

# The policy's record and the report's version.
POLICY = {
    "schema_version": versions.CONTAMINATION_POLICY, "normalization_version": "nfkc-lexeme-v1", "character_ngram_size": C.CHAR_SIZE, "token_ngram_size": C.TOKEN_SIZE, "minimum_exact_chars": C.MIN_EXACT, "minimum_fuzzy_chars": C.MIN_FUZZY,
    "fuzzy_jaccard_ppm": C.JACCARD, "fuzzy_containment_ppm": C.CONTAINMENT, "review_margin_ppm": C.MARGIN, "maximum_text_chars": 1_000_000, "included_field_groups": sorted(trust.GROUP_ORDER), "exempt_context_normalized_sha256": [],
}
NO_PARENTS = {"schema_version": versions.PARENT_PAYLOAD_LEDGER, "entries": []}


def fragment_set_sha256(fragments: DataFrame) -> str:
    """The digest of all fragments' ids, records, fields and normal forms in their order."""
    text = F.concat(F.lit("["), F.concat_ws(",", *(json_string(F.col(c)) for c in ("fragment_id", "sample_id", "field", "norm_sha"))), F.lit("]"))
    return list_digest(fragments, ["sample_id", "field", "norm_sha"], text).first()["digest"]


def candidate_pairs(train: DataFrame, held: DataFrame) -> int:
    """Pairs of fragments that share a normal form or any n-gram, counted for the report alone.

    For audits: the scan itself looks at fewer pairs.  Distinct pairs are what is counted, so
    this costs what a complete inverted index does.
    """
    same = lambda c: c

    def exploded(fragments: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        p = C.fingerprints(fragments, "fragment_id", "norm", same)
        long = p.where(F.col("norm_chars") >= C.MIN_FUZZY)
        grams = F.concat(F.transform("char_grams", lambda g: F.xxhash64(F.lit(0), g)), F.transform("token_grams", lambda g: F.xxhash64(F.lit(1), g)))
        return p.select(F.col("fragment_id").alias(key), F.xxhash64("norm_sha").alias("g")), long.select(F.col("fragment_id").alias(key), F.explode(grams).alias("g"))

    a, b = exploded(train, "a"), exploded(held, "b")
    pairs = [x.join(y, "g").select("a", "b") for x, y in zip(a, b, strict=True)]
    return pairs[0].union(pairs[1]).distinct().count()


MATCH_FIELDS = (
    "match_id", "kind", "train_record_id", "train_source_id", "train_field", "train_normalized_sha256", "eval_record_id", "eval_source_id", "eval_field", "eval_normalized_sha256", *trust.SCORES,
)


def contamination_report(train: DataFrame, held: DataFrame) -> tuple[dict[str, object], DataFrame]:
    """(report with its own digest, matches); the report lists its matches, so it's for reports of a driver's size."""
    require_none(trust.contamination_violations(train, held))
    matches = materialize(trust.contamination(train, held), "audit-matches")
    a, b = materialize(trust.fragments(train), "audit-train"), materialize(trust.fragments(held), "audit-held")
    listed = [r.asDict() for r in matches.select(*MATCH_FIELDS).orderBy("train_record_id", "eval_record_id").collect()]
    body = {
        "schema_version": versions.CONTAMINATION_REPORT, "policy_sha256": trust.canonical_sha256(POLICY), "training_fingerprint_sha256": fragment_set_sha256(a), "evaluation_fingerprint_sha256": fragment_set_sha256(b),
        "training_record_count": train.count(), "evaluation_record_count": held.count(), "training_fragment_count": a.count(), "evaluation_fragment_count": b.count(), "candidate_pair_count": candidate_pairs(a, b),
        "match_counts": trust.match_counts(matches), "matches": listed, "passed": not listed,
    }
    return body | {"report_sha256": trust.canonical_sha256(body)}, matches


MANIFEST_ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "split", "source_id", "source_revision", "payload_sha256", "content_sha256", "lineage_sha256")] + [T.StructField("family_sha256", trust.RECORD["families"].dataType)])


def manifest(records: DataFrame, bound: dict[str, str]) -> tuple[dict[str, object], DataFrame]:
    """(head with the manifest's digest, rows): rows stay a table; the digest is of head and rows as one object.

    bound: the digests of registries, policies and the clean report that it was made under.
    """
    rows = trust.manifest_records(records)
    summary = trust.record_summary(records)
    head = {"schema_version": versions.DATA_MANIFEST, **bound, "record_count": summary["record_count"], "split_counts": summary["split_counts"], "source_counts": summary["source_counts"], "record_set_sha256": summary["semantic_sha256"]}
    return head | {"manifest_sha256": _with_rows(head, rows)}, rows


def _with_rows(head: dict[str, object], rows: DataFrame) -> str:
    """The digest of the object of head and "records": [rows by sample_id]."""
    whole = json.dumps({**head, "records": "\x00"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    before, after = whole.split('"\\u0000"')
    return ordered_sha256(rows, ["sample_id"], canonical_json(F.struct(*MANIFEST_ROW.fieldNames()), MANIFEST_ROW), before + "[", "]" + after)[0]


def manifest_violations(head: dict[str, object], rows: DataFrame) -> list[str]:
    """Fields of a manifest that its own rows contradict."""
    body = {k: v for k, v in head.items() if k != "manifest_sha256"}
    counts = lambda c: {r[0]: r[1] for r in rows.groupBy(c).count().collect()}
    digest = set_digest(rows.select("sample_id", "payload_sha256"), "sample_id", "payload_sha256").first()
    seen = {"record_count": digest["n"], "split_counts": counts("split"), "source_counts": counts("source_id"), "record_set_sha256": digest["digest"], "manifest_sha256": _with_rows(body, rows)}
    return [k for k, v in seen.items() if head.get(k) != v]


def data_trust(candidates: DataFrame, held: DataFrame, sources: DataFrame, transforms: DataFrame, policy: trust.SplitPolicy, bound: dict[str, str], ledger: DataFrame | None = None) -> tuple[dict[str, object], DataFrame]:
    """(report, clean records): assign, validate, scan, quarantine, scan again, unite, validate, manifest."""
    assigned = materialize(trust.assign_splits(candidates, policy), "audit-assigned")
    require_none(trust.set_violations(assigned, sources, transforms, ledger))
    require_none(trust.set_violations(held, sources, transforms, ledger))
    dirty, matches = contamination_report(assigned, held)
    require_none(trust.unknown_matches(matches, assigned))
    kept, gone = trust.quarantined(assigned, matches)
    kept = materialize(kept, "audit-kept")
    clean, again = contamination_report(kept, held)
    require_none(again.select(F.lit("still_contaminated").alias("rule"), F.col("train_record_id").alias("key")))
    final = materialize(kept.unionByName(held), "audit-final")
    require_none(trust.set_violations(final, sources, transforms, ledger))
    under = {"split_policy_sha256": policy.sha256, "contamination_policy_sha256": trust.canonical_sha256(POLICY), "contamination_report_sha256": clean["report_sha256"], "parent_ledger_sha256": trust.canonical_sha256(NO_PARENTS)} | bound
    head, _ = manifest(final, under)
    report = {
        **{k: v for k, v in under.items() if k != "contamination_report_sha256"}, "assignment_sha256": trust.assignment_sha256(assigned), "split_counts": trust.record_summary(assigned)["split_counts"], "dirty_report_sha256": dirty["report_sha256"],
        "dirty_match_counts": dirty["match_counts"], "clean_report_sha256": clean["report_sha256"], "quarantined_record_count": gone.count(), "clean_training_record_count": clean["training_record_count"], "evaluation_record_count": clean["evaluation_record_count"],
        "manifest_sha256": head["manifest_sha256"], "manifest_record_set_sha256": head["record_set_sha256"], "manifest_split_counts": head["split_counts"],
    }
    return report, final


CASE = "case_id string, category string, reference string, prediction string, expected_reward double, expected_status string, notes string"


def verifier_audit(cases: DataFrame, scorer: Callable[[Column, Column], Column], least: int = 100, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """(counts by category, failures without texts) of a scorer on a corpus of between `least` and `most` cases; a reference without meaning has no reward."""
    n = cases.count()
    if not least <= n <= most:
        raise ValueError(f"a corpus has {least} to {most} cases, this one {n}")
    told = cases.withColumn("status", scorer(F.col("reference"), F.col("prediction"))["verification_status"])
    told = told.withColumn("reward", F.when(F.col("status") != "reference_invalid", (F.col("status") == "match").cast("double")))
    right = F.col("reward").eqNullSafe(F.col("expected_reward")) & (F.col("expected_status").isNull() | (F.col("status") == F.col("expected_status")))
    told = materialize(told.select("case_id", "category", "expected_reward", "reward", "expected_status", "status", right.alias("passed")), "verified")
    counts = told.groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return counts, told.where(~F.col("passed")).drop("passed")


def statistics(panel: DataFrame, bindings: dict[str, str], protocol: paired.Protocol | None = None) -> DataFrame:
    """DECISIONS of a checked panel under the registered protocol."""
    protocol = protocol or paired.Protocol()
    require_none(paired.panel_violations(panel, protocol))
    return paired.confirm(panel, protocol, bindings)


def _strict(spark: SparkSession, path: str, schema: T.StructType, key: str, limits: Limits | None = None) -> DataFrame:
    records, broken = read_records(spark, path, schema, key, limits)
    require_none(broken.select("rule", F.concat_ws(":", "file", "line").alias("key")))
    return records


def scorer_of(name: str) -> Callable[[Column, Column], Column]:
    if name in ("plain_number", "strict_label"):
        return getattr(evaluation, name)
    module, _, factory = name.partition(":")
    return scored_by(getattr(importlib.import_module(module), factory))


EVALUATOR = ("descriptor", "items", "references", "greedy", "sampling", "predictions", "expectation")


def main(argv: list[str] | None = None) -> int:
    """0 if the report is what the golden document says, or none is given; 1 otherwise."""
    parser = argparse.ArgumentParser(description="Audits over Spark")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind, needed in (("data-trust", ("sources", "transforms", "policy", "candidates", "evaluation")), ("statistics", ("panel",)), ("verifier", ("corpus", "scorer")), ("evaluator", (*EVALUATOR, "checkpoint", "scorer"))):
        own = kinds.add_parser(kind)
        for name in (*needed, "out"):
            own.add_argument(f"--{name}", required=True)
        own.add_argument("--golden")
    told = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if told.kind == "data-trust":
        sources, _, source_sha = documents.read_source_registry(spark, told.sources)
        transforms, transform_sha = documents.read_transform_registry(spark, told.transforms)
        records = [_strict(spark, p, trust.RECORD, "sample_id") for p in (told.candidates, told.evaluation)]
        report, _ = data_trust(*records, sources, transforms, documents.read_split_policy(spark, told.policy), {"source_registry_sha256": source_sha, "transform_registry_sha256": transform_sha})
    elif told.kind == "statistics":
        report = {r["hypothesis"]: r.asDict() for r in statistics(*paired.read_panel(spark, told.panel)).collect()}
    elif told.kind == "evaluator":
        report = evaluator_audit(spark, {k: getattr(told, k) for k in EVALUATOR}, told.checkpoint, scorer_of(told.scorer))
    else:
        cases = _strict(spark, told.corpus, spark.createDataFrame([], CASE).schema, "case_id", Limits(blank_is_fault=False))
        counts, failures = verifier_audit(cases, scorer_of(told.scorer))
        report = {"categories": {r["category"]: r.asDict() for r in counts.collect()}, "failures": [r["case_id"] for r in failures.orderBy("case_id").collect()]}
    documents.write_document(told.out, report)
    golden = documents.read_document(spark, told.golden) if told.golden else report
    wrong = golden_violations(golden, {k: v for k, v in report.items() if k in golden})
    for name in wrong:
        print(name, file=sys.stderr)
    return 1 if wrong or report.get("failures") else 0


if __name__ == "__main__":
    sys.exit(main())
