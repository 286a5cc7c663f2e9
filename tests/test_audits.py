"""The audits end to end, against reports whose digests are known."""

import json

import pytest

from tests import scorers
from tests.test_paired import BOUND, panel  # noqa: F401
from tests.test_trust import POLICY, SOURCES, records, tables  # noqa: F401
from tests.trust_rows import CANDIDATES, HELD, LINEAGE
from veraline.operators import evaluation, trust
from veraline.operators.checks import ContractError
from veraline.plans import audits
from veraline.sources.documents import write_document

GOLDEN = {
    "assignment_sha256": "7c7fb8f678c7b2dbb2ea5e311208f4eabcffcbdb0d3c1135f990b3dda777a93c", "clean_report_sha256": "c701b66ac5abf9a9a5e1820d14b51ebc0f0ef24561e3127f27f1f3fb36add09e", "clean_training_record_count": 9, "evaluation_record_count": 4,
    "contamination_policy_sha256": "675338221f7b274af54592a6e5552d47355fa4219853820150a971915eb53fa7", "dirty_report_sha256": "8cd86ee5012783bdec2b4d7866faf872fcf7e8afe6c5f480b1e5f6e24b5bb7d4", "manifest_record_set_sha256": "a6370acff1459d707faade76b1f27d5851eea631220fa1024e13e4449a9553f1",
    "manifest_sha256": "ae6b70c2f7667b0ee66d33ce59cd7fbb558ba4d5ba4934e69304bfd3f5abc364", "parent_ledger_sha256": "7d0b208bf140bf80d38bdb458324439eab114bf6188b465560d7b8e160865c73", "split_policy_sha256": "e877fd58abb2a903ae31f6acc88d046b2abc0f703fd0e18a8869abe53a153959",
    "split_counts": {"D_anchor": 3, "D_core": 2, "D_dev": 5, "D_select": 4, "D_teacher_gate": 1}, "source_registry_sha256": "5ee29d34ac4cd242a6f36859293ccd38dcc2cc7ddd341434a94352a6d1849f43", "quarantined_record_count": 6,
}


def test_data_trust_from_files_to_the_known_report(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    for name, rows in (("candidates", CANDIDATES), ("held", HELD)):
        with open(at(f"{name}.jsonl"), "w") as f:
            for r in records(spark, rows).collect():
                f.write(json.dumps(r.asDict(True)) + "\n")
    names = [x.split()[0] for x in trust.SOURCE.split(", ")]
    write_document(at("s.json"), {"schema_version": "d06-source-registry-v1", "allowed_license_expressions": ["Apache-2.0", "MIT"], "sources": [dict(zip(names, s, strict=True)) for s in SOURCES]})
    write_document(at("t.json"), {"schema_version": "d06-transform-registry-v1", "artifacts": [{"transform_name": LINEAGE[0], "transform_version": LINEAGE[1], "code_path": "a/code.py", "code_sha256": LINEAGE[2], "config_path": "a/config.json", "config_sha256": LINEAGE[3]}]})
    write_document(at("p.json"), POLICY.to_record())
    # the transform registry's digest holds paths, which are other ones here; so do manifests made under it
    write_document(at("g.json"), {k: v for k, v in GOLDEN.items() if k != "manifest_sha256"})
    args = ["data-trust", "--sources", at("s.json"), "--transforms", at("t.json"), "--policy", at("p.json"), "--candidates", at("candidates.jsonl"), "--evaluation", at("held.jsonl"), "--out", at("out.json"), "--golden", at("g.json")]
    assert audits.main(args) == 0


def test_manifests(spark, tables):  # noqa: F811
    candidates, held, *_ = tables
    assigned = trust.assign_splits(candidates, POLICY)
    kept, _ = trust.quarantined(assigned, trust.contamination(assigned, held))
    final = kept.unionByName(held)
    bound = {"transform_registry_sha256": "8b4a8f1eee0e1355cf2d004e86043eaf73f2c730c73e28f1a23eef6c9d8ff758", "contamination_report_sha256": GOLDEN["clean_report_sha256"]} | {k: GOLDEN[k] for k in ("source_registry_sha256", "split_policy_sha256", "parent_ledger_sha256", "contamination_policy_sha256")}
    head, rows = audits.manifest(final, bound)
    assert head["manifest_sha256"] == GOLDEN["manifest_sha256"] and audits.manifest_violations(head, rows) == []
    assert set(audits.manifest_violations(head | {"record_count": 3}, rows.where("sample_id <> 'eval:000'"))) == {"record_count", "split_counts", "source_counts", "record_set_sha256", "manifest_sha256"}


def test_statistics_from_a_panel(panel):  # noqa: F811
    assert {r.hypothesis: r.extreme_count for r in audits.statistics(panel, BOUND).collect()}["C1a"] == 371


CASES = [(f"{k * 3}/6", f"So \\\\boxed{{{k}/2}}".replace("\\\\", "\\"), 1.0, "match") for k in range(1, 40)] + [("7", f"The answer is {k}", 0.0, "mismatch") for k in range(8, 48)] + [("7", f"answer: about {k}", 0.0, "prediction_unparseable") for k in range(20)] + [("7", "7 it is", 0.0, "prediction_not_extracted"), ("x", "Answer: 1", None, "reference_invalid")]


def test_verifier_corpus_from_a_file(spark, tmp_path):
    lines = [json.dumps({"case_id": f"c{k}", "category": c[3], "reference": c[0], "prediction": c[1], "expected_reward": c[2], "expected_status": c[3] if k % 2 else None, "notes": None}) for k, c in enumerate(CASES)]
    (tmp_path / "cases.jsonl").write_text("\n\n".join(lines) + "\n")
    args = ["verifier", "--corpus", str(tmp_path / "cases.jsonl"), "--out", str(tmp_path / "out.json"), "--scorer"]
    assert audits.main([*args, "plain_number"]) == 0
    told = json.loads((tmp_path / "out.json").read_text())
    assert sum(c["total"] for c in told["categories"].values()) == len(CASES) and told["failures"] == []
    frame = spark.createDataFrame([(f"c{k}", *c[3:], *c[:2], c[2], c[3], None) for k, c in enumerate(CASES)], audits.CASE)
    counts, failures = audits.verifier_audit(frame, evaluation.strict_label)
    assert failures.count() >= 39
    with pytest.raises(ValueError):
        audits.verifier_audit(frame.limit(5), evaluation.plain_number)


def test_evaluator_from_files_to_the_known_summaries(spark, tmp_path):
    paths = scorers.evaluator_files(tmp_path)
    args = ["evaluator", *(x for k in audits.EVALUATOR for x in (f"--{k}", paths[k])), "--checkpoint", scorers.CHECKPOINT, "--scorer", "tests.scorers:make", "--out", str(tmp_path / "report.json")]
    assert audits.main(args) == 0
    told = json.loads((tmp_path / "report.json").read_text())
    assert told["passed"] and told["failures"] == [] and set(told["runs"]) == {"greedy", "sampling"}
    expected = json.loads(open(paths["expectation"]).read())
    expected["runs"]["greedy"]["truncation_count"] = 2
    expected["runs"]["sampling"]["report_sha256"] = "0" * 64
    write_document(paths["expectation"], expected)
    assert audits.main(args) == 1
    assert json.loads((tmp_path / "report.json").read_text())["failures"] == ["runs.greedy.truncation_count", "runs.sampling.report_sha256"]
    with open(paths["items"], "a") as f:
        f.write("\n")
    with pytest.raises(ContractError, match="bytes"):
        audits.main(args)
