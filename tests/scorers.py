"""A small evaluation whose digests and counts are known, and a scorer for its answers."""

import hashlib
import json
import re
from fractions import Fraction

from veraline.operators import evaluation as ev

# Prompts, references, answers and protocols behind known digests, and these digests and counts.
PROMPTS = ("Compute six multiplied by seven.", "Reduce the rational number obtained by dividing twelve by twenty-four.", "List every real root of x squared equals four.", "A triangle has side lengths two, two, and three. Determine its perimeter.", "Evaluate the sum of the first five positive integers.", "Express three divided by four as a reduced fraction.")
REFERENCES = ("42", "1/2", r"\{-2,2\}", "7", "15", "3/4")
GREEDY = ("Final answer: 42", "Final answer: 2/3", r"\boxed{\{-2,2\}}", "I cannot solve this problem.", "Final answer: 15", "Final answer: 1/4")
SAMPLED = (
    ("Final answer: 42", r"\boxed{42}", "42", "Answer = 42", "Final answer: 42", r"\boxed{42}", "42", "Answer = 42"), ("Final answer: 1/2", r"\boxed{1/2}", "1/2", "Answer = 1/2", "Final answer: 2/3", "2/3", "Final answer: 3/4", "1"),
    (r"\boxed{\{-2,2\}}", "Final answer: 2", "Final answer: -2", "0", "4", r"Final answer: 2; then \boxed{0}", "I cannot solve this problem.", "Final answer: 1"), ("Final answer: 6", "6", "8", "Final answer: 5", "I cannot solve this problem.", "Final answer: 9", "10", "0"),
    ("Final answer: 15", r"\boxed{15}", "14", "Final answer: 10", "16", "0", "5", "Final answer: 20"), ("Final answer: 3/4", r"\boxed{3/4}", "3/4", "Answer = 3/4", "Final answer: 0.75", r"\frac{3}{4}", "Final answer: 1/4", "1"),
)
COMMON = dict(max_new_tokens=64, system_prompt="Solve the problem and state one final answer.", chat_template_sha256="a" * 64, eos_token_id=2, stop_token_ids=(2,), stop_sequences=("<end>",))
PROTOCOLS = {"greedy": ev.Protocol("greedy", 1, **COMMON), "sampling": ev.Protocol("sampling", 8, **COMMON, temperature_ppm=700_000, top_p_ppm=950_000, top_k=0, seed_namespace="d07-synthetic-paired", base_seed=20260904)}
CHECKPOINT = "b" * 64
WANT = {
    "greedy": ("cfa8cf0f5513e713d29b9fecc285b5ead22f490c920a65105fcaa002bc6f88c5", {"protocol_sha256": "cfa8cf0f5513e713d29b9fecc285b5ead22f490c920a65105fcaa002bc6f88c5", "generation_record_set_sha256": "8ea5e5b50205bfafa28d8b8754d87c1e1da22c4b1ad39d4e8c30b3e5271fe56e", "item_count": 6, "sample_count": 6, "correct_sample_count": 3, "completion_token_count_total": 151, "truncation_count": 1, "answer_accuracy_ppm": 500000, "extraction_rate_ppm": 833333, "parse_rate_ppm": 833333, "truncation_rate_ppm": 166667, "pass_at_k_ppm": {"1": 500000}, "verification_status_counts": {"match": 3, "mismatch": 2, "prediction_not_extracted": 1}, "finish_reason_counts": {"eos": 5, "length": 1}}),
    "sampling": ("e07e5d433f91dc39edbe657b1af893124f03b17847eadc25429d6be3cc0e80a4", {"protocol_sha256": "e07e5d433f91dc39edbe657b1af893124f03b17847eadc25429d6be3cc0e80a4", "generation_record_set_sha256": "8644b9a3ba953b5bf6cbc44f70b2cf9c18cd02b379760fdbf575c4ac91cda03b", "item_count": 6, "sample_count": 48, "correct_sample_count": 21, "completion_token_count_total": 597, "truncation_count": 1, "answer_accuracy_ppm": 437500, "extraction_rate_ppm": 958333, "parse_rate_ppm": 958333, "truncation_rate_ppm": 20833, "pass_at_k_ppm": {"1": 437500, "8": 833333}, "verification_status_counts": {"match": 21, "mismatch": 25, "prediction_not_extracted": 2}, "finish_reason_counts": {"eos": 47, "length": 1}}),
}


def value(text):
    """A whole number, fraction, decimal or set of these; None for anything else."""
    text = re.sub(r"\\frac\{(\d+)\}\{(\d+)\}", r"\1/\2", text.strip())
    if text.startswith(r"\{") and text.endswith(r"\}"):
        found = [value(x) for x in text[2:-2].split(",")]
        return None if None in found else frozenset(found)
    return Fraction(text) if re.fullmatch(r"-?\d+(?:/[1-9]\d*|\.\d+)?", text) else None


def verdict(reference, said):
    want = value(reference)
    if want is None:
        return ("reference_invalid", "none", "none", None, 0)
    found = [x for m in re.finditer(r"\\boxed\{(.*)\}|[Aa]nswer(?::| =) ([^;]+)", said) for x in m.groups() if x]
    kind = "explicit" if found else "direct"
    if not found and value(said) is not None:
        found = [said]
    if not found:
        return ("prediction_not_extracted", "no_final_answer", "unparsed", None, 0)
    got = value(found[-1])
    status = "prediction_unparseable" if got is None else "match" if got == want else "mismatch"
    return (status, "extracted", "unparsed" if got is None else "parsed", kind, len(found))


def make():
    return lambda references, said: [verdict(a, b) for a, b in zip(references, said)]


def evaluator_files(folder):
    """All files of an evaluator audit, by name."""
    paths = {k: str(folder / f"{k}.{'jsonl' if k in ('items', 'references') else 'json'}") for k in ("descriptor", "items", "references", "greedy", "sampling", "predictions", "expectation")}
    own = {"benchmark_id": "synthetic/math-eval", "benchmark_revision": "4" * 40}

    def put(name, data):
        with open(paths[name], "wb") as f:
            f.write(data)
        return hashlib.sha256(data).hexdigest()

    def lines(name, rows):
        return put(name, b"".join(json.dumps(r, sort_keys=True).encode() + b"\n" for r in rows))

    def document(name, value):
        return put(name, json.dumps(value, sort_keys=True).encode() + b"\n")

    items = lines("items", [{**own, "item_id": f"math:{k:03}", "item_index": k, "prompt": p, "strata": {"level": str(k % 2)}, "schema_version": "d07-public-benchmark-item-v1"} for k, p in enumerate(PROMPTS)])
    references = lines("references", [{**own, "item_id": f"math:{k:03}", "reference": r, "schema_version": "d07-sealed-reference-v1"} for k, r in enumerate(REFERENCES)])
    told = {**own, "schema_version": "d07-benchmark-descriptor-v1", "revision_kind": "git_commit", "split_name": "test", "task": "exact_math", "item_count": 6, "public_items_sha256": items, "sealed_references_sha256": references, "source_registry_sha256": "c" * 64, "data_manifest_sha256": "d" * 64}
    descriptor = document("descriptor", told)
    for mode, p in PROTOCOLS.items():
        document(mode, ev.asdict(p))
    said = [{"item_id": f"math:{k:03}", "greedy": g, "sampling": list(s)} for k, (g, s) in enumerate(zip(GREEDY, SAMPLED))]
    cut = [{"mode": "greedy", "item_id": "math:003", "sample_index": 0}, {"mode": "sampling", "item_id": "math:003", "sample_index": 4}]
    predictions = document("predictions", {"schema_version": "d07-evaluator-fixture-predictions-v2", "items": said, "truncations": cut})
    document("expectation", {"schema_version": "d07-evaluator-audit-expectation-v1", "benchmark_descriptor_sha256": descriptor, "public_items_sha256": items, "sealed_references_sha256": references, "fixture_predictions_sha256": predictions, "runs": {m: w for m, (_, w) in WANT.items()}})
    return paths
