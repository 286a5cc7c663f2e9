"""Versions of schemas, as records and digests carry them."""

# Digests agree with other writers' only under just these names.
CONTAMINATION_POLICY = "d06-contamination-policy-v1"
CONTAMINATION_REPORT = "d06-contamination-report-v1"
DATA_MANIFEST = "d06-data-manifest-v1"
DATA_RECORD = "d06-data-record-v1"
FAMILY_SPLIT_POLICY = "d06-family-split-policy-v1"
PARENT_PAYLOAD_LEDGER = "d06-parent-payload-ledger-v1"
SOURCE_REGISTRY = "d06-source-registry-v1"
TRANSFORM_REGISTRY = "d06-transform-registry-v1"
BENCHMARK_DESCRIPTOR = "d07-benchmark-descriptor-v1"
EVALUATOR_EXPECTATION = "d07-evaluator-audit-expectation-v1"
EVALUATOR_PREDICTIONS = "d07-evaluator-fixture-predictions-v2"
EVALUATOR_REPORT = "d07-evaluator-audit-report-v1"
PUBLIC_BENCHMARK_ITEM = "d07-public-benchmark-item-v1"
SEALED_REFERENCE = "d07-sealed-reference-v1"
GENERATION_MANIFEST = "d07-generation-manifest-v1"
GENERATION_PROTOCOL = "d07-generation-protocol-v1"
GENERATION_RECORD = "d07-generation-record-v1"
GENERATION_REQUEST_ID = "d07-generation-request-id-v1"
PAIRED_GENERATION_SEED = "d07-paired-generation-seed-v1"
SAMPLE_SCORE = "d07-sample-score-v1"
DERIVED_RNG_STREAM = "d08-derived-rng-stream-v1"
RESAMPLING_DESIGN = "d08-resampling-design-v1"
STATISTICS_PROTOCOL = "d08-statistics-protocol-v1"
