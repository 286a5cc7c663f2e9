"""JSON documents of a driver's size: registries, policies, protocols, reports.

They are read strictly, through Spark's readers, so from any store that these reach; and
written whole or not at all.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veraline.functions import versions
from veraline.operators import trust
from veraline.operators.checks import ContractError, require_none
from veraline.sources.committed import document_text, write_text

MOST_BYTES = 16 << 20


def strict_json(text: str) -> object:
    """The value of a JSON text; repeated keys, NaN and infinity are errors."""

    def pairs(found):
        keys = [k for k, _ in found]
        if len(set(keys)) != len(keys):
            raise ContractError("repeated key in a JSON object")
        return dict(found)

    def constant(name):
        raise ContractError(f"{name} isn't JSON")

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError) as error:
        raise ContractError("not JSON") from error


def read_document(spark: SparkSession, path: str, keys: set[str] | None = None, version: str | None = None) -> dict:
    """One JSON object: at most MOST_BYTES, UTF-8 without a byte-order mark; its keys and schema_version, if given, must be just these."""
    found = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content")).limit(2).collect()
    if len(found) != 1:
        raise ContractError(f"{len(found)} documents where one is wanted")
    raw = found[0]["content"]
    if raw is None:
        raise ContractError(f"the document has more than {MOST_BYTES} bytes")
    if raw.startswith(b"\xef\xbb\xbf"):
        raise ContractError("the document begins with a byte-order mark")
    try:
        value = strict_json(bytes(raw).decode("utf-8"))
    except UnicodeDecodeError as error:
        raise ContractError("the document isn't UTF-8") from error
    if not isinstance(value, dict):
        raise ContractError("the document isn't an object")
    exact_keys(value, keys, "document")
    if version and value.get("schema_version") != version:
        raise ContractError(f"schema_version isn't {version}")
    return value


def exact_keys(value: dict, keys: set[str] | None, what: str) -> None:
    if keys is not None and set(value) != set(keys):
        raise ContractError(f"{what}: missing {sorted(set(keys) - set(value))}, unknown {sorted(set(value) - set(keys))}")


def _rows(spark: SparkSession, items: list, schema: str, what: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    if not isinstance(items, list):
        raise ContractError(f"{what} isn't a list")
    for item in items:
        exact_keys(item, set(names), what)
    return spark.createDataFrame([tuple(i[n] for n in names) for i in items], schema)


def read_source_registry(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], str]:
    """(sources, allowed licences, canonical digest), checked."""
    whole = read_document(spark, path, {"schema_version", "allowed_license_expressions", "sources"}, versions.SOURCE_REGISTRY)
    licenses = sorted(whole["allowed_license_expressions"])
    if not licenses or len(set(licenses)) != len(licenses) or not whole["sources"]:
        raise ContractError("a registry has sources, and licences that are allowed once")
    sources = _rows(spark, whole["sources"], trust.SOURCE, "source")
    require_none(trust.source_violations(sources, licenses))
    canonical = {**whole, "allowed_license_expressions": licenses, "sources": [{**s, "allowed_uses": sorted(s["allowed_uses"])} for s in sorted(whole["sources"], key=lambda s: s["source_id"])]}
    return sources, licenses, trust.canonical_sha256(canonical)


def read_transform_registry(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(transforms, canonical digest), checked."""
    whole = read_document(spark, path, {"schema_version", "artifacts"}, versions.TRANSFORM_REGISTRY)
    transforms = _rows(spark, whole["artifacts"], trust.TRANSFORM, "transform")
    require_none(trust.transform_violations(transforms))
    return transforms, trust.canonical_sha256({**whole, "artifacts": sorted(whole["artifacts"], key=lambda a: [a[k] for k in trust.TRANSFORM_KEY])})


def read_parent_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(ledger, canonical digest), checked."""
    whole = read_document(spark, path, {"schema_version", "entries"}, versions.PARENT_PAYLOAD_LEDGER)
    ledger = _rows(spark, whole["entries"], trust.PARENT, "parent")
    require_none(trust.parent_violations(ledger))
    return ledger, trust.canonical_sha256({**whole, "entries": sorted(whole["entries"], key=lambda e: e["sample_id"])})


def read_split_policy(spark: SparkSession, path: str) -> trust.SplitPolicy:
    whole = read_document(spark, path, {"schema_version", "namespace", "family_dimensions", "allocations"}, versions.FAMILY_SPLIT_POLICY)
    if tuple(whole["family_dimensions"]) != trust.DIMENSIONS:
        raise ContractError(f"family_dimensions are {trust.DIMENSIONS}")
    weights: dict[str, int] = {}
    for a in whole["allocations"]:
        exact_keys(a, {"split", "weight"}, "allocation")
        if a["split"] not in trust.TRAINING or a["split"] in weights or type(a["weight"]) is not int or a["weight"] < 1:
            raise ContractError("allocations are of training splits, once each, with whole weights from 1 on")
        weights[a["split"]] = a["weight"]
    if not weights:
        raise ContractError("a policy has allocations")
    return trust.SplitPolicy(whole["namespace"], weights)


def write_document(path: str, value: object) -> str:
    """Write one JSON document of a driver's size, whole or not at all, to the store of the path; returns its canonical digest."""
    write_text(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), path, document_text(value))
    return trust.canonical_sha256(value)
