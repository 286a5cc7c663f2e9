"""Confirmatory statistics on a panel whose results are known, and documents read strictly."""

import json
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_trust import SOURCES
from veraline.operators import paired
from veraline.operators.checks import ContractError, require_none
from veraline.sources import documents

BOUND = {name: str(k) * 64 for name, k in zip(paired.BINDINGS, (1, 2, 3, 4, 5, 6, 7), strict=True)}
A3 = ("111", "000", "100", "010", "101", "000", "110", "000")


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        (f"item-{k:03}", k, f"L{k % 2 + 1}", arm, seed, {"A1": "111", "A3": A3[k], "A4": A3[k]}.get(arm, "000")[j] == "1")
        for k in range(8) for arm in paired.ARMS for j, seed in enumerate((101, 202, 303))
    ]
    return spark.createDataFrame(rows, paired.PANEL)


def test_registered_analysis(panel):
    protocol = paired.Protocol()
    assert protocol.sha256 == "dc8789a4463691523867f1813d99cd3867b899673f69bfd359bf0307014f575f"
    require_none(paired.panel_violations(panel, protocol))
    streams = {r.hypothesis: (r.bootstrap_stream, r.flip_stream) for r in paired.evidence(panel, protocol, BOUND).collect()}
    assert streams["C1a"] == ("81e3f4b2522aaf288a090e005b3c99798fc46b4802a7d53ed8dfcf768dbf70d0", "0cb1dfd7b4b734e42471a8266725619a9967e19e4a13e584b3166236b740b9d1")
    decisions = paired.confirm(panel, protocol, BOUND).cache()
    got = {r.hypothesis: r for r in decisions.collect()}
    a, b, c = got["C1a"], got["C1b"], got["C2"]
    assert (a.point_ppm, a.extreme_count, a.p_num, a.p_den, a.p_ppm, a.holm_ppm, a.practical_success) == (1_000_000, 371, 372, 100_001, 3720, 7440, True)
    assert (b.point_ppm, b.extreme_count, b.holm_ppm, b.practical_success) == (0, 100_000, 1_000_000, False)
    assert (c.point_ppm, c.decision, c.unstable) == (0, "practical_equivalence", False)
    require_none(paired.revalidated(decisions, panel, protocol, BOUND))
    with pytest.raises(ContractError, match="not_reproduced: C2"):
        require_none(paired.revalidated(decisions.withColumn("decision", F.when(F.col("hypothesis") == "C2", "superior_A3").otherwise(F.col("decision"))), panel, protocol, BOUND))


def whole_totals(units, strata, repetitions, seed):
    """The registered bootstrap in whole batches."""
    places = [np.flatnonzero(strata == s) for s in sorted(set(strata.tolist()))]
    rng = np.random.Generator(np.random.PCG64(seed))
    batch = min(paired.BOOTSTRAP_BATCH, max(1, paired.MOST_CELLS // max(map(len, places))))
    sizes = [min(batch, repetitions - done) for done in range(0, repetitions, batch)]
    return np.concatenate([sum(units[at[rng.integers(0, len(at), size=(n, len(at)), dtype=np.int64)]].sum(axis=1) for at in places) for n in sizes])


def whole_signs(units, repetitions, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    batch = min(paired.FLIP_BATCH, max(1, paired.MOST_CELLS // len(units)))
    sizes = [min(batch, repetitions - done) for done in range(0, repetitions, batch)]
    return np.concatenate([(rng.integers(0, 2, size=(n, len(units)), dtype=np.int8).astype(np.int64) * 2 - 1) @ units for n in sizes])


@pytest.mark.parametrize(("n", "kinds", "repetitions"), [(8, 2, 10_000), (1, 1, 500), (301, 3, 3_001), (2_500, 7, 2_047), (37, 1, 5), (1_999, 2, 1_333)])
def test_pieces_replay_the_registered_stream(n, kinds, repetitions):
    rng = np.random.default_rng(n)
    units, strata = rng.integers(-3, 4, n), np.array([f"s{k % kinds}" for k in range(n)], object)
    got, count = np.zeros(repetitions, np.int64), 0
    for p in paired.pieces("h", strata, repetitions, 77, False):
        got[p.first : p.first + p.rows] += paired.replayed(p, units, strata)
        count += 1
    assert (got == whole_totals(units, strata, repetitions, 77)).all() and (count >= 32 or repetitions < 128)
    signs = np.concatenate([paired.replayed(p, units, strata) for p in paired.pieces("h", strata, repetitions, 78, True)])
    assert (signs == whole_signs(units, repetitions, 78)).all()


def test_panel_rules(panel):
    rules = lambda p: {r.rule for r in paired.panel_violations(p, paired.Protocol()).collect()}
    assert rules(panel.where("not (item_index = 3 and arm = 'A2' and seed = 101)")) == {"cells"}
    assert "repeated_cell" in rules(panel.unionByName(panel.limit(1)))
    assert rules(panel.where("item_index > 0")) == {"consecutive_indexes"}
    assert rules(panel.withColumn("stratum", F.when((F.col("arm") == "A0") & (F.col("item_index") == 1), "other").otherwise(F.col("stratum")))) == {"one_stratum"}


def test_exact_arithmetic():
    assert paired.type7(np.array([1, 2, 4]), Fraction(3, 4)) == 3 and paired.type7(np.array([5]), Fraction(1, 3)) == 5
    assert [paired.half_up_ppm(Fraction(n, 3_000_000)) for n in (1, 2, -2, 3)] == [0, 1, -1, 1] and paired.half_up_ppm(Fraction(1, 2_000_000)) == 1
    assert paired.holm({"a": Fraction(1, 100), "b": Fraction(1, 50), "c": Fraction(9, 10)}) == {"a": Fraction(3, 100), "b": Fraction(1, 25), "c": Fraction(9, 10)}


def test_documents(spark, tmp_path, panel):
    names = ("source_id", "uri", "revision_kind", "revision", "license_expression", "license_url", "license_evidence_sha256", "allowed_uses")
    registry = {"schema_version": "d06-source-registry-v1", "allowed_license_expressions": ["Apache-2.0", "MIT"], "sources": [dict(zip(names, s, strict=True)) for s in SOURCES]}
    path = str(tmp_path / "r.json")
    assert documents.write_document(path, registry) == "5ee29d34ac4cd242a6f36859293ccd38dcc2cc7ddd341434a94352a6d1849f43"
    sources, licenses, digest = documents.read_source_registry(spark, path)
    assert sources.count() == 3 and digest == "5ee29d34ac4cd242a6f36859293ccd38dcc2cc7ddd341434a94352a6d1849f43" and licenses == ["Apache-2.0", "MIT"]
    policy = {"schema_version": "d06-family-split-policy-v1", "namespace": "d06-synthetic-audit-v1", "family_dimensions": ["source", "problem", "template"], "allocations": [{"split": s, "weight": 1} for s in ("D_anchor", "D_core", "D_dev", "D_select", "D_teacher_gate")]}
    documents.write_document(path, policy)
    assert documents.read_split_policy(spark, path).sha256 == "e877fd58abb2a903ae31f6acc88d046b2abc0f703fd0e18a8869abe53a153959"
    for text, said in (('{"a": 1, "a": 2}', "repeated"), ('{"a": NaN}', "NaN"), ("[1]", "object"), ("{", "not JSON"), ("﻿{}", "byte-order"), (json.dumps({**policy, "more": 1}), "unknown"), (json.dumps({**policy, "schema_version": "v0"}), "schema_version")):
        (tmp_path / "bad.json").write_text(text, encoding="utf-8")
        with pytest.raises(ContractError, match=said):
            documents.read_split_policy(spark, str(tmp_path / "bad.json")) if "split" in text else documents.read_document(spark, str(tmp_path / "bad.json"))
    items = [{"item_id": f"item-{k:03}", "item_index": k, "stratum": "L1", "correctness": {a: [True, False, True] for a in paired.ARMS}} for k in range(3)]
    documents.write_document(path, {"training_seeds": [101, 202, 303], "items": items, **BOUND})
    read, bound = paired.read_panel(spark, path)
    require_none(paired.panel_violations(read, paired.Protocol()))
    assert read.count() == 45 and bound == BOUND
    transforms = {"schema_version": "d06-transform-registry-v1", "artifacts": [{"transform_name": "ingest", "transform_version": "1.0.0", "code_path": "a/b.py", "code_sha256": "1" * 64, "config_path": "../x", "config_sha256": "2" * 64}]}
    documents.write_document(path, transforms)
    with pytest.raises(ContractError, match="config_path"):
        documents.read_transform_registry(spark, path)
    documents.write_document(path, {"schema_version": "d06-parent-payload-ledger-v1", "entries": [{"sample_id": "p", "split": "E", "payload_sha256": "3" * 64}]})
    assert documents.read_parent_ledger(spark, path)[0].count() == 1
