"""Trust operators on a small record set whose digests, splits, matches and quarantine are known."""

import pytest
from pyspark.sql import functions as F

from tests.trust_rows import CANDIDATES, HELD, LINEAGE
from veraline.functions.canonical import set_digest
from veraline.operators import trust
from veraline.operators.checks import ContractError, require_none

POLICY = trust.SplitPolicy("d06-synthetic-audit-v1", dict.fromkeys(trust.TRAINING, 1))
SOURCES = [
    (i, f"https://example.invalid/datasets/{n}", "git_commit", k * 40, lic, f"https://example.invalid/licenses/{n}", c * 64, uses)
    for i, n, k, lic, c, uses in (
        ("synthetic/eval", "synthetic-eval", "3", "MIT", "c", ["evaluate"]), ("synthetic/train-a", "synthetic-train-a", "1", "Apache-2.0", "a", ["redistribute", "train"]), ("synthetic/train-b", "synthetic-train-b", "2", "Apache-2.0", "b", ["redistribute", "train"]),
    )
]


def records(spark, rows, parents=()):
    made = [(trust.RECORD_VERSION, i, s, rev, split, fam, p, m, ref, res, q, st, (*LINEAGE, list(parents))) for i, s, rev, split, fam, p, m, ref, res, q, st in rows]
    return spark.createDataFrame(made, trust.RECORD)


@pytest.fixture(scope="module")
def tables(spark):
    sources = spark.createDataFrame(SOURCES, trust.SOURCE)
    transforms = spark.createDataFrame([(LINEAGE[0], LINEAGE[1], "tests/code.py", LINEAGE[2], "tests/config.json", LINEAGE[3])], trust.TRANSFORM)
    return records(spark, CANDIDATES), records(spark, HELD), sources, transforms


def rules_of(broken):
    return sorted({(r.rule, r.key) for r in broken.collect()})


def test_the_whole_audit(spark, tables):
    candidates, held, sources, transforms = tables
    assert POLICY.sha256 == "e877fd58abb2a903ae31f6acc88d046b2abc0f703fd0e18a8869abe53a153959"
    require_none(trust.source_violations(sources, ["Apache-2.0", "MIT"]))
    require_none(trust.transform_violations(transforms))
    require_none(trust.set_violations(candidates, sources, transforms, assigned=False, disjoint=False))
    assigned = trust.assign_splits(candidates, POLICY).cache()
    assert trust.assignment_sha256(assigned) == "7c7fb8f678c7b2dbb2ea5e311208f4eabcffcbdb0d3c1135f990b3dda777a93c"
    assert {r.split: r["count"] for r in assigned.groupBy("split").count().collect()} == {"D_anchor": 3, "D_core": 2, "D_dev": 5, "D_select": 4, "D_teacher_gate": 1}
    require_none(trust.contamination_violations(assigned, held))
    found = sorted(map(tuple, trust.contamination(assigned, held).select("train_record_id", "eval_record_id", "kind", "train_field", "eval_field", "match_id", *trust.SCORES).collect()))
    assert found == [
        ("train:000", "eval:000", "exact", "problem", "problem", "f0e74d850eae8be59c2d04895db04eff9d15ff01cc267c0127a063d299018bab", 1000000, 1000000, 1000000, 1000000),
        ("train:002", "eval:001", "fuzzy", "problem", "problem", "c50b4112019ecbef3ccfac2be6389a1eccd484f39be3ad274e73b6b65d262355", 873239, 939394, 684211, 812500),
        ("train:005", "eval:002", "fuzzy", "response", "problem", "93a4bb36091f117bd19bccb3a209b4474d518695dbf4a7c66962d73e9978441c", 641026, 1000000, 666667, 1000000),
    ]
    matches = trust.contamination(assigned, held)
    assert trust.match_counts(matches) == {"exact": 1, "fuzzy": 2, "review": 0}
    require_none(trust.unknown_matches(matches, assigned))
    kept, gone = trust.quarantined(assigned, matches)
    assert sorted(r.sample_id for r in gone.collect()) == [f"train:{k:03}" for k in range(6)]
    final = kept.unionByName(held).cache()
    require_none(trust.set_violations(final, sources, transforms))
    assert trust.contamination(kept, held).count() == 0
    summary = trust.record_summary(final)
    assert summary["record_count"] == 13 and summary["split_counts"] == {"D_anchor": 2, "D_core": 2, "D_dev": 3, "D_select": 1, "D_teacher_gate": 1, "E": 4}
    told = trust.manifest_records(final)
    assert "problem" not in told.columns and set_digest(told, "sample_id", "payload_sha256").first().digest == summary["semantic_sha256"] == "a6370acff1459d707faade76b1f27d5851eea631220fa1024e13e4449a9553f1"


def test_broken_rules_are_named(spark, tables):
    candidates, held, sources, transforms = tables
    row = list(CANDIDATES[6])
    faults = {
        "sample_id": {0: "a/../b"}, "families": {4: ("", "p", "t")}, "message_role": {6: [("user", "x"), ("judge", "y")]}, "user_message": {6: [("system", "x")]}, "text": {5: "é"}, "quality": {9: {"Bad Key": True}},
        "strata": {10: {"k": "a b"}}, "split": {3: "F"}, "source_revision": {2: ""},
    }
    for rule, change in faults.items():
        own = list(row)
        for k, v in change.items():
            own[k] = v
        broken = trust.record_violations(records(spark, [tuple(own)]))
        assert rule in {r for r, _ in rules_of(broken)}, rule
        with pytest.raises(ContractError, match=rule):
            require_none(broken)
    for text in ("", "a\rb", "a\x00b"):
        assert ("text", row[0]) in rules_of(trust.record_violations(records(spark, [(*row[:7], text, *row[8:])])))
    twice = trust.record_violations(records(spark, [CANDIDATES[6], CANDIDATES[6]]))
    assert rules_of(twice) == [("repeated_sample_id", row[0])]
    assert ("unknown_source", row[0]) in rules_of(trust.registry_violations(records(spark, [(row[0], "nobody", *row[2:])]), sources))
    assert ("source_use", row[0]) in rules_of(trust.registry_violations(records(spark, [(*row[:3], "E", *row[4:])]), sources))
    assert ("source_revision_mismatch", row[0]) in rules_of(trust.registry_violations(records(spark, [(*row[:2], "9" * 40, *row[3:])]), sources))
    assert rules_of(trust.transform_registry_violations(candidates.limit(1), transforms.limit(0))) == [("unknown_transform", candidates.first().sample_id)]
    bad = spark.createDataFrame([(*SOURCES[0][:2], "git_commit", "12", "GPL", "http://x", "zz", ["train", "train"])], trust.SOURCE)
    assert {r for r, _ in rules_of(trust.source_violations(bad, ["MIT"]))} == {"revision", "license_url", "license_evidence", "allowed_uses", "license_allow_list"}


def test_lineage_rules(spark, tables):
    candidates, *_ = tables
    first = trust.with_digests(candidates).where("sample_id = 'train:006'").first()
    child = [("child", *CANDIDATES[7][1:])]
    make = lambda parents, split="UNASSIGNED": candidates.unionByName(records(spark, [(*child[0][:3], split, *child[0][4:])], parents))
    none = spark.createDataFrame([], trust.PARENT)
    assert rules_of(trust.lineage_violations(make([("train:006", first.payload_sha256)]), none)) == []
    assert rules_of(trust.lineage_violations(make([("train:006", "0" * 64)]), none)) == [("parent_digest", "child")]
    assert rules_of(trust.lineage_violations(make([("train:006", first.payload_sha256)], "E"), none)) == [("parent_split", "child")]
    assert rules_of(trust.lineage_violations(make([("gone", "0" * 64)]), none)) == [("missing_parent", "child")]
    ledger = spark.createDataFrame([("gone", "UNASSIGNED", "0" * 64), ("train:001", "UNASSIGNED", "0" * 64)], trust.PARENT)
    assert rules_of(trust.lineage_violations(make([("gone", "0" * 64)]), ledger)) == [("ledger_overlap", "train:001")]
    own = rules_of(trust.lineage_violations(make([("child", "0" * 64)]), none))
    assert ("own_parent", "child") in own and ("lineage_cycle", "child") in own


def test_family_leaks_and_fragments(spark, tables):
    candidates, held, *_ = tables
    leaky = candidates.withColumn("split", F.when(F.col("sample_id") == "train:000", "D_core").otherwise("D_dev"))
    assert [(r.dimension, r.splits, r.n) for r in trust.family_leaks(leaky).collect()] == [("source", ["D_core", "D_dev"], 2)]
    rows = trust.fragments(candidates.where("sample_id = 'train:006'"))
    assert {r.field for r in rows.collect()} >= {"problem", "reference_answer", "response", "aggregate.full_record"}
    assert trust.fragments(held.limit(0)).count() == 0


def plain_fragments(r):
    """{digest: (field, group, norm)} of a record, one text after another."""
    import hashlib

    from veraline.functions.text import normal_form

    fields = [("problem", r.problem), *((f"messages.{i}.{m.role}", m.content) for i, m in enumerate(r.messages or [])), ("reference_answer", r.reference_answer), ("response", r.response)]
    group = lambda f: "problem" if f == "problem" else "solution" if f in ("reference_answer", "response") or f.endswith(".assistant") else "prompt" if f.endswith(".user") else "context"
    own = [(f, group(f), normal_form(t)) for f, t in fields if t is not None and normal_form(t)]
    chosen = {
        "aggregate.prompt": ("prompt", [n for f, _, n in own if f == "problem" or f.startswith("messages.")]),
        "aggregate.solution_trace": ("solution", [n for f, _, n in own if f in ("reference_answer", "response") or f.endswith((".assistant", ".tool"))]),
        "aggregate.full_record": ("context", [n for *_, n in own]),
    }
    own += [(name, g, " ".join(parts)) for name, (g, parts) in chosen.items() if len(parts) >= 2]
    best = {}
    for f, g, n in sorted(own, key=lambda x: (trust.GROUP_ORDER.index(x[1]), x[0])):
        best.setdefault(hashlib.sha256(n.encode()).hexdigest(), (f, g, n))
    return best


def test_fragments_are_made_inside_the_record(spark, tables):
    candidates, held, *_ = tables
    texts = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")) for role, text in (("user", "Same words"), ("assistant", "same  WORDS"), ("tool", ""), ("system", "x"), ("user", "x"))))
    odd = candidates.limit(3).withColumns({"sample_id": F.concat(F.lit("odd:"), "sample_id"), "messages": texts.cast(candidates.schema["messages"].dataType), "problem": F.lit("SAME words"), "response": F.lit(None).cast("string")})
    every = candidates.unionByName(held).unionByName(odd)
    made = trust.fragments(every)
    got = {}
    for r in made.collect():
        assert r.norm_sha not in got.setdefault(r.sample_id, {})
        got[r.sample_id][r.norm_sha] = (r.field, r.field_group, r.norm)
    assert got == {r.sample_id: plain_fragments(r) for r in every.collect() if plain_fragments(r)}
    alone = trust.fragments(candidates)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
