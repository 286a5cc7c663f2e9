"""Training records and their trust: contracts, registries, lineage, families, splits, contamination, manifest.

Records are rows of RECORD.  Every check returns violations (rule, key); require_none()
turns them into an error.  Digests are over canonical JSON, so they agree with those of
any writer of that form, and no result carries text.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.functions import predicates as P
from veraline.functions import versions
from veraline.functions.canonical import json_string, object_sha256, ordered_sha256, set_digest, sha256_json
from veraline.functions.text import digest_mod, let, normalize_all
from veraline.operators.checks import named, repeated, require_none, union, violations
from veraline.operators.contamination import KIND_ORDER, fingerprints, scan
from veraline.operators.graph import connected_components
from veraline.plans.store import materialize

# The record's schema and versions, its domains and limits.
RECORD_VERSION = versions.DATA_RECORD


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT = T.StringType()
RECORD = _struct(
    schema_version=_TEXT, sample_id=_TEXT, source_id=_TEXT, source_revision=_TEXT, split=_TEXT, families=_struct(source=_TEXT, problem=_TEXT, template=_TEXT), problem=_TEXT,
    messages=T.ArrayType(_struct(role=_TEXT, content=_TEXT)), reference_answer=_TEXT, response=_TEXT, quality=T.MapType(_TEXT, T.BooleanType()), strata=T.MapType(_TEXT, _TEXT),
    lineage=_struct(transform_name=_TEXT, transform_version=_TEXT, code_sha256=_TEXT, config_sha256=_TEXT, parents=T.ArrayType(_struct(sample_id=_TEXT, payload_sha256=_TEXT))),
)
SOURCE = "source_id string, uri string, revision_kind string, revision string, license_expression string, license_url string, license_evidence_sha256 string, allowed_uses array<string>"
TRANSFORM = "transform_name string, transform_version string, code_path string, code_sha256 string, config_path string, config_sha256 string"
PARENT = "sample_id string, split string, payload_sha256 string"
UNASSIGNED, EVALUATION = "UNASSIGNED", "E"
TRAINING = ("D_anchor", "D_core", "D_dev", "D_select", "D_teacher_gate")
ROLES = ("system", "user", "assistant", "tool")
USES = ("evaluate", "redistribute", "train")
DIMENSIONS = ("source", "problem", "template")
MOST_MESSAGES, MOST_PARENTS, MOST_METADATA = 1024, 1024, 128
GROUP_ORDER = ("problem", "prompt", "solution", "context")
TRANSFORM_KEY = ("transform_name", "transform_version", "code_sha256", "config_sha256")


def canonical_sha256(value: object) -> str:
    """The digest of one plain object's canonical JSON, for documents of a driver's size."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# --- contracts ---


def record_violations(records: DataFrame) -> DataFrame:
    """Rules on single records, and repeated sample_ids."""
    texts = F.concat(F.array("problem"), F.coalesce(F.transform("messages", lambda m: m["content"]), F.array().cast("array<string>")), F.filter(F.array("reference_answer", "response"), lambda x: x.isNotNull()))
    line, parents = F.col("lineage"), F.col("lineage.parents")
    root = line["transform_name"] == "ingest"
    rules = {
        "schema_version": F.col("schema_version") == RECORD_VERSION,
        "sample_id": P.is_identifier(F.col("sample_id")),
        "source_id": P.is_identifier(F.col("source_id")),
        "source_revision": F.length("source_revision") > 0,
        "split": F.col("split").isin(UNASSIGNED, EVALUATION, *TRAINING),
        "families": P.is_identifier(F.col("families.source")) & P.is_identifier(F.col("families.problem")) & P.is_identifier(F.col("families.template")),
        "message_count": P.is_whole(F.size("messages"), 1, MOST_MESSAGES),
        "message_role": F.forall("messages", lambda m: P.sure(m["role"].isin(*ROLES))),
        "user_message": P.has_user_message(F.col("messages")),
        "text": P.are_texts(texts),
        "quality": F.col("quality").isNotNull() & (F.size("quality") <= MOST_METADATA) & F.forall(F.map_keys("quality"), P.is_metadata_key),
        "strata": F.col("strata").isNotNull() & (F.size("strata") <= MOST_METADATA) & F.forall(F.map_entries("strata"), lambda e: P.is_metadata_key(e["key"]) & P.is_identifier(e["value"])),
        "lineage": P.is_identifier(line["transform_name"]) & P.is_version(line["transform_version"]) & P.is_sha256(line["code_sha256"]) & P.is_sha256(line["config_sha256"]),
        "lineage_parents": (F.size(parents) <= MOST_PARENTS) & (F.size(F.array_distinct(parents["sample_id"])) == F.size(parents)) & F.forall(parents, lambda p: P.is_identifier(p["sample_id"]) & P.is_sha256(p["payload_sha256"])),
        "lineage_root": P.sure(root == (F.size(parents) == 0)),
    }
    return union(violations(records, "sample_id", rules), repeated(records, "repeated_sample_id", "sample_id"))


def source_violations(sources: DataFrame, licenses: list[str]) -> DataFrame:
    """Rules on a source registry; licenses: the allow-list."""
    uses = F.col("allowed_uses")
    rules = {
        "source_id": P.is_identifier(F.col("source_id")),
        "uri": P.is_public_uri(F.col("uri")),
        "revision": P.is_revision(F.col("revision_kind"), F.col("revision")),
        "license": P.is_license(F.col("license_expression")),
        "license_url": P.is_public_uri(F.col("license_url"), ("https",)),
        "license_evidence": P.is_sha256(F.col("license_evidence_sha256")),
        "allowed_uses": (F.size(uses) > 0) & P.is_sorted_set(F.array_sort(uses)) & F.forall(uses, lambda u: P.sure(u.isin(*USES))),
        "license_allow_list": F.col("license_expression").isin(*licenses),
    }
    return union(violations(sources, "source_id", rules), repeated(sources, "repeated_source_id", "source_id"))


def transform_violations(transforms: DataFrame) -> DataFrame:
    rules = {
        "transform_name": P.is_identifier(F.col("transform_name")),
        "transform_version": P.is_version(F.col("transform_version")),
        "code_path": P.is_relative_path(F.col("code_path")),
        "config_path": P.is_relative_path(F.col("config_path")),
        "code_sha256": P.is_sha256(F.col("code_sha256")),
        "config_sha256": P.is_sha256(F.col("config_sha256")),
    }
    return union(violations(transforms, "transform_name", rules), repeated(transforms, "repeated_transform", *TRANSFORM_KEY))


def parent_violations(ledger: DataFrame) -> DataFrame:
    rules = {"sample_id": P.is_identifier(F.col("sample_id")), "split": F.col("split").isin(UNASSIGNED, EVALUATION, *TRAINING), "payload_sha256": P.is_sha256(F.col("payload_sha256"))}
    return union(violations(ledger, "sample_id", rules), repeated(ledger, "repeated_sample_id", "sample_id"))


# --- identity ---


def with_digests(records: DataFrame) -> DataFrame:
    """records with payload_sha256, content_sha256, lineage_sha256 and family_sha256 (a struct)."""
    lined = records.withColumn("lineage", F.col("lineage").withField("parents", F.array_sort("lineage.parents")))
    whole = sha256_json(F.struct(*RECORD.fieldNames()), RECORD)
    families = F.struct(*(F.sha2(F.col(f"families.{d}"), 256).alias(d) for d in DIMENSIONS))
    return lined.withColumns({
        "payload_sha256": whole, "content_sha256": object_sha256(lined, problem="problem", messages="messages", reference_answer="reference_answer", response="response", quality="quality"),
        "lineage_sha256": sha256_json(F.col("lineage"), RECORD["lineage"].dataType), "family_sha256": families,
    })


def manifest_records(records: DataFrame) -> DataFrame:
    """What a manifest says of each record: hashes, split and source, no text."""
    return with_digests(records).select("sample_id", "split", "source_id", "source_revision", "payload_sha256", "content_sha256", "lineage_sha256", "family_sha256")


def record_summary(records: DataFrame) -> dict[str, object]:
    """record_count, split_counts, source_counts, semantic_sha256; counts by a domain meet on the driver, records don't."""
    digest = set_digest(with_digests(records).select("sample_id", "payload_sha256"), "sample_id", "payload_sha256").first()
    counts = lambda c: {r[0]: r[1] for r in records.groupBy(c).count().orderBy(c).collect()}
    return {"record_count": digest["n"], "split_counts": counts("split"), "source_counts": counts("source_id"), "semantic_sha256": digest["digest"]}


# --- joins with registries and lineage ---


def registry_violations(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records whose source isn't registered, doesn't allow their use, or has another revision."""
    joined = records.select("sample_id", "source_id", "source_revision", "split").join(sources.select("source_id", "revision", "allowed_uses", F.lit(True).alias("known")), "source_id", "left")
    use = F.when(F.col("split") == EVALUATION, "evaluate").otherwise("train")
    rules = {
        "unknown_source": F.col("known"),
        "source_use": F.col("known").isNull() | (F.col("split") == UNASSIGNED) | F.array_contains("allowed_uses", use),
        "source_revision_mismatch": F.col("known").isNull() | (F.col("source_revision") == F.col("revision")),
    }
    return violations(joined, "sample_id", rules)


def transform_registry_violations(records: DataFrame, transforms: DataFrame) -> DataFrame:
    keyed = records.select("sample_id", *(F.col(f"lineage.{k}").alias(k) for k in TRANSFORM_KEY))
    return named(keyed.join(transforms.select(*TRANSFORM_KEY), list(TRANSFORM_KEY), "left_anti"), "unknown_transform", "sample_id")


def lineage_violations(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Parents that are missing, have another digest or split, or close a cycle; ids that the ledger repeats."""
    from veraline.plans.trust import peel_cycles

    own = with_digests(records).select("sample_id", "split", "payload_sha256")
    links = records.select("sample_id", "split", F.explode("lineage.parents").alias("p")).select("sample_id", "split", F.col("p.sample_id").alias("parent"), F.col("p.payload_sha256").alias("said"))
    inside = own.select(F.col("sample_id").alias("parent"), F.col("split").alias("s1"), F.col("payload_sha256").alias("d1"))
    outside = ledger.select(F.col("sample_id").alias("parent"), F.col("split").alias("s2"), F.col("payload_sha256").alias("d2"))
    known = links.join(inside, "parent", "left").join(outside, "parent", "left").withColumns({"d": F.coalesce("d1", "d2"), "s": F.coalesce("s1", "s2")})
    rules = {"missing_parent": F.col("d").isNotNull(), "parent_digest": F.col("d").isNull() | (F.col("d") == F.col("said")), "parent_split": F.col("s").isNull() | (F.col("s") == F.col("split")), "own_parent": F.col("parent") != F.col("sample_id")}
    looped = peel_cycles(links.join(own.select(F.col("sample_id").alias("parent")), "parent", "left_semi").select(F.col("sample_id").alias("child"), "parent"))
    overlap = ledger.join(records.select("sample_id"), "sample_id", "left_semi")
    return union(violations(known, "sample_id", rules), named(looped.distinct(), "lineage_cycle", "child"), named(overlap, "ledger_overlap", "sample_id"))


def family_leaks(records: DataFrame) -> DataFrame:
    """(dimension, family_sha256, splits, n) of families whose records lie in several splits."""
    rows = records.select("split", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"families.{d}").alias("family")) for d in DIMENSIONS))).alias("f"))
    by = rows.groupBy("f.dimension", "f.family").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count("*").alias("n"))
    return by.where(F.size("splits") > 1).select("dimension", F.sha2("family", 256).alias("family_sha256"), "splits", "n")


def set_violations(records: DataFrame, sources: DataFrame, transforms: DataFrame, ledger: DataFrame | None = None, assigned: bool = True, disjoint: bool = True) -> DataFrame:
    """All rules on a record set together."""
    spark = records.sparkSession
    ledger = spark.createDataFrame([], PARENT) if ledger is None else ledger
    parts = [
        record_violations(records), registry_violations(records, sources), transform_registry_violations(records, transforms), lineage_violations(records, ledger),
        repeated(with_digests(records), "repeated_content", "content_sha256"),
    ]
    if assigned:
        parts.append(named(records.where(F.col("split") == UNASSIGNED), "unassigned", "sample_id"))
    if disjoint:
        parts.append(family_leaks(records).select(F.lit("family_leak").alias("rule"), F.concat_ws("|", "dimension", "family_sha256").alias("key")))
    return union(*parts)


# --- families and splits ---


@dataclass(frozen=True)
class SplitPolicy:
    """Weights of the splits, in the order of their names, under a namespace."""

    namespace: str
    weights: dict[str, int]

    def to_record(self) -> dict[str, object]:
        return {"schema_version": versions.FAMILY_SPLIT_POLICY, "namespace": self.namespace, "family_dimensions": list(DIMENSIONS), "allocations": [{"split": s, "weight": w} for s, w in sorted(self.weights.items())]}

    @property
    def sha256(self) -> str:
        return canonical_sha256(self.to_record())


def components(records: DataFrame) -> DataFrame:
    """(sample_id, component): records that share a family in any dimension, transitively; the component is its smallest id.

    Each record is linked to the smallest record of its family, so a family of any size gives one edge per record.
    """
    edges = None
    for d in DIMENSIONS:
        rows = records.select("sample_id", F.col(f"families.{d}").alias("f"))
        least = materialize(rows.groupBy("f").agg(F.min("sample_id").alias("dst")), "family-least")
        own = rows.join(least, "f").select(F.col("sample_id").alias("src"), "dst")
        edges = own if edges is None else edges.union(own)
    return connected_components(edges).withColumnRenamed("node", "sample_id")


def assignment_violations(records: DataFrame) -> DataFrame:
    """What can't be assigned: no records, records with a split, children (they are split as their parents), repeated ids."""
    none = records.limit(1).agg(F.count("*").alias("n")).where("n = 0").withColumn("key", F.lit("records"))
    return union(named(none, "no_records", "key"), named(records.where(F.col("split") != UNASSIGNED), "assigned_already", "sample_id"), named(records.where(F.size("lineage.parents") > 0), "not_a_root", "sample_id"), repeated(records, "repeated_sample_id", "sample_id"))


def assign_splits(records: DataFrame, policy: SplitPolicy) -> DataFrame:
    """records with the split of their component: the digest of its members and families, modulo the total weight.

    Records that assignment_violations() names raise.  A component's digest is of one text of its members, so a component is gathered; the
    families are the caller's, and their sizes the same for any order of rows.
    """
    require_none(assignment_violations(records))
    c = materialize(components(records), "components")
    member = F.struct("sample_id", "families")
    kind = T.ArrayType(T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("families", RECORD["families"].dataType)]))
    from veraline.functions.canonical import canonical_json

    pairs = F.transform(F.array_sort(F.collect_list(member)), lambda m: F.concat(F.lit("["), canonical_json(m["sample_id"], T.StringType()), F.lit(","), canonical_json(m["families"], kind.elementType["families"].dataType), F.lit("]")))
    payload = F.concat(F.lit(policy.namespace + "\x00"), F.lit("["), F.array_join(pairs, ","), F.lit("]"))
    drawn = c.join(records.select("sample_id", "families"), "sample_id").groupBy("component").agg(F.sha2(payload, 256).alias("d"))
    bounds, total, chosen = [], 0, None
    for split, weight in sorted(policy.weights.items()):
        total += weight
        bounds.append((total, split))
    bucket = digest_mod(F.col("d"), total)
    for top, split in bounds:
        chosen = F.when(F.col("b") < top, split) if chosen is None else chosen.when(F.col("b") < top, split)
    told = materialize(drawn.select("component", bucket.alias("b")).select("component", chosen.alias("new_split")), "splits")
    return records.join(c.join(told, "component").select("sample_id", "new_split"), "sample_id").withColumn("split", F.col("new_split")).select(*records.columns)


def assignment_sha256(assigned: DataFrame) -> str:
    """The digest of the object of all sample_ids and their splits, in the order of the ids."""
    return ordered_sha256(assigned, ["sample_id"], F.concat(json_string(F.col("sample_id")), F.lit(":"), json_string(F.col("split"))), "{", "}")[0]


# --- contamination ---


def field_group(field: Column) -> Column:
    return F.when(field == "problem", "problem").when(field.isin("reference_answer", "response") | field.endswith(".assistant"), "solution").when(field.endswith(".user"), "prompt").otherwise("context")


def _fields() -> Column:
    """A record's texts in its order, as structs of field and text."""
    said = F.transform("messages", lambda m, i: F.struct(F.concat(F.lit("messages."), i.cast("string"), F.lit("."), m["role"]).alias("field"), m["content"].alias("text")))
    one = lambda name: F.array(F.struct(F.lit(name).alias("field"), F.col(name).alias("text")))
    return F.filter(F.concat(one("problem"), said, one("reference_answer"), one("response")), lambda f: f["text"].isNotNull())


def fields_of(records: DataFrame) -> DataFrame:
    """One row per text of a record: its place in it, the field's name and group, the text."""
    rows = records.select("sample_id", "split", "source_id", F.posexplode(_fields()).alias("place", "f")).select("sample_id", "split", "source_id", "place", "f.field", "f.text")
    return rows.withColumn("field_group", field_group(F.col("field")))


def fragments(records: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(fragment_id, sample_id, source_id, field, field_group, norm): each record's fields and their aggregates in normal form.

    exempt: digests of normal forms that are left out where they're context.  Of equal
    normal forms of a record the one of the first group, then field, stays.  Aggregates
    join two fields or more in the record's order: prompts, solutions, all.  All of it
    happens inside the record, so nothing is exchanged.
    """
    rows = records.select("sample_id", "split", "source_id", _fields().alias("f")).withColumn("norms", normalize_all(F.col("f.text")))
    rank = lambda group: F.array_position(F.array(*map(F.lit, GROUP_ORDER)), group)
    made = lambda field, group, norm: F.struct(F.sha2(norm, 256).alias("norm_sha"), rank(group).alias("rank"), field.alias("field"), group.alias("field_group"), norm.alias("norm"))
    told = F.filter(F.transform(F.arrays_zip("f", "norms"), lambda x: made(x["f"]["field"], field_group(x["f"]["field"]), x["norms"])), lambda x: x["norm"] != "")
    if exempt:
        told = F.filter(told, lambda x: ~((x["field_group"] == "context") & x["norm_sha"].isin(*exempt)))
    is_message = lambda x: x["field"].startswith("messages.")
    kinds = {
        "aggregate.prompt": ("prompt", lambda x: (x["field"] == "problem") | is_message(x)),
        "aggregate.solution_trace": ("solution", lambda x: x["field"].isin("reference_answer", "response") | x["field"].endswith(".assistant") | x["field"].endswith(".tool")),
        "aggregate.full_record": ("context", lambda x: F.lit(True)),
    }
    rows = rows.withColumn("own", told)

    def joined(name: str, group: str, chosen) -> Column:
        return let(F.filter("own", chosen), lambda parts: F.when(F.size(parts) >= 2, made(F.lit(name), F.lit(group), F.array_join(F.transform(parts, lambda x: x["norm"]), " "))))

    every = F.array_sort(F.filter(F.concat("own", F.array(*(joined(name, *kind) for name, kind in kinds.items()))), lambda x: x.isNotNull()))  # equal normal forms beside each other, the best first
    best = let(every, lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["norm_sha"] != x["norm_sha"])))
    out = rows.select("sample_id", "split", "source_id", F.explode(best).alias("x")).select("sample_id", "split", "source_id", "x.norm_sha", "x.field", "x.field_group", "x.norm")
    return out.withColumn("fragment_id", object_sha256(out, record_id="sample_id", split="split", source_id="source_id", field="field", normalized_sha256="norm_sha"))


SCORES = ("character_jaccard_ppm", "character_containment_ppm", "token_jaccard_ppm", "token_containment_ppm")


def contamination(train: DataFrame, held: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """The best match of each pair of records: match_id, kind, both records', sources', fields' and normal forms' ids, four scores.

    By kind, whole fields before aggregates, then score, fields and id.
    """
    a, b = materialize(fragments(train, exempt), "train-fragments"), materialize(fragments(held, exempt), "held-fragments")
    same = lambda c: c  # noqa: E731  the fragments are in normal form
    found = scan(fingerprints(a, "fragment_id", "norm", same).withColumnRenamed("fragment_id", "ta"), fingerprints(b, "fragment_id", "norm", same).withColumnRenamed("fragment_id", "eb"), "ta", "eb")
    side = lambda df, key, tag: df.select(F.col("fragment_id").alias(key), F.col("sample_id").alias(f"{tag}_record_id"), F.col("source_id").alias(f"{tag}_source_id"), F.col("field").alias(f"{tag}_field"), F.col("norm_sha").alias(f"{tag}_normalized_sha256"))
    told = found.join(side(a, "ta", "train"), "ta").join(side(b, "eb", "eval"), "eb")
    told = told.withColumn("match_id", object_sha256(told, train_fragment_id="ta", eval_fragment_id="eb"))
    aggregate = (F.col("train_field").startswith("aggregate.") | F.col("eval_field").startswith("aggregate.")).cast("int")
    order = F.struct(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")), aggregate, -F.greatest(*SCORES), F.col("train_field"), F.col("eval_field"), F.col("match_id"))
    names = ("match_id", "kind", "train_source_id", "train_field", "train_normalized_sha256", "eval_source_id", "eval_field", "eval_normalized_sha256", *SCORES)
    best = told.groupBy("train_record_id", "eval_record_id").agg(F.min_by(F.struct(*names), order).alias("m"))
    return best.select("train_record_id", "eval_record_id", "m.*")


def contamination_violations(train: DataFrame, held: DataFrame) -> DataFrame:
    """What a scan may not be given: other splits, repeated ids, ids of both sides."""
    return union(
        named(train.where(~F.col("split").isin(*TRAINING)), "not_training", "sample_id"), named(held.where(F.col("split") != EVALUATION), "not_evaluation", "sample_id"),
        repeated(train, "repeated_training_id", "sample_id"), repeated(held, "repeated_evaluation_id", "sample_id"), named(train.select("sample_id").join(held.select("sample_id"), "sample_id", "left_semi"), "id_of_both_sides", "sample_id"),
    )


def match_counts(matches: DataFrame) -> dict[str, int]:
    """Matches by kind, kinds without any included."""
    return dict.fromkeys(KIND_ORDER, 0) | {r["kind"]: r["count"] for r in matches.groupBy("kind").count().collect()}


def unknown_matches(matches: DataFrame, train: DataFrame) -> DataFrame:
    return named(matches.join(train.select(F.col("sample_id").alias("train_record_id")), "train_record_id", "left_anti"), "unknown_training_record", "train_record_id")


def quarantined(train: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): with a matched record go all that its families connect it to."""
    c = materialize(components(train), "components")
    hit = c.join(matches.select(F.col("train_record_id").alias("sample_id")).distinct(), "sample_id", "left_semi").select("component").distinct()
    ids = materialize(c.join(hit, "component", "left_semi").select("sample_id"), "quarantined")
    return train.join(ids, "sample_id", "left_anti"), train.join(ids, "sample_id", "left_semi")
