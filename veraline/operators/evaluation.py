"""Sealed evaluation: request grid, responses, generation records, scores, report.

Public items never meet references before scoring, and what comes out holds no text of
either.  Every row's identity is a digest over canonical JSON, so a grid or a record can be
derived again anywhere and compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veraline.functions import predicates as P
from veraline.functions import versions
from veraline.functions.canonical import json_string, list_digest, object_sha256
from veraline.functions.text import composed, seed63
from veraline.operators.checks import ContractError, named, repeated, require_none, union, violations
from veraline.operators.trust import canonical_sha256
from veraline.sources.committed import DATA, MANIFEST, publish
from veraline.sources.documents import read_document

ITEM = "benchmark_id string, benchmark_revision string, item_id string, item_index long, prompt string, strata map<string,string>"
REFERENCE = "benchmark_id string, benchmark_revision string, item_id string, reference string"
RESPONSE = "request_id string, status string, generated_text string, output_token_ids array<int>, finish_reason string, error_code string"
RECORD = (
    "request_id string, benchmark_id string, benchmark_revision string, item_id string, item_index long, sample_index long, checkpoint_sha256 string, protocol_sha256 string, prompt_sha256 string, seed long, "
    "status string, generated_text string, output_token_ids array<int>, finish_reason string, error_code string, record_sha256 string"
)
FINISHES = ("eos", "length", "stop_sequence", "stop_token")
SCALE, MOST_TOKENS, MOST_SAMPLES = 1_000_000, 65_536, 1_024


@dataclass(frozen=True)
class Protocol:
    """How answers are generated."""

    mode: str
    samples_per_item: int
    max_new_tokens: int
    system_prompt: str
    chat_template_sha256: str
    eos_token_id: int
    stop_token_ids: tuple[int, ...]
    stop_sequences: tuple[str, ...]
    temperature_ppm: int | None = None
    top_p_ppm: int | None = None
    top_k: int | None = None
    seed_namespace: str | None = None
    base_seed: int | None = None
    schema_version: str = versions.GENERATION_PROTOCOL

    def __post_init__(self):
        whole = lambda x, low, high: type(x) is int and low <= x <= high
        drawn = (self.temperature_ppm, self.top_p_ppm, self.top_k, self.seed_namespace, self.base_seed)
        fine = {
            "mode": self.mode in ("greedy", "sampling"), "samples_per_item": whole(self.samples_per_item, 1, MOST_SAMPLES), "max_new_tokens": whole(self.max_new_tokens, 1, MOST_TOKENS),
            "stop_token_ids": tuple(sorted(set(self.stop_token_ids))) == self.stop_token_ids and self.eos_token_id in self.stop_token_ids, "stop_sequences": tuple(sorted(set(self.stop_sequences))) == self.stop_sequences,
            "greedy": self.mode != "greedy" or self.samples_per_item == 1 and drawn == (None,) * 5, "sampling": self.mode != "sampling" or None not in drawn,
        }
        broken = [k for k, ok in fine.items() if not ok]
        if broken:
            raise ContractError(f"protocol: {', '.join(broken)}")

    @property
    def sha256(self) -> str:
        return canonical_sha256(asdict(self) | {"stop_token_ids": list(self.stop_token_ids), "stop_sequences": list(self.stop_sequences)})


def read_protocol(spark: SparkSession, path: str) -> Protocol:
    whole = read_document(spark, path, set(Protocol.__dataclass_fields__), versions.GENERATION_PROTOCOL)
    return Protocol(**{k: tuple(v) if isinstance(v, list) else v for k, v in whole.items()})


# --- items and references ---


def item_violations(items: DataFrame) -> DataFrame:
    """Rules on public items; indexes run from 0 on without gaps, ids are single, and all are of one benchmark."""
    rules = {"benchmark_id": P.is_identifier(F.col("benchmark_id")), "item_id": P.is_identifier(F.col("item_id")), "prompt": P.is_text(F.col("prompt")), "strata": F.forall(F.map_entries("strata"), lambda e: P.is_metadata_key(e["key"]) & P.is_identifier(e["value"]))}
    spread = items.agg(F.min("item_index").alias("a"), F.max("item_index").alias("z"), F.count("*").alias("n"), F.countDistinct("item_index").alias("d"), F.countDistinct("benchmark_id", "benchmark_revision").alias("b"))
    whole = spread.select(F.explode(F.array(F.when((F.col("n") == 0) | (F.col("a") != 0) | (F.col("z") != F.col("n") - 1) | (F.col("d") != F.col("n")), F.lit("consecutive_indexes")), F.when(F.col("b") > 1, F.lit("one_benchmark")))).alias("rule"), F.lit("items").alias("key")).where("rule is not null")
    return union(violations(items, "item_id", rules), repeated(items, "repeated_item_id", "item_id"), whole)


def sealed_violations(items: DataFrame, references: DataFrame) -> DataFrame:
    """Ids that only one side has, and repeated or blank references."""
    left, right = items.select("item_id"), references.select("item_id")
    return union(
        named(left.join(right, "item_id", "left_anti"), "no_reference", "item_id"), named(right.join(left, "item_id", "left_anti"), "no_item", "item_id"), repeated(references, "repeated_reference", "item_id"),
        violations(references, "item_id", {"reference": P.is_text(F.col("reference"))}),
    )


def item_set_sha256(items: DataFrame) -> str:
    rows = items.select("item_index", F.sha2("prompt", 256).alias("p"), "item_id")
    text = F.concat(F.lit('{"item_id":'), json_string(F.col("item_id")), F.lit(',"item_index":'), F.col("item_index").cast("string"), F.lit(',"prompt_sha256":"'), F.col("p"), F.lit('"}'))
    return list_digest(rows, ["item_index"], text).first()["digest"]


# --- requests, responses, records ---


def requests(items: DataFrame, protocol: Protocol, checkpoint_sha256: str) -> DataFrame:
    """The grid of items and samples, each with its seed (null if greedy) and request_id."""
    grid = items.withColumn("sample_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(protocol.samples_per_item - 1).cast("long")))).withColumns({"checkpoint_sha256": F.lit(checkpoint_sha256), "protocol_sha256": F.lit(protocol.sha256), "prompt_sha256": F.sha2("prompt", 256)})
    seed: Column = F.lit(None).cast("long")
    if protocol.mode == "sampling":
        seed = seed63(object_sha256(grid, schema_version=F.lit(versions.PAIRED_GENERATION_SEED), protocol_sha256="protocol_sha256", benchmark_id="benchmark_id", benchmark_revision="benchmark_revision", item_id="item_id", sample_index="sample_index"))
    grid = grid.withColumn("seed", seed)
    names = ("benchmark_id", "benchmark_revision", "item_id", "item_index", "sample_index", "prompt_sha256", "checkpoint_sha256", "protocol_sha256", "seed")
    return grid.withColumn("request_id", object_sha256(grid, schema_version=F.lit(versions.GENERATION_REQUEST_ID), **{n: n for n in names}))


def response_violations(grid: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a response, responses without a request, several to one; faults of single responses."""
    done, ids = F.col("status") == "completed", F.col("output_token_ids")
    rules = {
        "status": F.col("status").isin("completed", "failed"),
        "completed": ~done | (F.col("generated_text").isNotNull() & F.col("finish_reason").isin(*FINISHES) & F.col("error_code").isNull() & (F.size(ids) > 0) & F.forall(ids, lambda x: P.is_whole(x, 0, 2**31 - 1))),
        "failed": done | (F.col("generated_text").isNull() & (F.coalesce(F.size(ids), F.lit(0)) <= 0) & F.col("finish_reason").isNull() & P.sure(F.col("error_code").rlike("^[a-z][a-z0-9_.-]{0,127}\\z"))),
    }
    return union(
        named(grid.join(responses.select("request_id"), "request_id", "left_anti"), "missing_response", "request_id"), named(responses.join(grid.select("request_id"), "request_id", "left_anti"), "extra_response", "request_id"),
        repeated(responses, "repeated_response", "request_id"), violations(responses, "request_id", rules),
    )


_UNSIGNED = [x.split()[0] for x in RECORD.split(", ")][:-1]


def _record_sha256(df: DataFrame) -> Column:
    return object_sha256(df, schema_version=F.lit(versions.GENERATION_RECORD), **{n: n for n in _UNSIGNED})


def generation_records(grid: DataFrame, responses: DataFrame) -> DataFrame:
    """RECORD of each request and its response, whatever order these came in."""
    joined = grid.join(responses, "request_id").withColumn("output_token_ids", F.coalesce("output_token_ids", F.array().cast("array<int>"))).select(*_UNSIGNED)
    return joined.withColumn("record_sha256", _record_sha256(joined))


def record_violations(records: DataFrame, items: DataFrame, protocol: Protocol, checkpoint_sha256: str) -> DataFrame:
    """Records that the grid, their own digest or the protocol's rules on endings contradict."""
    grid = requests(items, protocol, checkpoint_sha256).select("request_id", F.struct("item_id", "item_index", "sample_index", "prompt_sha256", "checkpoint_sha256", "protocol_sha256", "seed").alias("want"))
    own = F.struct("item_id", "item_index", "sample_index", "prompt_sha256", "checkpoint_sha256", "protocol_sha256", "seed")
    ids, why = F.col("output_token_ids"), F.col("finish_reason")
    ends = F.lit(False)
    for s in protocol.stop_sequences:
        ends = ends | F.col("generated_text").endswith(s)
    told = records.join(grid, "request_id", "left")
    ok = {
        "request": F.col("want").isNotNull() & own.eqNullSafe(F.col("want")),
        "record_sha256": F.col("record_sha256") == _record_sha256(told),
        "token_count": F.size(ids) <= protocol.max_new_tokens,
        "length_finish": P.sure(why != "length") | why.isNull() | (F.size(ids) == protocol.max_new_tokens),
        "eos_finish": P.sure(why != "eos") | why.isNull() | P.sure(F.element_at(ids, -1) == protocol.eos_token_id),
        "stop_token_finish": P.sure(why != "stop_token") | why.isNull() | P.sure(F.element_at(ids, -1).isin(*protocol.stop_token_ids)),
        "stop_sequence_finish": P.sure(why != "stop_sequence") | why.isNull() | P.sure(ends),
    }
    missing = named(grid.join(records.select("request_id"), "request_id", "left_anti"), "missing_record", "request_id")
    return union(violations(told, "request_id", ok), repeated(records, "repeated_record", "request_id"), missing)


def record_set_sha256(records: DataFrame) -> str:
    """The digest of all records' ids and digests in the order of the grid."""
    text = F.concat(F.lit('{"record_sha256":"'), F.col("record_sha256"), F.lit('","request_id":"'), F.col("request_id"), F.lit('"}'))
    return list_digest(records, ["item_index", "sample_index"], text).first()["digest"]


MANIFEST_FIELDS = ("schema_version", "run_id", "benchmark_id", "benchmark_revision", "protocol_sha256", "checkpoint_sha256", "record_count", "failed_count", "record_set_sha256")


def write_bundle(records: DataFrame, folder: str, run_id: str, protocol: Protocol, checkpoint_sha256: str) -> str:
    """Publish records as JSON lines with the manifest that says what they are, both or neither; returns the set's digest."""

    def manifest(written: DataFrame) -> dict:
        told = written.agg(F.count("*").alias("record_count"), F.count_if(F.col("status") == "failed").alias("failed_count"), F.min("benchmark_id").alias("benchmark_id"), F.min("benchmark_revision").alias("benchmark_revision")).first().asDict()
        return {"schema_version": versions.GENERATION_MANIFEST, "run_id": run_id, "protocol_sha256": protocol.sha256, "checkpoint_sha256": checkpoint_sha256, "record_set_sha256": record_set_sha256(written), **told}

    return publish(records, folder, manifest)["record_set_sha256"]


def read_bundle(spark: SparkSession, folder: str, items: DataFrame, protocol: Protocol) -> DataFrame:
    """The records of a bundle, if they are what the manifest and the derived grid say."""
    told = read_document(spark, f"{folder}/{MANIFEST}", set(MANIFEST_FIELDS), versions.GENERATION_MANIFEST)
    records = spark.read.schema(RECORD).json(f"{folder}/{DATA}")
    if told["protocol_sha256"] != protocol.sha256:
        raise ContractError("the manifest is of another protocol")
    require_none(record_violations(records, items, protocol, told["checkpoint_sha256"]))
    counts = records.agg(F.count("*"), F.count_if(F.col("status") == "failed")).first()
    if (counts[0], counts[1], record_set_sha256(records)) != (told["record_count"], told["failed_count"], told["record_set_sha256"]):
        raise ContractError("the records aren't those of the manifest")
    return records


# --- scores ---

SCORE = (
    "request_id", "item_id", "item_index", "sample_index", "generation_record_sha256", "correct", "verification_status", "extraction_status", "parse_status", "answer_source", "marker_count", "completion_token_count", "finish_reason",
)
# Fixed value: what a label may be.
STRICT_LABEL = r"^[A-Za-z0-9][A-Za-z0-9._+-]{0,63}\z"


def strict_label(reference: Column, prediction: Column) -> Column:
    """A label's verdict as a struct: blanks cut off, composed, then exact equality."""
    said = composed(F.trim(prediction))
    found = P.sure(said.rlike(STRICT_LABEL))
    same = found & (said == reference)
    return F.struct(
        F.when(same, "match").otherwise("mismatch").alias("verification_status"), F.when(found, "strict_label_extracted").otherwise("strict_label_not_extracted").alias("extraction_status"),
        F.when(found, "strict_label_parsed").otherwise("strict_label_unparseable").alias("parse_status"), F.when(found, F.lit("strict_label")).alias("answer_source"), found.cast("int").alias("marker_count"),
    )


# How plain answers are announced, and what a plain number is.
_ANNOUNCED = r"\\boxed\{[^{}]*\}|<answer>[^<]*</answer>|(?i:answer)(?: is|:)[^\n]*"
_OPENED = r"\\boxed\{|<answer>|(?i:answer)(?: is|:)"
_NUMBER = r"\A(-?[0-9]{1,18})(?:/([1-9][0-9]{0,17}))?\z"


def announced(text: Column) -> Column:
    """(status, answer, markers) of the last announced answer: in a box, between tags or to the end of its line; one that doesn't end is malformed."""
    found = F.regexp_extract_all(text, F.lit(_ANNOUNCED), F.lit(0))
    inside = F.trim(F.regexp_replace(F.element_at(found, -1), r"^(?:\\boxed\{|<answer>|(?i:answer)(?: is|:))|(?:\}|</answer>)$", ""))
    none, cut = F.coalesce(F.size(found) == 0, F.lit(True)), F.regexp_count(text, F.lit(_OPENED)) > F.size(found)
    status = F.when(cut, F.lit("malformed_final_answer")).when(none, F.lit("no_final_answer")).otherwise(F.lit("extracted"))
    return F.struct(status.alias("status"), F.when(~cut & ~none, inside).alias("answer"), F.coalesce(F.regexp_count(text, F.lit(_OPENED)), F.lit(0)).alias("markers"))


def plain_number(reference: Column, said: Column) -> Column:
    """A scorer of whole numbers and fractions: exact equality of what announced() finds."""
    told = announced(said)
    part = lambda c, k: F.regexp_extract(c, _NUMBER, k)
    fraction = lambda c: (part(c, 1).try_cast("decimal(18,0)"), F.coalesce(part(c, 2).try_cast("decimal(18,0)"), F.lit(1).cast("decimal(18,0)")))
    (a, b), (c, d) = fraction(reference), fraction(told["answer"])
    found = told["status"] == "extracted"
    status = F.when(a.isNull(), "reference_invalid").when(~found, "prediction_not_extracted").when(c.isNull(), "prediction_unparseable").when(a * d == b * c, "match").otherwise("mismatch")
    return F.struct(
        status.alias("verification_status"), told["status"].alias("extraction_status"), F.when(found & c.isNotNull(), "parsed").otherwise("unparsed").alias("parse_status"),
        F.when(found, F.lit("announced")).alias("answer_source"), told["markers"].cast("int").alias("marker_count"),
    )


def sample_scores(records: DataFrame, references: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """SCORE and score_sha256 of each record, without its text or the reference.

    scorer: strict_label, plain_number, or a caller's own through backend.scored_by().
    Failed generations and references without meaning are no model errors: they raise.
    """
    require_none(union(named(records.where("status = 'failed'"), "failed_generation", "request_id"), named(records.join(references.select("item_id"), "item_id", "left_anti"), "no_reference", "request_id")))
    said = records.join(references.select("item_id", "reference"), "item_id")
    told = said.withColumn("v", scorer(F.col("reference"), F.col("generated_text"))).select("request_id", "item_id", "item_index", "sample_index", F.col("record_sha256").alias("generation_record_sha256"), F.col("v.verification_status"), F.col("v.extraction_status"), F.col("v.parse_status"), F.col("v.answer_source"), F.col("v.marker_count"), F.size("output_token_ids").alias("completion_token_count"), "finish_reason")
    invalid = F.raise_error(F.lit("a reference has no meaning")).cast("boolean")
    told = told.withColumn("correct", F.when(F.col("verification_status") == "reference_invalid", invalid).otherwise(F.col("verification_status") == "match")).select(*SCORE)
    return told.withColumn("score_sha256", object_sha256(told, schema_version=F.lit(versions.SAMPLE_SCORE), **{n: n for n in SCORE}))


def pass_at_k(n: int, c: int, k: int) -> Fraction:
    """The chance that k of n samples, c of them right, hold a right one."""
    return 1 - Fraction(math.comb(n - c, k), math.comb(n, k))


def half_up(value: Fraction) -> int:
    return (2 * value.numerator * SCALE + value.denominator) // (2 * value.denominator)


def pass_at_k_ppm(rows: DataFrame, n: str, c: str, ks: tuple[int, ...]) -> DataFrame:
    """rows with pass_at_k in millionths for each k, exact until it's rounded half up once; null where there are fewer than k samples or no count.

    Fractions are made once for each (samples, right ones), so the numbers' length costs
    as many times as there are such pairs.
    """
    names = [f"pass_at_{k}" for k in ks]

    def run(frames):
        for frame in frames:
            for k, name in zip(ks, names, strict=True):
                frame[name] = [half_up(pass_at_k(a, b, k)) if 0 <= b <= a and a >= k else None for a, b in zip(frame["vl_n"].tolist(), frame["vl_c"].tolist(), strict=True)]
                frame[name] = frame[name].astype("Int64")
            yield frame

    pairs = rows.select(F.col(n).cast("long").alias("vl_n"), F.col(c).cast("long").alias("vl_c")).where("vl_n is not null and vl_c is not null").distinct()
    told = pairs.mapInPandas(run, "vl_n long, vl_c long" + "".join(f", {x} long" for x in names))
    return rows.join(told, (F.col(n) == F.col("vl_n")) & (F.col(c) == F.col("vl_c")), "left").select(*rows.columns, *names)


#: Parts that fractions of a key are added up in before they meet.
FRACTION_PARTS = 64


def mean_of_fractions(rows: DataFrame, key: str, num: str, den: str) -> DataFrame:
    """(key, ppm): the mean of each key's fractions num / den (whole numbers, den from 1 on), exact until it's rounded half up once.

    Equal fractions are counted first; counts of different ones are added as whole
    numbers of any length, in parts by hash, so a key of many fractions isn't one task.
    """

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum((Fraction(int(a), int(b)) * int(n) for a, b, n in zip(frame["a"], frame["b"], frame["n"], strict=True)), Fraction(0))
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "part": [frame["part"].iloc[0]], "a": [str(total.numerator)], "b": [str(total.denominator)], "n": [1], "all": [int(frame["all"].sum())]})

    def rounded(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum((Fraction(int(a), int(b)) for a, b in zip(frame["a"], frame["b"], strict=True)), Fraction(0))
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "ppm": [half_up(total / int(frame["all"].sum()))]})

    kind = dict(rows.dtypes)[key]
    told = rows.select(F.col(key).alias("k"), F.col(num).cast("string").alias("a"), F.col(den).cast("string").alias("b")).groupBy("k", "a", "b").agg(F.count("*").alias("n"))
    told = told.select("k", F.pmod(F.xxhash64("a", "b"), F.lit(FRACTION_PARTS)).cast("int").alias("part"), "a", "b", "n", F.col("n").alias("all"))
    parts = told.groupBy("k", "part").applyInPandas(added, f"k {kind}, part int, a string, b string, n long, all long")
    return parts.groupBy("k").applyInPandas(rounded, f"k {kind}, ppm long").withColumnRenamed("k", key)


def item_scores(scores: DataFrame) -> DataFrame:
    """(item_id, item_index, n, correct_count, sample_correctness) in the order of samples; a protocol bounds an item's samples."""
    rows = F.array_sort(F.collect_list(F.struct("sample_index", "correct")))
    return scores.groupBy("item_id", "item_index").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct_count"), rows["correct"].alias("sample_correctness"))


def report(scores: DataFrame, ks: tuple[int, ...]) -> dict[str, object]:
    """Counts and exact rates of a run; means over items are of fractions, rounded once.

    Only counts come to the driver: items are counted by (samples, right ones).
    """
    total = scores.agg(
        F.count("*").alias("sample_count"), F.count_if("correct").alias("correct_sample_count"), F.coalesce(F.sum("completion_token_count"), F.lit(0)).alias("completion_token_count_total"), F.count_if(F.col("finish_reason") == "length").alias("truncation_count"),
        F.count_if(F.col("extraction_status").isin("extracted", "strict_label_extracted")).alias("e"), F.count_if(F.col("parse_status").isin("parsed", "strict_label_parsed")).alias("p"),
    ).first()
    n = total["sample_count"]
    if not n:
        raise ContractError("a report needs scores")
    kinds = scores.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("c")).groupBy("n", "c").count().collect()  # MOST_SAMPLES squared at most
    items = sum(r["count"] for r in kinds)
    if any(k > r["n"] for k in ks for r in kinds):
        raise ContractError("pass@k of more samples than an item has")
    counts = lambda c: {r[0]: r["count"] for r in scores.groupBy(c).count().orderBy(c).collect()}
    return {
        "item_count": items, "sample_count": n, "correct_sample_count": total["correct_sample_count"], "completion_token_count_total": total["completion_token_count_total"], "truncation_count": total["truncation_count"],
        "answer_accuracy_ppm": half_up(Fraction(total["correct_sample_count"], n)), "extraction_rate_ppm": half_up(Fraction(total["e"], n)), "parse_rate_ppm": half_up(Fraction(total["p"], n)), "truncation_rate_ppm": half_up(Fraction(total["truncation_count"], n)),
        "pass_at_k_ppm": {str(k): half_up(sum((pass_at_k(r["n"], r["c"], k) * r["count"] for r in kinds), Fraction(0)) / items) for k in ks}, "verification_status_counts": counts("verification_status"), "finish_reason_counts": counts("finish_reason"),
    }


def panel_of(scores: dict[tuple[str, int], DataFrame], items: DataFrame, stratum_key: str) -> DataFrame:
    """A paired panel from the first samples of runs by (arm, seed): item, stratum, arm, seed, correct."""
    strata = items.select("item_id", "item_index", F.col("strata")[stratum_key].alias("stratum"))
    parts = [s.where("sample_index = 0").select("item_id", F.lit(arm).alias("arm"), F.lit(seed).cast("long").alias("seed"), "correct") for (arm, seed), s in sorted(scores.items())]
    return union(*parts).join(strata, "item_id").select("item_id", "item_index", "stratum", "arm", "seed", "correct")


def golden_violations(expected: dict, observed: dict) -> list[str]:
    """Names of fields, by their paths, whose values differ or that one side lacks."""
    out = []
    for k in sorted({*expected, *observed}, key=str):
        a, b = expected.get(k), observed.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out += [f"{k}.{x}" for x in golden_violations(a, b)]
        elif a != b or (k in expected) != (k in observed):
            out.append(str(k))
    return out
