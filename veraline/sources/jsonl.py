"""Strict JSON lines: what a lenient reader would let pass is reported, by file and line.

Spark's text source splits files at line feeds by ranges of bytes.  Lines are numbered
within each range as they're read, and a row a range says how many came before.  The bytes are
those of the file, so a file's digest can be computed from its lines, one after another.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.operators.checks import ContractError
from veraline.sources.committed import publish

MOST_BYTES = 8 << 20
_MARK = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Limits:
    """Bytes of a line and lines of a file at most (None: any number), and whether blank lines are faults or none."""

    most_bytes: int = MOST_BYTES
    most_lines: int | None = None
    blank_is_fault: bool = True


def fault_of(line: bytes | str | None, keys: frozenset[str] | None = None, limits: Limits | None = None) -> str | None:
    """What is wrong with one line, or None: duplicate keys, NaN or infinity, wrong keys, blank, too long, not normal text."""
    limits = limits or Limits()
    raw = line.encode() if isinstance(line, str) else line
    if raw is None or not raw.strip():
        return "blank" if limits.blank_is_fault else None
    if len(raw) > limits.most_bytes:
        return "too_long"
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "not_utf8"
    if text.startswith("﻿") or "\r" in text or "\x00" in text:
        return "bad_character"
    faults: list[str] = []

    def pairs(found):
        if len({k for k, _ in found}) != len(found):
            faults.append("duplicate_key")
        return dict(found)

    def constant(name):
        faults.append("not_finite")
        return None

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except (ValueError, RecursionError):
        return "not_json"
    if faults:
        return faults[0]
    if not isinstance(value, dict):
        return "not_an_object"
    if keys is not None and set(value) != keys:
        return "wrong_keys"
    return None if unicodedata.is_normalized("NFC", text) else "not_nfc"


def _in_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, raw): each line's place in the range of bytes that it was read in."""

    def run(batches):
        last, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (files[1:] != files[:-1]) | (starts[1:] != starts[:-1])]))
            at = np.arange(batch.num_rows) - np.repeat(new, np.diff(np.append(new, batch.num_rows)))
            if (batch.column(0)[0].as_py(), starts[0]) == last:
                end = new[1] if len(new) > 1 else batch.num_rows
                at[:end] += done
            last, done = (batch.column(0)[-1].as_py(), starts[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int64)), batch.column(2)], names=["file", "start", "at", "raw"])

    told = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))
    return told.mapInArrow(run, "file string, start long, at long, raw binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size) of all files, empty ones too; contents aren't read, and the list is the one that the driver reads any table by."""
    found = spark.read.format("binaryFile").load(path)
    sizes = found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))  # without empty files
    listed = spark.createDataFrame([(re.sub("^([^:/]+:)///", r"\1/", f),) for f in found.inputFiles()], "file string")
    return listed.join(sizes, "file", "left").select("file", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def _ranges(placed: DataFrame) -> DataFrame:
    """(file, start, n, bytes, before): a row a range of a file."""
    sums = placed.groupBy("file", "start").agg(F.count("*").alias("n"), F.sum(F.length("raw") + 1).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): lines end with LF alone and are numbered from 1 in each file."""
    placed = _in_ranges(spark, path)
    before = _ranges(placed).select("file", "start", "before")
    return placed.join(before, ["file", "start"]).select("file", (F.col("before") + F.col("at") + 1).alias("line"), "raw")


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, lines, marked, sha256) of each file: the digest is of its raw bytes; marked: it begins with a byte-order mark.

    A digest is serial, so a file's lines pass through one task, in their order and never
    held at once; files go to different tasks.
    """
    totals = _ranges(_in_ranges(spark, path)).groupBy("file").agg(F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"))
    # the text source takes a mark off; a last line without LF was counted with one
    files = _files(spark, path).join(totals, "file", "left").withColumn("over", F.col("size") - F.coalesce("bytes", F.lit(0)))
    files = files.select("file", "size", F.coalesce("lines", F.lit(0)).alias("lines"), (F.col("over") >= 2).alias("marked"), F.col("over").isin(0, 3).alias("ended"))

    def run(batches):
        last, sha, ended, first = None, None, False, True
        for batch in batches:
            done = []
            for file, marked, end, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if file != last:
                    if last is not None:
                        sha.update(b"\n" * ended)
                        done.append((last, sha.hexdigest()))
                    last, sha, ended, first = file, hashlib.sha256(_MARK * marked), end, True
                if not first:
                    sha.update(b"\n")
                sha.update(raw)
                first = False
            if done:
                yield pa.RecordBatch.from_pylist([{"file": f, "sha256": d} for f, d in done])
        if last is not None:
            sha.update(b"\n" * ended)
            yield pa.RecordBatch.from_pylist([{"file": last, "sha256": sha.hexdigest()}])

    lines = numbered_lines(spark, path).join(files.select("file", "marked", "ended"), "file")
    told = lines.repartition("file").sortWithinPartitions("file", "line").select("file", "marked", "ended", "raw").mapInArrow(run, "file string, sha256 string")
    empty = F.when(F.col("size") == 0, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("size") == 3, F.lit(hashlib.sha256(_MARK).hexdigest()))
    return files.join(told, "file", "left").select("file", "size", "lines", "marked", F.coalesce("sha256", empty).alias("sha256"))


def file_sha256(spark: SparkSession, path: str) -> str:
    """The digest of the raw bytes of the one file at path."""
    found = file_identities(spark, path).select("sha256").limit(2).collect()
    if len(found) != 1:
        raise ContractError(f"{len(found)} files where one is wanted")
    return found[0]["sha256"]


def read_records(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, violations): records of fine lines; violations (rule, file, line, detail) of others, of repeated keys and of files.

    detail: the line's digest, the key, or the number of lines; line is null for a file,
    and the first of a key.
    """
    limits, keys = limits or Limits(), frozenset(schema.fieldNames())

    @F.pandas_udf(T.StringType())
    def fault(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: fault_of(x, keys, limits))

    lines = numbered_lines(spark, path)
    if not limits.blank_is_fault:
        lines = lines.where(~F.col("raw").cast("string").rlike(r"\A[\x20\t\r\x0b\x0c]*\z"))
    told = lines.withColumn("fault", fault("raw"))
    records = told.where("fault is null").select("file", "line", F.from_json(F.col("raw").cast("string"), schema).alias("r")).select("file", "line", "r.*")
    bad = told.where("fault is not null").select(F.col("fault").alias("rule"), "file", "line", F.sha2("raw", 256).alias("detail"))
    totals = _ranges(_in_ranges(spark, path)).groupBy("file").agg(F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"))
    sized = _files(spark, path).join(totals, "file", "left")
    none = F.lit(None).cast("long").alias("line")
    bad = bad.unionByName(sized.where("size - coalesce(bytes, 0) >= 2").select(F.lit("byte_order_mark").alias("rule"), "file", none, F.lit(None).cast("string").alias("detail")))
    if limits.most_lines is not None:
        bad = bad.unionByName(sized.where(F.col("lines") > limits.most_lines).select(F.lit("too_many_lines").alias("rule"), "file", none, F.col("lines").cast("string").alias("detail")))
    if key:
        twice = records.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("f")).where("n > 1")
        bad = bad.unionByName(twice.select(F.lit("repeated_key").alias("rule"), "f.file", "f.line", F.col(key).cast("string").alias("detail")))
    return records.drop("file", "line"), bad


def tree_sha256(rows: DataFrame, key: str) -> str:
    """The digest of the sorted (key, payload digest) set, which doesn't depend on files or order.

    The set is hashed as a tree: 4,096 groups by key hash, then their digests, so no
    task sorts all rows.
    """
    payload = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    leaf = rows.select(F.pmod(F.xxhash64(key), F.lit(4096)).alias("g"), F.concat_ws(":", F.col(key).cast("string"), payload).alias("p"))
    groups = leaf.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), ","), 256).alias("d"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ","), 256)).first()[0]


def write_records(rows: DataFrame, path: str, key: str) -> str:
    """Publish rows as JSON lines with a manifest of their count and tree_sha256(), both or neither; returns the digest."""
    return publish(rows, path, lambda written: {"record_count": written.count(), "tree_sha256": tree_sha256(written, key)})["tree_sha256"]
