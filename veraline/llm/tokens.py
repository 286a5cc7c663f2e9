"""Token ids as ORC: run-length coded integers, row indexes, Bloom filters on doc_id.

Files hold documents in ascending doc_id order over the files in a row.  A reader
takes stripes in parallel; a look-up by doc_id skips files and row groups by their
ranges and Bloom filters before it reads any ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veraline.llm.common import encoder, small_batches, tidy, tokenizer_path
from veraline.plans.store import new_path

STORED = "part int, start_in_part long, doc_id long, n_tokens long, ids array<int>"
ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(16 << 20),
}


def encode_partitions(docs: DataFrame, path: str, end: int) -> DataFrame:
    """STORED rows of sorted partitions of (doc_id, text)."""

    def run(batches):
        own, part, done = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            flat, sizes = own.encode(batch.column(1), end)
            ends = np.cumsum(sizes)
            arrays = [
                pa.array(np.full(len(ids), part, np.int32)),
                pa.array(done + ends - sizes),
                ids.cast(pa.int64()),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))),
            ]
            done += int(ends[-1]) if len(ids) else 0
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "start_in_part", "doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(tidy(run), STORED)


def write(docs: DataFrame, target: str | None = None, tokenizer: str | None = None, end: int = 0) -> str:
    """Encode every whole text, append id `end`, write ORC files in ascending doc_id order; returns their folder.

    Null text: empty, so the end id alone.  Null doc_ids come first.  Rows of one
    doc_id are ordered by their text.  Texts are dealt by ranges of doc_id and
    text hash, so a repeated doc_id doesn't gather in one task.
    """
    small_batches(docs.sparkSession)
    target = target or new_path(docs.sparkSession, "token-orc")
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    encode_partitions(rows, tokenizer or tokenizer_path(), end).write.options(**ORC).orc(target)
    return target


def read(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; start counts the ids of all documents before.

    One total for each written partition meets on the driver.
    """
    stored = spark.read.schema(STORED).orc(target)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    rows, run = [], 0
    for t in totals:
        rows.append((t["part"], run))
        run += t["n"]
    base = F.broadcast(spark.createDataFrame(rows, "part int, before long"))  # one row per written partition
    return stored.join(base, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def look_up(spark: SparkSession, target: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents: ranges and Bloom filters leave the other row groups unread."""
    return read(spark, target).where(F.col("doc_id").isin(doc_ids))


def checksums(rows: DataFrame, *keep: str) -> DataFrame:
    """keep columns and ids_crc32 of rows with an `ids` array of int."""
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep) + ", ids_crc32 long"

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(crcs, pa.int64())], names=[*keep, "ids_crc32"])

    return rows.select(*keep, "ids").mapInArrow(tidy(run), schema)


def token_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document, from the written files: doc_id, start, n_tokens, ids_crc32."""
    return checksums(read(docs.sparkSession, write(docs, tokenizer=tokenizer)), "doc_id", "start", "n_tokens")
