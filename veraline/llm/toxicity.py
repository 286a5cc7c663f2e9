"""Toxicity by multiple-instance learning: noisy-or over sentences, learned from document labels.

A sentence has probability p = sigmoid(b + sum of the weights of its distinct
words); a document is toxic unless neither its leak nor any sentence makes it so:
1 - (1 - leak) * product(1 - p).  Weights, bias and leak are fitted by gradient
ascent on the documents' likelihood with an L1 step that sets most words to zero.
The sentence probabilities then locate what offends.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.llm.common import WORD, small_batches, tidy
from veraline.plans.store import fresh

SENTENCE = re.compile(r"[^.!?\n]+")
#: Default bounds of the fitted sample: labelled documents, their characters in all, and the part of these that one document may have.
SAMPLE_DOCS, SAMPLE_CHARS, LARGEST = 10_000, 24_000_000, 0.1
BITS = 18


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # 2 ** BITS
    bias: float
    leak: float


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the stretches between . ! ? and line ends."""
    return [m.span() for m in SENTENCE.finditer(text)]


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << BITS) - 1)


def held_out(doc_id) -> F.Column:
    """True if crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, label) of labelled documents outside the held-out fifth: the first by hash, as many as both bounds allow.

    The hash decides alone, so that long documents are in the sample as often as short
    ones; only those with more than LARGEST of the bound are never fitted on.  A doc_id
    labelled both ways counts as toxic; null labels and ids don't count.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.where(~held_out("doc_id"))
    sized = docs.where("doc_id is not null").groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    first = known.join(sized, "doc_id").where(F.col("chars") <= LARGEST * most_chars).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).collect()
    rows, chars = [], 0
    for r in first:
        chars += r["chars"]
        if chars > most_chars:
            break
        rows.append((r["doc_id"], r["label"]))
    return docs.sparkSession.createDataFrame(rows, "doc_id long, label int")


def _bags(docs: DataFrame) -> DataFrame:
    """Word buckets by sentence of (label, text): label, sizes, buckets."""

    def run(batches):
        kept: dict[str, int] = {}
        for batch in batches:
            labels, sizes, buckets = [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, b = [], []
                for a, z in sentences(text or ""):
                    own = set()
                    for w in WORD.findall(text[a:z].lower()):
                        if w not in kept:
                            if len(kept) > 100_000:
                                kept.clear()
                            kept[w] = _bucket(w)
                        own.add(kept[w])
                    if own:
                        n.append(len(own))
                        b.extend(sorted(own))
                labels.append(label)
                sizes.append(n)
                buckets.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(buckets, pa.list_(pa.int32()))], names=["label", "sizes", "buckets"])

    return docs.select("label", "text").mapInArrow(tidy(run), "label int, sizes array<int>, buckets array<int>")


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 120, l1: float = 0.2, least_df: int = 3, most_docs: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the bounded sample of training_sample().  No labelled row: a model that says 0 of all."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, most_docs, most_chars)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most most_docs rows
    bags = _bags(text.select("label", "text")).toArrow()
    y = bags.column("label").to_numpy().astype(np.float64)
    dim = 1 << BITS
    if not len(y) or not y.any():
        return Model(np.zeros(dim), -20.0, 0.0)
    counts = np.concatenate([np.diff(c.offsets.to_numpy()) for c in bags.column("sizes").chunks])
    sizes, words = (np.concatenate([c.flatten().to_numpy() for c in bags.column(name).chunks]) for name in ("sizes", "buckets"))
    del bags
    return _ascend(y, counts, sizes, words, rounds, l1, least_df, dim)


def _ascend(y, counts, sizes, words, rounds, l1, least_df, dim) -> Model:
    # rare words can't be told from noise; the rest are numbered anew
    df = np.bincount(words, minlength=dim)
    used = np.flatnonzero(df >= least_df)
    to = np.full(dim, -1, np.int32)
    to[used] = np.arange(len(used))
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    w = to[words]
    sentence, w = sentence[w >= 0], w[w >= 0]
    doc = np.repeat(np.arange(len(y), dtype=np.int32), counts)
    n, d = len(sizes), len(used)
    scale = np.maximum(len(y), 1)
    # start where words that stand out over the documents explain them alone; the ascent then sets all weights
    pairs = np.unique(doc[sentence] * np.int64(d) + w)
    has = np.bincount(pairs % d, minlength=d)
    toxic = np.bincount(pairs % d, weights=y[pairs // d], minlength=d)
    rate = y.mean()
    stands_out = (toxic - has * rate) / np.sqrt(has * rate * (1 - rate) + 1e-9)
    bias, leak = -7.0, np.log(max(rate / 2, 1e-4) / (1 - rate / 2))
    theta = np.where(stands_out > 4, np.log((toxic + 0.5) / (has - toxic + 0.5)) - bias, 0.0)
    m, v = np.zeros(d + 2), np.zeros(d + 2)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, weights=theta[w], minlength=n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        lam = 1 / (1 + np.exp(-leak))
        none = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + np.log1p(-lam)
        q = np.clip(1 - np.exp(none), 1e-9, 1 - 1e-9)
        # d log-likelihood / d(-none): toxic documents want more, others less
        pull = np.where(y == 1, (1 - q) / q, -1.0)
        g = pull[doc] * p  # -d log(1-p)/dz = p
        grad = np.concatenate([np.bincount(w, weights=g[sentence], minlength=d), [g.sum(), (pull * lam).sum()]]) / scale
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
        move = step * m / (1 - 0.9**t)
        theta = theta + move[:d]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - l1 / scale * step[:d], 0)
        bias, leak = float(np.clip(bias + move[d], -9.0, -4.0)), min(leak + move[d + 1], 0.0)
    weights = np.zeros(dim)
    weights[used] = theta
    return Model(weights, float(bias), float(1 / (1 + np.exp(-leak))))


def score(docs: DataFrame, model: Model, spans: bool = False, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns keep (default: doc_id), score (0 to 1; column `name`) and, if asked for, offending: array<struct<start, end, p>> of sentences with p >= 0.5.

    Null or empty text: the leak alone.  Each row is scored by its own whole text;
    repeated rows and null doc_ids give a row each.
    """
    small_batches(docs.sparkSession)
    # a broadcast of a fixed size: the words that matter, of 2 ** BITS at most
    at = np.flatnonzero(model.weights)
    table = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), model.weights[at], model.bias, model.leak))
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*keep, F.col("text").cast("string").alias(fresh(docs, "text")))
    extra = T._parse_datatype_string(f"`{name}` double" + ", offending array<struct<start:int,end:int,p:double>>" * spans)
    schema = T.StructType([*source.schema.fields[:-1], *extra.fields])

    def run(batches):
        places, values, bias, leak = table.value
        weight = dict(zip(places.tolist(), values.tolist(), strict=True))
        kept: dict[str, float] = {}
        for batch in batches:
            scores, found = [], []
            for text in batch.column(len(keep)).to_pylist():
                none, own = np.log1p(-min(leak, 1 - 1e-12)), []
                for a, z in sentences(text or ""):
                    total = bias
                    words = set(WORD.findall(text[a:z].lower()))
                    for w in words:
                        x = kept.get(w)
                        if x is None:
                            if len(kept) > 100_000:
                                kept.clear()
                            x = kept[w] = weight.get(_bucket(w), 0.0)
                        total += x
                    if words:
                        p = 1 / (1 + np.exp(-min(max(total, -30.0), 30.0)))
                        none += np.log1p(-min(p, 1 - 1e-9))
                        if p >= 0.5:
                            own.append({"start": a, "end": z, "p": float(p)})
                scores.append(float(min(max(1 - np.exp(none), 0.0), 1.0)))
                found.append(own)
            arrays = [*batch.columns[: len(keep)], pa.array(scores, pa.float64())]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, name, "offending"][: len(arrays)])

    return source.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5), offending (the sentences that are toxic by themselves, by code points)."""
    return score(docs, fit(docs, labels), spans=True).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the limit."""
    name = fresh(docs, "score")
    return score(docs, model, keep=docs.columns, name=name).where(F.col(name) < limit).drop(name)
