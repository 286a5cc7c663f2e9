"""Rows of training batches: examples, padding, masks, positions, rewards, normalisers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.functions import predicates as P
from veraline.functions.text import let, log_softmax
from veraline.operators.checks import repeated, union, violations

EXAMPLE = "sample_id string, prompt array<int>, completion array<int>"


def copy_bit_examples(spark: SparkSession, bits: int, zero: int = 3, one: int = 4, eos: int = 2) -> DataFrame:
    """EXAMPLE of every row of bits of that length: the completion repeats the prompt and ends."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: F.when(F.expr("id").bitwiseAND(F.pow(F.lit(2), k).cast("long")) > 0, F.lit(one)).otherwise(F.lit(zero)))
    made = spark.range(1 << bits).withColumn("prompt", digits)
    return made.select(F.concat(F.lit("copy-"), F.lpad(F.col("id").cast("string"), len(str((1 << bits) - 1)), "0")).alias("sample_id"), "prompt", F.concat("prompt", F.array(F.lit(eos))).alias("completion"))


def example_violations(examples: DataFrame, vocabulary: int, supervised: bool = True) -> DataFrame:
    """Empty prompts or completions, ids outside the vocabulary, repeated samples."""
    inside = lambda c: F.forall(c, lambda x: P.is_whole(x, 0, vocabulary - 1))
    rules = {"prompt": (F.size("prompt") > 0) & inside("prompt")}
    if supervised:
        rules["completion"] = (F.size("completion") > 0) & inside("completion")
    return union(violations(examples, "sample_id", rules), repeated(examples, "repeated_sample_id", "sample_id"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def position_ids(attention: pd.Series) -> pd.Series:
    """Places among the attended tokens, from 0; unattended ones before the first have 0, later ones the last place."""
    return attention.map(lambda m: None if m is None else np.maximum(np.cumsum(np.asarray(m, bool)) - 1, 0).astype(np.int32).tolist())


def is_right_padded(attention: Column) -> Column:
    """Once attention ends, it doesn't begin again."""
    return P.sure(~F.exists(F.zip_with(F.slice(attention, 1, F.greatest(F.size(attention) - 1, F.lit(0))), F.slice(attention, 2, F.greatest(F.size(attention) - 1, F.lit(0))), lambda a, b: ~a & b), lambda x: x))


def completion_mask(ids: Column, start: Column, attention: Column, eos: int) -> Column:
    """True from the completion's first token through its first end token, where attended."""
    return let(F.array_position(F.slice(ids, start + 1, F.greatest(F.size(ids) - start, F.lit(0))), eos), lambda at: F.zip_with(F.sequence(F.lit(0), F.size(ids) - 1), attention, lambda k, a: a & (k >= start) & ((at == 0) | (k < start + at))))


def supervised_batch(examples: DataFrame, pad: int, eos: int, length: int | None = None) -> DataFrame:
    """(sample_id, group_id, input_ids, attention_mask, completion_start, completion_mask), padded on the right to the longest or the given length.

    Groups are numbered by sample_id.
    """
    from veraline.operators.ordering import running_totals

    tokens = examples.select("sample_id", F.concat("prompt", "completion").alias("t"), F.size("prompt").alias("completion_start"))
    longest = length or tokens.agg(F.max(F.size("t"))).first()[0] or 0
    placed = running_totals(tokens, ["sample_id"], {}, "batch").withColumnRenamed("position", "group_id")
    padded = placed.select(
        "sample_id", "group_id", F.concat("t", F.array_repeat(F.lit(pad), F.greatest(F.lit(longest) - F.size("t"), F.lit(0)))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(True), F.size("t")), F.array_repeat(F.lit(False), F.greatest(F.lit(longest) - F.size("t"), F.lit(0)))).alias("attention_mask"), "completion_start",
    )
    return padded.withColumn("completion_mask", completion_mask(F.col("input_ids"), F.col("completion_start"), F.col("attention_mask"), eos))


def greedy_token(logits: Column) -> Column:
    """The first place of the largest logit, from 0."""
    return (F.array_position(logits, let(logits, F.array_max)) - 1).cast("int")


def token_log_probs(logits: Column, ids: Column, mask: Column) -> Column:
    """For each position the log-probability of its id under the logits before it; 0 where it isn't selected."""
    return F.transform(ids, lambda i, k: F.when(F.get(mask, k) & (k > 0), F.get(log_softmax(F.get(logits, k - 1)), i)).otherwise(0.0))


def exact_completion_reward(completion: Column, wanted: Column) -> Column:
    """1 where both lists of ids are the same, else 0."""
    return F.coalesce((completion == wanted).cast("int"), F.lit(0))


def reward_counts(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """(group, n, right, wrong, unassigned) of rewards of 1, 0 or null."""
    r = F.col(reward)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(r == 1).alias("right"), F.count_if(r == 0).alias("wrong"), F.count_if(r.isNull()).alias("unassigned"))


def shard_loss(shards: DataFrame, loss_sum: str, tokens: str) -> DataFrame:
    """shards with `loss`: loss_sum * shards / all tokens, whose mean over the shards is the loss a token; an empty shard has 0."""
    total = shards.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("vl_t"), F.count("*").alias("vl_w"))  # one row
    return shards.join(F.broadcast(total)).withColumn("loss", F.coalesce(F.col(loss_sum) * F.col("vl_w") / F.expr("nullif(vl_t, 0)"), F.lit(0.0))).drop("vl_t", "vl_w")


def task_means(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The mean and count of each measure by the keys; null measures don't count."""
    return rows.groupBy(*keys).agg(*(f for m in measures for f in (F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_n"))))
