"""Measures of runs: clipped surrogates, order statistics, stages, phases, parameters, differences, schedules, split errors."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veraline.operators.checks import ContractError
from veraline.operators.ordering import keyed_totals

# --- clipped surrogate ---


def importance_ratio(policy: Column, sampled: Column) -> Column:
    """The ratio of a token's probabilities, from their logarithms."""
    return F.exp(policy - sampled)


def surrogate(tokens: DataFrame, by: list[str], completion: str, ratio: str, advantage: str, longest: int, epsilon: float = 0.2, world: int = 1, completions: int | None = None) -> DataFrame:
    """By the keys: the clipped surrogate over tokens (completion, ratio, advantage), and what a merge of shards needs.

    loss_sum is that of -min(ratio * advantage, clipped ratio * advantage); loss is loss_sum *
    world / (completions * longest).  Ratios count as clipped where clipping changes the
    minimum: low ones of negative advantages, high ones of positive ones.  completions:
    the active ones over all shards, this table's distinct ones if not given.
    """
    if not 0 < epsilon < 1 or longest < 1 or world < 1:
        raise ContractError("epsilon lies between 0 and 1; a completion has a token or more, an update a shard or more")
    r, a = F.col(ratio), F.col(advantage)
    clipped = F.greatest(F.least(r, F.lit(1 + epsilon)), F.lit(1 - epsilon))
    sums = {
        "token_count": F.count("*"), "loss_sum": -F.sum(F.least(r * a, clipped * a)), "ratio_sum": F.sum(r), "ratio_min": F.min(r), "ratio_max": F.max(r),
        "low_clipped": F.count_if((r < 1 - epsilon) & (a < 0)), "high_clipped": F.count_if((r > 1 + epsilon) & (a > 0)),
    }
    # a completion first, so that distinct ones are counted without a set of them
    each = tokens.groupBy(*by, completion).agg(*(c.alias(k) for k, c in sums.items()))
    merged = {"ratio_min": F.min("ratio_min"), "ratio_max": F.max("ratio_max")}
    total = each.groupBy(*by).agg(*(merged.get(k, F.sum(k)).alias(k) for k in sums), F.count("*").alias("completion_count"))
    n = F.col("completion_count") if completions is None else F.lit(completions)
    return total.withColumn("loss", F.coalesce(F.col("loss_sum") * world / F.nullif(n * longest, F.lit(0)), F.lit(0.0)))


# --- order statistics, phases, stages ---


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, Fraction], nearest: bool = False) -> DataFrame:
    """(keys, a column for each name) of the values' quantiles: linear between neighbours, or, if nearest, the value at floor(q * (n - 1)).

    Ranks come from range partitions, so a key may hold all rows; null values don't count.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("vl_group"), F.col(value).cast("double").alias("vl_v"))
    counts = own.groupBy("vl_group").agg(F.count("*").alias("vl_n"))
    ranked = keyed_totals(own, "vl_group", ["vl_v"], {}, "quantiles").join(counts, "vl_group")
    found = []
    for name, q in at.items():
        place = F.expr(f"{q.numerator} * (vl_n - 1)")
        low, rest = F.floor(place / q.denominator), F.pmod(place, F.lit(q.denominator)) / F.lit(float(q.denominator))
        here = lambda k: F.max(F.when(F.col("position") == k, F.col("vl_v")))  # noqa: B023, E731
        a, b = here(low), here(F.least(low + 1, F.col("vl_n") - 1))
        found.append((a if nearest else a + (b - a) * F.max(rest)).alias(name))
    return ranked.groupBy("vl_group").agg(*found).select("vl_group.*", *at)


def round_medians(rows: DataFrame, keys: list[str], turn: str, value: str) -> DataFrame:
    """(keys, least_median, most_median) of the medians of each turn."""
    medians = quantiles(rows, [*keys, turn], value, {"m": Fraction(1, 2)})
    return medians.groupBy(*keys).agg(F.min("m").alias("least_median"), F.max("m").alias("most_median"))


def phase_means(rows: DataFrame, keys: list[str], phases: list[str], total: str, tokens: str, unit: float = 1.0) -> DataFrame:
    """(keys, {phase}_mean, tokens, tokens_per_s): means by phase, and all tokens over all time (`unit` of it a second)."""
    means = (F.avg(p).alias(f"{p}_mean") for p in phases)
    return rows.groupBy(*keys).agg(*means, F.sum(tokens).alias("tokens"), (F.sum(tokens) / (F.sum(total) / unit)).alias("tokens_per_s"))


def stages(rows: DataFrame, keys: list[str], updated: Column, seconds: str) -> DataFrame:
    """(keys, attempts, updates, skips, seconds)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(updated).alias("updates"), F.count_if(~updated).alias("skips"), F.sum(seconds).alias("seconds"))


# --- parameters, differences, schedules ---


def parameter_totals(rows: DataFrame, model: str, storage: list[str], size: str) -> DataFrame:
    """(model, total): sizes of a model's parameters, those that share a storage counted once."""
    return rows.groupBy(model, *storage).agg(F.max(size).alias("vl_size")).groupBy(model).agg(F.sum("vl_size").alias("total"))


def relative_difference(rows: DataFrame, keys: list[str], a: Column, b: Column, least: float = 1e-12) -> DataFrame:
    """(keys, relative, most): the length of a - b over that of a (`least` at least), and the largest difference."""
    return rows.groupBy(*keys).agg((F.sqrt(F.sum((a - b) ** 2)) / F.greatest(F.sqrt(F.sum(a**2)), F.lit(least))).alias("relative"), F.max(F.abs(a - b)).alias("most"))


def decayed(consumed: Column, target: Column | float, part: float = 0.9) -> Column:
    """The factor of a learning rate that falls with the consumed share of its target by `part` in all."""
    share = F.least(F.lit(1.0), consumed.cast("double") / (target if isinstance(target, Column) else F.lit(float(target))))
    return 1 - F.lit(part) * share


def cursor(attempt: Column, place: Column | int, batch: int, examples: int) -> Column:
    """Which example an attempt's place holds, going round all of them."""
    return (attempt * batch + place) % examples


# --- splits ---


def split_errors(assigned: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(split, n, target, error): rows of each split, its share by weight, and what the share of rows differs by; splits of others have target 0."""
    whole = sum(weights.values())
    wanted = assigned.sparkSession.createDataFrame(list(weights.items()), "split string, vl_weight long")
    counts = assigned.groupBy("split").agg(F.count("*").alias("n"))
    told = wanted.join(counts, "split", "full").select("split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("vl_weight", F.lit(0)).alias("w"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row a split
    target = F.col("w") / F.lit(float(whole))
    return told.select("split", "n", target.alias("target"), F.coalesce(F.col("n") / F.nullif(total, F.lit(0)) - target, F.lit(0.0)).alias("error"))


def largest_error(errors: DataFrame) -> float:
    return errors.agg(F.coalesce(F.max(F.abs("error")), F.lit(0.0))).first()[0]
