"""Rules applied to tables: what breaks them is a table too, and a gate that fails closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a rule; the message names the rule and the first offenders by key, never any text."""


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for every row and rule that isn't true of it; one pass over df."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def named(df: DataFrame, rule: str, key: str) -> DataFrame:
    """All rows of df as violations of one rule."""
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """One violation for each value of the keys that several rows have."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("vl_n")).where("vl_n > 1")
    return twice.select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_none(broken: DataFrame, offenders: int = 3) -> None:
    """Raise ContractError with the first offenders in the order of rule and key; only these reach the driver."""
    first = broken.orderBy("rule", F.col("key").asc_nulls_first()).limit(offenders).collect()
    if first:
        raise ContractError("; ".join(f"{r['rule']}: {r['key']}" for r in first))
