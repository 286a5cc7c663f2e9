"""SQL queries over the driver's tables, registered with the SQL that checks them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table from which its row groups are many enough, and below which it isn't worth dealing out.
LARGE, TINY = 64 << 20, 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table lies in a row group or two, which one task reads whole: its rows are dealt to all cores.  Large tables keep their splits."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if TINY < size < LARGE else df


def run_sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL in which the driver's tables and the given frames are views."""
    text = text.replace("{", "{{").replace("}", "}}")
    named = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)} | frames
    for k, v in named.items():
        text = re.sub(rf"\b(from|join)\s+{k}\b", rf"\1 {{{k}}} {k}", text, flags=re.I)
    return spark.sql(text, **{k: v for k, v in named.items() if "{" + k + "}" in text})


def sql(name: str, spark_text: str, duck_text: str | None = None) -> None:
    """Register a query; duck_text only where the two dialects differ."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, spark_text)
    ORACLE_SQL[name] = duck_text or spark_text


def query(name: str, duck_text: str | None = None):
    """Register a DataFrame query."""

    def put(f):
        QUERIES[name] = f
        if duck_text:
            ORACLE_SQL[name] = duck_text
        return f

    return put
