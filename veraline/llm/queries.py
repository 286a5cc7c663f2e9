"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veraline.llm.warc import AUDIT_SQL
from veraline.plans.sql import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pii_key(spark: SparkSession) -> str:
    """The key of the session setting spark.veraline.pii.key; without it one that's no secret, for tables of invented people alone."""
    return spark.conf.get("spark.veraline.pii.key", None) or "invented tables only"


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.pii import pseudonymize

    return pseudonymize(_table(spark, sf_dir, "documents"), pii_key(spark), found="found")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.warc import audit_copy

    return audit_copy(_table(spark, sf_dir, "pages"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.tokens import token_ids

    return token_ids(_table(spark, sf_dir, "documents"))


def op4_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.vectors import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.ann import nearest_of

    rows = _table(spark, sf_dir, "embeddings")
    return nearest_of(rows.where("vec_id % 20 = 0"), rows, k=20)


def op7_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.mixing import calibrate

    return calibrate(_table(spark, sf_dir, "documents")).drop("text", "n_chars")


def op8_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_secret_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.runs import digests, periodic_runs, with_planted_periods

    return digests(periodic_runs(with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veraline.llm.chunks import digests, encode_and_decode

    return digests(encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {
    f.__name__: f
    for f in (op1_feistel_pii, op2_merkle_fixity, op3_token_orc, op4_pivot_dedup, op5_chosen_path_join, op6_multi_index_hashing, op7_ipf_mixing, op8_cutting_stock, op9_secret_structure, op10_noisy_or_toxicity, op11_periodic_runs, op12_lanczos_whitening, op13_chunk_reuse)
}
ORACLE_SQL = {"op2_merkle_fixity": AUDIT_SQL}
