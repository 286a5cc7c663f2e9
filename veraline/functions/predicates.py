"""Rules on columns: each is true where the value is fine, false (never null) elsewhere."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The forms of identifiers, digests, revisions, licences, versions and metadata keys.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:/@+-]{0,254}\z"
SHA256 = r"^[0-9a-f]{64}\z"
GIT_COMMIT = r"^(?:[0-9a-f]{40}|[0-9a-f]{64})\z"
LICENSE = r"^[A-Za-z0-9][A-Za-z0-9.+() -]{0,126}\z"
VERSION = r"^[A-Za-z0-9][A-Za-z0-9._+-]{0,126}\z"
METADATA_KEY = r"^[a-z][a-z0-9_]{0,62}\z"
MOST_TEXT = 1_000_000


def sure(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def is_identifier(value: Column) -> Column:
    return sure(value.rlike(IDENTIFIER) & ~value.contains("..") & ~value.rlike("[/:]\\z"))


def is_sha256(value: Column) -> Column:
    return sure(value.rlike(SHA256))


def is_license(value: Column) -> Column:
    return sure(value.rlike(LICENSE))


def is_version(value: Column) -> Column:
    return sure(value.rlike(VERSION))


def is_metadata_key(value: Column) -> Column:
    return sure(value.rlike(METADATA_KEY))


def is_revision(kind: Column, value: Column) -> Column:
    """A full commit where the kind is git_commit, a digest where it's sha256."""
    return sure(F.when(kind == "git_commit", value.rlike(GIT_COMMIT)).when(kind == "sha256", value.rlike(SHA256)))


def is_public_uri(value: Column, schemes: tuple[str, ...] = ("https", "hf")) -> Column:
    return sure(F.lower(F.regexp_extract(value, "^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]", 1)).isin(*schemes))


def is_relative_path(value: Column) -> Column:
    """A path inside a repository, spelt canonically."""
    return sure((F.length(value) > 0) & ~value.contains("\\") & ~value.startswith("/") & ~F.exists(F.split(value, "/"), lambda p: p.isin("", ".", "..")))


def is_sorted_set(values: Column) -> Column:
    """Elements ascend and none is repeated or null."""
    return sure((F.array_sort(F.array_distinct(values)) == values) & ~F.exists(values, lambda x: x.isNull()))


def is_count_map(counts: Column) -> Column:
    """Non-empty keys, whole counts of 0 or more."""
    return sure(F.forall(F.map_entries(counts), lambda e: (F.length(e["key"]) > 0) & e["value"].isNotNull() & (e["value"] >= 0)))


def has_user_message(messages: Column) -> Column:
    return sure(F.exists(messages, lambda m: m["role"] == "user"))


def is_causal_target(mask: Column, ids: Column, vocabulary: int) -> Column:
    """Position 0 isn't selected, and every selected id lies in the vocabulary."""
    fine = F.zip_with(mask, ids, lambda m, i: ~m | ((i >= 0) & (i < vocabulary)))
    return sure((F.size(mask) == F.size(ids)) & ~F.get(mask, F.lit(0)) & F.forall(fine, lambda x: x))


def is_finite(value: Column) -> Column:
    return sure(~F.isnan(value) & (F.abs(value) < float("inf")))


def is_log_probability(value: Column) -> Column:
    return is_finite(value) & sure(value <= 0)


def is_binary_reward(value: Column) -> Column:
    return sure(value.isin(0, 1))


def is_whole(value: Column, least: int, most: int) -> Column:
    return sure(value.between(least, most))


def fine_text(text: str | None, most: int = MOST_TEXT) -> bool:
    """Not null or blank, not too long, no NUL, carriage return or lone surrogate, and in composed normal form."""
    if text is None or len(text) > most or not text.strip() or "\x00" in text or "\r" in text:
        return False
    return text.isascii() or (unicodedata.is_normalized("NFC", text) and not any("\ud800" <= c <= "\udfff" for c in text))


@F.pandas_udf(T.BooleanType())
def are_texts(texts: pd.Series) -> pd.Series:
    """fine_text() of all of an array of strings; Spark has no Unicode normalisation of its own."""
    return texts.map(lambda t: t is not None and all(fine_text(x) for x in t))


def is_text(value: Column) -> Column:
    return are_texts(F.array(value))
