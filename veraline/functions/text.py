"""Normalisation, n-grams, hashing and exact integer arithmetic as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as one lexeme, and the spacing commands that are dropped.
LEXEME = re.compile(r"\\[A-Za-z]+|[\w]+(?:\.[0-9]+)?|[^\s]")
LATEX_SPACE = re.compile(r"\\(?:[,;:!]|(?:quad|qquad|enspace|thinspace)\b)")
DIGIT_COMMA = re.compile(r"(?<=\d),(?=\d)")
SAME = {"\u2212": "-", "\u2013": "-", "\u2014": "-", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\left": "", "\\right": ""}


def normal_form(text: str) -> str:
    """Compatibility-normal, case-folded lexemes joined by one space."""
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    for a, b in SAME.items():
        out = out.replace(a, b)
    return " ".join(LEXEME.findall(DIGIT_COMMA.sub("", LATEX_SPACE.sub(" ", out))))


@F.pandas_udf(T.StringType())
def normalize(texts: pd.Series) -> pd.Series:
    """normal_form() of a column; null stays null.  Spark has no Unicode normalisation of its own."""
    return texts.map(lambda t: None if t is None else normal_form(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_all(texts: pd.Series) -> pd.Series:
    """normalize() of each text of an array."""
    return texts.map(lambda ts: None if ts is None else [None if t is None else normal_form(t) for t in ts])


@F.pandas_udf(T.BooleanType())
def is_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in composed form (NFC); plain ASCII is so already and never leaves the JVM."""
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), text).otherwise(_nfc(text))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores: the form that SQL can check."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a column that a lambda names would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(values: Column, n: int, between: str) -> Column:
    def of(v: Column) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(v) - n + 1), lambda i: F.concat_ws(between, *(F.element_at(v, i + k) for k in range(n))))
        return F.when(F.size(v) == 0, F.array().cast("array<string>")).when(F.size(v) < n, F.array(F.array_join(v, between))).otherwise(F.array_distinct(run))

    return let(values, of)


def ngrams(values: Column, n: int) -> Column:
    """Distinct n-grams of an array of strings: one of all values if there are fewer than n, none of none."""
    return _runs(values, n, "\x1f")


def char_ngrams(compact: Column, n: int) -> Column:
    """Distinct n-grams of the characters of a string without spaces."""
    return _runs(F.filter(F.split(compact, ""), lambda c: c != ""), n, "")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_mod(digest: Column, modulus: Column | int) -> Column:
    """A 64-digit hexadecimal number modulo a small one, exactly."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda a, i: (a * 16 + F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("long")) % m)


def seed63(digest: Column) -> Column:
    """The first eight bytes of a hexadecimal digest without their sign bit."""
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").bitwiseAND(F.lit(2**63 - 1))


def ppm_half_up(num: Column, den: Column) -> Column:
    """num / den in parts per million, halves up, in whole numbers."""
    return F.floor((F.lit(2_000_000) * num + den) / (F.lit(2) * den)).cast("long")


def ppm_half_even(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0)).otherwise(F.bround(num * 1_000_000 / den)).cast("long")


def log_softmax(logits: Column) -> Column:
    """Stable log-probabilities of an array of logits; the maximum and the sum are computed once a row."""

    def of(x: Column) -> Column:
        def less(top: Column) -> Column:
            total = F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
            return let(total, lambda t: F.transform(x, lambda v: v - top - t))

        return let(F.array_max(x), less)

    return let(logits, of)


def softcap(logits: Column, scale: float, cap: float, temperature: float) -> Column:
    return F.transform(logits, lambda x: F.lit(cap) * F.tanh(x * scale / cap) / temperature)
