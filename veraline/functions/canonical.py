"""Canonical JSON as columns, and digests over it.

The form: keys sorted by code point, no spaces, non-ASCII characters as they are,
quotes, backslashes and control characters escaped, no NaN or infinity.  So the digests agree
with those of any writer of that form.
"""

from __future__ import annotations

import hashlib
import tempfile

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The escapes of the form that have a letter; other control characters are four lowercase hexadecimal digits.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(text: Column) -> Column:
    """A string in quotes; null is null."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    whole = F.when(text.rlike("[\\x00-\\x1f]"), escaped).otherwise(out)
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), whole, F.lit('"')))


@F.pandas_udf(T.StringType())
def _float_text(values: pd.Series) -> pd.Series:
    """Shortest text that reads back as the same double; Spark writes exponents otherwise."""
    return values.map(lambda x: None if x is None or x != x or x in (float("inf"), float("-inf")) else repr(float(x)))


def _or_null(value: Column, text: Column) -> Column:
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def _has_floats(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []
    return isinstance(kind, (T.FloatType, T.DoubleType)) or any(map(_has_floats, inner))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of that type, as a string; null is the word null.

    Structs and maps are objects.  Doubles that aren't finite raise an error, as do other types.
    """
    if isinstance(kind, T.StringType):
        return json_string(value)
    if isinstance(kind, T.BooleanType):
        return _or_null(value, F.when(value, F.lit("true")).otherwise(F.lit("false")))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _or_null(value, value.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = _float_text(value.cast("double"))
        return _or_null(value, F.coalesce(text, F.raise_error(F.lit("a number that isn't finite has no canonical JSON")).cast("string")))
    if isinstance(kind, (T.ArrayType, T.MapType)) and _has_floats(kind):
        raise TypeError("doubles inside arrays or maps have no canonical JSON here: give them as text or parts per million")
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: canonical_json(x, kind.elementType))
        return _or_null(value, F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")))
    if isinstance(kind, T.MapType):
        inner = F.transform(F.array_sort(F.map_entries(F.transform_values(value, lambda _, v: canonical_json(v, kind.valueType)))), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
        return _or_null(value, F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in fields]
        return _or_null(value, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    raise TypeError(f"{kind.simpleString()} has no canonical JSON")


def sha256_json(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)


def object_sha256(df: DataFrame, **fields: Column | str) -> Column:
    """sha256_json() of an object made of the named columns of df."""
    made = F.struct(*(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in fields.items()))
    return sha256_json(made, df.select(made.alias("x")).schema["x"].dataType)


#: Rows of a serial digest at most; tables of any size have sources/jsonl.tree_sha256().
MOST_LISTED = 50_000_000
#: Bytes of a serial digest that its task holds, beyond which they wait in a file of their own.
HELD_BYTES = 32 << 20


def joined(rows: DataFrame, order: list[str], columns: list[str], between: bytes = b"") -> DataFrame:
    """(section, part, seq, data, n): the binary `columns` of the rows in that order, each column a section, a batch's values joined to one piece.

    Null isn't listed; n counts all rows, once a section.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(batches):
            listed = ([x for x in batch.column(k).to_pylist() if x is not None] for k in range(len(columns)))
            yield pa.RecordBatch.from_pylist([{"section": k, "part": part, "seq": seq, "data": between.join(x) if x else None, "n": batch.num_rows} for k, x in enumerate(listed)], PIECES)

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns).mapInArrow(run, "section int, part int, seq long, data binary, n long")


PIECES = pa.schema([("section", pa.int32()), ("part", pa.int32()), ("seq", pa.int64()), ("data", pa.binary()), ("n", pa.int64())])


def serial_sha256(pieces: DataFrame, heads: list[bytes], after: bytes = b"", between: bytes = b"", most: int | None = None) -> tuple[str, int]:
    """(sha256 of each section's head and its pieces (joined()) in their order, and `after`; rows of a section).

    Pieces come to one task as they are met, unsorted, and wait in a file until all are
    there: so it holds a batch of them at a time.
    """
    limit = HELD_BYTES

    def run(batches):
        with tempfile.SpooledTemporaryFile(limit) as file:
            places, n, end = [], 0, 0
            for batch in batches:
                for section, part, seq, data, k in zip(*(batch.column(c).to_pylist() for c in PIECES.names), strict=True):
                    n += k if section == 0 else 0
                    if most is not None and n > most:
                        raise ValueError(f"a serial digest of more than {most} rows")
                    if data is not None:
                        places.append((section, part, seq, end, len(data)))
                        file.write(data)
                        end += len(data)
            sha, last = hashlib.sha256(heads[0]), 0
            for k, (section, _, _, at, size) in enumerate(sorted(places)):
                for head in heads[last + 1 : section + 1]:
                    sha.update(head)
                sha.update(between if k and section == last else b"")
                last = section
                file.seek(at)
                sha.update(file.read(size))
            for head in heads[last + 1 :]:
                sha.update(head)
            sha.update(after)
            yield pa.RecordBatch.from_pylist([{"digest": sha.hexdigest(), "n": n}])

    found = pieces.repartition(1).mapInArrow(run, "digest string, n long").first()
    return (found["digest"], found["n"]) if found else (hashlib.sha256(b"".join(heads) + after).hexdigest(), 0)


def ordered_sha256(rows: DataFrame, order: list[str], text: Column, before: str, after: str) -> tuple[str, int]:
    """(sha256 of `before`, the rows' texts in that order with commas between, and `after`; how many rows).

    Such a digest is a serial sum by its definition, so it's for sets of MOST_LISTED rows
    at most and refuses more.  Texts are sorted and joined in range partitions; what one
    task hashes are these pieces, and the driver sees the digest alone.  A text that is
    null isn't listed, but counted.
    """
    keys = [f"k{i}" for i in range(len(order))]
    placed = rows.select(F.encode(text, "UTF-8").alias("t"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)))
    return serial_sha256(joined(placed, [*keys, "t"], ["t"], b","), [before.encode()], after.encode(), b",", MOST_LISTED)


def list_digest(rows: DataFrame, order: list[str], element: Column) -> DataFrame:
    """(digest, n): sha256 of the canonical JSON of a list whose elements, given as JSON texts, are in that order; see ordered_sha256()."""
    return rows.sparkSession.createDataFrame([ordered_sha256(rows, order, element, "[", "]")], "digest string, n long")


def set_digest(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """list_digest() of all [key, payload], sorted by key."""
    kinds = rows.schema
    pair = F.concat(F.lit("["), canonical_json(F.col(key), kinds[key].dataType), F.lit(","), canonical_json(F.col(payload), kinds[payload].dataType), F.lit("]"))
    return list_digest(rows, [key], pair)
