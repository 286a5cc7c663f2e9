"""Results that appear whole or not at all, in whatever store Spark writes to.

Data goes to a folder of its own beside the target, then its manifest, made from what was
written; one rename publishes both.  What fails before leaves nothing at the target, and
its folder is removed.  Where a store's rename copies, readers still refuse what the manifest doesn't
describe.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veraline.operators.checks import ContractError
from veraline.plans.store import remove

DATA, MANIFEST = "data", "manifest.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a text of a driver's size beside its place, then put it there, over what was there."""
    beside = f"{path}.{uuid.uuid4().hex}"
    files = _system(spark, path)
    try:
        stream = files.create(_path(spark, beside), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hflush()
        finally:
            stream.close()
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        place = files.makeQualified(_path(spark, path))
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(files.makeQualified(_path(spark, beside)), place, kinds)
    except BaseException:
        remove(spark, beside)
        raise


def document_text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, indent=2) + "\n"


def publish(rows: DataFrame, folder: str, manifest: Callable[[DataFrame], dict]) -> dict:
    """Write rows as JSON lines and the manifest of what was written, and publish both as `folder`; returns the manifest.

    manifest: makes the body from the reread rows.  A folder that's there already raises.
    """
    spark, target = rows.sparkSession, folder.rstrip("/")
    if exists(spark, target):
        raise ContractError("there is a result already where this one is to go")
    beside = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        rows.write.option("ignoreNullFields", "false").json(f"{beside}/{DATA}")
        body = manifest(spark.read.schema(rows.schema).json(f"{beside}/{DATA}"))
        write_text(spark, f"{beside}/{MANIFEST}", document_text(body))
        if not _system(spark, target).rename(_path(spark, beside), _path(spark, target)):
            raise ContractError("the result couldn't be put in its place")
    except BaseException:
        remove(spark, beside)
        raise
    return body
