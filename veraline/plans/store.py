"""Tables that cut lineage, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only a session whose driver and
executors are one process on one machine may go without: it gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a cluster without one an error, as executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="veraline-")
            spark.sparkContext.setCheckpointDir(_own[app])
        found = _own[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/veraline/{uuid.uuid4().hex}-{label}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block; the caller's is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written_once(spark: SparkSession):
    """While a table is written: its shuffle files go when it's there, as nothing reads them again."""
    return setting(spark, _CLEANUP, "true")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the reread table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with written_once(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veraline_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_veraline_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"vl_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark) -> None:
    """Whole texts are long: fewer rows and bytes to an Arrow batch keep a worker's memory bounded.

    The settings are read when a plan runs, so they stay lowered for the session.
    """
    for key, default, most in (("maxRecordsPerBatch", "10000", 500), ("maxBytesPerBatch", "64m", 8 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name, default)).lower().removesuffix("b")
        if int(now.rstrip("kmg")) * 1024 ** " kmg".index(now[-1] if now[-1] in "kmg" else " ") > most:
            spark.conf.set(name, str(most))


def tidy(run):
    """The function of mapInArrow, after which its worker gives freed memory back: it stays, idle, beside the next stages."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            library = ctypes.CDLL(None)
            if hasattr(library, "malloc_trim"):
                library.malloc_trim(0)

    return out
