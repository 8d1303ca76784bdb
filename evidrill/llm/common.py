"""Pieces that the corpus operators share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java pattern: what separates words.
SPACE = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []
_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors see, spark.checkpoint.dir. Where that
    is unset, a local master (a single machine, tests) gets a temporary folder; a cluster has to set it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return f"{folder.rstrip('/')}/evidrill-{sc.applicationId}"
    if not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="evidrill-"))
    return "file://" + _own_folder[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch[-1] if _scratch else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and a lost executor costs nothing."""
    return stored(df, shared_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written under a path that nothing reads any more."""
    if path.startswith("file://") and (spark.sparkContext.master or "").startswith("local"):
        shutil.rmtree(path[len("file://") :], ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What is materialized inside goes when the block ends; the block writes elsewhere what is to stay."""
    path = shared_path(spark, name)
    _scratch.append(path)
    try:
        yield
    finally:
        _scratch.remove(path)
        discard(spark, path)


@contextmanager
def records_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside hands n rows at a time to Python, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words of a text (null: none): runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*cols: Column) -> Column:
    """A 64-bit key of a row's content, never null. Repeated rows share it; a null differs from any value and from a
    null elsewhere. Joins by it compare the rows' ids as well."""
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a session, for functions that run in their Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_evidrill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="evidrill-code-")) / "evidrill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._evidrill_shipped = True
