"""Tables written once on the way, so that what is costly to work out isn't worked out again by each of its readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def folder(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors see, spark.checkpoint.dir. Where that
    is unset, a local master gets a temporary folder; a cluster has to set it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/staged-{sc.applicationId}"
    if not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="staged-"))
    return "file://" + _own_folder[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
