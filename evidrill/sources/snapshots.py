"""Reading snapshots as they are exported, JSON or CSV, and writing results.

A raw signal is a map from field names to texts, nested values as JSON. That takes any of the spellings that
exports use, and no schema has to be inferred from the data."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "snapshot_id string, ordinal bigint, raw map<string,string>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file: a list of signals, or an object with `signals` or else `items`. Entries that
    aren't objects stay as rows with a null map: they count as retained."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("snapshot_id"), F.regexp_replace("value", "^﻿", "").alias("doc"))
    lists = [F.from_json("doc", "array<string>")] + [F.from_json(F.get_json_object("doc", f"$.{k}"), "array<string>") for k in ("signals", "items")]
    found = F.when(F.ltrim("doc").startswith("["), lists[0]).otherwise(F.coalesce(*lists[1:]))
    return doc.select("snapshot_id", F.posexplode(found).alias("ordinal", "one")).select(
        "snapshot_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.when(F.ltrim("one").startswith("{"), F.from_json("one", "map<string,string>")).alias("raw")
    )


def _csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    table = spark.read.csv(paths, header=True, inferSchema=False, multiLine=True, escape='"')
    names = [c.removeprefix("\ufeff").removeprefix("ï»¿") for c in table.columns]
    table = table.toDF(*[f"c{i}" for i in range(len(names))])
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"c{i}"))]
    return table.select(F.col("_metadata.file_path").alias("snapshot_id"), F.monotonically_increasing_id().alias("ordinal"), F.create_map(*pairs).alias("raw"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every value a text; a mark of the byte order before the first name is dropped. Each file is
    read under its own header: files of one header are one scan, so exports of other columns or orders cost one more
    each. Files without a line give no rows."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "[\ufeff\r]", "").alias("line"))
    heads = lines.groupBy("file").agg(F.min_by("line", "at").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()  # no more than Spark lists itself
    if len(groups) < 2:
        return _csv(spark, path)
    parts = [_csv(spark, [unquote(f) for f in sorted(g["files"])]) for g in groups]
    return reduce(DataFrame.unionByName, parts)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Spark's commit makes the result appear as a whole."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).format(form).save(path)
