"""An append-only ledger of query runs that takes each run once, for foreachBatch.

A ledger is a folder. A batch writes its runs, the keys that they and their signals are known by, and what they add to
each snapshot's counts, each to a folder of the batch's own, and last of all a commit record. Readers see committed
batches alone. A batch that broke off is written over when it is delivered again; one that was committed isn't
touched. Nothing that was written before is written again.

An append reads keys only, of the buckets that its own snapshots fall into: never runs or signals. Counts are sums of
what batches add, so they are never recomputed from the ledger.

A run is known by its query_id; where that is null or blank, by query_term and query_layer, which runs with an id hold as
well. Of two runs of a query in a batch the first by content stays. Nulls in keys are blanks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
RUN = ("snapshot_id", "query_id", "query_term", "query_layer")
COUNTS = ("query_count", "observed_result_count", "retained_sample_count", "unique_sample_count", "duplicate_count", "discarded_result_count", "detail_open_count", "counter_signal_count")
_KEYS = "bucket int, snapshot_id string, kind string, a string, b string"


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("snapshot_id"), F.lit(BUCKETS)).cast("int")


def committed(spark: SparkSession, ledger: str) -> list[int]:
    """Ids of the batches that are whole; a row for each batch."""
    try:
        return sorted(r.batch_id for r in spark.read.schema("batch_id bigint").json(f"{ledger}/commits/*").select("batch_id").distinct().collect())
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def _held(spark: SparkSession, ledger: str, what: str, schema: str, batches: list[int]) -> DataFrame:
    """What the given batches wrote."""
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{ledger}/{what}").parquet(*[f"{ledger}/{what}/batch_id={b}" for b in batches]).drop("batch_id")


def runs(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """The runs of all committed batches."""
    return _held(spark, ledger, "runs", schema, committed(spark, ledger))


def counts(spark: SparkSession, ledger: str) -> DataFrame:
    """Per snapshot: snapshot_id and COUNTS."""
    added = _held(spark, ledger, "counts", "snapshot_id string, " + ", ".join(f"{c} bigint" for c in COUNTS), committed(spark, ledger))
    return added.groupBy("snapshot_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])


def _keys(df: DataFrame, kind: str, a: Column, b: Column | None = None) -> DataFrame:
    return df.select(_bucket().alias("bucket"), "snapshot_id", F.lit(kind).alias("kind"), a.alias("a"), (F.lit("") if b is None else b).alias("b"))


def append(batch: DataFrame, signals: DataFrame | None, ledger: str, batch_id: int) -> bool:
    """Add a batch: runs (RUN, observed_result_count, detail_open_count and any other columns) and their signals (RUN,
    dedupe_key, evidence_role). False if the batch was already there."""
    spark = batch.sparkSession
    before = committed(spark, ledger)
    if batch_id in before:
        return False
    shape = {c: _text(c) for c in RUN}
    new = batch.withColumns(shape | {"_row": F.xxhash64(*batch.columns)})
    known = _held(spark, ledger, "keys", _KEYS, before)
    touched = [r.bucket for r in new.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS at most
    known = known.where(F.col("bucket").isin(touched))
    of = lambda kind, names: known.where(F.col("kind") == kind).select("snapshot_id", *[F.col(x).alias(n) for x, n in zip(("a", "b"), names, strict=False)])
    first = lambda d, by: d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_row"))).where("_n = 1").drop("_n")
    by_id, by_term = ["snapshot_id", "query_id"], ["snapshot_id", "query_term", "query_layer"]
    named = first(new.where("query_id <> ''"), by_id).join(of("id", ["query_id"]), by_id, "left_anti")
    plain = first(new.where("query_id = ''"), by_term).join(of("term", ["query_term", "query_layer"]), by_term, "left_anti").join(named.select(*by_term), by_term, "left_anti")
    taken = named.unionByName(plain).drop("_row")
    place = lambda what: f"{ledger}/{what}/batch_id={batch_id}"
    taken.write.mode("overwrite").parquet(place("runs"))
    taken = spark.read.schema(taken.schema).parquet(place("runs"))  # what follows goes by what was written
    keys = [_keys(taken.where("query_id <> ''"), "id", F.col("query_id")), _keys(taken, "term", F.col("query_term"), F.col("query_layer"))]
    totals = taken.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum(F.coalesce("observed_result_count", F.lit(0))).alias("observed_result_count"), F.sum(F.coalesce("detail_open_count", F.lit(0))).alias("detail_open_count"),
    )
    if signals is not None:
        s = signals.withColumns(shape).join(taken.select(*RUN), list(RUN), "left_semi")
        each = s.groupBy("snapshot_id", F.col("dedupe_key").alias("key")).agg(F.bool_or(F.coalesce(F.col("evidence_role") == "counter", F.lit(False))).alias("is_counter"))
        for kind in ("signal", "counter"):
            each = each.join(of(kind, ["key"]).withColumn(f"known_{kind}", F.lit(1)), ["snapshot_id", "key"], "left")
        fresh, first_counter = F.col("known_signal").isNull(), F.col("known_counter").isNull() & F.col("is_counter")
        each.where(fresh | first_counter).select("snapshot_id", "key", fresh.alias("fresh"), first_counter.alias("counter")).write.mode("overwrite").parquet(place("signals"))
        added = spark.read.parquet(place("signals"))
        keys += [_keys(added.where("fresh"), "signal", F.col("key")), _keys(added.where("counter"), "counter", F.col("key"))]
        kept = s.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("retained_sample_count"))
        unique = added.groupBy("snapshot_id").agg(F.count_if("fresh").alias("unique_sample_count"), F.count_if("counter").alias("counter_signal_count"))
        totals = totals.join(kept, "snapshot_id", "left").join(unique, "snapshot_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in totals.columns else F.lit(0)
    derived = {
        "discarded_result_count": F.col("observed_result_count") - zero("retained_sample_count"), "duplicate_count": zero("retained_sample_count") - zero("unique_sample_count"),
        "retained_sample_count": zero("retained_sample_count"), "unique_sample_count": zero("unique_sample_count"), "counter_signal_count": zero("counter_signal_count"),
    }
    totals.select("snapshot_id", *[derived.get(c, F.col(c)).cast("bigint").alias(c) for c in COUNTS]).write.mode("overwrite").parquet(place("counts"))
    reduce(DataFrame.unionByName, keys).write.mode("overwrite").partitionBy("bucket").parquet(place("keys"))
    spark.createDataFrame([(batch_id,)], "batch_id bigint").coalesce(1).write.mode("overwrite").json(f"{ledger}/commits/{batch_id}")
    return True


def append_runs(batch: DataFrame, ledger: str) -> None:
    """For foreachBatch: add to the ledger table (a Parquet folder, by snapshot) the runs that aren't in it yet. A run
    is known by its query_id; where that is null or blank, by query_term and query_layer (if the batch has them), which
    runs with an id hold as well. A batch that is delivered again adds nothing; of two runs of a query one of the batch
    stays; nulls in keys are blanks. Only the partitions between the batch's first and last snapshot are read. `append`
    reads no runs, and keeps counts."""
    spark = batch.sparkSession
    texts = [c for c in ("query_id", "query_term", "query_layer") if dict(batch.dtypes).get(c) == "string"]
    batch = batch.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
    blank = F.trim(F.coalesce(F.col("query_id").cast("string"), F.lit(""))) == ""
    by_id, by_term = ["snapshot_id", "query_id"], ["snapshot_id", "query_term", "query_layer"]
    new = batch.where(~blank).dropDuplicates(by_id)
    unnamed = batch.where(blank).dropDuplicates(by_term if set(by_term) <= set(batch.columns) else by_id)
    try:
        low, high = batch.agg(F.min("snapshot_id"), F.max("snapshot_id")).first()
        held = spark.read.schema(batch.schema).parquet(ledger).where(F.col("snapshot_id").between(F.lit(low), F.lit(high)))
        new = new.join(held.select(*by_id), by_id, "left_anti")
    except Exception as e:  # no ledger so far
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = batch.limit(0)
    if set(by_term) <= set(batch.columns):
        known = held.select(*by_term).unionByName(new.select(*by_term))
        unnamed = unnamed.join(known, by_term, "left_anti")
    else:
        unnamed = unnamed.join(held.where(blank).select("snapshot_id"), "snapshot_id", "left_anti")
    new.unionByName(unnamed.select(*new.columns)).write.mode("append").partitionBy("snapshot_id").parquet(ledger)
