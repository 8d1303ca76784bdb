"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words. Whole epochs of the source come first; the rest is filled from a
weighted order without replacement: document i gets the exponential key -ln(u_i) / q_i, where u_i is a hash of
the document and q_i its quality weight, and documents are taken in the order of their keys until the budget
of words is used up (the last one where that comes nearer to the budget).

The prefix sums never put a source into one task: keys fall into `buckets` ranges, words are summed by source
and range, and only the one range of each source in which its budget ends is sorted.

Defined cases: a null or empty text has size 0; a null source is a source of its own, after all others;
ties of the key go by the id and the row's content, so repeated rows, which are separate documents, are the only ones
that are interchangeable; a very long text is taken whole or not at all; an empty table gives an empty result; other
columns are ignored by `mix` and carried by `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, spare

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000


def quality_weight(text: Column) -> Column:
    """From 0.5 to 1.5: higher for texts of which more characters are letters or spaces."""
    n = F.length(text)
    plain = n - F.length(F.regexp_replace(text, r"[\p{L}\x20]+", ""))
    return F.lit(0.5) + F.when(n > 0, plain / n).otherwise(F.lit(0.0))


def uniform(*cols: Column, seed: str) -> Column:
    """A number in (0, 1) from an md5 of the columns, the same in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, max_epochs: int) -> DataFrame:
    """sizes: source, source_size. Targets share `factor` times all words by the weights, dealt in turn to the
    sources in order; none is above max_epochs times its size, and what that cuts off is shared among the others."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(one) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "i")
    before, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(everything) * float(factor) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(on),
    )
    # the sources below the level are capped; the level is that of the first which isn't
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, max_epochs: int = 2, seed: str = "mix",
        buckets: int = 4096, quality: Column | None = None) -> DataFrame:
    """Per document: row_key, doc_id, source, size, source_size, target, epochs, selected, taken."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(
        row_key(F.col(id_col), F.col(source), F.col(text)).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("size"),
        uniform(F.col(id_col), F.col(source), seed=seed).alias("u"),
        (quality_weight(t) if quality is None else quality).alias("q"),
    )
    d = materialize(
        d.withColumn("key", -F.log("u") / F.col("q")).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets)),
        "mix-documents",
    )
    by_bucket = materialize(d.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    plan = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, factor, max_epochs)
    plan = plan.withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("bigint"),
    ).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    # the range of each source in which its budget ends
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_bucket.withColumn("reached", F.sum("words").over(up_to)).alias("b").join(
        plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))
    )
    cut = (
        ends.groupBy(F.col("p.source").alias("source"), "source_size", "target", "epochs", "budget")
        .agg(F.min(F.when(F.col("reached") >= F.col("budget"), F.struct("bucket", (F.col("reached") - F.col("words")).alias("before")))).alias("cut"))
        .select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "budget", F.col("cut.bucket").alias("cut"), F.col("cut.before").alias("before"))
    )
    cut = materialize(cut, "mix-plan")
    if cut.count() <= BROADCAST_ROWS:
        cut = F.broadcast(cut)
    d = d.join(cut, d.source.eqNullSafe(cut.p_source))
    sorted_range = Window.partitionBy("source").orderBy("key", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = d.where(F.col("bucket") == F.col("cut")).withColumn(
        "selected",
        F.col("before") + F.coalesce(F.sum("size").over(sorted_range), F.lit(0)) + F.col("size") / 2 < F.col("budget"),
    )
    outside = d.where(~F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))).withColumn(
        "selected", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)) & (F.col("budget") > 0)
    )
    return inside.unionByName(outside).select(
        "row_key", "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "epochs", "selected",
        ((F.col("epochs") + F.col("selected").cast("bigint")) * F.col("size")).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it."""
    found = mix(docs, id_col, source, text, **options)
    times = found.groupBy("row_key", "doc_id").agg(F.sum(F.col("epochs") + F.col("selected").cast("bigint")).cast("int").alias("times"), F.count(F.lit(1)).alias("rows"))
    times = materialize(times, "mix-times")
    repeated = times.where("rows > 1").limit(1).count() > 0
    key = spare(docs, "row_key")
    rows = docs.withColumn(key, row_key(F.col(id_col), F.col(source), F.col(text)))
    if repeated:  # their times were added up
        rows = rows.dropDuplicates([id_col, source, text])
    chosen_key, chosen_id, n = (spare(rows, x) for x in ("chosen_key", "chosen_id", "times"))
    chosen = times.where("times > 0").select(F.col("row_key").alias(chosen_key), F.col("doc_id").alias(chosen_id), F.col("times").alias(n))
    if chosen.count() <= BROADCAST_ROWS * 10:  # 24 bytes each
        chosen = F.broadcast(chosen)
    rows = rows.join(chosen, (rows[key] == chosen[chosen_key]) & rows[id_col].eqNullSafe(chosen[chosen_id]))
    return rows.withColumn(spare(rows, "copy"), F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
