"""Quality rules: statistics of single documents and line frequency across the documents of a host.

Each line is normalised (lower case, single spaces) and hashed. A line is boilerplate on a host if more than
`max_docs` distinct documents of that host hold it; boilerplate lines are removed, and a document that keeps less
than `min_kept_share` of its words is rejected as depleted.

Documents of the same set of normalised lines are one distinct document. So whole copies don't turn their own text
into boilerplate: finding copies is the work of the near-duplicate operators, and a clean text isn't rejected for
having been copied.

Defined cases: a null text is an empty one (no words: it fails the base rule); a null host is a host of its
own; repeated rows count as one document and get the same verdict; a very long text is measured whole; an empty table
gives an empty result; other columns of the input are carried by `clean`, whatever their names, and ignored by `score`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, row_key, spare, words


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_docs: int = 10
    min_kept_share: float = 0.3


def _key(id_col: str, host: str, text: str) -> Column:
    return row_key(F.col(id_col), F.col(host), F.col(text))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def statistics(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text",
               limits: Limits = Limits()) -> DataFrame:
    """One row per document: counts, plus the hashes and word counts of its lines."""
    w = limits.window
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host).alias("host"), _key(id_col, host, text).alias("row_key"), t.alias("t"),
    )
    d = d.withColumn("words", words(F.col("t"))).withColumn(
        "lines", F.filter(F.split("t", "\n"), _has_word)
    )
    n = F.size("words")
    # a hash for each window of `w` words, from the words' hashes; most texts repeat none, and the set shows that
    # cheaply
    d = d.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x))).withColumn(
        "win",
        F.when(
            n >= w,
            F.transform(F.slice("hashes", F.lit(1), n - (w - 1)), lambda x, i: F.xxhash64(F.slice("hashes", i + 1, w))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("win")) < F.size("win"),
            F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    d = d.withColumn(
        "at",
        F.when(
            F.col("sorted").isNotNull(),
            F.array_sort(
                F.transform(
                    F.filter(
                        "sorted",
                        lambda x, i: (F.coalesce(F.get("sorted", i - 1)["h"] == x["h"], F.lit(False)))
                        | (F.coalesce(F.get("sorted", i + 1)["h"] == x["h"], F.lit(False))),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    # windows that start at sorted places cover min(w, distance to the next start) words each
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(w), F.coalesce(F.get("at", i + 1) - p, F.lit(w)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return d.select(
        "doc_id", "host", "row_key",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.xxhash64(_normal(x))).alias("line_hash"),
        F.transform("lines", lambda x: F.size(words(x))).alias("line_words"),
    )


def _share(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Words of each document in frequent lines, with the hashes of those lines."""
    return (
        lines.join(frequent, [lines.host.eqNullSafe(frequent.f_host), lines.h == frequent.f_h], "left_semi")
        .groupBy("row_key")
        .agg(F.sum("w").alias("n_frequent"))
    )


def _frequent(lines: DataFrame, max_docs: int) -> DataFrame:
    return (
        lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)
        .select(F.col("host").alias("f_host"), F.col("h").alias("f_h"))
    )


def score(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text",
          limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Verdicts, one row per document, and the boilerplate lines as (host, line hash)."""
    stats = materialize(statistics(docs, id_col, host, text, limits), "quality-statistics")
    # one row for each distinct line of each distinct document; documents of the same set of lines share the content
    content = F.xxhash64(F.array_sort(F.array_distinct("line_hash")))
    lines = (
        stats.select("row_key", "host", content.alias("content"), F.explode(F.arrays_zip("line_hash", "line_words")).alias("z"))
        .groupBy("row_key", "host", "content", F.col("z.line_hash").alias("h"))
        .agg(F.max("z.line_words").alias("per_line"), F.count(F.lit(1)).alias("times"))
        .select("row_key", "host", "content", "h", (F.col("per_line") * F.col("times")).alias("w"))
    )
    lines = materialize(lines, "quality-lines")
    boilerplate = materialize(_frequent(lines.select("host", "h", "content").distinct(), limits.max_docs), "quality-boilerplate")
    # the lines of repeated rows were summed up; each row has its own part
    rows = stats.groupBy("row_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    removed = _share(lines, boilerplate).join(rows, "row_key", "left").select(
        "row_key", F.expr("n_frequent DIV coalesce(rows, 1)").alias("n_removed_words")
    )
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )
    verdict = stats.drop("line_hash", "line_words").join(removed, "row_key", "left").select(
        "row_key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("n_removed_words", F.lit(0)).cast("bigint").alias("n_removed_words"),
    )
    left = F.col("n_words") - F.col("n_removed_words")
    verdict = verdict.withColumn("depleted", left < limits.min_kept_share * F.col("n_words")).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("depleted")
    )
    return verdict, boilerplate


def clean(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text",
          limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, all columns, with boilerplate lines removed from their texts."""
    verdict, boilerplate = score(docs, id_col, host, text, limits)
    verdict = materialize(verdict, "quality-verdict")
    marked = verdict.where(F.col("kept") & (F.col("n_removed_words") > 0)).select("row_key").distinct()
    lines = F.filter(F.split(F.col(text), "\n"), _has_word)
    hit = (
        docs.select(_key(id_col, host, text).alias("row_key"), F.col(host).alias("host"), F.col(text)).join(marked, "row_key", "left_semi")
        .select("row_key", "host", F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(_normal(x))))).alias("h"))
        .distinct()
    )
    hit = (
        hit.join(boilerplate, [hit.host.eqNullSafe(boilerplate.f_host), hit.h == boilerplate.f_h], "left_semi")
        .groupBy("row_key").agg(F.collect_set("h").alias("lines"))
    )
    key = spare(docs, "row_key")
    out = docs.withColumn(key, _key(id_col, host, text))
    kept_key, kept_id, drop = (spare(out, x) for x in ("kept_key", "kept_id", "drop"))
    kept = verdict.where("kept").select("row_key", "doc_id").distinct().join(hit, "row_key", "left").select(
        F.col("row_key").alias(kept_key), F.col("doc_id").alias(kept_id), F.col("lines").alias(drop)
    )
    rest = F.array_join(
        F.filter(F.split(F.col(text), "\n"), lambda x: ~(_has_word(x) & F.array_contains(drop, F.xxhash64(_normal(x))))), "\n"
    )
    out = out.join(kept, (out[key] == kept[kept_key]) & out[id_col].eqNullSafe(kept[kept_id]), "inner")
    out = out.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
