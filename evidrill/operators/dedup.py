"""Identity, ordered merging of duplicate signals, and snapshot merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.constants import RELEVANCE_RANK


def identity(platform: Column, content_id: Column, url: Column, author: Column, published: Column, text: Column) -> Column:
    """A source's stable identity: its content id, else its address, else author, time and the text's beginning."""
    at = S.canonical_url(url)
    own = F.when(S.text(content_id) != "", F.concat_ws("|", F.lit("content_id"), S.text(content_id))).when(
        at != "", F.concat_ws("|", F.lit("url"), at)
    ).otherwise(F.concat_ws("|", F.lit("fallback"), S.text(author), S.text(published), F.substring(S.text(text), 1, 500)))
    return F.concat_ws("|", S.platform(platform), own)


def dedupe_key(*columns: Column) -> Column:
    return F.sha2(identity(*columns), 256)


_STALE = ("search_card_only", "Search card only", "Semantic relevance requires a separate review.")
_FILLED = ("title", "summary", "published_text")
_METRICS = ("views", "likes", "saves", "comments", "shares")
_REVIEWED = ("evidence_role", "topic_key")


def ordered_union(rows: DataFrame, key: list[str], order: list[str], arrays: list[str]) -> DataFrame:
    """Per key, for each array column its different elements over all rows, in the order in which they are first seen.
    Rows of a key that say the same are one, with the least place, before the shuffle; a key's task then holds its different
    rows. Null arrays are empty; keys without any element have no row."""
    names = [f"_a{i}" for i in range(len(arrays))]
    whole = [_whole(F.col(c)).alias(n) for c, n in zip(arrays, names)]
    each = rows.select(*key, F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).alias("_row"), *whole).where(" OR ".join(f"size({n}) > 0" for n in names))
    least = each.groupBy(*key, *names).agg(F.min("_row").alias("_row"))
    g = least.groupBy(*key).agg(F.collect_list(F.struct("_row", *names)).alias("_rows"))
    return g.select(*key, *[_union(n).alias(c) for n, c in zip(names, arrays)])


def _whole(c: Column) -> Column:
    return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))


def _union(name: str) -> Column:
    """The different elements of an array over collected `_rows`, by the places `_row` of these."""
    placed = F.flatten(F.transform("_rows", lambda r: F.transform(r[name], lambda x, i: F.struct(r["_row"], i, x.alias("x")))))
    seen = F.when(F.size("_rows") == 1, F.get("_rows", F.lit(0))[name]).otherwise(F.sort_array(placed)["x"])
    return F.array_distinct(seen)


#: A key with more rows than this is combined before it is shuffled; any other is cheaper to group as it is.
FEW_ROWS = 64
#: Rows of keys with few of them that a task groups.
ROWS_PER_TASK = 1 << 18
#: So many hashes of keys are broadcast, more are joined.
MOST_BROADCAST = 100_000


def merge_duplicates(signals: DataFrame) -> DataFrame:
    """Merge the observations of each (snapshot_id, dedupe_key) as if one after the other in input order.

    At each step the one with details, then the better source type, then the longer summary is primary (the earlier on
    a tie); its blank fields are filled from the other, arrays are joined in first-seen order, details are OR-ed and the
    higher relevance stays. Needs the columns snapshot_id, dedupe_key, ordinal, signal_id, source_type, detail_captured,
    title, summary, published_text, semantic_relevance, reviewed, evidence_role, topic_key, query_term, query_layer,
    evidence_refs, limitations and the five metrics.

    Nearly all of it is a plain aggregate: a field that no primary fills is the first one that isn't blank; arrays are
    ordered unions; relevance is the earliest of the highest; a reviewed role is the first reviewed row's or else the
    first there is. Which rows become primary, one after the other, isn't one, as a filled summary counts with its length,
    so that steps go over the rows of a key.

    Rows are counted by a hash of their key first. Those of keys with few rows are shuffled once, as they are. The others
    are combined before the shuffle: of all rows alike in details, quality and length of the summary only the earliest can
    become primary, so that steps go over one row for each such level, and however often a post was observed, there are
    at most 18 for each length that a summary has."""
    key = ["dedupe_key", "snapshot_id"]  # rows are sorted by the beginning of the first, and all keys of a snapshot share its own
    fields = [*_FILLED, *_METRICS]
    place = ["ordinal", "signal_id"]
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    held = {f: ~blank(F.col(f)) for f in _FILLED} | {f: F.col(f).isNotNull() for f in _METRICS}
    first = lambda c, value: F.min(F.when(c, F.struct(*place, value)))
    d = signals.withColumns({m: F.col(m).cast("double") for m in _METRICS} | {
        "detail": F.coalesce("detail_captured", F.lit(False)).cast("int"), "quality": S.source_quality(F.col("source_type")).cast("int"), "length": F.length(F.coalesce("summary", F.lit(""))),
        "rank": S.lookup(F.col("semantic_relevance"), RELEVANCE_RANK, 0), "reviewed": F.coalesce("reviewed", F.lit(False)),
    })
    firsts = {f"_{f}": first(c, F.col(f)) for f, c in held.items()} | {f"_{f}": first(~blank(F.col(f)), F.col(f)) for f in _REVIEWED}
    firsts["_relevance"] = F.min(F.struct((-F.col("rank")).alias("rank"), *place, "semantic_relevance"))
    firsts["_review"] = first(F.col("reviewed"), F.struct(*_REVIEWED).alias("labels"))
    one = lambda c: F.when(F.col(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    arrays = {"query_terms": one("query_term"), "query_layers": one("query_layer"), "evidence_refs": F.col("evidence_refs"), "limitations": F.col("limitations")}
    names = ("ordinal", "signal_id", "detail", "quality", "length", "source_type", *fields)

    def grouped(d: DataFrame, level: Column, n: Column, firsts: dict[str, Column], *more: Column) -> DataFrame:
        return d.groupBy(*key).agg(F.sort_array(F.collect_list(level)).alias("levels"), F.max("detail").alias("detail"), F.sum(n).cast("int").alias("merged_from_count"), *[v.alias(k) for k, v in firsts.items()], *more)

    def as_they_are(d: DataFrame, rows: int) -> DataFrame:
        parts = max(-(-rows // ROWS_PER_TASK), int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        collected = F.collect_list(F.struct(F.struct(*place).alias("_row"), *[_whole(v).alias(k) for k, v in arrays.items()])).alias("_rows")
        g = grouped(d.repartition(parts, *key), F.struct(*names), F.lit(1), firsts, collected)
        return g.withColumns({c: _union(c) for c in arrays}).drop("_rows")

    def combined(d: DataFrame) -> DataFrame:
        levels = d.groupBy(*key, "detail", "quality", "length").agg(F.min(F.struct(*place, "source_type", *fields)).alias("row"), F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in firsts.items()])
        level = F.struct(*[F.col(c if c in ("detail", "quality", "length") else f"row.{c}").alias(c) for c in names])
        g = grouped(levels, level, F.col("n"), {k: F.min(k) for k in firsts})
        unions = ordered_union(d.select(*key, *place, *[v.alias(k) for k, v in arrays.items()]), key, place, list(arrays))
        return g.join(unions, key, "left").withColumns({c: _whole(F.col(c)) for c in arrays})

    counts = d.groupBy(F.xxhash64(*key).alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    rows, often = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > FEW_ROWS)).first()
    if often:
        hot = counts.where(F.col("n") > FEW_ROWS).select("_h")
        hot = F.broadcast(hot) if often <= MOST_BROADCAST else hot
        d = d.withColumn("_h", F.xxhash64(*key))
        g = as_they_are(d.join(hot, "_h", "left_anti"), rows).unionByName(combined(d.join(hot, "_h", "left_semi")))
    else:
        g = as_they_are(d, rows)
    # the state's type must not change from step to step: all of it may be null
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in g.schema["levels"].dataType.elementType])

    def step(s: Column, x: Column) -> Column:
        names = ("detail", "quality", "length")
        better = F.struct(*[x[c] for c in names]) > F.struct(*[s[c] for c in names])
        taken = {c: x[c] for c in ("ordinal", "signal_id", "detail", "quality", "source_type")} | {"length": F.when(x["length"] > 0, x["length"]).otherwise(s["length"])}
        taken |= {f: F.when(~blank(x[f]), x[f]).otherwise(s[f]) for f in _FILLED} | {f: F.coalesce(x[f], s[f]) for f in _METRICS}
        # what isn't primary fills a blank summary, whose length counts from then on
        kept = {c: s[c] for c in taken} | {"length": F.when(s["length"] > 0, s["length"]).otherwise(x["length"])}
        return F.when(better, F.struct(*[taken[f.name].alias(f.name) for f in kind]).cast(kind)).otherwise(F.struct(*[kept[f.name].alias(f.name) for f in kind]).cast(kind))

    one = F.get("levels", F.lit(0)).cast(kind)
    folded = F.when(F.size("levels") == 1, one).otherwise(F.aggregate(F.slice("levels", 2, 2_000_000_000), one, step))
    m = g.withColumn("s", folded).withColumn("detail_captured", F.col("detail") == 1)
    filled = [F.when(~blank(F.col(f"s.{f}")), F.col(f"s.{f}")).otherwise(F.coalesce(F.col(f"_{f}.{f}"), F.col(f"s.{f}"))).alias(f) for f in _FILLED]
    labels = [F.when(~blank(F.col(f"_review.labels.{f}")), F.col(f"_review.labels.{f}")).otherwise(F.coalesce(F.col(f"_{f}.{f}"), F.lit(""))).alias(f) for f in _REVIEWED]
    m = m.select(
        *key, F.get("levels", F.lit(0))["ordinal"].alias("ordinal"), "s.signal_id", "s.source_type", "detail_captured", *filled, F.col("_relevance.semantic_relevance").alias("semantic_relevance"),
        F.col("_review").isNotNull().alias("reviewed"), *labels, *[F.coalesce(F.col(f"s.{f}"), F.col(f"_{f}.{f}")).alias(f) for f in _METRICS], "merged_from_count", *arrays,
    )
    stale = F.col("detail_captured") & (F.col("merged_from_count") > 1)
    return m.withColumn("limitations", F.when(stale, F.filter("limitations", lambda x: ~F.trim(x).isin(*_STALE))).otherwise(F.col("limitations")))


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: What a detailed observation gives a signal that was first seen without details.
DETAIL_FIELDS = ("source_type", "detail_captured", "title", "summary", "published_at", "metrics", "author", "platform_facts", "limitations")


def merge_snapshots(rows: DataFrame, detail_fields: list[str], arrays: list[str] = ()) -> DataFrame:
    """Merge snapshots of one subject. rows: subject, signal_id, ordinal (the place of the row among all snapshots),
    detail_captured, query_layer, query_term, the listed fields (usually DETAIL_FIELDS) and arrays. Per signal_id the first
    row stays, and if it has no detail the first detailed row gives the listed fields. Adds the number of rows, the
    sorted layers and terms, and the different elements of each array in first-seen order. All of it is combined before
    the shuffle."""
    key = ["subject", "signal_id"]
    detailed = F.coalesce("detail_captured", F.lit(False))
    row = F.struct("ordinal", detailed.alias("detailed"), F.struct(*detail_fields).alias("f"))
    m = rows.groupBy(*key).agg(
        F.min_by(row, "ordinal").alias("a"), F.min_by(F.when(detailed, row), F.when(detailed, F.col("ordinal"))).alias("b"), F.count(F.lit(1)).alias("merged_rows"),
        F.array_sort(F.collect_set("query_layer")).alias("query_layers"), F.array_sort(F.collect_set("query_term")).alias("query_terms"),
    )
    fill = F.col("b").isNotNull() & ~F.col("a.detailed")
    taken = [F.when(fill, F.col(f"b.f.{c}")).otherwise(F.col(f"a.f.{c}")).alias(c) for c in detail_fields if c != "detail_captured"]
    m = m.select(*key, *taken, F.col("b").isNotNull().alias("detail_captured"), "merged_rows", "query_layers", "query_terms")
    if not arrays:
        return m
    found = ordered_union(rows, key, ["ordinal"], list(arrays))
    return m.join(found, key, "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in arrays})


def jaccard(a: Column, b: Column) -> Column:
    """How far two result lists agree; null unless both are there."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
