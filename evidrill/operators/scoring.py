"""Observed heat and evidence confidence of signals and topics. The two are never combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import CONFIDENCE_CAP, CONFIDENCE_WEIGHTS, HEAT_WEIGHTS

FACTS = (
    "views", "likes", "saves", "comments", "shares", "observed_content_count", "search_result_count", "search_rank",
    "growth_rate_percent", "current_window_count", "previous_window_count",
)


def with_dimensions(signals: DataFrame, as_of: Column) -> DataFrame:
    """Adds the five dimensions; as_of is the clock, given and never read from the machine."""
    facts = {k: S.measure(F.col(k)) for k in FACTS} | {"platform": F.col("platform"), "published_at": F.col("published_at")}
    return signals.withColumns(S.dimensions(facts, as_of))


def signal_index(signals: DataFrame, as_of: Column) -> DataFrame:
    """Per signal: observed_heat, evidence_confidence, data_coverage, score_status, source_quality, missing_fields."""
    d = with_dimensions(signals, as_of)
    dims = {k: F.col(k) for k in HEAT_WEIGHTS if k != "diffusion"}
    d = d.withColumn("data_coverage", S.coverage(dims)).withColumn("source_quality", S.source_quality(F.col("source_type")).cast("int"))
    return d.withColumns({
        "observed_heat": F.bround(S.weighted(dims, HEAT_WEIGHTS), 0).cast("int"),
        "evidence_confidence": F.bround(F.col("data_coverage") * 0.6 + F.col("source_quality") * 0.4, 0).cast("int"),
        "score_status": S.score_status(F.col("data_coverage")),
        "missing_fields": F.array_compact(F.array(*[F.when(c.isNull(), k) for k, c in dims.items()])),
    })


def topic_key() -> Column:
    """The topic, or for a signal without one a group of its own."""
    return F.when(F.col("topic_key") != "", F.col("topic_key")).otherwise(F.concat(F.col("query_layer"), F.lit(":"), F.when(F.col("query_term") != "", F.col("query_term")).otherwise(F.col("signal_id"))))


def topic_index(signals: DataFrame, as_of: Column, status: DataFrame | None = None, audits: DataFrame | None = None) -> DataFrame:
    """Per (snapshot, topic). status: snapshot_id, contract_status. audits: snapshot_id, topic, audit_status; if
    given, clustering was applied and a topic without a passed audit is capped. A single grouping; the authors are
    a distinct count beside plain aggregates."""
    d = with_dimensions(signals, as_of).withColumn("topic", topic_key())
    author = F.lower(F.when(~F.col("source_type").isin("platform_summary", "search_snippet") & (F.col("author_id") != ""), F.col("author_id")))
    direct = F.col("source_type").isin("direct_post", "exported_item")
    bridge = F.col("query_layer") == "subject_bridge"
    g = d.groupBy("snapshot_id", "topic").agg(
        F.count(F.lit(1)).alias("signal_count"),
        *[F.median(k).alias(k) for k in ("engagement", "velocity", "search_demand", "freshness")],
        F.count_distinct(author).alias("unique_author_count"),
        F.avg(S.source_quality(F.col("source_type")).cast("double")).alias("source_score"),
        F.count_if(F.col("evidence_role") == "counter").alias("counter_signal_count"),
        F.count_if(direct).alias("direct_source_count"),
        F.count_if(F.col("source_type") == "search_card").alias("search_card_count"),
        F.count_if(bridge).alias("subject_bridge_signal_count"),
        F.count_if(bridge & (F.col("semantic_relevance") == "direct") & (F.col("detail_captured") | direct)).alias("subject_bridge_direct_count"),
        F.count_if(F.col("semantic_relevance").isin("direct", "adjacent", "weak")).alias("reviewed_count"),
        F.min_by("title", "ordinal").alias("title"),
    )
    n = F.col("signal_count").cast("double")
    g = g.withColumns({
        "content_volume": S.log_score(n, 50),
        "diffusion": F.when(F.col("unique_author_count") > 0, F.least(F.lit(100.0), F.col("unique_author_count") / n * 100)),
    })
    dims = {k: F.col(k) for k in HEAT_WEIGHTS}
    g = g.withColumn("data_coverage", S.coverage(dims))
    confidence = {
        "sample_sufficiency": F.least(F.lit(100.0), n / 5 * 100),
        "author_diversity": F.least(F.lit(100.0), F.col("unique_author_count") / F.lit(3.0) * 100),
        "source_quality": F.col("source_score"),
        "field_coverage": F.col("data_coverage").cast("double"),
        "counterevidence": F.when(F.col("counter_signal_count") > 0, 100.0).otherwise(0.0),
    }
    g = g.withColumns({
        "observed_heat": F.bround(S.weighted(dims, HEAT_WEIGHTS), 0).cast("int"),
        "raw_confidence": F.bround(S.weighted(confidence, CONFIDENCE_WEIGHTS), 0).cast("int"),
        "score_status": S.score_status(F.col("data_coverage")),
        "review_coverage": F.bround(F.col("reviewed_count") / n, 3),
    })
    if status is not None:
        g = g.join(status.select("snapshot_id", "contract_status"), "snapshot_id", "left")
    else:
        g = g.withColumn("contract_status", F.lit("untracked"))
    cap = S.lookup(F.col("contract_status"), CONFIDENCE_CAP, 45)
    if audits is not None:
        g = g.join(audits.select("snapshot_id", "topic", "audit_status"), ["snapshot_id", "topic"], "left")
        cap = F.when(F.coalesce(F.col("audit_status") != "passed", F.lit(True)), F.least(cap, F.lit(54))).otherwise(cap)
    g = g.withColumn("confidence_cap", cap.cast("int"))
    return g.withColumn("evidence_confidence", F.least("raw_confidence", "confidence_cap"))


def ranked(topics: DataFrame) -> DataFrame:
    """Adds the topic's rank in its snapshot: confidence, heat, key."""
    order = Window.partitionBy("snapshot_id").orderBy(F.desc("evidence_confidence"), F.desc("observed_heat"), "topic")
    return topics.withColumn("topic_rank", F.row_number().over(order))
