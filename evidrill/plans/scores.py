"""Queries over signal and topic scores, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ENGAGEMENT_WEIGHTS, SOURCE_QUALITY
from ..operators import scoring
from ..sources import views


def as_of() -> Column:
    return F.lit(views.AS_OF).cast("timestamp")


def _case(key: str, values: dict, default) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _log(value: str, ceiling: int) -> str:
    return f"greatest(0e0, least(1e2, ln(1 + greatest({value}, 0e0)) / ln(1e0 + {ceiling}) * 100))"


_PARTS = {k: f"({k} * {_case('platform', {p: f'{w[k]}e0' for p, w in ENGAGEMENT_WEIGHTS.items()}, '1e0')})" for k in ("likes", "saves", "comments", "shares")}
_TOTAL = "(" + " + ".join(f"coalesce({x}, 0e0)" for x in _PARTS.values()) + ")"
_SOME = "coalesce(likes, saves, comments, shares) IS NOT NULL"

#: Signals with their dimensions, for the statements below.
DIMENSIONS_SQL = f"""
signals AS ({views.as_sql(views.SIGNALS)}),
rated AS (SELECT *, coalesce(growth_rate_percent, (current_window_count - previous_window_count) / greatest(previous_window_count, 1e0) * 100) AS rate,
  greatest(0e0, (epoch_us(TIMESTAMP '{views.AS_OF}') - epoch_us(published_at)) / 864e8) AS days FROM signals),
dims AS (SELECT *,
  CASE WHEN observed_content_count IS NOT NULL THEN {_log("observed_content_count", 1000)} END AS content_volume,
  CASE WHEN views IS NOT NULL AND {_SOME} THEN least(1e2, {_TOTAL} / greatest(views, 1e0) * 1000)
    WHEN views IS NOT NULL OR {_SOME} THEN {_log(f"CASE WHEN {_TOTAL} > 0 THEN {_TOTAL} ELSE coalesce(views, 0e0) END", 100000)} END AS engagement,
  CASE WHEN rate IS NOT NULL THEN greatest(0e0, least(1e2, 50 + rate / 2)) END AS velocity,
  CASE WHEN search_result_count IS NOT NULL THEN {_log("search_result_count", 10000)}
    WHEN search_rank IS NOT NULL THEN greatest(0e0, least(1e2, 105 - search_rank)) END AS search_demand,
  CASE WHEN days <= 1 THEN 1e2 WHEN days <= 7 THEN 8e1 WHEN days <= 30 THEN 55e0 WHEN days <= 90 THEN 3e1 ELSE 1e1 END AS freshness,
  {_case("source_type", SOURCE_QUALITY, 20)} AS quality FROM rated)
"""


def _heat(names: dict[str, int]) -> str:
    return " + ".join(f"coalesce({k} * {w / 100}e0, 0e0)" for k, w in names.items())


def _coverage(names: dict[str, int]) -> str:
    return " + ".join(f"(CASE WHEN {k} IS NULL THEN 0 ELSE {w} END)" for k, w in names.items())


_FIVE = {"content_volume": 20, "engagement": 25, "velocity": 25, "search_demand": 10, "freshness": 5}
_SIX = {"content_volume": 20, "engagement": 25, "velocity": 25, "diffusion": 15, "search_demand": 10, "freshness": 5}
_STATUS = "CASE WHEN data_coverage >= 75 THEN 'complete' WHEN data_coverage >= 40 THEN 'partial' ELSE 'sparse' END"


def signal_evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.signal_index(views.signals(spark, sf_dir), as_of())
    return d.select(
        "snapshot_id", "signal_id", "observed_heat", "evidence_confidence", "data_coverage", "score_status", "source_quality",
        F.array_join("missing_fields", ",").alias("missing_fields"),
    )


def topic_evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: topics of every snapshot, ranked by evidence."""
    t = scoring.ranked(scoring.topic_index(views.signals(spark, sf_dir), as_of()))
    return t.select(
        "snapshot_id", "topic", "signal_count", "observed_heat", "raw_confidence", "confidence_cap", "evidence_confidence", "data_coverage", "score_status",
        "unique_author_count", "direct_source_count", "search_card_count", "counter_signal_count", "subject_bridge_signal_count",
        "subject_bridge_direct_count", F.bround("review_coverage", 3).alias("review_coverage"), "title", "topic_rank",
    )


QUERIES = {"topic_evidence_rank": topic_evidence_rank, "signal_evidence_index": signal_evidence_index}

_TOPIC = "CASE WHEN topic_key <> '' THEN topic_key ELSE query_layer || ':' || query_term END"
_DIRECT = "source_type IN ('direct_post', 'exported_item')"

#: Topics before caps, for the statements here and elsewhere.
TOPICS_SQL = f"""{DIMENSIONS_SQL},
grouped AS (SELECT snapshot_id, {_TOPIC} AS topic, count(*) AS signal_count, median(engagement) AS engagement, median(velocity) AS velocity,
    median(search_demand) AS search_demand, median(freshness) AS freshness,
    count(DISTINCT CASE WHEN source_type NOT IN ('platform_summary', 'search_snippet') AND author_id <> '' THEN lower(author_id) END) AS unique_author_count,
    avg(quality) AS source_score, count(*) FILTER (evidence_role = 'counter') AS counter_signal_count, count(*) FILTER ({_DIRECT}) AS direct_source_count,
    count(*) FILTER (source_type = 'search_card') AS search_card_count, count(*) FILTER (query_layer = 'subject_bridge') AS subject_bridge_signal_count,
    count(*) FILTER (query_layer = 'subject_bridge' AND semantic_relevance = 'direct' AND (detail_captured OR {_DIRECT})) AS subject_bridge_direct_count,
    count(*) FILTER (semantic_relevance <> 'unreviewed') AS reviewed_count, arg_min(title, ordinal) AS title FROM dims GROUP BY ALL),
scaled AS (SELECT *, {_log("signal_count::DOUBLE", 50)} AS content_volume,
    CASE WHEN unique_author_count > 0 THEN least(1e2, unique_author_count / signal_count::DOUBLE * 100) END AS diffusion FROM grouped),
covered AS (SELECT *, {_coverage(_SIX)} AS data_coverage FROM scaled),
topics AS (SELECT *, CAST(round_even({_heat(_SIX)}, 0) AS INT) AS observed_heat,
    CAST(round_even(least(1e2, signal_count / 5e0 * 100) * 0.25e0 + least(1e2, unique_author_count / 3e0 * 100) * 0.2e0 + source_score * 0.2e0 + data_coverage * 0.2e0
      + (CASE WHEN counter_signal_count > 0 THEN 1e2 ELSE 0e0 END) * 0.15e0, 0) AS INT) AS raw_confidence FROM covered)"""

SQL = {
    "signal_evidence_index": f"""WITH {DIMENSIONS_SQL}, covered AS (SELECT *, CAST({_coverage(_FIVE)} AS INT) AS data_coverage FROM dims)
SELECT snapshot_id, signal_id, CAST(round_even({_heat(_FIVE)}, 0) AS INT) AS observed_heat,
  CAST(round_even(data_coverage * 0.6e0 + quality * 0.4e0, 0) AS INT) AS evidence_confidence, data_coverage, {_STATUS} AS score_status, quality AS source_quality,
  concat_ws(',', {", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in ("content_volume", "engagement", "velocity", "search_demand", "freshness"))}) AS missing_fields
FROM covered""",
    "topic_evidence_rank": f"""WITH {TOPICS_SQL}
SELECT snapshot_id, topic, signal_count, observed_heat, raw_confidence, 45 AS confidence_cap, least(raw_confidence, 45) AS evidence_confidence,
  CAST(data_coverage AS INT) AS data_coverage, {_STATUS} AS score_status, unique_author_count, direct_source_count, search_card_count, counter_signal_count,
  subject_bridge_signal_count, subject_bridge_direct_count, round_even(reviewed_count / signal_count::DOUBLE, 3) AS review_coverage, title,
  CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY least(raw_confidence, 45) DESC, observed_heat DESC, topic) AS INT) AS topic_rank
FROM topics""",
}
