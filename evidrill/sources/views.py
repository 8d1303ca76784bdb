"""Domain tables from the driver's star schema, so that every operator has data that grows with the input.

A view is one SELECT that Spark and other engines read alike; the braces stand for the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"


def _pick(key: str, *values: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _some(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN CAST({value} AS DOUBLE) END"


#: One observed post for each event; one in ten repeats the post before it.
SIGNALS = f"""
SELECT CAST(CAST(ts AS DATE) AS STRING) AS snapshot_id, event_id AS ordinal,
  'post-' || CAST(CASE WHEN event_id % 10 = 1 THEN event_id - 1 ELSE event_id END AS STRING) AS content_id,
  'signal-' || CAST(event_id AS STRING) AS signal_id,
  {_pick("EXTRACT(DAY FROM ts) % 4", "x", "youtube", "xiaohongshu", "tiktok")} AS platform,
  {_pick("event_id % 7", "direct_post", "search_card", "exported_item", "platform_summary", "search_snippet", "webpage", "unknown")} AS source_type,
  {_pick("event_id % 3", "platform_baseline", "category", "subject_bridge")} AS query_layer,
  'term-' || CAST(event_id % 12 AS STRING) AS query_term,
  {_pick("event_id % 4", "direct", "adjacent", "weak", "unreviewed")} AS semantic_relevance,
  CASE WHEN user_id % 5 = 0 THEN 'counter' WHEN user_id % 5 = 1 THEN 'neutral' ELSE 'support' END AS evidence_role,
  (event_id % 3 = 0 OR event_id % 5 = 0) AS detail_captured,
  CASE WHEN event_id % 23 = 0 THEN '' ELSE 'user-' || CAST(user_id AS STRING) END AS author_id,
  CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 10 = 9 THEN '' ELSE 'topic-' || CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 10 AS STRING) END AS topic_key,
  event_type || ' ' || CAST(event_id % 100 AS STRING) AS title,
  CASE WHEN event_id % 8 = 0 THEN '' ELSE event_type || ' seen by ' || CAST(user_id AS STRING) END AS summary,
  {_some("event_id % 6 <> 0", "FLOOR(value * 100)")} AS views, {_some("event_id % 11 <> 0", "FLOOR(value * 3)")} AS likes,
  {_some("event_id % 2 = 0", "event_id % 19")} AS saves, {_some("event_id % 4 <> 1", "event_id % 17")} AS comments, {_some("event_id % 9 <> 2", "event_id % 5")} AS shares,
  {_some("event_id % 7 <> 3", "event_id % 60 + 1")} AS search_rank, {_some("event_id % 3 = 0", "event_id % 500")} AS search_result_count,
  {_some("event_id % 5 < 3", "event_id % 900")} AS observed_content_count,
  {_some("event_id % 13 = 0", "event_id % 80")} AS growth_rate_percent, {_some("event_id % 4 = 2", "event_id % 40")} AS current_window_count,
  {_some("event_id % 4 = 2", "event_id % 37")} AS previous_window_count,
  CAST(ts AS TIMESTAMP) AS published_at
FROM {{events}}
"""

#: One query run for each order; the results of a run are its line items. A customer's orders are one snapshot.
RUNS = f"""
SELECT o_custkey AS snapshot_id, o_orderkey AS query_id, 'term ' || CAST(o_orderkey % 50 AS STRING) AS query_term,
  {_pick("o_orderkey % 3", "platform_baseline", "category", "subject_bridge")} AS query_layer,
  CASE WHEN o_custkey % 3 = 0 THEN 'quick' WHEN o_custkey % 3 = 1 THEN 'standard' ELSE 'deep' END AS mode,
  CASE o_orderstatus WHEN 'F' THEN 'query_target_met' WHEN 'O' THEN 'results_exhausted' ELSE 'timeout' END AS stop_reason,
  CASE WHEN o_custkey % 7 = 0 THEN 'search_collection_complete' WHEN o_custkey % 7 = 1 THEN 'collection_in_progress' WHEN o_custkey % 7 = 2 THEN 'safety_stop' ELSE '' END AS snapshot_stop
FROM {{orders}}
"""

CARDS = f"""
SELECT o_custkey AS snapshot_id, l_orderkey AS query_id, l_linenumber AS position, 'p' || CAST(l_partkey AS STRING) AS dedupe_key,
  {_pick("l_orderkey % 3", "platform_baseline", "category", "subject_bridge")} AS query_layer,
  {_pick("l_partkey % 4", "direct", "adjacent", "weak", "unreviewed")} AS semantic_relevance,
  CASE WHEN l_returnflag = 'R' THEN 'counter' ELSE 'support' END AS evidence_role, (l_linestatus = 'F') AS detail_captured,
  {_pick("l_suppkey % 3", "direct_post", "search_card", "exported_item")} AS source_type, 's' || CAST(l_suppkey AS STRING) AS author_id,
  l_quantity AS quantity, l_extendedprice AS price
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, select: str, *tables: str) -> DataFrame:
    return spark.sql(select, **{t: table(spark, sf_dir, t) for t in tables})


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGNALS, "events")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RUNS, "orders")


#: A task that joins or groups by a key without another shuffle gets about so many rows, whatever the size of the table.
ROWS_PER_TASK = 1 << 19


def parts(df: DataFrame) -> int:
    """How many parts df has rows for; 0 where the session's own number of parts is enough. The count is that of the
    files' footers."""
    n = -(-df.count() // ROWS_PER_TASK)
    return 0 if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in as many parts as it has rows for; as it is where the session's own number of parts is enough."""
    n = parts(df)
    return df.repartition(n, *keys) if n else df


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined by the order and, for yields, grouped by it in the same tasks, so that these have to grow in number."""
    return spark.sql(CARDS, lineitem=spread(table(spark, sf_dir, "lineitem"), "l_orderkey"), orders=table(spark, sf_dir, "orders"))


def card_parts(spark: SparkSession, sf_dir: str) -> int:
    """The parts that cards need when they are grouped by anything but their order: a card is a line item."""
    return parts(table(spark, sf_dir, "lineitem"))


def as_sql(select: str) -> str:
    """The view as another engine reads it, with the tables under their own names."""
    for t in ("events", "orders", "lineitem", "documents", "labels", "conversations", "pages", "part", "customer", "nation", "benchmark"):
        select = select.replace("{" + t + "}", t)
    return select.strip()
