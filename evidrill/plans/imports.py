"""Queries over imported snapshots: raw exports in mixed spellings, normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, normalize
from ..sources import views


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exports would have them: every other one nested and in camel case, as JSON that is read back."""
    e = views.table(spark, sf_dir, "events")
    i = F.col("event_id").cast("string")
    url = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("https://x.test/status/"), i)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("https://x.test/i/trending/"), i)).when(
        F.col("event_id") % 4 == 2, F.concat(F.lit("https://x.test/page/"), i, F.lit("/#top"))).otherwise("mailto:x")
    flat = F.struct(
        F.when(F.col("event_id") % 3 == 0, i).alias("id"), url.alias("url"), F.concat(F.lit(" "), F.col("event_type"), F.lit("� ")).alias("title"), F.concat(F.floor("value"), F.lit("k")).alias("views"),
        F.lit("1,000").alias("like_count"), F.lit("yes").alias("detail_captured"), F.lit("Direct").alias("semantic_relevance"), F.lit("a|b，a").alias("query_terms"), F.col("user_id").alias("username"),
    )
    nested = F.struct(
        i.alias("contentId"), url.alias("canonicalUrl"), F.col("event_type").alias("text"), F.struct(F.floor("value").alias("view_count"), F.lit(-1).alias("likes")).alias("public_metrics"),
        F.struct(F.col("user_id").alias("id"), F.lit("Name").alias("name")).alias("author"), F.lit("COUNTER").alias("role"), F.lit("customer_export").alias("sourceMode"), F.array(F.lit("search_card_only")).alias("limits"),
        F.struct((F.col("event_id") % 50).alias("searchRank")).alias("discovery"),
    )
    text = F.when(F.col("event_id") % 2 == 0, F.to_json(flat)).otherwise(F.to_json(nested))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"), F.col("event_id").alias("ordinal"), F.from_json(text, "map<string,string>").alias("raw"))


def normalized_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalize.normalize(_raw(spark, sf_dir), "Twitter", "public_web", "2024-02-01")
    return n.select(
        "snapshot_id", "ordinal", "signal_id", "platform", "source_mode", "source_type", "evidence_role", "detail_captured", "canonical_url", "semantic_relevance", "title",
        F.array_join("query_terms", "+").alias("query_terms"), "views", "likes", "author_id", "author_name", "search_rank", F.size("evidence_refs").alias("refs"),
        F.size("limitations").alias("limits"), "dedupe_key",
    )


def merged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items as snapshots of one subject: the first row of a part wins, a later detailed one fills."""
    c = views.table(spark, sf_dir, "lineitem")
    order = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")
    rows = c.select(
        F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("signal_id"), F.struct(order.alias("o"), F.col("l_extendedprice").alias("p")).alias("ordinal"), (F.col("l_linestatus") == "F").alias("detail_captured"),
        F.col("l_extendedprice").alias("summary"), F.col("l_returnflag").alias("query_layer"), F.col("l_linestatus").alias("query_term"),
    )
    m = dedup.merge_snapshots(rows, ["summary"])
    return m.select("subject", "signal_id", "summary", "detail_captured", "merged_rows", F.array_join("query_layers", ",").alias("query_layers"), F.array_join("query_terms", ",").alias("query_terms"))


QUERIES = {"normalized_signals": normalized_signals, "merged_snapshots": merged_snapshots}
SQL = {
    "normalized_signals": """WITH e AS (SELECT *, CAST(event_id AS VARCHAR) AS i, event_id % 2 = 0 AS flat, CASE event_id % 4 WHEN 0 THEN 'https://x.test/status/' || event_id WHEN 1 THEN 'https://x.test/i/trending/' || event_id
  WHEN 2 THEN 'https://x.test/page/' || event_id || '/#top' ELSE '' END AS url FROM events),
n AS (SELECT *, CASE WHEN flat AND event_id % 3 <> 0 THEN '' ELSE i END AS cid FROM e),
k AS (SELECT *, sha256(CASE WHEN cid <> '' THEN 'x|content_id|' || cid ELSE 'x|url|' || regexp_replace(split_part(url, '#', 1), '/+$', '') END) AS dedupe_key FROM n)
SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id, event_id AS ordinal, CASE WHEN flat AND cid <> '' THEN cid WHEN cid <> '' THEN 'x-' || cid ELSE 'signal-' || substr(dedupe_key, 1, 12) END AS signal_id, 'x' AS platform,
  CASE WHEN flat THEN 'public_web' ELSE 'customer_export' END AS source_mode, CASE WHEN NOT flat THEN 'search_card' WHEN event_id % 4 = 0 THEN 'direct_post' ELSE 'webpage' END AS source_type,
  CASE WHEN flat THEN 'neutral' ELSE 'counter' END AS evidence_role, flat AS detail_captured, url AS canonical_url, CASE WHEN flat THEN 'direct' ELSE 'unreviewed' END AS semantic_relevance, event_type AS title,
  CASE WHEN flat THEN 'a+b+a' ELSE '' END AS query_terms, CAST(floor(value) AS BIGINT) * CASE WHEN flat THEN 1000 ELSE 1 END AS views, CASE WHEN flat THEN 1000::BIGINT END AS likes, CAST(user_id AS VARCHAR) AS author_id,
  CASE WHEN flat THEN '' ELSE 'Name' END AS author_name, CASE WHEN NOT flat THEN CAST(event_id % 50 AS DOUBLE) END AS search_rank, CASE WHEN url <> '' THEN 1 ELSE 0 END AS refs, 1 AS limits, dedupe_key FROM k""",
    "merged_snapshots": """WITH r AS (SELECT *, (l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT), l_extendedprice) AS o, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT), l_extendedprice) AS n FROM lineitem)
SELECT l_suppkey AS subject, l_partkey AS signal_id, coalesce(arg_min(l_extendedprice, n) FILTER (l_linestatus = 'F'), min(l_extendedprice) FILTER (n = 1)) AS summary,
  bool_or(l_linestatus = 'F') AS detail_captured, count(*) AS merged_rows, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS query_layers, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS query_terms
FROM r GROUP BY ALL""",
}
