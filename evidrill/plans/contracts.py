"""Queries over media evidence, findings and query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CONTRACTS
from ..operators import findings, media, scoring
from ..sources import views
from .scores import TOPICS_SQL, as_of


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a video: its lines are segments, its sentences are read from pictures, every third one wrongly."""
    d = views.table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    segments = F.transform(lines, lambda x, i: F.struct(F.concat(i, F.lit(":30")).alias("start"), x.alias("text")))
    ocr = F.transform(F.split("text", "\\. "), lambda x, i: F.struct(i.cast("string").alias("time"), F.concat(F.when(i % 3 == 0, "Ã").otherwise(""), x).alias("text"), F.lit(0.5).alias("confidence")))
    k = F.col("doc_id") % 5
    raw = F.struct(
        F.when(k < 3, F.struct(F.when(k == 0, "ASR").otherwise("other").alias("source"), segments.alias("segments"))).alias("transcript"), F.when(k != 1, ocr).alias("ocrResults"),
        F.when(k == 2, F.array(F.lit("used Whisper"))).alias("warnings"), F.array(F.struct(F.lit("1").alias("time"))).alias("frames"),
    )
    return d.select(F.col("doc_id").alias("signal_key"), F.to_json(F.when(k < 4, raw)).alias("raw"))


def media_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.analyzer_results(_analyzed(spark, sf_dir))
    return m.select("signal_key", F.size("segments").alias("segments"), F.size("ocr_rows").alias("ocr_rows"), "dropped", "keyframes", "provenance", "status")


def media_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable media promote a document's card; labels of low quality take it back."""
    s = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("signal_key"), F.when(F.col("doc_id") % 2 == 0, "search_card").otherwise("webpage").alias("source_type"), (F.col("doc_id") % 7 == 0).alias("detail_captured"))
    reviews = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("signal_key"), F.col("quality").alias("relevant_excerpts"))
    p = media.apply_review(media.promote(s, media.analyzer_results(_analyzed(spark, sf_dir))), reviews)
    return p.groupBy("source_type", "detail_captured", "media_reviewed").agg(F.count(F.lit(1)).alias("signals"))


def topic_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    e = c.select(
        (F.col("conv_id") % 5).alias("snapshot_id"), (F.col("conv_id") % 3).alias("topic"), F.struct("conv_id", "turn").alias("ordinal"), F.col("role").alias("channel"), F.col("text"),
        F.when(F.col("turn") % 3 == 2, "weak").otherwise("direct").alias("relevance"), F.col("conv_id").cast("string").alias("url"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("about "), F.col("conv_id") % 20)).alias("summary"),
    )
    t = media.topic_media(e)
    return t.select("snapshot_id", "topic", "reviewed_videos", "excerpt_count", F.array_join("excerpts", "|").alias("excerpts"), F.array_join("summaries", "|").alias("summaries"), F.array_join("refs", ",").alias("refs"),
                    F.array_join(F.transform(F.map_entries("channel_counts"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",").alias("channels"))


def plan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.runs(spark, sf_dir)
    p = r.select(
        F.col("snapshot_id").alias("plan_id"), "mode", (F.col("query_id") % 2000).alias("query_id"), F.when(F.col("query_id") % 29 == 0, " ").otherwise(F.col("query_term")).alias("term"),
        F.when(F.col("query_id") % 31 == 0, "elsewhere").otherwise(F.col("query_layer")).alias("layer"), F.when(F.col("query_id") % 37 == 0, "file://x").otherwise("https://x.test").alias("url"),
    )
    return findings.plan_faults(p)


def finding_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a finding of its customer's study; its fields break rules by the order's number."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = lambda n: F.when(k % n == 0, " ").otherwise("said")
    refs = lambda n: F.when(k % n == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://x.test/"), k)))
    f = o.select(
        F.col("o_custkey").alias("study"), k.cast("string").alias("finding_id"), F.concat(F.lit("t"), k % 6).alias("topic"), F.lit("demand").alias("intent"), text(11).alias("title"), text(13).alias("analysis_unit_statement"),
        F.lit("said").alias("decision_summary"), F.lit("said").alias("audience"), F.lit("said").alias("evidence_boundary"), F.when(k % 17 == 0, F.array(F.lit("alien"))).otherwise(F.array(F.lit("need"), F.lit("barrier"))).alias("roles"),
        refs(5).alias("support_refs"), F.when(k % 19 == 0, refs(7)).otherwise(F.array(F.lit("https://other.test/"))).alias("counter_refs"), F.lit("found").alias("counter_search_status"),
        F.array(F.create_map(F.lit("owner"), F.when(k % 23 == 0, "").otherwise("team"))).alias("actions"), F.create_map(F.lit("summary"), text(29)).alias("sections"),
        F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "review_ready").otherwise("candidate").alias("conclusion_status"), F.when(k % 2 == 0, "me").alias("human_confirmation"),
        F.when(k % 31 == 0, "rising").otherwise("current_snapshot").alias("temporal_claim"), F.lit(1).alias("snapshots"), (k % 37 != 0).alias("direct_source_present"),
    )
    profiles = spark.sql("SELECT 'demand' AS intent, array('need', 'barrier') AS allowed_roles, array('owner') AS action_fields, array('summary') AS section_names, 1 AS min_support, 2 AS min_roles, array('rising') AS history_claims")
    topics = o.select(F.col("o_custkey").alias("study"), F.explode(F.array(*[F.lit(f"t{i}") for i in range(5)])).alias("topic"))
    return findings.finding_faults(f, profiles, topics)


def cluster_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = p.select(
        F.col("p_brand").alias("plan_id"), k.cast("string").alias("topic_key"), F.when(k % 7 == 0, k.cast("string")).when(k % 11 == 0, F.concat(F.col("p_name"), F.lit(" **bold**"))).when(k % 13 == 0, F.repeat("p_name", 30)).otherwise(
            F.col("p_name")).alias("title"), F.when(k % 5 == 0, " ").otherwise("unit").alias("analysis_unit_statement"), F.lit("in").alias("inclusion_rule"), F.when(k % 17 == 0, None).otherwise("out").alias("exclusion_rule"),
    )
    return findings.cluster_spec_faults(d)


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts in some format, as far as they say, with what their hashtag page shows."""
    e, k = views.table(spark, sf_dir, "events"), F.col("event_id")
    said = F.when(k % 7 == 0, None).when(k % 7 == 1, " ").when(k % 7 == 2, F.concat(F.lit("Short"), F.when(k % 2 == 0, " ").otherwise("-"), F.lit("Video"))).when(k % 7 == 3, "REEL").when(k % 7 == 4, "p").otherwise(F.col("event_type"))
    hint = F.when(k % 5 < 2, F.concat(F.lit(" "), F.col("user_id") % 50, F.lit("K posts")))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_id"), k.alias("ordinal"), said.alias("format"), hint.alias("hint"))


def format_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.format_mix(_formats(spark, sf_dir))


def supply_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.supply_hints(_formats(spark, sf_dir))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for every third topic, with its scores and what reviewed conversations say on its number."""
    t = scoring.topic_index(views.signals(spark, sf_dir), as_of()).select("snapshot_id", "topic", "observed_heat", "raw_confidence")
    c = views.table(spark, sf_dir, "conversations").select(F.lit("2024-01-02").alias("snapshot_id"), F.concat(F.lit("topic-"), F.col("conv_id") % 10).alias("topic"), "role")
    comments = c.groupBy("snapshot_id", "topic").agg(F.count(F.lit(1)).alias("comments"))
    clips = c.where("role = 'system'").groupBy("snapshot_id", "topic").agg(F.count(F.lit(1)).alias("clips"))
    f = t.where("raw_confidence % 3 = 0").select("snapshot_id", "topic")
    return findings.report_rows(f, t, comments, clips).na.fill(0, ["comments", "clips"])


def unused_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scoring.topic_index(views.signals(spark, sf_dir), as_of()).select("snapshot_id", "topic", "raw_confidence")
    return findings.unused_topics(t, t.where("raw_confidence % 3 = 0"))


QUERIES = {"cluster_specs": cluster_specs, "format_mix": format_mix, "supply_hints": supply_hints, "report_rows": report_rows, "unused_topics": unused_topics, "media_results": media_results, "media_promotion": media_promotion, "topic_media": topic_media, "plan_faults": plan_faults, "finding_faults": finding_faults}


def _c(name: str, bound: int | None = None) -> str:
    v = {m: (c[name] if bound is None else c[name][bound]) for m, c in CONTRACTS.items()}
    return f"(CASE mode WHEN 'standard' THEN {v['standard']} WHEN 'deep' THEN {v['deep']} ELSE {v['quick']} END)"


_MEDIA = r"""d AS (SELECT doc_id, doc_id % 5 AS k, string_split(text, chr(10))[1:200] AS l, string_split(text, '. ') AS o FROM documents),
s AS (SELECT doc_id, k, len(list_filter(l, lambda x: regexp_replace(x, '[\s\p{Z}]', '', 'g') <> '')) AS seg, len(o) AS raw_ocr,
  len(list_filter(list_filter(range(1, least(len(o), 80) + 1), lambda i: (i - 1) % 3 <> 0), lambda i: regexp_replace(o[i], '[\s\p{Z}]', '', 'g') <> '')) AS ok FROM d),
m AS (SELECT doc_id AS signal_key, CASE WHEN k < 3 THEN seg ELSE 0 END AS segments, CASE WHEN k IN (0, 2, 3) THEN ok ELSE 0 END AS ocr_rows, CASE WHEN k IN (0, 2, 3) THEN raw_ocr - ok ELSE 0 END AS dropped,
  CASE WHEN k < 4 THEN 1 ELSE 0 END AS keyframes, CASE WHEN k = 0 THEN 'asr' WHEN k = 2 AND seg > 0 THEN 'asr' ELSE 'unknown' END AS provenance, k FROM s),
r AS (SELECT *, CASE WHEN segments = 0 AND ocr_rows = 0 THEN 'unavailable' WHEN k = 2 OR dropped > 0 THEN 'partial' ELSE 'complete' END AS status FROM m)"""
_FORMATS = """f AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot_id, event_id, trim(CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'Short Video' ELSE 'Short-Video' END WHEN 3 THEN 'REEL' WHEN 4 THEN 'p' ELSE event_type END) AS f,
  CASE WHEN event_id % 5 < 2 THEN ' ' || (user_id % 50) || 'K posts' END AS hint FROM events)"""
_LABELS = "WHEN '' THEN 'Format unconfirmed' WHEN 'short video' THEN 'Short video' WHEN 'short-video' THEN 'Short video' WHEN 'reel' THEN 'Reel' WHEN 'p' THEN 'Post' WHEN 'video' THEN 'Video' WHEN 'post' THEN 'Post' WHEN 'image' THEN 'Image' WHEN 'photo' THEN 'Photo' WHEN 'carousel' THEN 'Carousel' WHEN 'unknown' THEN 'Format unconfirmed'"
_FINDING = {
    "title": "k % 11 = 0", "analysis_unit_statement": "k % 13 = 0", "topic_key": "k % 6 = 5", "profile_evidence_roles": "k % 17 = 0", "shared_refs": "k % 19 = 0 AND k % 5 <> 0 AND k % 7 <> 0", "recommended_actions": "k % 23 = 0",
    "report_sections": "k % 29 = 0", "thresholds": "k % 3 <> 2 AND NOT (k % 5 <> 0 AND NOT (k % 19 = 0 AND k % 7 = 0) AND k % 17 <> 0 AND k % 37 <> 0)", "human_confirmation": "k % 3 = 0 AND k % 2 <> 0", "history": "k % 31 = 0",
}
SQL = {
    "cluster_specs": """WITH p AS (SELECT p_brand AS plan_id, CAST(p_partkey AS VARCHAR) AS topic_key, p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 11 = 0 THEN p_name || ' **bold**'
  WHEN p_partkey % 13 = 0 THEN repeat(p_name, 30) ELSE p_name END AS t FROM part)
SELECT plan_id, topic_key, 'analysis_unit_statement' AS rule FROM p WHERE k % 5 = 0 UNION ALL SELECT plan_id, topic_key, 'exclusion_rule' FROM p WHERE k % 17 = 0
UNION ALL SELECT plan_id, topic_key, 'reader_title' FROM p WHERE length(t) > 120 OR t = topic_key OR contains(t, '**')""",
    "format_mix": f"""WITH {_FORMATS}, g AS (SELECT snapshot_id, CASE lower(f) {_LABELS} ELSE f END AS format, count(*) AS signals FROM f GROUP BY ALL)
SELECT snapshot_id, format, signals, round_even(signals / sum(signals) OVER (PARTITION BY snapshot_id)::DOUBLE, 4) AS share, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY signals DESC, format) AS INT) AS format_rank FROM g""",
    "supply_hints": f"""WITH {_FORMATS}, h AS (SELECT snapshot_id, trim(hint) AS hint, min(event_id) AS o FROM f WHERE hint IS NOT NULL GROUP BY ALL)
SELECT snapshot_id, hint, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY o, hint) AS INT) AS hint_rank FROM h QUALIFY hint_rank <= 3""",
    "report_rows": f"""WITH {TOPICS_SQL}, c AS (SELECT 'topic-' || (conv_id % 10) AS topic, count(*) AS comments, count(*) FILTER (role = 'system') AS clips FROM conversations GROUP BY ALL)
SELECT snapshot_id, t.topic, observed_heat, raw_confidence, coalesce(comments, 0) AS comments, coalesce(clips, 0) AS clips FROM topics t LEFT JOIN c ON c.topic = t.topic AND snapshot_id = '2024-01-02' WHERE raw_confidence % 3 = 0""",
    "unused_topics": f"WITH {TOPICS_SQL} SELECT snapshot_id, topic, raw_confidence FROM topics WHERE raw_confidence % 3 <> 0",
    "media_results": f"WITH {_MEDIA} SELECT signal_key, segments, ocr_rows, dropped, keyframes, provenance, status FROM r",
    "media_promotion": f"""WITH {_MEDIA}, j AS (SELECT signal_key, CASE WHEN signal_key % 2 = 0 THEN 'search_card' ELSE 'webpage' END AS st, signal_key % 7 = 0 AS dc, status <> 'unavailable' AS seen, quality FROM r LEFT JOIN labels ON doc_id = signal_key)
SELECT CASE WHEN seen AND st = 'search_card' AND coalesce(quality, 1) > 0 THEN 'direct_post' ELSE st END AS source_type, CASE WHEN seen AND coalesce(quality, 1) > 0 THEN true ELSE dc END AS detail_captured,
  quality IS NOT NULL AS media_reviewed, count(*) AS signals FROM j GROUP BY ALL""",
    "topic_media": """WITH e AS (SELECT conv_id % 5 AS snapshot_id, conv_id % 3 AS topic, conv_id, turn, role, text AS x FROM conversations WHERE turn % 3 <> 2 AND trim(text) <> ''),
c AS (SELECT snapshot_id, topic, string_agg(role || ':' || n, ',' ORDER BY role) AS channels FROM (SELECT snapshot_id, topic, role, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL),
m AS (SELECT snapshot_id, topic, 'about ' || (conv_id % 20) AS y, min((conv_id, turn)) AS o FROM e WHERE turn % 2 = 0 GROUP BY ALL), y AS (SELECT snapshot_id, topic, string_agg(y, '|' ORDER BY o) AS summaries FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY snapshot_id, topic ORDER BY o) <= 3) GROUP BY ALL),
u AS (SELECT snapshot_id, topic, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS refs FROM (SELECT DISTINCT snapshot_id, topic, conv_id FROM e) GROUP BY ALL)
SELECT snapshot_id, topic, count(DISTINCT conv_id) AS reviewed_videos, count(*) AS excerpt_count, array_to_string(list(x ORDER BY conv_id, turn)[1:4], '|') AS excerpts, coalesce(any_value(summaries), '') AS summaries, any_value(refs) AS refs, any_value(channels) AS channels
FROM e JOIN c USING (snapshot_id, topic) LEFT JOIN y USING (snapshot_id, topic) JOIN u USING (snapshot_id, topic) GROUP BY ALL""",
    "plan_faults": f"""WITH p AS (SELECT o_custkey AS plan_id, CASE o_custkey % 3 WHEN 0 THEN 'quick' WHEN 1 THEN 'standard' ELSE 'deep' END AS mode, o_orderkey AS k, o_orderkey % 2000 AS query_id,
  CASE WHEN o_orderkey % 31 = 0 THEN 'elsewhere' ELSE (['platform_baseline', 'category', 'subject_bridge'])[o_orderkey % 3 + 1] END AS layer FROM orders),
g AS (SELECT plan_id, mode, count(*) AS n, least(count(*) FILTER (layer = 'platform_baseline'), count(*) FILTER (layer = 'category'), count(*) FILTER (layer = 'subject_bridge')) AS l FROM p GROUP BY ALL)
SELECT plan_id, query_id, 'unique_id' AS rule FROM p QUALIFY count(*) OVER (PARTITION BY plan_id, query_id) > 1 UNION ALL SELECT plan_id, query_id, 'term' FROM p WHERE k % 29 = 0
UNION ALL SELECT plan_id, query_id, 'layer' FROM p WHERE layer = 'elsewhere' UNION ALL SELECT plan_id, query_id, 'url' FROM p WHERE k % 37 = 0
UNION ALL SELECT plan_id, NULL, 'query_count' FROM g WHERE NOT n BETWEEN {_c('query_target', 0)} AND {_c('query_target', 1)} UNION ALL SELECT plan_id, NULL, 'layer_queries' FROM g WHERE l < {_c('layer_query_min')}""",
    "finding_faults": "WITH f AS (SELECT o_custkey AS study, CAST(o_orderkey AS VARCHAR) AS finding_id, o_orderkey AS k FROM orders) " + " UNION ALL ".join(f"SELECT study, finding_id, '{r}' AS rule FROM f WHERE {c}" for r, c in _FINDING.items()),
}
