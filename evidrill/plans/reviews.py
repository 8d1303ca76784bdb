"""Queries over duplicates, reviews, clusters, excerpts and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, review
from ..sources import views


def _with_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.signals(spark, sf_dir)
    none = F.lit("")
    return s.withColumn("dedupe_key", dedup.dedupe_key(F.col("platform"), F.col("content_id"), none, none, none, none)).withColumns({
        "published_text": F.lit(""), "reviewed": F.col("semantic_relevance") != "unreviewed",
        "evidence_refs": F.array(F.concat(F.lit("https://x.test/"), F.col("content_id")), F.concat(F.lit("artifact://"), F.col("signal_id"))),
        "limitations": F.when(F.col("detail_captured"), F.array(F.lit("partial"))).otherwise(F.array(F.lit("search_card_only"), F.lit("partial"))),
    })


def merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dedup.merge_duplicates(_with_identity(spark, sf_dir))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return m.select(
        "snapshot_id", "dedupe_key", "signal_id", "source_type", "detail_captured", "semantic_relevance", "merged_from_count", "views", "likes",
        joined("query_terms").alias("query_terms"), joined("evidence_refs").alias("evidence_refs"), joined("limitations").alias("limitations"),
    )


def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    none = F.lit("")
    key = dedup.dedupe_key(F.lit("Web"), none, none, F.col("source"), none, F.col("text"))
    d = d.select(key.alias("dedupe_key"), "doc_id")
    return d.groupBy("dedupe_key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("observations"))


def _semantic_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels")
    return labels.select(
        (F.col("doc_id") % 7).alias("snapshot_id"), F.col("doc_id").alias("content_id"), F.when(F.col("quality") == 0, "weak").when(F.col("doc_id") % 3 == 0, "adjacent").otherwise("direct").alias("relevance"),
        F.when(F.col("toxic") == 1, "counter").otherwise("support").alias("role"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("doc_id") % 9)).alias("topic"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise("read").alias("reason"),
    )


def semantic_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 7).alias("snapshot_id"), F.col("doc_id").alias("content_id"), F.lit("unreviewed").alias("semantic_relevance"), F.lit("neutral").alias("evidence_role"), F.col("source").alias("topic_key")
    )
    s = review.apply_semantic(d, _semantic_reviews(spark, sf_dir))
    return s.groupBy("snapshot_id", "topic_key").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if("reviewed").alias("reviewed"), F.count_if(F.col("semantic_relevance") == "direct").alias("direct"),
        F.count_if(F.col("evidence_role") == "counter").alias("counters"),
    )


def label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.label_faults(_semantic_reviews(spark, sf_dir)).select("content_id", "rule")


def review_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = views.table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select("doc_id")
    labels = views.table(spark, sf_dir, "labels").select("doc_id")
    return review.review_faults(queue, labels.unionByName(labels.where("doc_id % 10 = 0")), "doc_id")


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("signal_key"), (F.col("conv_id") % 10).alias("topic"), F.col("turn").alias("ordinal"), F.col("role").alias("category"),
        F.when(F.col("turn") % 3 == 0, "direct").when(F.col("turn") % 3 == 1, "adjacent").otherwise("weak").alias("relevance"),
        F.when(F.col("role") == "assistant", "counter").otherwise("support").alias("role"), F.col("text").alias("insight"),
    )


def comment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = review.comment_summary(_comments(spark, sf_dir), ["signal_key"])
    return s.select(
        "signal_key", "reviewed_count", "relevant_count", "support_count", "counter_count", F.array_join("insights", "|").alias("insights"),
        F.coalesce(F.array_join(F.transform(F.map_entries("category_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","), F.lit("")).alias("categories"),
    )


def topic_comment_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = review.comment_summary(_comments(spark, sf_dir), ["topic"], keep=4)
    return s.select("topic", "reviewed_count", "relevant_count", "support_count", "counter_count", F.array_join("insights", "|").alias("insights"), _categories())


def _categories() -> Column:
    return F.coalesce(F.array_join(F.transform(F.map_entries("category_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","), F.lit("")).alias("categories")


def commented_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as signals, joined with what was found in the conversation of their number."""
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("signal_key"))
    j = review.with_comment_review(d, _comments(spark, sf_dir))
    return j.select("signal_key", "comment_evidence", "reviewed_count", "relevant_count", "support_count", "counter_count", F.coalesce(F.size("insights"), F.lit(0)).alias("insights"))


def assignment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders assigned to clusters by line items: some twice, some never, some without a fit, a reason or a match."""
    li, k = views.table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    a = li.where("l_linenumber <= 2 AND l_orderkey % 13 <> 0").select(
        (k % 5).alias("snapshot_id"), F.when(k % 17 == 0, -k).otherwise(k).alias("signal_id"), F.when(k % 7 == 0, "vague").otherwise("core").alias("fit"), F.when(k % 11 == 0, " ").otherwise("why").alias("reason"),
        F.when(k % 19 != 0, F.col("l_linestatus") == "F").alias("transition_match"))
    return review.assignment_faults(a, views.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("snapshot_id"), F.col("o_orderkey").alias("signal_id")))


def verbatim_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items are excerpts; a document's paragraphs are the rows that they must stand in."""
    e = views.table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*[F.lit(s) for s in ("en", "fr", "de", "es")])).alias("channel"))
    rows = views.table(spark, sf_dir, "documents").select(F.col("lang").alias("channel"), F.explode(F.split("text", "\n")).alias("row_text"))
    return review.verbatim(e, rows, ["channel"]).select("item_id", "channel")


def _clusters(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('c0', 'topic-0'), ('c0', 'topic-1'), ('c1', 'topic-2'), ('c1', 'topic-3'), ('c2', 'topic-4'), ('other', NULL) AS t(cluster, source_topic)")


def cluster_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.cluster_plan(views.signals(spark, sf_dir), _clusters(spark)).groupBy("snapshot_id", "cluster", "fit", "transition_match").agg(F.count(F.lit(1)).alias("assignments"))


def cluster_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = review.cluster_audit(review.cluster_plan(views.signals(spark, sf_dir), _clusters(spark)))
    return a.select(
        "snapshot_id", "cluster", "member_count", "author_count", "direct_source_count", "core_member_count", "counter_member_count", "bridge_count",
        "match_rate", F.array_join("failed_checks", ",").alias("failed_checks"), "audit_status",
    )


def media_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.media_candidates(views.signals(spark, sf_dir)).select("snapshot_id", "signal_id", "rank")


def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over a day's authors, by the half of the event ids: how far they agree."""
    s = views.signals(spark, sf_dir)
    g = s.groupBy("snapshot_id").agg(
        F.collect_set(F.when(F.col("ordinal") % 2 == 0, F.col("author_id"))).alias("a"), F.collect_set(F.when(F.col("ordinal") % 2 == 1, F.col("author_id"))).alias("b")
    )
    return g.select("snapshot_id", F.bround(dedup.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


QUERIES = {
    "merged_signals": merged_signals, "document_identity": document_identity, "semantic_review": semantic_review, "label_faults": label_faults, "review_faults": review_faults,
    "comment_summary": comment_summary, "topic_comment_evidence": topic_comment_evidence, "verbatim_excerpts": verbatim_excerpts, "cluster_plan": cluster_plan,
    "commented_documents": commented_documents, "assignment_faults": assignment_faults, "cluster_audit": cluster_audit, "media_candidates": media_candidates, "repeatability": repeatability,
}

_SIGNALS = f"signals AS ({views.as_sql(views.SIGNALS)})"
_QUALITY = "(CASE source_type WHEN 'direct_post' THEN 100 WHEN 'exported_item' THEN 90 WHEN 'search_card' THEN 55 WHEN 'platform_summary' THEN 45 WHEN 'webpage' THEN 50 WHEN 'search_snippet' THEN 25 ELSE 20 END)"
_REVIEWS = """reviews AS (SELECT doc_id % 7 AS snapshot_id, doc_id AS content_id, CASE WHEN quality = 0 THEN 'weak' WHEN doc_id % 3 = 0 THEN 'adjacent' ELSE 'direct' END AS relevance,
  CASE WHEN toxic = 1 THEN 'counter' ELSE 'support' END AS role, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 't' || (doc_id % 9) END AS topic, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'read' END AS reason FROM labels)"""
_COMMENTS = """c AS (SELECT conv_id AS signal_key, conv_id % 10 AS topic, turn AS ordinal, role AS category, CASE turn % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'adjacent' ELSE 'weak' END AS relevance,
  CASE WHEN role = 'assistant' THEN 'counter' ELSE 'support' END AS role, text AS insight FROM conversations)"""
_COUNTS = """count(*) AS reviewed_count, count(*) FILTER (relevance <> 'weak') AS relevant_count, count(*) FILTER (relevance <> 'weak' AND role = 'support') AS support_count,
  count(*) FILTER (relevance <> 'weak' AND role = 'counter') AS counter_count"""
_CLUSTERED = f"""{_SIGNALS}, assigned AS (SELECT *, CASE topic_key WHEN 'topic-0' THEN 'c0' WHEN 'topic-1' THEN 'c0' WHEN 'topic-2' THEN 'c1' WHEN 'topic-3' THEN 'c1' WHEN 'topic-4' THEN 'c2' ELSE 'other' END AS cluster,
  CASE WHEN semantic_relevance = 'weak' THEN 'supporting' WHEN evidence_role = 'counter' THEN 'counter' WHEN semantic_relevance = 'direct' THEN 'core' ELSE 'supporting' END AS fit,
  semantic_relevance <> 'weak' AS transition_match FROM signals)"""

SQL = {
    # a pair at most shares an identity here, so the fold is one step
    "merged_signals": f"""WITH {_SIGNALS}, k AS (SELECT *, sha256(platform || '|content_id|' || content_id) AS dedupe_key, {_QUALITY} AS q,
  row_number() OVER (PARTITION BY snapshot_id, content_id ORDER BY detail_captured DESC, {_QUALITY} DESC, length(summary) DESC, ordinal) AS best FROM signals)
SELECT snapshot_id, dedupe_key, max(signal_id) FILTER (best = 1) AS signal_id, max(source_type) FILTER (best = 1) AS source_type, bool_or(detail_captured) AS detail_captured,
  arg_max(semantic_relevance, (CASE semantic_relevance WHEN 'direct' THEN 3 WHEN 'adjacent' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END)) AS semantic_relevance, CAST(count(*) AS INT) AS merged_from_count,
  coalesce(max(views) FILTER (best = 1), max(views) FILTER (best = 2)) AS views, coalesce(max(likes) FILTER (best = 1), max(likes) FILTER (best = 2)) AS likes,
  array_to_string(list_sort(list_distinct(list(query_term))), ',') AS query_terms,
  array_to_string(list_sort(list_distinct(flatten(list(['https://x.test/' || content_id, 'artifact://' || signal_id])))), ',') AS evidence_refs,
  CASE WHEN bool_or(detail_captured) THEN 'partial' ELSE 'partial,search_card_only' END AS limitations FROM k GROUP BY ALL""",
    "document_identity": r"""SELECT sha256('web|fallback|' || source || '||' || substr(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), 1, 500)) AS dedupe_key,
  min(doc_id) AS first_doc, count(*) AS observations FROM documents GROUP BY ALL""",
    "semantic_review": f"""WITH {_REVIEWS}, j AS (SELECT d.doc_id % 7 AS snapshot_id, CASE WHEN relevance = 'weak' THEN 'excluded-keyword-collision' WHEN relevance IS NOT NULL AND topic <> '' THEN topic ELSE source END AS topic_key,
  relevance, role FROM documents d LEFT JOIN reviews ON content_id = doc_id)
SELECT snapshot_id, topic_key, count(*) AS signals, count(relevance) AS reviewed, count(*) FILTER (relevance = 'direct') AS direct, count(*) FILTER (role = 'counter') AS counters FROM j GROUP BY ALL""",
    "label_faults": f"""WITH {_REVIEWS} SELECT content_id, 'reason' AS rule FROM reviews WHERE reason = '' UNION ALL SELECT content_id, 'topic_key' FROM reviews WHERE relevance <> 'weak' AND topic = ''""",
    "review_faults": """WITH q AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1), r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS n FROM labels)
SELECT * FROM (SELECT coalesce(q.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN q.doc_id IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' END AS fault FROM q FULL JOIN r ON q.doc_id = r.doc_id) WHERE fault IS NOT NULL""",
    "comment_summary": f"""WITH {_COMMENTS}, i AS (SELECT signal_key, insight, min(ordinal) AS o FROM c WHERE relevance <> 'weak' AND insight <> '' GROUP BY ALL),
k AS (SELECT signal_key, category, count(*) AS n FROM c WHERE relevance <> 'weak' GROUP BY ALL)
SELECT g.*, coalesce((SELECT string_agg(insight, '|' ORDER BY o) FROM (SELECT * FROM i WHERE i.signal_key = g.signal_key ORDER BY o LIMIT 5)), '') AS insights,
  coalesce((SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM k WHERE k.signal_key = g.signal_key), '') AS categories
FROM (SELECT signal_key, {_COUNTS} FROM c GROUP BY ALL) g""",
    "topic_comment_evidence": f"""WITH {_COMMENTS}, i AS (SELECT topic, insight, min(ordinal) AS o FROM c WHERE relevance <> 'weak' AND insight <> '' GROUP BY ALL), f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY topic ORDER BY o, insight) <= 4),
s AS (SELECT topic, string_agg(insight, '|' ORDER BY o, insight) AS insights FROM f GROUP BY ALL), k AS (SELECT topic, category, count(*) AS n FROM c WHERE relevance <> 'weak' GROUP BY ALL), m AS (SELECT topic, string_agg(category || ':' || n, ',' ORDER BY category) AS categories FROM k GROUP BY ALL)
SELECT g.*, coalesce(insights, '') AS insights, coalesce(categories, '') AS categories FROM (SELECT topic, {_COUNTS} FROM c GROUP BY ALL) g LEFT JOIN s USING (topic) LEFT JOIN m USING (topic)""",
    "commented_documents": f"""WITH {_COMMENTS}, g AS (SELECT signal_key, {_COUNTS}, least(5, count(DISTINCT insight) FILTER (relevance <> 'weak' AND insight <> '')) AS insights FROM c GROUP BY ALL)
SELECT doc_id AS signal_key, CASE WHEN relevant_count > 0 THEN 'relevant' WHEN reviewed_count > 0 THEN 'reviewed' ELSE 'unreviewed' END AS comment_evidence, coalesce(reviewed_count, 0) AS reviewed_count, coalesce(relevant_count, 0) AS relevant_count,
  coalesce(support_count, 0) AS support_count, coalesce(counter_count, 0) AS counter_count, CAST(coalesce(insights, 0) AS INT) AS insights FROM documents LEFT JOIN g ON signal_key = doc_id""",
    "assignment_faults": """WITH a AS (SELECT l_orderkey % 5 AS s, CASE WHEN l_orderkey % 17 = 0 THEN -l_orderkey ELSE l_orderkey END AS id, l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 13 <> 0 GROUP BY ALL),
o AS (SELECT o_orderkey % 5 AS s, o_orderkey AS id FROM orders)
SELECT s AS snapshot_id, id AS signal_id, 'unassigned' AS fault FROM o WHERE NOT EXISTS (FROM a WHERE a.s = o.s AND a.id = o.id) UNION ALL SELECT s, id, 'unknown_signal' FROM a WHERE NOT EXISTS (FROM o WHERE a.s = o.s AND a.id = o.id)
UNION ALL SELECT s, id, 'repeated' FROM a WHERE n > 1 UNION ALL SELECT s, id, 'fit' FROM a WHERE k % 7 = 0 UNION ALL SELECT s, id, 'reason' FROM a WHERE k % 11 = 0 UNION ALL SELECT s, id, 'transition_match' FROM a WHERE k % 19 = 0""",
    "verbatim_excerpts": r"""WITH e AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS x FROM benchmark),
r AS (SELECT DISTINCT lang AS channel, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS y FROM documents)
SELECT DISTINCT item_id, channel FROM e JOIN r ON x = y OR (length(x) >= 12 AND contains(y, x))""",
    "cluster_plan": f"WITH {_CLUSTERED} SELECT snapshot_id, cluster, fit, transition_match, count(*) AS assignments FROM assigned GROUP BY ALL",
    "cluster_audit": f"""WITH {_CLUSTERED}, g AS (SELECT snapshot_id, cluster, count(*) AS member_count, count(DISTINCT CASE WHEN author_id <> '' THEN lower(author_id) END) AS author_count,
  count(*) FILTER (detail_captured OR source_type IN ('direct_post', 'exported_item')) AS direct_source_count, count(*) FILTER (fit = 'core') AS core_member_count,
  count(*) FILTER (fit = 'counter') AS counter_member_count, count(*) FILTER (transition_match) AS m, count(*) FILTER (query_layer = 'subject_bridge') AS bridge_count FROM assigned GROUP BY ALL),
f AS (SELECT *, concat_ws(',', CASE WHEN member_count < 3 THEN 'member_count' END, CASE WHEN author_count < 2 THEN 'author_diversity' END, CASE WHEN direct_source_count < 1 THEN 'direct_source' END,
  CASE WHEN core_member_count < 2 THEN 'core_members' END, CASE WHEN m / member_count::DOUBLE < 0.8 THEN 'task_transition_match' END, CASE WHEN bridge_count < 1 THEN 'subject_bridge_member' END) AS failed_checks FROM g)
SELECT * EXCLUDE (m), round_even(m / member_count::DOUBLE, 3) AS match_rate, CASE WHEN failed_checks = '' THEN 'passed' ELSE 'failed' END AS audit_status FROM f""",
    "media_candidates": f"""WITH {_SIGNALS}, s AS (SELECT snapshot_id, signal_id, lower(author_id) AS author, evidence_role, CASE semantic_relevance WHEN 'direct' THEN 4e2 WHEN 'adjacent' THEN 3e2 WHEN 'unreviewed' THEN 15e1 WHEN 'weak' THEN 5e1 ELSE 0e0 END
  + CASE WHEN query_layer = 'subject_bridge' THEN 7e1 ELSE 0e0 END + CASE WHEN evidence_role = 'counter' THEN 4e1 ELSE 0e0 END + CASE WHEN NOT detail_captured THEN 2e1 ELSE 0e0 END
  + round_even(ln(1 + (coalesce(views, 0e0) * 0.05e0 + coalesce(likes, 0e0) + coalesce(comments, 0e0) * 2 + coalesce(shares, 0e0) * 2.5e0 + coalesce(saves, 0e0) * 2.5e0)), 6) AS score FROM signals),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, signal_id DESC) AS r FROM s),
t AS (SELECT snapshot_id, CASE WHEN evidence_role = 'counter' THEN 'support' ELSE 'counter' END AS opposite, author AS a1 FROM r WHERE r = 1),
o AS (SELECT r.*, CASE WHEN r.r = 1 THEN 1 WHEN r.r = min(CASE WHEN r.r > 1 AND evidence_role = opposite AND (author = '' OR author <> a1) THEN r.r END) OVER (PARTITION BY snapshot_id) THEN 2 ELSE 3 END AS seed FROM r JOIN t USING (snapshot_id)),
p AS (SELECT *, CASE WHEN seed < 3 THEN seed WHEN author = '' OR row_number() OVER (PARTITION BY snapshot_id, author ORDER BY seed, r) = 1 THEN 3 ELSE 4 END AS phase FROM o)
SELECT snapshot_id, signal_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY phase, r) AS INT) AS rank FROM p QUALIFY rank <= 10""",
    "repeatability": f"""WITH {_SIGNALS}, g AS (SELECT snapshot_id, list(DISTINCT author_id) FILTER (ordinal % 2 = 0) AS a, list(DISTINCT author_id) FILTER (ordinal % 2 = 1) AS b FROM signals GROUP BY ALL)
SELECT snapshot_id, round_even(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b))))::DOUBLE, 6) AS jaccard FROM g""",
}
