"""Queries over later details, snapshot merges, bases of reports and rules on their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import collection, enrich, findings, media, review, text_rules
from ..sources import views
from . import ledger, reviews


def _k() -> Column:
    return F.col("o_orderkey")


def failure_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as logs, each with what one kind of failure says."""
    c = views.table(spark, sf_dir, "conversations")
    said = ("", "HTTP 429 ", "Captcha shown ", "not logged in ", "Access denied ", "redirect loop ", "session expired ", "timed out ", "npm WARN cleanup EPERM ", "安全验证 ")
    log = F.concat(F.element_at(F.array(*map(F.lit, said)), ((F.col("conv_id") + F.col("turn")) % len(said) + 1).cast("int")), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", *[enrich.failure(log, kind).alias(kind) for kind in enrich.FAILURES])


def comment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://www.tiktok.com/@An.n/"), F.when(_k() % 2 == 0, "video/").otherwise("user/"), _k(), F.lit("?a=1"))
    comments = F.when(_k() % 5 == 0, F.array(F.lit("said"))).otherwise(F.array().cast("array<string>"))
    ok = enrich.comment_target(url, F.when(_k() % 3 == 0, "").otherwise((_k() + F.when(_k() % 7 == 0, 1).otherwise(0)).cast("string")), F.when(_k() % 11 == 0, "@bob").otherwise("@an.N"), _k() % 13 != 0, F.when(_k() % 26 == 0, "direct_post").otherwise("search_card"), comments, F.when(_k() % 17 == 0, "captured").otherwise(""))
    return o.select("o_orderkey", ok.alias("eligible"))


def _permalinks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = views.table(spark, sf_dir, "orders")
    own = F.concat(F.lit("https://www.reddit.com/r/t/comments/"), _k(), F.lit("/"))
    s = o.select(F.col("o_custkey").alias("snapshot_id"), _k().cast("string").alias("content_id"), F.when(_k() % 13 == 0, "x").otherwise("reddit").alias("platform"), own.alias("canonical_url"), F.lit("").alias("summary"), F.lit("search_card").alias("source_type"),
                 (_k() % 10 == 0).alias("detail_captured"), F.array(F.lit("The post body was not returned."), F.lit("partial")).alias("limitations"))
    url = F.when(_k() % 5 == 0, F.concat(F.lit("https://reddit.com/r/t/comments/"), _k())).when(_k() % 7 == 0, "https://www.reddit.com/other").otherwise(own)
    e = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("snapshot_id"), F.when(_k() % 33 == 0, "none").otherwise(_k().cast("string")).alias("content_id"), url.alias("canonical_url"), F.concat(F.lit("body "), F.col("o_orderpriority")).alias("body_text"),
                                             F.when(_k() % 17 == 0, "guess").otherwise("agent_summary").alias("body_text_kind"), F.lit("2024-01-01").alias("captured_at"), F.lit("public_web").alias("source_mode"))
    return s, e


def permalink_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = enrich.permalink_details(*_permalinks(spark, sf_dir))
    return out.select("snapshot_id", "content_id", "summary", "source_type", "detail_captured", "detail_text_kind", F.array_join("limitations", "|").alias("limitations"))


def permalink_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.permalink_details(*_permalinks(spark, sf_dir))[1]


def detail_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unopened signal of an even event is a target; two in three are opened. One event in ten repeats the post before
    it, so that results meet posts that were observed twice."""
    once = reviews._with_identity(spark, sf_dir)
    targets = once.where("NOT detail_captured AND ordinal % 2 = 0").select("snapshot_id", "dedupe_key", F.col("query_layer").alias("layer"))
    r = once.where("NOT detail_captured AND (ordinal % 2 = 0 OR ordinal % 5 = 0)")
    none = F.lit(None).cast("string")
    results = r.select(*[F.col(c) for c in once.columns if c not in ("ordinal", "signal_id", "query_term", "query_layer", "source_type", "summary", "detail_captured")], F.col("ordinal").alias("seq"), (F.col("ordinal") % 3 != 0).alias("success"),
                     F.when(F.col("ordinal") % 3 == 0, "timeout").otherwise("").alias("stop_reason"), F.lit("raw").alias("artifact"), none.alias("signal_id"), none.alias("query_term"), none.alias("query_layer"), none.alias("source_type"), F.lit("the whole text of the opened page").alias("summary"))
    merged, _ = enrich.detail_results(once, targets, results)
    return merged.select("snapshot_id", "dedupe_key", "signal_id", "source_type", "detail_captured", "summary", "merged_from_count")


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders are snapshots of one study, their line items signals."""
    o = views.table(spark, sf_dir, "orders")
    layer = F.element_at(F.array(F.lit("platform_baseline"), F.lit("category"), F.lit("subject_bridge")), (_k() % 3 + 1).cast("int"))
    snapshots = o.select(F.col("o_custkey").alias("study"), _k().alias("snapshot_id"), F.when(F.col("o_custkey") % 9 == 0, F.col("o_orderstatus")).otherwise("Topic").alias("subject"), F.concat(F.lit("Term "), _k() % 40).alias("query_term"), layer.alias("query_layer"),
                         F.when(_k() % 4 == 0, 0).otherwise(9).cast("bigint").alias("observed"))
    li = views.table(spark, sf_dir, "lineitem")
    signals = li.select(F.col("l_orderkey").alias("snapshot_id"), F.concat(F.lit("s"), F.col("l_partkey")).alias("signal_id"), F.concat(F.lit("https://x.test/"), F.col("l_partkey"), F.when(F.col("l_suppkey") % 50 == 0, "/b").otherwise("")).alias("canonical_url"),
                        (F.col("l_linestatus") == "F").alias("detail_captured"), F.when(F.col("l_returnflag") == "R", "").otherwise("text").alias("summary"))
    return snapshots, signals


def merge_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.merge_faults(*_merged(spark, sf_dir))


def merge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.merge_totals(enrich.snapshot_runs(*_merged(spark, sf_dir)))


def comment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    return enrich.comment_queue(c.select(F.lit("s").alias("snapshot_id"), F.col("conv_id").cast("string").alias("signal_key"), F.col("turn").alias("comment_index"), "text")).select("signal_key", "comment_index", "comment_key")


def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = ledger._counted(collection.collection_status)(spark, sf_dir)
    return enrich.collection_summary(status, views.cards(spark, sf_dir))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger._counted(collection.layer_stats_with_mode)(spark, sf_dir)


def gap_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = views.cards(spark, sf_dir)
    missing = F.array_compact(F.array(F.when(F.col("quantity") > 45, "freshness"), F.when(F.col("position") > 4, "engagement"), F.when(F.col("quantity") > 0, "velocity")))
    status = ledger._counted(collection.collection_status)(spark, sf_dir)
    return enrich.gap_tasks(status, _layers(spark, sf_dir), cards.select("snapshot_id", F.concat_ws("/", "query_id", "position").alias("signal_id"), missing.alias("missing_fields")))


def topic_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as runs of its study, line items as its signals."""
    runs = views.runs(spark, sf_dir).select(F.col("snapshot_id").alias("study"), "query_layer", F.lit(12).cast("bigint").alias("observed_result_count"), F.when(F.col("query_id") % 40 == 0, 1).otherwise(2).alias("pass_count"), ((F.col("query_id") % 10) / 10).alias("overlap"))
    signals = views.cards(spark, sf_dir).select(F.col("snapshot_id").alias("study"), F.array("query_layer").alias("layers"), "semantic_relevance", "evidence_role", "detail_captured", (F.col("position") % 3).alias("comment_count"))
    b = enrich.topic_basis(runs, signals)
    return b.select("study", "query_count", "observed_count", "unique_count", "detail_count", "relevant_count", "counter_count", "visible_comment_count", "repeat_pass_count", F.bround("repeat_overlap", 3).alias("repeat_overlap"), F.array_join("failed_checks", ",").alias("failed_checks"), "sampling_status")


def account_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem")
    said = F.when(F.col("l_linenumber") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return enrich.account_basis(li.select(F.col("l_suppkey").alias("account"), (F.col("l_linestatus") == "F").alias("detail_captured"), said.alias("representative_comments")))


def decision_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    return enrich.decision_readiness(o.select(F.col("o_custkey").alias("study"), F.when(_k() % 6 == 0, "confirmed").when(_k() % 6 == 1, "review_ready").otherwise("candidate").alias("conclusion_status"), F.when(_k() % 4 != 0, (_k() % 5).cast("int")).alias("snapshots")))


def excluded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = review.cluster_audit(review.cluster_plan(views.signals(spark, sf_dir), reviews._clusters(spark)))
    return enrich.excluded_topics(a).select("snapshot_id", "topic", F.array_join("failed_gates", ",").alias("failed_gates"))


def subject_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    refs = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r")))
    s = p.select(
        k.alias("subject_id"), F.col("p_name").alias("name"), F.when(k % 5 == 0, " ").otherwise("said").alias("summary"), F.when(k % 7 == 0, "thing").otherwise("idea").alias("subject_type"), F.when(k % 11 == 0, "fr").alias("language"), F.lit(None).cast("string").alias("goal"),
        F.when(k % 13 == 0, "all").otherwise("expert").alias("audience"), F.array(F.struct(F.lit("fact").alias("statement"), refs.alias("source_refs"))).alias("facts"),
        F.array(F.struct(F.lit("plain").alias("text"), F.lit("").alias("statement"), F.lit("").alias("origin")), F.struct(F.lit("").alias("text"), F.lit("held").alias("statement"), F.when(k % 3 == 0, "dream").otherwise("user_premise").alias("origin"))).alias("hypotheses"),
    )
    return enrich.subject_faults(s, ("idea", "product"))


def context_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    contexts = c.select(k.alias("context_id"), F.when(k % 6 == 0, "clarification_required").otherwise("ready").alias("status"), F.col("c_mktsegment").alias("research_intent"), F.when(k % 5 == 0, "v0").otherwise("v1").alias("profile_version"), F.when(k % 7 == 0, "").otherwise("x").alias("platform"), F.lit("en").alias("language"))
    profiles = c.select(F.col("c_mktsegment").alias("research_intent")).distinct().where("research_intent <> 'MACHINERY'").withColumn("version", F.lit("v1"))
    return enrich.context_faults(contexts, profiles, ["platform", "language"])


def report_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    item = F.struct(F.array(F.lit("https://X.test/a/"), F.lit("")).alias("support_refs"), F.when(k % 3 == 0, F.array(F.lit("https://x.test/A"), F.lit(""))).otherwise(F.array(F.lit(""))).alias("counter_refs"))
    return enrich.report_faults(d.select(k.alias("report_id"), F.lit("the").alias("subject"), "text", F.array(item).alias("items"), F.when(k % 2 == 0, "met").otherwise("partial").alias("contract_status"), F.when(k % 5 == 0, "timeout").otherwise("sampling_contract_met").alias("stop_reason")))


def recovery_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer proposes to search again, a few times with what ran before."""
    runs = views.runs(spark, sf_dir).withColumn("url", F.concat(F.lit("https://x.test/search?q="), F.col("query_id")))
    k, c = F.col("k"), F.col("snapshot_id")
    last = runs.groupBy("snapshot_id").agg(F.max("query_id").alias("k"), F.max_by("query_term", "query_id").alias("t"), F.max_by("query_layer", "query_id").alias("layer"))
    term = F.when(c % 5 == 0, F.upper("t")).when(c % 5 == 1, "one two-three four's five six").when(c % 5 == 2, "").otherwise("fresh words")
    url = F.when(c % 7 == 0, F.concat(F.lit("https://x.test/search?q="), k)).when(c % 7 == 1, "ftp://x").otherwise("https://x.test/new")
    p = last.select("snapshot_id", F.when(c % 11 == 0, k).alias("id"), term.alias("term"), F.when(c % 13 == 0, "other").otherwise(F.col("layer")).alias("layer"), url.alias("url"), F.when(c % 3 == 0, "ask").alias("intent"), F.when(c % 2 == 0, F.array(F.lit("ask"), F.lit("buy"))).alias("allowed_intents"))
    p = p.unionByName(p.where("snapshot_id % 17 = 0"))
    terms = last.select("snapshot_id", F.when(c % 3 == 0, "Fresh Words").otherwise("stale words").alias("term"))
    return findings.recovery_faults(p, runs, ledger._counted(collection.recovery_needs)(spark, sf_dir), terms)


def forbidden_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 5
    raw = F.when(k == 0, F.to_json(F.struct(F.col("text").alias("Token")))).when(k == 1, F.to_json(F.struct(F.struct(F.col("text").alias("friends")).alias("in")))).otherwise(F.to_json(F.struct(F.col("text").alias("text"))))
    return c.select("conv_id", "turn", F.coalesce(text_rules.forbidden_keys(raw, "friends"), F.lit(False)).alias("forbidden"))


def video_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://YouTu.be/"), k)).when(k % 4 == 1, "").otherwise(F.col("url"))
    return p.select("page_id", media.is_video(F.when(k % 3 == 0, "YouTube").otherwise("web"), F.when(k % 5 == 0, "Reel").otherwise("text"), url).alias("video"))


def stop_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    notes = F.array_compact(F.array(F.when(_k() % 2 == 0, "sampling_contract_unmet: x"), F.when(_k() % 3 == 0, "collection_in_progress"), F.col("o_orderpriority"), F.when(_k() % 5 == 0, "timeout")))
    return o.select("o_orderkey", F.array_join(collection.stop_limitations(notes, F.lit("timeout")), "|").alias("notes"))


def score_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", S.level(F.col("l_quantity") * 2, 70, 40).alias("level")).agg(F.count(F.lit(1)).alias("signals"))


QUERIES = {
    "failure_logs": failure_logs, "comment_targets": comment_targets, "permalink_details": permalink_details, "permalink_faults": permalink_faults, "detail_results": detail_results, "merge_faults": merge_faults, "merge_totals": merge_totals,
    "comment_queue": comment_queue, "collection_summary": collection_summary, "gap_tasks": gap_tasks, "topic_basis": topic_basis, "account_basis": account_basis, "decision_readiness": decision_readiness, "excluded_topics": excluded_topics,
    "subject_faults": subject_faults, "context_faults": context_faults, "report_faults": report_faults, "recovery_faults": recovery_faults, "forbidden_captures": forbidden_captures, "video_flags": video_flags, "stop_notes": stop_notes, "score_levels": score_levels,
}


def _failure_sql(kind: str) -> str:
    more = " WHEN contains(t, 'npm warn cleanup') AND contains(t, 'eperm') THEN 'runtime_install_error'" if kind == "analyzer" else ""
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {w!r})' for w in words)} THEN '{name}'" for name, words in enrich.FAILURES[kind]) + more + f" ELSE '{enrich.OTHERWISE[kind]}' END AS {kind}"


_LINKS = """s AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS pr FROM orders),
e AS (SELECT c, CASE WHEN k % 33 = 0 THEN 'none' ELSE CAST(k AS VARCHAR) END AS id, k, pr, k % 13 = 0 AS other, k % 5 <> 0 AND k % 7 = 0 AS moved, k % 17 = 0 AS guess FROM s WHERE k % 3 = 0),
b AS (SELECT *, id = 'none' OR other OR moved OR guess AS bad FROM e)"""
SQL = {
    "failure_logs": f"""WITH l AS (SELECT conv_id, turn, lower((['', 'HTTP 429 ', 'Captcha shown ', 'not logged in ', 'Access denied ', 'redirect loop ', 'session expired ', 'timed out ', 'npm WARN cleanup EPERM ', '安全验证 '])[(conv_id + turn) % 10 + 1] || coalesce(text, '')) AS t FROM conversations)
SELECT conv_id, turn, {", ".join(_failure_sql(k) for k in enrich.FAILURES)} FROM l""",
    "comment_targets": """SELECT o_orderkey, k % 2 = 0 AND (k % 3 = 0 OR k % 7 <> 0) AND k % 11 <> 0 AND (k % 13 <> 0 OR k % 26 = 0) AND k % 5 <> 0 AND k % 17 <> 0 AS eligible FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "permalink_details": f"""WITH {_LINKS}, g AS (SELECT c, k FROM b WHERE NOT bad)
SELECT s.c AS snapshot_id, CAST(s.k AS VARCHAR) AS content_id, CASE WHEN g.k IS NOT NULL THEN 'body ' || pr ELSE '' END AS summary, CASE WHEN g.k IS NOT NULL THEN 'direct_post' ELSE 'search_card' END AS source_type, g.k IS NOT NULL OR s.k % 10 = 0 AS detail_captured,
  CASE WHEN g.k IS NOT NULL THEN 'agent_summary' ELSE '' END AS detail_text_kind, CASE WHEN g.k IS NOT NULL THEN 'partial' ELSE 'The post body was not returned.|partial' END AS limitations FROM s LEFT JOIN g ON s.k = g.k""",
    "permalink_faults": f"""WITH {_LINKS} SELECT DISTINCT c AS snapshot_id, id AS content_id, f AS fault FROM (SELECT c, id, unnest(list_filter([CASE WHEN id = 'none' THEN 'content_id' END, CASE WHEN id = 'none' OR other OR moved THEN 'canonical_url' END, CASE WHEN guess THEN 'body' END], lambda x: x IS NOT NULL)) AS f FROM b)""",
    "detail_results": f"""WITH signals AS ({views.as_sql(views.SIGNALS)}), s AS (SELECT snapshot_id, sha256(platform || '|content_id|' || content_id) AS dedupe_key, ordinal, signal_id, source_type, detail_captured AS d, summary FROM signals),
r AS (SELECT snapshot_id, dedupe_key, ordinal + 1099511627776 AS ordinal, first(signal_id ORDER BY ordinal) OVER (PARTITION BY snapshot_id, dedupe_key) AS signal_id, 'direct_post' AS source_type, true AS d, 'the whole text of the opened page' AS summary, ordinal AS o FROM s
  WHERE EXISTS (FROM s t WHERE t.snapshot_id = s.snapshot_id AND t.dedupe_key = s.dedupe_key AND NOT t.d AND t.ordinal % 2 = 0) AND NOT d AND (ordinal % 2 = 0 OR ordinal % 5 = 0) AND ordinal % 3 <> 0),
u AS (SELECT * FROM s UNION ALL SELECT snapshot_id, dedupe_key, ordinal, signal_id, source_type, d, summary FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, dedupe_key ORDER BY d DESC, {reviews._QUALITY} DESC, length(summary) DESC, ordinal) AS best FROM u)
SELECT snapshot_id, dedupe_key, max(signal_id) FILTER (best = 1) AS signal_id, max(source_type) FILTER (best = 1) AS source_type, bool_or(d) AS detail_captured,
  coalesce(nullif(max(summary) FILTER (best = 1), ''), arg_min(summary, ordinal) FILTER (summary <> ''), '') AS summary, CAST(count(*) AS INT) AS merged_from_count FROM k GROUP BY ALL""",
    "merge_faults": """WITH s AS (SELECT o_custkey AS study, o_orderkey AS k, CASE WHEN o_custkey % 9 = 0 THEN lower(o_orderstatus) ELSE 'topic' END AS subject, o_orderkey % 40 AS term, o_orderkey % 3 AS layer FROM orders),
g AS (SELECT study, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT (term, layer)) AS queries, count(DISTINCT layer) AS layers FROM s GROUP BY ALL),
h AS (SELECT study, l_partkey, min(l_suppkey % 50 = 0) AS a, max(l_suppkey % 50 = 0) AS b FROM lineitem JOIN s ON l_orderkey = k WHERE l_linestatus = 'F' OR l_returnflag <> 'R' GROUP BY ALL)
SELECT study, 'snapshots' AS fault FROM g WHERE n < 3 UNION ALL SELECT study, 'subject' FROM g WHERE subjects <> 1 UNION ALL SELECT study, 'queries' FROM g WHERE queries < n UNION ALL SELECT study, 'layers' FROM g WHERE layers < 3
UNION ALL SELECT DISTINCT study, 'canonical_url' FROM h WHERE a <> b""",
    "merge_totals": """WITH r AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS d FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'R' GROUP BY ALL)
SELECT o_custkey AS study, count(*) AS query_count, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN coalesce(n, 0) ELSE 9 END) AS BIGINT) AS observed_total, CAST(sum(coalesce(n, 0)) AS BIGINT) AS retained_total, CAST(sum(coalesce(d, 0)) AS BIGINT) AS detail_total
FROM orders LEFT JOIN r ON k = o_orderkey GROUP BY ALL""",
    "comment_queue": r"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS signal_key, turn AS comment_index, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM conversations)
SELECT signal_key, comment_index, 'comment-' || substr(sha256(signal_key || chr(10) || comment_index || chr(10) || t), 1, 20) AS comment_key FROM c WHERE t <> ''""",
    "collection_summary": f"""WITH s AS (SELECT snapshot_id, count(*) AS u, count(*) FILTER (semantic_relevance IN ('direct', 'adjacent')) AS r, count(*) FILTER (evidence_role = 'counter') AS c, count(*) FILTER (detail_captured) AS d FROM ({views.as_sql(views.CARDS)}) GROUP BY ALL)
SELECT snapshot_id, query_count, observed_result_count, coalesce(u, unique_sample_count) AS unique_signal_count, r AS relevant_signal_count, coalesce(d, detail_open_count) AS detail_open_count, coalesce(c, counter_signal_count) AS counter_signal_count,
  CASE WHEN contract_status = 'met' AND stop_reason IN ('', 'sampling_contract_met') THEN 'complete' ELSE 'bounded' END AS sampling_status FROM ({ledger.SQL["collection_status"]}) LEFT JOIN s USING (snapshot_id)""",
    "gap_tasks": f"""WITH st AS ({ledger.SQL["collection_status"]}), ly AS (SELECT l.*, mode FROM ({ledger.SQL["layer_stats"]}) l JOIN (SELECT snapshot_id, any_value(mode) AS mode FROM ({views.as_sql(views.RUNS)}) GROUP BY ALL) USING (snapshot_id)),
m AS (SELECT snapshot_id, unnest(list_filter([CASE WHEN quantity > 45 THEN 'freshness' END, CASE WHEN position > 4 THEN 'engagement' END, CASE WHEN quantity > 0 THEN 'velocity' END], lambda x: x IS NOT NULL)) AS field FROM ({views.as_sql(views.CARDS)})),
t AS (SELECT snapshot_id, count(*) AS n FROM ({views.as_sql(views.CARDS)}) GROUP BY ALL), g AS (SELECT snapshot_id, field, count(*) AS affected FROM m GROUP BY ALL),
u AS (SELECT snapshot_id, 1 AS kind, 0 AS pos, 'collection.sampling_contract' AS field, 0 AS affected, 'high' AS priority FROM st WHERE contract_status <> 'met'
UNION ALL SELECT snapshot_id, 2, CASE query_layer WHEN 'platform_baseline' THEN 1 WHEN 'category' THEN 2 ELSE 3 END, 'collection.layer.' || query_layer || '.detail_opens', 0, 'high' FROM ly WHERE detail_open_count < {ledger._c('layer_detail_min')}
UNION ALL SELECT snapshot_id, 3, 0, 'collection.layer.subject_bridge.direct_relevance', 0, 'high' FROM ly WHERE query_layer = 'subject_bridge' AND direct_relevance_count < {ledger._c('subject_bridge_direct_min')}
UNION ALL SELECT snapshot_id, 4, -affected, field, affected, CASE WHEN affected = n THEN 'high' ELSE 'medium' END FROM g JOIN t USING (snapshot_id))
SELECT snapshot_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY kind, pos, field) AS INT) AS task_rank, field, affected, priority FROM u""",
    "topic_basis": f"""WITH runs AS ({views.as_sql(views.RUNS)}), cards AS ({views.as_sql(views.CARDS)}),
r AS (SELECT snapshot_id AS study, count(*) AS query_count, CAST(count(*) * 12 AS BIGINT) AS observed_count, min(CASE WHEN query_id % 40 = 0 THEN 1 ELSE 2 END) AS repeat_pass_count, round_even(round_even(avg(query_id % 10 / 10e0), 4), 3) AS repeat_overlap FROM runs GROUP BY ALL),
g AS (SELECT snapshot_id AS study, count(*) AS unique_count, count(*) FILTER (detail_captured) AS detail_count, count(*) FILTER (semantic_relevance IN ('direct', 'adjacent')) AS relevant_count, count(*) FILTER (semantic_relevance <> 'unreviewed') AS reviewed_count,
  count(*) FILTER (evidence_role = 'counter') AS counter_count, CAST(sum(position % 3) AS BIGINT) AS visible_comment_count, count(*) FILTER (query_layer = 'subject_bridge' AND semantic_relevance = 'direct' AND detail_captured) AS bridge FROM cards GROUP BY ALL),
p AS (SELECT snapshot_id AS study, query_layer, count(*) AS u, count(*) FILTER (semantic_relevance IN ('direct', 'adjacent')) AS rel, count(*) FILTER (semantic_relevance = 'direct') AS d, count(*) FILTER (detail_captured) AS o FROM cards GROUP BY ALL),
q AS (SELECT snapshot_id AS study, query_layer, count(*) AS q FROM runs GROUP BY ALL), l AS (SELECT study, count(*) FILTER (u >= 4 AND rel >= 4 AND d >= 2 AND o >= 2 AND q >= 1) AS fine FROM p JOIN q USING (study, query_layer) GROUP BY ALL),
j AS (SELECT study, query_count, observed_count, repeat_pass_count, repeat_overlap, coalesce(unique_count, 0) AS unique_count, coalesce(detail_count, 0) AS detail_count, coalesce(relevant_count, 0) AS relevant_count, coalesce(reviewed_count, 0) AS reviewed_count, coalesce(counter_count, 0) AS counter_count,
  coalesce(visible_comment_count, 0) AS visible_comment_count, coalesce(bridge, 0) AS bridge, coalesce(fine, 0) AS fine FROM r LEFT JOIN g USING (study) LEFT JOIN l USING (study)),
f AS (SELECT *, concat_ws(',', CASE WHEN query_count < 3 THEN 'query_count' END, CASE WHEN observed_count < 60 THEN 'observed_volume' END, CASE WHEN unique_count < 30 THEN 'unique_volume' END, CASE WHEN detail_count < 12 THEN 'detail_volume' END, CASE WHEN relevant_count < 18 THEN 'relevant_volume' END,
  CASE WHEN counter_count < 3 THEN 'counterevidence' END, CASE WHEN reviewed_count / greatest(unique_count, 1)::DOUBLE < 0.8 THEN 'review_coverage' END, CASE WHEN repeat_pass_count < 2 THEN 'repeatability' END, CASE WHEN bridge < 2 THEN 'direct_subject_bridge' END, CASE WHEN fine < 3 THEN 'per_layer_quality' END) AS failed_checks FROM j)
SELECT study, query_count, observed_count, unique_count, detail_count, relevant_count, counter_count, visible_comment_count, repeat_pass_count, repeat_overlap, failed_checks, CASE WHEN failed_checks = '' THEN 'complete' ELSE 'bounded' END AS sampling_status FROM f""",
    "account_basis": "SELECT l_suppkey AS account, count(*) AS observed_post_count, count(*) FILTER (l_linestatus = 'F') AS detail_post_count, CAST(2 * count(*) FILTER (l_linenumber = 1) AS BIGINT) AS visible_comment_count FROM lineitem GROUP BY ALL",
    "decision_readiness": """SELECT o_custkey AS study, count(*) FILTER (o_orderkey % 6 < 2) AS ready_findings, count(*) AS total_findings, CASE WHEN count(*) FILTER (o_orderkey % 6 < 2) > 0 THEN 'actionable_test' ELSE 'exploratory' END AS status,
  CAST(max(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 ELSE 1 END) AS INT) AS compatible_snapshot_count FROM orders GROUP BY ALL""",
    "excluded_topics": f"SELECT snapshot_id, cluster AS topic, array_to_string(list_sort(string_split(failed_checks, ',')), ',') AS failed_gates FROM ({reviews.SQL['cluster_audit']}) WHERE audit_status = 'failed'",
    "subject_faults": " UNION ALL ".join(f"SELECT p_partkey AS subject_id, '{rule}' AS rule FROM part WHERE p_partkey % {n} = 0" for rule, n in (("summary", 5), ("subject_type", 7), ("language", 11), ("audience", 13), ("facts[0].source_refs", 4), ("hypotheses[1].origin", 3))),
    "context_faults": """WITH c AS (SELECT c_custkey AS context_id, c_custkey AS k, c_mktsegment AS s FROM customer) SELECT context_id, 'status' AS rule FROM c WHERE k % 6 = 0 UNION ALL SELECT context_id, 'platform' FROM c WHERE k % 6 <> 0 AND k % 7 = 0
UNION ALL SELECT context_id, 'version' FROM c WHERE k % 6 <> 0 AND (k % 5 = 0 OR s = 'MACHINERY')""",
    "report_faults": """SELECT doc_id AS report_id, 'subject' AS rule FROM documents WHERE NOT contains(text, 'the') UNION ALL SELECT doc_id, 'shared_refs' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'stop_reason' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 = 0""",
    "recovery_faults": f"""WITH {ledger.NEEDS_SQL}, r AS ({views.as_sql(views.RUNS)}), q AS (SELECT snapshot_id AS c, max(query_id) AS k, arg_max(query_term, query_id) AS t, arg_max(query_layer, query_id) AS layer, count(*) AS n_runs, min(mode) AS mode FROM r GROUP BY ALL),
p AS (SELECT *, CASE c % 5 WHEN 0 THEN upper(t) WHEN 1 THEN 'one two-three four''s five six' WHEN 2 THEN '' ELSE 'fresh words' END AS term, CASE WHEN c % 13 = 0 THEN 'other' ELSE layer END AS l, CASE WHEN c % 17 = 0 THEN 2 ELSE 1 END AS copies FROM q),
w AS (SELECT p.*, recommended_layers, volume_only, unnest(range(0, copies)) AS i FROM p LEFT JOIN needs ON snapshot_id = c)
{" UNION ALL ".join(f"SELECT c AS snapshot_id, term, '{rule}' AS rule FROM w WHERE {when}" for rule, when in {
    "budget": f"{ledger._c('query_target', 1)} - n_runs < copies", "one_query": "copies > 1", "term": "term = ''", "layer_name": "c % 13 = 0", "url": "c % 7 = 1", "id": "c % 11 = 0", "url_repeated": "c % 7 = 0",
    "repeated": "term <> '' AND EXISTS (FROM r WHERE r.snapshot_id = c AND lower(query_term) = lower(term))", "words": "len(regexp_extract_all(term, '[a-z''-]+')) > 4",
    "layer": "recommended_layers <> '' AND NOT list_contains(string_split(recommended_layers, ','), l)", "evidence": "volume_only AND lower(term) <> CASE WHEN c % 3 = 0 THEN 'fresh words' ELSE 'stale words' END",
    "intent": "c % 2 = 0 AND c % 3 <> 0"}.items())}""",
    "forbidden_captures": "SELECT conv_id, turn, text IS NOT NULL AND (conv_id + turn) % 5 < 2 AS forbidden FROM conversations",
    "video_flags": """WITH p AS (SELECT page_id, page_id % 3 = 0 AS a, page_id % 5 = 0 AS b, CASE WHEN page_id % 4 = 0 THEN 'https://youtu.be/' || page_id WHEN page_id % 4 = 1 THEN '' ELSE lower(url) END AS u FROM pages)
SELECT page_id, u <> '' AND (a OR b OR contains(u, '/video/') OR contains(u, 'youtu.be/') OR contains(u, 'youtube.com/watch')) AS video FROM p""",
    "stop_notes": "SELECT o_orderkey, o_orderpriority || '|timeout' AS notes FROM orders",
    "score_levels": "SELECT l_returnflag, CASE WHEN l_quantity * 2 >= 70 THEN 'high' WHEN l_quantity * 2 >= 40 THEN 'medium' ELSE 'low' END AS level, count(*) AS signals FROM lineitem GROUP BY ALL",
}
