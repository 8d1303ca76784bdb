"""Queries over decisions, reconciliations, coverage, growth and capture chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, review, scoring
from ..sources import views
from ..streaming import chunks
from .scores import TOPICS_SQL, as_of


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic index, by contracts that are met on even days, audited by a plan of one cluster a topic."""
    s = views.signals(spark, sf_dir)
    days = s.select("snapshot_id").distinct()
    status = days.withColumn("contract_status", F.when(F.dayofmonth(F.col("snapshot_id").cast("date")) % 2 == 0, "met").otherwise("partial"))
    plan = s.select("*", scoring.topic_key().alias("cluster")).withColumn("fit", F.when(F.col("semantic_relevance") == "direct", "core").otherwise("supporting")).withColumn("transition_match", F.col("semantic_relevance") != "weak")
    audits = review.cluster_audit(plan).select("snapshot_id", F.col("cluster").alias("topic"), "audit_status")
    return scoring.topic_index(s, as_of(), status, audits).withColumn("mode", F.lit("standard"))


def capped_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).select("snapshot_id", "topic", "raw_confidence", "audit_status", "confidence_cap", "evidence_confidence")


def opportunity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal of a topic and day is a proposal; the first is its primary one."""
    s = views.signals(spark, sf_dir).withColumn("topic", scoring.topic_key())
    none = F.array().cast("array<string>")
    p = s.select(
        "snapshot_id", "topic", "ordinal", "title", F.when(F.col("ordinal") % 3 == 0, "").otherwise("sellers").alias("audience"), F.lit("gap").alias("task_gap"), F.lit("entry").alias("subject_entry"),
        F.lit("test").alias("expected_action"), F.array("signal_id").alias("support_refs"), F.when(F.col("ordinal") % 2 == 0, F.array("signal_id")).otherwise(none).alias("counter_refs"),
        F.when(F.col("ordinal") % 4 == 1, "searched_none_found").otherwise("found").alias("counter_search_status"), F.lit("agent_reviewed").alias("semantic_review"),
        F.array(F.lit("bounded")).alias("risk_boundaries"), (F.col("ordinal") % 5 == 0).alias("confirmed"),
    )
    g = decisions.opportunity_gates(p, _topics(spark, sf_dir).drop("title"))
    return g.select("snapshot_id", "topic", "ordinal", F.array_join("failed_gates", ",").alias("failed_gates"), "rejected", "status")


def finding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a finding; it refers to its signals and to one that doesn't exist."""
    s = views.signals(spark, sf_dir).withColumn("url", F.concat(F.lit("https://x.test/"), F.col("content_id")))
    refs = F.concat(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "signal_id"))), lambda x: x["signal_id"]), F.array(F.lit("signal-none")))
    f = s.groupBy("snapshot_id", "author_id").agg(refs.alias("refs")).withColumn("finding_id", F.concat_ws("/", "snapshot_id", "author_id"))
    d = decisions.finding_evidence(f, s)
    return d.select("finding_id", F.array_join("urls", ",").alias("urls"), F.array_join("unknown", ",").alias("unknown"))


def platform_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's study, an order a report: its priority is the platform, its status part of the key."""
    o = views.table(spark, sf_dir, "orders")
    reports = o.select(F.col("o_custkey").alias("study"), F.col("o_orderpriority").alias("platform"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise("same").alias("compatibility_key"))
    shared = o.groupBy(F.col("o_custkey").alias("study"), F.year("o_orderdate").alias("finding")).agg(F.collect_set("o_orderpriority").alias("platforms"))
    c = decisions.platform_comparison(reports, shared)
    return c.select("study", F.array_join("platforms", ",").alias("platforms"), "shared_findings", "comparison")


def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against themselves with some lost, some added and some changed."""
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    scored = o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "?").otherwise(F.col("o_orderstatus")))
    scored = scored.unionByName(o.where("o_orderkey % 19 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    return decisions.reconcile(o, scored, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def artifact_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items refer to parts; parts of even keys are in the manifest. An order owns what it refers to."""
    refs = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat(F.lit("part/"), F.col("l_partkey")).alias("path"))
    manifest = views.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("path"))
    return decisions.missing_references(refs, manifest)


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cases = c.select(F.col("n_name").alias("row"), F.col("c_mktsegment").alias("col"), (F.col("c_acctbal") > 5000).alias("passed"))
    return decisions.coverage_matrix(cases, views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("row")), views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("col")).distinct(), 10)


def window_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.window_growth(views.signals(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line items are the chunks of its query; parts are the results. Some readers lose their session, some
    meet a hard stop."""
    li = views.table(spark, sf_dir, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    lost, hard = F.col("l_suppkey") % 5 == 0, F.col("l_suppkey") % 23 == 1
    keys = F.when((k < 2) | (k == 5) | lost, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))))
    return li.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("bigint").alias("seq"), F.when(lost, "error").when(k < 2, "timeout").otherwise("success").alias("read_status"),
        F.when(k == 10, "exhausted").when(k > 7, "unknown").otherwise("available").alias("continuation_status"),
        F.when(lost & (k == 3), "cli_error").when(lost, "session_expired").when(k == 10, "zero_results").otherwise("").alias("stop_reason"), F.when(hard, "captcha").otherwise("").alias("hard_stop"),
        keys.alias("keys"), F.slice(keys, 1, 1).alias("signals"), F.when(F.col("l_linestatus") == "F", F.slice(keys, 2, 1)).alias("details"),
    )


def chunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every query after its chunks, one after the other."""
    return chunks.fold_chunks(_chunks(spark, sf_dir), 6)


def chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_faults(_chunks(spark, sf_dir))


QUERIES = {
    "capped_topics": capped_topics, "opportunity_gates": opportunity_gates, "finding_evidence": finding_evidence, "platform_comparison": platform_comparison,
    "ledger_reconcile": ledger_reconcile, "artifact_refs": artifact_refs, "coverage_matrix": coverage_matrix, "window_growth": window_growth, "chunk_fold": chunk_fold, "chunk_faults": chunk_faults,
}

_CHUNKS = """c AS (SELECT l_orderkey AS query_id, CAST(l_linenumber AS BIGINT) AS seq, (l_orderkey + l_linenumber) % 11 AS k, l_suppkey % 5 = 0 AS lost, CASE WHEN l_suppkey % 23 = 1 THEN 'captcha' ELSE '' END AS hard,
  CASE WHEN k < 2 OR k = 5 OR lost THEN [] ELSE ['p' || l_partkey, 's' || l_suppkey] END AS ks, ks[1:1] AS sg, CASE WHEN l_linestatus = 'F' THEN ks[2:2] ELSE [] END AS dt, CASE WHEN lost THEN 'error' WHEN k < 2 THEN 'timeout' ELSE 'success' END AS status,
  CASE WHEN k = 10 THEN 'exhausted' WHEN k > 7 THEN 'unknown' ELSE 'available' END AS cont, CASE WHEN lost AND k = 3 THEN 'cli_error' WHEN lost THEN 'session_expired' WHEN k = 10 THEN 'zero_results' ELSE '' END AS stop FROM lineitem)"""
_CAPPED = f"""WITH {TOPICS_SQL}, audits AS (SELECT snapshot_id, {"CASE WHEN topic_key <> '' THEN topic_key ELSE query_layer || ':' || query_term END"} AS topic,
  CASE WHEN count(*) >= 3 AND count(DISTINCT CASE WHEN author_id <> '' THEN lower(author_id) END) >= 2 AND count(*) FILTER (detail_captured OR source_type IN ('direct_post', 'exported_item')) >= 1
    AND count(*) FILTER (semantic_relevance = 'direct') >= 2 AND count(*) FILTER (semantic_relevance <> 'weak') / count(*)::DOUBLE >= 0.8 AND count(*) FILTER (query_layer = 'subject_bridge') >= 1
    THEN 'passed' ELSE 'failed' END AS audit_status FROM signals GROUP BY ALL),
capped AS (SELECT t.*, audit_status, CAST(day(CAST(snapshot_id AS DATE)) AS INT) % 2 = 0 AS met, CASE WHEN day(CAST(snapshot_id AS DATE)) % 2 = 0 AND audit_status = 'passed' THEN 100 ELSE 54 END AS confidence_cap
  FROM topics t JOIN audits USING (snapshot_id, topic))"""
SQL = {
    "capped_topics": f"{_CAPPED} SELECT snapshot_id, topic, raw_confidence, audit_status, confidence_cap, least(raw_confidence, confidence_cap) AS evidence_confidence FROM capped",
    "opportunity_gates": f"""{_CAPPED}, p AS (SELECT snapshot_id, CASE WHEN topic_key <> '' THEN topic_key ELSE query_layer || ':' || query_term END AS topic, ordinal FROM signals),
g AS (SELECT p.*, audit_status, row_number() OVER (PARTITION BY p.snapshot_id, p.topic ORDER BY ordinal) AS nth, concat_ws(',', CASE WHEN NOT met THEN 'sampling_contract_completed' END, CASE WHEN ordinal % 3 = 0 THEN 'audience_relevance' END,
  CASE WHEN signal_count < 3 THEN 'minimum_independent_signals' END, CASE WHEN unique_author_count < 2 THEN 'minimum_independent_authors' END, CASE WHEN direct_source_count < 1 THEN 'direct_source_present' END,
  CASE WHEN subject_bridge_direct_count < 1 THEN 'subject_bridge_direct_evidence' END, CASE WHEN round_even(reviewed_count / signal_count::DOUBLE, 3) < 0.8 THEN 'semantic_relevance_reviewed' END,
  CASE WHEN audit_status <> 'passed' THEN 'cluster_audit_passed' END, CASE WHEN least(raw_confidence, confidence_cap) < 55 THEN 'confidence_threshold' END,
  CASE WHEN NOT (ordinal % 4 = 1 OR ordinal % 2 = 0) THEN 'counterevidence_review' END) AS failed_gates FROM p JOIN capped USING (snapshot_id, topic)),
r AS (SELECT *, CASE WHEN audit_status <> 'passed' THEN 'topic_not_eligible' WHEN nth > 1 THEN 'one_primary_opportunity_per_topic' ELSE '' END AS rejected FROM g)
SELECT snapshot_id, topic, ordinal, failed_gates, rejected, CASE WHEN rejected <> '' THEN 'rejected' WHEN failed_gates <> '' THEN 'candidate' WHEN ordinal % 5 = 0 THEN 'confirmed' ELSE 'review_ready' END AS status FROM r""",
    "finding_evidence": f"""WITH signals AS ({views.as_sql(views.SIGNALS)}) SELECT concat_ws('/', snapshot_id, author_id) AS finding_id, string_agg('https://x.test/' || content_id, ',' ORDER BY ordinal) AS urls, 'signal-none' AS unknown
FROM signals GROUP BY snapshot_id, author_id""",
    "platform_comparison": """WITH r AS (SELECT o_custkey AS study, count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'same' END) AS keys, list_sort(list(DISTINCT o_orderpriority)) AS platforms FROM orders GROUP BY ALL),
s AS (SELECT o_custkey AS study, year(o_orderdate) AS finding, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY ALL),
j AS (SELECT study, keys, platforms, count(p) AS shared_findings, count(*) FILTER (p <> platforms) AS incomplete FROM r LEFT JOIN s USING (study) GROUP BY ALL)
SELECT study, array_to_string(platforms, ',') AS platforms, shared_findings, CASE WHEN keys <> 1 THEN 'incompatible' WHEN len(platforms) < 2 THEN 'single_platform' WHEN incomplete > 0 THEN 'incomplete_finding'
  WHEN shared_findings = 0 THEN 'no_shared_finding' ELSE 'comparable' END AS comparison FROM j""",
    "ledger_reconcile": """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'lost' ELSE 'changed' END AS fault FROM orders WHERE o_orderkey % 13 = 0 OR (o_orderkey % 17 = 0 AND o_orderstatus <> '?')
UNION ALL SELECT -1 - o_orderkey, 'added' FROM orders WHERE o_orderkey % 19 = 0""",
    "artifact_refs": """WITH r AS (SELECT l_orderkey AS owner, l_partkey AS p FROM lineitem)
SELECT DISTINCT 'part/' || p AS path, 'absent' AS fault FROM r WHERE p NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)
UNION ALL SELECT 'part/' || p, 'claimed_twice' FROM r GROUP BY p HAVING count(DISTINCT owner) > 1""",
    "coverage_matrix": """WITH g AS (SELECT n_name AS "row", s AS col FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer)),
c AS (SELECT n_name, c_mktsegment, count(*) FILTER (c_acctbal > 5000) AS passed, count(*) AS cases FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT "row", col, coalesce(passed, 0) AS passed, coalesce(cases, 0) AS cases, CAST(greatest(0, 10 - coalesce(passed, 0)) AS BIGINT) AS missing, CASE WHEN coalesce(passed, 0) >= 10 THEN 'ready' ELSE 'blocked' END AS state
FROM g LEFT JOIN c ON n_name = "row" AND c_mktsegment = col""",
    "window_growth": f"""WITH signals AS ({views.as_sql(views.SIGNALS)}), g AS (SELECT topic_key, time_bucket(INTERVAL 7 DAY, published_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS current_window_count FROM signals WHERE topic_key <> '' GROUP BY ALL),
l AS (SELECT *, CASE WHEN lag(window_start) OVER w + INTERVAL 7 DAY = window_start THEN lag(current_window_count) OVER w END AS previous_window_count FROM g WINDOW w AS (PARTITION BY topic_key ORDER BY window_start))
SELECT *, round_even((current_window_count - previous_window_count) / greatest(previous_window_count, 1)::DOUBLE * 100, 3) AS growth_rate_percent FROM l""",
    "chunk_faults": f"""WITH {_CHUNKS}, d AS (SELECT *, len(ks) = 0 AS nothing, coalesce(min(CASE WHEN len(ks) > 0 THEN seq END) OVER (PARTITION BY query_id) < seq, false) AS later FROM c)
SELECT query_id, seq, 'error' AS fault FROM d WHERE status = 'error' AND hard = '' AND stop NOT IN ('cli_error', 'session_expired')
UNION ALL SELECT query_id, seq, 'zero_result' FROM d WHERE nothing AND status = 'success' AND NOT (cont = 'available' AND later) AND NOT (cont = 'exhausted' AND (hard <> '' OR stop = 'zero_results'))""",
    "chunk_fold": f"""WITH RECURSIVE {_CHUNKS}, o AS (SELECT *, CASE WHEN status = 'timeout' THEN 'unknown' ELSE cont END AS going, CASE WHEN status = 'timeout' THEN '' ELSE stop END AS own,
  row_number() OVER (PARTITION BY query_id ORDER BY seq, status, cont, stop, hard, ks, sg, dt) AS i FROM c),
f AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, []::VARCHAR[] AS keys, []::VARCHAR[] AS sgs, []::VARCHAR[] AS dts, CAST(0 AS BIGINT) AS timeouts, CAST(0 AS BIGINT) AS unknowns, CAST(0 AS BIGINT) AS empties, CAST(0 AS BIGINT) AS restarts, '' AS reason FROM c
UNION ALL SELECT query_id, i, keys, sgs, dts, timeouts, unknowns, empties, restarts, CASE WHEN hard <> '' THEN hard WHEN status = 'timeout' AND timeouts >= 2 THEN 'repeated_timeout'
    WHEN (was_unknown AND unknowns >= 2) OR (was_empty AND empties >= 2) THEN 'continuation_unresolved' WHEN was_lost AND restarts >= 2 THEN 'session_recovery_failed' WHEN own = 'cli_error' THEN own
    WHEN len(keys) >= 6 THEN 'query_target_met' WHEN going = 'exhausted' THEN CASE WHEN own = 'zero_results' THEN own ELSE 'results_exhausted' END ELSE '' END
  FROM (SELECT query_id, i, own, hard, status, going, keys, sgs, dts, was_unknown, was_empty, was_lost, timeouts + CAST(status = 'timeout' AS BIGINT) AS timeouts, unknowns + CAST(was_unknown AS BIGINT) AS unknowns,
      CASE WHEN len(ks) > 0 THEN 0 ELSE empties + CAST(was_empty AS BIGINT) END AS empties, restarts + CAST(was_lost AS BIGINT) AS restarts
    FROM (SELECT o.query_id, o.i, own, hard, status, going, ks, f.timeouts, f.unknowns, f.empties, f.restarts, list_concat(f.keys, list_filter(ks, lambda x: NOT list_contains(f.keys, x))) AS keys,
        list_concat(sgs, list_filter(sg, lambda x: NOT list_contains(f.sgs, x))) AS sgs, list_concat(dts, list_filter(dt, lambda x: NOT list_contains(f.dts, x))) AS dts,
        status = 'success' AND hard = '' AND going = 'unknown' AND len(list_distinct(list_concat(f.keys, ks))) < 6 AS was_unknown,
        status = 'success' AND len(ks) = 0 AND going = 'available' AND len(f.keys) > 0 AS was_empty, status = 'error' AND own = 'session_expired' AND hard = '' AS was_lost
      FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1 WHERE f.reason = ''))),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1)
SELECT query_id, i AS chunks, len(keys) AS observed, len(sgs) AS signals, len(dts) AS details, timeouts, unknowns, restarts, reason AS stop_reason, CASE WHEN reason = '' THEN '' WHEN reason IN ('continuation_unresolved', 'repeated_timeout', 'cli_error', 'session_recovery_failed')
  THEN 'completed_partial' WHEN len(keys) = 0 THEN 'completed_with_zero_results' ELSE 'completed_with_results' END AS outcome, reason <> '' AS done FROM l""",
}
