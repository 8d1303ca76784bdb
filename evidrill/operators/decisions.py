"""Decisions: gates of opportunities, findings against their profile, comparisons, ledger reconciliation, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

INTERNAL_TOPICS = ("unreviewed", "excluded-keyword-collision", "reviewed-unclustered")


def eligible_topic(topic: Column, audit: Column, mode: Column) -> Column:
    return ~topic.isin(*INTERNAL_TOPICS) & ((audit == "passed") | ((mode == "quick") & (audit == "not_required")))


def opportunity_gates(proposals: DataFrame, topics: DataFrame) -> DataFrame:
    """proposals: snapshot_id, topic, ordinal, title, audience, task_gap, subject_entry, expected_action, support_refs,
    counter_refs, counter_search_status, semantic_review, risk_boundaries, confirmed. topics: the topic index with
    audit_status and mode. Each proposal gets its failed gates and a status; the first of a topic is primary."""
    p = proposals.join(topics, ["snapshot_id", "topic"], "left")
    found = F.size("counter_refs") > 0
    gates = {
        "sampling_contract_completed": F.col("contract_status") == "met",
        "audience_relevance": F.col("audience") != "",
        "task_continuity": (F.col("task_gap") != "") & (F.col("subject_entry") != ""),
        "subject_boundary": F.size("risk_boundaries") > 0,
        "supporting_evidence": F.size("support_refs") > 0,
        "minimum_independent_signals": F.col("signal_count") >= 3,
        "minimum_independent_authors": F.col("unique_author_count") >= 2,
        "direct_source_present": F.col("direct_source_count") >= 1,
        "subject_bridge_direct_evidence": F.col("subject_bridge_direct_count") >= 1,
        "semantic_relevance_reviewed": F.col("review_coverage") >= 0.8,
        "cluster_audit_passed": F.col("audit_status").isin("passed", "not_required"),
        "confidence_threshold": F.col("evidence_confidence") >= 55,
        "counterevidence_review": (found & (F.col("counter_search_status") == "found")) | (F.col("counter_search_status") == "searched_none_found"),
        "semantic_link_review": F.col("semantic_review").isin("agent_reviewed", "human_reviewed"),
        "concrete_action": F.col("expected_action") != "",
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in gates.items()]))
    missing = F.col("signal_count").isNull() | ~F.coalesce(eligible_topic(F.col("topic"), F.col("audit_status"), F.col("mode")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("snapshot_id", "topic").orderBy("ordinal"))
    p = p.withColumns({"failed_gates": failed, "rejected": F.when(missing, "topic_not_eligible").when(nth > 1, "one_primary_opportunity_per_topic").otherwise("")})
    status = F.when(F.col("rejected") != "", "rejected").when(F.size("failed_gates") > 0, "candidate").when(F.col("confirmed"), "confirmed").otherwise("review_ready")
    return p.withColumn("status", status)


def finding_evidence(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """findings: finding_id, snapshot_id, refs (signal ids). Adds the addresses in the order of the refs and the ids
    that no signal has."""
    r = findings.select("finding_id", "snapshot_id", F.posexplode("refs").alias("at", "signal_id"))
    j = r.join(signals.select("snapshot_id", "signal_id", "url"), ["snapshot_id", "signal_id"], "left")
    g = j.groupBy("finding_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("at", "url")))), lambda x: x["url"]).alias("urls"),
        F.array_sort(F.collect_list(F.when(F.col("url").isNull(), F.col("signal_id")))).alias("unknown"),
    )
    return findings.join(g, "finding_id", "left")


def disjoint_refs(a: Column, b: Column) -> Column:
    """Do two lists of references, fragments and trailing slashes aside, share none?"""
    plain = lambda x: F.transform(x, lambda r: F.lower(F.regexp_replace(F.substring_index(r, "#", 1), "/+$", "")))
    return ~F.coalesce(F.arrays_overlap(plain(a), plain(b)), F.lit(False))


def platform_comparison(reports: DataFrame, shared: DataFrame) -> DataFrame:
    """reports: study, platform, compatibility_key. shared: study, finding, platforms. A study can be compared if all
    its reports have one key and every shared finding names exactly its platforms. Scores are never combined."""
    r = reports.groupBy("study").agg(F.count_distinct("compatibility_key").alias("keys"), F.array_sort(F.collect_set("platform")).alias("platforms"))
    s = shared.join(r.select("study", F.col("platforms").alias("_all")), "study").groupBy("study").agg(
        F.count(F.lit(1)).alias("shared_findings"), F.count_if(F.array_sort(F.array_distinct("platforms")) != F.col("_all")).alias("incomplete")
    )
    j = r.join(s, "study", "left").na.fill(0, ["shared_findings", "incomplete"])
    status = F.when(F.col("keys") != 1, "incompatible").when(F.size("platforms") < 2, "single_platform").when(F.col("incomplete") > 0, "incomplete_finding").when(
        F.col("shared_findings") == 0, "no_shared_finding").otherwise("comparable")
    return j.withColumn("comparison", status)


def reconcile(raw: DataFrame, scored: DataFrame, key: list[str], kept: list[str]) -> DataFrame:
    """Rows of the raw ledger that the scored one lost or changed, and those that it added: (key, fault)."""
    a, b = raw.select(*key, F.struct(*kept).alias("_a")), scored.select(*key, F.struct(*kept).alias("_b"))
    j = a.join(b, key, "full_outer")
    fault = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "added").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(*key, fault.alias("fault")).where("fault IS NOT NULL")


def ledger_digest(ledger: DataFrame, columns: list[str], by: str = "snapshot_id") -> DataFrame:
    """Per snapshot the number of rows and two sums of their hashes, 128 bits together: equal for equal rows in any order,
    so that ledgers are told apart without being joined. Sums of parts add up."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns]).cast("decimal(38,0)"))
    return ledger.groupBy(by).agg(F.count(F.lit(1)).alias("n"), h(1).alias("h1"), h(2).alias("h2"))


def changed_snapshots(a: DataFrame, b: DataFrame, columns: list[str], by: str = "snapshot_id") -> DataFrame:
    """Snapshots whose rows differ."""
    x, y = (ledger_digest(d, columns, by).select(by, F.struct("n", "h1", "h2").alias(name)) for d, name in ((a, "x"), (b, "y")))
    return x.join(y, by, "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(by)


def reconcile_changed(raw: DataFrame, scored: DataFrame, key: list[str], kept: list[str], by: str = "snapshot_id") -> DataFrame:
    """As `reconcile`, but rows are compared in changed snapshots alone."""
    changed = changed_snapshots(raw, scored, [*dict.fromkeys([by, *key, *kept])], by)
    return reconcile(raw.join(changed, by, "left_semi"), scored.join(changed, by, "left_semi"), key, kept)


def _sums(signals: DataFrame) -> DataFrame:
    each = signals.groupBy("snapshot_id", "signal_key").agg(F.bool_or("detail_captured").alias("d"), F.bool_or(F.col("evidence_role") == "counter").alias("c"))
    return each.groupBy("snapshot_id").agg(F.count_if("d").alias("details"), F.count_if("c").alias("counters"))


def ledger_faults(raw: DataFrame, stored: DataFrame, reviewed: DataFrame, report: DataFrame, audits: DataFrame) -> DataFrame:
    """Three ledgers of each snapshot held against each other, a row for each broken rule (snapshot_id, fault).

    raw and reviewed: snapshot_id, signal_key, content_id, detail_captured, evidence_role, semantic_relevance, topic_key,
    review. stored: snapshot_id, details, counters (the raw ledger's own counts). report: snapshot_id, details, counters,
    contract_status, stop_reason (of the reviewed ledger). audits: snapshot_id, success, content_ids, details. Details that the
    reviewed ledger has and the raw one hasn't need a successful audit, which names them or, if none names any, counts
    enough; opened signals keep their review, role and topic. Both ledgers are grouped by signal in one pass, and everything
    else goes by the rows of that, which are written."""
    key = ["snapshot_id", "signal_key"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    seen, counter = F.col("detail_captured"), F.col("evidence_role") == "counter"
    lost = seen & (blank("evidence_role") | blank("review") | (F.col("semantic_relevance").isin("direct", "adjacent") & blank("topic_key")))
    null = lambda kind: F.lit(None).cast(kind)
    x = raw.select(*key, seen.alias("d"), counter.alias("c"), null("boolean").alias("d2"), null("boolean").alias("c2"), null("boolean").alias("lost"), null("string").alias("content_id"))
    y = reviewed.select(*key, null("boolean").alias("d"), null("boolean").alias("c"), seen.alias("d2"), counter.alias("c2"), lost.alias("lost"), F.when(seen, F.col("content_id").cast("string")).alias("content_id"))
    each = x.unionByName(y).groupBy(*key).agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in ("d", "c", "d2", "c2", "lost")], F.min("content_id").alias("content_id"))
    new = F.col("d2") & ~F.col("d") & F.col("snapshot_id").isNotNull()
    each = staged(each.select("snapshot_id", "d", "c", "d2", "c2", "lost", new.alias("new"), F.when(new, F.col("content_id")).alias("content_id")), "ledger-signals")
    counts = {"d": "raw_details", "c": "raw_counters", "d2": "report_details", "c2": "report_counters", "new": "appended"}
    per = staged(each.groupBy("snapshot_id").agg(*[F.count_if(n).alias(v) for n, v in counts.items()], F.bool_or("lost").alias("lost")), "ledger-snapshots")

    def miscounted(counts: DataFrame, name: str, **more: Column) -> DataFrame:
        j = counts.join(per, "snapshot_id", "left")
        rules = {f"{name}_{c}": zero(c) != zero(f"{name}_{c}") for c in ("details", "counters")} | more
        return j.select("snapshot_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("fault"))

    good = staged(audits.where("success").select("snapshot_id", "content_ids", "details"), "ledger-audits")
    ids = good.select("snapshot_id", F.explode("content_ids").alias("content_id")).where("content_id <> ''").distinct()
    audited = good.groupBy("snapshot_id").agg(F.sum(F.coalesce("details", F.lit(0))).alias("n"), F.count(F.lit(1)).alias("audits"))
    named = ids.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("named"))
    missing = each.where("new AND content_id <> ''").join(ids, ["snapshot_id", "content_id"], "left_anti").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("missing"))
    s = per.where("appended > 0").join(audited, "snapshot_id", "left").join(named, "snapshot_id", "left").join(missing, "snapshot_id", "left")
    fault = F.when(zero("audits") == 0, "no_audit").when((zero("named") > 0) & (zero("missing") > 0), "unaudited_detail").when((zero("named") == 0) & (zero("n") < F.col("appended")), "audit_count")
    stopped = (F.col("contract_status") == "met") & (F.coalesce("stop_reason", F.lit("")) != "sampling_contract_met")
    parts = [
        miscounted(stored, "raw"), miscounted(report, "report", stop_reason=stopped), s.select("snapshot_id", fault.alias("fault")).where("fault IS NOT NULL"),
        per.where("lost").select("snapshot_id", F.lit("lost_review").alias("fault")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_references(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """refs: owner, path. References without an entry in the manifest (path), and paths that two owners claim."""
    absent = refs.join(manifest.select("path").distinct(), "path", "left_anti").select("path", F.lit("absent").alias("fault"))
    twice = refs.groupBy("path").agg(F.count_distinct("owner").alias("n")).where("n > 1").select("path", F.lit("claimed_twice").alias("fault"))
    return absent.distinct().unionByName(twice)


def coverage_matrix(cases: DataFrame, rows: DataFrame, columns: DataFrame, required: int) -> DataFrame:
    """cases: row, col, passed. Every row by every column of two small dimensions, with what passed and what lacks."""
    grid = rows.crossJoin(columns)  # two dimensions of a fixed size
    passed = cases.groupBy("row", "col").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("cases"))
    g = grid.join(passed, ["row", "col"], "left").na.fill(0)
    return g.withColumn("missing", F.greatest(F.lit(0), F.lit(required) - F.col("passed")).cast("bigint")).withColumn("state", F.when(F.col("missing") == 0, "ready").otherwise("blocked"))


def window_growth(signals: DataFrame, days: int = 7) -> DataFrame:
    """Per topic and window: its count, the one before it and the growth in percent (null without one before)."""
    w = F.window("published_at", f"{days} days")
    g = signals.where("topic_key <> ''").groupBy("topic_key", w.alias("w")).agg(F.count(F.lit(1)).alias("current_window_count"))
    before = Window.partitionBy("topic_key").orderBy("w.start")
    adjacent = F.lag("w.end").over(before) == F.col("w.start")
    g = g.withColumn("previous_window_count", F.when(adjacent, F.lag("current_window_count").over(before)))
    rate = F.bround((F.col("current_window_count") - F.col("previous_window_count")) / F.greatest("previous_window_count", F.lit(1)) * 100, 3)
    return g.select("topic_key", F.col("w.start").alias("window_start"), "current_window_count", "previous_window_count", rate.alias("growth_rate_percent"))
