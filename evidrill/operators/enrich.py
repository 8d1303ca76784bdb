"""Details and comments that come later, joined back to the signals they belong to; merges of whole snapshots; what a
report says about its basis; rules on subjects, contexts and reports.

Whatever breaks a rule is a row or an entry of `faults`, as a table has no place for an error of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import scalars as S
from ..functions.constants import QUERY_LAYERS, RELEVANCE_RANK
from ..sources.staging import staged
from . import dedup
from .collection import contract

# Words of failure logs, in order, for the three kinds of readers.
FAILURES = {
    "command": (
        ("captcha", ("captcha", "验证码", "安全验证")), ("rate_limit", ("rate limit", "too many requests", "429", "频控")), ("login_expired", ("login_required", "not logged in", "登录失效")),
        ("permission_prompt", ("permission", "access denied", "403")), ("abnormal_redirect", ("abnormal redirect", "redirect loop", "页面错配")),
    ),
    "session": (
        ("session_expired", ("session not found or expired", "session expired")), ("captcha", ("captcha",)), ("rate_limit", ("rate limit", "too many requests", "429")), ("login_expired", ("login expired", "sign in", "not logged in")),
        ("permission_prompt", ("permission", "access denied", "403")), ("abnormal_redirect", ("abnormal redirect", "redirect loop")),
    ),
    "analyzer": (
        ("safety_stop", ("captcha", "rate limit", "too many requests")), ("authorization_required", ("login", "sign in", "cookie", "private video", "forbidden", "permission")), ("timeout", ("timed out", "timeout")),
    ),
}
OTHERWISE = {"command": "cli_error", "session": "cli_error", "analyzer": "analyzer_error"}


def failure(log: Column, kind: str) -> Column:
    """What a log says went wrong: the first class one of whose words it holds."""
    t, out = F.lower(log), None
    for name, words in FAILURES[kind]:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if kind == "analyzer":
        out = out.when(t.contains("npm warn cleanup") & t.contains("eperm"), "runtime_install_error")
    return F.coalesce(out.otherwise(OTHERWISE[kind]), F.lit(OTHERWISE[kind]))


def comment_target(url: Column, content_id: Column, handle: Column, detail: Column, source_type: Column, comments: Column, capture_status: Column) -> Column:
    """May a video's comments be read: its address names it, its details are there, its comments aren't yet."""
    who = A.tiktok_identity(url)
    stored, author = S.text(content_id), F.regexp_replace(S.text(handle), "^@+", "")
    same = who.isNotNull() & ((stored == "") | (stored == who["content_id"])) & ((author == "") | (F.lower(author) == F.lower(who["handle"])))
    return F.coalesce(same & (F.coalesce(detail, F.lit(False)) | (S.text(source_type) == "direct_post")) & (F.coalesce(F.size(comments), F.lit(0)) <= 0) & (S.text(capture_status) != "captured"), F.lit(False))


def with_comments(signals: DataFrame, captured: DataFrame) -> DataFrame:
    """signals: signal_key, evidence_refs, limitations. captured: signal_key, status, comments, artifact. Captured comments
    become part of their signal, which loses the notes on missing ones."""
    c = captured.where("status = 'captured'").select("signal_key", F.col("comments").alias("representative_comments"), F.col("artifact").alias("_artifact"))
    j = signals.join(c, "signal_key", "left")
    seen = F.col("_artifact").isNotNull()
    stale = lambda x: F.lower(x).contains("comment text was visible") | F.lower(x).contains("comment text was unavailable")
    return j.withColumns({
        "comment_capture_status": F.when(seen, "captured").otherwise("unavailable"), "evidence_refs": F.when(seen, F.array_union("evidence_refs", F.array("_artifact"))).otherwise(F.col("evidence_refs")),
        "limitations": F.when(seen, F.filter("limitations", lambda x: ~stale(x))).otherwise(F.col("limitations")),
    }).drop("_artifact")


def _address(c: Column) -> Column:
    return F.regexp_replace(F.replace(S.text(c), F.lit("https://reddit.com/"), F.lit("https://www.reddit.com/")), "/+$", "")


def permalink_details(signals: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """signals: snapshot_id, content_id, platform, canonical_url, summary, source_type, detail_captured, limitations.
    entries: snapshot_id, content_id, canonical_url, body_text, body_text_kind, captured_at, source_mode. The signals with
    the bodies read at their permalinks, and the entries that break a rule, which change nothing."""
    key = ["snapshot_id", "content_id"]
    e = entries.select(*key, _address(F.col("canonical_url")).alias("_url"), S.text(F.col("body_text")).alias("_body"), S.text(F.col("body_text_kind")).alias("_kind"), S.text(F.col("captured_at")).alias("_at"), S.text(F.col("source_mode")).alias("_mode"))
    e = e.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    j = e.join(signals.select(*key, F.col("platform").alias("_platform"), _address(F.col("canonical_url")).alias("_own")), key, "left")
    rules = {
        "content_id": (S.text(F.col("content_id")) == "") | (F.col("_n") > 1) | F.col("_own").isNull(), "canonical_url": F.coalesce((F.col("_platform") != "reddit") | (F.col("_own") != F.col("_url")), F.lit(True)),
        "body": (F.col("_body") == "") | ~F.col("_kind").isin("verbatim_excerpt", "agent_summary") | (F.col("_at") == "") | (F.col("_mode") != "public_web"),
    }
    j = j.withColumn("faults", F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])))
    good = j.where(F.size("faults") == 0).select(*key, "_body", "_kind")
    out = signals.join(good, key, "left")
    seen = F.col("_body").isNotNull()
    out = out.withColumns({
        "detail_captured": seen | F.col("detail_captured"), "source_type": F.when(seen, "direct_post").otherwise(F.col("source_type")), "summary": F.coalesce("_body", "summary"), "detail_text_kind": F.coalesce("_kind", F.lit("")),
        "limitations": F.when(seen, F.filter("limitations", lambda x: ~x.contains("post body was not returned"))).otherwise(F.col("limitations")),
    }).drop("_body", "_kind")
    return out, j.where(F.size("faults") > 0).select(*key, F.explode("faults").alias("fault")).distinct()


def detail_results(signals: DataFrame, targets: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """signals as `dedup.merge_duplicates` takes them. targets: snapshot_id, dedupe_key, layer. results: snapshot_id,
    dedupe_key, seq, success, stop_reason, artifact and, for a success, the fields of a signal, null where the page
    doesn't show them. Only planned targets count; a success is folded into its signal, with what it lacks taken from
    it; attempts are one row for each (key, artifact, success). Successes are written once, as merging reads its rows twice."""
    key = ["snapshot_id", "dedupe_key"]
    planned = results.join(targets.select(*key, "layer").distinct(), key)
    audits = planned.groupBy(*key, "artifact", "success").agg(F.min_by(F.struct("layer", "stop_reason"), "seq").alias("x")).select(*key, "artifact", "success", "x.*")
    names = ("signal_id", "query_term", "query_layer")  # of the first observation
    own = signals.groupBy("dedupe_key", "snapshot_id").agg(F.min(F.struct("ordinal", *names)).alias("x")).select(*key, *[F.col(f"x.{c}").alias("_" + c) for c in names])
    d = planned.where("success").join(own, key)
    filled = {c: F.coalesce(F.col(c), F.col("_" + c)) for c in ("signal_id", "query_term", "query_layer")}
    d = d.withColumns({**filled, "source_type": F.coalesce(S.first(F.col("source_type")), F.lit("direct_post")), "detail_captured": F.lit(True), "ordinal": F.col("seq") + F.lit(1 << 40)})
    d = staged(d.select(*signals.columns), "details")
    return dedup.merge_duplicates(signals.unionByName(d)), audits


def retained(signals: DataFrame) -> DataFrame:
    """Signals that a merge takes: with details, or at least a summary."""
    return signals.where(F.coalesce(F.col("detail_captured"), F.lit(False)) | (S.text(F.col("summary")) != ""))


def snapshot_runs(snapshots: DataFrame, signals: DataFrame) -> DataFrame:
    """snapshots: study, snapshot_id, query_term, query_layer, observed. One query run for each snapshot, with what was
    observed (at least by its own count of signals where unknown), retained and opened."""
    g = retained(signals).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("retained_signal_count"), F.count_if("detail_captured").alias("detail_open_count"))
    j = snapshots.join(g, "snapshot_id", "left").na.fill(0, ["retained_signal_count", "detail_open_count"])
    j = j.withColumn("observed_result_count", F.coalesce(F.when(F.col("observed") > 0, F.col("observed")), F.col("retained_signal_count")))
    return j.withColumn("discarded_result_count", F.greatest(F.lit(0), F.col("observed_result_count") - F.col("retained_signal_count")).cast("bigint")).drop("observed")


def merge_faults(snapshots: DataFrame, signals: DataFrame) -> DataFrame:
    """snapshots: study, snapshot_id, subject, query_term, query_layer. signals: snapshot_id, signal_id, canonical_url. Why
    the snapshots of a study can't be merged: (study, fault)."""
    s = snapshots.groupBy("study").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(S.text(F.col("subject")))).alias("subjects"), F.count_if(S.text(F.col("subject")) == "").alias("nameless"),
        F.count_distinct(F.struct(F.lower(S.text(F.col("query_term"))), "query_layer")).alias("queries"), F.count_if((S.text(F.col("query_term")) == "") | ~F.col("query_layer").isin(*QUERY_LAYERS)).alias("bad"),
        F.array_sort(F.collect_set("query_layer")).alias("layers"),
    )
    rules = {
        "snapshots": F.col("n") < 3, "subject": (F.col("subjects") != 1) | (F.col("nameless") > 0), "queries": (F.col("queries") < F.col("n")) | (F.col("bad") > 0),
        "layers": F.col("layers") != F.array(*[F.lit(x) for x in sorted(QUERY_LAYERS)]),
    }
    own = s.select("study", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("fault"))
    held = retained(signals).join(snapshots.select("study", "snapshot_id"), "snapshot_id").groupBy("study", "signal_id").agg(
        F.min(S.text(F.col("canonical_url"))).alias("a"), F.max(S.text(F.col("canonical_url"))).alias("b"))
    urls = held.groupBy("study").agg(F.bool_or((S.text(F.col("signal_id")) == "")).alias("unnamed"), F.bool_or(F.col("a") != F.col("b")).alias("urls"))
    more = F.array_compact(F.array(F.when(F.col("unnamed"), "signal_id"), F.when(F.col("urls"), "canonical_url")))
    return own.unionByName(urls.select("study", F.explode(more).alias("fault")))


def merge_totals(runs: DataFrame) -> DataFrame:
    """Per study, from `snapshot_runs`: runs, observed and retained results, opened details."""
    return runs.groupBy("study").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("observed_result_count").cast("bigint").alias("observed_total"), F.sum("retained_signal_count").cast("bigint").alias("retained_total"),
        F.sum("detail_open_count").cast("bigint").alias("detail_total"),
    )


def comment_queue(comments: DataFrame) -> DataFrame:
    """comments: snapshot_id, signal_key, comment_index, text. Adds a key for each comment that has text."""
    t = S.text(F.col("text"))
    digest = F.sha2(F.concat("signal_key", F.lit("\n"), F.col("comment_index").cast("string"), F.lit("\n"), t), 256)
    return comments.withColumn("text", t).where("text <> ''").withColumn("comment_key", F.concat(F.lit("comment-"), F.substring(digest, 1, 20)))


def queue_digest(queue: DataFrame, by: list[str], order: list[str], entry: list[str]) -> DataFrame:
    """A digest of each queue's entries in their order; equal in every run over equal entries."""
    row = F.to_json(F.struct(*entry), {"ignoreNullFields": "false"})
    g = queue.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_list(F.struct(*order, row.alias("_json")))).alias("rows"))
    return g.select(*by, "entries", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["_json"]), ","), F.lit("]")), 256).alias("queue_sha256"))


def collection_summary(status: DataFrame, signals: DataFrame) -> DataFrame:
    """status: snapshot_id and the ledger's counts, contract_status and stop_reason (from `collection_status`). signals:
    snapshot_id, semantic_relevance, evidence_role, detail_captured. Counts made anew from signals go before the ledger's."""
    s = signals.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("_unique"), F.count_if(F.col("semantic_relevance").isin("direct", "adjacent")).alias("relevant_signal_count"), F.count_if(F.col("evidence_role") == "counter").alias("_counter"), F.count_if("detail_captured").alias("_detail"),
    )
    j = status.join(s, "snapshot_id", "left")
    complete = (F.col("contract_status") == "met") & F.coalesce("stop_reason", F.lit("")).isin("", "sampling_contract_met")
    return j.select(
        "snapshot_id", "query_count", "observed_result_count", F.coalesce("_unique", "unique_sample_count").alias("unique_signal_count"), "relevant_signal_count", F.coalesce("_detail", "detail_open_count").alias("detail_open_count"),
        F.coalesce("_counter", "counter_signal_count").alias("counter_signal_count"), F.when(complete, "complete").otherwise("bounded").alias("sampling_status"),
    )


def gap_tasks(status: DataFrame, layers: DataFrame, indexed: DataFrame) -> DataFrame:
    """Everything that a snapshot lacks, as tasks in order: a failed contract, layers without enough details, a bridge
    without direct evidence, then each missing field with how many signals lack it. status: snapshot_id, contract_status,
    failed_checks. layers: snapshot_id, mode, query_layer, detail_open_count, direct_relevance_count. indexed: snapshot_id,
    signal_id, missing_fields."""
    m = F.col("mode")
    row = lambda d, rank, at, field, affected, priority: d.select("snapshot_id", F.lit(rank).alias("kind"), at.alias("at"), field.alias("field"), affected.alias("affected"), priority.alias("priority"))
    none, high = F.lit(0).cast("bigint"), F.lit("high")
    failed = row(status.where("contract_status <> 'met'"), 1, none, F.lit("collection.sampling_contract"), none, high)
    place = F.array_position(F.array(*map(F.lit, QUERY_LAYERS)), F.col("query_layer")).cast("bigint")
    shallow = row(layers.where(F.col("detail_open_count") < contract(m, "layer_detail_min")), 2, place, F.concat(F.lit("collection.layer."), "query_layer", F.lit(".detail_opens")), none, high)
    bridge = layers.where((F.col("query_layer") == "subject_bridge") & (F.col("direct_relevance_count") < contract(m, "subject_bridge_direct_min")))
    bridge = row(bridge, 3, none, F.lit("collection.layer.subject_bridge.direct_relevance"), none, high)
    # a null beside the fields counts the signals themselves, in the same pass
    each = F.concat(F.coalesce("missing_fields", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    g = indexed.select("snapshot_id", F.explode(each).alias("field")).groupBy("snapshot_id", "field").agg(F.count(F.lit(1)).alias("affected"))
    g = g.groupBy("snapshot_id").agg(F.max(F.when(F.col("field").isNull(), F.col("affected"))).alias("signals"), F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "affected"))).alias("fields"))
    g = g.select("snapshot_id", "signals", F.inline("fields"))
    fields = row(g, 4, -F.col("affected"), F.col("field"), F.col("affected"), F.when(F.col("affected") == F.col("signals"), "high").otherwise("medium"))
    order = Window.partitionBy("snapshot_id").orderBy("kind", "at", "field")
    every = failed.unionByName(shallow).unionByName(bridge).unionByName(fields)
    return every.withColumn("task_rank", F.row_number().over(order)).select("snapshot_id", "task_rank", "field", "affected", "priority")


def affected_signals(indexed: DataFrame) -> DataFrame:
    """(snapshot_id, field, signal_id) for each field that a signal lacks: the ids behind the tasks' counts."""
    return indexed.select("snapshot_id", F.explode("missing_fields").alias("field"), "signal_id")


def topic_basis(runs: DataFrame, signals: DataFrame) -> DataFrame:
    """runs: study, query_layer, observed_result_count, pass_count, overlap. signals: study, layers, semantic_relevance,
    evidence_role, detail_captured, comment_count. What a topic study rests on, and its ten checks."""
    rank = S.lookup(F.col("semantic_relevance"), RELEVANCE_RANK, 0)
    s = signals.withColumn("_rank", rank)
    g = s.groupBy("study").agg(
        F.count(F.lit(1)).alias("unique_count"), F.count_if("detail_captured").alias("detail_count"), F.count_if(F.col("_rank") >= 2).alias("relevant_count"), F.count_if(F.col("_rank") > 0).alias("reviewed_count"),
        F.count_if(F.col("evidence_role") == "counter").alias("counter_count"), F.sum("comment_count").cast("bigint").alias("visible_comment_count"),
        F.count_if(F.array_contains("layers", "subject_bridge") & (F.col("_rank") == 3) & F.col("detail_captured")).alias("bridge_count"),
    )
    per = s.withColumn("query_layer", F.explode(F.array_distinct("layers"))).groupBy("study", "query_layer").agg(
        F.count(F.lit(1)).alias("u"), F.count_if(F.col("_rank") >= 2).alias("r"), F.count_if(F.col("_rank") == 3).alias("d"), F.count_if("detail_captured").alias("o"))
    ran = runs.groupBy("study", "query_layer").agg(F.count(F.lit(1)).alias("q"), F.sum("observed_result_count").alias("n"))
    fine = (F.col("q") >= 1) & (F.col("n") >= 8) & (F.col("u") >= 4) & (F.col("r") >= 4) & (F.col("d") >= 2) & (F.col("o") >= 2)
    layers = ran.join(per, ["study", "query_layer"]).where(F.col("query_layer").isin(*QUERY_LAYERS)).groupBy("study").agg(F.count_if(fine).alias("fine_layers"))
    r = runs.groupBy("study").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("observed_result_count").cast("bigint").alias("observed_count"), F.min("pass_count").alias("repeat_pass_count"), F.bround(F.avg("overlap"), 4).alias("repeat_overlap"))
    j = r.join(g, "study", "left").join(layers, "study", "left").na.fill(0, ["unique_count", "detail_count", "relevant_count", "reviewed_count", "counter_count", "visible_comment_count", "bridge_count", "fine_layers"])
    checks = {
        "query_count": F.col("query_count") >= 3, "observed_volume": F.col("observed_count") >= 60, "unique_volume": F.col("unique_count") >= 30, "detail_volume": F.col("detail_count") >= 12, "relevant_volume": F.col("relevant_count") >= 18,
        "counterevidence": F.col("counter_count") >= 3, "review_coverage": F.col("reviewed_count") / F.greatest("unique_count", F.lit(1)) >= 0.8, "repeatability": F.col("repeat_pass_count") >= 2, "direct_subject_bridge": F.col("bridge_count") >= 2,
        "per_layer_quality": F.col("fine_layers") == len(QUERY_LAYERS),
    }
    j = j.withColumn("failed_checks", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), k) for k, c in checks.items()])))
    return j.withColumn("sampling_status", F.when(F.size("failed_checks") == 0, "complete").otherwise("bounded")).drop("fine_layers")


def account_basis(signals: DataFrame) -> DataFrame:
    """Per account: posts observed and opened, and visible comments."""
    return signals.groupBy("account").agg(
        F.count(F.lit(1)).alias("observed_post_count"), F.count_if("detail_captured").alias("detail_post_count"), F.sum(F.greatest(F.lit(0), F.size("representative_comments"))).cast("bigint").alias("visible_comment_count"))


def decision_readiness(findings: DataFrame) -> DataFrame:
    """findings: study, conclusion_status, snapshots. How many findings are ready, and over how many snapshots."""
    ready = F.count_if(F.col("conclusion_status").isin("review_ready", "confirmed"))
    return findings.groupBy("study").agg(
        ready.alias("ready_findings"), F.count(F.lit(1)).alias("total_findings"), F.when(ready > 0, "actionable_test").otherwise("exploratory").alias("status"), F.max(F.coalesce("snapshots", F.lit(1))).alias("compatible_snapshot_count"))


def excluded_topics(audits: DataFrame) -> DataFrame:
    """Topics whose cluster failed its audit (snapshot_id, cluster, audit_status, failed_checks), with the failed gates
    in order of their names."""
    return audits.where("audit_status = 'failed'").select("snapshot_id", F.col("cluster").alias("topic"), F.lit("cluster_audit_failed").alias("reason"), F.array_sort("failed_checks").alias("failed_gates"))


# What a subject may say.
SUBJECT = {
    "language": ("auto", "zh-CN", "en"), "goal": ("validate_business_opportunity", "validate_product_demand", "discover_content_opportunities", "understand_trend", "general_research"), "audience": ("general", "expert"),
    "origin": ("user_premise", "model_inference"),
}


def subject_faults(subjects: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """subjects: subject_id, name, summary, subject_type, language, goal, audience, facts (statement, source_refs),
    hypotheses (text, statement, origin). Broken rules, one row each, with the entry's place for facts and hypotheses."""
    blank = lambda c: S.text(c) == ""
    rules = {"name": blank(F.col("name")), "summary": blank(F.col("summary")), "subject_type": ~F.coalesce(F.col("subject_type").isin(*types), F.lit(False))} | {
        k: ~F.coalesce(F.col(k), F.lit(SUBJECT[k][0] if k != "goal" else "general_research")).isin(*SUBJECT[k]) for k in ("language", "goal", "audience")}
    own = F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))
    facts = F.transform("facts", lambda x, i: F.when(x.isNull() | blank(x["statement"]), F.concat(F.lit("facts["), i, F.lit("].statement"))).when(F.coalesce(F.size(x["source_refs"]), F.lit(0)) <= 0, F.concat(F.lit("facts["), i, F.lit("].source_refs"))))
    held = F.transform("hypotheses", lambda x, i: F.when(~blank(x["text"]), F.lit(None).cast("string")).when(x.isNull() | blank(x["statement"]), F.concat(F.lit("hypotheses["), i, F.lit("].statement"))).when(
        ~F.coalesce(x["origin"].isin(*SUBJECT["origin"]), F.lit(False)), F.concat(F.lit("hypotheses["), i, F.lit("].origin"))))
    none = F.array().cast("array<string>")
    return subjects.select("subject_id", F.explode(F.array_compact(F.concat(own, F.coalesce(facts, none), F.coalesce(held, none)))).alias("rule"))


def context_faults(contexts: DataFrame, profiles: DataFrame, required: list[str]) -> DataFrame:
    """contexts: context_id, status, research_intent, profile_version and the required texts. profiles: research_intent,
    version. A context that isn't ready, lacks a field or was made for another version of its profile."""
    j = contexts.join(profiles.select("research_intent", F.col("version").alias("_version")), "research_intent", "left")
    ready = F.col("status") == "ready"
    rules = {"status": ~ready} | {k: ready & (F.coalesce(F.col(k).cast("string"), F.lit("")) == "") for k in required} | {"version": ready & ~F.coalesce(F.col("profile_version") == F.col("_version"), F.lit(False))}
    return j.select("context_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), k) for k, c in rules.items()]))).alias("rule"))


def report_faults(reports: DataFrame) -> DataFrame:
    """reports: report_id, subject, text, items (support_refs, counter_refs), contract_status, stop_reason. The subject
    stands in the text, no item uses a reference both ways, and a met contract hasn't another stop."""
    plain = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda r: F.lower(F.regexp_replace(S.text(r), "/+$", "")))
    both = F.exists("items", lambda x: F.coalesce(F.arrays_overlap(F.filter(plain(x["support_refs"]), lambda r: r != ""), F.filter(plain(x["counter_refs"]), lambda r: r != "")), F.lit(False)))
    rules = {
        "subject": (S.text(F.col("subject")) != "") & ~F.col("text").contains(S.text(F.col("subject"))), "shared_refs": both,
        "stop_reason": (F.col("contract_status") == "met") & (F.coalesce("stop_reason", F.lit("")) != "sampling_contract_met"),
    }
    return reports.select("report_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))).alias("rule"))
