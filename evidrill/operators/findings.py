"""Findings and query plans held against their contracts: each broken rule is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import QUERY_LAYERS
from .collection import contract
from .decisions import disjoint_refs

CONCLUSIONS = ("candidate", "review_ready", "confirmed", "rejected")
TEMPORAL = ("current_snapshot", "spreading", "rising", "falling", "resolved_over_time")
REQUIRED = ("title", "analysis_unit_statement", "decision_summary", "audience", "evidence_boundary")


def _rows(df: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), k) for k, c in rules.items()]))
    return df.select(*keep, F.explode(broken).alias("rule"))


def finding_faults(findings: DataFrame, profiles: DataFrame, topics: DataFrame) -> DataFrame:
    """findings: study, finding_id, topic, the required texts, roles, support_refs, counter_refs,
    counter_search_status, actions (maps), sections (a map), conclusion_status, human_confirmation, temporal_claim,
    snapshots, direct_source_present, intent. profiles: intent, allowed_roles, action_fields, section_names,
    min_support, min_roles, history_claims. topics: study, topic (the eligible ones)."""
    t = topics.select("study", "topic").distinct().withColumn("_known", F.lit(True))
    f = findings.join(profiles, "intent", "left").join(t, ["study", "topic"], "left")
    f = f.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("study", "finding_id")))
    found = ((F.size("counter_refs") > 0) & (F.col("counter_search_status") == "found")) | (F.col("counter_search_status") == "searched_none_found")
    ready = (F.size("support_refs") >= F.col("min_support")) & found & (F.size(F.array_distinct("roles")) >= F.col("min_roles")) & F.col("direct_source_present")
    complete = F.forall("actions", lambda a: F.forall("action_fields", lambda k: F.coalesce(F.trim(F.try_element_at(a, k)), F.lit("")) != ""))
    sections = (F.array_sort(F.map_keys("sections")) == F.array_sort("section_names")) & F.forall(F.map_values("sections"), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    rules = {
        "id": (F.coalesce("finding_id", F.lit("")) == "") | (F.col("_same") > 1),
        **{k: F.coalesce(F.trim(k), F.lit("")) == "" for k in REQUIRED},
        "topic_key": F.col("_known").isNull(),
        "profile_evidence_roles": F.size(F.array_except("roles", "allowed_roles")) > 0,
        "shared_refs": ~disjoint_refs(F.col("support_refs"), F.col("counter_refs")),
        "recommended_actions": (F.size("actions") == 0) | ~complete,
        "report_sections": ~sections,
        "conclusion_status": ~F.col("conclusion_status").isin(*CONCLUSIONS),
        "thresholds": F.col("conclusion_status").isin("review_ready", "confirmed") & ~F.coalesce(ready, F.lit(False)),
        "human_confirmation": (F.col("conclusion_status") == "confirmed") & (F.coalesce("human_confirmation", F.lit("")) == ""),
        "temporal_claim": ~F.col("temporal_claim").isin(*TEMPORAL),
        "history": F.array_contains("history_claims", F.col("temporal_claim")) & (F.coalesce("snapshots", F.lit(1)) < 2),
    }
    return _rows(f, ["study", "finding_id"], rules)


def plan_faults(plans: DataFrame) -> DataFrame:
    """plans: plan_id, mode, query_id, term, layer, url. Broken rules of a plan or of one of its queries."""
    each = plans.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("plan_id", "query_id")))
    own = _rows(each, ["plan_id", "query_id"], {
        "unique_id": F.col("_same") > 1, "term": F.coalesce(F.trim("term"), F.lit("")) == "", "layer": ~F.col("layer").isin(*QUERY_LAYERS), "url": ~F.col("url").rlike("^https?://"),
    })
    g = plans.groupBy("plan_id", "mode").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("layer") == x).alias(x) for x in QUERY_LAYERS])
    m = F.col("mode")
    whole = _rows(g.withColumn("query_id", F.lit(None).cast(plans.schema["query_id"].dataType)), ["plan_id", "query_id"], {
        "query_count": ~F.col("n").between(contract(m, "query_target", 0), contract(m, "query_target", 1)), "layer_queries": F.least(*QUERY_LAYERS) < contract(m, "layer_query_min"),
    })
    return own.unionByName(whole)


def recovery_faults(recovery: DataFrame, runs: DataFrame, needs: DataFrame, terms: DataFrame, most_words: int = 4) -> DataFrame:
    """recovery: snapshot_id, id, term, layer, url, and, where a profile limits them, intent and allowed_intents. One query
    a snapshot, within what the mode's contract leaves of its queries, with few words, in a layer that lacks something if
    any does, with no id, term or address of a run (runs: snapshot_id, query_id, query_term, url, mode). Where volume is
    all that is lacking (needs: snapshot_id, recommended_layers, volume_only) the term has to be one of the recommended
    ones (terms: snapshot_id, term). Every broken rule is a row."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    known = {"id": ("query_id", text("query_id")), "repeated": ("query_term", F.lower(text("query_term"))), "url_repeated": ("url", text("url"))}
    r = recovery.withColumns({"_id": text("id"), "_repeated": F.lower(text("term")), "_url_repeated": text("url")}).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("snapshot_id")))
    for rule, (_, value) in known.items():
        held = runs.select("snapshot_id", value.alias(f"_{rule}")).where(F.col(f"_{rule}") != "").distinct().withColumn(f"_has_{rule}", F.lit(True))
        r = r.join(held, ["snapshot_id", f"_{rule}"], "left")
    r = r.join(terms.select("snapshot_id", F.lower(F.trim("term")).alias("_repeated")).distinct().withColumn("_from", F.lit(True)), ["snapshot_id", "_repeated"], "left")
    spent = runs.groupBy("snapshot_id").agg((contract(F.min("mode"), "query_target", 1) - F.count(F.lit(1))).alias("_left"))
    r = r.join(spent, "snapshot_id", "left").join(needs.select("snapshot_id", "recommended_layers", "volume_only"), "snapshot_id", "left")
    words = F.size(F.regexp_extract_all(F.coalesce("term", F.lit("")), F.lit(r"(?U)([\w'-]+)"), 1))
    lacking = F.coalesce(F.size("recommended_layers"), F.lit(0)) > 0
    rules = {
        "budget": F.coalesce(F.col("_left") < F.col("_n"), F.lit(False)), "one_query": F.col("_n") > 1, "term": F.col("_repeated") == "", "layer_name": ~F.coalesce(F.col("layer").isin(*QUERY_LAYERS), F.lit(False)),
        "url": ~F.col("_url_repeated").rlike("^https?://"), **{k: F.col(f"_has_{k}").isNotNull() for k in known}, "words": words > most_words,
        "layer": lacking & ~F.coalesce(F.array_contains("recommended_layers", F.col("layer")), F.lit(False)), "evidence": F.coalesce("volume_only", F.lit(False)) & F.col("_from").isNull(),
    }
    if "allowed_intents" in recovery.columns:
        rules["intent"] = F.col("allowed_intents").isNotNull() & ~F.coalesce(F.array_contains("allowed_intents", F.col("intent")), F.lit(False))
    return _rows(r, ["snapshot_id", "term"], rules)


def report_rows(findings: DataFrame, topics: DataFrame, comments: DataFrame, media: DataFrame) -> DataFrame:
    """Findings with the scores of their topic and what comments and media say about it; each side has one row per
    (snapshot_id, topic)."""
    key = ["snapshot_id", "topic"]
    return findings.join(topics, key, "left").join(comments, key, "left").join(media, key, "left")


def unused_topics(topics: DataFrame, findings: DataFrame) -> DataFrame:
    """Eligible topics that no finding refers to."""
    return topics.join(findings.select("snapshot_id", "topic").distinct(), ["snapshot_id", "topic"], "left_anti")


def cluster_spec_faults(specs: DataFrame) -> DataFrame:
    """specs: plan_id, topic_key, title, analysis_unit_statement, inclusion_rule, exclusion_rule. Required texts, and a
    title that is a short label for readers: no key, address or markup."""
    need = ("topic_key", "title", "analysis_unit_statement", "inclusion_rule", "exclusion_rule")
    t = F.col("title")
    label = (F.length(t) > 120) | (t == F.col("topic_key")) | t.contains("**") | t.contains("__") | t.rlike("https?://")
    return _rows(specs, ["plan_id", "topic_key"], {**{k: F.coalesce(F.trim(k), F.lit("")) == "" for k in need}, "reader_title": label})


# What readers are told of a format.
FORMAT_LABELS = {"p": "Post", "post": "Post", "photo": "Photo", "image": "Image", "carousel": "Carousel", "reel": "Reel", "video": "Video", "short_video": "Short video", "unknown": "Format unconfirmed"}


def format_label(value: Column) -> Column:
    """The label of a format, without regard to case, dashes and spaces; an unknown one is its own, a blank one unconfirmed."""
    own = F.trim(F.coalesce(value, F.lit("")))
    key = F.regexp_replace(F.lower(own), "[- ]", "_")
    return S.lookup(F.when(key == "", "unknown").otherwise(key), FORMAT_LABELS, own)


def format_mix(signals: DataFrame) -> DataFrame:
    """Per snapshot: all its formats by their labels (snapshot_id, format), those without one among them, the most frequent
    first, with the share of each."""
    g = signals.groupBy("snapshot_id", format_label(F.col("format")).alias("format")).agg(F.count(F.lit(1)).alias("signals"))
    w = Window.partitionBy("snapshot_id")  # a row for each format
    g = g.withColumn("share", F.bround(F.col("signals") / F.sum("signals").over(w), 4))
    return g.withColumn("format_rank", F.row_number().over(w.orderBy(F.desc("signals"), "format")))


def supply_hints(signals: DataFrame, k: int = 3) -> DataFrame:
    """signals: snapshot_id, ordinal, hint. The first k different hints of each snapshot, in the order of its signals."""
    h = signals.withColumn("hint", F.trim(F.coalesce("hint", F.lit("")))).where("hint <> ''").groupBy("snapshot_id", "hint").agg(F.min("ordinal").alias("first"))
    return h.withColumn("hint_rank", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("first", "hint"))).where(F.col("hint_rank") <= k).drop("first")
