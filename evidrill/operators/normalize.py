"""Raw signals, in whatever spelling, to canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import SOURCE_QUALITY
from . import dedup

# The names that exports use for a field, in order of preference.
ALIASES = {
    "content_id": ("content_id", "contentId", "id"),
    "signal_id": ("signal_id", "signalId", "id"),
    "url": ("canonical_url", "canonicalUrl", "url", "link", "source_url"),
    "title": ("title", "name", "text", "body"),
    "summary": ("summary", "description", "body", "text"),
    "published_at": ("published_at", "publishedAt", "created_at", "createdAt"),
    "captured_at": ("captured_at", "capturedAt"),
    "detail_captured": ("detail_captured", "detailCaptured", "detail_opened"),
    "source_mode": ("source_mode", "sourceMode"),
    "source_type": ("source_type", "sourceType", "evidence_source_type"),
    "evidence_role": ("evidence_role", "evidenceRole", "role"),
    "profile_evidence_role": ("profile_evidence_role", "profileEvidenceRole"),
    "query_term": ("query_term", "queryTerm", "query", "keyword"),
    "query_layer": ("query_layer", "queryLayer", "scope"),
    "query_intent": ("query_intent", "queryIntent"),
    "query_terms": ("query_terms", "queryTerms"),
    "query_layers": ("query_layers", "queryLayers"),
    "semantic_relevance": ("semantic_relevance", "semanticRelevance"),
    "topic_key": ("topic_key", "topicKey"),
    "evidence_refs": ("evidence_refs", "evidenceRefs", "refs"),
    "limitations": ("limitations", "limits"),
    "permission_scope": ("permission_scope", "permissionScope"),
    "author_id": ("author_id", "authorId", "username"),
    "author_name": ("author_name", "authorName"),
    "follower_count": ("follower_count", "followerCount"),
    "growth_rate_percent": ("growth_rate_percent", "growthRatePercent"),
    "current_window_count": ("current_window_count", "currentWindowCount"),
    "previous_window_count": ("previous_window_count", "previousWindowCount"),
    "comparison_count": ("comparison_count", "comparisonCount"),
    "search_rank": ("search_rank", "searchRank"),
    "search_result_count": ("search_result_count", "searchResultCount"),
    "observed_content_count": ("observed_content_count", "observedContentCount"),
}
METRICS = {
    "views": ("views", "view_count", "impressions", "impression_count"),
    "likes": ("likes", "like_count"),
    "saves": ("saves", "save_count", "bookmarks", "bookmark_count", "favorites"),
    "comments": ("comments", "comment_count", "replies", "reply_count"),
    "shares": ("shares", "share_count", "reposts", "retweet_count", "quote_count"),
}
REPAIRED = "An invalid replacement character was removed from the text; the raw capture is kept."


def _field(name: str, m: Column | None = None) -> Column:
    m = F.col("raw") if m is None else m
    return S.first(*[F.element_at(m, k) for k in ALIASES[name]])


def metric(keys: tuple[str, ...]) -> Column:
    """From the section `metrics`, then `public_metrics` (columns _metrics, _public_metrics), then the flat or dotted
    field; cut to a whole number."""
    nested = [S.number(F.element_at("_" + s, k)) for s in ("metrics", "public_metrics") for k in keys]
    flat = S.number(S.first(*[F.element_at("raw", k) for k in (*keys, *(f"metrics.{k}" for k in keys), *(f"public_metrics.{k}" for k in keys))]))
    return F.coalesce(*nested, flat).cast("bigint")


def source_type(explicit: Column, mode: Column, url: Column, detail: Column, limitations: Column) -> Column:
    """What a signal was seen as, by rules in order."""
    u = F.lower(url)
    return (
        F.when((explicit == "direct_post") & (mode == "controlled_capture") & ~detail, "search_card")
        .when(F.array_contains(F.transform(limitations, F.lower), "search_card_only"), "search_card")
        .when(explicit.isin(*SOURCE_QUALITY), explicit)
        .when(mode == "authorized_api", "direct_post").when(mode == "customer_export", "exported_item").when(mode == "historical_snapshot", "historical_item")
        .when(u.contains("/i/trending/"), "platform_summary")
        .when(u.rlike("/(status|note|explore|video)/"), F.when(detail, "direct_post").when(mode == "controlled_capture", "search_card").otherwise("search_snippet"))
        .when((mode == "public_web") & ~detail, "search_snippet").when(url != "", "webpage").otherwise("unknown")
    )


def normalize(raw: DataFrame, platform: str, source_mode: str, captured_at: str) -> DataFrame:
    """raw: snapshot_id, ordinal, raw (a map). One canonical signal per object."""
    d = raw.where(F.col("raw").isNotNull())
    # nested sections are parsed once
    d = d.withColumns({f"_{name}": F.from_json(F.element_at("raw", name), "map<string,string>") for name in ("metrics", "public_metrics", "author", "discovery")})
    text = lambda name: S.text(_field(name))
    strings = lambda name: F.filter(F.transform(S.items(_field(name)), S.text), lambda x: x != "")
    author, discovery = F.col("_author"), F.col("_discovery")
    nested = lambda m, *keys: S.first(*[F.element_at(m, k) for k in keys])
    clean = lambda c: F.regexp_replace(F.replace(S.text(c), F.lit("�"), F.lit("")), r"[\s\p{Z}]+$", "")
    title, summary = _field("title"), _field("summary")
    spoilt = F.coalesce(title.contains("�"), F.lit(False)) | F.coalesce(summary.contains("�"), F.lit(False))
    d = d.withColumns({
        "platform": S.platform(F.coalesce(S.first(F.element_at("raw", "platform")), F.lit(platform))), "url": S.url(_field("url")), "content_id": text("content_id"),
        "detail_captured": S.boolean(_field("detail_captured")), "source_mode": F.coalesce(S.first(text("source_mode")), F.lit(source_mode)),
        "author_id": S.text(F.coalesce(nested(author, "id", "author_id"), _field("author_id"))), "published_at": text("published_at"),
        "limitations": F.when(spoilt, F.array_append(strings("limitations"), REPAIRED)).otherwise(strings("limitations")),
        "title": F.substring(clean(title), 1, 500), "summary": F.substring(clean(summary), 1, 4000),
    })
    known = lambda c, *allowed, otherwise: F.when(F.lower(c).isin(*allowed), F.lower(c)).otherwise(otherwise)
    whole = S.first(_field("title"), _field("summary"))
    key = dedup.dedupe_key(F.col("platform"), F.col("content_id"), F.col("url"), F.col("author_id"), F.col("published_at"), whole)
    d = d.withColumn("dedupe_key", key)
    own_id = F.when((F.col("platform") != "") & (F.col("content_id") != ""), F.concat_ws("-", "platform", "content_id")).otherwise(F.concat(F.lit("signal-"), F.substring("dedupe_key", 1, 12)))
    number = lambda name, section=None: S.number(F.coalesce(nested(section, *ALIASES[name]), _field(name)) if section is not None else _field(name))
    captured = F.coalesce(S.first(text("captured_at")), F.lit(captured_at))
    return d.select(
        "snapshot_id", "ordinal", F.coalesce(S.first(text("signal_id")), own_id).alias("signal_id"), "platform", "source_mode",
        source_type(text("source_type"), F.col("source_mode"), F.col("url"), F.col("detail_captured"), F.col("limitations")).alias("source_type"),
        known(text("evidence_role"), "support", "counter", "neutral", otherwise="neutral").alias("evidence_role"), text("profile_evidence_role").alias("profile_evidence_role"),
        "detail_captured", "content_id", F.col("url").alias("canonical_url"), text("query_term").alias("query_term"),
        F.coalesce(S.first(text("query_layer")), F.lit("unspecified")).alias("query_layer"), text("query_intent").alias("query_intent"),
        strings("query_terms").alias("query_terms"), strings("query_layers").alias("query_layers"),
        known(text("semantic_relevance"), "direct", "adjacent", "weak", otherwise="unreviewed").alias("semantic_relevance"), text("topic_key").alias("topic_key"),
        "title", "summary", "published_at", captured.alias("captured_at"), *[metric(k).alias(n) for n, k in METRICS.items()],
        "author_id", S.text(F.coalesce(nested(author, "name", "display_name"), _field("author_name"))).alias("author_name"), number("follower_count", author).alias("follower_count"),
        *[number(n, discovery).alias(n) for n in ("search_rank", "search_result_count", "observed_content_count")],
        *[number(n).alias(n) for n in ("growth_rate_percent", "current_window_count", "previous_window_count", "comparison_count")],
        F.array_distinct(F.filter(F.concat(F.array("url"), F.transform(S.items(_field("evidence_refs")), S.url)), lambda x: x != "")).alias("evidence_refs"),
        "limitations", F.coalesce(S.first(text("permission_scope")), F.lit("unspecified")).alias("permission_scope"), "dedupe_key",
    )
