"""Captures of hashtag results, post searches, account pages and comment panels: each is one JSON document of a
bounded size, checked and turned into signals within its row.

Where a capture breaks its contract (limits, unknown stop, links of another kind) the faults are listed in place of
an error; where a check fails it is blocked, and only captured ones give signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import scalars as S
from ..operators.dedup import jaccard
from ..operators.text_rules import forbidden_keys
from .staging import staged

# Why reading stops for good, and why there is nothing to read.
HARD_STOPS = ("captcha", "rate_limit", "login_expired", "permission_prompt", "abnormal_redirect", "content_mismatch")
UNAVAILABLE_STOPS = ("timeout", "no_visible_posts", "details_unavailable", "surface_unreadable", "controller_connection_failed", "verified_zero_results")

# How a page says that its post isn't there any more.
GONE = r"页面无法显示|页面已被移除|link may be broken|page may have been removed|content isn't available|content is not available"

# What has to be checked and true on each surface.
CHECKS = {
    "hashtag": ("hashtag_identity", "canonical_post_links", "public_fields_only", "no_account_search_proxy", "no_personalized_explore_feed", "no_write_actions", "no_credential_export"),
    "posts": ("posts_surface", "frozen_query_visible", "public_content_only", "no_home_feed", "no_mixed_search", "no_write_actions", "no_credential_export"),
    "account": ("profile_identity", "canonical_post_links", "public_fields_only", "no_follow_graph", "no_write_actions", "no_credential_export"),
    "comments": ("stable_content_id", "author_path", "target_comments_panel", "top_level_visible_comments_only", "no_recommended_content", "no_write_actions"),
}

_COMMENT = "struct<author_name:string,author:string,text:string,likes:string,reactions:string,published_at:string,observed_time_label:string,top_level_visible:boolean>"
_POST = (
    "struct<canonical_url:string,author_username:string,author_name:string,caption:string,preview_text:string,body_text:string,published_at:string,observed_time_label:string,"
    f"content_format:string,likes:string,reactions:string,comments:string,shares:string,views:string,detail_captured:boolean,representative_comments:array<{_COMMENT}>>"
)
CAPTURE = (
    "struct<hashtag:string,username:string,stop_reason:string,checks:map<string,boolean>,result_passes:array<array<string>>,"
    f"result_cards:array<{_POST}>,posts:array<{_POST}>,canonical_url:string,content_id:string,author_handle:string,comments:array<{_COMMENT}>,visible_comment_entry_count:bigint>"
)
OUT = "struct<author_name:string,text:string,likes:bigint,published_at:string,observed_time_label:string>"


def hashtag(c: Column) -> Column:
    """Without its signs, in lower case; null unless it is one word."""
    tag = F.regexp_replace(S.text(c), "^#+", "")
    return F.when(tag.rlike(r"^[^\s#/?:&]{1,100}$"), F.lower(tag))


def whole(c: Column) -> Column:
    return S.number(c).cast("bigint")


def visible_comments(rows: Column, count: str = "likes") -> Column:
    """Comments in the form that signals carry."""
    make = lambda x: F.struct(
        S.text(x["author_name"]).alias("author_name"), S.text(x["text"]).alias("text"), whole(x[count]).alias("likes"), S.text(x["published_at"]).alias("published_at"), S.text(x["observed_time_label"]).alias("observed_time_label")
    )
    return F.coalesce(F.transform(rows, make), F.array().cast(f"array<{OUT}>"))


def comment_faults(rows: Column) -> Column:
    """Does any of the comments lack text, or isn't a visible one of the top level?"""
    return F.coalesce(F.exists(rows, lambda x: x.isNull() | ~F.coalesce(x["top_level_visible"], F.lit(False)) | (S.text(x["text"]) == "")), F.lit(False))


def _checked(checks: Column, kind: str) -> Column:
    ok = F.lit(True)
    for name in CHECKS[kind]:
        ok = ok & F.coalesce(F.try_element_at(checks, F.lit(name)), F.lit(False))
    return ok


def _faults(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))


def _once(links: Column) -> Column:
    """Links whose id hasn't come before."""
    ids = F.transform(links, lambda y: y["content_id"])
    return F.filter(links, lambda x, i: F.array_position(ids, x["content_id"]) == i + 1)


def _repeated(ids: Column) -> Column:
    return F.size(ids) != F.size(F.array_distinct(ids))


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{_POST}>"))


def _read_once(parts) -> Column:
    """What `parts` makes of a capture. A lambda sees the text parsed once; fields taken from the parsed text one by one would
    each parse it again."""
    make = lambda c: F.struct(*[v.alias(k) for k, v in parts(c).items()])
    return F.get(F.transform(F.array(F.from_json("raw", CAPTURE)), make), F.lit(0))


def _parsed(captures: DataFrame, post, more: tuple[str, ...]) -> DataFrame:
    """Adds the capture's parts: links of each pass (null where one isn't a post's), cards and details by content id. Texts
    are parsed and addresses read once; the parts are written, and everything else goes by those."""
    own = lambda rows: F.transform(_empty(rows), lambda x: F.struct(post(x["canonical_url"]).alias("id"), x.alias("x")))
    parts = lambda c: {
        "stop": F.lower(S.text(c["stop_reason"])), "passes": F.transform(c["result_passes"], lambda p: F.transform(p, lambda u: post(u))), "cards": own(c["result_cards"]), "details": own(c["posts"]),
        "hashtag": c["hashtag"], "checks": c["checks"],
    }
    d = captures.withColumn("forbidden", forbidden_keys(F.col("raw"), *more)).withColumn("c", _read_once(parts)).drop("raw")
    d = staged(d, "captures").select("*", "c.stop", "c.passes", "c.cards", "c.details").withColumn("c", F.struct("c.hashtag", "c.checks"))
    observed = _once(F.filter(F.coalesce(F.get("passes", F.lit(0)), F.array()), lambda x: x.isNotNull()))
    d = d.withColumn("observed", observed).withColumn("urls", F.transform("observed", lambda x: x["url"]))
    urls = lambda i: F.array_distinct(F.transform(F.filter(F.get("passes", F.lit(i)), lambda x: x.isNotNull()), lambda x: x["url"]))
    return d.withColumn("overlap", F.when(F.size("passes") == 2, jaccard(urls(0), urls(1)))).withColumn("pass_count", F.greatest(F.lit(0), F.size("passes")))


def _bad_passes() -> Column:
    return F.col("passes").isNull() | (F.size("passes") < 1) | (F.size("passes") > 2) | F.exists("passes", lambda p: F.coalesce(F.size(p) > F.col("max_posts"), F.lit(True)))


def _bad_links() -> Column:
    return F.exists("passes", lambda p: F.exists(p, lambda x: x.isNull()))


def _foreign(rows: str) -> Column:
    return F.exists(rows, lambda r: r["id"].isNull() | ~F.coalesce(F.array_contains("urls", r["id"]["url"]), F.lit(False)))


def _captured(d: DataFrame, term: str) -> DataFrame:
    """What signals need of the captured ones, with their checks worked out once."""
    return staged(d.select("capture_id", term, "query_layer", "status", "observed", "cards", "details"), "checked").where("status = 'captured'")


def _placed(d: DataFrame, term: str) -> DataFrame:
    """A row for each link of the first pass (p, at pos), with the last detail (d) and the last card (k) of its id, by
    joins within the capture."""
    own = lambda rows: d.select("capture_id", F.posexplode(rows).alias("at", "r")).groupBy("capture_id", F.col("r.id.content_id").alias("cid")).agg(F.max_by("r.x", "at").alias("x"))
    e = d.select("capture_id", term, "query_layer", F.size("observed").alias("n"), F.posexplode("observed").alias("pos", "p")).withColumn("cid", F.col("p.content_id"))
    key = ["capture_id", "cid"]
    return e.join(own("details").withColumnRenamed("x", "d"), key, "left").join(own("cards").withColumnRenamed("x", "k"), key, "left")


def _title(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " ")), 1, 180)


def hashtag_captures(captures: DataFrame) -> DataFrame:
    """captures: capture_id, hashtag, query_layer, max_posts, max_detail_posts, raw. Adds status, stop, faults, the
    observed links and how far two passes agree."""
    d = _parsed(captures, A.instagram_post, ("followers", "following"))
    ids = lambda rows: F.transform(rows, lambda r: r["id"]["content_id"])
    d = d.withColumn("faults", _faults({
        "forbidden": F.col("forbidden"), "stop": (F.col("stop") != "") & ~F.col("stop").isin(*HARD_STOPS, *UNAVAILABLE_STOPS), "passes": (F.col("stop") == "") & _bad_passes(), "links": (F.col("stop") == "") & _bad_links(),
        "cards": F.size("cards") > F.col("max_posts"), "details": F.size("details") > F.col("max_detail_posts"), "repeated": _repeated(ids("cards")) | _repeated(ids("details")),
        "preview": F.exists("cards", lambda r: S.text(r["x"]["preview_text"]) == ""), "detail_text": F.exists("details", lambda r: (S.text(r["x"]["caption"]) == "") | (S.text(r["x"]["published_at"]) == "")),
        "comments": F.exists("details", lambda r: comment_faults(r["x"]["representative_comments"]) | (F.size(r["x"]["representative_comments"]) > 5)),
    }))
    stop, wrong = F.col("stop"), (hashtag(F.col("c.hashtag")) != hashtag(F.col("hashtag"))) | hashtag(F.col("c.hashtag")).isNull() | ~_checked(F.col("c.checks"), "hashtag")
    status = (
        F.when(F.size("faults") > 0, "invalid").when(stop.isin(*HARD_STOPS), "blocked").when(stop != "", "unavailable").when(wrong, "blocked").when(F.size("observed") == 0, "unavailable")
        .when(_foreign("cards") | _foreign("details"), "blocked").when(F.size("details") > 0, "captured").otherwise("unavailable")
    )
    reason = F.when((F.size("faults") > 0) | (stop != ""), stop).when(wrong, "content_mismatch").when(F.size("observed") == 0, "no_visible_posts").when(_foreign("cards") | _foreign("details"), "content_mismatch").when(
        F.size("details") > 0, "").otherwise("details_unavailable")
    return d.withColumns({"status": status, "stop_reason": reason})


def hashtag_signals(captures: DataFrame) -> DataFrame:
    """Signals of the captured ones, in the order of the first pass: a detail stands for the card of its id."""
    e = _placed(_captured(hashtag_captures(captures), "hashtag"), "hashtag")
    cid = F.col("p.content_id")
    seen = F.col("d").isNotNull()
    text = F.when(seen, S.text(F.col("d.caption"))).otherwise(S.text(F.col("k.preview_text")))
    author = F.regexp_replace(S.text(F.when(seen, F.col("d.author_username")).otherwise(F.col("k.author_username"))), "^@+", "")
    return e.select(
        "capture_id", F.lit("instagram").alias("platform"), F.concat(F.lit("instagram-"), cid).alias("signal_id"), cid.alias("content_id"), F.col("p.url").alias("canonical_url"), F.col("p.kind").alias("content_format"),
        F.concat(F.lit("#"), hashtag(F.col("hashtag"))).alias("query_term"), "query_layer", F.when(seen, "direct_post").otherwise("search_card").alias("source_type"), seen.alias("detail_captured"),
        _title(text).alias("title"), text.alias("summary"), author.alias("author_id"), S.text(F.col("d.published_at")).alias("published_at"), *[whole(F.col(f"d.{m}")).alias(m) for m in ("views", "likes", "comments")],
        visible_comments(F.col("d.representative_comments")).alias("representative_comments"), (F.col("pos") + 1).alias("search_rank"), F.col("n").alias("search_result_count"),
        F.sha2(F.concat(F.lit("instagram:"), cid), 256).alias("capture_key"),
    )


def post_search_captures(captures: DataFrame) -> DataFrame:
    """captures: capture_id, query_term, query_layer, max_posts, max_detail_posts, raw. A failed check blocks, but what
    was seen still counts; a row has to be one of the first pass."""
    d = _parsed(captures, A.facebook_post, ("friends", "notifications"))
    text = lambda r, name: S.text(r["x"][name])
    d = d.withColumn("faults", _faults({
        "forbidden": F.col("forbidden"), "stop": (F.col("stop") != "") & ~F.col("stop").isin(*HARD_STOPS, "private_content", *UNAVAILABLE_STOPS), "passes": _bad_passes(), "links": _bad_links(),
        "limits": (F.size("cards") > F.col("max_posts")) | (F.size("details") > F.col("max_detail_posts")), "identity": _foreign("cards") | _foreign("details"),
        "text": F.exists("cards", lambda r: text(r, "preview_text") == "") | F.exists("details", lambda r: text(r, "body_text") == ""),
        "time": F.exists("details", lambda r: (text(r, "published_at") == "") & (text(r, "observed_time_label") == "")),
        "comments": F.exists("details", lambda r: comment_faults(r["x"]["representative_comments"]) | (F.size(r["x"]["representative_comments"]) > 5)) | F.exists("cards", lambda r: F.size(r["x"]["representative_comments"]) > 0),
    }))
    ids = F.transform("observed", lambda x: x["content_id"])
    details = F.size(F.array_intersect(ids, F.transform("details", lambda r: r["id"]["content_id"])))
    stop = F.when((F.col("stop") == "") & ~_checked(F.col("c.checks"), "posts"), "content_mismatch").otherwise(F.col("stop"))
    status = F.when(F.size("faults") > 0, "invalid").when(stop.isin(*HARD_STOPS, "private_content"), "blocked").when(details > 0, "captured").otherwise("unavailable")
    reason = F.when(stop != "", stop).when(F.size("observed") == 0, "no_visible_posts").when(details == 0, "details_unavailable").otherwise("")
    return d.withColumns({"status": status, "stop_reason": reason, "detail_open_count": details})


def post_search_signals(captures: DataFrame) -> DataFrame:
    """Signals of the captured ones. Reactions aren't likes; a link without card or detail gives none."""
    e = _placed(_captured(post_search_captures(captures), "query_term"), "query_term").where("d IS NOT NULL OR k IS NOT NULL")
    cid = F.col("p.content_id")
    seen = F.col("d").isNotNull()
    pick = lambda name: F.when(seen, F.col(f"d.{name}")).otherwise(F.col(f"k.{name}"))
    text = F.when(seen, S.text(F.col("d.body_text"))).otherwise(S.text(F.col("k.preview_text")))
    return e.select(
        "capture_id", F.lit("facebook").alias("platform"), F.concat(F.lit("facebook-"), cid).alias("signal_id"), cid.alias("content_id"), F.col("p.url").alias("canonical_url"),
        F.coalesce(S.first(S.text(pick("content_format"))), F.col("p.kind")).alias("content_format"), "query_term", "query_layer", F.when(seen, "direct_post").otherwise("search_card").alias("source_type"),
        seen.alias("detail_captured"), _title(text).alias("title"), text.alias("summary"), S.text(pick("author_name")).alias("author_name"), S.text(pick("published_at")).alias("published_at"),
        S.text(pick("observed_time_label")).alias("observed_time_label"), *[whole(pick(m)).alias(m) for m in ("views", "reactions", "comments", "shares")],
        visible_comments(F.col("d.representative_comments"), "reactions").alias("representative_comments"), (F.col("pos") + 1).alias("search_rank"), F.col("n").alias("search_result_count"),
    )


def account_signals(captures: DataFrame) -> DataFrame:
    """captures: capture_id, username, max_posts, max_detail_posts, raw. The posts of one account: every one by the
    account itself, under an address that names no other, and at least one of them opened."""
    post = lambda u: A.instagram_post(u, with_profile=True)
    name = lambda c: F.regexp_replace(F.regexp_replace(S.text(c), "^@+", ""), "^/+|/+$", "")
    rows = lambda posts: F.transform(_empty(posts), lambda x: F.struct(post(x["canonical_url"]).alias("id"), F.lower(name(x["author_username"])).alias("by"), F.coalesce(x["detail_captured"], F.lit(False)).alias("open"), x.alias("x")))
    d = captures.withColumn("forbidden", forbidden_keys(F.col("raw"), "followers", "following")).withColumn("own", F.lower(name(F.col("username"))))
    d = d.withColumn("c", _read_once(lambda c: {"username": c["username"], "stop_reason": c["stop_reason"], "checks": c["checks"], "rows": rows(c["posts"])})).drop("raw")
    d = staged(d, "accounts").withColumn("rows", F.col("c.rows"))
    opened = F.size(F.filter("rows", lambda r: r["open"]))
    alien = F.exists("rows", lambda r: (r["by"] != F.col("own")) | ((r["id"]["profile"] != "") & (F.lower(r["id"]["profile"]) != F.col("own"))))
    bad = (
        F.col("forbidden") | (S.text(F.col("c.stop_reason")) != "") | (F.lower(name(F.col("c.username"))) != F.col("own")) | ~_checked(F.col("c.checks"), "account") | alien
        | F.exists("rows", lambda r: r["id"].isNull() | (r["open"] & ((S.text(r["x"]["caption"]) == "") | (S.text(r["x"]["published_at"]) == ""))) | comment_faults(r["x"]["representative_comments"]) | (F.coalesce(F.size(r["x"]["representative_comments"]), F.lit(0)) > 5))
        | _repeated(F.transform("rows", lambda r: r["id"]["content_id"])) | (F.size("rows") > F.col("max_posts")) | (opened > F.col("max_detail_posts")) | (opened == 0)
    )
    e = d.where(~F.coalesce(bad, F.lit(True))).select("capture_id", "username", F.size("rows").alias("n"), F.posexplode("rows").alias("pos", "r"))
    x, cid = F.col("r.x"), F.col("r.id.content_id")
    return e.select(
        "capture_id", F.concat(F.lit("instagram-"), cid).alias("signal_id"), cid.alias("content_id"), F.col("r.id.url").alias("canonical_url"), F.col("r.id.kind").alias("content_format"), F.col("username").alias("author_id"),
        F.when(F.col("r.open"), "direct_post").otherwise("search_card").alias("source_type"), F.col("r.open").alias("detail_captured"), _title(S.text(x["caption"])).alias("title"), S.text(x["caption"]).alias("summary"),
        S.text(x["published_at"]).alias("published_at"), *[whole(x[m]).alias(m) for m in ("views", "likes", "comments")], visible_comments(x["representative_comments"]).alias("representative_comments"),
        (F.col("pos") + 1).alias("search_rank"), F.col("n").alias("search_result_count"),
    )


def meta_details(pages: DataFrame) -> DataFrame:
    """pages: page_id, canonical_url, description, og_title, published_at. What a post's meta tags say."""
    text = S.text(F.col("description"))
    head = r"(?is)^([\d,.]+) likes?,\s*([\d,.]+) comments?\s*-\s*([A-Za-z0-9._]+)\s+on\s+"
    count = lambda i: F.replace(F.regexp_extract(text, head, i), F.lit(","), F.lit("")).try_cast("bigint")
    caption = S.first(F.trim(F.regexp_extract(S.text(F.col("og_title")), r'(?s)on Instagram:\s*"(.*)"\s*$', 1)), F.trim(F.regexp_extract(text, r'(?s):\s*"(.*)"\.?\s*$', 1)))
    return pages.select(
        "page_id", F.coalesce(A.instagram_post(F.col("canonical_url"))["url"], F.lit("")).alias("canonical_url"), F.regexp_extract(text, head, 3).alias("author_username"), F.coalesce(caption, F.lit("")).alias("caption"),
        S.text(F.col("published_at")).alias("published_at"), count(1).alias("likes"), count(2).alias("comments"),
    )


_SHOWN = r"(?<![\w.])([0-9]+(?:[.,][0-9]+)?)\s*([kmb万亿]?)"


def button_metrics(labels: Column) -> dict[str, Column]:
    """Counts from a post's buttons, texts with a number and a word: of each kind the first button. A button counts for
    the first kind whose word it has."""
    text = lambda b: F.lower(F.replace(S.text(b), F.lit("，"), F.lit(",")))
    number = lambda b: F.floor(F.replace(F.regexp_extract(text(b), _SHOWN, 1), F.lit(","), F.lit("")).try_cast("double") * S._times(F.regexp_extract(text(b), _SHOWN, 2))).cast("bigint")
    kind = lambda b: F.when(text(b).rlike("评论|comment"), "comments").when(text(b).rlike("分享|share|发送给"), "shares").when(text(b).rlike("播放|观看|views?|plays?"), "views").when(text(b).rlike("回应|reactions?"), "reactions")
    found = F.filter(F.transform(labels, lambda b: F.struct(kind(b).alias("kind"), number(b).alias("n"))), lambda x: x["n"].isNotNull())
    return {k: F.get(F.filter(found, lambda x: x["kind"] == k), F.lit(0))["n"] for k in ("reactions", "comments", "shares", "views")}  # noqa: B023


def card_details(rows: DataFrame) -> DataFrame:
    """rows: row_id, requested_url, canonical_url, author_name, description, visible_text, og_title, observed_time_label,
    button_labels, comments (author_name, text, top_level_visible), and of the card card_author, card_time_label,
    card_reactions, card_comments, card_shares, card_views. Details of the post that was asked for; what the page
    doesn't show comes from the card. Unavailable pages and those without text or time give no row."""
    asked, seen = A.facebook_post(F.col("requested_url")), A.facebook_post(F.col("canonical_url"))
    said = lambda *names: F.coalesce(S.first(*[A.visible_text(F.col(n)) for n in names]), F.lit(""))
    d = rows.withColumns({"asked": asked, "seen": seen, "body": said("description", "visible_text", "og_title"), "label": said("observed_time_label", "card_time_label")})
    gone = F.lower("body").rlike(GONE)
    d = d.where((F.col("asked.content_id") == F.col("seen.content_id")) & (F.col("body") != "") & (F.col("label") != "") & ~gone)
    shown = F.filter(F.transform("comments", lambda x: F.struct(A.visible_text(x["author_name"]).alias("author_name"), A.visible_text(x["text"]).alias("text"), x["top_level_visible"].alias("top"))), lambda x: x["top"] & (x["text"] != ""))
    key = lambda x: F.struct(F.lower(x["author_name"]), x["text"])
    once = F.filter(shown, lambda x, i: F.array_position(F.transform(shown, key), key(x)) == i + 1)
    d = d.withColumn("said", F.coalesce(F.slice(once, 1, 5), F.array()))
    m = button_metrics(F.col("button_labels"))
    return d.select(
        "row_id", F.col("asked.url").alias("canonical_url"), F.col("asked.kind").alias("content_format"), said("author_name", "card_author").alias("author_name"), F.col("body").alias("body_text"),
        F.when(F.col("label").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("label")).otherwise("").alias("published_at"), F.col("label").alias("observed_time_label"),
        *[F.coalesce(m[k], F.col(f"card_{k}").cast("bigint")).alias(k) for k in m], F.col("said").alias("representative_comments"),
    )


def comment_captures(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """requests: request_id, signal_key, canonical_url, content_id, author_handle. captures: request_id, raw. Adds status,
    stop_reason, faults and the comments that stay (five at most)."""
    d = requests.join(captures.withColumn("c", F.from_json("raw", CAPTURE)).select("request_id", "raw", "c"), "request_id")
    stop, rows = F.lower(S.text(F.col("c.stop_reason"))), F.coalesce(F.col("c.comments"), F.array().cast(f"array<{_COMMENT}>"))
    same = (
        A.tiktok_identity(F.col("canonical_url")).eqNullSafe(A.tiktok_identity(F.col("c.canonical_url"))) & A.tiktok_identity(F.col("canonical_url")).isNotNull() & (S.text(F.col("c.content_id")) == S.text(F.col("content_id")))
        & (F.lower(F.regexp_replace(S.text(F.col("c.author_handle")), "^@+", "")) == F.lower(S.text(F.col("author_handle")))) & _checked(F.col("c.checks"), "comments")
    )
    made = F.transform(rows, lambda x: F.struct(
        S.text(S.first(x["author_name"], x["author"])).alias("author_name"), S.text(x["text"]).alias("text"), whole(x["likes"]).alias("likes"), S.text(x["published_at"]).alias("published_at"), S.text(x["observed_time_label"]).alias("observed_time_label")))
    d = d.withColumns({"made": made, "bad_text": comment_faults(rows), "same": F.coalesce(same, F.lit(False)), "stop": stop})
    keys = F.transform("made", lambda x: F.struct(F.lower(x["author_name"]), x["text"]))
    open_ = (F.col("stop") == "") & F.col("same")
    faults = _faults({
        "stop": (F.col("stop") != "") & ~F.col("stop").isin(*HARD_STOPS, "timeout", "comments_unavailable"), "limit": open_ & (F.size("made") > 5), "comments": open_ & (F.col("bad_text") | F.exists("made", lambda x: x["author_name"] == "")),
        "repeated": open_ & _repeated(keys), "total": open_ & (F.size("made") > 0) & ~F.coalesce(F.col("c.visible_comment_entry_count") >= F.size("made"), F.lit(False)),
    })
    d = d.withColumn("faults", faults)
    status = F.when(F.size("faults") > 0, "invalid").when(F.col("stop").isin(*HARD_STOPS), "blocked").when(F.col("stop") != "", "unavailable").when(~F.col("same"), "blocked").when(F.size("made") == 0, "unavailable").otherwise("captured")
    reason = F.when(F.col("stop") != "", F.col("stop")).when(~F.col("same"), "content_mismatch").when(F.size("made") == 0, "comments_unavailable").otherwise("")
    return d.select(
        "request_id", "signal_key", status.alias("status"), reason.alias("stop_reason"), "faults", F.when(status == "captured", F.col("made")).otherwise(F.array().cast(f"array<{OUT}>")).alias("comments"),
        F.col("c.visible_comment_entry_count").alias("visible_comment_entry_count"),
    )
