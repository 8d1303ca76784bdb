"""Queries over captures of hashtags, post searches, accounts, comments and rendered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..sources import details, rendered, social, views


def _k() -> Column:
    return F.col("o_orderkey")


def _checks(kind: str, ok: Column) -> Column:
    first, *rest = social.CHECKS[kind]
    return F.create_map(F.lit(first), ok, *[x for name in rest for x in (F.lit(name), F.lit(True))])


def _orders(spark: SparkSession, sf_dir: str, row: Column) -> DataFrame:
    """A customer's orders as the rows of one capture, by their numbers."""
    o = views.table(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_custkey").alias("capture_id")).agg(F.sort_array(F.collect_list(F.struct(_k().alias("k"), row.alias("x")))).alias("rows"))
    return g


def _list(keep, make) -> Column:
    return F.transform(F.filter("rows", lambda r: keep(r["k"])), lambda r: make(r["x"]))


def _instagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://www.instagram.com/"), F.when(_k() % 2 == 0, "p").otherwise("reel"), F.lit("/id"), _k(), F.lit("/?x=1"))
    comment = F.struct(F.lit("ann").alias("author_name"), F.concat(F.lit("said "), _k()).alias("text"), F.lit("2").alias("likes"), F.lit(True).alias("top_level_visible"))
    row = F.struct(url.alias("canonical_url"), F.concat(F.lit("@u"), F.col("o_custkey")).alias("author_username"), F.concat(F.lit("card  "), F.col("o_orderpriority")).alias("preview_text"),
                   F.concat(F.lit("seen "), F.col("o_orderstatus")).alias("caption"), F.lit("2024-01-01").alias("published_at"), F.concat(_k() % 90, F.lit("K")).alias("likes"), F.array(comment).alias("representative_comments"))
    g, c = _orders(spark, sf_dir, row), F.col("capture_id")
    same = lambda x: x
    raw = F.struct(
        F.lit("#Tag").alias("hashtag"), F.when(c % 13 == 0, "captcha").when(c % 17 == 0, "timeout").otherwise("").alias("stop_reason"), _checks("hashtag", c % 11 != 0).alias("checks"),
        F.array(_list(lambda k: F.lit(True), lambda x: x["canonical_url"]), _list(lambda k: k % 3 != 0, lambda x: x["canonical_url"])).alias("result_passes"),
        _list(lambda k: k % 5 == 1, same).alias("result_cards"), _list(lambda k: k % 7 == 0, same).alias("posts"),
    )
    return g.select("capture_id", F.lit("tag").alias("hashtag"), F.lit("category").alias("query_layer"), F.lit(24).alias("max_posts"), F.lit(6).alias("max_detail_posts"), F.to_json(raw).alias("raw"))


def hashtag_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = social.hashtag_captures(_instagram(spark, sf_dir))
    return d.select("capture_id", "status", "stop_reason", F.array_join("faults", ",").alias("faults"), F.size("observed").alias("observed"), F.bround("overlap", 6).alias("overlap"))


def hashtag_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = social.hashtag_signals(_instagram(spark, sf_dir))
    return s.select("capture_id", "content_id", "canonical_url", "content_format", "source_type", "title", "author_id", "likes", "search_rank", F.size("representative_comments").alias("comments"), "capture_key")


def _facebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid, shape = F.concat(F.lit("post"), _k()), _k() % 5
    url = F.when(shape == 0, F.concat(F.lit("https://m.facebook.com/reel/"), cid, F.lit("?s=1"))).when(shape == 1, F.concat(F.lit("https://facebook.com/some.one/posts/"), cid)).when(
        shape == 2, F.concat(F.lit("https://www.facebook.com/share/p/"), cid, F.lit("/"))).when(shape == 3, F.concat(F.lit("https://www.facebook.com/photo/?fbid="), cid, F.lit("&set=a"))).otherwise(
        F.concat(F.lit("https://www.facebook.com/permalink.php?id=9&story_fbid="), cid))
    row = F.struct(url.alias("canonical_url"), F.lit("Ann").alias("author_name"), F.concat(F.lit("card "), F.col("o_orderpriority")).alias("preview_text"), F.concat(F.lit("body "), F.col("o_orderstatus")).alias("body_text"),
                   F.when(_k() % 4 == 0, "").otherwise("3d").alias("observed_time_label"), F.when(_k() % 4 == 0, "2024-01-01").otherwise("").alias("published_at"), (_k() % 90).cast("string").alias("reactions"))
    g, c = _orders(spark, sf_dir, row), F.col("capture_id")
    same = lambda x: x
    raw = F.struct(F.when(c % 19 == 0, "private_content").otherwise("").alias("stop_reason"), _checks("posts", c % 11 != 0).alias("checks"), F.array(_list(lambda k: F.lit(True), lambda x: x["canonical_url"])).alias("result_passes"),
                   _list(lambda k: k % 2 == 0, same).alias("result_cards"), _list(lambda k: k % 6 == 0, same).alias("posts"))
    return g.select("capture_id", F.lit("term").alias("query_term"), F.lit("category").alias("query_layer"), F.lit(20).alias("max_posts"), F.lit(5).alias("max_detail_posts"), F.to_json(raw).alias("raw"))


def post_search_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = social.post_search_captures(_facebook(spark, sf_dir))
    return d.select("capture_id", "status", "stop_reason", F.array_join("faults", ",").alias("faults"), "detail_open_count")


def post_search_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = social.post_search_signals(_facebook(spark, sf_dir))
    return s.select("capture_id", "content_id", "canonical_url", "content_format", "source_type", "summary", "published_at", "reactions", "search_rank")


def account_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://www.instagram.com/"), F.when(_k() % 3 == 0, F.concat(F.lit("Acct"), F.col("o_custkey"), F.lit("/"))).otherwise(""), F.lit("p/id"), _k(), F.lit("/"))
    author = F.concat(F.lit("@"), F.when((F.col("o_custkey") % 5 == 0) & (_k() % 2 == 0), "other").otherwise(F.concat(F.lit("acct"), F.col("o_custkey"))))
    row = F.struct(url.alias("canonical_url"), author.alias("author_username"), (_k() % 4 == 0).alias("detail_captured"), F.concat(F.lit("text "), F.col("o_orderstatus")).alias("caption"), F.lit("2024-01-01").alias("published_at"), (_k() % 90).cast("string").alias("likes"))
    g, c = _orders(spark, sf_dir, row), F.concat(F.lit("acct"), F.col("capture_id"))
    raw = F.struct(c.alias("username"), _checks("account", F.lit(True)).alias("checks"), _list(lambda k: F.lit(True), lambda x: x).alias("posts"))
    d = g.select("capture_id", c.alias("username"), F.lit(12).alias("max_posts"), F.lit(6).alias("max_detail_posts"), F.to_json(raw).alias("raw"))
    return social.account_signals(d).select("capture_id", "content_id", "canonical_url", "source_type", "summary", "likes", "search_rank", "search_result_count")


def meta_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    said = F.concat(F.lit('a "quoted" note '), k)
    return social.meta_details(p.select(
        "page_id", F.concat(F.lit("https://instagram.com/some.one/reel/x"), k, F.lit("/?a")).alias("canonical_url"),
        F.when(k % 4 == 0, "no meta").otherwise(F.concat(F.format_number(k * 1001, 0), F.lit(" likes, "), k % 50, F.lit(' comments - user.x on May 1: "'), said, F.lit('".'))).alias("description"),
        F.when(k % 3 == 0, F.concat(F.lit('Ann on Instagram: "title '), k, F.lit('"'))).otherwise("").alias("og_title"), F.lit(" 2024 ").alias("published_at"),
    ))


def card_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    none = F.lit(None).cast("bigint")
    c = lambda author, text, top: F.struct(F.lit(author).alias("author_name"), F.lit(text).alias("text"), F.lit(top).alias("top_level_visible"))
    d = p.select(
        k.alias("row_id"), F.concat(F.lit("https://www.facebook.com/reel/page"), k).alias("requested_url"), F.concat(F.lit("https://m.facebook.com/reel/page"), F.when(k % 7 == 0, k + 1).otherwise(k), F.lit("/?x")).alias("canonical_url"),
        F.lit("").alias("author_name"), F.when(k % 3 == 0, F.concat(F.lit("body b�d "), k)).otherwise("").alias("description"), F.when(k % 5 == 0, "This content isn't available now").otherwise("visible").alias("visible_text"), F.lit("").alias("og_title"),
        F.when(k % 2 == 0, "2024-01-01 10:00").otherwise("").alias("observed_time_label"),
        F.array(F.concat(k % 40, F.lit(" comments")), F.lit("99 comments"), F.lit("Share"), F.lit("1.5K views"), F.concat(F.lit("All reactions: "), k % 9)).alias("button_labels"),
        F.array(c("ann", "yes", True), c("Ann", "yes", True), c("bob", "", True), c("bob", "no", False), c("bob", "well", True)).alias("comments"), F.lit("Card Author").alias("card_author"), F.lit("2d").alias("card_time_label"),
        none.alias("card_reactions"), none.alias("card_comments"), (k % 6).alias("card_shares"), none.alias("card_views"),
    )
    r = social.card_details(d)
    return r.select("row_id", "canonical_url", "author_name", "body_text", "published_at", "observed_time_label", "reactions", "comments", "shares", "views", F.array_join(F.transform("representative_comments", lambda x: x["text"]), "|").alias("said"))


def comment_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in a conversation as the comments of one video."""
    t = views.table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    row = F.struct(F.concat(F.lit("u"), F.col("turn")).alias("author_name"), F.col("text").alias("text"), F.lit(True).alias("top_level_visible"))
    g = t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", row.alias("x"))))), lambda x: x["x"]).alias("comments"))
    url = F.concat(F.lit("https://www.tiktok.com/@an.n/video/"), F.abs(k))
    raw = F.struct(url.alias("canonical_url"), F.abs(k).cast("string").alias("content_id"), F.when(k % 7 == 0, "@bob").otherwise("@An.N").alias("author_handle"), F.when(k % 11 == 0, "timeout").otherwise("").alias("stop_reason"),
                   _checks("comments", F.lit(True)).alias("checks"), F.col("comments"), F.when(k % 3 == 0, 0).otherwise(10).alias("visible_comment_entry_count"))
    requests = g.select(k.alias("request_id"), k.alias("signal_key"), url.alias("canonical_url"), F.abs(k).cast("string").alias("content_id"), F.lit("an.n").alias("author_handle"))
    r = social.comment_captures(requests, g.select(k.alias("request_id"), F.to_json(raw).alias("raw")))
    return r.select("request_id", "status", "stop_reason", F.array_join("faults", ",").alias("faults"), F.size("comments").alias("comments"))


def rendered_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("Top\r\n---\n"), k, F.lit("K\n12\nFavorites\n7\nShare\n3\n---\nAnn Name [1]\n · 2-3\n\nBody **of** "), k, F.lit(" more text\n[2]\n---\nComments\nann\nnice "), k,
                    F.lit("\n5 likes\n2d ago\n---\nbob\nok\nYou may like\nother\n---\n[1] https://www.tiktok.com/@me.x/video/"), k, F.lit("\n"))
    target = F.concat(F.lit("https://www.tiktok.com/@Me.x/"), F.when(F.col("page_id") % 2 == 0, "video").otherwise("photo"), F.lit("/"), F.when(F.col("page_id") % 9 == 0, "1").otherwise(k))
    d = rendered.tiktok_details(p.select(F.col("page_id").alias("target_id"), target.alias("target_url"), text.alias("raw")))
    return d.select("target_id", "canonical_url", "summary", "published_at", "author_name", "likes", "comments", "shares", "saves", F.to_json("representative_comments").alias("said"), "other_format")


def rendered_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("# Page\nAnn Name [2]\n@han_dle [3]\n---\nThe body "), k, F.lit("\nShow more\n---\n1:02 PM · Jan 2, 2024 · 3.5K Views\n"), k, F.lit(" Likes 2 Replies 1,200 Reposts\nhttps://x.com/han_dle/status/"), k)
    d = rendered.x_details(p.select(F.col("page_id").alias("target_id"), F.lit("https://x.com/other/status/1").alias("target_url"), F.when(F.col("page_id") % 8 == 0, "no sections").otherwise(text).alias("raw")))
    return d.select("target_id", "canonical_url", "title", "summary", "published_at", "views", "likes", "comments", "shares", "author_name", "author_id")


def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two posts on one rendered page, matched to their addresses in order."""
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    text = F.concat(F.lit("**Ann** @ann\nfirst "), k, F.lit("\n5 Likes\n---\n**Ann** @ann\nsecond "), k, F.lit("\n7 likes 2 replies\n---\nhttps://x.com/Ann/status/"), k * 10, F.lit("\nhttps://x.com/ann/status/"), k * 10 + 1, F.lit("\nhttps://x.com/ann/status/"), k * 10)
    d = details.rendered_x_posts(p.select(k.alias("target_id"), text.alias("raw")))
    return d.select("target_id", "content_id", "summary", "likes", "comments")


def thread_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    row = F.struct(_k().cast("string").alias("id"), F.concat(F.lit("text  "), F.col("o_orderpriority")).alias("text"), F.when(_k() % 9 == 0, "").otherwise("@ann").alias("author"), F.concat(_k() % 30, F.lit("K")).alias("likes"))
    g = o.groupBy("o_custkey").agg(F.min("o_orderkey").cast("string").alias("target_id"), F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("x")))), lambda x: x["x"]).alias("rows"))
    d = details.x_threads(g.select("target_id", F.to_json("rows").alias("raw")))
    return d.select("target_id", "title", "summary", "likes", F.size("representative_comments").alias("replies"))


def video_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as videos: objects, or lists of fields and values."""
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    values = {"title": F.col("p_name"), "channel": F.col("p_brand"), "description": F.when(k % 6 == 0, "").otherwise(F.col("p_type")), "views": F.concat(k, F.lit(" views")), "channelId": F.lit("c1")}
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in values.items()])
    raw = F.when(k % 2 == 0, F.to_json(F.struct(*[v.alias(n) for n, v in values.items()]))).otherwise(F.to_json(pairs))
    return details.youtube_details(p.select(k.alias("target_id"), raw.alias("raw"))).select("target_id", "title", "summary", "views", "author_id", "author_name")


def panel_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as comments below a video and below a note, whose replies don't count."""
    t = views.table(spark, sf_dir, "conversations")
    row = F.struct(F.col("role").alias("author"), F.col("text").alias("text"), F.lit("1.2万").alias("likes"), (F.col("turn") % 2 == 1).alias("is_reply"))
    g = t.groupBy(F.col("conv_id").alias("target_id")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", row.alias("x")))), lambda x: x["x"])).alias("raw"))
    v, n = details.youtube_comments(g), details.xiaohongshu_comments(g).withColumnRenamed("representative_comments", "notes")
    return v.join(n, "target_id").select("target_id", F.size("representative_comments").alias("video_comments"), F.size("notes").alias("note_comments"), F.coalesce(F.array_max(F.transform("notes", lambda x: x["likes"])), F.lit(0)).alias("most_likes"))


def post_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct references of each customer's orders, by status number or address."""
    o = views.table(spark, sf_dir, "orders")
    ref = F.when(_k() % 3 == 0, F.concat(F.lit("https://x.com/a"), _k(), F.lit("/status/"), _k() % 20)).when(_k() % 3 == 1, F.concat(F.lit("https://Test.com/"), _k() % 10, F.lit("/"))).otherwise(F.concat(F.lit(" https://test.com/"), _k() % 10))
    g = o.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", ref.alias("r")))), lambda x: x["r"]).alias("refs"))
    return g.select("o_custkey", F.array_join(A.distinct_references(F.col("refs")), ",").alias("refs"))


def visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    t = F.concat(F.lit("one  t�o "), F.col("url"), F.when(F.col("page_id") % 2 == 0, "  �").otherwise(""))
    plain = F.concat(F.lit("one  two "), F.col("url"))
    return p.select("page_id", A.visible_text(F.when(F.col("page_id") % 3 == 0, plain).otherwise(t)).alias("visible"))


QUERIES = {
    "hashtag_captures": hashtag_captures, "post_search_captures": post_search_captures, "hashtag_signals": hashtag_signals, "post_search_signals": post_search_signals, "account_posts": account_posts, "meta_details": meta_details,
    "card_details": card_details, "comment_captures": comment_captures, "rendered_videos": rendered_videos, "rendered_posts": rendered_posts, "page_posts": page_posts, "thread_details": thread_details, "video_details": video_details,
    "panel_comments": panel_comments, "post_addresses": post_addresses, "visible_texts": visible_texts,
}

_TAGGED = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS pr, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
g AS (SELECT c, count(*) AS n, count(*) FILTER (k % 7 = 0) AS nd, count(*) FILTER (k % 5 = 1) AS nc, count(*) FILTER (k % 3 <> 0) AS p2, CASE WHEN c % 13 = 0 THEN 'captcha' WHEN c % 17 = 0 THEN 'timeout' ELSE '' END AS stop FROM o GROUP BY c),
f AS (SELECT *, concat_ws(',', CASE WHEN stop = '' AND n > 24 THEN 'passes' END, CASE WHEN nc > 24 THEN 'cards' END, CASE WHEN nd > 6 THEN 'details' END) AS faults FROM g),
v AS (SELECT *, CASE WHEN faults <> '' THEN 'invalid' WHEN stop = 'captcha' THEN 'blocked' WHEN stop <> '' THEN 'unavailable' WHEN c % 11 = 0 THEN 'blocked' WHEN nd > 0 THEN 'captured' ELSE 'unavailable' END AS status FROM f)"""
_POSTED = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS pr, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
g AS (SELECT c, count(*) AS n, count(*) FILTER (k % 6 = 0) AS nd, count(*) FILTER (k % 2 = 0) AS nc, CASE WHEN c % 19 = 0 THEN 'private_content' WHEN c % 11 = 0 THEN 'content_mismatch' ELSE '' END AS stop FROM o GROUP BY c),
f AS (SELECT *, concat_ws(',', CASE WHEN n > 20 THEN 'passes' END, CASE WHEN nc > 20 OR nd > 5 THEN 'limits' END) AS faults FROM g),
v AS (SELECT *, CASE WHEN faults <> '' THEN 'invalid' WHEN stop <> '' THEN 'blocked' WHEN nd > 0 THEN 'captured' ELSE 'unavailable' END AS status FROM f)"""
SQL = {
    "hashtag_captures": f"""WITH {_TAGGED} SELECT c AS capture_id, status, CASE WHEN faults <> '' OR stop <> '' THEN stop WHEN c % 11 = 0 THEN 'content_mismatch' WHEN nd > 0 THEN '' ELSE 'details_unavailable' END AS stop_reason,
  faults, CAST(n AS INT) AS observed, round_even(p2 / n::DOUBLE, 6) AS overlap FROM v""",
    "post_search_captures": f"""WITH {_POSTED} SELECT c AS capture_id, status, CASE WHEN stop <> '' THEN stop WHEN nd = 0 THEN 'details_unavailable' ELSE '' END AS stop_reason, faults, CAST(nd AS INT) AS detail_open_count FROM v""",
    "account_posts": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, row_number() OVER w AS pos, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (o_orderkey % 4 = 0) OVER (PARTITION BY o_custkey) AS nd,
  count(*) FILTER (o_custkey % 5 = 0 AND o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey) AS alien FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT c AS capture_id, 'id' || k AS content_id, 'https://www.instagram.com/' || CASE WHEN k % 3 = 0 THEN 'Acct' || c || '/' ELSE '' END || 'p/id' || k || '/' AS canonical_url, CASE WHEN k % 4 = 0 THEN 'direct_post' ELSE 'search_card' END AS source_type,
  'text ' || st AS summary, k % 90 AS likes, CAST(pos AS INT) AS search_rank, CAST(n AS INT) AS search_result_count FROM o WHERE alien = 0 AND n <= 12 AND nd BETWEEN 1 AND 6""",
    "meta_details": """SELECT page_id, 'https://www.instagram.com/reel/x' || page_id || '/' AS canonical_url, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'user.x' END AS author_username,
  CASE WHEN page_id % 3 = 0 THEN 'title ' || page_id WHEN page_id % 4 = 0 THEN '' ELSE 'a "quoted" note ' || page_id END AS caption, '2024' AS published_at, CASE WHEN page_id % 4 <> 0 THEN page_id * 1001 END AS likes, CASE WHEN page_id % 4 <> 0 THEN page_id % 50 END AS comments FROM pages""",
    "card_details": """WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 3 = 0 THEN 'body ' || page_id WHEN page_id % 5 = 0 THEN '' ELSE 'visible' END AS b FROM pages WHERE page_id % 7 <> 0)
SELECT k AS row_id, 'https://www.facebook.com/reel/page' || k || '/' AS canonical_url, 'Card Author' AS author_name, b AS body_text, CASE WHEN k % 2 = 0 THEN '2024-01-01 10:00' ELSE '' END AS published_at, CASE WHEN k % 2 = 0 THEN '2024-01-01 10:00' ELSE '2d' END AS observed_time_label,
  k % 9 AS reactions, k % 40 AS comments, k % 6 AS shares, 1500 AS views, 'yes|well' AS said FROM p WHERE b <> ''""",
    "comment_captures": r"""WITH g AS (SELECT conv_id AS k, count(*) FILTER (role = 'user') AS n, count(*) FILTER (role = 'user' AND regexp_replace(coalesce(text, ''), '[\s\p{Z}]', '', 'g') = '') AS b FROM conversations GROUP BY ALL),
s AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'timeout' ELSE '' END AS stop, k % 11 <> 0 AND k % 7 <> 0 AS fine FROM g),
f AS (SELECT *, concat_ws(',', CASE WHEN fine AND n > 5 THEN 'limit' END, CASE WHEN fine AND b > 0 THEN 'comments' END, CASE WHEN fine AND n > 0 AND (CASE WHEN k % 3 = 0 THEN 0 ELSE 10 END) < n THEN 'total' END) AS faults FROM s),
v AS (SELECT *, CASE WHEN faults <> '' THEN 'invalid' WHEN stop <> '' THEN 'unavailable' WHEN NOT fine THEN 'blocked' WHEN n = 0 THEN 'unavailable' ELSE 'captured' END AS status FROM f)
SELECT k AS request_id, status, CASE WHEN stop <> '' THEN stop WHEN NOT fine THEN 'content_mismatch' WHEN n = 0 THEN 'comments_unavailable' ELSE '' END AS stop_reason, faults, CAST(CASE WHEN status = 'captured' THEN n ELSE 0 END AS INT) AS comments FROM v""",
    "rendered_videos": """SELECT page_id AS target_id, 'https://www.tiktok.com/@Me.x/video/' || page_id AS canonical_url, 'Body of ' || page_id || ' text' AS summary, '2-3' AS published_at, 'Ann Name' AS author_name, page_id * 1000 AS likes, 12 AS comments, 7 AS shares, 7 AS saves,
  '[{"author_name":"ann","text":"nice ' || page_id || '","likes":5,"published_at":"2d ago"},{"author_name":"bob","text":"ok","published_at":""}]' AS said, page_id % 2 <> 0 AS other_format FROM pages WHERE page_id % 9 <> 0 OR page_id = 1""",
    "rendered_posts": """SELECT page_id AS target_id, 'https://x.com/han_dle/status/' || page_id AS canonical_url, 'The body ' || page_id AS title, 'The body ' || page_id AS summary, '1:02 PM' AS published_at, 3500 AS views, page_id AS likes, 2 AS comments, 1200 AS shares,
  'Ann Name' AS author_name, '@han_dle' AS author_id FROM pages WHERE page_id % 8 <> 0""",
    "page_posts": """SELECT page_id AS target_id, CAST(page_id * 10 AS VARCHAR) AS content_id, 'first ' || page_id AS summary, 5 AS likes, NULL::BIGINT AS comments FROM pages
UNION ALL SELECT page_id, CAST(page_id * 10 + 1 AS VARCHAR), 'second ' || page_id, 7, 2 FROM pages""",
    "thread_details": """WITH g AS (SELECT o_custkey, min(o_orderkey) AS k, count(*) AS n, arg_min(o_orderpriority, o_orderkey) AS pr FROM orders GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS target_id, 'text ' || pr AS title, 'text  ' || pr AS summary, k % 30 * 1000 AS likes, CAST(least(5, n - 1) AS INT) AS replies FROM g WHERE k % 9 <> 0""",
    "video_details": "SELECT p_partkey AS target_id, p_name AS title, p_type AS summary, p_partkey AS views, 'c1' AS author_id, p_brand AS author_name FROM part WHERE p_partkey % 6 <> 0",
    "panel_comments": r"""WITH t AS (SELECT *, regexp_replace(coalesce(text, ''), '[\s\p{Z}]', '', 'g') <> '' AS said FROM conversations)
SELECT conv_id AS target_id, CAST(least(10, count(*) FILTER (said)) AS INT) AS video_comments, CAST(least(5, count(*) FILTER (said AND turn % 2 <> 1)) AS INT) AS note_comments, CASE WHEN count(*) FILTER (said AND turn % 2 <> 1) > 0 THEN 12000 ELSE 0 END AS most_likes FROM t GROUP BY ALL""",
    "post_addresses": """WITH r AS (SELECT o_custkey, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'https://x.com/a' || o_orderkey || '/status/' || (o_orderkey % 20) WHEN 1 THEN 'https://Test.com/' || (o_orderkey % 10) || '/' ELSE 'https://test.com/' || (o_orderkey % 10) END AS ref,
  CASE o_orderkey % 3 WHEN 0 THEN 's' || (o_orderkey % 20) ELSE 'u' || (o_orderkey % 10) END AS key FROM orders),
f AS (SELECT o_custkey, min(k) AS k, arg_min(ref, k) AS ref FROM r GROUP BY o_custkey, key) SELECT o_custkey, string_agg(ref, ',' ORDER BY k) AS refs FROM f GROUP BY ALL""",
    "visible_texts": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'one  two ' || url ELSE 'one ' || url END AS visible FROM pages",
    "hashtag_signals": f"""WITH {_TAGGED} SELECT c AS capture_id, 'id' || k AS content_id, 'https://www.instagram.com/' || kind || '/id' || k || '/' AS canonical_url, kind AS content_format,
  CASE WHEN k % 7 = 0 THEN 'direct_post' ELSE 'search_card' END AS source_type, CASE WHEN k % 7 = 0 THEN 'seen ' || st WHEN k % 5 = 1 THEN 'card ' || pr ELSE '' END AS title, CASE WHEN k % 7 = 0 OR k % 5 = 1 THEN 'u' || c ELSE '' END AS author_id,
  CASE WHEN k % 7 = 0 THEN k % 90 * 1000 END AS likes, CAST(pos AS INT) AS search_rank, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS comments, sha256('instagram:id' || k) AS capture_key
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'p' ELSE 'reel' END AS kind FROM o JOIN v USING (c) WHERE status = 'captured')""",
    "post_search_signals": f"""WITH {_POSTED} SELECT c AS capture_id, 'post' || k AS content_id, 'https://www.facebook.com/' || CASE k % 5 WHEN 0 THEN 'reel/post' || k || '/' WHEN 1 THEN 'some.one/posts/post' || k || '/' WHEN 2 THEN 'share/p/post' || k || '/'
  WHEN 3 THEN 'photo/?fbid=post' || k ELSE 'permalink.php?story_fbid=post' || k END AS canonical_url, CASE k % 5 WHEN 0 THEN 'reel' WHEN 3 THEN 'photo' ELSE 'post' END AS content_format, CASE WHEN k % 6 = 0 THEN 'direct_post' ELSE 'search_card' END AS source_type,
  CASE WHEN k % 6 = 0 THEN 'body ' || st ELSE 'card ' || pr END AS summary, CASE WHEN k % 4 = 0 THEN '2024-01-01' ELSE '' END AS published_at, k % 90 AS reactions, CAST(pos AS INT) AS search_rank FROM o JOIN v USING (c) WHERE status = 'captured' AND k % 2 = 0""",
}
