"""Extraction jobs for opened pages: details and bounded comment samples of one target each.

Input: capture rows (target_id, raw). A target whose record lacks what identifies it gives no row. Comments are a
sample for review; they never add to a sample's volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

_COMMENT = "struct<author_name:string,text:string,likes:bigint,reply_count:bigint,observed_time_label:string>"
_THREAD = "array<struct<id:string,text:string,author:string,created_at:string,views:string,likes:string,replies:string,retweets:string>>"
_YOUTUBE = "array<struct<text:string,content:string,comment:string,author:string,authorName:string,likes:string,replies:string,replyCount:string,time:string,published:string,publishedAt:string>>"
_XHS = "array<struct<text:string,author:string,likes:string,time:string,is_reply:boolean>>"


def _comments(rows: Column, make, keep, limit: int) -> Column:
    found = F.filter(F.transform(F.filter(rows, keep), make), lambda c: c["text"] != "")
    return F.coalesce(F.slice(found, 1, limit), F.array().cast(f"array<{_COMMENT}>"))


def _comment(author: Column, text: Column, likes: Column, replies: Column, label: Column) -> Column:
    return F.struct(author.alias("author_name"), text.alias("text"), likes.alias("likes"), replies.alias("reply_count"), label.alias("observed_time_label"))


def _handle(c: Column) -> Column:
    return F.regexp_replace(S.text(c), "^@+", "")


def x_threads(captures: DataFrame, limit: int = 5) -> DataFrame:
    """The target post of a thread and up to `limit` of the other posts in it."""
    d = captures.withColumn("r", F.from_json("raw", _THREAD)).withColumn("p", F.get(F.filter("r", lambda x: x["id"] == F.col("target_id")), F.lit(0)))
    d = d.where((S.text(F.col("p.text")) != "") & (_handle(F.col("p.author")) != ""))
    make = lambda x: _comment(_handle(x["author"]), S.text(x["text"]), S.parse_count(x["likes"]), S.parse_count(x["replies"]), S.text(x["created_at"]))
    return d.select(
        "target_id", F.substring(F.regexp_replace(S.text(F.col("p.text")), r"[\s\p{Z}]+", " "), 1, 180).alias("title"), S.text(F.col("p.text")).alias("summary"), S.text(F.col("p.created_at")).alias("published_at"),
        S.parse_count(F.col("p.views")).alias("views"), S.parse_count(F.col("p.likes")).alias("likes"), S.parse_count(F.col("p.replies")).alias("comments"), S.parse_count(F.col("p.retweets")).alias("shares"),
        _handle(F.col("p.author")).alias("author_id"), _comments(F.col("r"), make, lambda x: ~F.coalesce(x["id"] == F.col("target_id"), F.lit(False)), limit).alias("representative_comments"),
    )


def youtube_details(captures: DataFrame) -> DataFrame:
    """From an object, or a list of {field, value}."""
    pairs = F.from_json("raw", "array<struct<field:string,value:string>>")
    fields = F.when(F.ltrim("raw").startswith("["), F.map_from_entries(F.filter(pairs, lambda x: x["field"].isNotNull()))).otherwise(F.from_json("raw", "map<string,string>"))
    d = captures.withColumn("m", fields)
    get = lambda *names: S.text(S.first(*[F.try_element_at("m", F.lit(n)) for n in names]))
    count = lambda c: S.parse_count(c, "kmb万亿", anchored=False)
    return d.where((get("title") != "") & (get("channel") != "") & (get("description") != "")).select(
        "target_id", get("title").alias("title"), get("description").alias("summary"), get("publishDate", "published_at").alias("published_at"), count(get("views")).alias("views"), count(get("likes")).alias("likes"),
        get("channelId").alias("author_id"), get("channel").alias("author_name"), count(get("subscribers")).alias("follower_count"), count(get("duration")).alias("duration_seconds"),
    )


def youtube_comments(captures: DataFrame, limit: int = 10) -> DataFrame:
    name = lambda x: S.text(S.first(F.get_json_object(x["author"], "$.name"), F.get_json_object(x["author"], "$.handle"), F.when(~x["author"].startswith("{"), x["author"]), x["authorName"]))
    count = lambda c: S.parse_count(c, "kmb万亿", anchored=False)
    make = lambda x: _comment(name(x), S.text(S.first(x["text"], x["content"], x["comment"])), count(x["likes"]), count(S.first(x["replies"], x["replyCount"])), S.text(S.first(x["time"], x["published"], x["publishedAt"])))
    return captures.select("target_id", _comments(F.from_json("raw", _YOUTUBE), make, lambda x: x.isNotNull(), limit).alias("representative_comments"))


def xiaohongshu_comments(captures: DataFrame, limit: int = 5) -> DataFrame:
    make = lambda x: _comment(S.text(x["author"]), S.text(x["text"]), S.parse_count(x["likes"], "万w"), F.lit(None).cast("bigint"), S.text(x["time"]))
    return captures.select("target_id", _comments(F.from_json("raw", _XHS), make, lambda x: ~F.coalesce(x["is_reply"], F.lit(False)), limit).alias("representative_comments"))


_HEADING = r"(?m)^\s*(?:#+\s*)?\*{0,2}([^\n@*]{1,80}?)\*{0,2}\s*@([A-Za-z0-9_]{1,15})\b"
_ADDRESS = r"https?://(?:www\.)?x\.com/([A-Za-z0-9_]{1,15})/status/(\d+)"


def rendered_x_posts(captures: DataFrame) -> DataFrame:
    """Posts of a page rendered as text: blocks between lines of ---, each with a heading that ends in @handle. The
    k-th block of a handle belongs to the k-th different address of that handle on the page."""
    c = captures.select("target_id", F.regexp_replace("raw", "\r\n", "\n").alias("raw"))
    b = c.select("target_id", F.posexplode(F.split("raw", r"(?m)^---[ \t]*$")).alias("at", "block"))
    b = b.withColumn("handle", F.regexp_extract("block", _HEADING, 2)).where("handle <> ''").withColumn("key", F.lower("handle"))
    body = F.regexp_replace("block", f"(?s)^.*?{_HEADING[4:]}", "")
    lines = F.filter(F.transform(F.split(body, "\n"), S.text), lambda x: (x != "") & (x != "Show more") & ~x.rlike("^https?://") & ~x.rlike(r"(?i)^(?:[\d,.]+\s+(?:replies|reply|reposts?|likes?|views?|bookmarks?)\s*)+$"))
    b = b.withColumn("summary", F.trim(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\[\d+\]|\*\*", "")), " "))).where("summary <> ''")
    count = lambda word: F.regexp_extract("block", rf"(?i)([\d,]+)\s+{word}", 1)
    b = b.withColumns({n: F.replace(count(w), F.lit(","), F.lit("")).try_cast("bigint") for n, w in {"views": "views?", "likes": "likes?", "comments": "repl(?:y|ies)", "shares": "reposts?", "saves": "bookmarks?"}.items()})
    b = b.selectExpr("*", "row_number() OVER (PARTITION BY target_id, key ORDER BY at) AS k")
    pair = F.arrays_zip(F.regexp_extract_all("raw", F.lit(_ADDRESS), 1).alias("h"), F.regexp_extract_all("raw", F.lit(_ADDRESS), 2).alias("i"))
    a = c.select("target_id", F.posexplode(pair).alias("p", "z")).groupBy("target_id", F.lower("z.h").alias("key"), F.col("z.i").alias("content_id")).agg(F.min("p").alias("p"))
    a = a.selectExpr("target_id", "key", "content_id", "row_number() OVER (PARTITION BY target_id, key ORDER BY p) AS k")
    return b.join(a, ["target_id", "key", "k"]).select(
        "target_id", "content_id", F.concat(F.lit("https://x.com/"), F.col("handle"), F.lit("/status/"), F.col("content_id")).alias("canonical_url"), F.col("handle").alias("author_id"), "summary",
        "views", "likes", "comments", "shares", "saves", F.col("at").alias("position"),
    )
