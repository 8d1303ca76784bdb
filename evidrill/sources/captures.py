"""Extraction jobs: raw search captures, as JSON text, become signals.

A capture is (capture_id, query_term, query_layer, raw) with raw a JSON array of records. Records without an id or
a body are dropped, the first record of an id wins, and the rank is the place in the array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .staging import staged

_TEXT = {
    "x": "id string, url string, text string, author string, created_at string, views string, likes string, bookmarks string, replies string, retweets string",
    "youtube": "url string, video_id string, title string, channel string, views string, rank string, published string, duration string",
    "tiktok": "url string, video_id string, desc string, description string, author string, plays string, likes string, comments string, shares string, rank string",
    "xiaohongshu": "url string, title string, author string, author_url string, likes string, published_at string, rank string",
    "reddit": "id string, title string, selftext string, subreddit string, permalink string, url string, author string, created_utc string, num_comments string, score string, upvote_ratio string",
}


def youtube_id(url: Column) -> Column:
    """From ?v=, /shorts/, /embed/ or youtu.be/."""
    asked = F.regexp_extract(url, r"^https?://[^/]*youtube\.com/[^#]*[?&]v=([^&#]+)", 1)
    path = F.regexp_extract(url, r"^https?://[^/]*youtube\.com/(?:[^?#]*/)?(?:shorts|embed)/([A-Za-z0-9_-]{6,})", 1)
    short = F.regexp_extract(url, r"^https?://(?:www\.)?youtu\.be/([^/?#]+)", 1)
    return F.coalesce(*[F.when(x != "", x) for x in (short, asked, path)], F.lit(""))


def _fields(kind: str) -> dict[str, Column]:
    r = {f.split()[0]: S.text(F.col("r." + f.split()[0])) for f in _TEXT[kind].split(", ")}

    def one_of(*cols: Column) -> Column:
        return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))

    def count(name: str, **options) -> Column:
        return S.parse_count(r[name], **options)

    none = F.lit(None).cast("bigint")
    if kind == "x":
        handle = F.regexp_replace(r["author"], "^@+", "")
        cid = one_of(r["id"], F.regexp_extract(r["url"], r"/status/(\d+)", 1))
        url = F.concat(F.lit("https://x.com/"), one_of(handle, F.lit("i")), F.lit("/status/"), cid)
        return {"content_id": cid, "body": r["text"], "canonical_url": url, "author_id": handle, "published": r["created_at"], "views": count("views"), "likes": count("likes"),
                "saves": count("bookmarks"), "comments": count("replies"), "shares": count("retweets")}
    if kind == "youtube":
        cid = one_of(r["video_id"], youtube_id(r["url"]))
        return {"content_id": cid, "body": r["title"], "canonical_url": F.concat(F.lit("https://www.youtube.com/watch?v="), cid), "author_id": r["channel"], "published": r["published"],
                "views": count("views", suffixes="kmb万亿", anchored=False), "likes": none, "saves": none, "comments": none, "shares": none}
    if kind == "tiktok":
        cid, handle = one_of(r["video_id"], F.regexp_extract(r["url"], r"/video/(\d+)", 1)), F.regexp_replace(r["author"], "^@+", "")
        url = F.when(handle != "", F.concat(F.lit("https://www.tiktok.com/@"), handle, F.lit("/video/"), cid)).otherwise(r["url"])
        return {"content_id": cid, "body": one_of(r["desc"], r["description"]), "canonical_url": url, "author_id": handle, "published": F.lit(""), "views": count("plays"), "likes": count("likes"),
                "saves": none, "comments": count("comments"), "shares": count("shares")}
    if kind == "xiaohongshu":
        cid = F.regexp_extract(r["url"], r"/(?:search_result|explore)/([a-zA-Z0-9]+)", 1)
        return {"content_id": cid, "body": r["title"], "canonical_url": F.concat(F.lit("https://www.xiaohongshu.com/explore/"), cid), "author_id": F.regexp_extract(r["author_url"], r"/user/profile/([a-zA-Z0-9]+)", 1),
                "published": r["published_at"], "views": none, "likes": count("likes", suffixes="万w"), "saves": none, "comments": none, "shares": none}
    url = F.when(r["permalink"].startswith("/"), F.concat(F.lit("https://www.reddit.com"), r["permalink"])).when(
        r["permalink"].rlike(r"^https://(www\.)?reddit\.com/"), r["permalink"]
    ).otherwise(F.concat(F.lit("https://www.reddit.com/r/"), F.regexp_replace(r["subreddit"], "^r/|/+$", ""), F.lit("/comments/"), r["id"], F.lit("/")))
    posted = F.date_format(F.timestamp_seconds(F.floor(r["created_utc"].try_cast("double"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # a post's score isn't its likes
    return {"content_id": r["id"], "body": r["title"], "canonical_url": url, "author_id": r["author"], "published": F.coalesce(posted, F.lit("")), "views": none, "likes": none, "saves": none,
            "comments": r["num_comments"].try_cast("double").cast("bigint"), "shares": none}


def extract(captures: DataFrame, kind: str) -> DataFrame:
    """Signals of one platform's captures."""
    records = F.from_json("raw", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in _TEXT[kind].split(', '))}>>")
    e = captures.withColumn("_records", records).select("capture_id", "query_term", "query_layer", F.size("_records").alias("n"), F.posexplode("_records").alias("pos", "r"))
    fields = _fields(kind)
    e = e.select("capture_id", "query_term", "query_layer", "n", "pos", *[v.alias(k) for k, v in fields.items()]).where("content_id <> '' AND body <> ''")
    once = Window.partitionBy("capture_id", "content_id").orderBy("pos")
    e = e.withColumn("_k", F.row_number().over(once)).where("_k = 1")
    return e.select(
        "capture_id", F.lit(kind).alias("platform"), "content_id", "canonical_url", "query_term", "query_layer", S.excerpt(F.col("body")).alias("title"), F.col("body").alias("summary"),
        "author_id", "published", "views", "likes", "saves", "comments", "shares", (F.col("pos") + 1).alias("search_rank"), F.col("n").alias("search_result_count"),
        F.sha2(F.concat(F.lit(kind + ":"), F.col("content_id")), 256).alias("capture_key"),
    )


def envelopes(captures: DataFrame) -> DataFrame:
    """Post records nested under results, posts, data, result, items or content, however deep, become one flat array, for
    `extract`. Levels are read until one holds nothing more; each is written, so that none is worked out again for the next."""
    keys = ("results", "posts", "data", "result", "items", "content")
    own = ["capture_id", "query_term", "query_layer"]
    post = F.expr("try_variant_get(v, '$.id', 'string') IS NOT NULL AND try_variant_get(v, '$.title', 'string') IS NOT NULL AND coalesce(try_variant_get(v, '$.subreddit', 'string'), try_variant_get(v, '$.permalink', 'string')) IS NOT NULL")
    level = captures.select(*own, F.try_parse_json("raw").alias("v"), F.array(F.lit(0).cast("bigint")).alias("path"))
    found = None
    while found is None or not level.isEmpty():
        many = F.coalesce(F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v"))
        flat = level.where(F.col("v").isNotNull()).select(*own, "path", F.posexplode(many).alias("at", "v"))
        flat = flat.select(*own, F.concat("path", F.array(F.col("at").cast("bigint"))).alias("path"), "v", F.coalesce(post, F.lit(False)).alias("post"))
        inner = F.filter(F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.expr(f"try_variant_get(v, '$.{k}', 'variant')").alias("v")) for i, k in enumerate(keys)]), lambda x: x["v"].isNotNull())
        flat = staged(flat.select(*own, "path", F.when(F.col("post"), F.to_json("v")).alias("j"), F.when(~F.col("post"), inner).alias("inner")), "envelopes")
        here = flat.where("j IS NOT NULL").select(*own, F.struct("path", "j").alias("s"))
        found = here if found is None else found.unionByName(here)
        level = flat.where("size(inner) > 0").select(*own, F.explode("inner").alias("x"), "path").select(*own, F.col("x.v").alias("v"), F.concat("path", F.array("x.i")).alias("path"))
    g = found.groupBy(*own).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return g.select(*own, F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]")).alias("raw"))
