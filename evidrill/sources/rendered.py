"""Pages rendered as text, with references at the end: the details of the post that was asked for.

Input: pages (target_id, target_url, raw). A page that doesn't show the target gives no row. Whole texts are read by
patterns; nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# How rendered pages look: section rules, addresses of posts, counts.
_RULE = r"(?m)^---\s*$"
_VIDEO = r"(?i)https://(?:www\.)?tiktok\.com/@([A-Za-z0-9._-]+)/(video|photo)/(\d+)"
_X = r"(?i)https://(?:www\.)?x\.com/([A-Za-z0-9_]+)/status/(\d+)"
_COUNT = r"(?i)([\d,.]+\s*[KMB]?)"


def _plain(c: Column) -> Column:
    """The text with line feeds alone."""
    return F.replace(S.text(c), F.lit("\r\n"), F.lit("\n"))


def _clean(line: Column) -> Column:
    return F.trim(F.replace(F.trim(F.regexp_replace(S.text(line), "^>+", "")), F.lit("**"), F.lit("")))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), _clean), lambda x: x != "")


def _count(c: Column) -> Column:
    return S.parse_count(F.replace(S.text(c), F.lit(" "), F.lit("")), rounded=False)


def _first_count(lines: Column) -> Column:
    return F.get(F.filter(F.transform(lines, _count), lambda x: x.isNotNull()), F.lit(0))


def _after(lines: Column, label: Column, n: int) -> Column:
    """The first count in the n lines after one that is the label (the last such)."""
    at = F.size(lines) - F.array_position(F.reverse(F.transform(lines, F.lower)), label) + 1
    there = F.array_contains(F.transform(lines, F.lower), label)
    return F.when(there, _first_count(F.slice(lines, at + 1, n)))


def tiktok_details(pages: DataFrame, limit: int = 5) -> DataFrame:
    """Identity, author block (the longest body), the counts of the section before it, and visible comments."""
    d = pages.withColumn("t", _plain(F.col("raw"))).withColumns({"handle": F.regexp_extract("target_url", _VIDEO, 1), "asked": F.lower(F.regexp_extract("target_url", _VIDEO, 2)), "cid": F.regexp_extract("target_url", _VIDEO, 3)})
    all_of = lambda pattern, i: F.regexp_extract_all("t", F.lit(pattern), i)
    shown = F.filter(F.arrays_zip(all_of(_VIDEO, 1).alias("h"), all_of(_VIDEO, 2).alias("f"), all_of(_VIDEO, 3).alias("i")), lambda x: x["i"] == F.col("cid"))
    ref = r"(?im)^\[(\d+)\]\s+(https://(?:www\.)?tiktok\.com/@[^\s]+)\s*$"
    refs = F.filter(F.arrays_zip(all_of(ref, 1).alias("n"), all_of(ref, 2).alias("u")), lambda x: F.lower(F.regexp_extract(x["u"], r"(?i)tiktok\.com/@([^/?#]+)", 1)) == F.lower("handle"))
    d = d.where("cid <> ''").withColumns({"seen": F.get(shown, F.lit(0)), "ref": F.get(refs, F.lit(0))["n"]}).where((F.lower("seen.h") == F.lower("handle")) & F.col("ref").isNotNull())
    block = F.concat(F.lit(r"(?ms)^([^\n]+?)\s+\["), F.col("ref"), F.lit(r"\]\s*\n\s*·\s*([^\n]+)\n\s*\n(.+?)(?=^---\s*$)"))
    part = lambda i: F.regexp_extract_all("t", block, i)
    body = lambda x: F.trim(F.replace(F.regexp_replace(F.array_join(F.filter(_lines(x), lambda y: ~y.startswith("[")), " "), r"\s+", " "), F.lit(" more "), F.lit(" ")))
    blocks = F.transform(F.arrays_zip(part(0).alias("whole"), part(1).alias("author"), part(2).alias("at"), part(3).alias("text")), lambda x: F.struct(
        F.length(body(x["text"])).alias("n"), body(x["text"]).alias("body"), _clean(x["author"]).alias("author"), _clean(x["at"]).alias("published"), x["whole"].alias("whole")))
    longest = F.get(F.filter("blocks", lambda x: (x["n"] > 0) & (x["n"] == F.array_max(F.transform("blocks", lambda y: y["n"])))), F.lit(0))
    d = d.withColumn("blocks", blocks).withColumn("b", longest).where("b IS NOT NULL")
    sections = F.filter(F.split(F.call_function("substring_index", F.col("t"), F.col("b.whole"), F.lit(1)), _RULE), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    d = d.withColumn("lines", _lines(F.coalesce(F.try_element_at(sections, F.lit(-1)), F.lit("")))).withColumn("plain", F.array_join("lines", "\n"))
    favorite = F.array_position(F.transform("lines", lambda x: F.lower(x).contains("favorite")), True)
    leading = F.filter(F.transform(F.when(favorite > 0, F.slice("lines", F.lit(1), favorite.cast("int") - 1)).otherwise(F.col("lines")), _count), lambda x: x.isNotNull())
    named = lambda word: _count(F.when(F.col("plain").rlike(rf"{_COUNT}\s+{word}s?\b"), F.regexp_extract("plain", rf"{_COUNT}\s+{word}s?\b", 1)))
    like_at = F.array_position(F.transform("lines", lambda x: F.lower(x)), "like").cast("int")
    d = d.withColumns({"likes0": F.coalesce(named("like"), F.get(leading, F.lit(0))), "comments0": F.get(leading, F.lit(1)), "shares0": named("share")})
    word_at = F.array_position(F.transform("lines", lambda x: F.lower(x).contains("likes")), True).cast("int")
    between = F.when((word_at > 0) & (favorite > word_at), _first_count(F.slice("lines", word_at + 1, F.greatest(F.lit(0), favorite.cast("int") - word_at - 1))))
    d = d.withColumns({
        "likes": F.coalesce("likes0", F.when(like_at > 1, _first_count(F.slice("lines", F.greatest(F.lit(1), like_at - 1), F.lit(1))))), "saves": _after(F.col("lines"), F.lit("favorites"), 2),
        "shares": F.coalesce("shares0", _after(F.col("lines"), F.lit("share"), 2)), "comments": F.coalesce("comments0", _after(F.col("lines"), F.lit("comments"), 2)),
    })
    d = d.withColumn("comments", F.when(F.col("likes").isNotNull(), F.coalesce("comments", between)).otherwise(F.col("comments")))
    panel = F.regexp_extract("t", r"(?ms)^Comments\s*$\n(.+?)(?=^You may like\s*$)", 1)
    said = F.filter(F.transform(F.split(panel, _RULE), _lines), lambda x: (F.size(x) >= 2) & ~F.lower(F.get(x, F.lit(0))).isin("comments", "you may like"))
    liked = lambda x: F.get(F.filter(F.slice(x, F.lit(3), F.size(x)), lambda y: y.rlike(r"(?i)\blikes?\b")), F.lit(0))
    dated = lambda x: F.get(F.filter(F.slice(x, F.lit(3), F.size(x)), lambda y: ~y.rlike(r"(?i)\blikes?\b") & y.rlike(r"(?i)(?:ago|\d{1,2}-\d{1,2}|\d{4})")), F.lit(0))
    comments = F.transform(F.slice(said, 1, limit), lambda x: F.struct(
        F.get(x, F.lit(0)).alias("author_name"), F.get(x, F.lit(1)).alias("text"), _count(F.regexp_extract(liked(x), _COUNT, 1)).alias("likes"), F.coalesce(dated(x), F.lit("")).alias("published_at")))
    return d.select(
        "target_id", F.col("cid").alias("content_id"), F.lower("seen.f").alias("content_format"), F.concat(F.lit("https://www.tiktok.com/@"), "handle", F.lit("/"), F.lower("seen.f"), F.lit("/"), "cid").alias("canonical_url"),
        F.substring("b.body", 1, 180).alias("title"), F.col("b.body").alias("summary"), F.col("b.published").alias("published_at"), F.col("b.author").alias("author_name"), F.col("handle").alias("author_id"),
        "likes", "comments", "shares", "saves", comments.alias("representative_comments"), (F.lower("seen.f") != F.col("asked")).alias("other_format"),
    )


def x_details(pages: DataFrame) -> DataFrame:
    """The first section is the post's text; counts carry their words, and the time is the first line with a year and
    AM or PM."""
    d = pages.withColumn("t", _plain(F.col("raw"))).withColumn("from_", F.when(F.col("t").rlike(_X), F.col("t")).otherwise(F.col("target_url")))
    d = d.withColumns({"name": F.regexp_extract("from_", _X, 1), "cid": F.regexp_extract("from_", _X, 2), "sections": F.split("t", _RULE)})
    body = F.trim(F.regexp_replace(S.text(F.get("sections", F.lit(1))), r"(?m)^Show more\s*$", ""))
    d = d.withColumn("body", F.regexp_replace(body, r"^\s+|\s+$", "")).where("cid <> '' AND body <> ''")
    handle = r"(?m)^@([A-Za-z0-9_]+)\s*(?:\[\d+\])?\s*$"
    own = F.regexp_extract("t", handle, 1)
    above = F.filter(F.split(F.regexp_extract("t", r"(?ms)\A(.*?)^@[A-Za-z0-9_]+\s*(?:\[\d+\])?\s*$", 1), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#") & ~x.startswith(">"))
    author = F.when((own != "") & (F.size(above) > 0), F.regexp_replace(F.trim(F.try_element_at(above, F.lit(-1))), r"\s*\[\d+\]\s*$", "")).when(own != "", own).otherwise(F.col("name"))
    count = lambda word: S.parse_count(F.regexp_extract("t", rf"(?i)([\d,.]+[KMB]?)\s+{word}\b", 1), rounded=False)
    dated = F.get(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"(?i)\b(?:AM|PM)\b") & x.rlike(r"\b20\d{2}\b")), F.lit(0))
    published = F.trim(F.substring_index(F.regexp_replace(dated, r"\s*\[\d+\]\s*", " "), "·", 1))
    return d.select(
        "target_id", F.col("cid").alias("content_id"), F.concat(F.lit("https://x.com/"), "name", F.lit("/status/"), "cid").alias("canonical_url"), F.substring(F.substring_index("body", "\n", 1), 1, 180).alias("title"),
        F.col("body").alias("summary"), F.coalesce(published, F.lit("")).alias("published_at"), count("Views").alias("views"), count("Likes").alias("likes"), count("Replies").alias("comments"), count("Reposts").alias("shares"),
        author.alias("author_name"), F.concat(F.lit("@"), F.coalesce(S.first(own), F.col("name"))).alias("author_id"),
    )
