"""What a post's address says: its kind, its id and its canonical form. None runs Python in a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

# Shapes of addresses and ids.
INSTAGRAM = r"(?i)^https://(?:www\.)?instagram\.com/(?:([A-Za-z0-9._]{1,30})/)?(p|reel)/([A-Za-z0-9_-]+)/?$"
FACEBOOK_ID = r"^[A-Za-z0-9._-]{4,160}$"
FACEBOOK_HOSTS = ("facebook.com", "www.facebook.com", "m.facebook.com")
TIKTOK = r"(?i)^https://(?:www\.)?tiktok\.com/@([A-Za-z0-9._-]+)/(?:video|photo)/(\d+)(?:[?#/].*)?$"


def _struct(**parts: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def instagram_post(url: Column, with_profile: bool = False) -> Column:
    """(kind, content_id, profile, url), or null where it isn't the address of a post or reel."""
    read = lambda u: _struct(profile=F.regexp_extract(u, INSTAGRAM, 1), kind=F.lower(F.regexp_extract(u, INSTAGRAM, 2)), content_id=F.regexp_extract(u, INSTAGRAM, 3))

    def of(x: Column) -> Column:
        prefix = F.when(x["profile"] != "", F.concat(x["profile"], F.lit("/"))).otherwise("") if with_profile else F.lit("")
        address = F.concat(F.lit("https://www.instagram.com/"), prefix, x["kind"], F.lit("/"), x["content_id"], F.lit("/"))
        return F.when(x["content_id"] != "", _struct(kind=x["kind"], content_id=x["content_id"], profile=x["profile"], url=address))

    # lambdas see what was read once
    return F.get(F.transform(F.transform(F.array(F.substring_index(S.text(url), "?", 1)), read), of), F.lit(0))


def facebook_post(url: Column) -> Column:
    """(kind, content_id, url) for the five shapes of a public post's address, else null."""
    u = S.text(url)
    asked = lambda name: S.text(F.regexp_extract(u, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1))
    read = _struct(
        host=F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), photo=asked("fbid"), story=asked("story_fbid"),
        parts=F.filter(F.split(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != ""),
    )

    def of(x: Column) -> Column:
        n, part = F.size(x["parts"]), [F.coalesce(F.get(x["parts"], F.lit(i)), F.lit("")) for i in range(3)]
        first, second = F.lower(part[0]), F.lower(part[1])
        shape = lambda kind, cid, *address: _struct(kind=F.lit(kind), content_id=cid, url=F.concat(F.lit("https://www.facebook.com/"), *[F.lit(a) if isinstance(a, str) else a for a in address]))
        found = (
            F.when((n >= 2) & (first == "reel"), shape("reel", part[1], "reel/", part[1], "/")).when((n >= 3) & (second == "posts"), shape("post", part[2], part[0], "/posts/", part[2], "/"))
            .when((n >= 3) & (first == "share") & (second == "p"), shape("post", part[2], "share/p/", part[2], "/")).when(first == "photo", shape("photo", x["photo"], "photo/?fbid=", x["photo"]))
            .when(first == "permalink.php", shape("post", x["story"], "permalink.php?story_fbid=", x["story"]))
        )
        return F.when(x["host"].isin(*FACEBOOK_HOSTS), found)

    # lambdas see what was read once
    found = F.transform(F.transform(F.array(read), of), lambda y: F.when(y["content_id"].rlike(FACEBOOK_ID), y))
    return F.get(found, F.lit(0))


def tiktok_identity(url: Column) -> Column:
    """(handle, content_id) of a video's or photo's address, else null."""
    u = S.text(url)
    cid = F.regexp_extract(u, TIKTOK, 2)
    return F.when(cid != "", _struct(handle=F.regexp_extract(u, TIKTOK, 1), content_id=cid))


def reference_key(ref: Column) -> Column:
    """What makes two references one: the number of a status, else the address in lower case without end slashes."""
    t = S.text(ref)
    status = F.regexp_extract(t, r"/status/(\d+)", 1)
    return F.when(status != "", F.concat(F.lit("status:"), status)).otherwise(F.lower(F.regexp_replace(t, "/+$", "")))


def distinct_references(refs: Column) -> Column:
    """References in their order, each once by its key, the first one's spelling; blank ones go."""
    kept = F.filter(F.transform(refs, S.text), lambda x: x != "")
    keys = F.transform(kept, reference_key)
    return F.filter(kept, lambda x, i: F.array_position(keys, reference_key(x)) == i + 1)


def visible_text(c: Column) -> Column:
    """Without the words that hold a replacement character; other texts stay as they are."""
    t = S.text(c)
    words = F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: ~w.contains("�") & (w != ""))
    return F.when(t.contains("�"), F.array_join(words, " ")).otherwise(t)
