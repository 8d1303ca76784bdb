"""Queries over texts, addresses and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import MOJIBAKE
from ..operators import text_rules as R
from ..sources import captures, views


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents")


def text_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document is spoilt on purpose, as decoding UTF-8 wrongly would."""
    d = _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("é"), F.lit("Ã©"))).otherwise(F.col("text")))
    return R.integrity_faults(d, "doc_id", ["text", "source"]).select("doc_id", "path", F.array_join("markers", ",").alias("markers"))


#: What documents get at their end, by their number.
PLANTED = {0: "-----BEGIN EC PRIVATE KEY-----", 10: "Client_Secret: 'abcdefgh1'", 20: "authorization: Bearer abcdefghijkl.1", 30: "ghp_abcdefghij0123456789"}


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some of which get a secret of each kind at their end."""
    k, said = F.col("doc_id") % 40, F.lit("")
    for at, secret in PLANTED.items():
        said = F.when(k == at, secret).otherwise(said)
    return R.secret_findings(_docs(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said)))


def limitation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    k = F.col("doc_id") % 6
    note = F.when(k == 0, F.concat(F.lit("Vendor claim "), F.col("source"))).when(k == 1, "Search card, not opened").when(k == 2, F.concat(F.lit("generic business, "), F.col("lang"))).when(
        k == 3, "sampling_contract_unmet: details").when(k == 4, F.concat(F.lit("No measurable result "), F.col("doc_id") % 50)).otherwise(" ")
    return R.limitation_summary(d.select("source", note.alias("note")), ["source"])


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return p.select("page_id", S.canonical_url(F.col("url")).alias("canonical_url"), host.alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))


def social_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers stand for post ids of six platforms' addresses."""
    p = views.table(spark, sf_dir, "pages")
    k, i = F.col("page_id") % 6, F.col("page_id").cast("string")
    u = F.when(k == 0, F.concat(F.lit("https://m.facebook.com/reel/"), i, F.lit("?x=1"))).when(k == 1, F.concat(F.lit("https://facebook.com/some.one/posts/"), i)).when(
        k == 2, F.concat(F.lit("http://instagram.com/p/"), i, F.lit("/#c"))).when(k == 3, F.concat(F.lit("https://www.tiktok.com/@a.b/video/"), i)).when(
        k == 4, F.concat(F.lit("https://reddit.com/r/test/comments/"), i, F.lit("/title/"))).otherwise(F.col("url"))
    return p.select("page_id", R.social_url(u).alias("post_url"))


def request_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 8
    ask = F.element_at(F.array(*map(F.lit, (
        "Validate demand on Reddit: ", "brand sentiment on YouTube and Reddit ", "哪些内容机会 小红书 ", "Find business opportunities on X ", "switching triggers on twitter ",
        "plain text, worldwide ", "adoption barriers, tiktok, English-speaking market ", "监测舆情 抖音 中国市场 "))), (k + 1).cast("int"))
    r = R.classify_requests(c.select("conv_id", "turn", F.concat(ask, F.coalesce("text", F.lit(""))).alias("prompt")))
    return r.select("conv_id", "turn", F.coalesce("intent", F.lit("")).alias("intent"), F.coalesce("platform", F.lit("")).alias("platform"), F.coalesce("market", F.lit("")).alias("market"), "language", F.array_join("missing", ",").alias("missing"))


def reader_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    t = F.concat(F.col("p_name"), F.when(k == 0, " copilot").when(k == 1, " enablement layer").when(k == 2, " orchestration engine flywheel").otherwise(""))
    return p.select("p_partkey", R.reader_title(t).alias("title"), R.same_in_substance(t, F.upper(F.col("p_name"))).alias("repeats"))


def local_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names with inside words of two languages, for readers of either and for experts; suppliers by an adapter's names."""
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    t = F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, (" 多语言售后副驾", " 中台引擎 copilot", " 售后 Agent 的政策与订单事实守门层", " flywheel 闭环赋能", " plain"))), (k % 5 + 1).cast("int")))
    language, audience = F.when(k % 2 == 0, "zh-CN").otherwise("en"), F.when(k % 7 == 0, "expert").otherwise("general")
    name = F.element_at(F.array(*map(F.lit, (" Twitter", "小红书", "YT ", "Tik Tok", "脸书", "Elsewhere"))), (k % 6 + 1).cast("int"))
    return p.select("p_partkey", R.reader_title(t, language, audience).alias("title"), S.adapter_platform(name).alias("platform"), S.ratio(F.concat((k % 13).cast("string"), F.lit("e-1"))).alias("share"))


def safety_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 9
    said = F.when(k == 0, "Security check ").when(k == 1, "Try again later ").when(k == 2, "This content is private ").when(k == 3, "No results found ").otherwise("")
    path = F.when(k == 4, "/login/x").when(k == 5, "/checkpoint/1").otherwise("/search")
    asked = F.concat(F.lit("https://www.facebook.com/search/posts?q=term+"), F.col("page_id"))
    led = F.when(F.col("page_id") % 4 == 1, F.col("url")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://m.facebook.com/search/posts/?q=Term%20"), F.col("page_id"))).when(F.col("page_id") % 4 == 3, F.concat(asked, F.lit("x"))).otherwise("")
    moved = R.abnormal_redirect(asked, led, F.col("page_id") % 3 > 0)
    stop = R.safety_stop(F.lit("title"), F.concat(said, F.coalesce("html", F.lit(""))), path, F.lit(0), moved)
    d = p.select("page_id", stop.alias("stop"), said.alias("said"))
    return d.select("page_id", "stop", R.surface_state(F.col("stop"), F.col("page_id") % 2, F.col("page_id") % 5 < 4, F.col("said")).alias("state"))


def count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown counts, made of line items' prices, read back by the rules of each surface."""
    li = views.table(spark, sf_dir, "lineitem")
    k, q, p = F.col("l_linenumber") % 5, F.col("l_quantity").cast("int").cast("string"), F.floor("l_extendedprice").cast("bigint")
    shown = F.when(k == 0, F.concat(q, F.lit("K"))).when(k == 1, F.concat(q, F.lit(".5万"))).when(k == 2, F.format_number(p, 0)).when(k == 3, F.concat(q, F.lit(" views"))).otherwise(F.concat(q, F.lit(".25m")))
    n = S.number(shown)
    return li.select("l_orderkey", "l_linenumber", S.parse_count(shown).alias("anchored"), S.parse_count(shown, "kmb万亿", anchored=False).alias("anywhere"), n.cast("bigint").alias("number"))


def _capture(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A customer's orders as one search capture, in JSON; every seventh record repeats an id, every ninth has none."""
    o = views.table(spark, sf_dir, "orders")
    i = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey")).otherwise(F.col("o_orderkey")).cast("string")
    none = F.col("o_orderkey") % 9 == 0
    text, likes = F.concat(F.lit("post  about "), F.col("o_orderpriority")), F.concat((F.col("o_orderkey") % 90).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "K").otherwise(""))
    if kind == "x":
        r = F.struct(F.when(~none & (F.col("o_orderkey") % 2 == 0), i).alias("id"), F.when(~none, F.concat(F.lit("https://x.com/i/status/"), i)).alias("url"), text.alias("text"), F.concat(F.lit("@u"), F.col("o_custkey")).alias("author"), likes.alias("likes"))
    elif kind == "youtube":
        u = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://youtu.be/video"), i)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://www.youtube.com/watch?a=1&v=video"), i)).otherwise(F.concat(F.lit("https://m.youtube.com/shorts/video"), i))
        r = F.struct(F.when(~none, u).alias("url"), text.alias("title"), F.lit("chan").alias("channel"), F.concat(likes, F.lit(" views")).alias("views"))
    elif kind == "tiktok":
        r = F.struct(F.when(~none, F.concat(F.lit("https://www.tiktok.com/@a/video/"), i)).alias("url"), text.alias("desc"), F.lit("@a").alias("author"), likes.alias("likes"))
    elif kind == "xiaohongshu":
        r = F.struct(F.when(~none, F.concat(F.lit("https://www.xiaohongshu.com/explore/n"), i)).alias("url"), text.alias("title"), F.lit("/user/profile/p1").alias("author_url"), likes.alias("likes"))
    else:
        r = F.struct(F.when(~none, i).alias("id"), text.alias("title"), F.lit("test").alias("subreddit"), (F.col("o_orderkey") % 90).alias("num_comments"), F.lit(1704067200).alias("created_utc"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", r.alias("r")))), lambda x: x["r"])
    c = o.groupBy(F.col("o_custkey").alias("capture_id")).agg(rows.alias("rows")).select("capture_id", F.lit("term").alias("query_term"), F.lit("category").alias("query_layer"), F.to_json("rows").alias("raw"))
    if kind == "reddit":
        c = captures.envelopes(c.withColumn("raw", F.concat(F.lit('{"data":{"posts":'), F.col("raw"), F.lit("}}"))))
    return c


def _extraction(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = captures.extract(_capture(spark, sf_dir, kind), kind)
        return s.select("capture_id", "content_id", "canonical_url", "title", "likes", "comments", "capture_key") if kind != "reddit" else s.select("capture_id", "content_id", "canonical_url", "title", "comments", "published")

    query.__doc__ = f"Search captures of {kind}: JSON in, signals out."
    return query


KINDS = ("x", "youtube", "tiktok", "xiaohongshu", "reddit")
QUERIES = {
    "text_integrity": text_integrity, "secret_scan": secret_scan, "limitation_summary": limitation_summary, "url_canonical": url_canonical, "social_urls": social_urls,
    "request_classes": request_classes, "reader_titles": reader_titles, "local_titles": local_titles, "safety_stops": safety_stops, "count_texts": count_texts,
} | {f"capture_{k}": _extraction(k) for k in KINDS}


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _told(t: str, words: tuple) -> str:
    for word, plain in words:
        t = f"replace({t}, {_quote(word)}, {_quote(plain)})"
    return t


def _contains(t: str, words: tuple) -> str:
    return "(" + " OR ".join(f"contains({t}, {_quote(w)})" for w in words) + ")"


def _first(t: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {_quote(p)}) THEN '{n}'" for n, p in rules) + f" ELSE {otherwise} END"


_SPOILT = "(SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN replace(text, 'é', 'Ã©') ELSE text END AS text FROM documents)"
_PLANTED = "(SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 40 " + " ".join(f"WHEN {k} THEN {_quote(x)}" for k, x in PLANTED.items()) + " ELSE '' END AS text FROM documents)"
_NOTE = """CASE doc_id % 6 WHEN 0 THEN 'Vendor claim ' || source WHEN 1 THEN 'Search card, not opened' WHEN 2 THEN 'generic business, ' || lang WHEN 3 THEN 'sampling_contract_unmet: details'
  WHEN 4 THEN 'No measurable result ' || (doc_id % 50) ELSE '' END"""
_ASK = """(['Validate demand on Reddit: ', 'brand sentiment on YouTube and Reddit ', '哪些内容机会 小红书 ', 'Find business opportunities on X ', 'switching triggers on twitter ', 'plain text, worldwide ',
  'adoption barriers, tiktok, English-speaking market ', '监测舆情 抖音 中国市场 '])[(conv_id + turn) % 8 + 1]"""
_PLATFORM_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {_quote(p.replace('(?:^|', '(?:^|'))}) THEN '{n}' END" for n, p in R.PLATFORMS) + "], lambda x: x IS NOT NULL)"
_MARKET_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {_quote(p)}) THEN '{n}' END" for n, p in R.MARKETS) + "], lambda x: x IS NOT NULL)"
_I = "CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE o_orderkey END AS VARCHAR)"


def _capture_sql(cid: str, url: str, likes: str, key: str, comments: str = "NULL::BIGINT") -> str:
    return f"""WITH c AS (SELECT o_custkey AS capture_id, o_orderkey, {cid} AS content_id, 'post about ' || o_orderpriority AS title, o_orderkey % 90 * (CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END) AS n, * EXCLUDE (o_orderkey) FROM orders WHERE o_orderkey % 9 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY capture_id, content_id ORDER BY o_orderkey) AS k FROM c)
SELECT capture_id, content_id, {url} AS canonical_url, title, {likes} AS likes, {comments} AS comments, sha256('{key}:' || content_id) AS capture_key FROM f WHERE k = 1"""


SQL = {
    "text_integrity": "SELECT doc_id, path, array_to_string(m[1:3], ',') AS markers FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS path, list_filter([{', '.join(map(_quote, MOJIBAKE))}], lambda x: contains({c}, x)) AS m FROM {_SPOILT}" for c in ("text", "source")) + ") WHERE len(m) > 0",
    "secret_scan": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM {_PLANTED} WHERE regexp_matches(text, {_quote(p)})" for n, p in R.SECRETS.items()),
    "limitation_summary": f"""WITH n AS (SELECT DISTINCT source, {_NOTE} AS note FROM documents), c AS (SELECT source, lower(note) AS t FROM n WHERE note <> '' AND NOT starts_with(lower(note), 'sampling_contract_unmet:'))
SELECT source, CASE {" ".join(f"WHEN {_contains('t', w)} THEN '{k}'" for k, w in R.LIMITATIONS.items())} ELSE 'validation' END AS category, count(*) AS notes FROM c GROUP BY ALL""",
    "url_canonical": r"""SELECT page_id, regexp_replace(CASE WHEN regexp_matches(url, '^(https?|snapshot|artifact)://') THEN split_part(url, '#', 1) ELSE '' END, '/+$', '') AS canonical_url,
  regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages""",
    "social_urls": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.facebook.com/reel/' || page_id || '/' WHEN 1 THEN 'https://www.facebook.com/some.one/posts/' || page_id || '/'
  WHEN 2 THEN 'https://www.instagram.com/p/' || page_id || '/' WHEN 3 THEN 'https://www.tiktok.com/@a.b/video/' || page_id WHEN 4 THEN 'https://www.reddit.com/r/test/comments/' || page_id || '/' ELSE '' END AS post_url FROM pages""",
    "request_classes": f"""WITH r AS (SELECT conv_id, turn, {_ASK} || coalesce(text, '') AS prompt, lower({_ASK} || coalesce(text, '')) AS t FROM conversations), c AS (SELECT *, {_first('t', R.INTENTS, "''")} AS intent, {_PLATFORM_HITS} AS hits, {_MARKET_HITS} AS markets FROM r)
SELECT conv_id, turn, intent, CASE WHEN len(hits) = 1 THEN hits[1] ELSE '' END AS platform, CASE WHEN len(markets) = 1 THEN markets[1] ELSE '' END AS market, CASE WHEN regexp_matches(prompt, '[\\x{{3400}}-\\x{{9fff}}]') THEN 'zh-CN' ELSE 'en' END AS language,
  concat_ws(',', CASE WHEN intent = '' THEN 'research_intent' END, CASE WHEN len(hits) <> 1 THEN 'platform' END, CASE WHEN len(markets) <> 1 THEN 'market' END) AS missing FROM c""",
    "reader_titles": r"""WITH t AS (SELECT p_partkey, p_name, p_name || CASE p_partkey % 4 WHEN 0 THEN ' copilot' WHEN 1 THEN ' enablement layer' WHEN 2 THEN ' orchestration engine flywheel' ELSE '' END AS t FROM part)
SELECT p_partkey, replace(replace(replace(replace(t, 'copilot', 'assistant'), 'orchestration engine', 'workflow tool'), 'enablement layer', 'support process'), 'flywheel', 'feedback process') AS title, p_partkey % 4 = 3 AS repeats FROM t""",
    "local_titles": f"""WITH t AS (SELECT p_partkey AS k, p_name || ([' 多语言售后副驾', ' 中台引擎 copilot', ' 售后 Agent 的政策与订单事实守门层', ' flywheel 闭环赋能', ' plain'])[p_partkey % 5 + 1] AS t FROM part)
SELECT k AS p_partkey, CASE WHEN k % 7 = 0 THEN t WHEN k % 2 = 0 THEN {_told("t", R.JARGON_ZH)} ELSE {_told("t", R.JARGON)} END AS title, (['x', 'xiaohongshu', 'youtube', 'tiktok', 'facebook', 'elsewhere'])[k % 6 + 1] AS platform,
  CASE WHEN k % 13 <= 10 THEN CAST((k % 13) || 'e-1' AS DOUBLE) END AS share FROM t""",
    "safety_stops": f"""WITH t AS (SELECT page_id, lower('title' || chr(10) || CASE page_id % 9 WHEN 0 THEN 'Security check ' WHEN 1 THEN 'Try again later ' WHEN 2 THEN 'This content is private ' WHEN 3 THEN 'No results found ' ELSE '' END || coalesce(html, '')) AS t, page_id % 3 > 0 AS search,
  CASE page_id % 4 WHEN 1 THEN url WHEN 2 THEN 'https://m.facebook.com/search/posts/?q=Term%20' || page_id WHEN 3 THEN 'https://www.facebook.com/search/posts?q=term+' || page_id || 'x' ELSE '' END AS led FROM pages),
p AS (SELECT page_id, CASE {" ".join(f"WHEN regexp_matches(t, {_quote(x)})" + {"login_expired": " OR page_id % 9 = 4", "permission_prompt": " OR page_id % 9 = 5"}.get(n, "") + f" THEN '{n}'" for n, x in R.STOPS)}
  WHEN led <> '' AND search AND regexp_matches(led, '^https?:', 'i') AND NOT (regexp_matches(led, '^https?://([^/?#]*\\.)?facebook\\.com/search/posts/*([?#]|$)', 'i') AND lower(url_decode(replace(regexp_extract(led, '[?&]q=([^&#]*)', 1), '+', ' '))) = 'term ' || page_id) THEN 'abnormal_redirect'
  WHEN led <> '' AND NOT search AND NOT regexp_matches(led, '^https?://[^/?#]*facebook\\.com([/?#:]|$)', 'i') THEN 'abnormal_redirect' ELSE '' END AS stop FROM t)
SELECT page_id, stop, CASE WHEN stop <> '' THEN 'safety_stop' WHEN page_id % 5 < 4 AND page_id % 2 > 0 THEN 'results_visible' WHEN page_id % 5 < 4 AND page_id % 9 = 3 THEN 'explicit_empty' ELSE 'surface_unreadable' END AS state FROM p""",
    "count_texts": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN q * 1000 WHEN 2 THEN p WHEN 4 THEN q * 1000000 + 250000 END AS anchored,
  CASE l_linenumber % 5 WHEN 0 THEN q * 1000 WHEN 1 THEN q * 10000 + 5000 WHEN 2 THEN p WHEN 3 THEN q ELSE q * 1000000 + 250000 END AS anywhere,
  CASE l_linenumber % 5 WHEN 0 THEN q * 1000 WHEN 1 THEN q * 10000 + 5000 WHEN 2 THEN p WHEN 4 THEN q * 1000000 + 250000 END AS number FROM l""",
    "capture_x": _capture_sql(_I, "'https://x.com/u' || capture_id || '/status/' || content_id", "n", "x"),
    "capture_youtube": _capture_sql(f"'video' || {_I}", "'https://www.youtube.com/watch?v=' || content_id", "NULL::BIGINT", "youtube"),
    "capture_tiktok": _capture_sql(_I, "'https://www.tiktok.com/@a/video/' || content_id", "n", "tiktok"),
    "capture_xiaohongshu": _capture_sql(f"'n' || {_I}", "'https://www.xiaohongshu.com/explore/' || content_id", "CASE WHEN o_orderkey % 2 = 1 THEN n END", "xiaohongshu"),
    "capture_reddit": f"""WITH c AS (SELECT o_custkey AS capture_id, o_orderkey, {_I} AS content_id, 'post about ' || o_orderpriority AS title FROM orders WHERE o_orderkey % 9 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY capture_id, content_id ORDER BY o_orderkey) AS k FROM c)
SELECT capture_id, content_id, 'https://www.reddit.com/r/test/comments/' || content_id || '/' AS canonical_url, title, o_orderkey % 90 AS comments, '2024-01-01T00:00:00Z' AS published FROM f WHERE k = 1""",
}
