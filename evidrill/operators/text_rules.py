"""Rules on texts and addresses: integrity, secrets, safety stops, request classes, jargon, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import MOJIBAKE

# Patterns of secrets.
SECRETS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "assigned_secret": r"(?i)(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\s*[:=]\s*['\"][^'\"]{8,}",
    "bearer": r"(?i)authorization\s*:\s*bearer\s+[A-Za-z0-9._~+/-]{12,}",
    "code_host_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
}

# What a page says when reading has to stop, in order.
STOPS = (
    ("captcha", r"captcha|验证码|security check|安全检查|confirm you(?:'|’)re human|确认你是真人"),
    ("rate_limit", r"too many requests|rate limit|try again later|操作过于频繁|请求过多|请稍后再试"),
    ("login_expired", r"log into facebook|登录 facebook 帐号|登录 facebook"),
    ("permission_prompt", r"approval required|permission required|需要你的许可|需要获得许可|请确认你的身份"),
    ("private_content", r"this content is private|private group|仅限成员|私密小组|你无权查看"),
)

# Patterns that tell a request's intent, in order, and its platform.
INTENTS = (
    ("competitor_users", r"竞品用户|切换原因|切换触发|switching triggers?|competitor users?|\bversus\b.*\busers?\b|用户分别喜欢和抱怨"),
    ("brand_sentiment", r"品牌舆情|监测.*舆情|\bsentiment\b|需要.*回应|负面问题|怎么评价.*扩大"),
    ("content_opportunity", r"内容机会|content opportunities?|值得持续做内容|哪些问题值得.*内容"),
    ("product_demand", r"产品需求|validate demand|验证.*需求|采用阻力|adoption barriers?|workarounds?.*adoption"),
    ("business_opportunity", r"商业机会|business opportunities?|值得验证的生意|趋势机会|trend opportunities?"),
)
PLATFORMS = (
    ("xiaohongshu", r"小红书|\bxiaohongshu\b|\bxhs\b"),
    ("reddit", r"\breddit\b|红迪"),
    ("youtube", r"\byoutube\b|油管"),
    ("tiktok", r"\btik[ -]?tok\b|国际抖音"),
    ("douyin", r"抖音|\bdouyin\b"),
    ("instagram", r"\binstagram\b|(?:^|[，。；、,.!?\s])ins(?:平台|$|[，。；、,.!?\s])"),
    ("facebook", r"\bfacebook\b|(?:^|[，。；、,.!?\s])fb(?:平台|$|[，。；、,.!?\s])|脸书"),
    ("x", r"(?:^|[，。；、,.!?\s])x(?:上|平台|英语市场|$|[，。；、,.!?\s])|\bon\s+x\b|\btwitter\b"),
)

# Patterns that tell a request's market.
MARKETS = (
    ("英语市场", r"英语市场|英文市场|english[- ]speaking market|english market"),
    ("中国市场", r"中国市场|china market|mainland china"),
    ("全球市场", r"全球市场|global market|worldwide"),
)

# Inside words and what readers are told instead, in order.
JARGON = (("copilot", "assistant"), ("orchestration engine", "workflow tool"), ("enablement layer", "support process"), ("flywheel", "feedback process"))

JARGON_ZH = (
    ("跨时区多语言首轮处理队列", "先处理夜间和多语言售后，复杂问题再转人工"),
    ("售后 Agent 的政策与订单事实守门层", "售后 AI 助手回复前，先核对订单和政策"),
    ("多语言售后副驾", "跨境电商多语言售后助手"),
    ("先准备动作", "自动准备处理方案"),
    ("资金操作人工批准", "退款等资金操作交给人工确认"),
    ("政策与订单事实守门层", "政策与订单信息检查机制"),
    ("副驾", "助手"),
    ("中台", "统一工作台"),
    ("引擎", "工具"),
    ("闭环", "完整流程"),
    ("赋能", "帮助"),
    ("桥接", "连接"),
    ("守门层", "检查机制"),
    ("Agent", "AI 助手"),
)

# What an audit note is about, by its words, in order.
LIMITATIONS = {
    "context": ("search card", "search-card", "not opened", "unopened", "truncat", "linked article not opened", "linked offer page not opened"),
    "source": ("vendor", "promotional", "builder", "seller claim", "self-reported", "job ", "job listing", "employer", "paid-work", "conflict", "made-with-ai", "creator claim"),
    "relevance": (
        "not specific", "not explicitly", "weakly related", "weak semantic", "broad ", "context signal", "rather than", "pre-fulfilment", "not full after-sales", "not ecommerce",
        "not shopify", "generic business", "enterprise-focused", "specific to", "nigeria-specific", "idea list", "growth workflow", "upstream", "cro context",
    ),
    "validation": (
        "unverified", "unsourced", "not sourced", "not independently", "no measurable", "no documented", "no company-level", "not observed", "no customer outcome", "outcome evidence",
        "authenticity", "low reach", "no external customer", "no workflow or outcome", "not buyer-demand", "not buyer outcome", "not measured", "no production outcome",
    ),
}


def integrity_faults(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per text column that holds a sign of wrong decoding, with up to three of the signs."""

    def markers(column: str) -> Column:
        return F.filter(F.array(*map(F.lit, MOJIBAKE)), lambda m: F.col(column).contains(m))

    per = F.array(*[F.struct(F.lit(c).alias("path"), markers(c).alias("markers")) for c in columns])
    bad = F.filter(per, lambda x: F.size(x["markers"]) > 0)
    return rows.select(F.col(key), F.explode(bad).alias("b")).select(key, "b.path", F.slice("b.markers", 1, 3).alias("markers"))


def forbidden_keys(raw: Column, *more: str) -> Column:
    """Does a JSON text hold a key that captures must not: cookies, sessions, tokens, passwords and `more`?"""
    names = "|".join(("cookies?", "session", "token", "password", *more))
    return raw.rlike(rf'(?i)(?<!\\)"({names})"\s*:')


def secret_findings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rule) for each kind of secret that a text holds."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), name) for name, p in SECRETS.items()]))
    return docs.select(F.col(id_col), F.explode(hits).alias("rule"))


def safety_stop(title: Column, body: Column, path: Column, password_inputs: Column, redirected: Column | None = None) -> Column:
    """Why reading a page has to stop; '' if it needn't. The first rule that holds; an abnormal redirect is the last."""
    t, p = F.lower(F.concat_ws("\n", title, body)), F.lower(path)
    extra = {"login_expired": p.startswith("/login") | (password_inputs > 0), "permission_prompt": p.startswith("/checkpoint")}
    out = None
    for name, pattern in STOPS:
        hit = t.rlike(pattern)
        if name in extra:
            hit = hit | F.coalesce(extra[name], F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if redirected is not None:
        out = out.when(redirected, "abnormal_redirect")
    return out.otherwise("")


def abnormal_redirect(expected: Column, actual: Column, query_surface: Column) -> Column:
    """Did a page lead elsewhere? A search has to stay on the network's post search with the same term; any other page of
    the network on the network. Where either address is blank, nothing is said."""
    host = lambda u: F.coalesce(F.lower(F.try_parse_url(u, F.lit("HOST"))), F.lit(""))
    term = lambda u: F.lower(F.coalesce(F.try_url_decode(F.replace(F.coalesce(F.try_parse_url(u, F.lit("QUERY"), F.lit("q")), F.lit("")), F.lit("+"), F.lit(" "))), F.lit("")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(actual, F.lit("PATH")), F.lit("")), "/+$", "")
    home = lambda u: host(u).endswith("facebook.com")
    moved = F.when(query_surface, F.lower(actual).rlike("^https?:") & ~(home(actual) & (path == "/search/posts") & (term(actual) == term(expected)))).otherwise(home(expected) & ~home(actual))
    return F.coalesce((expected != "") & (actual != "") & moved, F.lit(False))


# How a page says that there is nothing.
EMPTY_RESULT = r"没有(?:找到|任何).{0,20}(?:结果|帖子)|找不到.{0,20}(?:结果|帖子)|未找到.{0,20}(?:结果|帖子)|no results(?: found)?|couldn['’]t find any results|didn['’]t find any results"


def surface_state(stop: Column, cards: Column, identity: Column, body: Column) -> Column:
    """results_visible, explicit_empty, safety_stop or surface_unreadable: no cards alone are no zero result."""
    empty = F.lower(body).rlike(EMPTY_RESULT)
    return F.when(stop != "", "safety_stop").when(identity & (cards > 0), "results_visible").when(identity & empty, "explicit_empty").otherwise("surface_unreadable")


def classify_requests(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Adds intent (the first whose pattern matches), platform and market (if exactly one matches), language and what is
    missing. Word limits and spaces are Unicode's, whatever the Java version: reddit isn't a word of "在reddit上"."""
    t = F.lower(F.col(prompt))
    intent = None
    for name, pattern in INTENTS:
        intent = F.when(t.rlike("(?U)" + pattern), name) if intent is None else intent.when(t.rlike("(?U)" + pattern), name)
    hits = F.array_compact(F.array(*[F.when(t.rlike("(?U)" + p), name) for name, p in PLATFORMS]))
    r = requests.withColumn("intent", intent).withColumn("platform", F.when(F.size(hits) == 1, F.get(hits, F.lit(0))))
    markets = F.array_compact(F.array(*[F.when(t.rlike("(?U)" + p), name) for name, p in MARKETS]))
    r = r.withColumn("market", F.when(F.size(markets) == 1, F.get(markets, F.lit(0))))
    missing = F.array_compact(F.array(F.when(F.col("intent").isNull(), "research_intent"), F.when(F.col("platform").isNull(), "platform"), F.when(F.col("market").isNull(), "market")))
    return r.withColumn("language", F.when(F.col(prompt).rlike(r"[\x{3400}-\x{9fff}]"), "zh-CN").otherwise("en")).withColumn("missing", missing)


def reader_title(title: Column, language: Column | None = None, audience: Column | None = None) -> Column:
    """Inside words replaced one after the other, each in what the one before it left: those of the reader's language
    (zh-CN, else English). Experts read the title as it is."""

    def told(words: tuple) -> Column:
        out = title
        for word, plain in words:
            out = F.replace(out, F.lit(word), F.lit(plain))
        return out

    plain = told(JARGON) if language is None else F.when(language == "zh-CN", told(JARGON_ZH)).otherwise(told(JARGON))
    return plain if audience is None else F.when(audience == "expert", title).otherwise(plain)


def same_in_substance(a: Column, b: Column, least: int = 48, share: float = 0.85) -> Column:
    """Letters and digits are equal, or the shorter of at least 48 stands in the longer and is most of it."""
    x, y = (F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "") for c in (a, b))
    short, long_ = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    inside = (F.length(short) >= least) & long_.contains(short) & (F.length(short) / F.length(long_) >= share)
    return (x != "") & (y != "") & ((x == y) | inside)


def limitation_category(note: Column) -> Column:
    t, out = F.lower(note), None
    for name, words in LIMITATIONS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("validation")


def limitation_summary(notes: DataFrame, by: list[str]) -> DataFrame:
    """Different notes by category; notes on unmet contracts don't count."""
    n = notes.withColumn("note", S.text(F.col("note"))).where("note <> '' AND NOT startswith(lower(note), 'sampling_contract_unmet:')").select(*by, "note").distinct()
    return n.withColumn("category", limitation_category(F.col("note"))).groupBy(*by, "category").agg(F.count(F.lit(1)).alias("notes"))


def social_url(url: Column) -> Column:
    """A post's canonical address on the platform that the host names, else ''."""
    u = S.text(url)

    def take(pattern: str, *parts: str) -> Column:
        found = [F.regexp_extract(u, pattern, i + 1) for i in range(pattern.count("(") - pattern.count("(?:"))]
        return F.when(found[0] != "", F.concat(*[F.lit(p) if isinstance(p, str) else found[p] for p in parts]))

    fb = r"^https?://(?:www\.|m\.)?facebook\.com/"
    return F.coalesce(
        take(fb + r"reel/([A-Za-z0-9_-]+)", "https://www.facebook.com/reel/", 0, "/"),
        take(fb + r"([^/?#]+)/posts/([A-Za-z0-9_-]+)", "https://www.facebook.com/", 0, "/posts/", 1, "/"),
        take(fb + r"share/p/([A-Za-z0-9_-]+)", "https://www.facebook.com/share/p/", 0, "/"),
        take(fb + r"photo/?\?(?:[^#]*&)?fbid=([A-Za-z0-9._-]+)", "https://www.facebook.com/photo/?fbid=", 0),
        take(fb + r"permalink\.php\?(?:[^#]*&)?story_fbid=([A-Za-z0-9._-]+)", "https://www.facebook.com/permalink.php?story_fbid=", 0),
        take(r"^https?://(?:www\.)?instagram\.com/(p|reel)/([A-Za-z0-9_-]+)", "https://www.instagram.com/", 0, "/", 1, "/"),
        take(r"^https?://(?:www\.)?tiktok\.com/@([^/?#]+)/video/(\d+)", "https://www.tiktok.com/@", 0, "/video/", 1),
        take(r"^https?://(?:www\.)?reddit\.com/r/([^/?#]+)/comments/([a-z0-9]+)", "https://www.reddit.com/r/", 0, "/comments/", 1, "/"),
        take(r"^https?://(?:www\.)?(?:x|twitter)\.com/([^/?#]+)/status/(\d+)", "https://x.com/", 0, "/status/", 1),
        F.lit(""),
    )
