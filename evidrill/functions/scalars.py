"""Column functions. None runs Python in a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ADAPTER_ALIASES, ENGAGEMENT_WEIGHTS, HEAT_WEIGHTS, PLATFORM_ALIASES, SOURCE_QUALITY

#: White space as [\s\p{Z}] has it, letter by letter: trimming by letters costs a fraction of what a pattern does.
_WHITE = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NUMBER = r"^([0-9]+(?:\.[0-9]+)?)\s*(k|m|b|万|亿)?$"
SUFFIXES = {"k": 1e3, "m": 1e6, "b": 1e9, "w": 1e4, "万": 1e4, "亿": 1e8, "": 1.0}


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a small fixed table, as a chain of conditions."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def text(c: Column) -> Column:
    """Trimmed of any white space; null becomes ''."""
    return F.coalesce(F.btrim(c.cast("string"), F.lit(_WHITE)), F.lit(""))


def first(*cols: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cols])


def _entry(key: Column, values: dict) -> Column:
    """The value of a small fixed table, or null. The key is looked up, so that it is worked out once: a chain of conditions
    repeats it, and code that long is never compiled."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _times(suffix: Column) -> Column:
    """What a suffix multiplies by."""
    return _entry(suffix, SUFFIXES)


def number(c: Column) -> Column:
    """A count or measure: not negative, finite; thousands separators and k, m, b, 万, 亿 are understood."""
    t = F.replace(F.lower(text(c)), F.lit(","), F.lit(""))
    return F.when(c.isNotNull(), F.regexp_extract(t, _NUMBER, 1).try_cast("double") * _times(F.regexp_extract(t, _NUMBER, 2)))


def measure(c: Column) -> Column:
    """A numeric column by the same rule: null if negative or not finite."""
    d = c.cast("double")
    return F.when((d >= 0) & (d < float("inf")), d)


def boolean(c: Column) -> Column:
    return F.lower(text(c)).isin("1", "true", "yes", "y")


def items(c: Column) -> Column:
    """A list from text: a JSON array of strings, else parts between | , ; and line feeds."""
    t = text(c)
    parts = F.filter(F.transform(F.split(t, r"[|,，;；\n]+"), text), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(t == "", none).when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), parts)).otherwise(parts)


def parse_count(c: Column, suffixes: str = "kmb", anchored: bool = True, rounded: bool = True) -> Column:
    """A shown count such as 1.2K: which suffixes count, whether the whole text must match, and whether fractions
    are rounded (half to even) or cut. Every thousands separator is dropped."""
    t = F.replace(F.lower(text(c)), F.lit(","), F.lit(""))
    pattern = rf"([0-9]+(?:\.[0-9]+)?)\s*([{suffixes}])?" if suffixes else r"([0-9]+(?:\.[0-9]+)?)()"
    if anchored:
        pattern = f"^{pattern}$"
    value = F.regexp_extract(t, pattern, 1)
    out = value.try_cast("double") * _times(F.regexp_extract(t, pattern, 2))
    return (F.bround(out, 0) if rounded else out).cast("bigint")


def platform(c: Column) -> Column:
    t = F.lower(text(c))
    plain = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9_\-\x{4e00}-\x{9fff}]+", "_"), r"^_+|_+$", "")
    return F.coalesce(_entry(t, {name: name for name in PLATFORM_ALIASES.values()} | PLATFORM_ALIASES), plain)  # known names need no pattern


def adapter_platform(c: Column) -> Column:
    """The platform whose adapter knows the name; an unknown name is its own, in lower case."""
    t = F.lower(text(c))
    return lookup(t, {alias: name for name, aliases in ADAPTER_ALIASES.items() for alias in aliases}, t)


def ratio(c: Column) -> Column:
    """A share from 0 to 1; null if it isn't one."""
    d = text(c).try_cast("double")
    return F.when((d >= 0) & (d <= 1), d)


def url(c: Column) -> Column:
    """The address if its scheme is one that evidence may have, else ''."""
    t = text(c)
    return F.when(t.rlike("^(https?|snapshot|artifact)://"), t).otherwise("")


def canonical_url(c: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.substring_index(url(c), "#", 1), "/+$", "")


def excerpt(c: Column, limit: int = 180) -> Column:
    t = F.regexp_replace(text(c), r"[\s\p{Z}]+", " ")
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def clock_seconds(c: Column) -> Column:
    """mm:ss, hh:mm:ss or seconds, in seconds."""
    parts = F.transform(F.split(text(c), ":"), lambda x: x.try_cast("double"))
    return F.when(text(c) == "", F.lit(None).cast("double")).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x))


def log_score(value: Column, ceiling: float) -> Column:
    """0 to 100 on a logarithmic scale that ends at the ceiling."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.log1p(F.greatest(value, F.lit(0.0))) / F.log1p(F.lit(float(ceiling))) * 100))


def freshness(published: Column, as_of: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(published)) / F.lit(86_400_000_000.0))
    score = F.when(days <= 1, 100.0).when(days <= 7, 80.0).when(days <= 30, 55.0).when(days <= 90, 30.0).otherwise(10.0)
    return F.when(published.isNotNull() & as_of.isNotNull(), score)  # greatest() would pass over a null


def engagement_weight(platform_name: Column, kind: str) -> Column:
    return lookup(platform_name, {p: w[kind] for p, w in ENGAGEMENT_WEIGHTS.items()}, 1.0)


def dimensions(s: dict[str, Column], as_of: Column) -> dict[str, Column]:
    """The five dimensions of one signal, each null where its facts are missing. s: views, likes, saves, comments,
    shares, platform, observed_content_count, search_result_count, search_rank, growth_rate_percent,
    current_window_count, previous_window_count and published_at."""
    zero = F.lit(0.0)
    parts = {k: s[k] * engagement_weight(s["platform"], k) for k in ("likes", "saves", "comments", "shares")}
    some = F.coalesce(*parts.values()).isNotNull()
    total = sum((F.coalesce(x, zero) for x in parts.values()), zero)
    views = s["views"]
    plain = F.when(total > 0, total).otherwise(F.coalesce(views, zero))
    engagement = F.when(
        views.isNotNull() & some, F.least(F.lit(100.0), total / F.greatest(views, F.lit(1.0)) * 1000)
    ).when(views.isNotNull() | some, log_score(plain, 100_000))
    rate = F.coalesce(
        s["growth_rate_percent"],
        (s["current_window_count"] - s["previous_window_count"]) / F.greatest(s["previous_window_count"], F.lit(1.0)) * 100,
    )
    return {
        "content_volume": F.when(s["observed_content_count"].isNotNull(), log_score(s["observed_content_count"], 1000)),
        "engagement": engagement,
        "velocity": F.when(rate.isNotNull(), F.greatest(zero, F.least(F.lit(100.0), 50 + rate / 2))),
        "search_demand": F.when(s["search_result_count"].isNotNull(), log_score(s["search_result_count"], 10_000)).when(
            s["search_rank"].isNotNull(), F.greatest(zero, F.least(F.lit(100.0), 105 - s["search_rank"]))
        ),
        "freshness": freshness(s["published_at"], as_of),
    }


def weighted(dims: dict[str, Column], weights: dict[str, int]) -> Column:
    """The sum of value times percent; missing dimensions add nothing and their weights aren't dealt out anew."""
    return sum((F.coalesce(dims[k] * (w / 100), F.lit(0.0)) for k, w in weights.items() if k in dims), F.lit(0.0))


def coverage(dims: dict[str, Column]) -> Column:
    return sum((F.when(dims[k].isNotNull(), w).otherwise(0) for k, w in HEAT_WEIGHTS.items() if k in dims), F.lit(0)).cast("int")


def score_status(cover: Column) -> Column:
    return F.when(cover >= 75, "complete").when(cover >= 40, "partial").otherwise("sparse")


def source_quality(source_type: Column) -> Column:
    return lookup(source_type, SOURCE_QUALITY, SOURCE_QUALITY["unknown"])


def level(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
