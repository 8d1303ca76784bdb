"""Fixed values that results depend on, as published: weights, enumerations and contracts."""

# Weights of the heat and confidence dimensions, in percent.
HEAT_WEIGHTS = {"content_volume": 20, "engagement": 25, "velocity": 25, "diffusion": 15, "search_demand": 10, "freshness": 5}
CONFIDENCE_WEIGHTS = {"sample_sufficiency": 25, "author_diversity": 20, "source_quality": 20, "field_coverage": 20, "counterevidence": 15}

# Quality of a source by its type.
SOURCE_QUALITY = {
    "direct_post": 100,
    "exported_item": 90,
    "search_card": 55,
    "platform_summary": 45,
    "profile": 35,
    "webpage": 50,
    "search_snippet": 25,
    "historical_item": 40,
    "unknown": 20,
}

QUERY_LAYERS = ("platform_baseline", "category", "subject_bridge")
SOURCE_MODES = ("authorized_api", "customer_export", "controlled_capture", "public_web", "historical_snapshot")
RELEVANCE_RANK = {"unreviewed": 0, "weak": 1, "adjacent": 2, "direct": 3}

# Weights of interactions by platform; all others have 1 each.
ENGAGEMENT_WEIGHTS = {
    "x": {"likes": 1.0, "comments": 2.0, "shares": 3.0, "saves": 5.0},
    "xiaohongshu": {"likes": 1.0, "comments": 3.0, "shares": 4.0, "saves": 4.0},
    "youtube": {"likes": 1.0, "comments": 3.0, "shares": 4.0, "saves": 1.0},
}

# Minimums of the sampling contracts; targets have a lower and an upper bound.
CONTRACTS = {
    "quick": {
        "query_target": (3, 5),
        "observed_result_target": (20, 40),
        "per_query_observed_target": 7,
        "atomic_read_reserve": 10,
        "unique_signal_target": (8, 15),
        "detail_open_target": (4, 8),
        "counter_signal_min": 2,
        "opportunity_target": (1, 3),
        "repeat_snapshot_min": 1,
        "layer_query_min": 1,
        "layer_observed_min": 4,
        "layer_unique_signal_min": 2,
        "layer_relevant_signal_min": 1,
        "layer_direct_signal_min": 0,
        "relevant_unique_signal_min": 4,
        "layer_detail_min": 0,
        "subject_bridge_direct_min": 0,
        "relevance_review_coverage_min": 0.0,
    },
    "standard": {
        "query_target": (3, 9),
        "observed_result_target": (60, 100),
        "per_query_observed_target": 10,
        "atomic_read_reserve": 20,
        "unique_signal_target": (30, 50),
        "detail_open_target": (12, 18),
        "counter_signal_min": 3,
        "opportunity_target": (3, 5),
        "repeat_snapshot_min": 1,
        "layer_query_min": 1,
        "layer_observed_min": 8,
        "layer_unique_signal_min": 4,
        "layer_relevant_signal_min": 4,
        "layer_direct_signal_min": 2,
        "relevant_unique_signal_min": 18,
        "layer_detail_min": 2,
        "subject_bridge_direct_min": 2,
        "relevance_review_coverage_min": 0.8,
    },
    "deep": {
        "query_target": (9, 15),
        "observed_result_target": (100, 300),
        "per_query_observed_target": 12,
        "atomic_read_reserve": 25,
        "unique_signal_target": (80, 200),
        "detail_open_target": (20, 40),
        "counter_signal_min": 8,
        "opportunity_target": (5, 8),
        "repeat_snapshot_min": 2,
        "layer_query_min": 3,
        "layer_observed_min": 15,
        "layer_unique_signal_min": 8,
        "layer_relevant_signal_min": 8,
        "layer_direct_signal_min": 3,
        "relevant_unique_signal_min": 48,
        "layer_detail_min": 3,
        "subject_bridge_direct_min": 3,
        "relevance_review_coverage_min": 0.9,
    },
}

# The most confidence that a collection of each status allows.
CONFIDENCE_CAP = {"met": 100, "partial": 54, "blocked": 54, "untracked": 45}

# Strings that tell of text decoded with a wrong encoding.
MOJIBAKE = (
    "�", "Ã", "Â", "â€", "â€™", "â€œ", "â€�", "æ�", "ç´", "å®", "°ï", "Öú", "¶À", "Á¢", "¹Ë", "ÎÊ", "¼¼ÄÜ", "È÷ÊÆ",
    "鏂囨梾", "鍏ㄩ摼", "璺惀", "閿€涓績",
)

# Platform names and their aliases.
PLATFORM_ALIASES = {
    "小红书": "xiaohongshu", "rednote": "xiaohongshu", "red": "xiaohongshu", "xhs": "xiaohongshu", "twitter": "x", "推特": "x", "抖音": "douyin",
    "tik tok": "tiktok", "国际抖音": "tiktok", "yt": "youtube", "油管": "youtube", "ins": "instagram", "fb": "facebook", "脸书": "facebook",
    "视频号": "wechat_channels", "wechat channels": "wechat_channels",
}

# Platforms that adapters read, and the names that they go by there.
ADAPTER_ALIASES = {
    "x": ("x", "twitter"),
    "xiaohongshu": ("xiaohongshu", "xhs", "小红书"),
    "youtube": ("youtube", "yt", "油管"),
    "tiktok": ("tiktok", "tik tok", "国际抖音"),
    "reddit": ("reddit",),
    "instagram": ("instagram", "ins"),
    "facebook": ("facebook", "fb", "脸书"),
}
