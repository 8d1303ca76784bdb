"""Review labels joined back to what they judge: signals, comments, media excerpts, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEVANCE = ("direct", "adjacent", "weak")
ROLES = ("support", "counter", "neutral")
COLLISION = "excluded-keyword-collision"


def apply_semantic(signals: DataFrame, reviews: DataFrame) -> DataFrame:
    """signals: snapshot_id, content_id, semantic_relevance, evidence_role, topic_key. reviews: the same keys with
    relevance, role, topic. A reviewed signal takes the review's values; a weak one leaves its topic."""
    r = reviews.select("snapshot_id", "content_id", F.col("relevance").alias("_rel"), F.col("role").alias("_role"), F.col("topic").alias("_topic"))
    j = signals.join(r, ["snapshot_id", "content_id"], "left")
    seen = F.col("_rel").isNotNull()
    return j.withColumns({
        "semantic_relevance": F.when(seen, F.col("_rel")).otherwise(F.col("semantic_relevance")),
        "evidence_role": F.when(seen, F.col("_role")).otherwise(F.col("evidence_role")),
        "topic_key": F.when(F.col("_rel") == "weak", COLLISION).when(seen & (F.col("_topic") != ""), F.col("_topic")).otherwise(F.col("topic_key")),
        "reviewed": seen,
    }).drop("_rel", "_role", "_topic")


def review_faults(queue: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Keys that are missing from the reviews, in them but not in the queue, or reviewed more than once."""
    counted = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    q = queue.select(key).distinct().withColumn("queued", F.lit(True))
    j = q.join(counted, key, "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("queued").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return j.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def label_faults(reviews: DataFrame, topic_rule: bool = True) -> DataFrame:
    """Rules on labels, one row per broken rule: known values, a reason, a topic or insight where relevant."""
    relevant = F.col("relevance").isin("direct", "adjacent")
    rules = {
        "semantic_relevance": ~F.col("relevance").isin(*RELEVANCE), "evidence_role": ~F.col("role").isin(*ROLES),
        "reason": F.coalesce(F.col("reason"), F.lit("")) == "",
    }
    if topic_rule:
        rules["topic_key"] = relevant & (F.coalesce(F.col("topic"), F.lit("")) == "")
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), k) for k, c in rules.items()]))
    return reviews.select("*", F.explode(broken).alias("rule"))


def first_texts(rows: DataFrame, by: list[str], order: str, text: str, keep: int, name: str) -> DataFrame:
    """Per group an array of the first `keep` different texts that aren't blank, by their least place (ties by text). Each
    text is one row before the shuffle, and no group is gathered beyond what it keeps."""
    t = rows.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(*by, F.col(text).alias("_x")).agg(F.min(order).alias("_at"))
    t = t.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_at", "_x"))).where(F.col("_n") <= keep)
    return t.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda x: x["_x"]).alias(name))


def comment_summary(comments: DataFrame, by: list[str], keep: int = 5) -> DataFrame:
    """comments: ordinal, category, relevance, role, insight and the grouping columns. Counts, a map of category
    counts over relevant comments, and the first `keep` different insights."""
    relevant = F.col("relevance").isin("direct", "adjacent")
    g = comments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reviewed_count"), F.count_if(relevant).alias("relevant_count"),
        F.count_if(relevant & (F.col("role") == "support")).alias("support_count"), F.count_if(relevant & (F.col("role") == "counter")).alias("counter_count"),
    )
    c = comments.where(relevant).groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts")
    )
    said = first_texts(comments.where(relevant), by, "ordinal", "insight", keep, "insights")
    return g.join(c, by, "left").join(said, by, "left").withColumn("insights", F.coalesce("insights", F.array().cast("array<string>")))


def with_comment_review(signals: DataFrame, comments: DataFrame) -> DataFrame:
    """Signals (signal_key) with what the review of their comments found; a signal without reviewed comments has zeros."""
    s = comment_summary(comments, ["signal_key"])
    j = signals.join(s, "signal_key", "left")
    return j.na.fill(0, ["reviewed_count", "relevant_count", "support_count", "counter_count"]).withColumn("comment_evidence", F.when(F.col("relevant_count") > 0, "relevant").when(F.col("reviewed_count") > 0, "reviewed").otherwise("unreviewed"))


def normal_text(c: Column) -> Column:
    """Runs of white space as one space, lower case letter by letter, whatever stands beside a letter."""
    return F.lower(F.translate(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")), "Σİ", "σi"))


#: How many counts stand for the frequencies of grams; at most as many rows are broadcast.
GRAM_BUCKETS = 1 << 16

#: A row is compared with all excerpts of its key, up to so many; that costs about as much as cutting it into runs.
FEW_EXCERPTS = 256


def _grams(text: Column, n: int) -> Column:
    """Hashes of all runs of n characters, in order; the text is gone through once."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1), lambda g: F.xxhash64(g))


def verbatim(excerpts: DataFrame, rows: DataFrame, key: list[str], least: int = 12) -> DataFrame:
    """Excerpts (text) that equal a row (row_text) of the same key, or, from `least` characters on, stand within one; both
    without regard to case and runs of white space.

    Keys of at most FEW_EXCERPTS different excerpts have them in a list, which each row of the key is held against.
    For the other keys, short excerpts are joined by equality. Of a long one the rarest run of `least` characters is looked
    up among those of the rows, and only rows that hold it are compared. How rare a run is, is read from counts over buckets
    of hashes, GRAM_BUCKETS in number whatever the texts; rows are cut into runs where they are, and only the runs in
    buckets that some excerpt asks for are shuffled. Excerpts with a null in the key, or a null text, have no row."""
    e = excerpts.withColumn("_e", normal_text(F.col("text")))
    all_asked = e.select(*key, "_e").where(F.col("_e").isNotNull()).distinct()
    all_rows = rows.select(*key, normal_text(F.col("row_text")).alias("_r"))
    size = all_asked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    lists = all_asked.join(size.where(F.col("_n") <= FEW_EXCERPTS), key).groupBy(*key).agg(
        F.collect_list(F.struct("_e", F.octet_length("_e").alias("n"), (F.length("_e") >= least).alias("long"))).alias("_few"))
    holds = lambda x: (x["n"] <= F.octet_length("_r")) & ((F.col("_r") == x["_e"]) | (x["long"] & F.col("_r").contains(x["_e"])))
    listed = all_rows.join(lists, key).select(*key, F.explode(F.filter("_few", holds)["_e"]).alias("_e")).distinct()

    many = size.where(F.col("_n") > FEW_EXCERPTS).select(*key)
    asked, r = all_asked.join(many, key, "left_semi"), all_rows.join(many, key, "left_semi")
    short = asked.where(F.length("_e") < least)
    equal = short.join(r.withColumnRenamed("_r", "_e"), [*key, "_e"], "left_semi")
    bucket = F.pmod("gram", F.lit(GRAM_BUCKETS)).cast("int")
    of_rows = r.where(F.length("_r") >= least).select(*key, "_r", F.explode(_grams(F.col("_r"), least)).alias("gram")).withColumn("bucket", bucket)
    counts = of_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    of_excerpts = asked.where(F.length("_e") >= least).select(*key, "_e", F.posexplode(_grams(F.col("_e"), least)).alias("at", "gram")).withColumn("bucket", bucket)
    # an excerpt with a run in an empty bucket stands nowhere
    rarest = of_excerpts.join(F.broadcast(counts), "bucket", "left").groupBy(*key, "_e").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram", "bucket")).alias("x"))
    rarest = rarest.where("x.n > 0").select(*key, "_e", "x.gram", "x.bucket")
    wanted = F.broadcast(rarest.select("bucket").distinct())
    candidates = of_rows.join(wanted, "bucket", "left_semi").select(*key, "gram", "_r").distinct()
    inside = rarest.join(candidates, [*key, "gram"]).where(F.col("_r").contains(F.col("_e"))).select(*key, "_e").distinct()
    return e.join(listed.unionByName(equal).unionByName(inside), [*key, "_e"], "left_semi").select(*excerpts.columns)


def cluster_plan(signals: DataFrame, clusters: DataFrame) -> DataFrame:
    """Assign every signal to the cluster of its topic, else to the fallback cluster, with its fit. clusters:
    cluster, source_topic (null for the fallback). Small table, broadcast when Spark knows its size."""
    named = clusters.where(F.col("source_topic").isNotNull()).select(F.col("source_topic").alias("topic_key"), "cluster")
    fallback = clusters.where(F.col("source_topic").isNull()).agg(F.first("cluster").alias("fallback"))
    j = signals.join(named, "topic_key", "left").crossJoin(F.broadcast(fallback))  # a single row
    weak = F.col("semantic_relevance") == "weak"
    fit = F.when(weak, "supporting").when(F.col("evidence_role") == "counter", "counter").when(F.col("semantic_relevance") == "direct", "core").otherwise("supporting")
    return j.withColumn("cluster", F.coalesce("cluster", "fallback")).withColumn("fit", fit).withColumn("transition_match", ~weak).drop("fallback")


FITS = ("core", "supporting", "counter")


def assignment_faults(assignments: DataFrame, signals: DataFrame) -> DataFrame:
    """assignments: snapshot_id, signal_id, fit, reason, transition_match. signals: snapshot_id, signal_id. Every signal is
    assigned exactly once, with a fit, a reason and a yes or no on its match: a row for each broken rule (snapshot_id,
    signal_id, fault)."""
    key = ["snapshot_id", "signal_id"]
    known = signals.select(*key).distinct().withColumn("_known", F.lit(True))
    a = assignments.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("fit").isin(*FITS), F.lit(False))).alias("fits"), F.bool_and(F.trim(F.coalesce("reason", F.lit(""))) != "").alias("reasoned"), F.bool_and(F.col("transition_match").isNotNull()).alias("matched"),
    )
    j = a.join(known, key, "full_outer")
    given = F.col("n").isNotNull()
    rules = {"unassigned": ~given, "unknown_signal": given & F.col("_known").isNull(), "repeated": F.col("n") > 1, "fit": given & ~F.col("fits"), "reason": given & ~F.col("reasoned"), "transition_match": given & ~F.col("matched")}
    return j.select(*key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))).alias("fault"))


def cluster_audit(assigned: DataFrame) -> DataFrame:
    """Coherence gates per (snapshot_id, cluster)."""
    direct = F.col("detail_captured") | F.col("source_type").isin("direct_post", "exported_item")
    g = assigned.groupBy("snapshot_id", "cluster").agg(
        F.count(F.lit(1)).alias("member_count"), F.count_distinct(F.when(F.col("author_id") != "", F.lower("author_id"))).alias("author_count"),
        F.count_if(direct).alias("direct_source_count"), F.count_if(F.col("fit") == "core").alias("core_member_count"),
        F.count_if(F.col("fit") == "counter").alias("counter_member_count"), F.count_if("transition_match").alias("matches"),
        F.count_if(F.col("query_layer") == "subject_bridge").alias("bridge_count"),
    )
    checks = {
        "member_count": F.col("member_count") >= 3, "author_diversity": F.col("author_count") >= 2, "direct_source": F.col("direct_source_count") >= 1,
        "core_members": F.col("core_member_count") >= 2, "task_transition_match": F.col("matches") / F.col("member_count") >= 0.8, "subject_bridge_member": F.col("bridge_count") >= 1,
    }
    failed = F.array_compact(F.array(*[F.when(~c, k) for k, c in checks.items()]))
    return g.withColumn("failed_checks", failed).withColumn("audit_status", F.when(F.size("failed_checks") == 0, "passed").otherwise("failed")).withColumn(
        "match_rate", F.bround(F.col("matches") / F.col("member_count"), 3)
    )


def media_candidates(signals: DataFrame, k: int = 10) -> DataFrame:
    """The k signals of each snapshot to review as media: by relevance, bridge, counter, unopened and engagement.
    The best comes first, then the best of the opposite role by another author, then the best of each author not
    yet seen, then the others. Exactly k, where there are as many.

    Each snapshot is first cut down to the rows that can be chosen (`_within_reach`), by group limits that hold before
    any shuffle; only those are ranked together."""
    weight = {"views": 0.05, "likes": 1.0, "comments": 2.0, "shares": 2.5, "saves": 2.5}
    engaged = F.log1p(sum((F.greatest(F.coalesce(F.col(m), F.lit(0.0)), F.lit(0.0)) * w for m, w in weight.items()), F.lit(0.0)))
    relevance = F.when(F.col("semantic_relevance") == "direct", 400.0).when(F.col("semantic_relevance") == "adjacent", 300.0).when(
        F.col("semantic_relevance") == "unreviewed", 150.0).when(F.col("semantic_relevance") == "weak", 50.0).otherwise(0.0)
    score = relevance + F.when(F.col("query_layer") == "subject_bridge", 70.0).otherwise(0.0) + F.when(F.col("evidence_role") == "counter", 40.0).otherwise(0.0) \
        + F.when(~F.col("detail_captured"), 20.0).otherwise(0.0) + F.bround(engaged, 6)
    return ranked_candidates(_within_reach(signals.withColumn("score", score).withColumn("author", F.lower("author_id")), k), k)


def _best_of(s: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n best rows of each group."""
    return s.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("signal_id")))).where(F.col("_n") <= n).drop("_n")


def _within_reach(s: DataFrame, k: int) -> DataFrame:
    """The rows of each snapshot among which `ranked_candidates` finds its k, a few times k however large it is.

    The runner-up is the best of its role without an author, or of that role's two best authors. Then come k rows at
    most that have no author or are their author's best: the k + 2 best of either, as two may have gone before. If
    those are fewer than k, all others that are chosen are among the 2 k best."""
    whole = ["snapshot_id"]
    nameless = F.coalesce(F.col("author") == "", F.lit(False))
    top = _best_of(s, whole, 2 * k + 2)
    own = _best_of(s.where(~nameless), [*whole, "author", "evidence_role"], 1)
    authors = _best_of(_best_of(own, [*whole, "author"], 1), whole, k + 2)
    roles = _best_of(own, [*whole, "evidence_role"], 2)
    others = _best_of(s.where(nameless), [*whole, "evidence_role"], k + 2)
    return top.unionByName(authors).unionByName(roles).unionByName(others).dropDuplicates(["snapshot_id", "signal_id"])


def ranked_candidates(s: DataFrame, k: int) -> DataFrame:
    """The k candidates of each snapshot in their order; s has a score and an author as well."""
    best = Window.partitionBy("snapshot_id").orderBy(F.desc("score"), F.desc("signal_id"))
    s = s.withColumn("r", F.row_number().over(best))
    whole = Window.partitionBy("snapshot_id")
    top = F.max(F.when(F.col("r") == 1, F.struct("evidence_role", "author"))).over(whole)
    opposite = F.when(top["evidence_role"] == "counter", "support").otherwise("counter")
    second = F.min(F.when((F.col("r") > 1) & (F.col("evidence_role") == opposite) & ((F.col("author") == "") | (F.col("author") != top["author"])), F.col("r"))).over(whole)
    s = s.withColumn("seed", F.when(F.col("r") == 1, 1).when(F.col("r") == second, 2).otherwise(3)).withColumn(
        "seed", F.when((F.col("seed") == 2) & F.lit(k < 2), 3).otherwise(F.col("seed")))
    of_author = F.row_number().over(Window.partitionBy("snapshot_id", "author").orderBy("seed", "r"))
    s = s.withColumn("phase", F.when(F.col("seed") < 3, F.col("seed")).when((F.col("author") == "") | (of_author == 1), 3).otherwise(4))
    chosen = Window.partitionBy("snapshot_id").orderBy("phase", "r")
    return s.withColumn("rank", F.row_number().over(chosen)).where(F.col("rank") <= k)
