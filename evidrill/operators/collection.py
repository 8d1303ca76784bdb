"""The collection ledger: counts, layer statistics, contract checks, budgets, yields and recovery plans.

Inputs are query runs (snapshot_id, query_id, query_term, query_layer, mode, stop_reason) and result cards
(snapshot_id, query_id, dedupe_key, query_layer, semantic_relevance, evidence_role, detail_captured, source_type).
`parts` is the number of tasks that cards are dealt to when they are grouped by snapshot and key; 0 leaves it to the session,
whose number doesn't grow with the cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import CONTRACTS, QUERY_LAYERS, RELEVANCE_RANK


def _relevant() -> Column:
    return F.col("relevance") >= RELEVANCE_RANK["adjacent"]


def _direct() -> Column:
    return F.col("relevance") == RELEVANCE_RANK["direct"]


def contract(mode: Column, name: str, bound: int | None = None) -> Column:
    """A threshold of the mode's contract; an unknown mode is 'quick'."""
    pick = {m: (c[name] if bound is None else c[name][bound]) for m, c in CONTRACTS.items()}
    return S.lookup(mode, pick, pick["quick"])


def _dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df


def unique_signals(cards: DataFrame, parts: int = 0) -> DataFrame:
    """One row per (snapshot, key): what any of its cards says, and how many it has in each layer. Later counts need no
    distinct. Only numbers and flags are kept, so that it is a hash aggregate."""
    c = cards.select(
        "snapshot_id", "dedupe_key", *[(F.col("query_layer") == layer).alias(layer) for layer in QUERY_LAYERS],
        S.lookup(F.col("semantic_relevance"), RELEVANCE_RANK, 0).alias("relevance"), F.col("detail_captured").alias("detail"),
        F.col("source_type").isin("direct_post", "exported_item").alias("direct_source"), (F.col("evidence_role") == "counter").alias("counter"),
    )
    return _dealt(c, parts, "snapshot_id", "dedupe_key").groupBy("snapshot_id", "dedupe_key").agg(
        F.count(F.lit(1)).alias("cards"),
        *[F.count_if(layer).alias(f"{layer}_cards") for layer in QUERY_LAYERS],
        F.max("relevance").alias("relevance"), *[F.bool_or(c).alias(c) for c in ("detail", "direct_source", "counter")],
    )


#: What is counted of a layer.
_LAYER_COUNTS = ("query_count", "observed_result_count", "unique_signal_count", "relevant_signal_count", "direct_signal_count", "detail_open_count", "direct_relevance_count")


def _snapshots(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """Per snapshot of runs: counts over raw cards and over distinct keys, of the whole and of each layer, in one row, so that
    what is asked of them needs neither the cards again nor a join."""
    r = _dealt(runs, parts, "snapshot_id").groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("query_count"), F.min_by("mode", "query_id").alias("mode"), F.min_by("snapshot_stop", "query_id").alias("stop_reason"),
        *[F.count_if(F.col("query_layer") == layer).alias(f"{layer}_query_count") for layer in QUERY_LAYERS],
    )
    counts = {
        "observed_result_count": F.sum("cards"), "unique_sample_count": F.count(F.lit(1)), "detail_open_count": F.count_if("detail"), "counter_signal_count": F.count_if("counter"),
        "relevant_unique_count": F.count_if(_relevant()), "reviewed_count": F.count_if(F.col("relevance") > 0),
    }
    for layer in QUERY_LAYERS:
        here = F.col(f"{layer}_cards") > 0
        of_layer = {
            "observed_result_count": F.sum(f"{layer}_cards"), "unique_signal_count": F.count_if(here), "relevant_signal_count": F.count_if(here & _relevant()), "direct_signal_count": F.count_if(here & _direct()),
            "detail_open_count": F.count_if(here & F.col("detail")), "direct_relevance_count": F.count_if(here & _direct() & (F.col("detail") | F.col("direct_source"))),
        }
        counts |= {f"{layer}_{k}": v for k, v in of_layer.items()}
    u = unique_signals(cards, parts).groupBy("snapshot_id").agg(*[v.alias(k) for k, v in counts.items()])
    c = r.join(u, "snapshot_id", "left").na.fill(0)
    return c.withColumn("duplicate_count", F.col("observed_result_count") - F.col("unique_sample_count"))


def _layer(layer: str) -> Column:
    """A layer's counts in a row of `_snapshots`."""
    return F.struct(F.lit(layer).alias("query_layer"), *[F.col(f"{layer}_{k}").alias(k) for k in _LAYER_COUNTS])


def _by_layer(snapshots: DataFrame, *more: str) -> DataFrame:
    return snapshots.select("snapshot_id", *more, F.inline(F.array(*map(_layer, QUERY_LAYERS))))


def layer_stats(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """Three rows for each snapshot of runs, with zeros where a layer has nothing."""
    return _by_layer(_snapshots(runs, cards, parts))


def layer_stats_with_mode(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """The same with the mode of the snapshot."""
    return _by_layer(_snapshots(runs, cards, parts), "mode")


def ledger_counts(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """Per snapshot: counts over raw cards and over distinct keys."""
    return _snapshots(runs, cards, parts).drop(*[f"{layer}_{k}" for layer in QUERY_LAYERS for k in _LAYER_COUNTS])


def collection_status(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """Per snapshot: counts, the 14 contract checks as a map, stop reason and status."""
    m = F.col("mode")

    c = _snapshots(runs, cards, parts)
    for k in _LAYER_COUNTS[:-1]:
        c = c.withColumn("least_" + k, F.least(*[f"{layer}_{k}" for layer in QUERY_LAYERS]))
    c = c.withColumn("bridge_direct", F.col("subject_bridge_direct_relevance_count")).drop(*[f"{layer}_{k}" for layer in QUERY_LAYERS for k in _LAYER_COUNTS])
    checks = {
        "queries": F.col("query_count") >= contract(m, "query_target", 0),
        "observed_results": F.col("observed_result_count") >= contract(m, "observed_result_target", 0),
        "unique_signals": F.col("unique_sample_count") >= contract(m, "unique_signal_target", 0),
        "relevant_unique_signals": F.col("relevant_unique_count") >= contract(m, "relevant_unique_signal_min"),
        "detail_opens": F.col("detail_open_count") >= contract(m, "detail_open_target", 0),
        "counter_signals": F.col("counter_signal_count") >= contract(m, "counter_signal_min"),
        "layer_queries": F.col("least_query_count") >= contract(m, "layer_query_min"),
        "layer_observed_results": F.col("least_observed_result_count") >= contract(m, "layer_observed_min"),
        "layer_unique_signals": F.col("least_unique_signal_count") >= contract(m, "layer_unique_signal_min"),
        "layer_relevant_signals": F.col("least_relevant_signal_count") >= contract(m, "layer_relevant_signal_min"),
        "layer_direct_signals": F.col("least_direct_signal_count") >= contract(m, "layer_direct_signal_min"),
        "layer_detail_opens": F.col("least_detail_open_count") >= contract(m, "layer_detail_min"),
        "subject_bridge_direct_evidence": F.col("bridge_direct") >= contract(m, "subject_bridge_direct_min"),
        "relevance_review_coverage": F.col("reviewed_count") / F.greatest(F.col("unique_sample_count"), F.lit(1)) >= contract(m, "relevance_review_coverage_min"),
    }
    c = c.withColumn("failed_checks", F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()])))
    met = F.size("failed_checks") == 0
    stop = F.coalesce("stop_reason", F.lit(""))
    stop = F.when(stop.isin("", "search_collection_complete") & met, "sampling_contract_met").otherwise(stop)
    c = c.withColumn("stop_reason", stop)
    tracked = (F.col("observed_result_count") > 0) & (F.col("query_count") > 0)
    status = (
        F.when(~tracked, "untracked").when(F.col("stop_reason") == "collection_in_progress", "in_progress")
        .when(met & F.col("stop_reason").isin("", "sampling_contract_met"), "met").when(F.col("stop_reason") != "", "blocked").otherwise("partial")
    )
    return c.withColumn("contract_status", status)


def search_budget(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """Per snapshot: how many results may be observed before a new search, and by how much they were overshot."""
    m = F.col("mode")
    upper = contract(m, "observed_result_target", 1)
    ceiling = F.greatest(contract(m, "observed_result_target", 0), upper - contract(m, "atomic_read_reserve"))
    c = ledger_counts(runs, cards, parts)
    return c.withColumns({
        "launch_ceiling": ceiling, "may_start_search": F.col("observed_result_count") <= ceiling,
        "atomic_overshoot": F.greatest(F.lit(0), F.col("observed_result_count") - upper).cast("bigint"),
    })


def query_yields(runs: DataFrame, cards: DataFrame) -> DataFrame:
    """Per run: observed, relevant, their rate, low_yield and the outcome."""
    keys = cards.groupBy("query_id", "dedupe_key").agg(F.max(S.lookup(F.col("semantic_relevance"), RELEVANCE_RANK, 0)).alias("relevance"))
    per = keys.groupBy("query_id").agg(F.count(F.lit(1)).alias("observed"), F.count_if(_relevant()).alias("relevant"))
    r = runs.join(per, "query_id", "left").na.fill(0, ["observed", "relevant"])
    low = (F.col("observed") == 0) | ((F.col("observed") >= 8) & (F.col("relevant") <= F.greatest(F.lit(1), F.floor(F.col("observed") * 0.1))))
    partial = F.col("stop_reason") == "timeout"
    return r.withColumns({
        "relevant_yield_rate": F.bround(F.col("relevant") / F.greatest("observed", F.lit(1)), 3), "low_yield": low,
        "outcome": F.when(partial, "completed_partial").when(F.col("observed") == 0, "completed_with_zero_results").otherwise("completed_with_results"),
    })


def _deficits(of: Callable[[str], Column], bridge: Column) -> dict[str, Column]:
    """What a layer lacks to the contract's minimums; `of` gives its counts."""
    m = F.col("mode")

    def lack(minimum: str, measure: str) -> Column:
        return F.greatest(F.lit(0), contract(m, minimum) - of(measure)).cast("bigint")

    return {
        "observed": lack("layer_observed_min", "observed_result_count"), "unique": lack("layer_unique_signal_min", "unique_signal_count"), "relevant": lack("layer_relevant_signal_min", "relevant_signal_count"),
        "direct_relevance": lack("layer_direct_signal_min", "direct_signal_count"), "details": lack("layer_detail_min", "detail_open_count"),
        "direct": F.when(bridge, lack("subject_bridge_direct_min", "direct_relevance_count")).otherwise(F.lit(0)).cast("bigint"),
    }


def layer_deficits(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """Per (snapshot, layer): what is missing to the contract's minimums."""
    lacks = _deficits(F.col, F.col("query_layer") == "subject_bridge")
    d = layer_stats_with_mode(runs, cards, parts).select("snapshot_id", "query_layer", *[v.alias(k) for k, v in lacks.items()])
    return d.withColumn("recommended", F.greatest(*lacks) > 0)


def recovery_needs(runs: DataFrame, cards: DataFrame, parts: int = 0) -> DataFrame:
    """Per snapshot: what the whole lacks to its contract (observed, unique, relevant, details, counters), the layers that a
    new query should go to, in order, and whether volume is all that is lacking. First come layers that lack something
    themselves, by name; then, for each thing that the whole lacks, the layers with the least of it; counters are looked
    for in the bridge first. Where volume is all, the layers of the queries that yielded most, in that order, stand
    instead."""
    m = F.col("mode")

    def layer(name: str) -> Column:
        of = lambda k: F.col(f"{name}_{k}")
        lacking = F.greatest(*_deficits(of, F.lit(name == "subject_bridge")).values()) > 0
        return F.struct(F.lit(name).alias("query_layer"), lacking.alias("recommended"), of("observed_result_count").alias("observed"), of("unique_signal_count").alias("unique"), of("relevant_signal_count").alias("relevant"), of("detail_open_count").alias("details"))

    c = _snapshots(runs, cards, parts).withColumn("layers", F.array(*map(layer, sorted(QUERY_LAYERS))))
    lacks = {
        "observed": contract(m, "observed_result_target", 0) - F.col("observed_result_count"), "unique": contract(m, "unique_signal_target", 0) - F.col("unique_sample_count"),
        "relevant": contract(m, "relevant_unique_signal_min") - F.col("relevant_unique_count"), "details": contract(m, "detail_open_target", 0) - F.col("detail_open_count"),
        "counters": contract(m, "counter_signal_min") - F.col("counter_signal_count"),
    }
    c = c.select("snapshot_id", "layers", *[F.greatest(F.lit(0), v).cast("bigint").alias(k) for k, v in lacks.items()])

    def by_least(metric: str) -> Column:
        return F.transform(F.array_sort(F.transform("layers", lambda x: F.struct(x[metric].alias("n"), x["query_layer"].alias("layer")))), lambda x: x["layer"])

    none = F.array().cast("array<string>")
    wanted = [F.transform(F.filter("layers", lambda x: x["recommended"]), lambda x: x["query_layer"])]
    wanted += [F.when(F.col(k) > 0, by_least(k)).otherwise(none) for k in ("observed", "unique", "relevant", "details")]
    wanted.append(F.when(F.col("counters") > 0, F.array(*map(F.lit, ("subject_bridge", "category", "platform_baseline")))).otherwise(none))
    quality = (F.greatest("relevant", "details", "counters") > 0) | F.exists("layers", lambda x: x["recommended"])
    best = F.min(F.struct((-F.col("relevant")).alias("a"), (-F.col("observed")).alias("b"), (-F.col("relevant_yield_rate")).alias("c"), "query_term", "query_id"))
    proven = _dealt(query_yields(runs, cards).where("observed > 0"), parts, "snapshot_id").groupBy("snapshot_id", "query_layer").agg(best.alias("best")).groupBy("snapshot_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("best", "query_layer"))), lambda x: x["query_layer"]).alias("proven"))
    c = c.withColumn("volume_only", (F.greatest("observed", "unique") > 0) & ~quality).withColumn("recommended_layers", F.array_distinct(F.concat(*wanted)))
    c = c.join(proven, "snapshot_id", "left")
    return c.withColumn("recommended_layers", F.when(F.col("volume_only") & F.col("proven").isNotNull(), F.col("proven")).otherwise(F.col("recommended_layers"))).drop("layers", "proven")


def recovery_seeds(runs: DataFrame, cards: DataFrame, k: int = 5) -> DataFrame:
    """The k queries of each snapshot that yielded most."""
    y = query_yields(runs, cards).where("observed > 0")
    order = Window.partitionBy("snapshot_id").orderBy(F.desc("relevant"), F.desc("observed"), F.desc("relevant_yield_rate"), "query_term", "query_id")
    return y.withColumn("seed_rank", F.row_number().over(order)).where(F.col("seed_rank") <= k)


# Words that say little about a query.
GENERIC_TOKENS = ("ai", "automatic", "automated", "automation", "meeting", "meetings", "tool", "tools", "software", "app", "apps", "system", "systems")
_TOKEN = r"([A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[\x{4e00}-\x{9fff}]+)"


def recommended_terms(terms: DataFrame, k: int = 5) -> DataFrame:
    """terms: snapshot_id, seed_rank, query_term. Phrases cut from proven queries, in the order of the seeds: the
    whole without generic words, then runs of three and two; none that was a query, each once, k at most."""
    t = terms.withColumn("tokens", F.filter(F.transform(F.regexp_extract_all("query_term", F.lit(_TOKEN), 1), F.lower), lambda x: ~x.isin(*GENERIC_TOKENS)))
    n = F.size("tokens")
    none = F.array().cast("array<string>")

    def grams(size: int) -> Column:
        starts = F.sequence(F.lit(1), n - (size - 1))
        return F.when(n > size, F.transform(starts, lambda i: F.array_join(F.slice("tokens", i, size), " "))).otherwise(none)

    whole = F.when((n >= 2) & (n <= 4), F.array(F.array_join("tokens", " "))).when(
        (n == 1) & F.get("tokens", F.lit(0)).rlike(r"^[\x{4e00}-\x{9fff}]{2,12}$"), F.col("tokens")
    ).otherwise(none)
    found = t.select("snapshot_id", "seed_rank", F.posexplode(F.concat(whole, grams(3), grams(2))).alias("at", "term"))
    known = terms.select("snapshot_id", F.lower("query_term").alias("term")).distinct()
    once = found.groupBy("snapshot_id", "term").agg(F.min(F.struct("seed_rank", "at")).alias("first")).join(known, ["snapshot_id", "term"], "left_anti")
    order = Window.partitionBy("snapshot_id").orderBy("first.seed_rank", "first.at")
    return once.withColumn("term_rank", F.row_number().over(order)).where(F.col("term_rank") <= k).drop("first")


def detail_targets(signals: DataFrame, needs: DataFrame) -> DataFrame:
    """Which unopened signals to open. signals: snapshot_id, signal_key, layers, semantic_relevance, evidence_role,
    detail_captured. needs: snapshot_id, one column a layer, and `total`. Layers go in order of their names; each
    takes twice its need, a signal goes to one layer, and what the total still lacks comes from the rest.

    Signals of the same layers are taken best first, and no more of them than all needs together: each snapshot is cut
    down to so many of each set of layers, by a group limit that holds before the shuffle, and quotas are dealt
    among those alone."""
    relevance = S.lookup(F.col("semantic_relevance"), {"direct": 3, "adjacent": 2}, 0)
    role = S.lookup(F.col("evidence_role"), {"counter": 2, "support": 1}, 0)
    open_ = signals.where(~F.col("detail_captured") & F.col("semantic_relevance").isin("direct", "adjacent")).select(
        "snapshot_id", "signal_key", "layers", relevance.alias("relevance"), role.alias("role")
    )
    asked = sum((2 * F.col(layer) for layer in QUERY_LAYERS), F.col("total"))
    most = needs.agg(F.max(asked)).first()[0] or 0  # a single number, bounded by the contracts
    alike = Window.partitionBy("snapshot_id", "kind").orderBy(F.desc("relevance"), F.desc("role"), "signal_key")
    open_ = open_.withColumn("kind", F.array_join(F.array_sort(F.array_distinct("layers")), ","))
    open_ = open_.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= int(most)).drop("n", "kind").join(needs, "snapshot_id")
    rest = open_.withColumn("layer", F.lit(None).cast("string"))
    for layer in sorted(QUERY_LAYERS):
        fits = F.col("layer").isNull() & F.array_contains("layers", layer)
        within = Window.partitionBy("snapshot_id", fits).orderBy(F.desc("relevance"), F.desc("role"), "signal_key")
        rest = rest.withColumn("layer", F.when(fits & (F.row_number().over(within) <= 2 * F.col(layer)), layer).otherwise(F.col("layer")))
    taken = F.count("layer").over(Window.partitionBy("snapshot_id"))
    rest = rest.withColumn("still", F.greatest(F.lit(0), F.col("total") - taken))
    left = Window.partitionBy("snapshot_id", F.col("layer").isNull()).orderBy(F.desc("relevance"), F.desc("role"), "signal_key")
    more = F.col("layer").isNull() & (F.row_number().over(left) <= F.col("still"))
    return rest.withColumn("layer", F.when(more, F.get("layers", F.lit(0))).otherwise(F.col("layer"))).where("layer IS NOT NULL").select("snapshot_id", "signal_key", "layer")


def stop_limitations(limitations: Column, reason: Column) -> Column:
    """Limitations of a ledger that stops: transient notes go, the reason is added once."""
    kept = F.filter(limitations, lambda x: ~(x.startswith("sampling_contract_unmet:") | x.startswith("observed_budget_guard:") | x.isin("collection_in_progress", "search_collection_complete")))
    return F.array_distinct(F.concat(kept, F.array(reason)))


def data_gaps(indexed: DataFrame) -> DataFrame:
    """indexed: snapshot_id, signal_id, missing_fields. One task per missing field, most affected first."""
    total = indexed.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("signals"))
    g = indexed.select("snapshot_id", F.explode("missing_fields").alias("field")).groupBy("snapshot_id", "field").agg(F.count(F.lit(1)).alias("affected"))
    order = Window.partitionBy("snapshot_id").orderBy(F.desc("affected"), "field")
    return g.join(total, "snapshot_id").select(
        "snapshot_id", "field", "affected", F.when(F.col("affected") == F.col("signals"), "high").otherwise("medium").alias("priority"),
        F.row_number().over(order).alias("task_rank"),
    )
