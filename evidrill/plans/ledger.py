"""Queries over the collection ledger, with customers as snapshots, orders as query runs and line items as cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CONTRACTS
from ..operators import collection, scoring
from ..sources import views
from .scores import _FIVE, DIMENSIONS_SQL, as_of


def _ledger(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(views.runs(spark, sf_dir), views.cards(spark, sf_dir))

    return query


def _counted(operator):
    """The same for operators that group cards by snapshot and key."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(views.runs(spark, sf_dir), views.cards(spark, sf_dir), views.card_parts(spark, sf_dir))

    return query


def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(collection.layer_stats)(spark, sf_dir)


def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counted(collection.collection_status)(spark, sf_dir)
    return c.select(
        "snapshot_id", "mode", "query_count", "observed_result_count", "unique_sample_count", "duplicate_count", "detail_open_count",
        "counter_signal_count", F.array_join("failed_checks", ",").alias("failed_checks"), "stop_reason", "contract_status",
    )


def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counted(collection.search_budget)(spark, sf_dir)
    return c.select("snapshot_id", "observed_result_count", "launch_ceiling", "may_start_search", "atomic_overshoot")


def query_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(collection.query_yields)(spark, sf_dir).select("query_id", "observed", "relevant", "relevant_yield_rate", "low_yield", "outcome")


def layer_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(collection.layer_deficits)(spark, sf_dir)


def recovery_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _counted(collection.recovery_needs)(spark, sf_dir)
    return n.withColumn("recommended_layers", F.array_join("recommended_layers", ","))


def recovery_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(collection.recovery_seeds)(spark, sf_dir).select("snapshot_id", "query_id", "query_term", "observed", "relevant", "seed_rank")


def _part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("snapshot_id"), F.col("p_partkey").alias("seed_rank"), F.concat(F.col("p_name"), F.lit(" tool "), F.col("p_type")).alias("query_term")
    )


def recommended_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.recommended_terms(_part_terms(spark, sf_dir))


def detail_backfill_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.signals(spark, sf_dir).select(
        "snapshot_id", F.col("signal_id").alias("signal_key"), F.array("query_layer").alias("layers"), "semantic_relevance", "evidence_role", "detail_captured"
    )
    needs = s.groupBy("snapshot_id").agg(
        F.lit(3).alias("category"), F.lit(0).alias("platform_baseline"), F.lit(2).alias("subject_bridge"), (F.count(F.lit(1)) % 20).alias("total")
    )
    return collection.detail_targets(s, needs)


def data_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.data_gaps(scoring.signal_index(views.signals(spark, sf_dir), as_of()))


QUERIES = {
    "layer_stats": layer_stats, "collection_status": collection_status, "search_budget": search_budget, "query_yields": query_yields,
    "layer_deficits": layer_deficits, "recovery_needs": recovery_needs, "recovery_seeds": recovery_seeds, "recommended_terms": recommended_terms,
    "detail_backfill_targets": detail_backfill_targets, "data_gaps": data_gaps,
}


def _c(name: str, bound: int | None = None) -> str:
    v = {m: (c[name] if bound is None else c[name][bound]) for m, c in CONTRACTS.items()}
    return f"(CASE mode WHEN 'standard' THEN {v['standard']} WHEN 'deep' THEN {v['deep']} ELSE {v['quick']} END)"


_RANK = "(CASE semantic_relevance WHEN 'weak' THEN 1 WHEN 'adjacent' THEN 2 WHEN 'direct' THEN 3 ELSE 0 END)"
LEDGER_SQL = f"""
runs AS ({views.as_sql(views.RUNS)}),
cards AS ({views.as_sql(views.CARDS)}),
uniq AS (SELECT snapshot_id, dedupe_key, count(*) AS n, list(DISTINCT query_layer) AS layers, max({_RANK}) AS relevance, bool_or(detail_captured) AS detail,
  bool_or(source_type IN ('direct_post', 'exported_item')) AS direct_source, bool_or(evidence_role = 'counter') AS counter FROM cards GROUP BY ALL),
found AS (SELECT snapshot_id, query_layer, count(*) AS unique_signal_count, count(*) FILTER (relevance >= 2) AS relevant_signal_count,
  count(*) FILTER (relevance = 3) AS direct_signal_count, count(*) FILTER (detail) AS detail_open_count,
  count(*) FILTER (relevance = 3 AND (detail OR direct_source)) AS direct_relevance_count
  FROM (SELECT *, unnest(layers) AS query_layer FROM uniq) GROUP BY ALL),
stats AS (SELECT s.snapshot_id, l.query_layer, coalesce(q.n, 0) AS query_count, coalesce(o.n, 0) AS observed_result_count, coalesce(unique_signal_count, 0) AS unique_signal_count,
  coalesce(relevant_signal_count, 0) AS relevant_signal_count, coalesce(direct_signal_count, 0) AS direct_signal_count, coalesce(detail_open_count, 0) AS detail_open_count,
  coalesce(direct_relevance_count, 0) AS direct_relevance_count
  FROM (SELECT DISTINCT snapshot_id FROM runs) s CROSS JOIN (SELECT unnest(['platform_baseline', 'category', 'subject_bridge']) AS query_layer) l
  LEFT JOIN (SELECT snapshot_id, query_layer, count(*) AS n FROM runs GROUP BY ALL) q USING (snapshot_id, query_layer)
  LEFT JOIN (SELECT snapshot_id, query_layer, count(*) AS n FROM cards GROUP BY ALL) o USING (snapshot_id, query_layer)
  LEFT JOIN found f USING (snapshot_id, query_layer)),
counts AS (SELECT r.*, coalesce(observed_result_count, 0) AS observed_result_count, coalesce(unique_sample_count, 0) AS unique_sample_count,
  coalesce(detail_open_count, 0) AS detail_open_count, coalesce(counter_signal_count, 0) AS counter_signal_count, coalesce(relevant_unique_count, 0) AS relevant_unique_count,
  coalesce(reviewed_count, 0) AS reviewed_count
  FROM (SELECT snapshot_id, count(*) AS query_count, any_value(mode) AS mode, any_value(snapshot_stop) AS stop FROM runs GROUP BY ALL) r
  LEFT JOIN (SELECT snapshot_id, CAST(sum(n) AS BIGINT) AS observed_result_count, count(*) AS unique_sample_count, count(*) FILTER (detail) AS detail_open_count,
    count(*) FILTER (counter) AS counter_signal_count, count(*) FILTER (relevance >= 2) AS relevant_unique_count, count(*) FILTER (relevance > 0) AS reviewed_count
    FROM uniq GROUP BY ALL) u USING (snapshot_id)),
yields AS (SELECT r.*, coalesce(observed, 0) AS observed, coalesce(relevant, 0) AS relevant FROM runs r LEFT JOIN (
  SELECT query_id, count(*) AS observed, count(*) FILTER (relevance >= 2) AS relevant
  FROM (SELECT query_id, dedupe_key, max({_RANK}) AS relevance FROM cards GROUP BY ALL) GROUP BY ALL) USING (query_id))
"""
_CHECKS = {
    "queries": f"query_count >= {_c('query_target', 0)}", "observed_results": f"observed_result_count >= {_c('observed_result_target', 0)}",
    "unique_signals": f"unique_sample_count >= {_c('unique_signal_target', 0)}", "relevant_unique_signals": f"relevant_unique_count >= {_c('relevant_unique_signal_min')}",
    "detail_opens": f"detail_open_count >= {_c('detail_open_target', 0)}", "counter_signals": f"counter_signal_count >= {_c('counter_signal_min')}",
    "layer_queries": f"lq >= {_c('layer_query_min')}", "layer_observed_results": f"lo >= {_c('layer_observed_min')}", "layer_unique_signals": f"lu >= {_c('layer_unique_signal_min')}",
    "layer_relevant_signals": f"lr >= {_c('layer_relevant_signal_min')}", "layer_direct_signals": f"ld >= {_c('layer_direct_signal_min')}",
    "layer_detail_opens": f"lt >= {_c('layer_detail_min')}", "subject_bridge_direct_evidence": f"bd >= {_c('subject_bridge_direct_min')}",
    "relevance_review_coverage": f"reviewed_count / greatest(unique_sample_count, 1) >= {_c('relevance_review_coverage_min')}",
}


def _lack(minimum: str, measure: str) -> str:
    return f"CAST(greatest(0, {_c(minimum)} - {measure}) AS BIGINT)"


_TOKENS = r"list_filter(list_transform(regexp_extract_all(query_term, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?|[\x{4e00}-\x{9fff}]+'), lambda x: lower(x)), lambda x: x NOT IN (" + ", ".join(f"'{t}'" for t in collection.GENERIC_TOKENS) + "))"


def _grams(n: int) -> str:
    return f"CASE WHEN len(t) > {n} THEN list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' ')) ELSE [] END"


_ORDER = "ORDER BY relevance DESC, role DESC, signal_key"
SQL = {
    "layer_stats": f"WITH {LEDGER_SQL} SELECT * FROM stats",
    "collection_status": f"""WITH {LEDGER_SQL}, least_ AS (SELECT snapshot_id, min(query_count) AS lq, min(observed_result_count) AS lo, min(unique_signal_count) AS lu,
  min(relevant_signal_count) AS lr, min(direct_signal_count) AS ld, min(detail_open_count) AS lt, max(CASE WHEN query_layer = 'subject_bridge' THEN direct_relevance_count END) AS bd FROM stats GROUP BY ALL),
checked AS (SELECT counts.*, concat_ws(',', {", ".join(f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in _CHECKS.items())}) AS failed_checks FROM counts JOIN least_ USING (snapshot_id)),
stopped AS (SELECT *, CASE WHEN stop IN ('', 'search_collection_complete') AND failed_checks = '' THEN 'sampling_contract_met' ELSE stop END AS stop_reason FROM checked)
SELECT snapshot_id, mode, query_count, observed_result_count, unique_sample_count, observed_result_count - unique_sample_count AS duplicate_count, detail_open_count, counter_signal_count,
  failed_checks, stop_reason, CASE WHEN observed_result_count = 0 THEN 'untracked' WHEN stop_reason = 'collection_in_progress' THEN 'in_progress'
  WHEN failed_checks = '' AND stop_reason IN ('', 'sampling_contract_met') THEN 'met' WHEN stop_reason <> '' THEN 'blocked' ELSE 'partial' END AS contract_status FROM stopped""",
    "search_budget": f"""WITH {LEDGER_SQL}, c AS (SELECT *, greatest({_c('observed_result_target', 0)}, {_c('observed_result_target', 1)} - {_c('atomic_read_reserve')}) AS launch_ceiling FROM counts)
SELECT snapshot_id, observed_result_count, launch_ceiling, observed_result_count <= launch_ceiling AS may_start_search,
  CAST(greatest(0, observed_result_count - {_c('observed_result_target', 1)}) AS BIGINT) AS atomic_overshoot FROM c""",
    "query_yields": f"""WITH {LEDGER_SQL} SELECT query_id, observed, relevant, round_even(relevant / greatest(observed, 1)::DOUBLE, 3) AS relevant_yield_rate,
  observed = 0 OR (observed >= 8 AND relevant <= greatest(1, floor(observed * 0.1))) AS low_yield,
  CASE WHEN stop_reason = 'timeout' THEN 'completed_partial' WHEN observed = 0 THEN 'completed_with_zero_results' ELSE 'completed_with_results' END AS outcome FROM yields""",
    "layer_deficits": f"""WITH {LEDGER_SQL}, d AS (SELECT snapshot_id, query_layer, {_lack('layer_observed_min', 'observed_result_count')} AS observed,
  {_lack('layer_unique_signal_min', 'unique_signal_count')} AS "unique", {_lack('layer_relevant_signal_min', 'relevant_signal_count')} AS relevant,
  {_lack('layer_direct_signal_min', 'direct_signal_count')} AS direct_relevance, {_lack('layer_detail_min', 'detail_open_count')} AS details,
  CASE WHEN query_layer = 'subject_bridge' THEN {_lack('subject_bridge_direct_min', 'direct_relevance_count')} ELSE 0 END AS direct
  FROM stats JOIN (SELECT snapshot_id, any_value(mode) AS mode FROM runs GROUP BY ALL) USING (snapshot_id))
SELECT *, greatest(observed, "unique", relevant, direct_relevance, details, direct) > 0 AS recommended FROM d""",
    "recovery_seeds": f"""WITH {LEDGER_SQL} SELECT snapshot_id, query_id, query_term, observed, relevant, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY relevant DESC, observed DESC,
  round_even(relevant / greatest(observed, 1)::DOUBLE, 3) DESC, query_term, query_id) AS INT) AS seed_rank FROM yields WHERE observed > 0 QUALIFY seed_rank <= 5""",
    "recommended_terms": f"""WITH terms AS (SELECT p_brand AS snapshot_id, p_partkey AS seed_rank, p_name || ' tool ' || p_type AS query_term FROM part),
tok AS (SELECT *, {_TOKENS} AS t FROM terms),
cand AS (SELECT snapshot_id, seed_rank, list_concat(list_concat(CASE WHEN len(t) BETWEEN 2 AND 4 THEN [array_to_string(t, ' ')] ELSE [] END, {_grams(3)}), {_grams(2)}) AS c FROM tok),
each_term AS (SELECT snapshot_id, seed_rank, unnest(c) AS term, generate_subscripts(c, 1) AS pos FROM cand),
once AS (SELECT snapshot_id, term, min(seed_rank * 1000 + pos) AS fst FROM each_term WHERE (snapshot_id, term) NOT IN (SELECT (snapshot_id, lower(query_term)) FROM terms) GROUP BY ALL)
SELECT snapshot_id, term, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY fst) AS INT) AS term_rank FROM once QUALIFY term_rank <= 5""",
    "detail_backfill_targets": f"""WITH signals AS ({views.as_sql(views.SIGNALS)}),
needs AS (SELECT snapshot_id, count(*) % 20 AS total FROM signals GROUP BY ALL),
c AS (SELECT snapshot_id, signal_id AS signal_key, query_layer, CASE semantic_relevance WHEN 'direct' THEN 3 ELSE 2 END AS relevance,
  CASE evidence_role WHEN 'counter' THEN 2 WHEN 'support' THEN 1 ELSE 0 END AS role, total FROM signals JOIN needs USING (snapshot_id)
  WHERE NOT detail_captured AND semantic_relevance IN ('direct', 'adjacent')),
p AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, query_layer {_ORDER}) <= CASE query_layer WHEN 'category' THEN 6 WHEN 'subject_bridge' THEN 4 ELSE 0 END AS picked FROM c),
r AS (SELECT *, greatest(0, total - count(*) FILTER (picked) OVER (PARTITION BY snapshot_id)) AS still, row_number() OVER (PARTITION BY snapshot_id, picked {_ORDER}) AS n FROM p)
SELECT snapshot_id, signal_key, query_layer AS layer FROM r WHERE picked OR n <= still""",
    "data_gaps": f"""WITH {DIMENSIONS_SQL}, miss AS (SELECT snapshot_id, unnest(list_filter([{", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in _FIVE)}], lambda x: x IS NOT NULL)) AS field FROM dims),
g AS (SELECT snapshot_id, field, count(*) AS affected FROM miss GROUP BY ALL)
SELECT snapshot_id, field, affected, CASE WHEN affected = n THEN 'high' ELSE 'medium' END AS priority,
  CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY affected DESC, field) AS INT) AS task_rank FROM g JOIN (SELECT snapshot_id, count(*) AS n FROM dims GROUP BY ALL) USING (snapshot_id)""",
}
_GLOBAL = ", ".join(f"CAST(greatest(0, {_c(name, bound)} - {count}) AS BIGINT) AS {alias}" for alias, name, bound, count in (
    ("observed", "observed_result_target", 0, "observed_result_count"), ('"unique"', "unique_signal_target", 0, "unique_sample_count"), ("relevant", "relevant_unique_signal_min", None, "relevant_unique_count"),
    ("details", "detail_open_target", 0, "detail_open_count"), ("counters", "counter_signal_min", None, "counter_signal_count")))
NEEDS_SQL = f"""ld AS ({SQL["layer_deficits"]}), st AS ({SQL["layer_stats"]}), gl AS (WITH {LEDGER_SQL} SELECT snapshot_id, {_GLOBAL} FROM counts),
place AS (SELECT snapshot_id, query_layer, 0 AS kind, 0 AS n FROM ld WHERE recommended
  {" ".join(f"UNION ALL SELECT st.snapshot_id, query_layer, {i}, st.{count} FROM st JOIN gl USING (snapshot_id) WHERE gl.{metric} > 0" for i, (metric, count) in enumerate((("observed", "observed_result_count"), ('"unique"', "unique_signal_count"), ("relevant", "relevant_signal_count"), ("details", "detail_open_count")), 1))}
  UNION ALL SELECT snapshot_id, query_layer, 5, CASE query_layer WHEN 'subject_bridge' THEN 0 WHEN 'category' THEN 1 ELSE 2 END FROM st JOIN gl USING (snapshot_id) WHERE counters > 0),
least_place AS (SELECT snapshot_id, query_layer, min((kind, n)) AS p FROM place GROUP BY ALL), wanted AS (SELECT snapshot_id, string_agg(query_layer, ',' ORDER BY p, query_layer) AS recommended_layers FROM least_place GROUP BY ALL),
yl AS (WITH {LEDGER_SQL} SELECT snapshot_id, query_layer, min((-relevant, -observed, -round_even(relevant / greatest(observed, 1)::DOUBLE, 3), query_term, query_id)) AS b FROM yields WHERE observed > 0 GROUP BY ALL),
proven AS (SELECT snapshot_id, string_agg(query_layer, ',' ORDER BY b) AS proven FROM yl GROUP BY ALL),
needs0 AS (SELECT gl.*, recommended_layers AS rl, greatest(observed, "unique") > 0 AND greatest(relevant, details, counters) = 0 AND NOT coalesce(own, false) AS volume_only
  FROM gl LEFT JOIN wanted USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, bool_or(recommended) AS own FROM ld GROUP BY ALL) USING (snapshot_id)),
needs AS (SELECT * EXCLUDE (rl, proven), coalesce(CASE WHEN volume_only THEN proven END, rl, '') AS recommended_layers FROM needs0 LEFT JOIN proven USING (snapshot_id))"""
SQL["recovery_needs"] = f"WITH {NEEDS_SQL} SELECT * FROM needs"
