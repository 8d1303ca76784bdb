"""Queries over excerpts of single signals, merged evidence, released files, ledgers held against each other, and media
results in other spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, dedup, enrich, media, release, review, scoring
from ..operators.text_rules import SECRETS
from ..sources import views
from .scores import _FIVE, DIMENSIONS_SQL, as_of


def signal_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of each document, in capitals half of the times (where those stand for the same small letters; those of ß
    don't), held against the lines of one of its two channels."""
    d = views.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    said = F.substring("text", 11, F.lit(0) + (8 + k % 40).cast("int"))
    loud = (k % 2 == 0) & (review.normal_text(F.upper(said)) == review.normal_text(said))
    e = d.select(k.alias("signal_key"), F.when(k % 3 == 0, "ocr").otherwise("transcript").alias("channel"), F.when(loud, F.upper(said)).otherwise(said).alias("text"))
    rows = d.select(k.alias("signal_key"), F.posexplode(F.split("text", "\n")).alias("at", "row_text")).select("signal_key", F.when(F.col("at") % 2 == 1, "ocr").otherwise("transcript").alias("channel"), "row_text")
    return review.verbatim(e, rows, ["signal_key", "channel"]).select("signal_key", "channel")


def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items as snapshots of one subject: what the first detailed row of a part fills, and all references
    and artifacts in the order in which they came."""
    li = views.table(spark, sf_dir, "lineitem")
    order = F.struct((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("o"), F.col("l_extendedprice").alias("p"))
    refs = F.array(F.concat(F.lit("u"), F.col("l_orderkey") % 7), F.concat(F.lit("v"), F.col("l_quantity").cast("int") % 3), F.concat(F.lit("u"), F.col("l_quantity").cast("int") % 7))
    rows = li.select(
        F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("signal_id"), order.alias("ordinal"), (F.col("l_linestatus") == "F").alias("detail_captured"),
        F.col("l_extendedprice").alias("title"), F.col("l_quantity").alias("metrics"), F.col("l_returnflag").alias("query_layer"), F.col("l_linestatus").alias("query_term"), refs.alias("evidence_refs"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.concat(F.lit("f"), F.col("l_linenumber")))).alias("raw_artifacts"),
    )
    m = dedup.merge_snapshots(rows, ["detail_captured", "title", "metrics"], ["evidence_refs", "raw_artifacts"])
    return m.select("subject", "signal_id", "title", "metrics", "detail_captured", "merged_rows", F.array_join("evidence_refs", ",").alias("evidence_refs"), F.array_join("raw_artifacts", ",").alias("raw_artifacts"))


_PLANTED = {1: "C:\\Users\\example\\x", 2: "C:\\Users\\Bob\\x", 3: "see appdata/LOCAL/temp", 4: "codex-clipboard-7", 5: "PassWord = 'hunter2hunter2'", 6: "ghp_" + "a1" * 12, 7: "C:\\Users\\example.txt"}


def release_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds, some with what a release must not hold at their end, some not in UTF-8."""
    d = views.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    more = F.lit("")
    for at, said in _PLANTED.items():
        more = F.when(k % 11 == at, said).otherwise(more)
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), more)
    content = F.when(k % 9 == 0, F.concat(F.encode(text, "utf-8"), F.unhex(F.lit("FF41")))).otherwise(F.encode(text, "utf-8"))
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".png", ".py", ""))), (k % 5 + 1).cast("int"))
    files = d.select(F.concat(F.lit("docs/v1.2/d"), k, suffix).alias("path"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return release.audit_files(files, most_bytes=20_000)


def _ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """A customer's cards, as they were captured and as they were reviewed, each customer with a fault of its own."""
    c = F.col("snapshot_id")
    raw = views.cards(spark, sf_dir).select(
        "snapshot_id", "query_id", "position", F.col("dedupe_key").alias("signal_key"), F.col("dedupe_key").alias("content_id"), "detail_captured", "evidence_role", "semantic_relevance", F.lit("t").alias("topic_key"), F.lit("read").alias("review"), "price")
    second = (c % 17 == 0) & (F.col("position") == 2)
    reviewed = raw.where(~((c % 13 == 0) & (F.col("position") == 3))).withColumns({
        "detail_captured": F.col("detail_captured") | second, "evidence_role": F.when((c % 19 == 0) & (F.col("position") == 1), "").otherwise(F.col("evidence_role")), "topic_key": F.when(c % 29 == 0, "").otherwise(F.col("topic_key")),
    })
    sums = lambda d: decisions._sums(d)
    stored = sums(raw).select("snapshot_id", (F.col("details") + (c % 23 == 0).cast("int")).alias("details"), F.col("counters").alias("counters"))
    report = sums(reviewed).select("snapshot_id", F.col("details"), (F.col("counters") + (c % 31 == 0).cast("int")).alias("counters"), F.when(c % 3 == 0, "met").otherwise("partial").alias("contract_status"),
                                   F.when(c % 5 == 0, "timeout").otherwise("sampling_contract_met").alias("stop_reason"))
    named = F.when(c % 4 == 1, F.collect_set(F.when(F.col("position") == 2, F.col("content_id")))).when(c % 4 == 2, F.array(F.lit("p0"))).otherwise(F.array().cast("array<string>"))
    audits = raw.where(c % 17 == 0).groupBy("snapshot_id").agg(named.alias("content_ids"), F.lit(0).alias("details")).withColumn("success", c % 4 != 0)
    return raw, stored, reviewed, report, audits


def reviewed_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.ledger_faults(*_ledgers(spark, sf_dir))


def reviewed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _, reviewed, _, _ = _ledgers(spark, sf_dir)
    return decisions.reconcile_changed(raw, reviewed, ["snapshot_id", "query_id", "position", "signal_key", "price"], ["detail_captured", "evidence_role", "topic_key"])


def media_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as analyzer output in other spellings: plain strings, other names of times and texts, a bare list."""
    d = views.table(spark, sf_dir, "documents")
    k, lines = F.col("doc_id"), F.split("text", "\n")
    plain = F.struct(lines.alias("transcript"), F.struct(F.concat(F.lit(" Title "), k).alias("title"), (k % 600).alias("durationSeconds"), F.lit("ann").alias("channel"), F.lit("2024").alias("upload_date")).alias("metadata"), F.array(F.lit("Output does not contain any stream")).alias("warnings"))
    named = F.struct(F.struct(F.lit("en").alias("language"), F.transform(lines, lambda x, i: F.struct((i * 2).alias("startSeconds"), F.concat(i, F.lit(":05")).alias("endTime"), x.alias("content"))).alias("segments")).alias("transcript"), F.array(F.lit("odd"), F.lit("frame")).alias("frames"))
    shown = F.struct(F.transform(lines, lambda x, i: F.struct((i + 1).alias("timestampSeconds"), x.alias("text"), F.lit("0.5").alias("confidence"))).alias("ocr_results"), F.array(F.struct(F.lit(1).alias("timestamp"))).alias("frames"))
    raw = F.when(k % 4 == 0, F.to_json(plain)).when(k % 4 == 1, F.to_json(named)).when(k % 4 == 2, F.to_json(shown)).otherwise("not json")
    m = media.analyzer_results(d.select(k.alias("signal_key"), raw.alias("raw")))
    last = F.get("segments", F.size("segments") - 1)
    return m.select(
        "signal_key", F.size("segments").alias("segments"), F.size("ocr_rows").alias("ocr_rows"), "dropped", "keyframes", "status", "language", "content_format", "title", "duration_seconds", "uploader", "upload_date",
        last["start_seconds"].alias("last_start"), last["end_seconds"].alias("last_end"), F.get("ocr_rows", F.lit(0))["timestamp_seconds"].alias("first_row"),
    )


def commented_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as signals; what their users say was captured as comments for two in three."""
    t = views.table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    note = F.when(k % 2 == 0, "No Comment text was visible here").otherwise("Comment text was unavailable")
    signals = t.select("conv_id").distinct().select(
        k.alias("signal_key"), F.array(F.concat(F.lit("ref"), k)).alias("evidence_refs"), F.array(F.lit("partial"), note).alias("limitations"))
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"])
    captured = t.groupBy("conv_id").agg(said.alias("comments")).select(k.alias("signal_key"), F.when(k % 3 == 0, "blocked").otherwise("captured").alias("status"), "comments", F.when(k % 5 == 0, F.concat(F.lit("ref"), k)).otherwise(F.concat(F.lit("file"), k)).alias("artifact"))
    j = enrich.with_comments(signals, captured)
    return j.select("signal_key", "comment_capture_status", F.array_join("evidence_refs", ",").alias("evidence_refs"), F.array_join("limitations", ",").alias("limitations"), F.coalesce(F.size("representative_comments"), F.lit(0)).alias("comments"))


def comment_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    q = enrich.comment_queue(c.select(F.lit("s").alias("snapshot_id"), F.col("conv_id").cast("string").alias("signal_key"), F.col("turn").alias("comment_index"), "text"))
    return enrich.queue_digest(q, ["signal_key"], ["comment_index"], ["comment_index", "comment_key"])


def affected_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.affected_signals(scoring.signal_index(views.signals(spark, sf_dir), as_of()))


QUERIES = {
    "commented_signals": commented_signals, "comment_digests": comment_digests, "affected_signals": affected_signals,
    "signal_excerpts": signal_excerpts, "merged_evidence": merged_evidence, "release_audit": release_audit, "reviewed_ledgers": reviewed_ledgers, "reviewed_changes": reviewed_changes, "media_spellings": media_spellings,
}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FILES = f"""d AS (SELECT doc_id AS k, coalesce(text, '') || ' ' || CASE doc_id % 11 {" ".join(f"WHEN {at} THEN {_q(said)}" for at, said in _PLANTED.items())} ELSE '' END AS t FROM documents),
f AS (SELECT *, ['.md', '.TXT', '.png', '.py', ''][k % 5 + 1] AS suffix, 'docs/v1.2/d' || k || suffix AS path, strlen(t) + CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END AS n, suffix IN ('.md', '.TXT', '.py') AS is_text FROM d),
v AS (SELECT * FROM f WHERE is_text AND k % 9 <> 0)"""
_LEDGERS = f"""raw AS (SELECT snapshot_id AS c, query_id, position, dedupe_key AS s, detail_captured AS d, evidence_role AS r, semantic_relevance AS rel, 't' AS topic, price FROM ({views.as_sql(views.CARDS)})),
rev AS (SELECT c, query_id, position, s, d OR (c % 17 = 0 AND position = 2) AS d, CASE WHEN c % 19 = 0 AND position = 1 THEN '' ELSE r END AS r, rel, CASE WHEN c % 29 = 0 THEN '' ELSE 't' END AS topic, price FROM raw WHERE NOT (c % 13 = 0 AND position = 3))"""
SQL = {
    "commented_signals": """WITH g AS (SELECT conv_id AS k, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY ALL)
SELECT k AS signal_key, CASE WHEN k % 3 = 0 THEN 'unavailable' ELSE 'captured' END AS comment_capture_status, 'ref' || k || CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN '' ELSE ',file' || k END AS evidence_refs,
  'partial' || CASE WHEN k % 3 <> 0 THEN '' WHEN k % 2 = 0 THEN ',No Comment text was visible here' ELSE ',Comment text was unavailable' END AS limitations, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE n END AS INT) AS comments FROM g""",
    "comment_digests": r"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS signal_key, turn AS i, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM conversations),
q AS (SELECT signal_key, i, 'comment-' || substr(sha256(signal_key || chr(10) || i || chr(10) || t), 1, 20) AS k FROM c WHERE t <> '')
SELECT signal_key, count(*) AS entries, sha256('[' || string_agg('{"comment_index":' || i || ',"comment_key":"' || k || '"}', ',' ORDER BY i) || ']') AS queue_sha256 FROM q GROUP BY ALL""",
    "affected_signals": f"""WITH {DIMENSIONS_SQL} SELECT snapshot_id, unnest(list_filter([{", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in _FIVE)}], lambda x: x IS NOT NULL)) AS field, signal_id FROM dims""",
    "signal_excerpts": r"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'transcript' END AS channel, lower(trim(regexp_replace(substr(text, 11, 8 + doc_id % 40), '[\s\p{Z}]+', ' ', 'g'))) AS x FROM documents),
r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, CASE WHEN i % 2 = 0 THEN 'ocr' ELSE 'transcript' END AS channel, lower(trim(regexp_replace(l, '[\s\p{Z}]+', ' ', 'g'))) AS y FROM r)
SELECT doc_id AS signal_key, channel FROM e WHERE EXISTS (FROM n WHERE n.doc_id = e.doc_id AND n.channel = e.channel AND (x = y OR (length(x) >= 12 AND contains(y, x))))""",
    "merged_evidence": """WITH r AS (SELECT *, (l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT), l_extendedprice) AS o, l_linestatus = 'F' AS f FROM lineitem),
g AS (SELECT l_suppkey, l_partkey, coalesce(arg_min(l_extendedprice, o) FILTER (f), arg_min(l_extendedprice, o)) AS title, coalesce(arg_min(l_quantity, o) FILTER (f), arg_min(l_quantity, o)) AS metrics, bool_or(f) AS detail_captured, count(*) AS merged_rows FROM r GROUP BY ALL),
e AS (SELECT l_suppkey, l_partkey, o, unnest(['u' || (l_orderkey % 7), 'v' || (CAST(l_quantity AS INT) % 3), 'u' || (CAST(l_quantity AS INT) % 7)]) AS x, unnest([1, 2, 3]) AS i FROM r),
u AS (SELECT l_suppkey, l_partkey, x, min((o, i)) AS p FROM e GROUP BY ALL), a AS (SELECT l_suppkey, l_partkey, string_agg(x, ',' ORDER BY p) AS evidence_refs FROM u GROUP BY ALL),
b0 AS (SELECT l_suppkey, l_partkey, 'f' || l_linenumber AS x, min(o) AS p FROM r WHERE l_linenumber % 2 = 0 GROUP BY ALL), b AS (SELECT l_suppkey, l_partkey, string_agg(x, ',' ORDER BY p) AS raw_artifacts FROM b0 GROUP BY ALL)
SELECT g.l_suppkey AS subject, g.l_partkey AS signal_id, title, metrics, detail_captured, merged_rows, evidence_refs, coalesce(raw_artifacts, '') AS raw_artifacts FROM g JOIN a USING (l_suppkey, l_partkey) LEFT JOIN b USING (l_suppkey, l_partkey)""",
    "release_audit": rf"""WITH {_FILES} SELECT path, 'large_file' AS rule, CAST(n AS VARCHAR) AS detail FROM f WHERE n > 20000 UNION ALL SELECT path, 'not_utf8', '' FROM f WHERE is_text AND k % 9 = 0
{" ".join(f"UNION ALL SELECT path, 'fragment', {_q(x)} FROM v WHERE contains(lower(t), {_q(x.lower())})" for x in release.FRAGMENTS)}
{" ".join(f"UNION ALL SELECT path, 'secret', '{name}' FROM v WHERE regexp_matches(t, {_q(p)})" for name, p in SECRETS.items())}
UNION ALL SELECT path, 'path', '' FROM v WHERE len(list_filter(regexp_extract_all(t, '(?i)C:\\Users\\[^\\\s]+(?:\\|\s|$)'), lambda m: lower(m) NOT IN ('c:\users\example\', 'c:\users\example'))) > 0""",
    "reviewed_ledgers": f"""WITH {_LEDGERS}, a AS (SELECT c, s, bool_or(d) AS d, bool_or(r = 'counter') AS k FROM raw GROUP BY ALL), b AS (SELECT c, s, bool_or(d) AS d, bool_or(r = 'counter') AS k FROM rev GROUP BY ALL),
ap AS (SELECT c, s FROM b WHERE d AND NOT EXISTS (FROM a WHERE a.c = b.c AND a.s = b.s AND a.d)), two AS (SELECT DISTINCT c, s FROM raw WHERE position = 2),
n AS (SELECT c, count(*) AS n, count(*) FILTER (NOT EXISTS (FROM two WHERE two.c = ap.c AND two.s = ap.s)) AS missing FROM ap GROUP BY ALL)
SELECT c AS snapshot_id, 'raw_details' AS fault FROM (SELECT DISTINCT c FROM raw) WHERE c % 23 = 0 UNION ALL SELECT c, 'report_counters' FROM (SELECT DISTINCT c FROM rev) WHERE c % 31 = 0
UNION ALL SELECT c, CASE WHEN c % 4 = 0 THEN 'no_audit' WHEN c % 4 = 3 THEN 'audit_count' ELSE 'unaudited_detail' END FROM n WHERE c % 4 <> 1 OR missing > 0
UNION ALL SELECT DISTINCT c, 'lost_review' FROM rev WHERE d AND (r = '' OR (rel IN ('direct', 'adjacent') AND topic = '')) UNION ALL SELECT c, 'stop_reason' FROM (SELECT DISTINCT c FROM rev) WHERE c % 3 = 0 AND c % 5 = 0""",
    "reviewed_changes": f"""WITH {_LEDGERS} SELECT coalesce(raw.c, rev.c) AS snapshot_id, coalesce(raw.query_id, rev.query_id) AS query_id, coalesce(raw.position, rev.position) AS position, coalesce(raw.s, rev.s) AS signal_key, coalesce(raw.price, rev.price) AS price, CASE WHEN rev.c IS NULL THEN 'lost' WHEN raw.c IS NULL THEN 'added' ELSE 'changed' END AS fault
FROM raw FULL JOIN rev ON raw.c = rev.c AND raw.query_id = rev.query_id AND raw.position = rev.position AND raw.s = rev.s AND raw.price = rev.price WHERE rev.c IS NULL OR raw.c IS NULL OR (raw.d, raw.r, raw.topic) <> (rev.d, rev.r, rev.topic)""",
    "media_spellings": r"""WITH d AS (SELECT doc_id AS k, string_split(text, chr(10)) AS l FROM documents), h AS (SELECT *, list_filter(range(1, least(len(l), 200) + 1), lambda i: regexp_replace(l[i], '[\s\p{Z}]', '', 'g') <> '') AS seg,
  list_filter(range(1, least(len(l), 80) + 1), lambda i: regexp_replace(l[i], '[\s\p{Z}]', '', 'g') <> '') AS ocr FROM d)
SELECT k AS signal_key, CASE WHEN k % 4 < 2 THEN coalesce(len(seg), 0) ELSE 0 END AS segments, CASE WHEN k % 4 = 2 THEN coalesce(len(ocr), 0) ELSE 0 END AS ocr_rows, CASE WHEN k % 4 = 2 THEN coalesce(len(l) - len(ocr), 0) ELSE 0 END AS dropped, CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END AS keyframes,
  CASE WHEN k % 4 = 3 OR (k % 4 < 2 AND coalesce(len(seg), 0) = 0) OR (k % 4 = 2 AND coalesce(len(ocr), 0) = 0) THEN 'unavailable' WHEN k % 4 = 0 OR (k % 4 = 2 AND len(l) > len(ocr)) THEN 'partial' ELSE 'complete' END AS status, CASE WHEN k % 4 = 1 THEN 'en' ELSE '' END AS language,
  CASE k % 4 WHEN 0 THEN 'audio_or_slideshow' WHEN 2 THEN 'video' ELSE 'unknown' END AS content_format, CASE WHEN k % 4 = 0 THEN 'Title ' || k ELSE '' END AS title, CASE WHEN k % 4 = 0 THEN CAST(k % 600 AS DOUBLE) END AS duration_seconds,
  CASE WHEN k % 4 = 0 THEN 'ann' ELSE '' END AS uploader, CASE WHEN k % 4 = 0 THEN '2024' ELSE '' END AS upload_date, CASE WHEN k % 4 = 1 AND len(seg) > 0 THEN CAST((seg[-1] - 1) * 2 AS DOUBLE) END AS last_start, CASE WHEN k % 4 = 1 AND len(seg) > 0 THEN CAST((seg[-1] - 1) * 60 + 5 AS DOUBLE) END AS last_end,
  CASE WHEN k % 4 = 2 AND len(ocr) > 0 THEN CAST(ocr[1] AS DOUBLE) END AS first_row FROM h""",
}
