"""Goldens, edge cases and invariants of the evidence operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidrill.functions import scalars as S
from evidrill.operators import collection, decisions, dedup, review, scoring, text_rules
from evidrill.plans.decide import _chunks
from evidrill.sources import captures
from evidrill.streaming import chunks, ledger


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_numbers(spark):
    given = ["1,234", "1.5k", "2M", "3万", "1 亿", "-5", "abc", "", None, "12 views", "7b"]
    assert values(spark, S.number, given) == [1234.0, 1500.0, 2e6, 3e4, 1e8, None, None, None, None, None, 7e9]
    assert values(spark, S.parse_count, ["1.2K", "2.5", "3.5", "x1", "1,234,567"]) == [1200, 2, 4, None, 1234567]
    assert values(spark, lambda c: S.parse_count(c, "kmb", anchored=False, rounded=False), ["about 2.9 likes", "1.25k"]) == [2, 1250]


def test_texts_and_lists(spark):
    assert values(spark, S.text, ["  a　", None]) == ["a", ""]
    assert values(spark, S.items, ['["a","b"]', "a|b，c；d\ne", "", None, "[broken", " x , "]) == [["a", "b"], ["a", "b", "c", "d", "e"], [], [], ["[broken"], ["x"]]
    assert values(spark, S.boolean, ["Yes", " 1", "no", None]) == [True, True, False, False]
    assert values(spark, S.clock_seconds, ["01:30", "1:00:05", "7.5", "", None]) == [90.0, 3605.0, 7.5, None, None]
    assert values(spark, S.platform, ["XHS", "Tik Tok", "推特", "My Site!", ""]) == ["xiaohongshu", "tiktok", "x", "my_site", ""]
    assert values(spark, S.canonical_url, ["https://a.b/c/#d", "ftp://x", "artifact://q//"]) == ["https://a.b/c", "", "artifact://q"]


def test_worked_example_of_scores(spark):
    """views 1000, likes 40, comments 5, shares 3 on x: (40 + 2*5 + 3*3) / 1000 * 1000 = 59."""
    schema = ("snapshot_id string, ordinal bigint, signal_id string, platform string, source_type string, query_layer string, query_term string, semantic_relevance string, evidence_role string, "
              "detail_captured boolean, author_id string, topic_key string, title string, views double, likes double, saves double, comments double, shares double, search_rank double, "
              "search_result_count double, observed_content_count double, growth_rate_percent double, current_window_count double, previous_window_count double, published_text string")
    rows = [
        ("s", 1, "p1", "x", "direct_post", "category", "q", "direct", "support", True, "A", "t", "first", 1000.0, 40.0, None, 5.0, 3.0, None, None, 12.0, None, None, None, "2026-08-06 07:00:00"),
        ("s", 2, "p2", "x", "search_card", "category", "q", "direct", "counter", False, "b", "t", "second", None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, schema).withColumn("published_at", F.col("published_text").cast("timestamp"))
    as_of = F.lit("2026-08-06 08:00:00").cast("timestamp")
    r = {x.signal_id: x for x in scoring.signal_index(d, as_of).collect()}
    assert abs(r["p1"].engagement - 59.0) < 1e-9 and abs(r["p1"].content_volume - 37.13) < 0.01 and r["p1"].freshness == 100.0
    assert r["p1"].data_coverage == 50 and r["p1"].observed_heat == 27 and r["p1"].evidence_confidence == 70
    assert r["p1"].missing_fields == ["velocity", "search_demand"] and r["p2"].data_coverage == 0 and r["p2"].observed_heat == 0
    t = scoring.topic_index(d, as_of).first()
    assert t.signal_count == 2 and t.unique_author_count == 2 and t.counter_signal_count == 1 and t.title == "first" and t.confidence_cap == 45
    met = spark.createDataFrame([("s", "met")], "snapshot_id string, contract_status string")
    assert scoring.topic_index(d, as_of, met).first().confidence_cap == 100
    failed = spark.createDataFrame([("s", "t", "failed")], "snapshot_id string, topic string, audit_status string")
    assert scoring.topic_index(d, as_of, met, failed).first().confidence_cap == 54


def test_dropping_a_metric_never_raises_coverage(spark):
    from evidrill.sources import views

    s = views.signals(spark, "/root/testdata/sf0.001")
    as_of = F.lit(views.AS_OF).cast("timestamp")
    a = scoring.signal_index(s, as_of).select("signal_id", F.col("data_coverage").alias("a"))
    b = scoring.signal_index(s.withColumn("views", F.lit(None).cast("double")), as_of).select("signal_id", F.col("data_coverage").alias("b"))
    assert a.join(b, "signal_id").where("b > a").count() == 0


MERGE = ("snapshot_id string, dedupe_key string, ordinal bigint, signal_id string, source_type string, detail_captured boolean, title string, summary string, published_text string, semantic_relevance string, "
         "reviewed boolean, evidence_role string, topic_key string, query_term string, query_layer string, evidence_refs array<string>, limitations array<string>, views double, likes double, saves double, comments double, shares double")


def test_merge_is_a_fold_in_order(spark):
    rows = [
        ("s", "k", 1, "a", "search_card", False, "A", "", "", "weak", False, "neutral", "", "q1", "category", ["u1"], ["search_card_only"], 1.0, None, None, None, None),
        ("s", "k", 2, "b", "direct_post", True, "", "", "t2", "direct", True, "support", "tb", "q2", "category", ["u2", "u1"], ["x"], None, 2.0, None, None, None),
        ("s", "k", 3, "c", "exported_item", False, "C", "long summary", "t3", "adjacent", False, "counter", "tc", "q1", "subject_bridge", ["u3"], [], 9.0, 9.0, 3.0, None, None),
        ("s", "other", 4, "d", "unknown", False, "D", "s", "", "unreviewed", False, "neutral", "", "", "", [], ["search_card_only"], None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, MERGE)
    for d in (df, df.orderBy(F.desc("ordinal")).repartition(3)):
        m = {r.dedupe_key: r for r in dedup.merge_duplicates(d).collect()}
        k = m["k"]
        assert (k.signal_id, k.title, k.summary, k.published_text, k.detail_captured) == ("b", "A", "long summary", "t2", True)
        assert (k.semantic_relevance, k.evidence_role, k.topic_key, k.merged_from_count) == ("direct", "support", "tb", 3)
        assert k.query_terms == ["q1", "q2"] and k.query_layers == ["category", "subject_bridge"] and k.evidence_refs == ["u1", "u2", "u3"] and k.limitations == ["x"]
        assert (k.views, k.likes, k.saves) == (1.0, 2.0, 3.0)
        assert m["other"].limitations == ["search_card_only"] and m["other"].merged_from_count == 1


def test_snapshots_merge_first_wins_and_details_fill(spark):
    rows = [("s", "a", 1, False, "card", "category", "q1"), ("s", "a", 2, True, "full", "category", "q2"), ("s", "a", 3, True, "later", "bridge", "q1"), ("s", "b", 4, True, "own", "bridge", "q1")]
    m = {r.signal_id: r for r in dedup.merge_snapshots(spark.createDataFrame(rows, "subject string, signal_id string, ordinal int, detail_captured boolean, summary string, query_layer string, query_term string"), ["summary"]).collect()}
    assert m["a"].summary == "full" and m["a"].merged_rows == 3 and m["a"].query_terms == ["q1", "q2"] and m["b"].summary == "own"


def test_identity_prefers_ids_then_addresses(spark):
    d = spark.createDataFrame([("X", "1", "https://a/b#c", "u", "p", "t"), ("X", "", "https://a/b/#c", "u", "p", "t"), ("X", "", "", "u", "p", "t" * 600)], "pl string, id string, url string, au string, pu string, te string")
    got = [r[0] for r in d.select(dedup.identity(*[F.col(c) for c in d.columns])).collect()]
    assert got[:2] == ["x|content_id|1", "x|url|https://a/b"] and got[2] == "x|fallback|u|p|" + "t" * 500


def test_collection_closes_when_all_checks_pass(spark):
    runs, cards = [], []
    for i in range(9):
        layer = ("platform_baseline", "category", "subject_bridge")[i % 3]
        runs.append(("s", i, f"q{i}", layer, "quick", "query_target_met", "search_collection_complete"))
        cards += [("s", i, f"k{i}-{j}", layer, "direct", "counter" if j == 0 else "support", True, "direct_post") for j in range(4)]
    r = spark.createDataFrame(runs, "snapshot_id string, query_id bigint, query_term string, query_layer string, mode string, stop_reason string, snapshot_stop string")
    c = spark.createDataFrame(cards, "snapshot_id string, query_id bigint, dedupe_key string, query_layer string, semantic_relevance string, evidence_role string, detail_captured boolean, source_type string")
    s = collection.collection_status(r, c).first()
    assert s.contract_status == "met" and s.stop_reason == "sampling_contract_met" and s.failed_checks == []
    s = collection.collection_status(r, c.where("query_layer <> 'category'")).first()
    assert s.contract_status == "blocked" and "layer_unique_signals" in s.failed_checks
    assert collection.collection_status(r, c.limit(0)).first().contract_status == "untracked"
    doubled = collection.collection_status(r, c.unionByName(c)).first()
    assert doubled.unique_sample_count == 36 and doubled.duplicate_count == 36


def test_recommended_terms(spark):
    d = spark.createDataFrame([("s", 1, "AI meeting action items notes"), ("s", 2, "food waste"), ("s", 3, "AI 自动剪视频"), ("s", 4, "action items")], "snapshot_id string, seed_rank int, query_term string")
    got = [r.term for r in collection.recommended_terms(d).orderBy("term_rank").collect()]
    assert got == ["action items notes", "items notes", "自动剪视频"]


def test_stop_limitations(spark):
    d = spark.createDataFrame([(["sampling_contract_unmet: x", "keep", "collection_in_progress"],)], "l array<string>")
    assert d.select(collection.stop_limitations(F.col("l"), F.lit("safety_stop"))).first()[0] == ["keep", "safety_stop"]


def test_reddit_envelopes(spark):
    post = {"id": "p1", "title": "T", "subreddit": "r", "score": 5, "num_comments": 3, "created_utc": 1704067200}
    raw = json.dumps({"results": [{"data": {"posts": [post, {**post, "id": "p2"}]}}, {**post, "id": "p1"}]})
    d = spark.createDataFrame([(1, "q", "category", raw), (2, "q", "category", "no json"), (3, "q", "category", None)], "capture_id int, query_term string, query_layer string, raw string")
    got = captures.extract(captures.envelopes(d), "reddit").orderBy("search_rank").collect()
    assert [r.content_id for r in got] == ["p1", "p2"] and got[0].likes is None and got[0].comments == 3 and got[0].published == "2024-01-01T00:00:00Z"


@pytest.mark.parametrize(("url", "want"), [("https://youtu.be/abcdef1?t=2", "abcdef1"), ("https://www.youtube.com/watch?x=1&v=abc#q", "abc"), ("https://m.youtube.com/shorts/abcdefg", "abcdefg"), ("https://x.test/watch?v=a", "")])
def test_youtube_ids(spark, url, want):
    assert values(spark, captures.youtube_id, [url]) == [want]


def test_text_rules(spark):
    assert values(spark, text_rules.forbidden_keys, ['{"Cookie": 1}', '{"x": "cookie"}', None]) == [True, False, None]
    assert values(spark, text_rules.limitation_category, ["Vendor, not opened", "seller claim", "something"]) == ["context", "source", "validation"]
    d = spark.createDataFrame([("a" * 60, "A" * 58 + "!"), ("short", "shorter"), ("", ""), ("x y", "X-Y")], "a string, b string")
    assert [r[0] for r in d.select(text_rules.same_in_substance(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_review_faults_and_verbatim(spark):
    q, r = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("b",), ("c",)], "k string")
    assert {(x.k, x.fault) for x in review.review_faults(q, r, "k").collect()} == {("a", "missing"), ("b", "duplicate"), ("c", "extra")}
    e = spark.createDataFrame([(1, "Hello   World again"), (1, "tiny"), (2, "Hello World again")], "g int, text string")
    rows = spark.createDataFrame([(1, "said: hello world AGAIN, twice"), (1, "tiny bit")], "g int, row_text string")
    assert [x.text for x in review.verbatim(e, rows, ["g"]).collect()] == ["Hello   World again"]


def test_disjoint_references(spark):
    d = spark.createDataFrame([(["https://A/b/"], ["https://a/b#x"]), (["u"], ["v"]), (["u"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(decisions.disjoint_refs(F.col("a"), F.col("b"))).collect()] == [False, True, True]


def plain_fold(rows, target):
    out = {}
    for q, seq, status, cont, keys in sorted(rows):
        s = out.setdefault(q, dict(chunks=0, keys=[], timeouts=0, unknowns=0, empties=0, reason=""))
        if s["reason"]:
            continue
        s["chunks"] += 1
        cont = "unknown" if status == "timeout" else cont
        s["timeouts"] += status == "timeout"
        empty = not keys and status == "success" and cont == "available" and bool(s["keys"])
        s["empties"] = 0 if keys else s["empties"] + empty
        s["keys"] += [k for k in dict.fromkeys(keys) if k not in s["keys"]]
        unknown = status == "success" and len(s["keys"]) < target and cont == "unknown"
        s["unknowns"] += unknown
        s["reason"] = ("repeated_timeout" if status == "timeout" and s["timeouts"] >= 2 else "continuation_unresolved" if (unknown and s["unknowns"] >= 2) or (empty and s["empties"] >= 2)
                       else "query_target_met" if len(s["keys"]) >= target else "results_exhausted" if cont == "exhausted" else "")
    return {q: (s["chunks"], len(s["keys"]), s["timeouts"], s["unknowns"], s["reason"]) for q, s in out.items()}


def test_chunk_fold_matches_a_loop(spark):
    rng = random.Random(6)
    rows = [(q, i, rng.choice(["success", "success", "timeout", "error"]), rng.choice(["available", "available", "unknown", "exhausted"]), [f"k{rng.randrange(9)}" for _ in range(rng.randrange(3))]) for q in range(80) for i in range(6)]
    d = spark.createDataFrame(rows, "query_id bigint, seq bigint, read_status string, continuation_status string, keys array<string>")
    got = {r.query_id: (r.chunks, r.observed, r.timeouts, r.unknowns, r.stop_reason) for r in chunks.fold_chunks(d, 4).collect()}
    assert got == plain_fold(rows, 4)


def test_stream_of_chunks_ends_like_the_batch(spark, tmp_path):
    d = _chunks(spark, "/root/testdata/sf0.001").where("query_id % 10 = 0")
    for k, part in enumerate((d.where("seq <= 2"), d.where("seq > 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
            q = chunks.stream_chunks(stream, 6).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("states").collect():
        if r.query_id not in last or r.chunks >= last[r.query_id][0]:
            last[r.query_id] = (r.chunks, r.observed, r.timeouts, r.unknowns, r.stop_reason)
    want = {r.query_id: (r.chunks, r.observed, r.timeouts, r.unknowns, r.stop_reason) for r in chunks.fold_chunks(d, 6).collect()}
    assert last == want


def test_ledger_takes_each_run_once(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    a = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "snapshot_id string, query_id bigint, outcome string")
    for batch in (a, a, a.unionByName(spark.createDataFrame([("t", 1, "z")], a.schema))):
        ledger.append_runs(batch, folder)
    assert sorted((r.snapshot_id, r.query_id) for r in spark.read.parquet(folder).collect()) == [("s", 1), ("s", 2), ("t", 1)]


def test_ledger_of_runs_without_ids(spark, tmp_path):
    folder, schema = str(tmp_path / "ledger"), "snapshot_id string, query_id string, query_term string, query_layer string"
    first = spark.createDataFrame([("007", "1", "a", "l"), ("007", " ", "b", "l"), ("007", None, "b", "l"), ("007", "", "a", "l")], schema)
    again = spark.createDataFrame([("007", "", "b", "l"), ("007", "", "b", "m"), ("007", "2", "b", "l"), ("008", "", "b", "l"), ("008", None, None, None), ("008", "", "", None)], schema)
    for batch in (first, first, again, again, again.limit(0)):
        ledger.append_runs(batch, folder)
    kept = spark.read.schema(schema).parquet(folder).collect()
    found = sorted((r.snapshot_id, (r.query_id or "").strip(), r.query_term, r.query_layer) for r in kept)
    assert found == [("007", "", "b", "l"), ("007", "", "b", "m"), ("007", "1", "a", "l"), ("007", "2", "b", "l"), ("008", "", "", ""), ("008", "", "b", "l")]


def test_csv_files_have_their_own_headers(spark, tmp_path):
    from evidrill.sources import snapshots

    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a b.csv").write_bytes("\ufeffid,title\n1,one\n2,\"two\nlines\"\n".encode())
    (folder / "b.csv").write_text("title,id,likes\r\nthree,3,9\r\n")
    (folder / "c.csv").write_text("id,title\n4,four\n")
    (folder / "empty.csv").write_text("")
    for path in (str(folder), str(folder / "*.csv")):
        rows = sorted((r.raw for r in snapshots.read_csv(spark, path).collect()), key=lambda m: m["id"])
        assert rows == [{"id": "1", "title": "one"}, {"id": "2", "title": "two\nlines"}, {"id": "3", "title": "three", "likes": "9"}, {"id": "4", "title": "four"}]


def test_requests_beside_other_scripts(spark):
    from evidrill.operators import text_rules

    d = spark.createDataFrame([(0, "在reddit上"), (1, "在 reddit 上"), (2, "on reddit and youtube"), (3, None), (4, "")], "i int, prompt string")
    assert [r.platform for r in text_rules.classify_requests(d).orderBy("i").collect()] == [None, "reddit", None, None, None]


def test_snapshots_from_json_and_csv(spark, tmp_path):
    from evidrill.operators import normalize
    from evidrill.sources import snapshots

    (tmp_path / "a.json").write_text(json.dumps({"signals": [{"id": "1", "title": "T", "metrics": {"views": "1.5k"}, "author": {"name": "N"}}, "no object", {"url": "https://a/b/#c", "likes": True, "limitations": ["x", ""]}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"contentId": "9", "text": "a�b", "role": "Counter"}]))
    (tmp_path / "c.csv").write_bytes("﻿id,title,query_terms\n7,Hello,\"a|b\"\n".encode())
    j = snapshots.read_json(spark, str(tmp_path / "*.json"))
    assert j.count() == 4 and j.where("raw IS NULL").count() == 1
    n = normalize.normalize(j, "x", "public_web", "now").orderBy("snapshot_id", "ordinal").collect()
    assert [(r.signal_id, r.views, r.author_name) for r in n][:1] == [("1", 1500, "N")]
    assert n[1].canonical_url == "https://a/b/#c" and n[1].likes is None and n[1].limitations == ["x"] and n[1].source_type == "search_snippet"
    assert n[2].title == "ab" and n[2].evidence_role == "counter" and n[2].signal_id == "x-9" and len(n[2].limitations) == 1
    c = normalize.normalize(snapshots.read_csv(spark, str(tmp_path / "c.csv")), "yt", "customer_export", "now").first()
    assert (c.signal_id, c.platform, c.title, c.query_terms, c.source_type) == ("7", "youtube", "Hello", ["a", "b"], "exported_item")
    snapshots.write(j.select("snapshot_id", "ordinal"), str(tmp_path / "out"), by=["ordinal"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_opened_pages(spark):
    from evidrill.sources import details

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "target_id string, raw string")

    thread = [{"id": "9", "text": "other", "author": "@b", "likes": "2K"}, {"id": "1", "text": "The  post", "author": "@a", "views": "1,200", "replies": "3"}, {"id": "2", "text": " "}] + [{"id": str(10 + i), "text": f"r{i}", "author": "c"} for i in range(9)]
    x = details.x_threads(rows(("1", json.dumps(thread)), ("404", json.dumps(thread)), ("1", "junk"), ("1", None))).collect()
    assert len(x) == 1 and (x[0].title, x[0].author_id, x[0].views, x[0].comments) == ("The post", "a", 1200, 3)
    assert [c.text for c in x[0].representative_comments] == ["other", "r0", "r1", "r2", "r3"] and x[0].representative_comments[0].likes == 2000
    pairs = [{"field": "title", "value": "T"}, {"field": "channel", "value": "C"}, {"field": "description", "value": "D"}, {"field": "views", "value": "1.5万 views"}]
    y = details.youtube_details(rows(("a", json.dumps(pairs)), ("b", json.dumps({"title": "T", "channel": "C", "description": "D", "subscribers": "3M"})), ("c", json.dumps({"title": "T"})))).orderBy("target_id").collect()
    assert [(r.target_id, r.views, r.follower_count) for r in y] == [("a", 15000, None), ("b", None, 3000000)]
    yc = details.youtube_comments(rows(("a", json.dumps([{"author": {"name": "N"}, "content": "hi", "likes": "5"}, {"text": ""}, {"author": "M", "text": "yo"}])), ("b", "{}"))).orderBy("target_id").collect()
    assert [(c.author_name, c.text, c.likes) for c in yc[0].representative_comments] == [("N", "hi", 5), ("M", "yo", None)] and yc[1].representative_comments == []
    xc = details.xiaohongshu_comments(rows(("a", json.dumps([{"text": "一", "likes": "1.2万"}, {"text": "二", "is_reply": True}])))).first()
    assert [(c.text, c.likes) for c in xc.representative_comments] == [("一", 12000)]


def test_rendered_posts(spark):
    from evidrill.sources import details

    page = ("Ann @ann_1\nfirst [1] post\n1,234 views 5 Likes\nhttps://x.com/ann_1/status/11\n---\nBob @bob\nhello **there**\nShow more\nhttps://x.com/bob/status/22\n---\nno heading here\n---\nAnn @ann_1\nsecond\n"
            "https://x.com/ann_1/status/11\nhttps://x.com/ann_1/status/33\n---\nCy @cy\nwithout address")
    got = details.rendered_x_posts(spark.createDataFrame([("p", page)], "target_id string, raw string")).orderBy("position").collect()
    assert [(r.content_id, r.author_id, r.summary) for r in got] == [("11", "ann_1", "first  post"), ("22", "bob", "hello there"), ("33", "ann_1", "second")]
    assert (got[0].views, got[0].likes, got[1].views) == (1234, 5, None)


def test_media_rules(spark):
    from evidrill.operators import media

    raw = {"transcript": {"source": "Native Subtitle", "segments": [{"start": "01:05", "text": " hi "}, {"text": ""}]}, "ocrResults": [{"time": "3", "text": "ok"}, {"text": "bÃd"}], "frames": [{}] * 12, "warnings": [" "]}
    d = spark.createDataFrame([("a", json.dumps(raw)), ("b", json.dumps({"frames": [{}]})), ("c", "junk"), ("d", None)], "signal_key string, raw string")
    m = {r.signal_key: r for r in media.analyzer_results(d).collect()}
    assert (m["a"].provenance, m["a"].status, m["a"].dropped, m["a"].keyframes, len(m["a"].segments), m["a"].segments[0].start_seconds) == ("native_subtitle", "partial", 1, 8, 1, 65.0)
    assert m["b"].status == m["c"].status == m["d"].status == "unavailable" and m["b"].keyframes == 1


def test_recovery_plan_faults(spark):
    from evidrill.operators import findings

    rows = [("s", "", "action items", "category", "https://n"), ("t", "r9", "Old term", "category", "https://old"), ("u", "", "one two-three four's five six", "category", "mailto:x"), ("v", "", "invented phrase", "category", "https://n"),
            ("w", "", "any", "nowhere", "https://n"), ("x", "", "a", "category", "https://a"), ("x", "", "b", "category", "https://b")]
    r = spark.createDataFrame(rows, "snapshot_id string, id string, term string, layer string, url string")
    runs = spark.createDataFrame([("t", "r9", "old TERM", "https://old", "deep"), *[("w", str(i), f"q{i}", f"https://{i}", "quick") for i in range(99)]], "snapshot_id string, query_id string, query_term string, url string, mode string")
    needs = spark.createDataFrame([("s", ["category"], True), ("t", ["category"], False), ("u", ["subject_bridge"], False), ("v", [], True)], "snapshot_id string, recommended_layers array<string>, volume_only boolean")
    terms = spark.createDataFrame([("s", "Action Items"), ("v", "other phrase")], "snapshot_id string, term string")
    got = {(x.snapshot_id, x.rule) for x in findings.recovery_faults(r, runs, needs, terms).collect()}
    assert got == {("t", "repeated"), ("t", "id"), ("t", "url_repeated"), ("u", "words"), ("u", "layer"), ("u", "url"), ("v", "evidence"), ("w", "layer_name"), ("w", "budget"), ("x", "one_query")}


def test_formats_are_all_counted(spark):
    from evidrill.operators import findings

    rows = [("s", i, f, h) for i, (f, h) in enumerate([("Reel", "9K posts"), ("reel", None), (None, " 9K posts "), ("", "2M"), ("Short-Video", "1"), ("zine", "7"), ("p", ""), ("post", None), ("image", None)])]
    d = spark.createDataFrame(rows, "snapshot_id string, ordinal int, format string, hint string")
    assert [(x.format, x.signals) for x in findings.format_mix(d).orderBy("format_rank").collect()] == [("Format unconfirmed", 2), ("Post", 2), ("Reel", 2), ("Image", 1), ("Short video", 1), ("zine", 1)]
    assert [x.hint for x in findings.supply_hints(d).orderBy("hint_rank").collect()] == ["9K posts", "2M", "1"]


def test_redirects(spark):
    rows = [("https://www.facebook.com/search/posts?q=a+b", "https://m.facebook.com/search/posts/?q=A%20B", True, False), ("https://www.facebook.com/search/posts?q=a", "https://www.facebook.com/search/top?q=a", True, True),
            ("https://www.facebook.com/search/posts?q=a", "https://www.facebook.com/search/posts?q=b", True, True), ("https://www.facebook.com/x", "https://evil.test/x", False, True), ("https://other.test/", "https://evil.test/", False, False),
            ("https://www.facebook.com/search/posts?q=a", "", True, False), ("https://www.facebook.com/search/posts?q=a", "about:blank", True, False)]
    d = spark.createDataFrame(rows, "e string, a string, s boolean, want boolean")
    assert all(r.want == r.got for r in d.select("want", text_rules.abnormal_redirect(F.col("e"), F.col("a"), F.col("s")).alias("got")).collect())
