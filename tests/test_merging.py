"""Merging, excerpts, candidates, quotas, captures and the ledger against plain versions, and with hot keys."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from evidrill import plans
from evidrill.functions.constants import RELEVANCE_RANK
from evidrill.operators import collection, dedup, enrich, review
from evidrill.plans import audits
from evidrill.sources import views
from evidrill.streaming import chunks, ledger

from .test_operators import MERGE

NAMES = [c.split()[0] for c in MERGE.split(", ")]
QUALITY = {"direct_post": 100, "exported_item": 90, "search_card": 55, "platform_summary": 45, "webpage": 50, "search_snippet": 25, "unknown": 20}
METRICS = ("views", "likes", "saves", "comments", "shares")


def folded(rows):
    """One observation after the other, as the operator's docstring says."""
    state = None
    for r in sorted(rows, key=lambda r: (r["ordinal"], r["signal_id"])):
        own = dict(r) | {"query_terms": [r["query_term"]] if r["query_term"] else [], "query_layers": [r["query_layer"]] if r["query_layer"] else [], "n": 1}
        if state is None:
            state = own
            continue
        key = lambda x: (x["detail_captured"], QUALITY[x["source_type"]], len(x["summary"]))
        first, second = (own, state) if key(own) > key(state) else (state, own)
        new = dict(first) | {"ordinal": state["ordinal"], "n": state["n"] + 1, "detail_captured": state["detail_captured"] or own["detail_captured"]}
        for f in ("title", "summary", "published_text"):
            new[f] = first[f] or second[f]
        for m in METRICS:
            new[m] = first[m] if first[m] is not None else second[m]
        for a in ("query_terms", "query_layers", "evidence_refs", "limitations"):
            new[a] = list(dict.fromkeys([*state[a], *own[a]]))
        if new["detail_captured"]:
            new["limitations"] = [x for x in new["limitations"] if x not in ("search_card_only", "Search card only", "Semantic relevance requires a separate review.")]
        rank = lambda x: RELEVANCE_RANK.get(x["semantic_relevance"], 0)
        new["semantic_relevance"] = own["semantic_relevance"] if rank(own) > rank(state) else state["semantic_relevance"]
        new["reviewed"] = state["reviewed"] or own["reviewed"]
        for f in ("evidence_role", "topic_key"):
            new[f] = (state[f] if state["reviewed"] else own[f] if own["reviewed"] else "") or state[f] or own[f]
        state = new
    return state


def observation(rng, key, i):
    pick = rng.choice
    return ("s", key, i, f"x{rng.randrange(99)}", pick(list(QUALITY)), rng.random() < 0.3, pick(["", "", f"T{i}"]), "y" * pick([0, 0, 1, 2, 3, 5, 8]), pick(["", f"P{i}"]), pick(["weak", "adjacent", "direct", "unreviewed"]), rng.random() < 0.3,
            pick(["", "support", "counter"]), pick(["", f"t{rng.randrange(4)}"]), pick(["", f"q{rng.randrange(5)}"]), pick(["", "category", "subject_bridge"]), rng.sample(["r1", "r2", "r3", "r4"], rng.randrange(4)),
            rng.sample(["search_card_only", "a", "b"], rng.randrange(3)), *[pick([None, float(rng.randrange(9))]) for _ in METRICS])


def test_merging_equals_the_fold(spark):
    rng = random.Random(11)
    rows = [observation(rng, f"k{k}", i) for k in range(400) for i in rng.sample(range(500), rng.randrange(1, 50))]
    got = {r.dedupe_key: r for r in dedup.merge_duplicates(spark.createDataFrame(rows, MERGE).repartition(7)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(dict(zip(NAMES, r, strict=True)))
    assert len(got) == len(groups)
    for k, own in groups.items():
        want = folded(own)
        for f in ("ordinal", "signal_id", "source_type", "detail_captured", "title", "summary", "published_text", "semantic_relevance", "reviewed", "evidence_role", "topic_key", "query_terms", "query_layers", "evidence_refs", "limitations", *METRICS):
            assert getattr(got[k], f) == want[f], (k, f)
        assert got[k].merged_from_count == want["n"]


def test_a_post_observed_very_often(spark):
    d = spark.range(300_000).select(
        F.lit("s").alias("snapshot_id"), F.lit("hot").alias("dedupe_key"), F.col("id").alias("ordinal"), F.concat(F.lit("x"), "id").alias("signal_id"), F.lit("search_card").alias("source_type"), F.lit(False).alias("detail_captured"),
        F.lit("").alias("title"), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")).alias("summary"), F.lit("p").alias("published_text"), F.lit("weak").alias("semantic_relevance"), F.lit(False).alias("reviewed"), F.lit("").alias("evidence_role"),
        F.lit("").alias("topic_key"), F.concat(F.lit("q"), F.col("id") % 7).alias("query_term"), F.lit("category").alias("query_layer"), F.array(F.concat(F.lit("r"), F.col("id") % 9)).alias("evidence_refs"), F.array(F.lit("a")).alias("limitations"),
        *[F.when(F.col("id") > 100, F.col("id").cast("double")).alias(m) for m in METRICS],
    )
    r = dedup.merge_duplicates(d).collect()[0]
    assert (r.signal_id, r.merged_from_count, len(r.summary), r.likes, r.query_terms) == ("x49", 300_000, 49, 101.0, [f"q{i}" for i in range(7)])
    plan = dedup.merge_duplicates(d)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_snapshots_merge_in_order(spark):
    rows = [("s", "a", 3, False, "one", ["u1", "u2"], ["f1"]), ("s", "a", 5, True, "two", ["u3", "u1"], None), ("s", "a", 4, True, "late", ["u4"], ["f0", "f1"]), ("s", "b", 1, True, "own", [], []), ("s", "b", 2, True, "no", ["z", "y", "z"], [])]
    d = spark.createDataFrame(rows, "subject string, signal_id string, ordinal int, detail_captured boolean, title string, evidence_refs array<string>, raw_artifacts array<string>").withColumn("query_layer", F.lit("l")).withColumn("query_term", F.lit("q"))
    m = {r.signal_id: r for r in dedup.merge_snapshots(d, ["title", "detail_captured"], ["evidence_refs", "raw_artifacts"]).collect()}
    assert (m["a"].title, m["a"].evidence_refs, m["a"].raw_artifacts, m["a"].detail_captured) == ("late", ["u1", "u2", "u4", "u3"], ["f1", "f0"], True)
    assert (m["b"].title, m["b"].evidence_refs, m["b"].raw_artifacts) == ("own", ["z", "y"], [])


def test_excerpts_match_a_plain_version(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "δέλτα", "東京", "x", "  ", "eee"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"s{i % 9}", "ocr" if i % 2 else "transcript", text(rng.randrange(1, 40))) for i in range(300)] + [("s1", "ocr", None), (None, "ocr", "alpha beta gamma delta"), ("s1", "ocr", "")]
    quotes = []
    for i in range(400):
        s, c, t = rng.choice(rows[:300])
        start = rng.randrange(len(t))
        q = t[start : start + rng.randrange(1, 30)]
        quotes.append((i, s if i % 3 else "s0", c, q.upper() if i % 4 == 0 else q.replace(" ", "\n ")))
    quotes += [(1000, "s1", "ocr", None), (1001, None, "ocr", "alpha beta gamma delta"), (1002, "s1", "ocr", "")]
    r = spark.createDataFrame(rows, "signal_key string, channel string, row_text string")
    e = spark.createDataFrame(quotes, "id int, signal_key string, channel string, text string")
    normal = lambda t: " ".join(t.split()).lower()
    held = {}
    for s, c, t in rows:
        if t is not None and s is not None:
            held.setdefault((s, c), []).append(normal(t))
    want = sorted(i for i, s, c, q in quotes if q is not None and s is not None and any(normal(q) == x or (len(normal(q)) >= 12 and normal(q) in x) for x in held.get((s, c), [])))
    assert sorted(x.id for x in review.verbatim(e, r, ["signal_key", "channel"]).collect()) == want


def test_excerpts_beyond_a_list_are_looked_up_by_runs(spark, monkeypatch):
    monkeypatch.setattr(review, "FEW_EXCERPTS", 2)
    test_excerpts_match_a_plain_version(spark)


def test_long_rows_are_cut_into_runs_once(spark, monkeypatch):
    """A row of 200,000 characters took time by the square of its length."""
    monkeypatch.setattr(review, "FEW_EXCERPTS", 0)
    text = " ".join(f"word{i}" for i in range(20_000))
    r = spark.createDataFrame([("g", text)], "g string, row_text string")
    e = spark.createDataFrame([("g", text[5000:5040]), ("g", "word9999 word2"), ("g", "Word19999")], "g string, text string")
    began = time.perf_counter()
    assert [x.text for x in review.verbatim(e, r, ["g"]).collect()] == [text[5000:5040]]
    assert time.perf_counter() - began < 60


def test_quotes_of_letters_without_capitals_of_their_own(spark, tmp_path):
    docs = [(2, "0123456789Straße und Weg\nx"), (4, "0123456789ΛΌΓΟΣ ΕΔΏ\nx"), (6, "0123456789λόγος εδώ πέρα\nx"), (44, "0123456789Straßen und Wege\nx")]
    spark.createDataFrame([(i, t, "de", "web", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in audits.signal_excerpts(spark, str(tmp_path)).select("signal_key").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT signal_key FROM ({audits.SQL['signal_excerpts']})").fetchall())


def test_excerpts_are_joined_by_runs(spark):
    r = spark.createDataFrame([("g", "a text that is long enough")], "g string, row_text string")
    plan = review.verbatim(r.withColumnRenamed("row_text", "text"), r, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_candidates_within_reach_are_enough(spark, k):
    rng = random.Random(k)
    rows = [(f"s{rng.randrange(12)}", f"x{i}", rng.choice(["", "a", "b", "c", "d", "e", "f", "g"]) if rng.random() < 0.7 else "a", rng.choice(["support", "counter", "neutral"]), float(rng.randrange(30))) for i in range(900)]
    d = spark.createDataFrame(rows, "snapshot_id string, signal_id string, author string, evidence_role string, score double")
    of = lambda x: sorted((r.snapshot_id, r.rank, r.signal_id) for r in x.collect())
    assert of(review.ranked_candidates(review._within_reach(d, k), k)) == of(review.ranked_candidates(d, k))


def test_candidates_are_cut_down_before_the_shuffle(spark):
    plan = review.media_candidates(views.signals(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_quotas_after_the_cut_equal_those_of_all(spark, monkeypatch):
    rng = random.Random(5)
    layers = ["category", "platform_baseline", "subject_bridge"]
    rows = [(f"s{rng.randrange(6)}", f"x{i}", rng.sample(layers, rng.randrange(1, 4)), rng.choice(["direct", "adjacent", "weak"]), rng.choice(["counter", "support", "neutral"]), rng.random() < 0.2) for i in range(600)]
    d = spark.createDataFrame(rows, "snapshot_id string, signal_key string, layers array<string>, semantic_relevance string, evidence_role string, detail_captured boolean")
    needs = spark.createDataFrame([(f"s{i}", i % 3, (i + 1) % 4, i % 2, 3 * i) for i in range(6)], "snapshot_id string, category int, platform_baseline int, subject_bridge int, total int")
    got = sorted(map(tuple, collection.detail_targets(d, needs).collect()))
    best = lambda r: (-{"direct": 3, "adjacent": 2}[r[3]], -{"counter": 2, "support": 1, "neutral": 0}[r[4]], r[1])
    want = []
    for i in range(6):
        left = sorted((r for r in rows if r[0] == f"s{i}" and not r[5] and r[3] != "weak"), key=best)
        need, taken = dict(zip(layers, (i % 3, (i + 1) % 4, i % 2), strict=True)), []
        for layer in layers:
            own = [r for r in left if layer in r[2]][: 2 * need[layer]]
            taken += [(r[0], r[1], layer) for r in own]
            left = [r for r in left if r not in own]
        taken += [(r[0], r[1], r[2][0]) for r in left[: max(0, 3 * i - len(taken))]]
        want += taken
    assert got == sorted(want)


CHUNK = "query_id bigint, seq bigint, read_status string, continuation_status string, stop_reason string, hard_stop string, keys array<string>, signals array<string>, details array<string>"


def captures(seed, queries, steps):
    rng = random.Random(seed)
    some = lambda n: [f"k{rng.randrange(12)}" for _ in range(rng.randrange(n))]
    out = []
    for q in range(queries):
        for i in range(steps):
            status = rng.choice(["success"] * 5 + ["timeout", "error"])
            stop = rng.choice(["session_expired", "session_expired", "cli_error"]) if status == "error" else rng.choice(["", "", "zero_results"])
            out.append((q, i, status, rng.choice(["available"] * 4 + ["unknown", "exhausted"]), stop, rng.choice([""] * 30 + ["captcha"]), some(4), some(2), some(2)))
    return out


def test_lost_sessions_and_hard_stops(spark):
    step = lambda q, i, status, going, stop, hard="", keys=("a",): (q, i, status, going, stop, hard, list(keys), [], [])
    rows = [step(1, 0, "error", "available", "session_expired", keys=()), step(1, 1, "success", "available", ""), step(1, 2, "error", "available", "session_expired", keys=()), step(1, 3, "success", "available", "", keys=("b",)),
            step(2, 0, "success", "available", ""), step(2, 1, "success", "available", "", "captcha", ("b",)), step(2, 2, "success", "available", "", "", ("c",)),
            step(3, 0, "success", "exhausted", "zero_results", keys=()), step(4, 0, "error", "unknown", "cli_error", keys=()), step(5, 0, "timeout", "exhausted", "", keys=()), step(5, 1, "success", "unknown", ""), step(5, 2, "success", "unknown", "")]
    got = {r.query_id: (r.stop_reason, r.outcome, r.restarts, r.observed) for r in chunks.fold_chunks(spark.createDataFrame(rows, CHUNK), 9).collect()}
    assert got == {1: ("session_recovery_failed", "completed_partial", 2, 1), 2: ("captcha", "completed_with_results", 0, 2), 3: ("zero_results", "completed_with_zero_results", 0, 0), 4: ("cli_error", "completed_partial", 0, 0),
                   5: ("continuation_unresolved", "completed_partial", 0, 1)}


def run_stream(spark, tmp_path, parts, schema, target, silence=None, wait=False):
    import time

    name = f"states_{abs(hash(str(tmp_path)))}"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = chunks.stream_chunks(stream, target, silence).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not wait:  # with timers there is always another batch
            q.processAllAvailable()
    if wait:
        end = time.time() + 60
        while time.time() < end and not spark.table(name).where("done").count():
            time.sleep(1)
    q.stop()
    last = {}
    for r in spark.table(name).collect():
        if r.query_id not in last or (r.chunks, r.done) >= (last[r.query_id].chunks, last[r.query_id].done):
            last[r.query_id] = r
    return last


def test_the_stream_ends_like_the_batch(spark, tmp_path):
    d = spark.createDataFrame(captures(8, 25, 8), CHUNK)
    last = run_stream(spark, tmp_path, [d.where("seq < 3"), d.where("seq BETWEEN 3 AND 5"), d.where("seq > 5")], d.schema, 6)
    want = {r.query_id: r for r in chunks.fold_chunks(d, 6).collect()}
    assert {q: tuple(r) for q, r in last.items()} == {q: tuple(r) for q, r in want.items()}
    assert len({r.stop_reason for r in want.values()}) >= 5


def test_a_silent_capture_ends(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, "success", "available", "", "", ["a"], [], [])], CHUNK)
    last = run_stream(spark, tmp_path, [d], d.schema, 6, silence=500, wait=True)
    assert (last[1].stop_reason, last[1].observed, last[1].chunks) == ("continuation_unresolved", 1, 1)


RUNS = "snapshot_id string, query_id string, query_term string, query_layer string, mode string, snapshot_stop string, stop_reason string, observed_result_count bigint, detail_open_count bigint"


def test_ledger_counts_and_commits(spark, tmp_path, monkeypatch):
    folder, rng = str(tmp_path / "ledger"), random.Random(2)
    runs = [(f"s{i % 5}", "" if i % 4 == 0 else str(i), f"t{i}", "category", "quick", "", "", 6, 1) for i in range(40)]
    cards = [(*r[:4], f"k{rng.randrange(30)}", rng.choice(["support", "counter"]), rng.choice(["direct", "weak"]), False, "search_card") for r in runs for _ in range(rng.randrange(6))]
    r = spark.createDataFrame(runs, RUNS)
    c = spark.createDataFrame(cards, "snapshot_id string, query_id string, query_term string, query_layer string, dedupe_key string, evidence_role string, semantic_relevance string, detail_captured boolean, source_type string")
    some = lambda d, lo, hi: d.where(F.substring("query_term", 2, 9).cast("int").between(lo, hi))
    assert ledger.append(some(r, 0, 19), some(c, 0, 19), folder, 0)
    assert not ledger.append(some(r, 0, 19), some(c, 0, 19), folder, 0)

    class Lost(Exception):
        pass

    plain = spark.createDataFrame
    with monkeypatch.context() as m:  # lost before its commit record

        def lost(rows, schema=None, *args, **named):
            if schema == "batch_id bigint":
                raise Lost
            return plain(rows, schema, *args, **named)

        m.setattr(type(spark), "createDataFrame", lambda self, *a, **b: lost(*a, **b))
        with pytest.raises(Lost):
            ledger.append(some(r, 10, 39), some(c, 10, 39), folder, 1)
    assert sum(x.query_count for x in ledger.counts(spark, folder).collect()) == 20
    assert ledger.append(some(r, 10, 39), some(c, 10, 39), folder, 1)  # half of it is known
    assert ledger.append(some(r, 0, 5), some(c, 0, 5), folder, 2)  # all of it is
    held = ledger.runs(spark, folder, r.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(x.query_term for x in held.collect()) == sorted(x[2] for x in runs)
    got = {x.snapshot_id: x for x in ledger.counts(spark, folder).collect()}
    want = {x.snapshot_id: x for x in collection.ledger_counts(r, c).collect()}
    assert set(got) == set(want)
    for s, w in want.items():
        g = got[s]
        assert (g.query_count, g.retained_sample_count, g.unique_sample_count, g.duplicate_count, g.counter_signal_count) == (w.query_count, w.observed_result_count, w.unique_sample_count, w.duplicate_count, w.counter_signal_count)
        assert g.observed_result_count == 6 * g.query_count and g.detail_open_count == g.query_count and g.discarded_result_count == g.observed_result_count - g.retained_sample_count


def test_an_append_reads_no_runs(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    one = lambda i: spark.createDataFrame([("s", None, f"t{i}", None, "quick", "", "", 3, 0), (None, "", None, None, "quick", "", "", None, None)], RUNS)
    assert ledger.append(one(0), None, folder, 0)
    for f in (tmp_path / "ledger" / "runs").rglob("*.parquet"):
        f.unlink()  # nothing that the next append needs
    assert ledger.append(one(1), None, folder, 1) and ledger.append(one(1), None, folder, 2)
    assert sorted((x.snapshot_id, x.query_count) for x in ledger.counts(spark, folder).collect()) == [("", 1), ("s", 2)]




def test_release_audit_reads_files(spark, tmp_path):
    from evidrill.operators import release

    (tmp_path / "a").mkdir()
    held = {"a/x.md": b"C:\\Users\\Bob\\x", "a/y.PY": b"AppData/Local/TEMP \xff", "b.txt": "é api_key = 'abcdefgh1'".encode(), "LICENSE": b"C:\\Users\\Bob", "z.png": b"\xff" * 50, "ok.md": b"C:\\Users\\example\\x"}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    got = {(r.path, r.rule) for r in release.audit_files(release.read_files(spark, str(tmp_path)), most_bytes=40).collect()}
    assert got == {("a/x.md", "path"), ("a/y.PY", "not_utf8"), ("b.txt", "secret"), ("z.png", "large_file")}
    assert release.audit_files(release.read_files(spark, str(tmp_path), "*.none")).count() == 0


def test_digests_tell_ledgers_apart(spark):
    from evidrill.operators import decisions

    a = spark.createDataFrame([("s", 1, "x"), ("s", 2, None), ("t", 1, "y"), ("t", 1, "y"), ("u", 1, "z")], "snapshot_id string, k int, v string")
    b = spark.createDataFrame([("s", 2, None), ("s", 1, "x"), ("t", 1, "y"), ("v", 1, "z"), ("u", 1, None)], a.schema)
    assert {r.snapshot_id for r in decisions.changed_snapshots(a, b, ["snapshot_id", "k", "v"]).collect()} == {"t", "u", "v"}
    got = {(r.snapshot_id, r.k, r.fault) for r in decisions.reconcile_changed(a, b, ["snapshot_id", "k"], ["v"]).collect()}
    assert got == {("u", 1, "changed"), ("v", 1, "added")}


def test_analyzer_spellings(spark):
    import json

    from evidrill.operators import media

    rows = [("a", json.dumps({"transcript": ["one", "", {"content": "two", "startSeconds": "1:00"}], "ocr_results": ["sign", {"text": "bÃd"}, 7], "frames": [1, {"time": 2}], "metadata": {"title": " T ", "durationSeconds": 9, "channel": "c", "upload_date": "d"}, "warnings": ["Whisper used"]})),
            ("b", json.dumps({"transcript": {"segments": [{"text": "", "content": "x", "start": 0, "end_seconds": 4}]}, "ocrResults": [], "ocr_results": [{"text": "y", "timestamp": "01:01"}], "warnings": "none"})), ("c", "[1]"), ("d", None)]
    m = {r.signal_key: r for r in media.analyzer_results(spark.createDataFrame(rows, "signal_key string, raw string")).collect()}
    a, b = m["a"], m["b"]
    assert ([s.text for s in a.segments], a.segments[1].start_seconds, [r.text for r in a.ocr_rows], a.dropped, a.keyframes) == (["one", "two"], 60.0, ["sign"], 2, 1)
    assert (a.title, a.duration_seconds, a.uploader, a.upload_date, a.provenance, a.status, a.content_format) == ("T", 9.0, "c", "d", "asr", "partial", "video")
    assert (b.segments[0].text, b.segments[0].start_seconds, b.segments[0].end_seconds, b.ocr_rows[0].timestamp_seconds, b.status, b.content_format) == ("x", 0.0, 4.0, 61.0, "complete", "unknown")
    assert m["c"].status == m["d"].status == "unavailable"


def test_cards_come_in_more_parts_as_they_grow(spark, monkeypatch):
    """All rows went to a fixed number of tasks, each of which joined, grouped and sorted its share."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, collection.query_yields(views.runs(spark, sf), views.cards(spark, sf)).collect()))
    monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
    y = collection.query_yields(views.runs(spark, sf), views.cards(spark, sf))
    assert y.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500
    assert sorted(map(tuple, y.collect())) == want


def test_ledger_needs_cards_once(spark):
    """Counts of layers, of the whole and of the contract come from one pass over the cards and one over the runs."""
    sf = "/root/testdata/sf0.001"
    plan = collection.collection_status(views.runs(spark, sf), views.cards(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3 and "collect_set" not in plan


def test_gap_tasks_read_signals_once(spark):
    status = spark.createDataFrame([("s", "met", []), ("t", "met", [])], "snapshot_id string, contract_status string, failed_checks array<string>")
    layers = spark.createDataFrame([], "snapshot_id string, mode string, query_layer string, detail_open_count bigint, direct_relevance_count bigint")
    indexed = spark.createDataFrame([("s", "1", ["a", "b"]), ("s", "2", ["a"]), ("t", "3", []), ("t", "4", None), ("u", "5", ["b"]), ("u", "6", None)], "snapshot_id string, signal_id string, missing_fields array<string>")
    g = enrich.gap_tasks(status, layers, indexed)
    assert sorted(map(tuple, g.collect())) == [("s", 1, "a", 2, "high"), ("s", 2, "b", 1, "medium"), ("u", 1, "b", 1, "medium")]
    assert g._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_union_keeps_rows_whole_up_to_the_group(spark):
    """Each element went through the shuffle for itself."""
    rows = [("k", 2, "b", ["x", "y", None], ["p"]), ("k", 1, "a", ["y"], None), ("k", 1, "a", ["z", "y"], []), ("k", 3, "c", ["x", "w", "w"], ["q", "p"]), ("l", 1, "a", ["r", "r"], None), ("m", 1, "a", None, [])]
    d = spark.createDataFrame(rows, "key string, o int, id string, u array<string>, v array<string>")
    got = dedup.ordered_union(d, ["key"], ["o", "id"], ["u", "v"])
    assert sorted(map(tuple, got.collect())) == [("k", ["y", "z", "x", None, "w"], ["p", "q"]), ("l", ["r"], [])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_signals_and_snapshots_come_in_more_parts_as_cards_grow(spark, monkeypatch):
    """Distinct signals and the yields of a snapshot went to the session's own number of tasks, whatever there was of them."""
    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = {name: rows(plan(spark, sf)) for name, plan in plans.ledger.QUERIES.items() if name in ("recovery_needs", "collection_status", "layer_deficits")}
    monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
    parts = views.card_parts(spark, sf)
    assert parts >= spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500
    assert collection.unique_signals(views.cards(spark, sf), parts).rdd.getNumPartitions() == parts
    assert all(rows(plans.ledger.QUERIES[name](spark, sf)) == w for name, w in want.items())
    plan = plans.ledger.recovery_needs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{parts}), REPARTITION_BY_NUM") >= 4  # line items twice, signals, yields (and runs)


def test_keys_with_few_rows_are_shuffled_once(spark, monkeypatch):
    """Every row was sorted, combined and shuffled four times, though few keys have rows to combine."""
    rng = random.Random(5)
    rows = [observation(rng, f"k{k}", i) for k in range(60) for i in rng.sample(range(50), rng.choice([1, 1, 2, 9]))]
    d = spark.createDataFrame(rows, MERGE).repartition(3)
    want = {k: folded([dict(zip(NAMES, r)) for r in rows if r[1] == k]) for k in {r[1] for r in rows}}
    for few in (100, 2, 0):
        monkeypatch.setattr(dedup, "FEW_ROWS", few)
        m = dedup.merge_duplicates(d)
        plan = m._jdf.queryExecution().executedPlan().toString()
        assert (few < 100) == ("Join" in plan) and (few < 100 or plan.count("Exchange hashpartitioning") == 1)
        got = {r.dedupe_key: r.asDict() for r in m.collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert all(got[k][c] == w[c] for c in ("ordinal", "signal_id", "source_type", "detail_captured", "title", "summary", "published_text", "semantic_relevance", "evidence_role", "topic_key", *METRICS)), (few, k)
            assert all(list(got[k][c]) == w[c] for c in ("query_terms", "query_layers", "evidence_refs", "limitations")) and got[k]["merged_from_count"] == w["n"], (few, k)


def test_opened_details_are_joined_once(spark):
    """Merging worked out the joins that details come from each time it read its rows."""
    s = spark.createDataFrame([observation(random.Random(i), f"k{i % 5}", i) for i in range(12)], MERGE)
    targets = s.where("ordinal < 4").select("snapshot_id", "dedupe_key", F.lit("category").alias("layer"))
    none = F.lit(None).cast("string")
    results = s.where("ordinal < 6").select(
        *[c for c in NAMES if c not in ("ordinal", "signal_id", "query_term", "query_layer", "source_type", "detail_captured", "summary")], F.col("ordinal").alias("seq"), (F.col("ordinal") != 3).alias("success"), F.lit("").alias("stop_reason"),
        F.lit("raw").alias("artifact"), none.alias("signal_id"), none.alias("query_term"), none.alias("query_layer"), none.alias("source_type"), F.lit("all of it").alias("summary"))
    merged, audits = enrich.detail_results(s, targets, results)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    got = {r.dedupe_key: r for r in merged.collect()}
    assert {k: r.merged_from_count for k, r in got.items()} == {"k0": 5, "k1": 4, "k2": 3, "k3": 2, "k4": 2} and audits.count() == 4
    assert [got[f"k{i}"].detail_captured for i in range(3)] == [True] * 3 and all(got[f"k{i}"].summary for i in range(3))
