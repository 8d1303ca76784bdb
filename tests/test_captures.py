"""Captures are read once; trimming by letters is trimming by the pattern."""

import pytest
from pyspark.sql import functions as F

from evidrill.functions import addresses as A
from evidrill.functions import scalars as S
from evidrill.operators import decisions
from evidrill.sources import captures, social, staging


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("of", [social.account_signals, social.hashtag_signals, social.post_search_signals])
def test_a_capture_is_parsed_once(spark, monkeypatch, of):
    made = []

    def kept(df, name):
        made.append(plan(df))
        return staging.staged(df, name)

    monkeypatch.setattr(social, "staged", kept)
    raw = '{"username":"ann","hashtag":"t","stop_reason":"","checks":{},"result_passes":[],"result_cards":[],"posts":[]}'
    d = spark.createDataFrame([(1, "ann", "t", "t", "category", 5, 5, raw)], "capture_id bigint, username string, hashtag string, query_term string, query_layer string, max_posts int, max_detail_posts int, raw string")
    made.append(plan(of(d)))
    assert sum(p.count("from_json(") for p in made) == 1


def test_text_is_trimmed_of_all_white_space(spark):
    white = [chr(i) for i in range(1, 0x3100) if chr(i) in "\t\n\x0b\f\r \xa0     　" or 0x2000 <= i <= 0x200A]
    rows = [(c + c + "a " + c + "b" + c,) for c in map(chr, range(1, 0x3100)) if c != "\x85"] + [("".join(white),), ("",), (None,), (" \n　 x \n\t",)]
    d = spark.createDataFrame(rows, "t string")
    by_pattern = F.coalesce(F.regexp_replace("t", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))
    assert d.where(S.text(F.col("t")) != by_pattern).count() == 0


def test_addresses_of_posts(spark):
    rows = [(" https://WWW.instagram.com/Ann.b/P/Ab_-9/?x=1 ",), ("https://instagram.com/reel/z9",), ("https://instagram.com/tv/z9",), ("",), (None,)]
    d = spark.createDataFrame(rows, "u string").select(A.instagram_post(F.col("u")).alias("p"), A.instagram_post(F.col("u"), with_profile=True).alias("q"))
    got = [(tuple(r.p) if r.p else None, r.q.url if r.q else None) for r in d.collect()]
    assert got == [
        (("p", "Ab_-9", "Ann.b", "https://www.instagram.com/p/Ab_-9/"), "https://www.instagram.com/Ann.b/p/Ab_-9/"), (("reel", "z9", "", "https://www.instagram.com/reel/z9/"), "https://www.instagram.com/reel/z9/"),
        (None, None), (None, None), (None, None),
    ]


def test_levels_of_an_envelope_are_written(spark):
    raw = '{"data":{"posts":[{"id":"1","title":"a","subreddit":"s"},{"items":{"content":[{"id":"2","title":"b","permalink":"/p"},null,7]}}]},"results":[{"id":"3","title":"c","subreddit":"s"},{"id":"4"}]}'
    d = spark.createDataFrame([(1, "t", "c", raw), (2, "t", "c", "no json"), (3, "t", "c", "{}"), (4, "t", "c", None)], "capture_id bigint, query_term string, query_layer string, raw string")
    e = captures.envelopes(d)
    assert "parse_json" not in plan(e)
    got = e.select("capture_id", F.from_json("raw", "array<struct<id:string>>").alias("r")).collect()
    assert [(r.capture_id, [x.id for x in r.r]) for r in got] == [(1, ["3", "1", "2"])]


def test_ledgers_are_read_once_to_be_compared(spark, monkeypatch):
    made = []

    def kept(df, name):
        made.append(plan(df))
        return staging.staged(df, name)

    monkeypatch.setattr(decisions, "staged", kept, raising=False)
    k = F.col("id")
    ledger = lambda low, seen: spark.range(low, 10).select(
        (k % 2).alias("snapshot_id"), k.alias("signal_key"), k.cast("string").alias("content_id"), seen.alias("detail_captured"), F.lit("counter").alias("evidence_role"), F.lit("weak").alias("semantic_relevance"),
        F.lit("").alias("topic_key"), F.lit("read").alias("review"))
    raw, reviewed = ledger(3, k > 8), ledger(2, k > 7)
    stored = spark.createDataFrame([(0, 0, 3), (1, 2, 4)], "snapshot_id bigint, details bigint, counters bigint")
    report = spark.createDataFrame([(0, 1, 4, "met", "timeout"), (1, 1, 4, "partial", "")], "snapshot_id bigint, details bigint, counters bigint, contract_status string, stop_reason string")
    audits = spark.createDataFrame([(0, True, ["7"], 0)], "snapshot_id bigint, success boolean, content_ids array<string>, details bigint")
    out = decisions.ledger_faults(raw, stored, reviewed, report, audits)
    made.append(plan(out))
    assert sorted(map(tuple, out.collect())) == [(0, "stop_reason"), (0, "unaudited_detail"), (1, "raw_details")]
    assert sum(p.count("Range (3, 10") for p in made) == 1 and sum(p.count("Range (2, 10") for p in made) == 1
