"""Media evidence: analyzer output, its place in a signal, and what reviewed excerpts say about a topic.

Media text never adds to a sample's volume; unreviewed text is never shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import MOJIBAKE
from .dedup import ordered_union
from .review import first_texts

MAX_SEGMENTS, MAX_OCR, MAX_FRAMES = 200, 80, 8
VIDEO_PLATFORMS = ("tiktok", "instagram", "youtube", "x")


def is_video(platform: Column, content_format: Column, url: Column) -> Column:
    u = F.lower(url)
    by_url = u.contains("/video/") | u.contains("youtu.be/") | u.contains("youtube.com/watch")
    return (url != "") & (F.lower(platform).isin(*VIDEO_PLATFORMS) | F.lower(content_format).isin("video", "short_video", "reel") | by_url)


def _spoilt(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, MOJIBAKE)), lambda m: text.contains(m))


def _text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a text or a number; '' if none does."""
    found = [F.nullif(S.text(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths]
    return F.coalesce(*found, F.lit(""))


def _list(v: Column, *paths: str) -> Column:
    """The first of the paths that is a list with anything in it."""
    found = [F.try_variant_get(v, p, "array<variant>") for p in paths]
    return F.coalesce(*[F.when(F.size(f) > 0, f) for f in found], F.array().cast("array<variant>"))


def _said(x: Column, *names: str) -> Column:
    """A row's text: that of an object, or a plain string."""
    return F.when(F.schema_of_variant(x) == "STRING", S.text(F.try_variant_get(x, "$", "string"))).otherwise(_text(x, *names))


# Spellings of times, the first of which counts.
_START, _END, _AT = ("$.start", "$.startSeconds", "$.start_seconds", "$.time"), ("$.end", "$.endSeconds", "$.end_seconds", "$.endTime"), ("$.time", "$.timestamp", "$.timestampSeconds", "$.timestamp_seconds")


def analyzer_results(raw: DataFrame) -> DataFrame:
    """raw: signal_key, raw (JSON in any of the analyzer's spellings; segments and rows may be plain strings). Bounded
    transcript and OCR rows (spoilt ones dropped and counted), key frames, metadata, provenance, format and status. Frames
    alone prove that a stream was opened, not that it was understood. What isn't JSON is unavailable."""
    v = F.col("v")
    d = raw.select("signal_key", F.try_parse_json("raw").alias("v"))
    segment = lambda x: F.struct(S.clock_seconds(_text(x, *_START)).alias("start_seconds"), S.clock_seconds(_text(x, *_END)).alias("end_seconds"), F.substring(_said(x, "$.text", "$.content"), 1, 2000).alias("text"))
    row = lambda x: F.struct(S.clock_seconds(_text(x, *_AT)).alias("timestamp_seconds"), F.substring(_said(x, "$.text"), 1, 1000).alias("text"), S.measure(_text(x, "$.confidence").try_cast("double")).alias("confidence"))
    held = lambda rows, make, n: F.filter(F.transform(F.slice(rows, 1, n), make), lambda x: x["text"] != "")
    d = d.withColumns({"spoken": _list(v, "$.transcript.segments", "$.transcript"), "shown": _list(v, "$.ocrResults", "$.ocr_results"), "frames": _list(v, "$.frames")})
    d = d.withColumns({
        "segments": held(F.col("spoken"), segment, MAX_SEGMENTS), "ocr_rows": F.filter(held(F.col("shown"), row, MAX_OCR), lambda x: ~_spoilt(x["text"])),
        "keyframes": F.size(F.filter(F.slice("frames", 1, MAX_FRAMES), lambda x: F.schema_of_variant(x).startswith("OBJECT"))),
        "warnings": F.filter(F.transform(_list(v, "$.warnings"), lambda x: S.text(F.try_variant_get(x, "$", "string"))), lambda x: x != ""),
    })
    d = d.withColumn("dropped", F.greatest(F.lit(0), F.size("shown") - F.size("ocr_rows")))
    named = F.replace(F.lower(_text(v, "$.transcript.source")), F.lit(" "), F.lit("_"))
    warned = lambda words: F.exists("warnings", lambda w: F.lower(w).contains(words))
    usable = (F.size("segments") > 0) | (F.size("ocr_rows") > 0)
    doubt = (F.size("warnings") > 0) | (F.col("dropped") > 0)
    return d.select(
        "signal_key", "segments", "ocr_rows", "keyframes", "dropped", "warnings",
        F.when(named.isin("native_subtitle", "asr"), named).when((F.size("segments") > 0) & warned("whisper"), "asr").otherwise("unknown").alias("provenance"),
        F.when(~usable, "unavailable").when(doubt, "partial").otherwise("complete").alias("status"), _text(v, "$.transcript.language").alias("language"),
        F.when(F.col("keyframes") > 0, "video").when(warned("does not contain any stream"), "audio_or_slideshow").otherwise("unknown").alias("content_format"),
        F.substring(_text(v, "$.metadata.title"), 1, 500).alias("title"), S.measure(_text(v, "$.metadata.duration", "$.metadata.durationSeconds").try_cast("double")).alias("duration_seconds"),
        F.substring(_text(v, "$.metadata.uploader", "$.metadata.channel"), 1, 300).alias("uploader"), F.substring(_text(v, "$.metadata.uploadDate", "$.metadata.upload_date"), 1, 100).alias("upload_date"),
    )


def promote(signals: DataFrame, results: DataFrame) -> DataFrame:
    """Signals with usable media count as read, search cards among them as posts; what they were is kept for the
    review, which may take it back."""
    r = results.where("status <> 'unavailable'").select("signal_key", F.col("status").alias("media_status"))
    j = signals.join(r, "signal_key", "left")
    seen = F.col("media_status").isNotNull()
    return j.withColumns({
        "previous_source_type": F.when(seen, F.col("source_type")), "previous_detail_captured": F.when(seen, F.col("detail_captured")),
        "detail_captured": seen | F.col("detail_captured"),
        "source_type": F.when(seen & (F.col("source_type") == "search_card"), "direct_post").otherwise(F.col("source_type")),
    })


def apply_review(promoted: DataFrame, reviews: DataFrame) -> DataFrame:
    """reviews: signal_key, relevant_excerpts. A review without a relevant excerpt restores what the signal was."""
    j = promoted.join(reviews, "signal_key", "left")
    demote = (F.col("relevant_excerpts") == 0) & F.col("previous_source_type").isNotNull()
    back = F.coalesce(demote, F.lit(False))
    return j.withColumns({
        "source_type": F.when(back, F.col("previous_source_type")).otherwise(F.col("source_type")),
        "detail_captured": F.when(back, F.col("previous_detail_captured")).otherwise(F.col("detail_captured")),
        "media_reviewed": F.col("relevant_excerpts").isNotNull(),
    })


def topic_media(excerpts: DataFrame, keep: int = 4, summaries: int = 3) -> DataFrame:
    """excerpts: snapshot_id, topic, ordinal, channel, text, relevance, url and, where reviews have them, summary. Relevant
    excerpts of a topic by channel, the first few texts, the first few different summaries and the addresses, each once in
    the order in which they come."""
    key = ["snapshot_id", "topic"]
    e = excerpts.where(F.col("relevance").isin("direct", "adjacent") & (F.trim("text") != ""))
    channels = e.groupBy(*key, "channel").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "n")))).alias("channel_counts")
    )
    g = e.groupBy(*key).agg(F.count_distinct("url").alias("reviewed_videos"), F.count(F.lit(1)).alias("excerpt_count"))
    first = e.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal", "text"))).where(F.col("_n") <= keep)
    first = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]).alias("excerpts"))
    refs = ordered_union(e.select(*key, "ordinal", F.array("url").alias("refs")), key, ["ordinal"], ["refs"])
    out = g.join(channels, key).join(first, key).join(refs, key)
    if "summary" in excerpts.columns:
        out = out.join(first_texts(e, key, "ordinal", "summary", summaries, "summaries"), key, "left").withColumn("summaries", F.coalesce("summaries", F.array().cast("array<string>")))
    return out
