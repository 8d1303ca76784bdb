"""Capture chunks as events: the state of each query, in one batch or as a stream.

A chunk: query_id, seq, read_status (success, timeout, error), keys (result keys), continuation_status (available,
exhausted, unknown), and, where it has them, signals and details (keys of kept signals and of opened details), stop_reason
and hard_stop. A query ends locally after two timeouts, two unknown continuations below its target, two empty
continuations in a row, a second lost session, or an error of the reader; it is blocked by a hard stop; it ends well at
its target or when results are exhausted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Names of stops.
HARD_STOPS = ("captcha", "rate_limit", "login_expired", "permission_prompt", "abnormal_redirect")
LOCAL_STOPS = ("continuation_unresolved", "repeated_timeout", "cli_error", "session_recovery_failed")
RECOVERY_STOPS = ("session_expired",)
ZERO_STOPS = ("zero_results", "no_results", "no_results_returned")

_SETS = ("keys", "signals", "details")
_COUNTS = ("chunks", "timeouts", "unknowns", "empties", "restarts")
OUTPUT = "query_id bigint, chunks bigint, observed bigint, signals bigint, details bigint, timeouts bigint, unknowns bigint, restarts bigint, stop_reason string, outcome string, done boolean"


def _whole(chunks: DataFrame) -> DataFrame:
    """All columns of a chunk; those that the table lacks, and nulls, are blank."""
    lists = {c: F.coalesce(c, F.array()).cast("array<string>") if c in chunks.columns else F.array().cast("array<string>") for c in _SETS}
    texts = {c: F.coalesce(c, F.lit("")) if c in chunks.columns else F.lit("") for c in ("read_status", "continuation_status", "stop_reason", "hard_stop")}
    return chunks.withColumns(texts | lists).select("query_id", F.col("seq").cast("bigint").alias("seq"), *texts, *lists)


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """Chunks that can't be recorded, a row for each broken rule: query_id, seq, fault. Errors name what stopped them;
    signals come with result keys; nothing found is said to be the end, or follows earlier results."""
    c = _whole(chunks)
    c = c.withColumn("first", F.min(F.when(F.size("keys") > 0, F.col("seq"))).over(Window.partitionBy("query_id")))
    nothing = (F.size("keys") == 0) & (F.size("signals") == 0)
    hard, success = F.col("hard_stop") != "", F.col("read_status") == "success"
    later = (F.col("continuation_status") == "available") & F.coalesce(F.col("first") < F.col("seq"), F.lit(False))
    ended = (F.col("continuation_status") == "exhausted") & (hard | F.col("stop_reason").isin(*ZERO_STOPS))
    rules = {
        "read_status": ~F.col("read_status").isin("success", "timeout", "error"), "continuation_status": ~F.col("continuation_status").isin("available", "exhausted", "unknown"),
        "hard_stop": hard & ~F.col("hard_stop").isin(*HARD_STOPS), "error": (F.col("read_status") == "error") & ~hard & ~F.col("stop_reason").isin(*LOCAL_STOPS, *RECOVERY_STOPS),
        "signals": (F.size("keys") == 0) & (F.size("signals") > 0), "zero_result": nothing & success & ~later & ~ended, "details": nothing & (F.size("details") > 0),
    }
    return c.select("query_id", "seq", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))).alias("fault"))


def _outcome(reason: Column, observed: Column) -> Column:
    return F.when(reason == "", "").when(reason.isin(*LOCAL_STOPS), "completed_partial").when(observed == 0, "completed_with_zero_results").otherwise("completed_with_results")


def fold_chunks(chunks: DataFrame, target: int) -> DataFrame:
    """The state of each query after its chunks, by seq (ties by what they hold); chunks after the end change nothing."""
    step = F.struct("seq", "read_status", "continuation_status", "stop_reason", "hard_stop", *_SETS)
    kind = "struct<" + ",".join([f"{c}:bigint" for c in _COUNTS] + [f"{c}:array<string>" for c in _SETS] + ["stop_reason:string"]) + ">"
    start = F.struct(*[F.lit(0).alias(c) for c in _COUNTS], *[F.array().cast("array<string>").alias(c) for c in _SETS], F.lit("").alias("stop_reason"))

    def advance(s: Column, c: Column) -> Column:
        timeout, success, hard = c["read_status"] == "timeout", c["read_status"] == "success", c["hard_stop"] != ""
        going = F.when(timeout, "unknown").otherwise(c["continuation_status"])
        own = F.when(timeout, "").otherwise(c["stop_reason"])
        sets = {k: F.array_union(s[k], c[k]) for k in _SETS}
        keys = sets["keys"]
        empty = (F.size(c["keys"]) == 0) & (F.size(c["signals"]) == 0) & success & (going == "available") & (F.size(s["keys"]) > 0)
        restart = (c["read_status"] == "error") & own.isin(*RECOVERY_STOPS) & ~hard
        unknown = success & (F.size(keys) < target) & (going == "unknown") & ~hard
        n = {"chunks": s["chunks"] + 1, "timeouts": s["timeouts"] + timeout.cast("bigint"), "unknowns": s["unknowns"] + unknown.cast("bigint"),
             "empties": F.when(F.size(c["keys"]) > 0, F.lit(0)).otherwise(s["empties"] + empty.cast("bigint")), "restarts": s["restarts"] + restart.cast("bigint")}
        local = (
            F.when(timeout & (n["timeouts"] >= 2), "repeated_timeout").when((unknown & (n["unknowns"] >= 2)) | (empty & (n["empties"] >= 2)), "continuation_unresolved")
            .when(restart & (n["restarts"] >= 2), "session_recovery_failed").when(own.isin(*LOCAL_STOPS), own).otherwise("")
        )
        ended = F.when(own.isin(*ZERO_STOPS), own).otherwise("results_exhausted")
        reason = F.when(hard, c["hard_stop"]).when(local != "", local).when(F.size(keys) >= target, "query_target_met").when(going == "exhausted", ended).otherwise("")
        after = F.struct(*[v.cast("bigint").alias(k) for k, v in n.items()], *[v.alias(k) for k, v in sets.items()], reason.alias("stop_reason"))
        names = [*_COUNTS, *_SETS, "stop_reason"]
        after = F.struct(*[after[k].alias(k) for k in names])
        return F.when(s["stop_reason"] != "", s).otherwise(after.cast(kind)).cast(kind)

    g = _whole(chunks).groupBy("query_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    s = g.select("query_id", F.aggregate("steps", start.cast(kind), advance).alias("s"))
    size = lambda c: F.size(f"s.{c}").cast("bigint")
    return s.select(
        "query_id", "s.chunks", size("keys").alias("observed"), size("signals").alias("signals"), size("details").alias("details"), "s.timeouts", "s.unknowns", "s.restarts", "s.stop_reason",
        _outcome(F.col("s.stop_reason"), size("keys")).alias("outcome"), (F.col("s.stop_reason") != "").alias("done"),
    )


class Capture(StatefulProcessor):
    """One query's state in a stream: counters and the stop as a value, and a map for each set of keys, of which only the
    keys of a chunk are looked up. A query that stays silent for `silence` milliseconds ends unresolved."""

    def __init__(self, target: int, silence: int | None):
        self.target, self.silence = target, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", ", ".join(f"{c} bigint" for c in (*_COUNTS, "n_keys", "n_signals", "n_details")) + ", stop_reason string")
        self.sets = {c: handle.getMapState(c, "k string", "place bigint") for c in _SETS}

    def _state(self) -> tuple[dict[str, int], str]:
        held = self.value.get() if self.value.exists() else None
        names = (*_COUNTS, "n_keys", "n_signals", "n_details")
        return dict(zip(names, held[:-1] if held else (0,) * len(names), strict=True)), held[-1] if held else ""

    def _advance(self, n: dict[str, int], c) -> str:
        timeout, success, hard = c.read_status == "timeout", c.read_status == "success", c.hard_stop
        going, own = ("unknown", "") if timeout else (c.continuation_status, c.stop_reason)
        new, had = list(c.keys), n["n_keys"]
        for name in _SETS:
            for k in dict.fromkeys(getattr(c, name)):
                if not self.sets[name].containsKey((k,)):
                    self.sets[name].updateValue((k,), (n[f"n_{name}"],))
                    n[f"n_{name}"] += 1
        empty = not new and not len(c.signals) and success and going == "available" and had > 0
        restart = c.read_status == "error" and own in RECOVERY_STOPS and not hard
        unknown = success and n["n_keys"] < self.target and going == "unknown" and not hard
        n["chunks"] += 1
        n["timeouts"] += timeout
        n["unknowns"] += unknown
        n["empties"] = 0 if new else n["empties"] + empty
        n["restarts"] += restart
        if hard:
            return hard
        if timeout and n["timeouts"] >= 2:
            return "repeated_timeout"
        if (unknown and n["unknowns"] >= 2) or (empty and n["empties"] >= 2):
            return "continuation_unresolved"
        if restart and n["restarts"] >= 2:
            return "session_recovery_failed"
        if own in LOCAL_STOPS:
            return own
        if n["n_keys"] >= self.target:
            return "query_target_met"
        return (own if own in ZERO_STOPS else "results_exhausted") if going == "exhausted" else ""

    def _row(self, key: tuple, n: dict[str, int], reason: str) -> pd.DataFrame:
        outcome = "" if not reason else "completed_partial" if reason in LOCAL_STOPS else "completed_with_results" if n["n_keys"] else "completed_with_zero_results"
        row = (key[0], n["chunks"], n["n_keys"], n["n_signals"], n["n_details"], n["timeouts"], n["unknowns"], n["restarts"], reason, outcome, bool(reason))
        return pd.DataFrame([row], columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def _keep(self, n: dict[str, int], reason: str, now: int | None) -> None:
        self.value.update((*n.values(), reason))
        if self.silence is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not reason:
            self.handle.registerTimer(now + self.silence)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, reason = self._state()
        order = lambda c: (c.seq, c.read_status, c.continuation_status, c.stop_reason, c.hard_stop, *(tuple(getattr(c, s)) for s in _SETS))
        for c in sorted(pd.concat(list(rows)).itertuples(), key=order):
            if reason:
                break
            reason = self._advance(n, c)
        self._keep(n, reason, timerValues.getCurrentProcessingTimeInMs() if self.silence is not None else None)
        yield self._row(key, n, reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, reason = self._state()
        if not reason:
            reason = "continuation_unresolved"
            self.value.update((*n.values(), reason))
        yield self._row(key, n, reason)

    def close(self) -> None:
        pass


#: What keeps the state of `stream_chunks`.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_chunks(chunks: DataFrame, target: int, silence: int | None = None) -> DataFrame:
    """The same over a stream: the state of every query that got chunks, after each of them, or fell silent. Sets the
    session's state store, which has to be RocksDB."""
    chunks.sparkSession.conf.set(*STATE_STORE)
    return _whole(chunks).groupBy("query_id").transformWithStateInPandas(
        statefulProcessor=Capture(target, silence), outputStructType=OUTPUT, outputMode="Update", timeMode="None" if silence is None else "ProcessingTime"
    )
