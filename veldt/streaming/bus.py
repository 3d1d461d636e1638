"""The event bus as streams (D1 to D11): an append-only folder of JSON messages, views of it, and stateful checkpoints.

Windows, watermarks and late rows are extensions beyond the in-process bus that this replaces.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.order import latest

MESSAGE = "id string, timestamp timestamp, sender string, receiver string, type string, confidence double, payload string, checkpoint boolean, resolves string, experiment_id string"
LOG_LIMIT = 100_000


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a batch; lines that are no messages are left out."""
    return spark.read.schema(MESSAGE).json(folder).where("id is not null")


def message_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGE)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.json(folder).where("id is not null")


def publish(folder: str, *rows: dict) -> str:
    """One file of messages, complete when it appears. Missing ids are made, missing times are now."""
    import os

    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
    with open(path + ".part", "w") as f:
        for r in rows:
            r = {"id": uuid.uuid4().hex, "timestamp": pd.Timestamp.now("UTC").isoformat(), "checkpoint": False} | r
            payload = r.get("payload")
            r["payload"] = payload if isinstance(payload, (str, type(None))) else json.dumps(payload)
            f.write(json.dumps(r, default=str) + "\n")
    os.replace(path + ".part", path)
    return path


def fan_out(receivers: dict[str, Callable[[DataFrame], None]], failed: list | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that hands each receiver its messages; one that fails is noted and does not stop the others."""

    def deliver(batch: DataFrame, epoch: int) -> None:
        for name, fn in receivers.items():
            try:
                fn(batch.where((F.col("receiver") == name) | F.col("receiver").isNull()))
            except Exception as e:
                (failed if failed is not None else []).append((epoch, name, f"{type(e).__name__}: {e}"))

    return deliver


def retained(log: DataFrame, limit: int = LOG_LIMIT) -> DataFrame:
    """The newest messages up to the bound."""
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def findings(log: DataFrame, experiment: str | None = None) -> DataFrame:
    out = log.where(F.col("type") == "finding")
    return out if experiment is None else out.where(F.col("experiment_id") == experiment)


def pending(log: DataFrame, experiment: str | None = None) -> DataFrame:
    """Checkpoints that no message resolves."""
    asked = log.where(F.coalesce("checkpoint", F.lit(False)))
    asked = asked if experiment is None else asked.where(F.col("experiment_id") == experiment)
    return asked.join(log.where("resolves is not null").select(F.col("resolves").alias("id")), "id", "left_anti")


def resolution(message_id: str, decision: str, experiment: str | None = None) -> dict:
    return {"type": "resolution", "resolves": message_id, "payload": decision, "experiment_id": experiment}


def checkpoint_states(stream: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """A stateful stream: per checkpoint its state whenever it changes, asked, resolved or timed out (in processing time)."""
    keyed = stream.withColumn("key", F.coalesce(F.when(F.coalesce("checkpoint", F.lit(False)), F.col("id")), F.col("resolves"))).where("key is not null")
    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "state": ["timed_out"], "decision": [None]})
            return
        asked, decision = state.get if state.exists else (False, None)
        for pdf in parts:
            asked = asked or bool(pdf["checkpoint"].fillna(False).any())
            said = pdf.loc[pdf["resolves"].notna(), "payload"]
            decision = said.iloc[-1] if len(said) else decision
        if asked and decision is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"id": [key[0]], "state": ["resolved"], "decision": [decision]})
        else:
            state.update((asked, decision))
            state.setTimeoutDuration(millis)
            if asked:
                yield pd.DataFrame({"id": [key[0]], "state": ["asked"], "decision": [None]})

    return keyed.select("key", "checkpoint", "resolves", "payload").groupBy("key").applyInPandasWithState(step, "id string, state string, decision string", "asked boolean, decision string", "append", "ProcessingTimeTimeout")


def wait_for(spark: SparkSession, folder: str, message_id: str, timeout: float, poll: float = 0.2) -> str | None:
    """The decision on a checkpoint, or null after the timeout."""
    end = time.time() + timeout
    while True:
        row = messages(spark, folder).where(F.col("resolves") == message_id).orderBy("timestamp", "id").first()
        if row or time.time() >= end:
            return row["payload"] if row else None
        time.sleep(poll)


def replay(spark: SparkSession, folder: str, experiment: str | None = None) -> DataFrame:
    """The log in the order of its times, an id once (the earliest)."""
    log = merged(messages(spark, folder))
    return (log if experiment is None else log.where(F.col("experiment_id") == experiment)).orderBy("timestamp", "id")


def merged(*logs: DataFrame) -> DataFrame:
    """Several logs as one: of rows with the same id the first by time."""
    from functools import reduce

    from veldt.functions.order import first_row

    return first_row(reduce(DataFrame.unionByName, logs), ["id"], [F.col("timestamp").asc_nulls_last(), F.col("sender")])


def deduplicated(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["id"])


def bind(log: DataFrame, experiment: str, senders: list[str]) -> DataFrame:
    """Early messages without an experiment, of senders known to work for it, bound to it."""
    return log.withColumn("experiment_id", F.when(F.col("experiment_id").isNull() & F.col("sender").isin(senders), experiment).otherwise(F.col("experiment_id")))


def snapshot(log: DataFrame, now, stale_after: float = 120) -> tuple[DataFrame, DataFrame]:
    """Per experiment: phase, messages, findings, open checkpoints; and per sender the last sign of life and whether it is stale."""
    open_ = pending(log).groupBy("experiment_id").agg(F.count("*").alias("open_checkpoints"))
    view = log.groupBy("experiment_id").agg(F.max_by(F.when(F.col("type") == "progress", F.col("payload")), F.when(F.col("type") == "progress", F.struct("timestamp", "id"))).alias("phase"), F.count("*").alias("messages"), F.count_if(F.col("type") == "finding").alias("findings")).join(open_, "experiment_id", "left").fillna({"open_checkpoints": 0})
    beats = latest(log.select("sender", "timestamp", "type"), ["sender"], "timestamp", F.lit(now).cast("timestamp"), stale_after)
    return view, beats


def drain(spark: SparkSession, folder: str, policy: Callable[[dict], str | None], experiment: str | None = None, max_rounds: int = 20) -> int:
    """Answers open checkpoints by a policy until none is left that it answers; returns how many were."""
    done = 0
    for _ in range(max_rounds):
        answers = [(r["id"], a) for r in pending(messages(spark, folder), experiment).orderBy("timestamp", "id").limit(1000).collect() if (a := policy(r.asDict())) is not None]
        if not answers:
            break
        publish(folder, *(resolution(i, a, experiment) for i, a in answers))
        done += len(answers)
    return done


def run_until(query, done: Callable[[], bool], timeout: float, poll: float = 0.5) -> bool:
    """Waits for a stream until done or the timeout, then stops it."""
    end = time.time() + timeout
    try:
        while time.time() < end:
            if done():
                return True
            query.awaitTermination(poll)
        return done()
    finally:
        query.stop()


# extensions: event-time windows over any stream or table


def tumbling(events: DataFrame, at: str, width: str, keys=(), value: str | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts (and sums) by time window; on a stream rows later than late are dropped."""
    events = events.withWatermark(at, late) if late else events
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.groupBy(w, *keys).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if value else []))


def sessions(events: DataFrame, at: str, gap: str, keys=(), late: str | None = None) -> DataFrame:
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def split_late(events: DataFrame, at: str, seen_at: str, late: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that arrived later than the bound."""
    ok = F.col(seen_at) <= F.col(at) + F.expr(f"interval {late}")
    return events.where(ok), events.where(~ok)
