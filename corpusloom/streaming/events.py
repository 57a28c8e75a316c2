"""Event streams: windows with watermarks, run progress, replay, spans, fan-out of micro-batches.

Each function takes a batch or a streaming frame with an event time ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import ratio


def late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay else events


def tumbling(events: DataFrame, size: str, key: str, value: str, delay: str | None = None) -> DataFrame:
    out = late(events, delay).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("events"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "events", "total")


def sliding(events: DataFrame, size: str, step: str, key: str, delay: str | None = None) -> DataFrame:
    out = late(events, delay).groupBy(F.window("ts", size, step).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), key, "events")


def sessions(events: DataFrame, gap: str, key: str, delay: str | None = None) -> DataFrame:
    out = late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def progress(events: DataFrame, total: int | None = None) -> DataFrame:
    """Per run: counters, the last value of each field and a forecast, from (run_id, seq, event_type, question_id, elapsed_seconds, status).

    A pure aggregate, so a stream keeps one small state for each run.
    """
    done, failed = F.count_if(F.expr("event_type = 'question_completed'")), F.count_if(F.expr("event_type = 'question_failed'"))
    average = F.avg(F.when(F.col("event_type") == "question_completed", F.col("elapsed_seconds")))
    out = events.groupBy("run_id").agg(
        F.count("*").alias("events"), done.alias("completed"), failed.alias("failed"),
        F.max_by("event_type", "seq").alias("last_event"), F.max("seq").alias("last_seq"), F.round(F.coalesce(average, F.lit(0.0)), 6).alias("mean_seconds"),
    )
    if total is None:
        return out
    left = F.greatest(F.lit(total) - F.col("completed") - F.col("failed"), F.lit(0))
    return out.withColumn("eta_seconds", F.round(left * F.col("mean_seconds"), 6)).withColumn("per_hour", ratio(F.lit(3600.0), F.col("mean_seconds")))


def state_since_reset(events: DataFrame, reset: str = "run_started", keep: int = 250) -> DataFrame:
    """Batch snapshot per run: what counts since the last reset event, the last status, and how many of at most ``keep`` events remain."""
    starts = events.filter(F.col("event_type") == reset).groupBy("run_id").agg(F.max("seq").alias("_from"))
    live = events.join(starts, "run_id", "left").filter(F.col("seq") >= F.coalesce("_from", F.lit(-1)))
    return live.groupBy("run_id").agg(
        F.count("*").alias("since_reset"), F.least(F.count("*"), F.lit(keep)).cast("long").alias("held"), F.max_by("event_type", "seq").alias("last_event"), F.max("seq").alias("last_seq")
    )


def replay(events: DataFrame, after: int, limit: int = 1000) -> DataFrame:
    """Events with a sequence number above ``after``, the last ``limit`` of them."""
    return events.filter(F.col("seq") > after).orderBy(F.desc("seq")).limit(limit)


def spans(events: DataFrame, started: str, completed: str, key: list[str]) -> DataFrame:
    """Pairs each completion with the last start before it of the same key: (key, started_at, completed_at, seconds)."""
    w = W.partitionBy(*key).orderBy("ts", "seq")
    begin = F.last(F.when(F.col("event_type") == started, F.col("ts")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = events.withColumn("started_at", begin).filter((F.col("event_type") == completed) & F.col("started_at").isNotNull())
    return out.select(*key, "started_at", F.col("ts").alias("completed_at"), F.round(F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("ts")) / 1e6, 3).alias("seconds"))


def write_each(stream: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Fans each micro-batch out to the handlers; one that raises doesn't keep the others from it, and the batch fails afterwards."""

    def all_of(batch: DataFrame, number: int) -> None:
        errors = []
        batch.persist()
        try:
            for handle in handlers:
                try:
                    handle(batch, number)
                except Exception as e:  # any handler's error: reported below
                    errors.append(e)
        finally:
            batch.unpersist()
        if errors:
            raise ExceptionGroup("event handlers failed", errors)

    return stream.writeStream.foreachBatch(all_of).option("checkpointLocation", checkpoint)
