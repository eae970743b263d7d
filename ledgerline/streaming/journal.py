"""Streams: usage over an unbounded log, and journal events that checkpoints contradict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_usage(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour", time: str = "ts", key: str = "run_id", value: str = "value") -> DataFrame:
    """(window_start, key, n, total) of events in tumbling windows; events later than delay are left out. Works on streams
    and on tables."""
    late = events.withWatermark(time, delay) if events.isStreaming else events
    return late.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def stream_journal_conflicts(journal: DataFrame, checkpoint: DataFrame, delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Succeeded journal events (run_id, step_code, step_status, ts) without a succeeded checkpoint (run_id, step_code,
    checkpoint_status, ts) up to `within` after them. On streams a row comes out when no checkpoint can come any more:
    both sides have watermarks and the join a time range, so the state is bounded."""
    j = journal.where("step_status = 'Succeeded'").select("run_id", "step_code", "step_status", "ts")
    c = checkpoint.where("checkpoint_status = 'Succeeded'").select(F.col("run_id").alias("c_run"), F.col("step_code").alias("c_step"), F.col("ts").alias("c_ts"))
    if journal.isStreaming:
        j, c = j.withWatermark("ts", delay), c.withWatermark("c_ts", delay)
    on = (F.col("run_id") == F.col("c_run")) & (F.col("step_code") == F.col("c_step")) & (F.col("c_ts") >= F.col("ts")) & (F.col("c_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return j.join(c, on, "left_outer").where("c_ts IS NULL").select("run_id", "step_code", "step_status", "ts")
