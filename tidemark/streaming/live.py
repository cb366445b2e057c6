"""Streaming twins: deliveries that arrive in micro-batches, and phases that are published as sessions come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Hysteresis


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], known: str = "ingested_at", delay: str = "30 days", revision: str = "revision_id"):
    """Appends a stream of deliveries, repeated rows within the watermark dropped; runs what is there and stops.

    `keys` say what a repeat is. They must hold the revision where the stream has one, or a late revision would pass for a repeat."""
    if revision in stream.columns and revision not in keys:
        raise ValueError(f"{revision} must be among the keys {keys}")
    rows = stream.withColumn("__event", F.col(known).cast("timestamp")).withWatermark("__event", delay)
    rows = rows.dropDuplicatesWithinWatermark([*keys]).drop("__event")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Event-time windows with a watermark: rows, and the value's sum and extremes, per window and kind."""
    rows = stream.withColumn("__event", F.col(time).cast("timestamp")).withWatermark("__event", delay)
    out = rows.groupBy(F.window("__event", size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("begins"), by, "n", "total", "low", "high")


_STATE = "phase string, idx bigint, calm int, seen int, target string"


def _publish(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    machine = Hysteresis()
    if state.exists:
        machine.phase, machine.idx, machine.calm, machine.seen, machine.target = state.get
    rows = pd.concat(list(frames)).sort_values("idx")  # one series' rows of one micro-batch
    out = []
    for r in rows.itertuples(index=False):
        if machine.idx is not None and r.idx <= machine.idx:
            continue  # a session that was published stays as it is
        acute = None if pd.isna(r.hard_acute) else bool(r.hard_acute)
        shock = None if pd.isna(r.shock) else float(r.shock)
        out.append((key[0], int(r.idx), r.raw_phase, machine.push((r.raw_phase, bool(r.counts), acute, shock, int(r.idx)))))
    if machine.idx is not None:
        state.update((machine.phase, machine.idx, machine.calm, machine.seen, machine.target))
    yield pd.DataFrame(out, columns=["series_id", "idx", "raw_phase", "phase"])


def published_phases(stream: DataFrame) -> DataFrame:
    """Phase hysteresis over a stream of (series_id, idx, raw_phase, counts, hard_acute, shock). The state of a series
    is five values; sessions that arrive late are not published again."""
    return stream.groupBy("series_id").applyInPandasWithState(_publish, "series_id string, idx bigint, raw_phase string, phase string", _STATE, "append", GroupStateTimeout.NoTimeout)
