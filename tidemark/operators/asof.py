"""Attributes as they were known at an event's time (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import real, require_columns, shared_dir

#: Time buckets that a key's changes and events are cut into. A key has at most as many of them as the calendar
#: has hours, however many rows it holds.
BUCKET = "hour"


def clean(df: DataFrame, name: str) -> Column:
    """A payload column as it may come out: NaN is no reading, so it is null."""
    col = F.col(name)
    return real(col) if df.schema[name].dataType.typeName() in ("double", "float") else col


def changes(facts: DataFrame, keys: Sequence[str], known: str, tie_break: Sequence[str], payload: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """(keys, valid_from, payload): one row for each moment at which something became known of a key.

    Facts that became known at the same moment are settled by the greatest tie_break; a null `known`
    was never known. `only` restricts the keys by a semi-join, whose hot partitions AQE splits; behind it
    copies collapse on the map side of an aggregate, so a key that holds most of the rows is no hot task.
    """
    rows = facts.where(F.col(known).isNotNull())
    if only is not None:
        rows = rows.join(only, list(keys), "left_semi")
    best = F.max(F.struct(*tie_break, *[c for c in payload if c not in tie_break])).alias("best")
    # the struct key keeps the aggregate from taking over the join's partitioning, which would skip its map side
    found = rows.groupBy(F.struct(*keys).alias("key"), F.col(known).alias("valid_from")).agg(best)
    return found.select(*[F.col(f"key.{c}").alias(c) for c in keys], "valid_from", *[F.col(f"best.{c}").alias(c) for c in payload])


def known_intervals(found: DataFrame, asks: DataFrame, keys: Sequence[str], at: str, bucket: str = BUCKET) -> DataFrame:
    """(keys, at, fact) for the distinct asks: the fact (a struct with valid_from) in whose validity interval `at` lies.

    An interval reaches from its own change to the next one of its key. It is cut at the time buckets: the part
    in its own bucket ends there or at the next change; and it is handed on to each later bucket in which
    somebody asks, until a bucket that holds a change ends it. Facts and asks of a key and bucket meet by
    their equal key and bucket, and `valid_from <= at < next change` is settled by one merge along time, so
    a key with n changes and m asks costs n + m rows and never n x m pairs, and a hot key is spread over its buckets.
    The timeline is used twice, so it is written once to the shared folder.
    """
    shared_dir(found.sparkSession)
    keys = list(keys)
    fact = F.struct("valid_from", *[c for c in found.columns if c not in (*keys, "valid_from")])
    line = found.select(*keys, F.col("valid_from").alias("t"), fact.alias("fact"), F.lit(0).alias("ask"))
    line = line.unionByName(asks.select(*keys, F.col(at).alias("t"), F.lit(1).alias("ask")), allowMissingColumns=True)
    line = line.withColumn("b", F.date_trunc(bucket, "t")).checkpoint()
    so_far = Window.partitionBy(*keys, "b").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)  # a change at `at` itself is known
    inside = line.withColumn("here", F.last("fact", ignorenulls=True).over(so_far)).where("ask = 1").select(*keys, "b", "t", "here")
    cells = line.groupBy(*keys, "b").agg(F.max_by("fact", F.when(F.col("ask") == 0, F.col("t"))).alias("closing"), F.max("ask").alias("asked"))
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    handed = cells.withColumn("open", F.last("closing", ignorenulls=True).over(before)).where("asked = 1").select(*keys, "b", "open")
    return inside.join(handed, [*keys, "b"]).select(*keys, F.col("t").alias(at), F.coalesce("here", "open").alias("fact"))


def attributes_as_of(
    events: DataFrame,
    facts: DataFrame,
    event_id: str = "prediction_id",
    entity: str = "series_id",
    event_day: str = "prediction_date",
    event_time: str = "decision_at",
    fact_day: str = "session_date",
    known: str = "available_at",
    loaded: str = "ingested_at",
    payload: Sequence[str] = ("revision_id", "value"),
    bucket: str = BUCKET,
) -> DataFrame:
    """Each event once, with the payload of its entity and day as known at the event's time.

    Facts become validity intervals, the intervals are spread over time buckets, and events meet them
    by an equi-join on entity, day and bucket with half-open containment (`known_intervals`). Only entities
    that some event asks for are looked at, and events with the same entity, day and time ask once.

    Events that repeat an id come out once (the greatest row). Events with a null entity, day or time,
    or asked before anything was known, keep null payload. Facts without `known`, entity or day never
    count. A NaN in the payload is no reading and comes out as null. Columns: event_id, entity, event_day,
    event_time, known_from, payload...
    """
    require_columns(events, event_id, entity, event_day, event_time)
    require_columns(facts, entity, fact_day, known, loaded, *payload)
    asked = (
        events.select(
            F.col(event_id).alias("id"),
            F.struct(F.col(entity).alias("e"), F.col(event_day).cast("date").alias("d"), F.col(event_time).alias("at")).alias("x"),
        )
        .groupBy("id")
        .agg(F.max("x").alias("x"))
        .select("id", "x.e", "x.d", "x.at")
    )
    asks = asked.where("e is not null and d is not null and at is not null").select("e", "d", "at").distinct()
    tie = ["loaded"] + [f"p{i}" for i in range(len(payload))]
    rows = facts.select(
        F.col(entity).alias("e"), F.col(fact_day).cast("date").alias("d"), F.col(known).alias("known"), F.col(loaded).alias("loaded"),
        *[clean(facts, c).alias(f"p{i}") for i, c in enumerate(payload)],
    ).where("e is not null and d is not null and known is not null")
    found = changes(rows, ["e", "d"], "known", tie, tie[1:], asks.select("e", "d").distinct())
    hits = known_intervals(found, asks, ["e", "d"], "at", bucket)
    return asked.join(hits, ["e", "d", "at"], "left").select(
        F.col("id").alias(event_id), F.col("e").alias(entity), F.col("d").alias(event_day), F.col("at").alias(event_time),
        F.col("fact.valid_from").alias("known_from"), *[F.col(f"fact.p{i}").alias(c) for i, c in enumerate(payload)],
    )
