"""Totals and averages over trailing periods for every calendar day (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import real, require_columns


def current_readings(df: DataFrame, entity: str, day: str, value: str, loaded: str) -> DataFrame:
    """One row (e, k, v) per point: the value of its row with the greatest `loaded`; k counts days since 1970.

    A missing value (null or NaN) in that row means the point has no reading. Rows that tie on `loaded`
    are settled by the greatest value, missing ones last. Rows without entity or day are no points.
    """
    rows = df.select(
        F.col(entity).alias("e"),
        F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).alias("k"),
        F.col(loaded).alias("o"),
        real(F.col(value).cast("double")).alias("v"),
    ).where("e is not null and k is not null")
    return (
        rows.groupBy("e", "k")
        .agg(F.max(F.struct("o", "v")).alias("last"))
        .select("e", "k", F.col("last.v").alias("v"))
        .where("v is not null")
    )


def rolling_totals(
    df: DataFrame,
    entity: str = "series_id",
    day: str = "session_date",
    value: str = "value",
    loaded: str = "ingested_at",
    periods: Sequence[int] = (7, 30),
    bucket_days: int = 120,
) -> DataFrame:
    """Per entity and calendar day from its first to its last reading: total, average and number of
    readings over each trailing period, the day included. Days without activity come out with total 0,
    n 0 and a null average.

    Each daily total is exploded onto the output dates it influences. Before that it goes to the one or
    two (entity, date bucket) cells that hold those dates, so the wide rows arise inside a task and are
    summed there: what is shuffled is the readings, not their thirtyfold copies, and an entity with most
    of the rows is spread over its buckets. The calendar then joins in the empty days.

    Empty input gives an empty result. Columns: entity, as_of_day, then total_P, avg_P, n_P per period P.
    """
    require_columns(df, entity, day, value, loaded)
    longest, size = max(periods), int(bucket_days)
    readings = current_readings(df, entity, day, value, loaded)

    cells = readings.withColumn(
        "b", F.explode(F.expr(f"sequence(cast(floor(k / {size}) as int), cast(floor((k + {longest - 1}) / {size}) as int))"))
    ).repartition("e", "b")
    spread = cells.withColumn(
        "t", F.explode(F.expr(f"sequence(greatest(k, b * {size}), least(k + {longest - 1}, b * {size} + {size - 1}))"))
    ).withColumn("age", F.col("t") - F.col("k"))
    sums = []
    for p in periods:
        inside = F.col("age") < p
        sums += [F.sum(F.when(inside, F.col("v"))).alias(f"s{p}"), F.count(F.when(inside, 1)).alias(f"c{p}")]
    totals = spread.groupBy("e", "b", "t").agg(*sums)

    bounds = readings.groupBy("e").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    calendar = (
        bounds.withColumn("b", F.explode(F.expr(f"sequence(cast(floor(lo / {size}) as int), cast(floor(hi / {size}) as int))")))
        .repartition("e", "b")
        .withColumn("t", F.explode(F.expr(f"sequence(greatest(lo, b * {size}), least(hi, b * {size} + {size - 1}))")))
        .select("e", "b", "t")
    )
    out = [F.col("e").alias(entity), F.date_from_unix_date("t").alias("as_of_day")]
    for p in periods:
        n = F.coalesce(F.col(f"c{p}"), F.lit(0))
        out += [
            F.coalesce(F.col(f"s{p}"), F.lit(0.0)).alias(f"total_{p}"),
            F.when(n > 0, F.col(f"s{p}") / n).alias(f"avg_{p}"),
            n.alias(f"n_{p}"),
        ]
    return calendar.join(totals, ["e", "b", "t"], "left").select(*out)
