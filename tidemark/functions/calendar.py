"""Sessions, decision times and settlement dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def indexed_sessions(sessions: DataFrame, day: str = "session_date") -> DataFrame:
    """(session_date, idx, decision_at): a dense index over the calendar, a dimension of a few thousand rows."""
    return sessions.select(F.col(day).alias("session_date"), F.row_number().over(Window.orderBy(day)).alias("idx"), "decision_at")


def wall_time(day: Column, hour: int, minute: int, zone: str) -> Column:
    """UTC wall clock (without a zone) of a local time on a day, daylight saving included."""
    local = F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(minute), F.lit(0), F.lit(zone))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local.cast("timestamp_ntz"))


def third_friday(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "FR"), 14)


def rule_settlement(year: Column, month: Column) -> Column:
    """Thirty days before the third Friday of the next month, holidays left to `snap_back`."""
    following = F.add_months(F.make_date(year, month, F.lit(1)), 1)
    return F.date_sub(third_friday(F.year(following), F.month(following)), 30)


def snap_back(df: DataFrame, day: str, sessions: DataFrame, out: str) -> DataFrame:
    """Adds `out`: the last session on or before `day`, however long the closure; null before the first. Distinct days and sessions are
    merged along time, which are rows of the calendar, and joined back by the day."""
    asked = df.select(F.col(day).alias("__d")).where("__d is not null").distinct().withColumn("__s", F.lit(None).cast("date"))
    line = asked.unionByName(sessions.select(F.col("session_date").alias("__d"), F.col("session_date").alias("__s")))
    so_far = Window.orderBy("__d", F.col("__s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    near = line.withColumn(out, F.last("__s", ignorenulls=True).over(so_far)).where("__s is null").select("__d", out)
    return df.join(near, F.col(day) == F.col("__d"), "left").drop("__d")
