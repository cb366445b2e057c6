"""Bitemporal selection: what was known when, and how late revisions enter the history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import fingerprint
from ..functions.vintage import is_formal, rank
from ..session import real


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per key: the payload of the row that is greatest in `order` (then in payload). An aggregate, so
    copies of a hot key collapse before the shuffle."""
    extra = [c for c in payload if c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *extra)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in payload])


def known_at_decision(observations: DataFrame, sessions: DataFrame, formal_only: bool = True) -> DataFrame:
    """(series_id, session_date, revision_id, value, available_at) as known at each session's own decision time.
    Rows of days that are no sessions, or that became known later, are out."""
    calendar = sessions.select("session_date", "decision_at")
    rows = observations.where(is_formal(F.col("vintage_kind"))) if formal_only else observations
    rows = rows.join(calendar, "session_date").where(F.col("available_at") <= F.col("decision_at"))
    rows = rows.withColumn("value", real(F.col("value")))
    return latest_row(rows, ["series_id", "session_date"], ["available_at", "ingested_at", "revision_id"], ["revision_id", "value", "available_at"])


def known_at(observations: DataFrame, cutoff: str) -> DataFrame:
    """The state of every point at one global moment."""
    rows = observations.where(F.col("available_at") <= F.lit(cutoff).cast("timestamp_ntz")).withColumn("value", real(F.col("value")))
    return latest_row(rows, ["series_id", "session_date"], ["available_at", "ingested_at", "revision_id"], ["revision_id", "value", "available_at"])


def merge_revisions(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], meaning: Sequence[str]) -> DataFrame:
    """Appends deliveries whose meaning is new. A new meaning for a point that is known already (in the history
    or earlier in the batch) is never backdated: it becomes available when it was loaded. The first delivery
    of a new point keeps its own time. Order within the batch: load time, available time, revision."""
    print_of = fingerprint(existing, [*keys, *meaning])
    old = existing.withColumn("print", print_of).select(*keys, *meaning, "available_at", "ingested_at", "revision_id", "print")
    new = incoming.withColumn("print", fingerprint(incoming, [*keys, *meaning]))
    order = ["ingested_at", "available_at", "revision_id"]
    first = new.groupBy("print", *keys).agg(F.min(F.struct(*order, *meaning)).alias("x")).select("print", *keys, "x.*")
    fresh = first.join(old.select("print").distinct(), "print", "left_anti")
    known = old.select(*keys).distinct().withColumn("known", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "print"))
    late = F.coalesce(F.col("known"), F.lit(False)) | (F.col("place") > 1)
    added = fresh.withColumn("place", place).join(known, list(keys), "left")
    added = added.withColumn("available_at", F.when(late, F.greatest("available_at", "ingested_at")).otherwise(F.col("available_at")))
    return old.drop("print").unionByName(added.select(*keys, *meaning, *order))


def admitted(df: DataFrame, policy: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose identity is in the policy table exactly; null matches nothing. Any policy size: Spark picks the join."""
    return df.join(policy.select(*columns).distinct(), list(columns), "left_semi")


def vintage_summary(df: DataFrame) -> DataFrame:
    """Per session: rows, series, weakest rank, and whether every row is formal."""
    return df.groupBy("session_date").agg(
        F.count("*").alias("n_rows"), F.countDistinct("series_id").alias("n_series"), F.min(rank(F.col("vintage_kind"))).alias("weakest_rank"),
        F.min(is_formal(F.col("vintage_kind"))).alias("formal"),
    )


def latest_complete_session(df: DataFrame, group: Column) -> DataFrame:
    """Per group of series: the last session on which all its series have a value."""
    rows = df.where(real(F.col("value")).isNotNull()).select(group.alias("grp"), "series_id", "session_date").where("grp is not null").distinct()
    needed = rows.groupBy("grp").agg(F.countDistinct("series_id").alias("n_needed"))
    daily = rows.groupBy("grp", "session_date").agg(F.count("*").alias("n"))
    full = daily.join(needed, "grp").where("n = n_needed")
    return needed.join(full.groupBy("grp").agg(F.max("session_date").alias("last_complete")), "grp", "left")


def freshness(df: DataFrame, target: str) -> DataFrame:
    """Per series: FRESH with a value on the target day, MISSING without any, STALE if it ends before it,
    INCOMPLETE with a row but no value, SESSION_GAP if it only goes on afterwards."""
    day, has = F.lit(target).cast("date"), real(F.col("value")).isNotNull()
    facts = df.groupBy("series_id").agg(
        F.max(F.when(has, F.col("session_date"))).alias("last_value_day"),
        F.max((F.col("session_date") == day) & has).alias("hit"), F.max(F.col("session_date") == day).alias("row"),
    )
    status = (
        F.when(F.col("last_value_day").isNull(), "MISSING").when(F.col("hit"), "FRESH").when(F.col("row"), "INCOMPLETE")
        .when(F.col("last_value_day") < day, "STALE").otherwise("SESSION_GAP")
    )
    return facts.select("series_id", "last_value_day", status.alias("status"))
