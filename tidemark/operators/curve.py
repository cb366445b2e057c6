"""Term structure of a family of dated contracts, one row per family and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import wall_time
from ..functions.scalars import log_ratio
from ..functions.vintage import is_formal
from ..session import epoch_seconds, real
from .pit import latest_row

SIZE = 7
TARGET_DAYS, FARTHEST_FRONT = 30, 36


def nearest_contracts(contracts: DataFrame, sessions: DataFrame, n: int = SIZE) -> DataFrame:
    """The n nearest standard monthly contracts of each family (series_id) and session, as known at decision time.

    Unexpired at 15:00 Chicago of the session and with a settlement; of contracts that settle at the same
    moment the greatest id holds. Adds `place` from 1 and `days` to settlement.
    """
    rows = contracts.join(sessions.select("session_date", "decision_at"), "session_date")
    rows = rows.where((F.col("available_at") <= F.col("decision_at")) & F.coalesce(F.col("is_standard_monthly"), F.lit(False)))
    payload = ["revision_id", "contract_year", "contract_month", "settle", "vintage_kind"]
    rows = latest_row(rows, ["series_id", "session_date", "final_settlement_timestamp", "contract_id"], ["available_at", "ingested_at", "revision_id"], payload)
    cutoff = wall_time(F.col("session_date"), 15, 0, "America/Chicago")
    rows = rows.withColumn("settle", real(F.col("settle"))).where(F.col("settle").isNotNull() & (F.col("final_settlement_timestamp") > cutoff))
    rows = latest_row(rows, ["series_id", "session_date", "final_settlement_timestamp"], ["contract_id"], ["contract_id", *payload])
    days = (epoch_seconds(F.col("final_settlement_timestamp")) - epoch_seconds(cutoff)) / 86400
    place = F.row_number().over(Window.partitionBy("series_id", "session_date").orderBy("final_settlement_timestamp"))
    return rows.withColumns({"days": days, "place": place}).where(F.col("place") <= n)


def _at(i: int, field: str) -> Column:
    return F.get(F.col("curve"), F.lit(i - 1)).getField(field)


def _all_pairs(a: int, b: int, test) -> Column:
    out = F.lit(True)
    for i in range(a, b):
        out = out & test(i, i + 1)
    return out


def _inversions(a: int, b: int) -> Column:
    """How many neighbours between places a and b fall."""
    total = F.lit(0)
    for i in range(a, b):
        total = total + F.when(_at(i, "settle") > _at(i + 1, "settle"), 1).otherwise(0)
    return total


def curve_table(nearest: DataFrame) -> DataFrame:
    """Slopes, levels, inversion shares and the constant 30-day value of each curve.

    Mid-curve facts and the 30-day value need a complete curve (seven distinct positive contracts of
    consecutive months) of formal vintages only; what can't be known is null.
    """
    item = F.struct("place", "contract_id", "settle", "days", "vintage_kind", (F.col("contract_year") * 12 + F.col("contract_month")).alias("month"))
    rows = nearest.groupBy("series_id", "session_date").agg(F.sort_array(F.collect_list(item)).alias("curve"))  # at most seven
    full = F.size("curve") == SIZE
    months = _all_pairs(1, SIZE, lambda i, j: F.coalesce(_at(j, "month") - _at(i, "month") == 1, F.lit(False)))
    complete = full & months & F.forall("curve", lambda c: c["settle"] > 0) & (F.size(F.array_distinct(F.col("curve.contract_id"))) == SIZE)
    formal = complete & F.forall("curve", lambda c: is_formal(c["vintage_kind"]))
    rows = rows.withColumns({"complete": F.coalesce(complete, F.lit(False)), "formal": F.coalesce(formal, F.lit(False))})
    s1, s2, d1, d2 = _at(1, "settle"), _at(2, "settle"), _at(1, "days"), _at(2, "days")
    pair = (s1 > 0) & (s2 > 0) & (d2 > d1)
    front, mid = (s1 + s2) / 2, (_at(4, "settle") + _at(5, "settle") + _at(6, "settle") + _at(7, "settle")) / 4
    value, kind = F.lit(None).cast("double"), F.lit("UNAVAILABLE")
    back = (d1 > TARGET_DAYS) & (d1 <= FARTHEST_FRONT)
    value = F.when(back, s1 + (s2 - s1) * (TARGET_DAYS - d1) / (d2 - d1))
    kind = F.when(back, "BOUNDED_BACKWARD_EXTRAPOLATION").otherwise(kind)
    for i in range(SIZE - 1, 0, -1):
        near, far = _at(i, "days"), _at(i + 1, "days")
        inside = (near <= TARGET_DAYS) & (far > TARGET_DAYS)
        mix = (far - TARGET_DAYS) / (far - near) * _at(i, "settle") + (TARGET_DAYS - near) / (far - near) * _at(i + 1, "settle")
        value, kind = F.when(inside, mix).otherwise(value), F.when(inside, "DIRECT_BRACKET_INTERPOLATION").otherwise(kind)
    only = F.col("formal")
    return rows.select(
        "series_id", "session_date", F.size("curve").alias("n_contracts"), "complete", "formal",
        F.when(pair, s2 / s1 - 1).alias("ts12"), F.when(pair, F.ln(s2 / s1) * 30 / (d2 - d1)).alias("front_slope30"),
        F.when(only, front).alias("front_level"), F.when(only, mid).alias("mid_level"),
        F.when(only, F.ln(_at(7, "settle") / _at(4, "settle")) * 30 / (_at(7, "days") - _at(4, "days"))).alias("mid_slope30"),
        F.when(only, _inversions(4, 7) / 3).alias("mid_inversion_share"), F.when(only, log_ratio(mid, front)).alias("front_to_mid"),
        F.when(F.col("complete"), _inversions(1, 6) / 5).alias("inversion_share"),
        F.when(only, value).alias("value30"), F.when(only, kind).otherwise(F.lit("UNAVAILABLE")).alias("value30_kind"),
    )
