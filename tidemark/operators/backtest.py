"""Cost-aware ledgers of a strategy that holds one asset at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import along


def probe_ledger(days: DataFrame, key: str, order: str, asset: Column, ret: Column, nav: float = 10_000.0, cost: float = 0.0005) -> DataFrame:
    """Adds asset, turnover, growth, nav, peak and drawdown. The first row buys (turnover 1), a switch sells and
    buys (2), else 0; each unit of turnover costs `cost`. NAV compounds (1 - cost * turnover) * (1 + return), as a
    sum of logarithms; a null return counts as 0; the peak starts at the initial NAV."""
    w = along([key], [order])
    rows = days.withColumns({"asset": asset, "ret": F.coalesce(ret, F.lit(0.0))})
    before = F.lag("asset").over(w)
    turnover = F.when(before.isNull(), 1).when(before != F.col("asset"), 2).otherwise(0)
    rows = rows.withColumn("turnover", turnover).withColumn("growth", (1 - cost * F.col("turnover")) * (1 + F.col("ret")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nav", nav * F.exp(F.sum(F.ln("growth")).over(so_far)))
    peak = F.greatest(F.lit(nav), F.max("nav").over(so_far))
    return rows.withColumn("peak", peak).withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def compounded(ret: Column, n: int, w) -> Column:
    """Return over the last n rows; null unless all n are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(ret).over(frame) == n, F.exp(F.sum(F.ln(1 + ret)).over(frame)) - 1)
