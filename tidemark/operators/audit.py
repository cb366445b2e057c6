"""Scores of predictions, distributions, stability checks and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clipped
from .windows import along


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, floor: float = 1e-6) -> Column:
    q = clipped(p, floor, 1 - floor)
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def calibration_error(df: DataFrame, key: str, p: str, y: str, order: Sequence[str], bins: int = 5) -> DataFrame:
    """(key, ece): equal-count bins by (p, order); sum of size / n * |mean p - mean y|."""
    cut = F.ntile(bins).over(along([key], [p, *order]))
    per = df.withColumn("bin", cut).groupBy(key, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    return per.groupBy(key).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def reliability(df: DataFrame, key: str, p: str, y: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of fixed width; 0 belongs to the first."""
    b = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    return df.groupBy(key, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def distribution(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, quartiles (linear between readings) and the share of positives; missing values are out."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q"), F.avg((F.col(x) > 0).cast("double")).alias("positive"))
    return out.select(*keys, "n", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q25", "median", "q75"))], "positive")


def crosstab(df: DataFrame, left: str, right: str) -> DataFrame:
    counts = df.groupBy(left, right).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(left)))


def error_bundle(df: DataFrame, keys: Sequence[str], actual: str, estimate: str) -> DataFrame:
    """n, bias, mean absolute error, median, 95th and greatest absolute percentage error, correlation."""
    rows = df.where(F.col(actual).isNotNull() & F.col(estimate).isNotNull())
    e = F.col(estimate) - F.col(actual)
    ape = F.when(F.col(actual) != 0, F.abs(e / F.col(actual)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.percentile(ape, F.lit(0.5)).alias("median_ape"),
        F.percentile(ape, F.lit(0.95)).alias("p95_ape"), F.max(ape).alias("max_ape"), F.corr(actual, estimate).alias("correlation"),
    )


def leave_one_out_direction(df: DataFrame, key: str, x: str, sign: int = 1, least: int = 3) -> DataFrame:
    """Whether the median keeps its sign whichever single value is left out.

    With n sorted values only the middle ones decide: leaving out one of the lower values gives one median,
    one of the upper another, the middle a third. So three ranked look-ups stand for n medians, and nothing is
    paired. Below `least` values the evidence is insufficient.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(key).alias("k"), (F.col(x) * sign).alias("v"))
    place = rows.withColumns({"i": F.row_number().over(Window.partitionBy("k").orderBy("v")), "n": F.count("*").over(Window.partitionBy("k"))})
    h = F.floor(F.col("n") / 2)
    pick = lambda at: F.max(F.when(F.col("i") == at, F.col("v")))
    mid = place.where(F.col("i").between(h - 1, h + 2)).groupBy("k", "n").agg(pick(h - 1).alias("a"), pick(h).alias("b"), pick(h + 1).alias("c"), pick(h + 2).alias("d"))
    half = F.floor(F.col("n") / 2)
    # even n: leaving out one of the lower half gives c, of the upper half b; odd n: the lower half (c + d) / 2, the middle (b + d) / 2, the upper half (b + c) / 2
    even = (F.col("n") % 2) == 0
    score = lambda v: F.when(v > 0, 1).otherwise(0)
    kept = F.when(even, half * score(F.col("c")) + half * score(F.col("b"))).otherwise(
        half * score((F.col("c") + F.col("d")) / 2) + score((F.col("b") + F.col("d")) / 2) + half * score((F.col("b") + F.col("c")) / 2)
    )
    median = F.when(even, (F.col("b") + F.col("c")) / 2).otherwise(F.col("c"))
    few = F.col("n") < least
    status = F.when(few, "INSUFFICIENT_EVIDENCE").when(kept == F.col("n"), "STABLE").otherwise("UNSTABLE")
    return mid.select(F.col("k").alias(key), "n", F.when(~few, median * sign).alias("median"), F.when(~few, kept / F.col("n")).alias("rate"), status.alias("status"))


def gate(name: str, violations: DataFrame) -> DataFrame:
    """(gate, violations, passed) of a table that must be empty."""
    return violations.agg(F.lit(name).alias("gate"), F.count("*").alias("violations")).withColumn("passed", F.col("violations") == 0)
