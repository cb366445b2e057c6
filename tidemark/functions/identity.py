"""Content identity: one canonical text per row, the same whatever the engine or partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(df: DataFrame, name: str) -> Column:
    """The column as text that loses nothing; null has a token of its own, NaN counts as null."""
    kind, col = df.schema[name].dataType.simpleString(), F.col(name)
    if kind in ("double", "float"):
        text = F.when(col.isNotNull() & ~F.isnan(col), F.format_string("%.17g", col.cast("double")))
    elif kind.startswith("timestamp"):
        text = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        text = col.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit("~"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\x01", *[canonical(df, c) for c in columns]), 256)


def frame_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n_rows, low, high): an order-free digest. Row hashes are added up in four 32-bit lanes, so it
    combines before the shuffle and needs no sort; copies count."""
    h = fingerprint(df, columns)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    sums = df.agg(F.count("*").alias("n_rows"), *[x.alias(f"lane{i}") for i, x in enumerate(lanes)])
    return sums.select("n_rows", F.sha2(F.concat_ws("-", *[F.coalesce(F.col(f"lane{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))
