"""Readers for the vendors' file dialects. Headers are read on the driver, rows by Spark with explicit types."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import rule_settlement, snap_back
from ..functions.identity import fingerprint

# The month letters of futures symbols.
MONTH_LETTERS = "FGHJKMNQUVXZ"


def read_text_table(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A CSV with all columns as trimmed text under trimmed capital headers, plus the file's name and line order."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.csv(path)
    named = rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().upper()) for c in rows.columns], F.col("_metadata.file_name").alias("FILE_NAME"))
    return named.withColumn("ROW_ORDER", F.monotonically_increasing_id())


def number(text: Column) -> Column:
    """A finite number, without thousands separators and marks; anything else is null."""
    x = F.translate(text, ",*", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def day(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "MM/dd/yyyy"))


def last_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with the same key the last one in the file."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ROW_ORDER")))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def read_index_history(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """(series_id, session_date, value) from `DATE,OPEN,HIGH,LOW,CLOSE`, `DATE,CLOSE` or `DATE,<symbol>`: one row per
    reading, missing ones dropped, the last row of a repeated day."""
    rows = read_text_table(spark, path)
    if "DATE" not in rows.columns:
        raise ValueError(f"{path}: no DATE among {rows.columns}")
    rows = last_per_key(rows.withColumn("session_date", day(F.col("DATE"))).where("session_date is not null"), ["session_date"])
    parts = [c for c in ("OPEN", "HIGH", "LOW", "CLOSE") if c in rows.columns]
    if not parts:
        rest = [c for c in rows.columns if c not in ("DATE", "FILE_NAME", "ROW_ORDER", "session_date")]
        if symbol.upper() in rest:
            rest = [symbol.upper()]
        if len(rest) != 1:
            raise ValueError(f"{path}: which of {rest} is the close?")
        rows, parts = rows.withColumnRenamed(rest[0], "CLOSE"), ["CLOSE"]
    wide = rows.select("session_date", *[number(F.col(c)).alias(c) for c in parts])
    long = wide.unpivot("session_date", parts, "part", "value").where("value is not null")
    return long.select(F.concat(F.lit(f"{symbol.upper()}_"), "part").alias("series_id"), "session_date", "value")


def read_close_history(spark: SparkSession, path: str) -> DataFrame:
    """(session_date, value) from `DATE` with CLOSE, SPX or VALUE, or `observation_date,SP500`."""
    rows = read_text_table(spark, path)
    head = next((c for c in ("DATE", "OBSERVATION_DATE") if c in rows.columns), None)
    value = next((c for c in ("CLOSE", "SPX", "VALUE", "SP500") if c in rows.columns), None)
    if head is None or value is None:
        raise ValueError(f"{path}: unknown header {rows.columns}")
    out = rows.select(day(F.col(head)).alias("session_date"), number(F.col(value)).alias("value"), "ROW_ORDER").where("session_date is not null and value is not null")
    return last_per_key(out, ["session_date"]).drop("ROW_ORDER")


def read_contract_files(spark: SparkSession, folder: str, sessions: DataFrame) -> DataFrame:
    """Settlements from monthly files `VX_<settlement day>.csv`. Files of days that no monthly rule gives (weekly
    expiries) are left out; settlements that are missing or not above 0 are dropped."""
    rows = read_text_table(spark, folder, "VX_????-??-??.csv")
    rows = rows.withColumn("final_settlement_date", F.try_to_date(F.regexp_extract("FILE_NAME", r"VX_(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))
    months = sessions.select(F.year("session_date").alias("contract_year"), F.month("session_date").alias("contract_month")).distinct()
    rules = snap_back(months.withColumn("rule_day", rule_settlement(F.col("contract_year"), F.col("contract_month"))), "rule_day", sessions, "final_settlement_date")
    rows = rows.join(rules.select("final_settlement_date", "contract_year", "contract_month"), "final_settlement_date")  # one row a month of the calendar
    made = F.format_string("VX%04d%02d", "contract_year", "contract_month")
    ident = F.coalesce(F.nullif(F.col("FUTURES"), F.lit("")), made) if "FUTURES" in rows.columns else made
    out = rows.select(day(F.col("TRADE DATE")).alias("session_date"), ident.alias("contract_id"), "contract_year", "contract_month", "final_settlement_date", number(F.col("SETTLE")).alias("settle"), "ROW_ORDER")
    out = out.where("session_date is not null and settle > 0")
    return last_per_key(out, ["session_date", "contract_id"]).drop("ROW_ORDER")


def read_daily_settlement(spark: SparkSession, path: str, product: str = "VX") -> DataFrame:
    """(contract_id, expiration, settle) of one day's settlement file `Product,Symbol,Expiration Date,Price`. Symbols
    are `VX/F5`; a symbol whose month letter contradicts its expiry is refused."""
    rows = read_text_table(spark, path).where(F.col("PRODUCT") == product).where(F.col("SYMBOL").rlike(rf"^{re.escape(product)}/[{MONTH_LETTERS}]\d$"))
    letter = F.substring("SYMBOL", len(product) + 2, 1)
    due = day(F.col("EXPIRATION DATE"))
    fits = F.expr(f"instr('{MONTH_LETTERS}', substring(SYMBOL, {len(product) + 2}, 1))") == F.month(due)
    checked = rows.withColumn("expiration", F.when(fits, due).otherwise(F.raise_error(F.concat(F.lit("symbol and expiry disagree: "), "SYMBOL")).cast("date")))
    label = F.concat(letter, F.lit(" ("), F.date_format("expiration", "MMM yyyy"), F.lit(")"))
    return checked.select(label.alias("contract_id"), "expiration", number(F.col("PRICE")).alias("settle")).where("settle > 0")


def read_chart_json(spark: SparkSession, path: str, ticker: str, zone: str = "America/New_York") -> DataFrame:
    """(session_date, ticker, adjusted_open) from a chart document with parallel arrays: open * adjclose / close on
    the exchange's local date; entries with a missing part are dropped."""
    arrays = "struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,close:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"chart {arrays}").getField("chart").getField("result").getItem(0).alias("r"))
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), F.col("r.indicators.quote")[0]["open"].alias("o"), F.col("r.indicators.quote")[0]["close"].alias("c"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("a"))
    rows = doc.select(F.explode(zipped).alias("x")).select("x.*").toDF("t", "o", "c", "a")
    local = F.from_utc_timestamp(F.timestamp_seconds("t"), zone)
    return rows.select(F.to_date(local).alias("session_date"), F.lit(ticker).alias("ticker"), F.when(F.col("c") != 0, F.col("o") * F.col("a") / F.col("c")).alias("adjusted_open")).where("adjusted_open is not null")


def stamped(df: DataFrame, sessions: DataFrame, source: str, symbol: str, ingested_at: str, method: str, unit: str = "index_points") -> DataFrame:
    """Readings as assumed point-in-time observations: known from their session's decision time, identified by content."""
    rows = df.join(sessions.select("session_date", "observed_at", F.col("decision_at").alias("available_at")), "session_date")
    rows = rows.withColumns({
        "unit": F.lit(unit), "source": F.lit(source), "source_symbol": F.lit(symbol), "ingested_at": F.lit(ingested_at).cast("timestamp_ntz"),
        "methodology_version": F.lit(method), "vintage_kind": F.lit("ASSUMED_PIT"),
    })
    return rows.withColumn("revision_id", F.concat(F.lit("sha256:"), fingerprint(rows, ["series_id", "session_date", "value", "unit", "source", "source_symbol", "methodology_version"])))
