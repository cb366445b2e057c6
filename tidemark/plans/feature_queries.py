"""Queries on daily features: changes, percentiles, technical measures, curves, scores, states and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalars import bucket, capped_log_age, forward_variance, forward_volatility, scaled_change, weighted_score
from ..operators import folds
from ..operators.curve import curve_table, nearest_contracts
from ..operators.windows import along, any_true, at_least_true, filled, level_change, log_change, midrank_percentile, midrank_percentiles, run_number, trailing
from ..session import table
from .pit_queries import CAL, R, on_calendar

WINDOW, LEAST = 756, 504  # sessions before a reading that its percentile looks at, and valid ones it needs


def _order() -> WindowSpec:
    return along(["series_id"], ["idx"])


def _bars_order() -> WindowSpec:
    return along(["symbol"], ["session_date"])


def log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = on_calendar(spark, sf_dir), F.col("value")
    return rows.select("series_id", "session_date", *[F.round(log_change(x, k, _order()), 9).alias(f"log_{k}") for k in (1, 5, 10)])


def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = on_calendar(spark, sf_dir), F.col("value")
    return rows.select("series_id", "session_date", *[F.round(level_change(x, k, _order()), 6).alias(f"d_{k}") for k in (1, 5, 20)])


def midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midrank_percentile(on_calendar(spark, sf_dir), "series_id", "session_date", "value", window=756, minimum=504, position="idx")


def _with_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = on_calendar(spark, sf_dir)
    last = table(spark, sf_dir, "observations").groupBy("series_id", "session_date").agg(F.max(F.struct("ingested_at", "methodology_version")).alias("x"))
    known = last.select("series_id", "session_date", F.col("x.methodology_version").alias("method"))
    return rows.join(known, ["series_id", "session_date"], "left").withColumn("method", filled(F.col("method"), _order()))


def midrank_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midrank_percentile(_with_method(spark, sf_dir), "series_id", "session_date", "value", signature="method", window=WINDOW, minimum=LEAST, position="idx")


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_calendar(spark, sf_dir).select("series_id", "session_date", filled(F.col("value"), _order()).alias("value"))


def value_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of sessions with a value."""
    rows = on_calendar(spark, sf_dir).withColumn("has", F.col("value").isNotNull())
    rows = rows.withColumn("segment", run_number(F.col("has") & ~F.coalesce(F.lag("has").over(_order()), F.lit(False)), _order())).where("has")
    return rows.groupBy("series_id", "segment").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"), F.count("*").alias("n"))




def _true_range(close_before: Column) -> Column:
    whole = F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return F.when(whole, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close_before), F.abs(F.col("low") - close_before)))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the order prices, one symbol per priority."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("session_date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close")
    )


def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir)
    return rows.select("symbol", "session_date", F.round(_true_range(F.lag("close").over(_bars_order())), 6).alias("true_range")).where("true_range is not null")


def stochastic_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """%K over 14 and %D over 3 sessions of each series' own value; a flat window gives 50."""
    rows, frame = on_calendar(spark, sf_dir), trailing(_order(), 14)
    low, high = F.min("value").over(frame), F.max("value").over(frame)
    k = F.when(F.count("value").over(frame) == 14, F.when(high == low, 50.0).otherwise(100 * (F.col("value") - low) / (high - low)))
    rows = rows.withColumn("k", k)
    d = F.when(F.count("k").over(trailing(_order(), 3)) == 3, F.avg("k").over(trailing(_order(), 3)))
    return rows.select("series_id", "session_date", F.round("k", 6).alias("k"), F.round(d, 6).alias("d")).where("k is not null")


def _fold(spark: SparkSession, sf_dir: str, outputs, state) -> DataFrame:
    return folds.stream_fold(on_calendar(spark, sf_dir), ["series_id"], ["idx"], ["value"], outputs, state)


def seeded_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    def state():
        a = folds.ema(20)
        return lambda row: (a.push(row[0]),)

    return _fold(spark, sf_dir, [("ema", "double")], state).select("series_id", "idx", F.round("ema", 6).alias("ema")).where("ema is not null")


def wilder_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    def state():
        a = folds.Wilder(14)
        return lambda row: (a.push(row[0]),)

    return _fold(spark, sf_dir, [("wilder", "double")], state).select("series_id", "idx", F.round("wilder", 6).alias("wilder")).where("wilder is not null")


def wilder_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average true range of each symbol over its rows with bars, as it is and against the close."""
    rows = bars(spark, sf_dir).withColumn("tr", _true_range(F.lag("close").over(_bars_order())))

    def state():
        a = folds.Wilder(14)
        return lambda row: (a.push(row[0]), None if row[1] is None else row[1])

    out = folds.stream_fold(rows, ["symbol"], ["session_date"], ["tr", "close"], [("atr", "double"), ("close", "double")], state)
    return out.where("atr is not null").select("symbol", "session_date", F.round("atr", 6).alias("atr"), F.round(F.when(F.col("close") != 0, F.col("atr") / F.col("close")), 6).alias("atr_share"))


def rsi14(spark: SparkSession, sf_dir: str) -> DataFrame:
    def state():
        a = folds.Rsi(14)
        return lambda row: (a.push(row[0]),)

    return _fold(spark, sf_dir, [("rsi", "double")], state).select("series_id", "idx", F.round("rsi", 6).alias("rsi")).where("rsi is not null")


def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    def state():
        a = folds.Macd()
        return lambda row: a.push(row[0])

    out = _fold(spark, sf_dir, [("line", "double"), ("signal", "double")], state)
    return out.select("series_id", "idx", F.round("line", 6).alias("line"), F.round("signal", 6).alias("signal")).where("line is not null")


def cash_oscillator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value - EMA20) / Wilder14 of the absolute daily move, 0 without movement; and EMA5 / EMA20 - 1."""

    def state():
        fast, slow, move, last = folds.ema(5), folds.ema(20), folds.Wilder(14), [None]

        def step(row):
            x = row[0]
            a, b = fast.push(x), slow.push(x)
            m = move.push(None if x is None or last[0] is None else abs(x - last[0]))
            last[0] = x
            osc = None if b is None or m is None else 0.0 if m == 0 else (x - b) / m
            return osc, None if a is None or not b else a / b - 1

        return step

    out = _fold(spark, sf_dir, [("oscillator", "double"), ("trend", "double")], state)
    return out.select("series_id", "idx", F.round("oscillator", 6).alias("oscillator"), F.round("trend", 6).alias("trend")).where("trend is not null or oscillator is not null")


def ewma_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decaying variance of log returns, and the premium of the level's own square over the annual variance."""
    rows = on_calendar(spark, sf_dir).withColumn("x", F.when(F.col("value") > 0, F.ln("value")))

    def state():
        a = folds.EwmaVariance()
        return lambda row: (a.push(row[0]), row[1])

    out = folds.stream_fold(rows, ["series_id"], ["idx"], ["x", "value"], [("variance", "double"), ("value", "double")], state)
    premium = F.pow(F.col("value") / 100, F.lit(2.0)) - 252 * F.col("variance")
    return out.where("variance is not null").select("series_id", "idx", F.round("variance", 9).alias("variance"), F.round(premium, 6).alias("premium"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_contracts(table(spark, sf_dir, "vx_contracts"), table(spark, sf_dir, "exchange_sessions"))


def nearest_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("series_id", "session_date", "place", "contract_id", "settle", F.round("days", 6).alias("days"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_table(_nearest(spark, sf_dir))


def curve_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("series_id", "session_date", "n_contracts", "complete", "formal", "inversion_share")


def curve_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["ts12", "front_slope30", "front_level", "mid_level", "mid_slope30", "mid_inversion_share", "front_to_mid"]
    return _curve(spark, sf_dir).select("series_id", "session_date", *[F.round(c, 7).alias(c) for c in cols])


def constant_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("series_id", "session_date", F.round("value30", 7).alias("value30"), "value30_kind")


def forward_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between neighbouring contracts, taking a settlement as the volatility of its tenor."""
    rows = _nearest(spark, sf_dir)
    w = along(["series_id", "session_date"], ["place"])
    var = forward_variance(F.col("settle"), F.col("days"), F.lead("settle").over(w), F.lead("days").over(w))
    rows = rows.withColumn("fvar", var).where("fvar is not null")
    return rows.select("series_id", "session_date", "place", F.round("fvar", 12).alias("fvar"), F.round(forward_volatility(F.col("fvar")), 6).alias("fvol"))


def state_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each series and session from percentiles of its level and of its changes, isolated by methodology."""
    base = _with_method(spark, sf_dir)
    x = F.col("value")
    base = base.withColumns({"d1": F.round(level_change(x, 1, _order()), 6), "d5": F.round(level_change(x, 5, _order()), 6)})
    ranks = midrank_percentiles(base, "series_id", "session_date", ["value", "d1", "d5"], "method", WINDOW, LEAST, position="idx")
    out = base.select("series_id", "session_date", "idx", "value", "d1", "d5").join(ranks, ["series_id", "session_date"])
    shock = weighted_score([(F.col("p_value"), 0.5), (F.col("p_d1"), 0.25), (F.col("p_d5"), 0.25)])
    carry = weighted_score([(1 - F.col("p_value"), 0.75), (1 - F.col("p_d5"), 0.25)])
    out = out.withColumns({"shock": shock, "carry": carry})
    confirmations = F.when(F.col("p_value").isNotNull() & F.col("p_d1").isNotNull() & F.col("p_d5").isNotNull(), sum((F.col(c) >= 0.75).cast("int") for c in ("p_value", "p_d1", "p_d5")))
    out = out.withColumn("confirmations", confirmations)
    return out.withColumns({
        "hard_acute": (F.col("shock") >= 85) & (F.col("confirmations") >= 2),
        "status": F.when(F.col("value").isNull(), "UNKNOWN").when(F.col("shock").isNotNull() & F.col("carry").isNotNull(), "OK").otherwise("PARTIAL"),
        "open_day": (F.col("p_value") < 0.5) & (F.col("d5") <= 0), "pressure_day": (F.col("p_value") >= 0.75) & (F.col("d1") > 0),
    })


def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_frame(spark, sf_dir).select("series_id", "session_date", F.round("shock", 9).alias("shock"), F.round("carry", 9).alias("carry"), "confirmations", "hard_acute", "status").where("shock is not null")


def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state_frame(spark, sf_dir)
    names = ["CALM", "NORMAL", "ELEVATED", "HIGH", "EXTREME"]
    change = F.col("shock") - F.lag("shock", 5).over(_order())
    direction = F.when(change >= 7.5, "RISING").when(change <= -7.5, "FALLING").when(change.isNotNull(), "FLAT")
    rows = rows.select("series_id", "session_date", bucket(F.col("shock"), [35, 55, 70, 85], names).alias("level"), direction.alias("direction"), F.round(scaled_change(change), 9).alias("scaled"))
    return rows.where("level is not null")


def tri_any_prior10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state_frame(spark, sf_dir)
    known = any_true(F.col("pressure_day"), _order().rowsBetween(-10, -1), 10)
    return rows.select("series_id", "session_date", known.alias("any_prior"), any_true(F.col("pressure_day"), trailing(_order(), 10), 10).alias("recent"))


def tri_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state_frame(spark, sf_dir)
    return rows.select("series_id", "session_date", at_least_true(F.col("pressure_day"), trailing(_order(), 5), 5, 3).alias("now"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state_frame(spark, sf_dir)
    prior = any_true(F.col("pressure_day"), _order().rowsBetween(-10, -1), 10)
    rows = rows.withColumns({"receding": prior & (F.col("d5") < 0), "priced": F.col("p_value") >= 0.75, "rising": (F.col("d5") > 0) & (F.col("d1") > 0), "now": at_least_true(F.col("pressure_day"), trailing(_order(), 5), 5, 3)})
    mid = F.when(F.col("receding"), "RECEDING").when(F.col("receding").isNull(), "UNKNOWN").when(F.col("priced"), "PRICED").when(F.col("priced").isNull(), "UNKNOWN").when(F.col("rising"), "RISING").when(F.col("rising").isNull(), "UNKNOWN").otherwise("QUIET")
    yesterday = F.lag("open_day").over(_order())
    carry = F.when(F.col("open_day").isNull(), "UNKNOWN").when(~F.col("open_day"), "CLOSED").when(yesterday.isNull(), "UNKNOWN").when(yesterday, "OPEN").otherwise("RECOVERING")
    return rows.withColumns({"mid_state": mid, "carry_state": carry})


def mid_state_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("series_id", "session_date", "mid_state")


def carry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("series_id", "session_date", "carry_state")


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir)
    shock = F.col("shock")
    answer = F.when(shock >= 85, "ACUTE").when(shock >= 65, "HIGH").when(shock >= 40, "BUILDING").when(shock.isNotNull(), "CALM").otherwise("UNKNOWN")
    rows = rows.withColumn("answer", answer)
    supportive = (F.col("carry_state") == "OPEN") & (F.col("answer") == "CALM")
    raw = (
        F.when((F.col("status") != "OK") | (F.col("carry_state") == "UNKNOWN") | (F.col("mid_state") == "UNKNOWN"), "UNKNOWN").when(F.col("hard_acute"), folds.ACUTE)
        .when(F.col("now"), "PERSISTENT_BROAD_STRESS").when((F.col("mid_state") == "RISING") & (F.col("answer") == "HIGH"), "DIFFUSING_STRESS")
        .when(F.col("mid_state") == "RECEDING", "REPAIR_CONFIRMED").when(supportive & (F.col("p_d5") >= 0.5), "TAIL_RICH_QUIET_CURVE")
        .when(supportive, "CARRY_SUPPORTIVE_LOW_STRESS").otherwise("MIXED_TRANSITION")
    )
    return rows.withColumn("raw_phase", raw)


def phase_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phases(spark, sf_dir).select("series_id", "session_date", "answer", "raw_phase")


def published_phases(rows: DataFrame) -> DataFrame:
    def state():
        h = folds.Hysteresis()
        return lambda row: (row[0], h.push(row))

    inputs = rows.withColumn("counts", F.col("status") == "OK")
    return folds.stream_fold(inputs, ["series_id"], ["idx"], ["raw_phase", "counts", "hard_acute", "shock", "idx"], [("raw_phase", "string"), ("phase", "string")], state)


def phase_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published_phases(_phases(spark, sf_dir)).select("series_id", "idx", "raw_phase", "phase")


def churn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often raw and published phases change in each series."""
    rows = published_phases(_phases(spark, sf_dir))
    change = lambda c: F.sum(F.when(F.col(c) != F.col(f"{c}_0"), 1).otherwise(0))
    rows = rows.withColumns({f"{c}_0": F.lag(c).over(_order()) for c in ("raw_phase", "phase")})
    return rows.groupBy("series_id").agg(change("raw_phase").alias("raw_changes"), change("phase").alias("published_changes"), F.count("*").alias("n"))


def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series and session up to three drivers (percentile of .75 or more, largest contribution first) and up
    to two counters (.35 or less, smallest first)."""
    rows = state_frame(spark, sf_dir)
    weights = {"p_value": 0.5, "p_d1": 0.25, "p_d5": 0.25}
    items = F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).alias("p"), (F.lit(w) * (F.col(c) - 0.5)).alias("c")) for c, w in weights.items()])
    long = rows.select("series_id", "session_date", F.explode(items).alias("x")).select("series_id", "session_date", "x.*").where("p is not null")
    side = F.when(F.col("p") >= 0.75, "DRIVER").when(F.col("p") <= 0.35, "COUNTER")
    long = long.withColumn("side", side).where("side is not null")
    order = [F.when(F.col("side") == "DRIVER", -F.col("c")).otherwise(F.col("c")), F.col("id")]
    place = F.row_number().over(Window.partitionBy("series_id", "session_date", "side").orderBy(*order))
    return long.withColumn("place", place).where(F.col("place") <= F.when(F.col("side") == "DRIVER", 3).otherwise(2)).select("series_id", "session_date", "side", "place", "id", F.round("c", 9).alias("contribution"))


def state_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.events import spell_age

    rows = spell_age(_states(spark, sf_dir), ["series_id"], "idx", F.col("carry_state").isin("OPEN", "RECOVERING"))
    return rows.where("spell_age is not null").select("series_id", "session_date", "spell_age", F.round(capped_log_age(F.col("spell_age")), 9).alias("log_age"))


QUERIES = {
    f.__name__: f
    for f in (
        log_changes, level_changes, midrank, midrank_by_regime, forward_fill, value_segments, true_range, stochastic_kd, seeded_ema, wilder_average, wilder_atr, rsi14, macd,
        cash_oscillator, ewma_variance, nearest_curve, curve_completeness, curve_slopes, constant_maturity, forward_variances, weighted_scores, score_buckets, tri_any_prior10,
        tri_k_of_n, mid_state_ladder, carry_state, phase_ladder, phase_hysteresis, churn_count, evidence_topk, state_spells,
    )
}

G = f"with recursive {R}, {CAL}"
W_SQL = "window w as (partition by series_id order by idx)"
LN = "case when value > 0 and lag(value, {k}) over w > 0 then round(ln(value / lag(value, {k}) over w), 9) end as log_{k}"
METHOD = """m0 as (select series_id, session_date, max(struct_pack(o := ingested_at, m := methodology_version)).m as m from observations group by all),
gm as (select g.*, last_value(m0.m ignore nulls) over (partition by g.series_id order by g.idx rows between unbounded preceding and current row) as method
  from g left join m0 using (series_id, session_date))"""


def _rank_sql(source: str, column: str, window: int, least: int, signature: str | None = None) -> str:
    same = f"and b.{signature} = a.{signature}" if signature else ""
    own = f"and a.{signature} is not null" if signature else ""
    return f"""select a.series_id, a.session_date, case when a.{column} is not null {own} and count(b.{column}) >= {least}
      then (count(*) filter (b.{column} < a.{column}) + 0.5 * count(*) filter (b.{column} = a.{column})) / count(b.{column}) end as percentile
      from {source} a left join {source} b on b.series_id = a.series_id and b.idx < a.idx and b.idx >= a.idx - {window} {same} group by a.series_id, a.session_date, a.{column}{", a." + signature if signature else ""}"""


# the segment's seed row holds the mean of its first n values; later rows follow it one by one
def _fold_sql(n: int, step: str, source: str = "g", key: str = "series_id", idx: str = "idx", x: str = "value", p: str = "") -> str:
    a, b, f = f"{p}a", f"{p}b", f"{p}f"
    step = step.replace("b.", f"{b}.").replace("f.", f"{f}.")
    return f"""{a} as (select {key} as k, {idx} as i, {x} as x, sum(case when {x} is null then 1 else 0 end) over (partition by {key} order by {idx}) as s from {source}),
    {b} as materialized (select k, i, x, row_number() over (partition by k, s order by i) as pos, avg(x) over (partition by k, s order by i rows between {n - 1} preceding and current row) as seed from {a} where x is not null),
    {f} as (select k, i, pos, seed as level from {b} where pos = {n} union all select {b}.k, {b}.i, {b}.pos, {step} from {f} join {b} on {b}.k = {f}.k and {b}.i = {f}.i + 1 and {b}.pos = {f}.pos + 1)"""


def _ema_sql(n: int, source: str = "g", p: str = "") -> str:
    w = 2 / (n + 1)
    return _fold_sql(n, f"{w!r} * b.x + (1 - {w!r}) * f.level", source, p=p)


def _wilder_sql(n: int, x: str, p: str) -> str:
    return _fold_sql(n, f"(f.level * {n - 1} + b.x) / {n}", "mv", x=x, p=p)


MOVES = """mv as (select series_id, idx, value, value - lag(value) over w as d, greatest(value - lag(value) over w, 0.0) as up, greatest(lag(value) over w - value, 0.0) as down,
  abs(value - lag(value) over w) as size from g window w as (partition by series_id order by idx))"""


CURVE = """near as (
  select *, row_number() over (partition by series_id, session_date order by final_settlement_timestamp) as place,
    (epoch(final_settlement_timestamp) - epoch(observed - interval 15 minute)) / 86400 as days from (
    select * from (
      select v.series_id, v.session_date, v.final_settlement_timestamp, v.contract_id, v.contract_year, v.contract_month,
        case when isnan(v.settle) then null else v.settle end as settle, v.vintage_kind, s.observed_at as observed
      from vx_contracts v join exchange_sessions s using (session_date) where v.available_at <= s.decision_at and v.is_standard_monthly
      qualify row_number() over (partition by v.series_id, v.session_date, v.final_settlement_timestamp, v.contract_id order by v.available_at desc, v.ingested_at desc, v.revision_id desc,
        v.contract_year desc, v.contract_month desc, v.settle desc nulls last, v.vintage_kind desc) = 1)
    where settle is not null and final_settlement_timestamp > observed - interval 15 minute
    qualify row_number() over (partition by series_id, session_date, final_settlement_timestamp order by contract_id desc) = 1)
  qualify row_number() over (partition by series_id, session_date order by final_settlement_timestamp) <= 7),
c as (select series_id, session_date, count(*) as n, bool_and(settle > 0) as pos, count(distinct contract_id) as ids,
    bool_and(vintage_kind in ('OBSERVED_PIT', 'ASSUMED_PIT')) as fv, max(contract_year * 12 + contract_month - place) - min(contract_year * 12 + contract_month - place) as off,
    list(settle order by place) as s, list(days order by place) as d from near group by all),
cc as (select *, coalesce(n = 7 and off = 0 and pos and ids = 7, false) as complete, coalesce(n = 7 and off = 0 and pos and ids = 7 and fv, false) as formal from c)"""


def _inv(a: int, b: int) -> str:
    return "(" + " + ".join(f"(s[{i}] > s[{i + 1}])::int" for i in range(a, b)) + ")"


def _brackets() -> tuple[str, str]:
    value, kind = "", ""
    for i in range(1, 7):
        inside = f"when d[{i}] <= 30 and d[{i + 1}] > 30"
        value += f" {inside} then (d[{i + 1}] - 30) / (d[{i + 1}] - d[{i}]) * s[{i}] + (30 - d[{i}]) / (d[{i + 1}] - d[{i}]) * s[{i + 1}]"
        kind += f" {inside} then 'DIRECT_BRACKET_INTERPOLATION'"
    back = "when d[1] > 30 and d[1] <= 36"
    return f"case {value} {back} then s[1] + (s[2] - s[1]) * (30 - d[1]) / (d[2] - d[1]) end", f"case {kind} {back} then 'BOUNDED_BACKWARD_EXTRAPOLATION' else 'UNAVAILABLE' end"


STATE = f"""{METHOD},
x as (select *, round(value - lag(value) over w, 6) as d1, round(value - lag(value, 5) over w, 6) as d5 from gm {W_SQL}),
pv as ({_rank_sql("x", "value", WINDOW, LEAST, "method")}), p1 as ({_rank_sql("x", "d1", WINDOW, LEAST, "method")}), p5 as ({_rank_sql("x", "d5", WINDOW, LEAST, "method")}),
st0 as (select x.series_id, x.session_date, x.idx, x.value, x.d1, x.d5, pv.percentile as p_value, p1.percentile as p_d1, p5.percentile as p_d5
  from x join pv using (series_id, session_date) join p1 using (series_id, session_date) join p5 using (series_id, session_date)),
st1 as (select *, 0.0::double + p_value * 50.0::double + p_d1 * 25.0::double + p_d5 * 25.0::double as shock, 0.0::double + (1 - p_value) * 75.0::double + (1 - p_d5) * 25.0::double as carry,
  case when p_value is not null and p_d1 is not null and p_d5 is not null then (p_value >= 0.75)::int + (p_d1 >= 0.75)::int + (p_d5 >= 0.75)::int end as confirmations from st0),
st as (select *, shock >= 85 and confirmations >= 2 as hard_acute, case when value is null then 'UNKNOWN' when shock is not null and carry is not null then 'OK' else 'PARTIAL' end as status,
  p_value < 0.5 and d5 <= 0 as open_day, p_value >= 0.75 and d1 > 0 as pressure_day from st1)"""
TRI = """tri as (select *, count(*) filter (pressure_day) over a as y10, count(*) filter (not pressure_day) over a as n10, count(*) filter (pressure_day) over b as y5, count(*) filter (not pressure_day) over b as n5,
  count(*) filter (pressure_day) over c as yr, count(*) filter (not pressure_day) over c as nr, lag(open_day) over (partition by series_id order by idx) as before_open
  from st window a as (partition by series_id order by idx rows between 10 preceding and 1 preceding), b as (partition by series_id order by idx rows between 4 preceding and current row),
    c as (partition by series_id order by idx rows between 9 preceding and current row)),
t2 as (select *, case when y10 > 0 then true when n10 = 10 then false end as any_prior, case when yr > 0 then true when nr = 10 then false end as recent,
  case when y5 >= 3 then true when 5 - n5 < 3 then false end as now from tri),
t3 as (select *, any_prior and d5 < 0 as receding, p_value >= 0.75 as priced, d5 > 0 and d1 > 0 as rising from t2),
t4 as (select *, case when receding then 'RECEDING' when receding is null then 'UNKNOWN' when priced then 'PRICED' when priced is null then 'UNKNOWN' when rising then 'RISING' when rising is null then 'UNKNOWN' else 'QUIET' end as mid_state,
  case when open_day is null then 'UNKNOWN' when not open_day then 'CLOSED' when before_open is null then 'UNKNOWN' when before_open then 'OPEN' else 'RECOVERING' end as carry_state,
  case when shock >= 85 then 'ACUTE' when shock >= 65 then 'HIGH' when shock >= 40 then 'BUILDING' when shock is not null then 'CALM' else 'UNKNOWN' end as answer from t3),
ph as (select *, case when status <> 'OK' or carry_state = 'UNKNOWN' or mid_state = 'UNKNOWN' then 'UNKNOWN' when hard_acute then 'ACUTE_FRONT_STRESS' when now then 'PERSISTENT_BROAD_STRESS'
  when mid_state = 'RISING' and answer = 'HIGH' then 'DIFFUSING_STRESS' when mid_state = 'RECEDING' then 'REPAIR_CONFIRMED'
  when carry_state = 'OPEN' and answer = 'CALM' and p_d5 >= 0.5 then 'TAIL_RICH_QUIET_CURVE' when carry_state = 'OPEN' and answer = 'CALM' then 'CARRY_SUPPORTIVE_LOW_STRESS' else 'MIXED_TRANSITION' end as raw_phase from t4)"""
S = f"{G}, {STATE}"
T = f"{S}, {TRI}"
SLOW_SQL = "(h.phase, q.raw) in (('MIXED_TRANSITION', 'TAIL_RICH_QUIET_CURVE'), ('MIXED_TRANSITION', 'CARRY_SUPPORTIVE_LOW_STRESS'), ('TAIL_RICH_QUIET_CURVE', 'CARRY_SUPPORTIVE_LOW_STRESS'))"
SEEN = "(case when h.target = q.raw and q.i = h.i + 1 then h.seen + 1 else 1 end)"
CALM = "(case when q.raw <> 'ACUTE_FRONT_STRESS' and q.acute = false and q.shock < 75 then h.calm + 1 else 0 end)"
HYST = f"""q as materialized (select series_id as k, idx as i, raw_phase as raw, status = 'OK' as ok, hard_acute as acute, shock from ph),
h as (select k, i, raw, raw as phase, 0 as calm, null::varchar as target, 0 as seen from q where i = (select min(i) from q q2 where q2.k = q.k)
  union all select q.k, q.i, q.raw,
    case when not q.ok or q.raw = 'UNKNOWN' then q.raw when h.phase = 'ACUTE_FRONT_STRESS' then case when {CALM} >= 2 then q.raw else h.phase end
      when {SLOW_SQL} then case when {SEEN} >= 3 then q.raw else h.phase end else q.raw end,
    case when not q.ok or q.raw = 'UNKNOWN' or h.phase <> 'ACUTE_FRONT_STRESS' or {CALM} >= 2 then 0 else {CALM} end,
    case when q.ok and q.raw <> 'UNKNOWN' and h.phase <> 'ACUTE_FRONT_STRESS' and {SLOW_SQL} and {SEEN} < 3 then q.raw end,
    case when q.ok and q.raw <> 'UNKNOWN' and h.phase <> 'ACUTE_FRONT_STRESS' and {SLOW_SQL} and {SEEN} < 3 then {SEEN} else 0 end
  from h join q on q.k = h.k and q.i = h.i + 1)"""
WIDE = """wide as (select o_orderpriority as symbol, o_orderdate::date as session_date, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
  min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close from orders group by all)"""
TR_SQL = "case when high is not null and low is not null and close is not null then greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end"
BARS = f"tr as (select symbol, session_date, close, {TR_SQL} as tr, row_number() over w as n from wide window w as (partition by symbol order by session_date))"
ORACLE = {
    "log_changes": f"{G} select series_id, session_date, {', '.join(LN.format(k=k) for k in (1, 5, 10))} from g {W_SQL}",
    "level_changes": f"{G} select series_id, session_date, {', '.join(f'round(value - lag(value, {k}) over w, 6) as d_{k}' for k in (1, 5, 20))} from g {W_SQL}",
    "midrank": f"{G} {_rank_sql('g', 'value', 756, 504)}",
    "midrank_by_regime": f"{G}, {METHOD} {_rank_sql('gm', 'value', WINDOW, LEAST, 'method')}",
    "forward_fill": f"{G} select series_id, session_date, last_value(value ignore nulls) over (partition by series_id order by idx rows between unbounded preceding and current row) as value from g",
    "value_segments": f"""{G}, h as (select *, value is not null and lag(value) over w is null as begins from g {W_SQL}),
      n as (select *, sum(case when begins then 1 else 0 end) over (partition by series_id order by idx rows between unbounded preceding and current row)::bigint as segment from h)
      select series_id, segment, min(session_date) as first, max(session_date) as last, count(*) as n from n where value is not null group by all""",
    "true_range": f"with {WIDE}, {BARS} select symbol, session_date, round(tr, 6) as true_range from tr where tr is not null",
    "stochastic_kd": f"""{G}, k as (select series_id, session_date, idx, case when count(value) over a = 14 then case when max(value) over a = min(value) over a then 50.0
        else 100 * (value - min(value) over a) / (max(value) over a - min(value) over a) end end as k from g window a as (partition by series_id order by idx rows between 13 preceding and current row)),
      d as (select *, case when count(k) over b = 3 then avg(k) over b end as d from k window b as (partition by series_id order by idx rows between 2 preceding and current row))
      select series_id, session_date, round(k, 6) as k, round(d, 6) as d from d where k is not null""",
    "seeded_ema": f"{G}, {_ema_sql(20)} select k as series_id, i as idx, round(level, 6) as ema from f",
    "wilder_average": f"{G}, {_fold_sql(14, '(f.level * 13 + b.x) / 14')} select k as series_id, i as idx, round(level, 6) as wilder from f",
    "wilder_atr": f"""with recursive {WIDE}, {BARS}, {_fold_sql(14, "(f.level * 13 + b.x) / 14", "tr", "symbol", "n", "tr")}
      select k as symbol, tr.session_date, round(level, 6) as atr, round(case when tr.close <> 0 then level / tr.close end, 6) as atr_share from f join tr on tr.symbol = f.k and tr.n = f.i""",
    "rsi14": f"""{G}, {MOVES}, {_wilder_sql(14, "case when d is not null then up end", "u")}, {_wilder_sql(14, "case when d is not null then down end", "l")}
      select uf.k as series_id, uf.i as idx, round(case when lf.level = 0 then case when uf.level = 0 then 50.0 else 100.0 end else 100 - 100 / (1 + uf.level / lf.level) end, 6) as rsi from uf join lf on uf.k = lf.k and uf.i = lf.i""",
    "macd": f"""{G}, {_ema_sql(12, p="q")}, {_ema_sql(26, p="t")}, ln as (select g.series_id, g.idx, qf.level - tf.level as value from g left join qf on qf.k = g.series_id and qf.i = g.idx left join tf on tf.k = g.series_id and tf.i = g.idx),
      {_ema_sql(9, "ln", "z")} select ln.series_id, ln.idx, round(ln.value, 6) as line, round(zf.level, 6) as signal from ln left join zf on zf.k = ln.series_id and zf.i = ln.idx where ln.value is not null""",
    "cash_oscillator": f"""{G}, {MOVES}, {_ema_sql(5, p="q")}, {_ema_sql(20, p="t")}, {_wilder_sql(14, "size", "w")},
      o as (select g.series_id, g.idx, case when tf.level is not null and wf.level is not null then case when wf.level = 0 then 0.0 else (g.value - tf.level) / wf.level end end as oscillator,
        case when tf.level <> 0 then qf.level / tf.level - 1 end as trend from g left join qf on qf.k = g.series_id and qf.i = g.idx left join tf on tf.k = g.series_id and tf.i = g.idx left join wf on wf.k = g.series_id and wf.i = g.idx)
      select series_id, idx, round(oscillator, 6) as oscillator, round(trend, 6) as trend from o where oscillator is not null or trend is not null""",
    "ewma_variance": f"""{G}, r0 as (select series_id as k, idx as i, value, case when value > 0 then ln(value) end - lag(case when value > 0 then ln(value) end) over (partition by series_id order by idx) as r from g),
      r1 as (select *, sum(case when r is null then 1 else 0 end) over (partition by k order by i) as s from r0),
      r2 as (select *, row_number() over (partition by k, s order by i) as pos, var_samp(r) over (partition by k, s order by i rows between 251 preceding and current row) as v from r1 where r is not null),
      r3 as (select k, min(i) as i0 from r2 where pos = 252 group by k), r4 as materialized (select r2.*, row_number() over (partition by r2.k order by r2.i) as n from r2 join r3 using (k) where r2.i >= r3.i0),
      e as (select k, i, n, value, v as level from r4 where n = 1 union all select r4.k, r4.i, r4.n, r4.value, 0.94 * e.level + (1 - 0.94) * r4.r * r4.r from e join r4 on r4.k = e.k and r4.n = e.n + 1)
      select k as series_id, i as idx, round(level, 9) as variance, round(pow(value / 100, 2) - 252 * level, 6) as premium from e""",
    "nearest_curve": f"with {CURVE} select series_id, session_date, place::int as place, contract_id, settle, round(days, 6) as days from near",
    "curve_completeness": f"with {CURVE} select series_id, session_date, n::int as n_contracts, complete, formal, case when complete then {_inv(1, 6)} / 5 end as inversion_share from cc",
    "curve_slopes": f"""with {CURVE} select series_id, session_date, case when s[1] > 0 and s[2] > 0 then round(s[2] / s[1] - 1, 7) end as ts12,
      case when s[1] > 0 and s[2] > 0 then round(ln(s[2] / s[1]) * 30 / (d[2] - d[1]), 7) end as front_slope30,
      case when formal then round((s[1] + s[2]) / 2, 7) end as front_level, case when formal then round((s[4] + s[5] + s[6] + s[7]) / 4, 7) end as mid_level,
      case when formal then round(ln(s[7] / s[4]) * 30 / (d[7] - d[4]), 7) end as mid_slope30, case when formal then round({_inv(4, 7)} / 3, 7) end as mid_inversion_share,
      case when formal then round(ln(((s[4] + s[5] + s[6] + s[7]) / 4) / ((s[1] + s[2]) / 2)), 7) end as front_to_mid from cc""",
    "constant_maturity": f"with {CURVE} select series_id, session_date, case when formal then round({_brackets()[0]}, 7) end as value30, case when formal then {_brackets()[1]} else 'UNAVAILABLE' end as value30_kind from cc",
    "forward_variances": f"""with {CURVE}, n2 as (select *, lead(settle) over w as s2, lead(days) over w as d2 from near window w as (partition by series_id, session_date order by place)),
      v as (select *, (d2 / 365 * pow(s2 / 100, 2) - days / 365 * pow(settle / 100, 2)) / (d2 / 365 - days / 365) as fvar from n2 where s2 is not null)
      select series_id, session_date, place::int as place, round(fvar, 12) as fvar, case when fvar >= 0 then round(sqrt(fvar) * 100, 6) end as fvol from v""",
    "weighted_scores": f"{S} select series_id, session_date, round(shock, 9) as shock, round(carry, 9) as carry, confirmations, hard_acute, status from st where shock is not null",
    "score_buckets": f"""{S}, c as (select *, shock - lag(shock, 5) over w as ch from st {W_SQL})
      select series_id, session_date, case when shock < 35 then 'CALM' when shock < 55 then 'NORMAL' when shock < 70 then 'ELEVATED' when shock < 85 then 'HIGH' else 'EXTREME' end as level,
      case when ch >= 7.5 then 'RISING' when ch <= -7.5 then 'FALLING' when ch is not null then 'FLAT' end as direction,
      case when ch is not null then round(least(greatest((ch + 100) / 200, 0.0), 1.0), 9) end as scaled from c where shock is not null""",
    "tri_any_prior10": f"{T} select series_id, session_date, any_prior, recent from t2",
    "tri_k_of_n": f"{T} select series_id, session_date, now from t2",
    "mid_state_ladder": f"{T} select series_id, session_date, mid_state from t4",
    "carry_state": f"{T} select series_id, session_date, carry_state from t4",
    "phase_ladder": f"{T} select series_id, session_date, answer, raw_phase from ph",
    "phase_hysteresis": f"{T}, {HYST} select k as series_id, i as idx, raw as raw_phase, phase from h",
    "churn_count": f"""{T}, {HYST}, l as (select *, lag(raw) over (partition by k order by i) as r0, lag(phase) over (partition by k order by i) as p0 from h)
      select k as series_id, sum(case when raw <> r0 then 1 else 0 end)::bigint as raw_changes, sum(case when phase <> p0 then 1 else 0 end)::bigint as published_changes, count(*) as n from l group by all""",
    "evidence_topk": f"""{S}, l as (select series_id, session_date, 'p_value' as id, p_value as p, 0.5::double * (p_value - 0.5) as c from st union all select series_id, session_date, 'p_d1', p_d1, 0.25::double * (p_d1 - 0.5) from st
        union all select series_id, session_date, 'p_d5', p_d5, 0.25::double * (p_d5 - 0.5) from st),
      s as (select *, case when p >= 0.75 then 'DRIVER' when p <= 0.35 then 'COUNTER' end as side from l where p is not null),
      o as (select *, row_number() over (partition by series_id, session_date, side order by case when side = 'DRIVER' then -c else c end, id) as place from s where side is not null)
      select series_id, session_date, side, place::int as place, id, round(c, 9) as contribution from o where place <= case when side = 'DRIVER' then 3 else 2 end""",
    "state_spells": f"""{T}, e as (select *, carry_state in ('OPEN', 'RECOVERING') as inn, idx - row_number() over (partition by series_id, carry_state in ('OPEN', 'RECOVERING') order by idx) as isle from t4)
      select series_id, session_date, row_number() over (partition by series_id, isle order by idx)::int as spell_age,
        round(ln(1 + least(row_number() over (partition by series_id, isle order by idx), 20)), 9) as log_age from e where inn""",
}
