"""Queries on the state of a market: scores, predicates, answers, phases, the target ledger and its audits.

The tables hold no market whose series overlap for long, so one is put together from the trade tables: a session is a ship
date, the seven tenors are line numbers with the average price of three days, spot and the other levels are the day's orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import capped_log_age, forward_variance, forward_volatility, log_ratio, ratio
from ..operators import audit, state
from ..operators.curve import curve_table
from ..operators.events import spell_age
from ..operators.windows import along, midrank_percentiles, trailing
from ..session import shared_dir, table

WINDOW, LEAST = 756, 504
M2 = (1000, 1060)  # sessions whose data were made by another method
CUT = "1999-06-30"
IV_DAYS = (9, 30, 93, 184)


def market(spark: SparkSession, sf_dir: str, cut: str | None = None) -> DataFrame:
    """(market, session_date, idx, decision_at, method, levels and curve facts) per session, missing ones null; `cut` leaves out what came later."""
    lines = _until(table(spark, sf_dir, "lineitem"), "l_shipdate", cut).groupBy(F.to_date("l_shipdate").alias("d"), F.col("l_linenumber").cast("int").alias("place"))
    cells = lines.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("c"), F.count("*").alias("n"))
    days = cells.select(F.col("d").alias("session_date")).distinct()
    days = days.select("session_date", F.row_number().over(along([], ["session_date"])).alias("idx"))  # a calendar of a few thousand days
    near = cells.select(F.explode(F.array(*[F.date_add("d", k) for k in range(3)])).alias("session_date"), "place", "c", "n")
    near = near.groupBy("session_date", "place").agg((F.sum("c") / F.sum("n") / 100).alias("settle")).join(days, "session_date")
    month = F.year("session_date") * 12 + F.month("session_date") - 1 + F.col("place")
    near = near.select(
        F.lit("M").alias("series_id"), "session_date", "place", F.concat(F.lit("C"), "place").alias("contract_id"), "settle", (F.col("place") * 30.0 - 20).alias("days"),
        F.lit("OBSERVED_PIT").alias("vintage_kind"), F.floor(month / 12).cast("int").alias("contract_year"), (month % 12).cast("int").alias("contract_month"),
    )
    curve = curve_table(near)
    ends = near.groupBy("session_date").agg(F.max(F.when(F.col("place") == 1, F.col("settle"))).alias("f1"), F.max(F.when(F.col("place") == 2, F.col("settle"))).alias("f2"))
    price, even = F.round(F.col("o_totalprice") * 100).cast("bigint"), F.col("o_orderkey") % 2 == 0
    spot = _until(table(spark, sf_dir, "orders"), "o_orderdate", cut).groupBy(F.to_date("o_orderdate").alias("session_date")).agg(
        (F.sum(price) / F.count("*") / 100).alias("vix"), (F.sum(F.when(even, price)) / F.count(F.when(even, 1)) / 100).alias("vix9d"),
        (F.max(price) / 100).alias("vvix"), (F.min(price) / 100).alias("skew"),
    )
    rows = days.join(curve, "session_date", "left").join(ends, "session_date", "left").join(spot, "session_date", "left")
    w = along(["market"], ["idx"])
    rows = rows.select(
        F.lit("M").alias("market"), "session_date", "idx", F.date_add("session_date", 1).cast("timestamp_ntz").alias("decision_at"), F.when(F.col("idx").between(M2[0], M2[1] - 1), "m2").otherwise("m1").alias("method"),
        "vix", "vix9d", "vvix", "skew", "f1", "f2", F.round("front_slope30", 9).alias("slope"), F.round("mid_level", 9).alias("mid"), F.round("mid_slope30", 9).alias("mid_slope"),
        F.col("mid_inversion_share").alias("inversion"), F.round("value30", 9).alias("value30"), F.coalesce("formal", F.lit(False)).alias("formal"),
        (F.col("f1").isNotNull() & F.col("f2").isNotNull()).alias("front_formal"),
    )
    return rows.withColumns({
        "basis": F.round(F.col("value30") / F.col("vix") - 1, 9), "near": F.round(log_ratio(F.col("vix9d"), F.col("vix")), 9),
        "premium": F.round(F.col("vvix") / F.col("vix") - 1, 9), "oscillator": F.round(F.col("vix") / F.avg("vix").over(trailing(w, 20)) - 1, 9),
    })


def ranked(spark: SparkSession, sf_dir: str, cut: str | None = None) -> DataFrame:
    """All percentiles come from one pass over the same cells."""
    rows = state.with_changes(market(spark, sf_dir, cut), "market", "idx")
    ranks = midrank_percentiles(rows, "market", "idx", state.RANKED, "method", WINDOW, LEAST, position="idx")
    return rows.join(ranks, ["market", "idx"])


def scored(spark: SparkSession, sf_dir: str, cut: str | None = None) -> DataFrame:
    return state.with_scores(ranked(spark, sf_dir, cut), "market", "idx")


def states(spark: SparkSession, sf_dir: str, cut: str | None = None) -> DataFrame:
    return state.with_answers(state.with_predicates(scored(spark, sf_dir, cut), "market", "idx"))


def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rows.select("session_date", *[F.round(c, 6).alias(c) for c in (*state.AXES, "base", "d5_base")], "confirmations", "hard_acute", "status", "compensation")


def scaled_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, the five-session change and the confirmations on a scale from 0 to 1."""
    rows = scored(spark, sf_dir)
    parts = {c: F.col(c) / 100 for c in state.AXES} | {"change": (F.col("d5_base") + 100) / 200, "confirmed": F.col("confirmations") / 3}
    return rows.select("session_date", *[F.round(state.scaled(x), 8).alias(c) for c, x in parts.items()])


def state_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.with_predicates(scored(spark, sf_dir), "market", "idx")
    return rows.select("session_date", "front", "priced", "rising", "receding", "mid_state", "scope", "open_day", "carry_state", "broad_day", "stress_day", "broad_now", "recent_stress", "repair_confirmed")


def predicate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.with_predicates(scored(spark, sf_dir), "market", "idx")
    return rows.select("session_date", "acute_formal", "slope_formal", "mid_formal", "broad_formal", "carry_formal", "repair_formal")


def axis_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five answers, the raw phase and what is published of the baseline, after sessions that aren't OK were withheld."""
    rows = states(spark, sf_dir)
    return rows.select("session_date", *state.ANSWERS, "raw_phase", "published_status", F.round("baseline", 6).alias("baseline"), F.round("d5_baseline", 6).alias("d5_baseline"), "pressure_level", "direction")


def target_ledger_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows a session: status, label and when the outcome became known."""
    return state.event_ledger(states(spark, sf_dir), "market", "idx", "session_date", "decision_at").drop("market", "idx")


def carry_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the spell in which carry may recover, and whether it is recovering."""
    ledger = state.event_ledger(states(spark, sf_dir), "market", "idx", "session_date", "decision_at").where("event_id = 'carry_environment_recovers_10d'")
    rows = spell_age(ledger, ["market"], "idx", F.col("event_status") == "ELIGIBLE").where("spell_age is not null")
    return rows.select("session_date", F.col("spell_age").cast("int").alias("spell_age"), F.round(capped_log_age(F.col("spell_age")), 9).alias("log_age"))


def component_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's weighted distance from the middle on the last session on which its axis is known, ranked: up to three
    drivers (.75 or more), two counters (.35 or less) and three repairs (.75 or more)."""
    rows = scored(spark, sf_dir)
    weight = state.BASELINE | {"repair": 1.0}
    items = F.array(*[
        F.struct(F.lit(axis).alias("axis"), F.lit(c).alias("component"), state._part(c).alias("p"), F.round(F.lit(weight[axis] * share) * (state._part(c) - 0.5), 9).alias("contribution"))
        for axis, parts in state.AXES.items() for c, share in parts
    ])
    long = rows.select("session_date", "idx", F.explode(items).alias("x")).select("session_date", "idx", "x.*").where("p is not null")
    side = (
        F.when((F.col("axis") == "repair") & (F.col("p") >= 0.75), "REPAIR").when(F.col("axis") == "repair", None)
        .when(F.col("p") >= 0.75, "DRIVER").when(F.col("p") <= 0.35, "COUNTER")
    )
    long = long.withColumn("side", side).where("side is not null")
    order = [F.when(F.col("side") == "COUNTER", F.col("contribution")).otherwise(-F.col("contribution")), F.col("axis"), F.col("component")]
    place = F.row_number().over(along(["session_date", "side"], []).orderBy(*order))
    return long.withColumn("place", place).where(F.col("place") <= F.when(F.col("side") == "COUNTER", 2).otherwise(3)).select("session_date", "side", "place", "axis", "component", "contribution")


def iv_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatilities of 9, 30, 93 and 184 days: ratios and log ratios of neighbours at both ends, forward variances and volatilities between all."""
    rows = market(spark, sf_dir)
    iv = [F.col(c) / 10_000 for c in ("vix9d", "vix", "vvix", "skew")]
    out = rows.select("session_date", F.round(ratio(iv[0], iv[1]), 7).alias("near_ratio"), F.round(ratio(iv[2], iv[3]), 7).alias("far_ratio"), F.round(log_ratio(iv[0], iv[1]), 7).alias("near_log"), F.round(log_ratio(iv[2], iv[3]), 7).alias("far_log"), *[
        forward_variance(iv[i], F.lit(float(IV_DAYS[i])), iv[i + 1], F.lit(float(IV_DAYS[i + 1]))).alias(f"v{i + 1}") for i in range(3)
    ])
    return out.select("session_date", "near_ratio", "far_ratio", "near_log", "far_log", *[F.round(f"v{i}", 7).alias(f"fvar{i}") for i in (1, 2, 3)], *[F.round(forward_volatility(F.col(f"v{i}")), 7).alias(f"fvol{i}") for i in (1, 2, 3)])


def lagged_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-valued windows over days of inversion: any of the ten before, however many there are, and three of the last five, all of which must be there."""
    w = along(["market"], ["idx"])
    day = (F.col("slope") < 0).cast("int")
    rows = market(spark, sf_dir)
    prior = F.coalesce(F.max(day).over(w.rowsBetween(-10, -1)) == 1, F.lit(False))
    five = F.when(F.count(day).over(trailing(w, 5)) == 5, F.sum(day).over(trailing(w, 5)) >= 3)
    return rows.select("session_date", prior.alias("any_prior"), five.alias("three_of_five"))


def _until(df: DataFrame, day: str, cut: str | None) -> DataFrame:
    return df if cut is None else df.where(F.to_date(day) <= F.lit(cut).cast("date"))


def append_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild from the sessions up to a day must give what the full history gives for them: percentiles, scores and answers,
    and the labels that were resolved by then. Counts compared rows and those that differ."""
    last = F.lit(CUT).cast("date")
    shared_dir(spark)
    full, part = states(spark, sf_dir).checkpoint(), states(spark, sf_dir, CUT).checkpoint()  # each is read twice
    seen = ["idx", *[F.round(f"p_{c}", 9).alias(f"p_{c}") for c in state.RANKED], *[F.round(c, 9).alias(c) for c in state.AXES], *state.ANSWERS, "raw_phase", "published_status"]
    resolved = F.coalesce(F.col("valid_through") <= last, F.lit(False))
    led = lambda df: state.event_ledger(df, "market", "idx", "session_date", "decision_at").where(resolved).select("idx", "event_id", "label", "label_status", "first_hit")
    out = None
    for name, a, b in (("states", full.where(F.col("session_date") <= last).select(*seen), part.select(*seen)), ("labels", led(full), led(part))):
        rows = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
        same = rows.groupBy(*[c for c in rows.columns if c != "side"]).agg(F.sum("side").alias("balance"), F.count("*").alias("n"))
        one = same.agg(F.lit(name).alias("what"), F.sum("n").alias("compared"), F.coalesce(F.sum(F.abs("balance")), F.lit(0)).alias("differing"))
        out = one if out is None else out.unionByName(one)
    return out.select("what", F.coalesce("compared", F.lit(0)).alias("compared"), "differing")


QUERIES = {
    f.__name__: f
    for f in (append_invariance, iv_curve, lagged_flags, axis_scores, scaled_predictors, state_predicates, predicate_evidence, axis_answers, target_ledger_build, carry_spells, component_evidence)
}

_RANKED = ", ".join(
    f"""case when a.{c} is not null and count(b.{c}) >= {LEAST} then (count(*) filter (b.{c} < a.{c}) + 0.5 * count(*) filter (b.{c} = a.{c})) / count(b.{c}) end as p_{c}"""
    for c in state.RANKED
)
_BRACKET = " ".join(
    f"when 30 * {i} - 20 <= 30 and 30 * {i + 1} - 20 > 30 then (30 * {i + 1} - 50) / 30.0 * s[{i}] + (50 - 30 * {i}) / 30.0 * s[{i + 1}]" for i in range(1, 7)
)


def _weighed(parts) -> str:
    name = lambda c: c[1:] if c[0] == "=" else f"(1 - p_{c[1:]})" if c[0] == "-" else f"p_{c}"
    return "0::double + " + " + ".join(f"{name(c)} * {100 * w!r}::double" for c, w in parts)


_MARKET = f"""ce as (select l_shipdate::date as d, l_linenumber::int as place, sum(round(l_extendedprice * 100)::bigint)::bigint as c, count(*) as n from lineitem group by all),
dy as (select session_date, row_number() over (order by session_date)::int as idx from (select distinct d as session_date from ce)),
nr as (select (d + k)::date as session_date, place, sum(c) / sum(n) / 100 as settle from ce, (values (0), (1), (2)) t(k) group by all),
cv as (select session_date, list(settle order by place) as s, count(*) as n, min(settle) as low, max(case when place = 1 then settle end) as f1, max(case when place = 2 then settle end) as f2,
  max(place) = count(*) as gapless, min(place) as first from nr group by session_date),
sp as (select o_orderdate::date as session_date, sum(round(o_totalprice * 100)::bigint) / count(*) / 100 as vix,
  sum(case when o_orderkey % 2 = 0 then round(o_totalprice * 100)::bigint end) / count(case when o_orderkey % 2 = 0 then 1 end) / 100 as vix9d,
  max(round(o_totalprice * 100)::bigint) / 100 as vvix, min(round(o_totalprice * 100)::bigint) / 100 as skew from orders group by o_orderdate::date),
m0 as (select dy.session_date, dy.idx, case when idx >= {M2[0]} and idx < {M2[1]} then 'm2' else 'm1' end as method, vix, vix9d, vvix, skew, f1, f2, coalesce(n = 7 and low > 0, false) as formal,
  f1 is not null and f2 is not null as front_formal,
  case when n >= 2 and s[1] > 0 and s[2] > 0 then round(ln(s[2] / s[1]) * 30 / (30 * (list_extract(pl, 2) - list_extract(pl, 1))), 9) end as slope,
  case when n = 7 and low > 0 then round((s[4] + s[5] + s[6] + s[7]) / 4, 9) end as mid, case when n = 7 and low > 0 then round(ln(s[7] / s[4]) * 30 / 90, 9) end as mid_slope,
  case when n = 7 and low > 0 then ((s[4] > s[5])::int + (s[5] > s[6])::int + (s[6] > s[7])::int) / 3 end as inversion,
  case when n = 7 and low > 0 then round(case {_BRACKET} end, 9) end as value30
  from dy left join cv using (session_date) left join sp using (session_date) left join (select session_date, list(place order by place) as pl from nr group by session_date) using (session_date)),
m1 as (select *, round(value30 / vix - 1, 9) as basis, case when vix > 0 and vix9d > 0 then round(ln(vix9d / vix), 9) end as near, round(vvix / vix - 1, 9) as premium,
  round(vix / avg(vix) over (order by idx rows between 19 preceding and current row) - 1, 9) as oscillator from m0),
m2 as (select *, case when vix > 0 and lag(vix) over w > 0 then round(ln(vix / lag(vix) over w), 9) end as d1_vix, case when vix > 0 and lag(vix, 5) over w > 0 then round(ln(vix / lag(vix, 5) over w), 9) end as d5_vix,
  case when vvix > 0 and lag(vvix, 5) over w > 0 then round(ln(vvix / lag(vvix, 5) over w), 9) end as d5_vvix, case when mid > 0 and lag(mid, 5) over w > 0 then round(ln(mid / lag(mid, 5) over w), 9) end as d5_mid,
  {", ".join(f"round({c} - lag({c}, 5) over w, 9) as d5_{c}" for c in ("slope", "near", "skew", "mid_slope", "inversion"))} from m1 window w as (order by idx)),
mr as (select a.idx as i, {_RANKED} from m2 a left join m2 b on b.idx < a.idx and b.idx >= a.idx - {WINDOW} and b.method = a.method group by a.idx, {", ".join("a." + c for c in state.RANKED)}),
s0 as (select m2.*, mr.* exclude (i), {", ".join(f"{_weighed(parts)} as {axis}" for axis, parts in state.AXES.items())} from m2 join mr on mr.i = m2.idx),
s1 as (select *, 0::double + {" + ".join(f"{a} * {w!r}::double" for a, w in state.BASELINE.items())} as base,
  case when vix9d is not null and vix is not null and f1 is not null and f2 is not null and p_oscillator is not null then (vix9d > vix)::int + (f1 > f2)::int + (p_oscillator >= 0.9)::int end as confirmations from s0),
sc as (select *, base - lag(base, 5) over (order by idx) as d5_base, case when shock is not null and confirmations is not null then shock >= 85 and confirmations >= 2 end as hard_acute,
  case when vix is null or value30 is null then 'UNKNOWN' when base is not null and repair is not null and formal then 'OK' else 'PARTIAL' end as status,
  case when p_premium is null then 'UNKNOWN' when p_premium < 0.35 then 'THIN' when p_premium >= 0.75 then 'RICH' else 'NORMAL' end as compensation from s1)"""
_STATES = """t0 as (select *, p_mid >= 0.75 or inversion >= 2 / 3 as priced, d5_mid > 0 and (d5_mid_slope < 0 or d5_inversion > 0) as rising, near > 0 or slope < 0 as front,
  d5_mid < 0 and (d5_mid_slope > 0 or d5_inversion < 0) as easing from sc),
t1 as (select *, case when count(*) filter (priced) over a > 0 then true when count(*) filter (not priced) over a = 10 then false end and easing as receding
  from t0 window a as (order by idx rows between 10 preceding and 1 preceding)),
t2 as (select *, case when receding then 'RECEDING' when receding is null then 'UNKNOWN' when priced then 'PRICED' when priced is null then 'UNKNOWN' when rising then 'RISING' when rising is null then 'UNKNOWN' else 'QUIET' end as mid_state from t1),
t3 as (select *, case when front is null or mid_state = 'UNKNOWN' then 'UNKNOWN' when mid_state in ('RISING', 'PRICED') then case when front then 'BROAD' else 'MID' end when front then 'FRONT' else 'NONE' end as scope,
  slope > 0 and basis > 0 and near <= 0 and mid_slope > 0 and nullif(mid_state, 'UNKNOWN') = 'QUIET' as open_day from t2),
t4 as (select *, case when open_day is null then 'UNKNOWN' when open_day and coalesce(lag(open_day) over (order by idx), false) then 'OPEN' when open_day or mid_state = 'RECEDING' then 'RECOVERING' else 'CLOSED' end as carry_state,
  nullif(scope, 'UNKNOWN') = 'BROAD' as broad_day, nullif(scope, 'UNKNOWN') <> 'NONE' or hard_acute as stress_day, nullif(mid_state, 'UNKNOWN') = 'RECEDING' as repair_confirmed from t3),
t5 as (select *, case when count(*) filter (broad_day) over a >= 3 then true when 5 - count(*) filter (not broad_day) over a < 3 then false end as broad_now,
  case when count(*) filter (stress_day) over b > 0 then true when count(*) filter (not stress_day) over b = 10 then false end as recent_stress
  from t4 window a as (order by idx rows between 4 preceding and current row), b as (order by idx rows between 9 preceding and current row)),
st as (select *, formal and hard_acute is not null as acute_formal, front_formal as slope_formal, formal and mid_state <> 'UNKNOWN' as mid_formal, formal and broad_day is not null as broad_formal,
  formal and carry_state <> 'UNKNOWN' as carry_formal, formal and repair_confirmed is not null as repair_formal from t5)"""
_ANSWERS = """a0 as (select *, case when carry_state = 'UNKNOWN' or slope is null then 'UNKNOWN' when carry_state = 'OPEN' then 'SUPPORTIVE' when slope < 0 then 'INVERTED' when carry_state = 'CLOSED' then 'STRESSED' else 'MIXED' end as ca,
  case when shock is null or confirmations is null then 'UNKNOWN' when hard_acute then 'ACUTE' when shock >= 65 then 'HIGH' when shock >= 40 then 'BUILDING' else 'CALM' end as sa,
  case when tail is null then 'UNKNOWN' when tail >= 90 then 'EXTREME' when tail >= 75 then 'RICH' when tail >= 60 then 'ELEVATED' else 'NORMAL' end as ta,
  case when broad_now is null or scope = 'UNKNOWN' or mid_state = 'UNKNOWN' then 'UNKNOWN' when broad_now then 'PERSISTENT' when scope = 'BROAD' and mid_state = 'RISING' then 'DIFFUSING' when scope = 'FRONT' then 'FRONT_LOCALIZED'
    when scope = 'NONE' and mid_state = 'QUIET' then 'NORMAL' else 'MIXED' end as pa,
  case when repair is null or repair_confirmed is null then 'UNKNOWN' when repair_confirmed then 'CONFIRMED' when recent_stress and repair >= 60 then 'BUILDING' when (recent_stress and repair >= 60) is null then 'UNKNOWN' else 'INACTIVE' end as ra from st),
a1 as (select *, case when status = 'OK' and 'UNKNOWN' in (ca, sa, ta, pa, ra) then 'PARTIAL' else status end as published_status from a0),
a2 as (select *, case when published_status = 'OK' then base end as baseline, case when published_status = 'OK' then d5_base end as d5_baseline, case when published_status <> 'OK' then 'UNKNOWN' when hard_acute then 'ACUTE_FRONT_STRESS'
  when pa = 'PERSISTENT' then 'BROAD_PERSISTENT_STRESS' when pa = 'DIFFUSING' then 'PRESSURE_DIFFUSING' when ra = 'CONFIRMED' then 'REPAIR_IN_PROGRESS' when pa = 'FRONT_LOCALIZED' then 'FRONT_LOCALIZED_STRESS'
  when ca = 'SUPPORTIVE' and sa = 'CALM' and pa = 'NORMAL' then case when ta in ('RICH', 'EXTREME') then 'TAIL_RICH_QUIET_CURVE' else 'CARRY_SUPPORTIVE_LOW_STRESS' end else 'MIXED_TRANSITION' end as raw_phase from a1),
an as (select *, case when baseline is null then 'UNKNOWN' when baseline < 35 then 'LOW' when baseline < 55 then 'WATCH' when baseline < 70 then 'ELEVATED' when baseline < 85 then 'HIGH' else 'EXTREME' end as pressure_level,
  case when d5_baseline is null then 'UNKNOWN' when d5_baseline >= 7.5 then 'RISING' when d5_baseline <= -7.5 then 'FALLING' else 'STABLE' end as direction from a2)"""
_FACTS = {
    "acute_front_stress_5d": ("not hard_acute", "hard_acute", "acute_formal", "carry_risk shock tail persistence d5_base confirmations"),
    "front_inversion_5d": ("slope >= 0", "slope < 0", "slope_formal", "p_slope p_d5_slope p_basis shock"),
    "mid_curve_pressure_accelerates_5d": ("nullif(mid_state, 'UNKNOWN') in ('QUIET', 'RECEDING')", "nullif(mid_state, 'UNKNOWN') = 'RISING'", "mid_formal", "p_mid p_d5_mid p_d5_mid_slope inversion shock d5_base"),
    "broad_stress_persists_10d": ("broad_day", "broad_day", "broad_formal", ""),
    "carry_environment_recovers_10d": (
        "nullif(carry_state, 'UNKNOWN') in ('CLOSED', 'RECOVERING') and (front or nullif(mid_state, 'UNKNOWN') <> 'QUIET')", "nullif(carry_state, 'UNKNOWN') = 'OPEN'", "carry_formal",
        "repair p_d5_slope p_d5_near p_d5_mid_slope p_d5_mid shock",
    ),
}


def _event_sql(event: str) -> str:
    onset, hit, evidence, inputs = _FACTS[event]
    horizon, needed = state.EVENTS[event]
    seen = " and ".join(["published_status = 'OK'", "formal", *[f"{c} is not null" for c in inputs.split()]])
    return f"""select session_date, idx, '{event}' as event_id, onset, event_status, case when event_status = 'ELIGIBLE' and whole then (list_count(hits) >= {needed})::int end as label,
      case when event_status = 'NOT_APPLICABLE' then 'NOT_APPLICABLE' when event_status = 'ELIGIBLE' and whole then case when list_count(hits) >= {needed} then 'OBSERVED_1' else 'OBSERVED_0' end else 'CENSORED' end as label_status,
      case when event_status = 'ELIGIBLE' and whole then hits[{needed}] end as first_hit, case when event_status = 'ELIGIBLE' and whole then through end as valid_through,
      case when event_status = 'ELIGIBLE' and whole then (through + 1)::timestamp end as outcome_available_at
      from (select session_date, idx, {onset} as onset, case when not ({seen}) or ({onset}) is null then 'UNOBSERVABLE' when {onset} then 'ELIGIBLE' else 'NOT_APPLICABLE' end as event_status,
        count(*) over w = {horizon} and count(case when ({hit}) is not null and {evidence} then 1 end) over w = {horizon} as whole, lead(session_date, {horizon}) over (order by idx) as through,
        list_filter(list(case when {hit} then idx end) over w, lambda x: x is not null) as hits from an window w as (order by idx rows between 1 following and {horizon} following))"""


_LEDGER = f"le as ({' union all '.join(map(_event_sql, _FACTS))})"
_SIDES = " union all ".join(
    f"""select session_date, '{axis}' as axis, '{c}' as component, {_weighed([(c, 0.01)])[12:].split(' * ')[0]} as p, round({(state.BASELINE | {'repair': 1.0})[axis] * w!r}::double * ({_weighed([(c, 0.01)])[12:].split(' * ')[0]} - 0.5), 9) as contribution from sc"""
    for axis, parts in state.AXES.items() for c, w in parts
)
_WITH = f"with {_MARKET}"


def _prefix(sql: str) -> str:
    """The same steps over the tables up to the cut, under other names."""
    steps = set(re.findall(r"(?:^|,\n?\s*)(\w+) as \(", sql))
    renamed = re.sub(r"\b(\w+)\b", lambda m: f"x_{m[1]}" if m[1] in steps else m[1], sql)
    return renamed.replace("from lineitem", f"from (select * from lineitem where l_shipdate::date <= date '{CUT}')").replace("from orders", f"from (select * from orders where o_orderdate::date <= date '{CUT}')")


def _compared(what: str, rows: str) -> str:
    other = re.sub(r"from (an|le)\b", r"from x_\1", rows)
    return f"""select '{what}' as what, ((select count(*) from ({rows})) + (select count(*) from ({other})))::bigint as compared,
      ((select count(*) from ({rows} except all {other})) + (select count(*) from ({other} except all {rows})))::bigint as differing"""


_ALL = f"{_WITH}, {_STATES}, {_ANSWERS}"
_SEEN = f"""select idx, {', '.join(f'round(p_{c}, 9)' for c in state.RANKED)}, {', '.join(f'round({c}, 9)' for c in state.AXES)}, {', '.join(f"case when published_status = 'OK' then {c} end" for c in ('ca', 'sa', 'ta', 'pa', 'ra'))},
  raw_phase, published_status from an where session_date <= date '{CUT}'"""
_SEEN_LABELS = f"select idx, event_id, label, label_status, first_hit from le where valid_through <= date '{CUT}'"
ORACLE = {
    "append_invariance": f"{_ALL}, {_LEDGER}, {_prefix(f'{_MARKET}, {_STATES}, {_ANSWERS}, {_LEDGER}')} {_compared('states', _SEEN)} union all {_compared('labels', _SEEN_LABELS)}",
    "iv_curve": f"""{_WITH}, i as (select session_date, vix9d / 10000 as a, vix / 10000 as b, vvix / 10000 as c, skew / 10000 as d from m0),
      v as (select *, {", ".join(f"({IV_DAYS[k + 1]} / 365 * pow({y} / 100, 2) - {IV_DAYS[k]} / 365 * pow({x} / 100, 2)) / ({IV_DAYS[k + 1]} / 365 - {IV_DAYS[k]} / 365) as v{k + 1}" for k, (x, y) in enumerate(("ab", "bc", "cd")))} from i)
      select session_date, case when b <> 0 then round(a / b, 7) end as near_ratio, case when d <> 0 then round(c / d, 7) end as far_ratio, case when a > 0 and b > 0 then round(ln(a / b), 7) end as near_log,
        case when c > 0 and d > 0 then round(ln(c / d), 7) end as far_log, {", ".join(f"round(v{k}, 7) as fvar{k}" for k in (1, 2, 3))}, {", ".join(f"case when v{k} >= 0 then round(sqrt(v{k}) * 100, 7) end as fvol{k}" for k in (1, 2, 3))} from v""",
    "lagged_flags": f"""{_WITH} select session_date, coalesce(bool_or(slope < 0) over a, false) as any_prior, case when count(slope) over b = 5 then sum((slope < 0)::int) over b >= 3 end as three_of_five
      from m0 window a as (order by idx rows between 10 preceding and 1 preceding), b as (order by idx rows between 4 preceding and current row)""",
    "axis_scores": f"{_WITH} select session_date, {', '.join(f'round({c}, 6) as {c}' for c in (*state.AXES, 'base', 'd5_base'))}, confirmations, hard_acute, status, compensation from sc",
    "scaled_predictors": f"""{_WITH} select session_date, {', '.join(f'case when {c} is not null then round(least(greatest({c} / 100, 0.0), 1.0), 8) end as {c}' for c in state.AXES)},
      case when d5_base is not null then round(least(greatest((d5_base + 100) / 200, 0.0), 1.0), 8) end as change, round(confirmations / 3, 8) as confirmed from sc""",
    "state_predicates": f"{_WITH}, {_STATES} select session_date, front, priced, rising, receding, mid_state, scope, open_day, carry_state, broad_day, stress_day, broad_now, recent_stress, repair_confirmed from st",
    "predicate_evidence": f"{_WITH}, {_STATES} select session_date, acute_formal, slope_formal, mid_formal, broad_formal, carry_formal, repair_formal from st",
    "axis_answers": f"""{_ALL} select session_date, {', '.join(f"case when published_status = 'OK' then {s} else 'UNKNOWN' end as {a}" for s, a in zip(('ca', 'sa', 'ta', 'pa', 'ra'), state.ANSWERS))}, raw_phase, published_status,
      round(baseline, 6) as baseline, round(d5_baseline, 6) as d5_baseline, pressure_level, direction from an""",
    "target_ledger_build": f"{_ALL}, {_LEDGER} select * exclude (idx) from le",
    "carry_spells": f"""{_ALL}, {_LEDGER}, e as (select session_date, idx, idx - row_number() over (order by idx) as isle from le where event_id = 'carry_environment_recovers_10d' and event_status = 'ELIGIBLE'),
      n as (select session_date, row_number() over (partition by isle order by idx)::int as spell_age from e) select session_date, spell_age, round(ln(1 + least(spell_age, 20)), 9) as log_age from n""",
    "component_evidence": f"""{_WITH}, l as ({_SIDES}), s as (select *, case when axis = 'repair' then case when p >= 0.75 then 'REPAIR' end when p >= 0.75 then 'DRIVER' when p <= 0.35 then 'COUNTER' end as side from l where p is not null),
      o as (select *, row_number() over (partition by session_date, side order by case when side = 'COUNTER' then contribution else -contribution end, axis, component)::int as place from s where side is not null)
      select session_date, side, place, axis, component, contribution from o where place <= case when side = 'COUNTER' then 2 else 3 end""",
}
